"""Prefix overlaps between reads: a k-mer equi-join with a theta condition, verified and reduced to the best.

Reads are indexed by 36-mers at offsets 0, 12, 24, ... and probed by the 36-mers at offsets 0 to 11, so that
any overlap of 47 bases or more meets an indexed offset. The anchors of one k-mer are capped at twelve, the
earliest; a kernel applies it before the shuffle, so hot k-mers stay small, and packs four bases to a byte. Candidates are
verified by slices of at most 291 bases, cut once for each place that they refer to.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.batches import binaries, by_pieces, flat
from strandlake.functions.scalars import BASES
from strandlake.sources.archive import scratch

K, STEP, MAX_MATCH, CAP, MIN_LOG = 36, 12, 291, 12, -1.0
_CODES = np.arange(256)
_GOOD = (_CODES >= 34) & (_CODES <= 126)
#: log10 of the probability that a base of this quality is right.
LOGS = np.where(_GOOD, np.log10(1 - 10.0 ** (-(np.where(_GOOD, _CODES, 34) - 33) / 10.0)), -10.0)


def _sums(data: np.ndarray, k: int) -> np.ndarray:
    """The sum of logs of k symbols from each place on.

    One running sum over the bytes of the batch, taken anew in pieces so that its error stays below the rounding.
    """
    logs, sums = LOGS[data], np.zeros(max(0, len(data) - k + 1))
    for begin in range(0, len(sums), 1 << 14):
        total = np.concatenate(([0.0], np.cumsum(logs[begin : begin + (1 << 14) + k - 1])))
        sums[begin : begin + (1 << 14)] = total[k:] - total[:-k]
    return sums


def _offsets(n: np.ndarray, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Row and offset of n offsets of each row, ``step`` apart."""
    row = np.repeat(np.arange(len(n)), n)
    return row, (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * step


def _windows(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For all windows of k symbols of all rows: row and the sum of logs, to nine places."""
    data, at = flat(column)
    row, off = _offsets(np.maximum(np.diff(at) - k + 1, 0))
    return row, np.round(_sums(data, k)[at[row] + off], 9)


def window_logs(reads: DataFrame, k: int = K, min_log: float = MIN_LOG) -> DataFrame:
    """(rec_no, windows, eligible, best): windows of k positions, those whose bases are all right with a log10
    probability above ``min_log``, and the best log10."""

    def stats(quality: pa.Array) -> pa.Array:
        row, sums = _windows(quality, k)
        n = np.bincount(row, minlength=len(quality))
        best = np.full(len(quality), -np.inf)
        np.maximum.at(best, row, sums)
        columns = [pa.array(n.astype(np.int32)), pa.array(np.bincount(row[sums > min_log], minlength=len(quality)).astype(np.int32)), pa.array(best, mask=n == 0)]
        return pa.StructArray.from_arrays(columns, ["windows", "eligible", "best"])

    return reads.select("rec_no", F.arrow_udf(by_pieces(stats), "struct<windows: int, eligible: int, best: double>")("quality").alias("w")).select("rec_no", "w.*")


_LETTERS = np.frombuffer(BASES.encode(), np.uint8)
_CODE = np.full(256, 4, np.uint8)
_CODE[_LETTERS] = np.arange(4)


def _kmers(data: np.ndarray, begins: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """The k symbols from each of ``begins``, four bases to a byte, or as they are where one is no base; and a number
    that is equal for equal ones."""
    codes = _CODE[data]
    windows = begins[:, None] + np.arange(k)
    four = np.zeros((len(begins), -(-k // 4) * 4), np.uint8)
    four[:, :k] = codes[windows]
    odd = (four == 4).any(1)
    packed = four[:, 0::4] << 6 | four[:, 1::4] << 4 | four[:, 2::4] << 2 | four[:, 3::4]
    at = np.concatenate(([0], np.cumsum(np.where(odd, k, packed.shape[1]))))
    if not odd.any():
        out = packed.ravel()
    else:
        out = np.zeros(at[-1], np.uint8)
        out[at[:-1][~odd][:, None] + np.arange(packed.shape[1])] = packed[~odd]
        out[at[:-1][odd][:, None] + np.arange(k)] = data[windows[odd]]
    mark = np.zeros(len(begins), np.uint64)
    for byte in packed.T:
        mark = mark * np.uint64(0x9E3779B97F4A7C15) + byte
    return binaries(out, at), mark


def _letters(k: int):
    """The text of packed k-mers."""

    def text(kmer: pa.Array) -> pa.Array:
        data, at = flat(kmer)
        every = _LETTERS[np.stack([data >> 6, data >> 4 & 3, data >> 2 & 3, data & 3], 1)].reshape(-1)
        rows = [(data[a:b] if b - a == k else every[4 * a : 4 * a + k]).tobytes() for a, b in zip(at[:-1], at[1:])]
        return pa.array(rows, pa.binary()).cast(pa.string())

    return text


def _index(reads: DataFrame, k: int, step: int, cap: int, min_log: float, wanted: DataFrame | None = None) -> DataFrame:
    """``anchors`` with packed k-mers, as they are shuffled; of ``wanted`` k-mers only, if given. A kernel applies the cap
    to each piece of its input, so that one that is everywhere stays small; what is left is sorted after the shuffle."""

    def kmers(rec_no: pa.Array, seq: pa.Array, quality: pa.Array) -> pa.Array:
        (marks, begin), (data, at) = flat(quality), flat(seq)
        row, off = _offsets(-(-np.maximum(np.minimum(np.diff(at) - k, np.diff(begin) - k + 1), 0) // step), step)
        likely = np.round(_sums(marks, k)[begin[row] + off], 9) > min_log
        row, off = row[likely], off[likely]
        others = np.concatenate(([0], np.cumsum(data == ord("N"))))
        known = others[at[row] + off] == others[at[row] + off + k]
        row, off = row[known], off[known]
        made, mark = _kmers(data, at[row] + off, k)
        _, of, n = np.unique(mark, return_inverse=True, return_counts=True)
        hot = np.flatnonzero(n[of] > cap)
        if len(hot):
            numbers, seen, drop = rec_no.to_numpy(zero_copy_only=False)[row[hot]], {}, []
            for j in hot[np.lexsort((off[hot], numbers))].tolist():
                kmer = made[j].as_py()
                seen[kmer] = seen.get(kmer, 0) + 1
                if seen[kmer] > cap:
                    drop.append(j)
            left = np.ones(len(row), bool)
            left[drop] = False
            row, off, made = row[left], off[left], made.filter(pa.array(left))
        each = pa.StructArray.from_arrays([made, pa.array(off.astype(np.int32))], ["kmer", "off"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(seq) + 1)).astype(np.int32)), each)

    each = reads.select("rec_no", F.explode(F.arrow_udf(by_pieces(kmers), "array<struct<kmer: binary, off: int>>")("rec_no", "seq", "quality")).alias("a")).select("a.kmer", "rec_no", "a.off")
    place = F.row_number().over(Window.partitionBy("kmer").orderBy("rec_no", "off"))
    each = each.repartition("kmer")
    if wanted is not None:
        each = each.join(wanted.select("kmer").distinct().hint("shuffle_hash"), "kmer", "left_semi")
    return each.withColumn("place", place).where(F.col("place") <= cap).drop("place")


def anchors(reads: DataFrame, k: int = K, step: int = STEP, cap: int = CAP, min_log: float = MIN_LOG) -> DataFrame:
    """(kmer, rec_no, off): windows at multiples of ``step`` that are eligible by ``window_logs`` and end before the
    read does, at most ``cap`` for each k-mer."""
    return _index(reads, k, step, cap, min_log).withColumn("kmer", F.arrow_udf(by_pieces(_letters(k)), "string")("kmer"))


def _probes(reads: DataFrame, k: int, step: int) -> DataFrame:
    """(rec_no, i, kmer): the packed k-mers at the first ``step`` offsets of each read, those without N."""

    def kmers(seq: pa.Array) -> pa.Array:
        data, at = flat(seq)
        row, off = _offsets(np.clip(np.diff(at) - k + 1, 0, step))
        others = np.concatenate(([0], np.cumsum(data == ord("N"))))
        known = others[at[row] + off] == others[at[row] + off + k]
        row, off = row[known], off[known]
        each = pa.StructArray.from_arrays([_kmers(data, at[row] + off, k)[0], pa.array(off.astype(np.int32))], ["kmer", "i"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(seq) + 1)).astype(np.int32)), each)

    head = F.substring("seq", F.lit(1), F.lit(k + step - 1))
    each = reads.select("rec_no", F.explode(F.arrow_udf(by_pieces(kmers), "array<struct<kmer: binary, i: int>>")(head)).alias("p"))
    return each.select("rec_no", "p.i", "p.kmer")


def common_prefix(a: str, b: str, most: int = MAX_MATCH) -> Column:
    """Length of the common prefix of two columns of at most ``most`` symbols, by halving steps."""
    steps = ", ".join(str(1 << i) for i in reversed(range(most.bit_length())))
    n = f"least(length({a}), length({b}))"
    return F.expr(f"aggregate(array({steps}), 0, (m, s) -> if(m + s <= {n} and substring({a}, m + 1, s) = substring({b}, m + 1, s), m + s, m))")


def candidates(reads: DataFrame, k: int = K, step: int = STEP, cap: int = CAP, min_log: float = MIN_LOG) -> DataFrame:
    """(rec_no, ref_rec_no, ref_off, i, match_len): every prefix of at least k bases that is found in an earlier read."""
    probes = _probes(reads, k, step)
    index = _index(reads, k, step, cap, min_log, probes).select("kmer", F.col("rec_no").alias("ref_rec_no"), "off")
    met = probes.join(index, "kmer").where("ref_rec_no < rec_no and off >= i")
    met = _stored(met.groupBy("rec_no", "ref_rec_no", (F.col("off") - F.col("i")).alias("ref_off")).agg(F.min("i").alias("i")))
    before_n = lambda c: F.substring_index(c, "N", 1)
    # a place is referred to by many reads: its slice is cut from the whole read once
    places = met.select("ref_rec_no", "ref_off").distinct()
    ref = reads.select(F.col("rec_no").alias("ref_rec_no"), "seq").join(places, "ref_rec_no")
    ref = ref.select("ref_rec_no", "ref_off", before_n(F.expr(f"substring(seq, ref_off + 1, {MAX_MATCH})")).alias("b")).where(F.length("b") >= k)
    own = reads.select("rec_no", before_n(F.expr(f"substring(seq, 1, {MAX_MATCH})")).alias("a")).where(F.length("a") >= k)
    met = met.join(own, "rec_no").join(ref, ["ref_rec_no", "ref_off"]).where(F.substring("a", 1, k) == F.substring("b", 1, k))
    return met.select("rec_no", "ref_rec_no", "ref_off", "i", common_prefix("a", "b").alias("match_len"))


def best_overlaps(reads: DataFrame, k: int = K, step: int = STEP, cap: int = CAP, min_log: float = MIN_LOG, mode: str = "any") -> DataFrame:
    """(rec_no, ref_rec_no, ref_off, match_len): for each read the longest prefix found in an earlier read.

    Ties go to the smallest probe offset, then the earliest read. A match ends before any N and at 291 bases.
    With ``mode`` "any" every earlier read may be a source; with "depth1" only reads that have no overlap
    themselves, so that no chain arises.
    """
    found = candidates(reads, k, step, cap, min_log)
    if mode == "depth1":
        found = _stored(found)
        found = found.join(_sources(found), "ref_rec_no", "left_semi")
    best = found.groupBy("rec_no").agg(F.min(F.struct((-F.col("match_len")).alias("m"), "i", "ref_rec_no", "ref_off")).alias("b"))
    return best.select("rec_no", "b.ref_rec_no", "b.ref_off", (-F.col("b.m")).alias("match_len"))


def _sources(found: DataFrame) -> DataFrame:
    """(ref_rec_no): of the reads referred to, those that overlap no such read before them.

    Every round settles the reads that meet a new source, and makes those sources whose candidates are all settled
    otherwise; the earliest open read is always among them. Only pairs of read numbers are moved.
    """
    open_ = _stored(found.select("rec_no", "ref_rec_no").distinct())
    own = lambda df: df.select(F.col("rec_no").alias("ref_rec_no")).distinct()
    new = _stored(open_.select("ref_rec_no").distinct().join(own(open_), "ref_rec_no", "left_anti"))
    every = [new]
    while not open_.isEmpty():
        matched = _stored(open_.join(new, "ref_rec_no", "left_semi").select("rec_no").distinct())
        left = _stored(open_.join(matched, "rec_no", "left_anti"))
        open_ = _stored(left.join(own(matched), "ref_rec_no", "left_anti"))
        new = _stored(own(left).join(own(open_), "ref_rec_no", "left_anti"))
        every.append(new)
    return reduce(DataFrame.union, every)


def strip(reads: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(rec_no, ref_rec_no, ref_off, match_len, tail): reads without the prefix that another read holds."""
    rows = reads.join(overlaps, "rec_no", "left")
    tail = F.when(F.col("match_len").isNotNull(), F.expr("substring(seq, match_len + 1)")).otherwise(F.col("seq"))
    return rows.select("rec_no", "ref_rec_no", "ref_off", "match_len", tail.alias("tail"))


def _stored(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "overlap")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def restore(stripped: DataFrame) -> DataFrame:
    """(rec_no, seq) of all reads, from stripped ones alone.

    A read's source may be stripped too. Every round fills the reads whose source the last round made whole, so
    each read is written once, and there are as many rounds as the longest chain of sources.
    """
    stripped = _stored(stripped)
    made = [stripped.where(F.col("ref_rec_no").isNull()).select("rec_no", F.col("tail").alias("seq"))]
    left = stripped.where(F.col("ref_rec_no").isNotNull())
    while not left.isEmpty():
        source = made[-1].select(F.col("rec_no").alias("ref_rec_no"), F.col("seq").alias("ref"))
        whole = F.concat(F.expr("substring(ref, ref_off + 1, match_len)"), "tail")
        now = _stored(left.join(source, "ref_rec_no").select("rec_no", whole.alias("seq")))
        if now.isEmpty():
            raise ValueError("a read refers to one that is not there")
        made.append(now)
        left = _stored(left.join(now.select("rec_no"), "rec_no", "left_anti"))
    return reduce(DataFrame.union, made)


def lookup(stripped: DataFrame, rec_no: int) -> DataFrame:
    """(rec_no, seq) of one read: its row, and by a second filtered scan the tail of the read it refers to.

    Where that read is itself stripped, its own prefix is looked up first, so the chain is followed to its end.
    """
    chain, at = [], rec_no
    while at is not None:
        row = stripped.where(F.col("rec_no") == at).first()
        if row is None:
            break
        chain.append(row)
        at = row.ref_rec_no
    seq = None
    for row in reversed(chain):
        prefix = seq[row.ref_off : row.ref_off + row.match_len] if row.ref_rec_no is not None else ""
        seq = prefix + row.tail
    return stripped.sparkSession.createDataFrame([(rec_no, seq)] if chain else [], "rec_no bigint, seq string")
