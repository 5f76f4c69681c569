"""Exact substring dedup by blockwise suffix sorting with a difference cover.

Every byte covered by a ``LENGTH``-byte string that starts more than once in the corpus is removed.

1. Buckets. Sorting every suffix of the corpus would move many times the corpus. A string of LENGTH bytes is
   filed under its anchor: the leftmost least hash of its ``GRAM``-byte substrings, a choice that depends on
   the string alone. Equal strings so meet in the same bucket, at the same distance from the anchor. The
   starts that share one anchor form a span, and only anchors and span hashes are shuffled: about one row for
   each (LENGTH - GRAM) / 2 bytes. A bucket with one span repeats nothing; equal spans repeat wholly.
2. Blocks. Only spans that differ from others in their bucket send their bytes. One block of buckets at a time
   is suffix-sorted to LENGTH bytes: the suffixes at the positions of a difference cover modulo ``PERIOD`` are
   ranked first; the other suffixes are then sorted by PERIOD bytes, and longer ties by the rank of the cover
   sample next to both and by the bytes that it leaves. Ties after that are equal strings. Spans are laid out
   with their anchors at multiples of PERIOD, so that equal strings share the distance to their sample.
3. A bucket of over ``HOT_SPANS`` different spans is split before it is sorted, by bytes that its strings hold
   around the anchor: the starts whose distance to the anchor lies in one half share LENGTH - 69 bytes and more, by
   which they are filed anew, and so on in quarters until no bucket is larger. A string has one distance to its
   anchor, so equal strings stay together.

Equality of whole spans (equal starts, distances and bytes) is that of two independent 64-bit hashes, of the anchor
and of the span; all that differs within a bucket is told apart by the sort.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import cut, map_batches, remove, shared_dir, stored

LENGTH, GRAM, PERIOD = 200, 64, 64
HOT_SPANS, BLOCK_BYTES, PIECE = 2000, 2 << 20, 1 << 16
#: A key of more rows than this, and than one in so many of all rows, is salted in joins.
HOT_ROWS, HOT_KEYS = 2000, 20_000
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POS = 17  # bits that hold a place within a piece


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Hashes:
    """Rolling hashes of one piece of bytes: of any of its substrings, by prefix sums."""

    def __init__(self, data: np.ndarray, base: int):
        up, self.down = _powers(base, PIECE + 2 * LENGTH + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(key) - width + 1
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def spans(data: bytes) -> tuple[np.ndarray, ...]:
    """(anchor hash, span hash, start, number of starts, distance to the anchor) of each span of a text."""
    raw = np.frombuffer(data, np.uint8)
    out = []
    for at in range(0, len(raw) - LENGTH + 1, PIECE):
        x = raw[at : at + PIECE + LENGTH - 1]
        first = Hashes(x, BASES[0])
        grams = first.grams(GRAM)
        place = np.arange(len(grams), dtype=np.uint64)
        least = _least((grams >> np.uint64(_POS) << np.uint64(_POS)) | place, LENGTH - GRAM + 1)
        anchor = (least & np.uint64((1 << _POS) - 1)).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        anchor = anchor[start]
        n = np.diff(np.append(start, len(least)))
        lead = anchor - start
        whole = Hashes(x, BASES[1]).of(start, start + n - 1 + LENGTH)
        whole = _mixed(whole ^ (n.astype(np.uint64) << np.uint64(32)) ^ lead.astype(np.uint64))
        out.append((grams[anchor].view(np.int64), whole.view(np.int64), start + at, n, lead))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    return tuple(np.concatenate(c) for c in zip(*out))


@lru_cache(4)
def difference_cover(period: int) -> tuple[int, ...]:
    """Residues whose differences give every number modulo ``period``, chosen greedily."""
    chosen, missing = [0], set(range(1, period))
    while missing:
        gain = lambda c: len(missing & {(c - d) % period for d in chosen} | missing & {(d - c) % period for d in chosen})
        best = max(range(period), key=lambda c: (gain(c), -c))
        missing -= {(best - d) % period for d in chosen} | {(d - best) % period for d in chosen}
        chosen.append(best)
    return tuple(sorted(chosen))


class _Order:
    """Ranks of suffixes, refined key by key; only ties are looked at again."""

    def __init__(self, n: int):
        self.rank = np.zeros(n, np.int64)
        self.tied = np.arange(n) if n > 1 else np.zeros(0, np.int64)

    def refine(self, key) -> None:
        """``key`` gives the next key of the suffixes it is asked for."""
        t = self.tied
        if not len(t):
            return
        k = key(t)
        order = np.lexsort((k, self.rank[t]))
        t, k = t[order], k[order]
        old = self.rank[t]
        new_old = np.concatenate(([True], old[1:] != old[:-1]))
        new = new_old | np.concatenate(([True], k[1:] != k[:-1]))
        group = np.flatnonzero(new)
        place = np.arange(len(t)) - np.repeat(np.flatnonzero(new_old), np.diff(np.append(np.flatnonzero(new_old), len(t))))
        size = np.diff(np.append(group, len(t)))
        self.rank[t] = old + np.repeat(place[group], size)
        self.tied = t[np.repeat(size > 1, size)]


def suffix_ranks(text: np.ndarray, starts: np.ndarray, length: int = LENGTH, period: int = PERIOD) -> _Order:
    """Order the ``length``-byte strings at ``starts``; equal ones keep equal ranks and stay in ``tied``.

    Equal strings must start at equal residues modulo ``period``, and length be twice the period or more.
    """
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    # the eight bytes from each place on, read where they lie: numbers of their own for all places take eight times the text
    at_each = np.ndarray(len(text), ">u8", padded, strides=(1,))
    words = lambda i: at_each[i].astype(np.uint64)
    cover = np.zeros(period, bool)
    cover[list(difference_cover(period))] = True
    # distance from each residue to the next sample
    ahead = np.array([next(d for d in range(period) if cover[(r + d) % period]) for r in range(period)])
    sample = np.unique(starts + ahead[starts % period])
    reach = length - period
    samples = _Order(len(sample))
    for at in [*range(0, reach - 7, 8), reach - 8]:
        samples.refine(lambda t, at=at: words(sample[t] + at))
    order = _Order(len(starts))
    for at in range(0, period, 8):
        order.refine(lambda t, at=at: words(starts[t] + at))
    order.refine(lambda t: starts[t] % period)  # ranks say nothing of starts that lie at other distances to their samples
    order.refine(lambda t: samples.rank[np.searchsorted(sample, starts[t] + ahead[starts[t] % period])])
    for at in range(length - period, length - 7, 8):
        order.refine(lambda t, at=at: words(starts[t] + at))
    return order


def repeated_starts(pieces: list[bytes], counts: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """Which of the starts of all spans, one after another, begin a string that another start has too."""
    sizes = np.array([len(p) for p in pieces])
    # room before each span brings its anchor to a multiple of PERIOD
    begin = np.zeros(len(pieces), np.int64)
    at = 0
    for i, (size, lead) in enumerate(zip(sizes.tolist(), leads.tolist())):
        begin[i] = at + (-(at + lead)) % PERIOD
        at = begin[i] + size
    text = np.zeros(at + PERIOD, np.uint8)
    for b, p in zip(begin.tolist(), pieces):
        text[b : b + len(p)] = np.frombuffer(p, np.uint8)
    starts = np.repeat(begin, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    again = np.zeros(len(starts), bool)
    again[suffix_ranks(text, starts).tied] = True
    return again


_OWN = "t1 long, t2 long, doc_id long"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [spans(t)[:2] for t in b.column("bytes").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 2, ["anchor", "span"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [spans(t) for t in b.column("bytes").to_pylist()]
        if not found:
            continue
        row = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
        own = [b.column(c).take(row) for c in ("t1", "t2", "doc_id")]
        yield pa.RecordBatch.from_arrays([*own, *(pa.array(np.concatenate(c)) for c in zip(*found))], ["t1", "t2", "doc_id", "anchor", "span", "start", "n", "lead"])


_PIECES = "anchor long, span long, t1 long, t2 long, start long, n long, lead long, known boolean, hot boolean, piece binary"
_PIECE_NAMES = ["anchor", "span", "t1", "t2", "start", "n", "lead", "known", "hot", "piece"]
_PIECE_TYPES = [pa.int64()] * 7 + [pa.bool_(), pa.bool_(), pa.binary()]


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE_TYPES)], _PIECE_NAMES)


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted spans, each from the one document that stands for it."""
    for b in batches:
        out = []
        for data, t1, t2, doc_id, wanted in zip(*(b.column(c).to_pylist() for c in ("bytes", "t1", "t2", "doc_id", "wanted"))):
            out += [(w["anchor"], w["span"], t1, t2, w["start"], w["n"], w["lead"], w["known"], w["hot"], data[w["start"] : w["start"] + w["n"] - 1 + LENGTH]) for w in wanted if w["doc_id"] == doc_id]
        if out:
            yield _piece_rows(out)


def _signed(*parts: bytes | int) -> int:
    """XXH64 of bytes and numbers, as a signed long."""
    h = xxhash.xxh64(seed=len(parts))
    for p in parts:
        h.update(p if isinstance(p, bytes) else struct.pack("<q", p))
    return struct.unpack("<q", struct.pack("<Q", h.intdigest()))[0]


def split_span(anchor: int, start: int, n: int, lead: int, piece: bytes, width: int) -> list[tuple[int, int, int, int, int, bytes]]:
    """(anchor, span, start, n, lead, piece) of a span's parts: by distance to the anchor in ranges of ``width``,
    each filed under the bytes that all strings of its range hold."""
    out = []
    for low in range((lead - n + 1) // width * width, lead + 1, width):
        high = min(low + width - 1, LENGTH - GRAM)
        far, near = min(high, lead), max(low, lead - n + 1)
        i, m = lead - far, far - near + 1
        part = piece[i : i + m - 1 + LENGTH]
        shared = piece[lead - low : lead + LENGTH - high]
        out.append((_signed(anchor, low, shared), _signed(part, m, far), start + i, m, far, part))
    return out


def _split(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for anchor, _, t1, t2, start, n, lead, known, hot, piece in zip(*(b.column(c).to_pylist() for c in _PIECE_NAMES)):
                out += [(a, s, t1, t2, begin, m, far, known, hot, part) for a, s, begin, m, far, part in split_span(anchor, start, n, lead, piece, width)]
            if out:
                yield _piece_rows(out)

    return run


def _sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; whole buckets are gathered into blocks, each suffix-sorted by itself."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        _, t1, t2, start, n, lead, known, pieces = zip(*rows)
        counts = np.array(n)
        again = repeated_starts(list(pieces), counts, np.array(lead))
        again &= ~np.repeat(np.array(known), counts)  # what stands for known repeats is counted already
        owner = np.repeat(np.arange(len(rows)), counts)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        head = again & ~np.concatenate(([False], again[:-1] & (owner[1:] == owner[:-1])))
        tail = again & ~np.concatenate((again[1:] & (owner[1:] == owner[:-1]), [False]))
        i, j = np.flatnonzero(head), np.flatnonzero(tail)
        own = owner[i]
        columns = [np.array(t1, np.int64)[own], np.array(t2, np.int64)[own], np.array(start, np.int64)[own] + offset[i], j - i + 1]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["t1", "t2", "start", "n"])

    held, size = [], 0
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("anchor", "t1", "t2", "start", "n", "lead", "known", "piece"))):
            if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                yield done(held)
                held, size = [], 0
            held.append(row)
            size += len(row[-1])
    if held:
        yield done(held)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"bytes": text.cast("binary"), "t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(7), text)})


def _matched(rows: DataFrame, keyed: DataFrame, keys: list[str], salt: Column) -> DataFrame:
    """Join rows with ``keyed``, where ``c`` is the number of rows of each key. Keys with many rows, ``HOT_KEYS`` at
    most, are told to all tasks, and their rows are dealt over as many buckets as they fill."""
    total = keyed.agg(F.sum("c")).first()[0] or 0
    most = max(HOT_ROWS, total // HOT_KEYS)
    ways = F.when(F.col("c") > most, F.ceil(F.col("c") / most).cast("int")).otherwise(1)
    hot = F.broadcast(keyed.where(F.col("c") > most).select(*keys, ways.alias("ways")))
    dealt = rows.join(hot, keys, "left").withColumn("salt", F.when(F.col("ways").isNull(), 0).otherwise(F.pmod(salt, F.col("ways"))).cast("int")).drop("ways")
    spread = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), ways - 1)))
    return dealt.join(spread.drop("c"), [*keys, "salt"]).drop("salt")


def repeats(docs: DataFrame, hot_spans: int = HOT_SPANS) -> DataFrame:
    """(t1, t2, cuts) for each text with repeats: its key, and the runs (start, n) of starts of repeated strings.

    The result is a table in the shared folder; what it was made from is deleted."""
    spark = docs.sparkSession
    work = f"{shared_dir(spark)}/substrings-{uuid.uuid4().hex}"
    keep = lambda df: stored(df, work)
    keyed = _keyed(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "bytes", "t1", "t2")
    met = map_batches(keyed.select("bytes"), _anchors, "anchor long, span long").groupBy("anchor")
    met = met.agg(F.count("*").alias("c"), F.min("span").alias("low"), F.max("span").alias("high")).where("c > 1")
    met = keep(met.select("anchor", "c", (F.col("low") != F.col("high")).alias("differ")))
    schema = f"{_OWN}, anchor long, span long, start long, n long, lead long"
    place = lambda: F.xxhash64("t1", "doc_id", "start")
    found = keep(_matched(map_batches(keyed, _occurrences, schema), met, ["anchor"], place()))
    whole = found.where(~F.col("differ")).select("t1", "t2", "start", "n")

    differ = found.where("differ")
    kinds = keep(differ.groupBy("anchor", "span").agg(F.count("*").alias("c"), F.min(F.struct("t1", "t2", "doc_id", "start", "n", "lead")).alias("one")))
    again = _matched(differ, kinds.where("c > 1").select("anchor", "span", "c"), ["anchor", "span"], place()).select("t1", "t2", "start", "n")
    buckets = cut(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("c").alias("least")).where("least = 1"))
    wanted = kinds.join(buckets.select("anchor", (F.col("kinds") > hot_spans).alias("hot")), "anchor")
    wanted = wanted.select("anchor", "span", "one.*", (F.col("c") > 1).alias("known"), "hot")
    lists = keep(wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("anchor", "span", "doc_id", "start", "n", "lead", "known", "hot")).alias("wanted")))
    pieces = keep(map_batches(keyed.join(lists, ["t1", "t2"]), _cuts, _PIECES))

    parts, ready, width = [whole, again], [pieces.where("not hot")], LENGTH - GRAM + 1
    hot = pieces.where("hot")
    while not hot.isEmpty():
        width = -(-width // 2)
        each = keep(map_batches(hot, _split(width), _PIECES))
        sizes = keep(each.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").withColumn("large", F.col("c") > hot_spans))
        each = keep(_matched(each.drop("hot"), sizes, ["anchor"], F.xxhash64("t1", "start")))
        ready.append(each.where("not large").withColumn("hot", F.lit(False)).select(*_PIECE_NAMES))
        large = each.where("large")
        one = F.min(F.struct("t1", "t2", "start", "n", "lead", "known", "piece")).alias("one")
        kinds = keep(large.groupBy("anchor", "span").agg(F.count("*").alias("c"), one))
        parts.append(_matched(large, kinds.where("c > 1").select("anchor", "span", "c"), ["anchor", "span"], F.xxhash64("t1", "start")).select("t1", "t2", "start", "n"))
        buckets = cut(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("c").alias("least")).where("least = 1"))
        left = kinds.join(buckets.select("anchor", (F.col("kinds") > hot_spans).alias("hot")), "anchor")
        left = keep(left.select("anchor", "span", "one.t1", "one.t2", "one.start", "one.n", "one.lead", (F.col("one.known") | (F.col("c") > 1)).alias("known"), "hot", "one.piece"))
        ready.append(left.where("not hot"))
        hot = left.where("hot")
    blocks = reduce(DataFrame.union, ready).repartition("anchor").sortWithinPartitions("anchor")
    parts.append(map_batches(blocks, _sorted_blocks, "t1 long, t2 long, start long, n long", 4096))
    cuts = reduce(DataFrame.union, parts).distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "n")).alias("cuts"))
    cuts = stored(cuts)
    remove(spark, work)
    return cuts


def kept(data: bytes, cuts: list[dict] | None) -> tuple[bytes, int, int]:
    """(what stays, bytes removed, maximal runs removed)."""
    if not cuts:
        return data, 0, 0
    edge = np.zeros(len(data) + 1, np.int32)
    start = np.array([c["start"] for c in cuts])
    np.add.at(edge, start, 1)
    np.add.at(edge, start + np.array([c["n"] for c in cuts]) - 1 + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))).sum())


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [(data, *kept(data, cuts)) for data, cuts in zip(b.column("bytes").to_pylist(), b.column("cuts").to_pylist())]
        columns = [pa.array([len(m[0]) for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()), pa.array([m[3] for m in made], pa.int64()), pa.array([hashlib.sha256(m[1]).hexdigest() for m in made], pa.string())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def report(docs: DataFrame, hot_spans: int = HOT_SPANS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts count as empty; texts under LENGTH bytes keep everything; rows repeated in the table repeat each
    other's strings; null doc_ids stay null; an empty table gives an empty one; other columns take no part.
    """
    keyed = _keyed(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "bytes", "t1", "t2")
    rows = keyed.join(repeats(docs, hot_spans), ["t1", "t2"], "left").select("doc_id", "bytes", "cuts")
    return map_batches(rows, _report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [kept(d, c)[0].decode(errors="ignore") for d, c in zip(b.column("bytes").to_pylist(), b.column("cuts").to_pylist())]
        own = [c for c in b.schema.names if c not in ("bytes", "cuts")]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(texts, pa.string())], [*own, "new_text"])


def deduplicated(docs: DataFrame, hot_spans: int = HOT_SPANS) -> DataFrame:
    """The rows of ``docs`` with repeated strings cut out of ``text``, and n_chars, if there, counted anew.

    Characters of which a cut leaves only a part go wholly. A null text stays null. All other columns come back as
    they are, whatever their names; repeated rows lose what they share; an empty table gives an empty one.
    """
    names = docs.columns
    row = F.struct(*[docs[c] for c in names if c != "text"])
    keyed = _keyed(docs.select(row.alias("row"), F.col("text"))).select("row", F.col("text").isNull().alias("none"), "bytes", "t1", "t2")
    rows = keyed.join(repeats(docs, hot_spans), ["t1", "t2"], "left").select("row", "none", "bytes", "cuts")
    kind = rows.schema["row"].dataType.simpleString()
    out = map_batches(rows, _rewrite, f"row {kind}, none boolean, new_text string")
    text = F.when(~F.col("none"), F.col("new_text"))
    made = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None}
    return out.select(*[made[c].alias(c) if c in made else F.col("row")[c].alias(c) for c in names])


#: The rows of ``report``, for DuckDB: bytes are pairs of hex digits, strings are compared as they are.
SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS row_no, doc_id, hex(encode(coalesce(text, ''))) AS bytes FROM documents),
starts AS (
  SELECT row_no, unnest(range(0, length(bytes) // 2 - 199)) AS start, bytes FROM texts WHERE length(bytes) >= 400),
grams AS (
  SELECT row_no, start, substring(bytes, 2 * start + 1, 400) AS gram FROM starts),
again AS (
  SELECT g.row_no, g.start FROM grams g SEMI JOIN (SELECT gram FROM grams GROUP BY gram HAVING count(*) > 1) USING (gram)),
stepped AS (
  SELECT row_no, start, lag(start) OVER (PARTITION BY row_no ORDER BY start) AS before FROM again),
numbered AS (
  SELECT row_no, start, sum(CASE WHEN before IS NULL OR start > before + 200 THEN 1 ELSE 0 END)
    OVER (PARTITION BY row_no ORDER BY start) AS run FROM stepped),
runs AS (
  SELECT row_no, run, min(start) AS low, max(start) + 200 AS high FROM numbered GROUP BY ALL),
gaps AS (
  SELECT row_no, low, high, lag(high, 1, 0) OVER (PARTITION BY row_no ORDER BY low) AS kept_from FROM runs),
cuts AS (
  SELECT g.row_no, sum(high - low) AS n_removed, count(*) AS n_spans, max(high) AS last_high,
    string_agg(substring(t.bytes, 2 * kept_from + 1, 2 * (low - kept_from)), '' ORDER BY low) AS kept
  FROM gaps g JOIN texts t USING (row_no) GROUP BY g.row_no)
SELECT doc_id, CAST(length(bytes) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN c.row_no IS NULL THEN bytes ELSE kept || substring(bytes, 2 * last_high + 1) END)) AS kept_sha256
FROM texts t LEFT JOIN cuts c USING (row_no)
"""
