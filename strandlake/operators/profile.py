"""Aggregates that describe superblocks of reads. Each needs one shuffle, of partial sums only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators import runs
from strandlake.functions.batches import PIECE, flat, whole_groups
from strandlake.functions.scalars import BLOCK, SUPERBLOCK, bit_length, block_id, kept_length, last_kept, run_estimate, symbols


def superblocks(reads: DataFrame, size: int = SUPERBLOCK) -> DataFrame:
    return reads.withColumn("sb_id", block_id(F.col("rec_no"), size))


def base_composition(reads: DataFrame, size: int = SUPERBLOCK) -> DataFrame:
    """(sb_id, base, n). The five usual letters are counted by lengths, without a row per base."""
    n = lambda c: F.length("seq") - F.length(F.replace("seq", F.lit(c), F.lit("")))
    usual = superblocks(reads, size).groupBy("sb_id").agg(*[F.sum(n(c)).alias(c) for c in "ACGTN"])
    usual = usual.select("sb_id", F.explode(F.array(*[F.struct(F.lit(c).alias("base"), F.col(c).cast("bigint").alias("n")) for c in "ACGTN"])).alias("b")).select("sb_id", "b.*").where("n > 0")
    rest = superblocks(reads, size).select("sb_id", F.regexp_replace("seq", "[ACGTN]", "").alias("odd")).where("odd <> ''")
    rest = rest.select("sb_id", F.explode(symbols(F.col("odd"))).alias("base")).groupBy("sb_id", "base").agg(F.count("*").alias("n"))
    return usual.union(rest)


def alphabet_codes(reads: DataFrame, column: str, size: int = SUPERBLOCK) -> DataFrame:
    """(sb_id, symbol, code): the symbols of a column of each superblock, numbered in byte order, N left out of bases."""
    text = F.replace("seq", F.lit("N"), F.lit("")) if column == "seq" else F.col(column)
    distinct = superblocks(reads, size).select("sb_id", F.explode(F.array_distinct(symbols(text))).alias("symbol")).where("symbol <> ''").distinct()
    code = F.dense_rank().over(Window.partitionBy("sb_id").orderBy("symbol")) - 1
    return distinct.withColumn("code", code.cast("int"))


def read_lengths(reads: DataFrame, size: int = SUPERBLOCK) -> DataFrame:
    """Per superblock: records, blocks, least and greatest length, and the greatest length so far."""
    own = superblocks(reads, size).groupBy("sb_id").agg(
        F.count("*").alias("records"),
        F.ceil(F.count("*") / BLOCK).cast("bigint").alias("blocks"),
        F.min(F.length("quality")).alias("min_len"),
        F.max(F.length("quality")).alias("max_len"),
    )
    return running_max(own)


def running_max(per_superblock: DataFrame, group: int = 4096) -> DataFrame:
    """Greatest ``max_len`` so far, in two levels: inside groups of superblocks, then over one row per group."""
    rows = per_superblock.withColumn("g", F.floor(F.col("sb_id") / group))
    heads = rows.groupBy("g").agg(F.max("max_len").alias("m"))
    upto = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("g", F.max("m").over(upto).alias("before"))
    inside = F.max("max_len").over(Window.partitionBy("g").orderBy("sb_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("inside", inside).join(heads, "g").withColumn("running_max_len", F.greatest("inside", "before")).drop("g", "inside", "before")


def _histogram(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, byte and count of all texts of a superblock, position 0 for all positions together."""
    data, at = flat(column)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    code = np.zeros(256, np.int64)
    code[used] = np.arange(len(used))
    n = np.zeros(int(np.diff(at).max(initial=0)) * len(used), np.int64)
    begin = 0
    while begin < len(at) - 1:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + PIECE, "right")) - 1)
        piece = data[at[begin] : at[end]]
        place = np.arange(at[begin], at[end]) - np.repeat(at[begin:end], np.diff(at[begin : end + 1]))
        part = np.bincount(place * len(used) + code[piece])
        n[: len(part)] += part
        begin = end
    found, total = np.flatnonzero(n), n.reshape(-1, max(len(used), 1)).sum(0)
    return np.append(found // max(len(used), 1) + 1, np.zeros(len(used), np.int64)), np.append(used[found % max(len(used), 1)], used), np.append(n[found], total)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sb_id, pos, symbol, n) of rows sorted by superblock."""
    names = pa.array([chr(i) for i in range(256)])
    for b in whole_groups(batches, "sb_id"):
        sbs, first = np.unique(b.column("sb_id").to_numpy(), return_index=True)
        parts = [_histogram(b.column("quality").slice(i, j - i)) for i, j in zip(first, [*first[1:], b.num_rows])]
        pos, byte, n = (np.concatenate(c) for c in zip(*parts))
        symbol = pa.DictionaryArray.from_arrays(pa.array(byte.astype(np.int16)), names).cast(pa.string())
        columns = [pa.array(np.repeat(sbs, [len(c[0]) for c in parts])), pa.array(pos.astype(np.int32)), symbol, pa.array(n)]
        yield pa.RecordBatch.from_arrays(columns, ["sb_id", "pos", "symbol", "n"])


def quality_histogram(reads: DataFrame, size: int = SUPERBLOCK, truncate: bool = False) -> DataFrame:
    """(sb_id, pos, symbol, n) with the total of all positions at pos 0; ``truncate`` leaves trailing # out.

    Symbols are bytes. Texts of a superblock meet in a kernel, which counts them piece by piece: what is shuffled is the
    text, and no table of counts is kept for more than a superblock."""
    text = F.substring("quality", F.lit(1), kept_length(F.col("quality"))) if truncate else F.col("quality")
    rows = superblocks(reads, size).select("sb_id", text.alias("quality")).repartition("sb_id").sortWithinPartitions("sb_id")
    return rows.mapInArrow(_counts, "sb_id bigint, pos int, symbol string, n bigint")


def quality_sums(reads: DataFrame, size: int = SUPERBLOCK, block: int = BLOCK) -> DataFrame:
    """Raw, trimmed and run lengths of the first record of every block, summed by superblock."""
    sample = superblocks(reads, size).where(F.col("rec_no") % block == 0)
    total = lambda c: F.sum(c).cast("bigint")
    return sample.groupBy("sb_id").agg(
        F.count("*").alias("sampled"),
        total(F.length("quality")).alias("raw"),
        total(last_kept(F.col("quality"))).alias("trunc"),
        total(run_estimate(F.col("quality"))).alias("runs"),
    )


def chosen_method() -> Column:
    """Run lengths if they pay, else plain codes unless trimming saves three symbols a block."""
    return F.when(F.col("trunc") > 1.25 * F.col("runs"), "rle").when(F.col("raw") - F.col("trunc") < 3 * F.col("sampled"), "plain").otherwise("truncate")


def quality_method(reads: DataFrame, size: int = SUPERBLOCK) -> DataFrame:
    return quality_sums(reads, size).withColumn("method", chosen_method())


def color_space(reads: DataFrame, size: int = SUPERBLOCK) -> DataFrame:
    """Per superblock: whether reads are in colors, and whether the start symbols are constant."""
    return superblocks(reads, size).groupBy("sb_id").agg(
        F.bool_or(F.substring("seq", 2, 1).rlike("[0-3]")).alias("color"),
        ((F.min(F.substring("seq", 1, 1)) == F.max(F.substring("seq", 1, 1))) & (F.min(F.substring("quality", 1, 1)) == F.max(F.substring("quality", 1, 1)))).alias("constant_start"),
    )


def superblock_header(reads: DataFrame, size: int = SUPERBLOCK) -> DataFrame:
    """One row of facts per superblock. ``base_mode`` is how many bits a base takes; ``in_colors`` says that all reads are
    colors after one start symbol, so that they can be turned into bases and back; ``max_run`` is the longest run
    within a block, up to the cap, where runs are what is coded."""
    same = lambda c: F.min(F.substring(c, 1, 1)) == F.max(F.substring(c, 1, 1))
    rows = superblocks(reads, size).withColumn("first", F.col("rec_no") % BLOCK == 0)
    q, total = F.col("quality"), lambda c: F.sum(F.when(F.col("first"), c).otherwise(0)).cast("bigint")
    facts = rows.groupBy("sb_id").agg(
        F.count("*").alias("records"),
        F.bool_and(F.length("plus") == 1).alias("plus_only"),
        (F.min(F.length(q)) != F.max(F.length(q))).alias("variable_length"),
        F.max(F.length(q)).alias("max_len"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(symbols(F.replace("seq", F.lit("N"), F.lit("")))))))).alias("n_bases"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(symbols(q)))))).alias("n_qualities"),
        F.bool_or(F.substring("seq", 2, 1).rlike("[0-3]")).alias("color"),
        same("seq").alias("constant_start_base"),
        same("quality").alias("constant_start_quality"),
        F.min(F.substring("seq", 1, 1)).alias("start_base"),
        F.min(F.substring("quality", 1, 1)).alias("start_quality"),
        F.bool_and(F.col("seq").rlike("^[ACGT][0-3.N]*$")).alias("only_colors"),
        total(F.lit(1)).alias("sampled"),
        total(F.length(q)).alias("raw"),
        total(last_kept(q)).alias("trunc"),
        total(run_estimate(q)).alias("runs"),
    )
    constant = F.col("constant_start_base") & F.col("constant_start_quality")
    facts = facts.withColumns({"overlaps": F.col("max_len") > 36, "method": chosen_method(), "in_colors": F.col("color") & F.col("only_colors") & constant, "base_mode": F.greatest(bit_length(F.col("n_bases") - 1), F.lit(2))})
    facts = facts.join(runs.longest_runs(reads, size // BLOCK), "sb_id", "left").withColumn("max_run", F.when(F.col("method") == "rle", F.col("longest")))
    return running_max(facts).drop("sampled", "raw", "trunc", "runs", "longest", "only_colors")


def record_numbers(reads: DataFrame, size: int = SUPERBLOCK, block: int = BLOCK) -> DataFrame:
    """(rec_no, sb_id, block_id, block_in_sb, slot): where a record lies."""
    n = F.col("rec_no")
    return reads.select("rec_no", block_id(n, size).alias("sb_id"), block_id(n, block).alias("block_id"), F.floor(n % size / block).cast("int").alias("block_in_sb"), (n % block).cast("int").alias("slot"))


def truncated(reads: DataFrame) -> DataFrame:
    """Qualities without trailing #, and how many were dropped; one symbol stays where all are #."""
    kept = kept_length(F.col("quality"))
    return reads.withColumns({"dropped": F.greatest(F.length("quality") - kept, F.lit(0)), "quality": F.substring("quality", F.lit(1), kept)})


def refilled(cut: DataFrame) -> DataFrame:
    """Inverse of ``truncated``."""
    return cut.withColumn("quality", F.concat("quality", F.repeat(F.lit("#"), F.col("dropped")))).drop("dropped")


def histogram_bits(histogram: DataFrame) -> DataFrame:
    """(sb_id, pos, bits): each histogram at the width of its largest count, after a byte for that width and the
    number of symbols in as many bits as their count takes."""
    stats = histogram.groupBy("sb_id", "pos").agg(F.count("*").alias("k"), F.max("n").alias("m"))
    return stats.select("sb_id", "pos", (8 + bit_length(F.col("k")) + F.col("k") * bit_length(F.col("m"))).cast("bigint").alias("bits"))
