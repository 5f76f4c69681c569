"""Run-length coding of qualities. A block's qualities form one string, whose runs cross record borders.

Blocks are small (32 reads), so each is put together where its reads meet and cut at once. Where runs are counted or
restored they stay one row per block; no row per run is shuffled, sorted or windowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.batches import binaries, counted, flat, symbols, texts, whole_groups
from strandlake.functions.scalars import BLOCK, RUN_CAP, block_id, runs


def _blocks(reads: DataFrame, block: int) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rec_no", "quality")))
    return reads.groupBy(block_id(F.col("rec_no"), block).alias("block_id")).agg(ordered.alias("r")).withColumn("line", F.expr("array_join(transform(r, x -> x.quality), '')"))


def quality_runs(reads: DataFrame, block: int = BLOCK, cap: int = RUN_CAP) -> DataFrame:
    """(block_id, run_no, symbol, run_len) with runs of at most ``cap`` symbols."""
    each = _blocks(reads, block).select("block_id", F.posexplode(runs(F.col("line"), cap)).alias("run_no", "run"))
    return each.select("block_id", "run_no", F.substring("run", 1, 1).alias("symbol"), F.length("run").alias("run_len"))


def quality_restore(coded: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """Inverse: (rec_no, quality) from the runs and from (rec_no, len)."""
    lines = coded.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("run_no", "symbol", "run_len"))).alias("r"))
    lines = lines.select("block_id", F.expr("array_join(transform(r, x -> repeat(x.symbol, x.run_len)), '')").alias("line"))
    own = lengths.withColumn("block_id", block_id(F.col("rec_no"), block))
    before = F.sum("len").over(Window.partitionBy("block_id").orderBy("rec_no").rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("before", F.coalesce(before, F.lit(0)))
    return own.join(lines, "block_id").select("rec_no", F.expr("substring(line, cast(before + 1 as int), len)").alias("quality"))


def _together(reads: DataFrame, block: int) -> DataFrame:
    """(block_id, quality): the reads of a block one after the other."""
    rows = reads.select(block_id(F.col("rec_no"), block).alias("block_id"), "rec_no", "quality")
    return rows.repartition("block_id").sortWithinPartitions("block_id", "rec_no").select("block_id", "quality")


def cut_runs(codes: np.ndarray, begins: np.ndarray, cap: int = RUN_CAP) -> tuple[np.ndarray, np.ndarray]:
    """Where each run begins and how long it is, at most ``cap``; a run ends before each of ``begins``."""
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    new[begins[begins < len(codes)]] = True
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(codes)))
    n = -(-size // cap)
    if n.max(initial=1) > 1:
        piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, size = np.repeat(at, n) + cap * piece, np.minimum(np.repeat(size, n) - cap * piece, cap)
    return at, size


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of some whole blocks at a time: their numbers, where each begins, all symbols, and begin and length of all runs."""
    for b in whole_groups(batches, "block_id"):
        codes, at = symbols(b.column("quality"))
        blocks, first = np.unique(b.column("block_id").to_numpy(), return_index=True)
        yield blocks, at[first], codes, *cut_runs(codes, at[first])


def coded_blocks(reads: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block_id, symbols, lens): the runs of ``quality_runs``, a row per block, with a byte for each length."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks, begins, codes, at, size in _each(batches):
            ends = np.append(np.searchsorted(at, begins), len(at))
            yield pa.RecordBatch.from_arrays([pa.array(blocks), texts(codes[at], ends), binaries(size.astype(np.uint8), ends)], ["block_id", "symbols", "lens"])

    return _together(reads, block).mapInArrow(code, "block_id bigint, symbols string, lens binary")


def restored(coded: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rec_no, quality) from ``coded_blocks`` and from (rec_no, len)."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, "block_id"):
            (codes, _), (size, _) = symbols(b.column("symbols")), flat(b.column("lens"))
            own = b.column("own").flatten()
            n = own.field("len")
            made = texts(np.repeat(codes, size), np.concatenate(([0], np.cumsum(n.fill_null(0).to_numpy()))))
            yield pa.RecordBatch.from_arrays([own.field("rec_no"), pc.if_else(n.is_valid(), made, pa.scalar(None, pa.string()))], ["rec_no", "quality"])

    own = lengths.groupBy(block_id(F.col("rec_no"), block).alias("block_id")).agg(F.array_sort(F.collect_list(F.struct("rec_no", "len"))).alias("own"))
    return own.join(coded, "block_id").sortWithinPartitions("block_id").mapInArrow(expand, "rec_no bigint, quality string")


def run_histogram(coded: DataFrame, blocks_per_superblock: int = 512) -> DataFrame:
    """(sb_id, symbol, run_len, n)."""
    sb = block_id(F.col("block_id"), blocks_per_superblock).alias("sb_id")
    return coded.groupBy(sb, "symbol", "run_len").agg(F.count("*").alias("n"))


def run_models(reads: DataFrame, blocks_per_superblock: int = 512, block: int = BLOCK) -> DataFrame:
    """(model, sb_id, context, symbol, n): "run_symbol" has each run's symbol after its predecessor's, where a block starts
    without one (''), "run_length" each run's length, in three digits, by its symbol."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks, begins, codes, at, size in _each(batches):
            sbs, of = np.unique(blocks // blocks_per_superblock, return_inverse=True)
            sb, symbol = np.repeat(of, np.diff(np.append(np.searchsorted(at, begins), len(at)))), codes[at].astype(np.int64)
            before = np.concatenate(([0], symbol[:-1] + 1))[: len(at)]
            before[np.isin(at, begins)] = 0
            many = int(symbol.max(initial=0)) + 1
            key, n = counted((sb * (many + 1) + before) * many + symbol)
            text = lambda codes: [chr(c) for c in codes.tolist()]
            before = key // many % (many + 1)
            pairs = [sbs[key // many // (many + 1)], [chr(c - 1) if c else "" for c in before.tolist()], text(key % many), n]
            key, n = counted((sb * many + symbol) * (RUN_CAP + 1) + size)
            sizes = [sbs[key // (RUN_CAP + 1) // many], text(key // (RUN_CAP + 1) % many), [f"{s:03d}" for s in (key % (RUN_CAP + 1)).tolist()], n]
            for model, columns in (("run_symbol", pairs), ("run_length", sizes)):
                yield pa.RecordBatch.from_arrays([pa.array([model] * len(columns[3]), pa.string()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64())))], ["model", "sb_id", "context", "symbol", "n"])

    each = _together(reads, block).mapInArrow(count, "model string, sb_id bigint, context string, symbol string, n bigint")
    return each.groupBy("model", "sb_id", "context", "symbol").agg(F.sum("n").alias("n"))


def run_bigrams(reads: DataFrame, blocks_per_superblock: int = 512) -> DataFrame:
    """(sb_id, context, symbol, n): each run's symbol after its predecessor's."""
    return run_models(reads, blocks_per_superblock).where("model = 'run_symbol'").drop("model")


def longest_runs(reads: DataFrame, blocks_per_superblock: int = 512, block: int = BLOCK) -> DataFrame:
    """(sb_id, longest): the longest run within a block, up to the cap."""

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks, begins, _, at, size in _each(batches):
            ends = np.append(np.searchsorted(at, begins), len(at))
            some = np.diff(ends) > 0
            most = np.maximum.reduceat(size, ends[:-1][some]) if some.any() else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(blocks[some] // blocks_per_superblock), pa.array(most.astype(np.int32))], ["sb_id", "longest"])

    return _together(reads, block).mapInArrow(longest, "sb_id bigint, longest int").groupBy("sb_id").agg(F.max("longest").alias("longest"))
