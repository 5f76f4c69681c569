"""Reads that arrive in order, a micro-batch at a time: each batch adds partial facts of its superblocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.functions.scalars import SUPERBLOCK
from strandlake.operators.profile import superblocks


def facts(reads: DataFrame, size: int = SUPERBLOCK) -> DataFrame:
    """Facts that merge: records, least and greatest length, and base counts, by superblock."""
    n = lambda c: F.sum(F.length("seq") - F.length(F.replace("seq", F.lit(c), F.lit("")))).cast("bigint").alias(f"n_{c.lower()}")
    return superblocks(reads, size).groupBy("sb_id").agg(F.count("*").alias("records"), F.min(F.length("seq")).alias("min_len"), F.max(F.length("seq")).alias("max_len"), *[n(c) for c in "ACGTN"])


def merge(parts: DataFrame) -> DataFrame:
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("records", "n_a", "n_c", "n_g", "n_t", "n_n")]
    return parts.groupBy("sb_id").agg(F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len"), *sums)


def ingest(reads: DataFrame, path: str, checkpoint: str, size: int = SUPERBLOCK) -> StreamingQuery:
    """Append each micro-batch's facts under ``path``; a batch that is run again replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        facts(batch, size).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
