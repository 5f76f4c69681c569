"""Record-to-record deltas of numeric columns and their inverse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.scalars import SUPERBLOCK, block_id


def deltas(values: DataFrame, size: int = SUPERBLOCK) -> DataFrame:
    """(sb_id, rec_no, delta) of (rec_no, value); a superblock's first record keeps its value as delta."""
    rows = values.withColumn("sb_id", block_id(F.col("rec_no"), size))
    before = F.lag("value").over(Window.partitionBy("sb_id").orderBy("rec_no"))
    return rows.select("sb_id", "rec_no", (F.col("value") - F.coalesce(before, F.lit(0))).cast("bigint").alias("delta"))


def restore(coded: DataFrame) -> DataFrame:
    """(rec_no, value) from ``deltas``."""
    upto = Window.partitionBy("sb_id").orderBy("rec_no").rowsBetween(Window.unboundedPreceding, 0)
    return coded.select("rec_no", F.sum("delta").over(upto).cast("bigint").alias("value"))
