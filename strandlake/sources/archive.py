"""Archives of reads: Parquet sorted by rec_no, so that a lookup prunes row groups by their ranges."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.scalars import BLOCK, SUPERBLOCK, block_id


def write(reads: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write reads range-partitioned and sorted by rec_no, with small row groups for lookups."""
    rows = reads.repartitionByRange("rec_no").sortWithinPartitions("rec_no")
    rows.write.mode(mode).option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(path)


def append(reads: DataFrame, path: str) -> None:
    write(reads, path, "append")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All reads in the order of rec_no."""
    return read(spark, path).orderBy("rec_no")


def lookup(spark: SparkSession, path: str, rec_no: int) -> DataFrame:
    """The read with this number; none if it is out of range."""
    return read(spark, path).where(F.col("rec_no") == rec_no)


def block_index(reads: DataFrame, superblock: int = SUPERBLOCK, block: int = BLOCK) -> DataFrame:
    """(sb_id, block_in_sb, rows, bytes, byte_offset): where each block would start in its superblock's text."""
    size = F.sum(F.length("title") + F.length("seq") + F.length("plus") + F.length("quality") + 4).cast("bigint")
    own = reads.groupBy(block_id(F.col("rec_no"), superblock).alias("sb_id"), F.floor(F.col("rec_no") % superblock / block).cast("int").alias("block_in_sb")).agg(F.count("*").alias("rows"), size.alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("sb_id").orderBy("block_in_sb").rowsBetween(Window.unboundedPreceding, -1))
    return own.withColumn("byte_offset", F.coalesce(before, F.lit(0)).cast("bigint"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir or the checkpoint folder of the
    session, or a local one where neither is set and everything runs on this machine."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="strandlake-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, into a scratch folder that stays until the shared one is cleared."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
