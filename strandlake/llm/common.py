"""What the operators share: lineage cuts, Arrow batches of bounded size, and a global order."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes that a kernel sees at a time: bounds its memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A session without one gets a temporary folder, but on this machine alone."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="strandlake-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Like ``cut`` for large rows: a compressed table in the shared folder, a fraction of a checkpoint's size.

    It stays until ``remove`` or until that folder is cleared."""
    path = f"{folder or shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def sliced(batch: pa.RecordBatch, rows: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows and ``most`` bytes, one row at least."""
    at, step = 0, rows
    while at < batch.num_rows:
        part = batch.slice(at, step)
        if part.num_rows > 1 and part.nbytes > most:
            step = max(1, part.num_rows // 2)
            continue
        yield part
        at, step = at + part.num_rows, rows


#: What a worker process keeps from task to task, by the operator that it serves.
_CACHES: dict[str, dict] = {}


def cache(owner: str) -> dict:
    """This worker process's own store for an operator; it is emptied once the process serves another operator."""
    return _CACHES.setdefault(owner, {})


def make_room(owner: str) -> None:
    """Empty the stores of all other operators, and give what is free in this process back to the system."""
    for name, own in _CACHES.items():
        if name != owner:
            own.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = BATCH_ROWS, owner: str = "") -> DataFrame:
    """``mapInArrow`` with small batches of whole texts, cut inside the worker: the session's settings stay.

    Of what worker processes keep between tasks, only the store of ``owner`` is there when ``fn`` begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(owner)
        return fn(part for b in batches for part in sliced(b, rows))

    return df.mapInArrow(run, schema)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def before(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add for each row the sums (long) of all rows that come earlier in the global order of ``order``.

    Rows are range-partitioned and summed inside each partition; only one row per partition goes through the
    driver. The sorted rows are cut first, so that partition numbers stay fixed.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    part = cut(df.repartitionByRange(*keys).withColumns({"_part": F.spark_partition_id(), **{f"_{k}": c.cast("long") for k, c in sums.items()}}))
    totals = sorted(part.groupBy("_part").agg(*[F.sum(f"_{k}").alias(k) for k in sums]).collect())
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for k in sums:
        offsets, total = [], 0
        for r in totals:
            offsets += [F.lit(r["_part"]), F.lit(total).cast("long")]
            total += r[k] or 0
        offset = F.create_map(*offsets)[F.col("_part")] if offsets else F.lit(0).cast("long")
        out[k] = offset + F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0).cast("long"))
    return part.withColumns(out).drop("_part", *[f"_{k}" for k in sums])


def ranked(df: DataFrame, order: list[str], rank: str = "rank") -> DataFrame:
    """Add each row's 0-based place in the global order of ``order``."""
    return before(df, order, {rank: F.lit(1)})
