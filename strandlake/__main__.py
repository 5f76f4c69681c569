"""Command line: ``e`` codes FASTQ text into an archive, ``d`` writes FASTQ text from an archive, or one record."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.sizes import input_bytes
from strandlake.sources import archive, coded, fastq

#: Least, usual and greatest MB of memory.
LEAST_MB, USUAL_MB, MOST_MB = 128, 2048, 65536


def _say(verb: str, reads: DataFrame, path: str, seconds: float) -> None:
    """Speed in MB of text a second, and the ratio of text to archive."""
    spark = reads.sparkSession
    plain = reads.agg(F.sum(input_bytes())).first()[0] or 0
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    stored = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    print(f"{verb}: {plain / 1e6 / max(seconds, 1e-9):.2f} MB/s, ratio {plain / max(stored, 1):.2f}")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandlake", description=__doc__)
    parser.add_argument("verb", choices=["e", "d"])
    parser.add_argument("-r", type=int, metavar="N", help="with d: only record N, counted from 0")
    parser.add_argument("-l", action="store_true", help="with e: search overlaps between reads; slower, a bit stronger")
    parser.add_argument("-m", type=int, metavar="MB", default=USUAL_MB, help=f"memory of the driver, {LEAST_MB} to {MOST_MB}, where no session runs yet")
    parser.add_argument("--plain", action="store_true", help="with e: keep reads as plain columns")
    parser.add_argument("--wrapped", action="store_true", help="with e: records may span more than four lines; one task per file")
    parser.add_argument("--mode", choices=["PERMISSIVE", "FAILFAST"], default="PERMISSIVE", help="a malformed record ends its file, or is an error")
    parser.add_argument("source")
    parser.add_argument("target")
    got = parser.parse_args(args)
    memory = min(MOST_MB, max(LEAST_MB, got.m))
    spark = SparkSession.builder.appName("strandlake").config("spark.driver.memory", f"{max(memory, 512)}m").getOrCreate()
    began = time.perf_counter()
    if got.verb == "d":
        kind = coded if coded.is_coded(spark, got.source) else archive
        reads = kind.read(spark, got.source) if got.r is None else kind.lookup(spark, got.source, got.r)
        fastq.write(reads, got.target)
        _say("decoded", reads, got.source, time.perf_counter() - began)
        return
    if got.wrapped:
        reads = fastq.read_whole(spark, got.source, got.mode)
    else:
        try:
            reads = fastq.accepted(fastq.read_lines(spark, got.source), got.mode)
        except ValueError as e:
            raise SystemExit(str(e)) from e
    reads = fastq.numbered(reads).select("rec_no", "title", "seq", "plus", "quality")
    if got.plain:
        archive.write(reads, got.target)
    else:
        coded.write(reads, got.target, overlaps="depth1" if got.l else None)
    kind = archive if got.plain else coded
    _say("encoded", kind.read(spark, got.target), got.target, time.perf_counter() - began)


if __name__ == "__main__":
    main()
