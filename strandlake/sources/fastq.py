"""FASTQ text: a splittable reader of four-line files, a general one per file, and a sink.

``@`` and ``+`` are legal quality bytes, so a record's start cannot be told from a line alone. Four-line files
are read line by line and grouped by line number; files with wrapped sequences go whole to one parser each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TEXT, _END = re.compile("[^\r\n]"), re.compile("[\r\n]")
READS = "file string, rec_no bigint, title string, seq string, plus string, quality string"


def valid() -> Column:
    """What a scan accepts: a title with its mark, a base for every quality, at least one, and a plus line."""
    return F.coalesce(F.col("title").startswith("@") & (F.length("title") > 0) & (F.length("seq") > 0) & (F.length("seq") == F.length("quality")) & F.col("plus").startswith("+"), F.lit(False))


def parse(text: str) -> tuple[list[tuple[str, str, str, str]], bool]:
    """All records up to the first malformed one, and whether the text ended cleanly.

    Blank lines before a title or plus line are passed over; bases run to the first +; qualities are as many
    symbols as bases, over any number of lines.
    """
    out, at, n = [], 0, len(text)

    def skip(at: int) -> int:
        found = _TEXT.search(text, at)
        return found.start() if found else n

    def line(at: int) -> tuple[str, int]:
        end = _END.search(text, at)
        end = end.start() if end else n
        return text[at:end], end

    while (at := skip(at)) < n:
        title, at = line(at)
        plus_at = text.find("+", at)
        if not title.startswith("@") or plus_at < 0:
            return out, False
        seq = text[at:plus_at].replace("\r", "").replace("\n", "")
        plus, at = line(plus_at)
        quality, at = [], skip(at)
        need = len(seq)
        while need and at < n:
            part, at = line(at)
            if len(part) > need:
                at -= len(part) - need
                part = part[:need]
            quality.append(part)
            need -= len(part)
            if need:
                at = skip(at)
        if not seq or need:
            return out, False
        out.append((title, seq, plus, "".join(quality)))
    return out, True


def read_whole(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Reads of files of any layout, one task per file; ``rec_no`` counts within the file.

    A malformed record ends its file: under FAILFAST with an error, under PERMISSIVE with what came before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64()] + [pa.string()] * 4
        for b in batches:
            for name, text in zip(b.column("file").to_pylist(), b.column("value").to_pylist()):
                records, clean = parse(text)
                if not clean and mode == "FAILFAST":
                    raise ValueError(f"{name}: malformed record {len(records)}")
                rows = [(name, i, *r) for i, r in enumerate(records)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["file", "rec_no", "title", "seq", "plus", "quality"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.mapInArrow(run, READS)


def from_lines(lines: DataFrame) -> DataFrame:
    """Reads of (file, line_no, value) with four lines a record."""
    group = F.floor(F.col("line_no") / 4).cast("bigint")
    part = lambda k: F.max(F.when(F.col("line_no") % 4 == k, F.rtrim("value", F.lit("\r"))))
    return lines.groupBy("file", group.alias("rec_no")).agg(part(0).alias("title"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("quality"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Reads of four-line files, split at any line; blank lines are passed over. Line numbers come from counts of
    each file's splits. Malformed records are there too: see ``accepted``."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    rows = rows.where(F.rtrim("value", F.lit("\r")) != "")
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("file", "block", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    return from_lines(rows.withColumn("inside", inside).join(counts, ["file", "block"]).select("file", (F.col("before") + F.col("inside")).alias("line_no"), "value"))


def accepted(reads: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """The reads of each file up to its first malformed record, where the scan ends; under FAILFAST that is an error."""
    bad = reads.where(~valid()).groupBy("file").agg(F.min("rec_no").alias("bad"))
    if mode == "FAILFAST" and (first := bad.first()):
        raise ValueError(f"{first.file}: malformed record {first.bad}")
    return reads.join(bad, "file", "left").where("bad is null or rec_no < bad").drop("bad")


def lines(reads: DataFrame) -> DataFrame:
    """(rec_no, value): each read as four lines in one string."""
    return reads.select("rec_no", F.concat_ws("\n", "title", "seq", "plus", "quality").alias("value"))


def write(reads: DataFrame, path: str) -> None:
    """FASTQ text in the order of rec_no, over range-sorted part files."""
    lines(reads).repartitionByRange("rec_no").sortWithinPartitions("rec_no").select("value").write.mode("overwrite").text(path)


def numbered(reads: DataFrame) -> DataFrame:
    """Dense record numbers over all files, in order of file name and place; one row per file is summed.

    Numbers within a file are dense already, so no read is sorted."""
    counts = reads.groupBy("file").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("file", before.alias("before"))
    return reads.join(counts, "file").withColumn("rec_no", (F.col("before") + F.col("rec_no")).cast("bigint")).drop("before", "file")
