"""Titles: tokens, the schema that a superblock's first title sets, and statistics of its fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.scalars import BLOCK, SEPARATORS, SUPERBLOCK, bit_length, block_id, symbols

MAX_DISTINCT, POSITIONS = 512, 128


def _tokens(title: str = "title"):
    seps = F.concat(F.regexp_extract_all(title, F.lit(SEPARATORS), F.lit(0)), F.array(F.lit("")))
    return F.arrays_zip(F.split(title, SEPARATORS).alias("txt"), seps.alias("sep"))


def title_tokens(titles: DataFrame) -> DataFrame:
    """(rec_no, field_no, txt, sep): every title cut at each separator; sep follows the field, '' ends the title."""
    return titles.select("rec_no", F.posexplode(_tokens()).alias("field_no", "t")).select("rec_no", "field_no", "t.txt", "t.sep")


def expected_fields(titles: DataFrame, size: int = SUPERBLOCK) -> DataFrame:
    """(sb_id, field_no, sep, txt0): the fields of each superblock's first title."""
    first = titles.groupBy(block_id(F.col("rec_no"), size).alias("sb_id")).agg(F.min_by("title", "rec_no").alias("title"))
    return first.select("sb_id", F.posexplode(_tokens()).alias("field_no", "t")).select("sb_id", "field_no", "t.sep", F.col("t.txt").alias("txt0"))


def split_expected(titles: DataFrame, size: int = SUPERBLOCK) -> DataFrame:
    """(sb_id, rec_no, field_no, txt) of titles that hold the expected separators in their order.

    A separator that is not the next expected one is data. The first title travels as one row per superblock
    on the titles' own partitioning, so the join adds no shuffle of its own beyond sb_id.
    """
    rows = titles.withColumn("sb_id", block_id(F.col("rec_no"), size))
    seps = titles.groupBy(block_id(F.col("rec_no"), size).alias("sb_id")).agg(F.min_by("title", "rec_no").alias("t0"))
    seps = seps.select("sb_id", F.regexp_extract_all("t0", F.lit(SEPARATORS), F.lit(0)).alias("seps"))
    cut = F.expr(
        """aggregate(seps, named_struct('ok', true, 'rest', title, 'parts', cast(array() as array<string>)),
           (a, s) -> named_struct('ok', a.ok and locate(s, a.rest) > 0,
                                  'rest', if(locate(s, a.rest) > 0, substring(a.rest, locate(s, a.rest) + 1), a.rest),
                                  'parts', concat(a.parts, array(substring(a.rest, 1, greatest(locate(s, a.rest) - 1, 0))))),
           a -> if(a.ok, concat(a.parts, array(a.rest)), null))"""
    )
    return rows.join(seps, "sb_id").withColumn("parts", cut).where("parts is not null").select("sb_id", "rec_no", F.posexplode("parts").alias("field_no", "txt"))


def conformity(titles: DataFrame, size: int = SUPERBLOCK) -> DataFrame:
    """(sb_id, titles, conforming, all_conform)."""
    every = titles.groupBy(block_id(F.col("rec_no"), size).alias("sb_id")).agg(F.count("*").alias("titles"))
    good = split_expected(titles, size).where("field_no = 0").groupBy("sb_id").agg(F.count("*").alias("conforming"))
    out = every.join(good, "sb_id", "left").withColumn("conforming", F.coalesce("conforming", F.lit(0)).cast("bigint"))
    return out.withColumn("all_conform", F.col("titles") == F.col("conforming"))


#: Digits that a number gives back unchanged, within a long.
_NUMBER = "^(0|[1-9][0-9]{0,17})$"


def field_schema(titles: DataFrame, size: int = SUPERBLOCK, rows: DataFrame | None = None) -> DataFrame:
    """Per field: constant, length-constant, digits only, numeric (canonical, so that it round-trips), ranges. ``rows`` are
    those of ``split_expected`` where they are at hand."""
    rows = split_expected(titles, size) if rows is None else rows
    number = F.when(F.col("txt").rlike(_NUMBER), F.col("txt").cast("bigint"))
    numeric = F.bool_and(F.col("txt").rlike(_NUMBER))
    stats = rows.groupBy("sb_id", "field_no").agg(
        (F.min("txt") == F.max("txt")).alias("constant"),
        F.min(F.length("txt")).alias("min_len"),
        F.max(F.length("txt")).alias("max_len"),
        F.bool_and(F.col("txt").rlike("^[0-9]*$")).alias("digits"),
        numeric.alias("numeric"),
        F.min(number).alias("lo"),
        F.max(number).alias("hi"),
    )
    stats = stats.withColumns({"min_value": F.when(F.col("numeric"), F.col("lo")), "max_value": F.when(F.col("numeric"), F.col("hi"))}).drop("lo", "hi")
    return expected_fields(titles, size).drop("txt0").join(stats, ["sb_id", "field_no"])


def numeric_values(titles: DataFrame, size: int = SUPERBLOCK, rows: DataFrame | None = None) -> DataFrame:
    """(sb_id, field_no, rec_no, value) of the numeric fields."""
    rows = split_expected(titles, size) if rows is None else rows
    good = rows.groupBy("sb_id", "field_no").agg(F.bool_and(F.col("txt").rlike(_NUMBER)).alias("numeric")).where("numeric").drop("numeric")
    return rows.join(good, ["sb_id", "field_no"]).select("sb_id", "field_no", "rec_no", F.col("txt").cast("bigint").alias("value"))


def block_constants(titles: DataFrame, size: int = SUPERBLOCK, block: int = BLOCK) -> DataFrame:
    """Per field and block: constant text, constant value, constant delta from record to record."""
    rows = split_expected(titles, size).withColumn("block_id", block_id(F.col("rec_no"), block))
    value = F.when(F.col("txt").rlike(_NUMBER), F.col("txt").cast("bigint"))
    rows = rows.withColumn("value", value)
    delta = F.col("value") - F.lag("value").over(Window.partitionBy("block_id", "field_no").orderBy("rec_no"))
    rows = rows.withColumn("delta", delta)
    both = lambda c: F.coalesce((F.min(c) == F.max(c)) & (F.count("value") == F.count("*")), F.lit(False))
    return rows.groupBy("block_id", "field_no").agg((F.min("txt") == F.max("txt")).alias("text_constant"), both("value").alias("value_constant"), both("delta").alias("delta_constant"))


def char_histogram(fields: DataFrame) -> DataFrame:
    """(sb_id, field_no, pos, ch, n) of (sb_id, field_no, rec_no, txt); positions from 128 on share one slot."""
    each = fields.select("sb_id", "field_no", F.posexplode(symbols(F.col("txt"))).alias("p", "ch")).where("ch <> ''")
    return each.groupBy("sb_id", "field_no", F.least("p", F.lit(POSITIONS)).alias("pos"), "ch").agg(F.count("*").alias("n"))


def char_mask(fields: DataFrame) -> DataFrame:
    """(sb_id, field_no, pos, constant): whether every record has record 0's character there. Characters are compared as
    numbers, which are aggregated without a sort of a row per character."""
    each = fields.select("sb_id", "field_no", "rec_no", F.posexplode(symbols(F.col("txt"))).alias("pos", "ch")).where("ch <> ''")
    first = fields.groupBy("sb_id", "field_no").agg(F.min_by("txt", "rec_no").alias("txt0"), F.count("*").alias("records"))
    seen = each.groupBy("sb_id", "field_no", "pos").agg(F.min(F.ascii("ch")).alias("lo"), F.max(F.ascii("ch")).alias("hi"), F.count("*").alias("have"))
    joined = seen.join(first, ["sb_id", "field_no"]).where(F.col("pos") < F.length("txt0"))
    same = (F.col("lo") == F.col("hi")) & (F.col("have") == F.col("records"))
    return joined.select("sb_id", "field_no", "pos", same.alias("constant"))


def value_or_delta(values: DataFrame) -> DataFrame:
    """Per numeric field the coding with the smaller range, deltas on ties, its bits, and whether a table of
    codes is kept: up to 512 distinct values or deltas."""
    return value_stats(values).drop("min_delta")


def value_stats(values: DataFrame) -> DataFrame:
    """``value_or_delta`` with the least delta."""
    rows = values.withColumn("delta", F.col("value") - F.lag("value").over(Window.partitionBy("sb_id", "field_no").orderBy("rec_no")))
    stats = rows.groupBy("sb_id", "field_no").agg(
        (F.max("value") - F.min("value")).alias("value_range"),
        F.coalesce(F.max("delta") - F.min("delta"), F.lit(0)).cast("bigint").alias("delta_range"),
        F.coalesce(F.min("delta"), F.lit(0)).cast("bigint").alias("min_delta"),
        F.countDistinct("value").alias("n_values"),
        F.countDistinct("delta").alias("n_deltas"),
    )
    by_value = F.col("value_range") < F.col("delta_range")
    return stats.select(
        "sb_id",
        "field_no",
        F.when(by_value, "value").otherwise("delta").alias("coding"),
        F.when(by_value, bit_length(F.col("value_range"))).otherwise(bit_length(F.col("delta_range"))).alias("bits"),
        (F.when(by_value, F.col("n_values")).otherwise(F.col("n_deltas")) <= MAX_DISTINCT).alias("table_kept"),
        "min_delta",
    )


def rejoin(titles: DataFrame, size: int = SUPERBLOCK) -> DataFrame:
    """(rec_no, title) put together again from its fields and the expected separators."""
    parts = split_expected(titles, size).join(expected_fields(titles, size).drop("txt0"), ["sb_id", "field_no"])
    ordered = F.array_sort(F.collect_list(F.struct("field_no", "txt", "sep")))
    return parts.groupBy("rec_no").agg(ordered.alias("f")).select("rec_no", F.expr("array_join(transform(f, x -> concat(x.txt, x.sep)), '')").alias("title"))


def restored(titles: DataFrame, size: int = SUPERBLOCK) -> DataFrame:
    """(rec_no, title) of every title: those that conform by ``rejoin``, the others and null ones carried whole."""
    whole = titles.join(split_expected(titles, size).where("field_no = 0").select("rec_no"), "rec_no", "left_anti")
    return rejoin(titles, size).union(whole.select("rec_no", "title"))


def frequencies(values: DataFrame, deltas: bool = False) -> DataFrame:
    """(sb_id, field_no, value, n) of each numeric field, or of its deltas; none for fields of over 512 distinct ones."""
    rows = values
    if deltas:
        before = F.lag("value").over(Window.partitionBy("sb_id", "field_no").orderBy("rec_no"))
        rows = values.withColumn("value", F.col("value") - before).where("value is not null")
    counts = rows.groupBy("sb_id", "field_no", "value").agg(F.count("*").alias("n"))
    few = counts.groupBy("sb_id", "field_no").agg(F.count("*").alias("k")).where(F.col("k") <= MAX_DISTINCT).drop("k")
    return counts.join(few, ["sb_id", "field_no"])
