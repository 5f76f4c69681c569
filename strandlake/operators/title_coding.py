"""Titles as coded fields and back: what the superblock's schema tells is not stored again.

A constant field stores nothing. A numeric field stores its value above the least one, or after a block's first
record the delta above the least delta, and nothing where the block's flags tell it. Any other field stores its
length above the least one and the characters at positions that differ within the superblock. Titles without
the expected separators are stored whole, as field -1.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.scalars import BLOCK, SUPERBLOCK, block_id
from strandlake.operators import titles
from strandlake.sources.archive import stored


class Coded(NamedTuple):
    rows: DataFrame  # (sb_id, block_id, rec_no, field_no, num, chars)
    flags: DataFrame  # (block_id, field_no, same_value, least_delta)
    schema: DataFrame  # one row per (sb_id, field_no)
    fields: DataFrame | None = None  # those of split_expected


def _schema(rows: DataFrame, source: DataFrame, size: int) -> DataFrame:
    coding = titles.value_stats(titles.numeric_values(source, size, rows)).select("sb_id", "field_no", "coding", "min_delta")
    mask = titles.char_mask(rows).groupBy("sb_id", "field_no").agg(F.array_sort(F.collect_list(F.struct("pos", "constant"))).alias("m"))
    mask = mask.select("sb_id", "field_no", F.expr("array_join(transform(m, x -> if(x.constant, '1', '0')), '')").alias("mask"))
    first = titles.expected_fields(source, size).select("sb_id", "field_no", "txt0")
    out = titles.field_schema(source, size, rows).join(first, ["sb_id", "field_no"])
    for more in (coding, mask):
        out = out.join(more, ["sb_id", "field_no"], "left")
    kind = F.when(F.col("constant"), "constant").when(F.col("numeric"), "numeric").otherwise("text")
    return out.select("sb_id", "field_no", "sep", "txt0", kind.alias("kind"), "min_len", "min_value", "min_delta", "coding", F.coalesce("mask", F.lit("")).alias("mask"))


def encode(source: DataFrame, size: int = SUPERBLOCK, block: int = BLOCK) -> Coded:
    """Code (rec_no, title); ``size`` is a multiple of ``block``. Fields, schema and coded fields are stored, as each is
    asked for several times."""
    rows = stored(titles.split_expected(source, size), "titles")
    schema = stored(_schema(rows, source, size), "titles")
    each = rows.join(schema.drop("sep", "txt0"), ["sb_id", "field_no"]).withColumn("block_id", block_id(F.col("rec_no"), block))
    each = each.withColumn("value", F.when(F.col("kind") == "numeric", F.col("txt").cast("bigint")))
    order = Window.partitionBy("block_id", "field_no").orderBy("rec_no")
    each = each.withColumn("delta", F.col("value") - F.lag("value").over(order))
    of = lambda f, c: f(c).over(Window.partitionBy("block_id", "field_no"))
    each = each.withColumns({
        "same_value": of(F.min, "value") == of(F.max, "value"),
        "least_delta": F.coalesce((of(F.min, "delta") == of(F.max, "delta")) & (of(F.max, "delta") == F.col("min_delta")), F.lit(False)),
        "head": F.row_number().over(order) == 1,
    })
    by_delta = F.col("coding") == "delta"
    number = F.when(F.col("delta").isNull(), F.col("value") - F.col("min_value"))
    number = number.when(F.col("same_value") | (by_delta & F.col("least_delta")), None)
    number = number.when(by_delta, F.col("delta") - F.col("min_delta")).otherwise(F.col("value") - F.col("min_value"))
    num = F.when(F.col("kind") == "numeric", number).when(F.col("kind") == "text", (F.length("txt") - F.col("min_len")).cast("bigint"))
    left = F.expr("array_join(filter(transform(split(txt, ''), (c, i) -> if(substring(mask, i + 1, 1) = '1', '', c)), c -> c <> ''), '')")
    each = each.select("sb_id", "block_id", "rec_no", "field_no", num.alias("num"), F.when(F.col("kind") == "text", left).alias("chars"), "same_value", "least_delta", (F.col("head") & (F.col("kind") == "numeric")).alias("flag"))
    each = stored(each.where("num is not null or chars is not null or flag"), "titles")
    flags = each.where("flag").select("block_id", "field_no", "same_value", "least_delta")
    coded = each.where("num is not null or chars is not null").select("sb_id", "block_id", "rec_no", "field_no", "num", "chars")
    odd = source.join(rows.where("field_no = 0").select("rec_no"), "rec_no", "left_anti")
    odd = odd.select(block_id(F.col("rec_no"), size).alias("sb_id"), block_id(F.col("rec_no"), block).alias("block_id"), "rec_no", F.lit(-1).alias("field_no"), F.lit(None).cast("bigint").alias("num"), F.col("title").alias("chars"))
    return Coded(coded.union(odd), flags, schema, rows)


def decode(coded: Coded, records: DataFrame, size: int = SUPERBLOCK, block: int = BLOCK) -> DataFrame:
    """(rec_no, title) for the given rec_no, from what ``encode`` kept."""
    odd = coded.rows.where("field_no = -1").select("rec_no", F.col("chars").alias("title"))
    regular = records.select("rec_no").join(odd.select("rec_no"), "rec_no", "left_anti")
    regular = regular.withColumns({"sb_id": block_id(F.col("rec_no"), size), "block_id": block_id(F.col("rec_no"), block)})
    each = regular.join(coded.schema, "sb_id").join(coded.rows.drop("sb_id", "block_id"), ["rec_no", "field_no"], "left").join(coded.flags, ["block_id", "field_no"], "left")
    order = Window.partitionBy("block_id", "field_no").orderBy("rec_no")
    head = F.row_number().over(order) == 1
    by_delta = F.col("coding") == "delta"
    step = F.when(head, F.col("num") + F.col("min_value")).when(F.col("same_value"), 0).otherwise(F.coalesce("num", F.lit(0)) + F.col("min_delta"))
    each = each.withColumns({"head": head, "step": step})
    total = F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    value = F.when(F.col("head") | F.col("same_value") | by_delta, total).otherwise(F.col("num") + F.col("min_value"))
    text = F.expr(
        """array_join(transform(if(num + min_len > 0, sequence(1, cast(num + min_len as int)), cast(array() as array<int>)),
             i -> if(substring(mask, i, 1) = '1', substring(txt0, i, 1), substring(chars, i - length(replace(substring(mask, 1, i - 1), '0', '')), 1))), '')"""
    )
    txt = F.when(F.col("kind") == "constant", F.col("txt0")).when(F.col("kind") == "numeric", value.cast("string")).otherwise(text)
    each = each.withColumn("txt", txt)
    whole = each.groupBy("rec_no").agg(F.array_sort(F.collect_list(F.struct("field_no", "txt", "sep"))).alias("f"))
    return whole.select("rec_no", F.expr("array_join(transform(f, x -> concat(x.txt, x.sep)), '')").alias("title")).union(odd)
