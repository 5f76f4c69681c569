"""Size accounting: the bits that each stream of a coded superblock takes, and the ratio that results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.scalars import SUPERBLOCK, bit_length, n_count
from strandlake.operators import overlap, profile, quality_coding, title_coding
from strandlake.operators.huffman import huffman
from strandlake.operators.titles import MAX_DISTINCT, POSITIONS
from strandlake.sources.archive import stored


def _title_models(coded: title_coding.Coded) -> DataFrame:
    """Histograms of what titles store: numbers of up to 512 values by field, and the characters of text fields by
    position, without the positions that are constant."""
    numbers = coded.rows.where("field_no >= 0 and num is not null").groupBy("sb_id", "field_no", "num").agg(F.count("*").alias("n"))
    few = numbers.groupBy("sb_id", "field_no").agg(F.count("*").alias("k")).where(F.col("k") <= MAX_DISTINCT).drop("k")
    numbers = numbers.join(few, ["sb_id", "field_no"]).select(F.lit("title_value").alias("model"), "sb_id", F.col("field_no").cast("string").alias("context"), F.lpad((F.col("num") + F.lit(1 << 60)).cast("string"), 20, "0").alias("symbol"), "n")
    fields = coded.fields.join(coded.schema.where("kind = 'text'").select("sb_id", "field_no", "mask"), ["sb_id", "field_no"])
    each = fields.select("sb_id", "field_no", "mask", F.posexplode(F.split("txt", "")).alias("p", "ch")).where("ch <> '' and substring(mask, p + 1, 1) <> '1'")
    chars = each.groupBy("sb_id", "field_no", F.least("p", F.lit(POSITIONS)).alias("pos"), "ch").agg(F.count("*").alias("n"))
    return numbers.union(chars.select(F.lit("title_char").alias("model"), "sb_id", F.concat_ws(":", "field_no", "pos").alias("context"), F.col("ch").alias("symbol"), "n"))


def models(reads: DataFrame, size: int = SUPERBLOCK, titles: title_coding.Coded | None = None) -> DataFrame:
    """(model, sb_id, context, symbol, n): every histogram that codes are built for; ``titles`` where they are coded already."""
    titles = titles or title_coding.encode(reads.select("rec_no", "title"), size)
    qualities = quality_coding.models(reads.select("rec_no", "quality"), profile.quality_method(reads, size), size)
    return qualities.union(_title_models(titles))


def size_report(reads: DataFrame, size: int = SUPERBLOCK, overlaps: str | None = None) -> DataFrame:
    """(sb_id, stream, bits) of everything that reading back needs.

    "quality", "title_char" and "title_value" by their codes, "tables" the histograms that these come from,
    "title_number" numbers of over 512 values at the width of their range, "title_odd" titles without the expected
    separators, "title_flags" two bits for each numeric field of a block, "bases" at the width of their alphabet
    (two bits at least) without N and without the prefixes that ``overlaps`` finds, "overlaps" their triples at the
    width of the largest, "n" the places of N, "lengths" where they vary, "plus" a bit where one is not bare and the
    text of plus lines that the title does not tell.
    """
    rows, kept = profile.superblocks(reads, size), title_coding.encode(reads.select("rec_no", "title"), size)
    codes = stored(huffman(models(reads, size, kept)), "codes")
    coded = codes.groupBy("sb_id", F.when(F.col("model").startswith("title"), F.col("model")).otherwise("quality").alias("stream")).agg(F.sum(F.col("n") * F.col("bits")).alias("bits"))
    table = codes.groupBy("sb_id", "model", "context").agg(F.count("*").alias("k"), F.max("n").alias("m"))
    table = table.select("sb_id", F.lit("tables").alias("stream"), (8 + bit_length(F.col("k")) + F.col("k") * (8 + bit_length(F.col("m")))).alias("bits"))

    numbers = kept.rows.where("num is not null").groupBy("sb_id", "field_no").agg(F.countDistinct("num").alias("k"), F.count("*").alias("n"), F.max("num").alias("hi"), F.min("num").alias("lo"))
    numbers = numbers.where(F.col("k") > MAX_DISTINCT).select("sb_id", F.lit("title_number").alias("stream"), (F.col("n") * bit_length(F.col("hi") - F.col("lo"))).alias("bits"))
    odd = kept.rows.where("field_no = -1").select("sb_id", F.lit("title_odd").alias("stream"), (8 * F.octet_length(F.coalesce("chars", F.lit("")))).alias("bits"))
    flags = kept.flags.select(F.floor(F.col("block_id") * 32 / size).cast("bigint").alias("sb_id"), F.lit("title_flags").alias("stream"), F.lit(2).alias("bits"))

    facts = rows.groupBy("sb_id").agg(F.count("*").alias("records"), F.max(F.length("quality")).alias("max_len"), (F.min(F.length("quality")) != F.max(F.length("quality"))).alias("vary"), F.bool_and(F.length("plus") == 1).alias("bare"))
    letters = profile.alphabet_codes(reads, "seq", size).groupBy("sb_id").agg(F.count("*").alias("k")).select("sb_id", F.greatest(bit_length(F.col("k") - 1), F.lit(2)).alias("width"))
    facts = facts.join(letters, "sb_id", "left").withColumn("width", F.coalesce("width", F.lit(0)))
    found = overlap.best_overlaps(reads, mode=overlaps) if overlaps else rows.sparkSession.createDataFrame([], "rec_no long, ref_rec_no long, ref_off int, match_len int")
    widths = found.agg(*[F.coalesce(bit_length(F.max(c)), F.lit(0)).alias(w) for c, w in (("ref_rec_no", "a"), ("ref_off", "b"), ("match_len", "c"))])
    own = rows.select("rec_no", "sb_id", F.length("seq").alias("len"), n_count(F.col("seq")).alias("n"), "plus", "title").join(found.select("rec_no", "match_len"), "rec_no", "left").join(facts.drop("records"), "sb_id").crossJoin(F.broadcast(widths))
    per = lambda name, bits: F.struct(F.lit(name).alias("stream"), bits.cast("bigint").alias("bits"))
    told = F.concat(F.lit("+"), F.expr("substring(title, 2)"))
    streams = [
        per("bases", F.col("width") * (F.col("len") - F.col("n") - F.coalesce("match_len", F.lit(0)))),
        per("overlaps", F.when(F.col("match_len").isNotNull(), F.col("a") + F.col("b") + F.col("c")).otherwise(0)),
        per("n", F.col("n") * bit_length(F.col("max_len"))),
        per("lengths", F.when(F.col("vary"), bit_length(F.col("max_len"))).otherwise(0)),
        per("plus", F.when(F.col("bare"), 0).otherwise(1) + F.when((F.col("plus") != "+") & (F.col("plus") != told), 8 * F.octet_length("plus")).otherwise(0)),
    ]
    each = own.select("sb_id", F.explode(F.array(*streams)).alias("s")).select("sb_id", "s.*")
    every = reduce(DataFrame.union, [df.select("sb_id", "stream", F.col("bits").cast("bigint").alias("bits")) for df in (coded, table, numbers, odd, flags, each)])
    return every.groupBy("sb_id", "stream").agg(F.sum("bits").cast("bigint").alias("bits")).where("bits > 0")


def input_bytes() -> Column:
    """Bytes of a read as four lines."""
    return F.octet_length("title") + F.octet_length("seq") + F.octet_length("plus") + F.octet_length("quality") + 4


def compression(reads: DataFrame, size: int = SUPERBLOCK, overlaps: str | None = None) -> DataFrame:
    """(sb_id, input_bytes, coded_bytes, ratio) over all streams of ``size_report``."""
    text = profile.superblocks(reads, size).groupBy("sb_id").agg(F.sum(input_bytes()).cast("bigint").alias("input_bytes"))
    coded = size_report(reads, size, overlaps).groupBy("sb_id").agg(F.ceil(F.sum("bits") / 8).cast("bigint").alias("coded_bytes"))
    return text.join(coded, "sb_id").withColumn("ratio", F.round(F.col("input_bytes") / F.col("coded_bytes"), 4))
