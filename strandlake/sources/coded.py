"""Coded archives: what an analysis of superblocks finds is stored, and reads are stored as what it does not tell.

A folder of Parquet tables: ``header`` (facts of each superblock), ``alphabet`` (codes of bases), ``title_schema``,
``title_flags`` and ``title_rows`` (coded titles), ``models`` (histograms with their codes), ``quality`` (coded bits by
block), ``records`` (lengths, plus lines, overlap and packed bases), ``index`` (place and size of each block) and
``trailer`` (totals). Tables of records and blocks are sorted by number, so that a lookup prunes their row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.scalars import BLOCK, SUPERBLOCK, bit_length, block_id
from strandlake.operators import huffman, overlap, profile, quality_coding, title_coding, transforms
from strandlake.sources.archive import remove, scratch

TABLES = ("header", "alphabet", "title_schema", "title_flags", "title_rows", "models", "quality", "records", "index", "trailer")


def is_coded(spark: SparkSession, path: str) -> bool:
    trailer = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/trailer")
    return trailer.getFileSystem(spark._jsc.hadoopConfiguration()).exists(trailer)


def _put(df: DataFrame, path: str, order: str | None = None) -> DataFrame:
    if order:
        df = df.repartitionByRange(order).sortWithinPartitions(order)
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _plain(reads: DataFrame, header: DataFrame, size: int) -> DataFrame:
    """Reads of color superblocks as bases, without their start symbols."""
    rows = profile.superblocks(reads, size).join(header.select("sb_id", "in_colors"), "sb_id")
    colors = transforms.color_decode(rows.where("in_colors"))
    return rows.where("not in_colors").union(colors.select(*rows.columns)).drop("in_colors")


def write(reads: DataFrame, path: str, size: int = SUPERBLOCK, overlaps: str | None = "depth1") -> None:
    """Encode (rec_no, title, seq, plus, quality) into ``path``. ``overlaps`` is the mode of ``best_overlaps``, or None
    to store every read whole; superblocks of reads of 36 bases at most search none."""
    spark = reads.sparkSession
    work = scratch(spark, "coding")
    reads = _put(reads.select("rec_no", "title", "seq", "plus", "quality"), f"{work}/reads")
    header = _put(profile.superblock_header(reads, size), f"{path}/header")
    plain = _put(_plain(reads, header, size), f"{work}/plain")
    _put(profile.alphabet_codes(plain, "seq", size), f"{path}/alphabet")

    titles = title_coding.encode(reads.select("rec_no", "title"), size)
    _put(titles.schema, f"{path}/title_schema")
    _put(titles.flags, f"{path}/title_flags", "block_id")
    title_rows = _put(titles.rows, f"{path}/title_rows", "rec_no")

    qualities = plain.select("rec_no", "quality")
    codes = _put(huffman.huffman(quality_coding.models(qualities, header, size)), f"{path}/models", "sb_id")
    blocks = _put(quality_coding.encode(qualities, header, codes, size), f"{path}/quality", "block_id")

    if overlaps is None:
        found = spark.createDataFrame([], "rec_no long, ref_rec_no long, ref_off int, match_len int")
    else:
        wanted = plain.join(header.where("overlaps").select("sb_id"), "sb_id", "left_semi")
        found = overlap.best_overlaps(wanted.select("rec_no", "seq", "quality"), mode=overlaps)
    tails = overlap.strip(plain.select("rec_no", "seq"), found).withColumnRenamed("tail", "seq")
    plus = transforms.plus_store(reads.select("rec_no", "title", "plus")).select("rec_no", "plus_only", "plus_text")
    records = transforms.pack_bases(tails).drop("seq").join(plus, "rec_no").join(quality_coding.lengths(qualities, header, size), "rec_no")
    records = _put(records, f"{path}/records", "rec_no")

    index = _put(_index(records, blocks, title_rows, size), f"{path}/index", "block_id")
    totals = index.agg(F.count("*").alias("blocks"), F.countDistinct("sb_id").alias("superblocks"), F.sum("rows").alias("records"), F.sum("bytes").alias("bytes"), bit_length(F.max("byte_offset")).alias("offset_bits"))
    _put(totals.select(F.lit(size).alias("size"), F.lit(overlaps or "none").alias("overlaps"), "*"), f"{path}/trailer")
    remove(spark, work)


def _index(records: DataFrame, blocks: DataFrame, title_rows: DataFrame, size: int) -> DataFrame:
    """(sb_id, block_id, block_in_sb, rows, bytes, byte_offset) by the size of what is stored for each block."""
    own = F.octet_length("packed") + 5 * F.size("others") + F.when(F.col("ref_rec_no").isNotNull(), 14).otherwise(0) + F.octet_length(F.coalesce("plus_text", F.lit(""))) + 9
    each = records.groupBy("sb_id", "block_id").agg(F.count("*").alias("rows"), F.sum(own).alias("own"))
    titles = title_rows.groupBy("block_id").agg(F.sum(F.when(F.col("num").isNotNull(), 8).otherwise(0) + F.octet_length(F.coalesce("chars", F.lit("")))).alias("titles"))
    each = each.join(titles, "block_id", "left").join(blocks.select("block_id", F.octet_length("data").alias("quality")), "block_id", "left")
    each = each.select("sb_id", "block_id", F.floor(F.col("block_id") % (size // BLOCK)).cast("int").alias("block_in_sb"), "rows", (F.col("own") + F.coalesce("titles", F.lit(0)) + F.coalesce("quality", F.lit(0))).cast("long").alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("sb_id").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1))
    return each.withColumn("byte_offset", F.coalesce(before, F.lit(0)).cast("long"))


def _decoded(spark: SparkSession, path: str, records: DataFrame, sequences: DataFrame, block: int | None = None) -> DataFrame:
    """The given records; ``sequences`` are their bases, and ``block`` the only block they lie in."""
    table = lambda name: spark.read.parquet(f"{path}/{name}")
    size = table("trailer").first()["size"]
    here = F.lit(True) if block is None else F.col("block_id") == block
    there = F.lit(True) if block is None else F.col("sb_id") == block * BLOCK // size
    titles = title_coding.Coded(table("title_rows").where(here), table("title_flags").where(here), table("title_schema").where(there))
    titles = title_coding.decode(titles, records.select("rec_no"), size)
    qualities = quality_coding.decode(records, table("quality").where(here), table("models").where(there))
    rows = records.select("rec_no", "sb_id", "plus_only", "plus_text").join(titles, "rec_no").join(sequences, "rec_no").join(qualities, "rec_no")
    rows = transforms.plus_rebuild(rows).join(table("header").where(there).select("sb_id", "in_colors", "start_base", "start_quality"), "sb_id")
    columns = ("rec_no", "title", "seq", "plus", "quality")
    colors = rows.where("in_colors")
    colors = transforms.color_encode(colors, F.col("start_base"), F.col("start_quality"))
    return rows.where("not in_colors").select(*columns).union(colors.select(*columns))


def _tails(records: DataFrame) -> DataFrame:
    return transforms.unpack_bases(records.select("rec_no", "ref_rec_no", "ref_off", "match_len", "packed", "n_bases", "others")).select("rec_no", "ref_rec_no", "ref_off", "match_len", F.col("seq").alias("tail"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All reads in the order of rec_no."""
    records = spark.read.parquet(f"{path}/records")
    return _decoded(spark, path, records, overlap.restore(_tails(records))).orderBy("rec_no")


def lookup(spark: SparkSession, path: str, rec_no: int) -> DataFrame:
    """One read, from its own block and the reads that it refers to; none if it is out of range."""
    records = spark.read.parquet(f"{path}/records")
    block, one = rec_no // BLOCK, F.col("rec_no") == rec_no
    wanted = records.where(F.col("block_id") == block)
    every = _decoded(spark, path, wanted, overlap.lookup(_tails(records), rec_no), block)
    return every.where(one)
