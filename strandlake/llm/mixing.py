"""Mixing sources to target weights.

Words are summed per source; sources in code-point order weigh 1, 2, 3, 1, ... and share all words by
weight. A target stops at ``CAP`` times its source's words and its excess goes to the others by weight, so
that target = min(CAP * words, level * weight) with one level for all. A document is taken floor(rate) times
and once more by a Bernoulli draw whose probability is the rate's fraction. The draw is a number in [0, 1)
from an MD5 of the row and a seed; of ``SEEDS`` seeds each source uses the one whose sum of words comes nearest
its target, for a few very long documents may hold most of a source's words.

Rows that agree in doc_id, source and text are numbered, and the number is part of what is hashed, so that
each has a draw of its own. Any numbering gives the same rows, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import before, cut, ranked, stored

WEIGHTS, CAP, SEEDS = (1, 2, 3), 3, 32
#: Up to so many sources (or keys of repeated rows) are broadcast, under 1 MB; beyond, a shuffle joins them.
BROADCAST_SOURCES = 10_000


def words(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key() -> Column:
    """What names a row in its draw, in 32 hex digits."""
    doc_id, source, text = (F.col(c).cast("string") for c in ("doc_id", "source", "text"))
    return F.md5(F.concat_ws("|", F.coalesce(doc_id, F.lit("null")), F.coalesce(F.concat(F.lit("="), source), F.lit("null")), F.coalesce(text, F.lit(""))).cast("binary"))


def _drawn(rows: DataFrame) -> DataFrame:
    """Add ``draw`` and ``turn``, uniform in [0, 1) in steps of 2**-44, from a row's key and number."""
    digits = F.md5(F.concat("key", F.lit("|"), F.col("nth").cast("string")).cast("binary"))
    unit = lambda at: F.conv(F.substring(digits, at, 11), 16, 10).cast("long") / F.lit(float(1 << 44))
    return rows.withColumns({"draw": unit(1), "turn": unit(12)})


def _copies(seed: Column) -> Column:
    """floor(rate), and one more if the seed's draw is below the fraction: draw + seed * turn modulo 1, which is
    uniform for each seed and independent for any two."""
    whole, moved = F.floor("rate"), F.col("draw") + seed * F.col("turn")
    return whole + F.when(moved - F.floor(moved) < F.col("rate") - whole, 1).otherwise(0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target, rate) of rows with source and size. Null is a source of its own, the last.

    With the sources in the order of words by weight, the first j stopped at their cap leave the others the
    level (total - cap * their words) / (weights of the rest). It rises with j while the next source is still
    below it and falls afterwards, so the true level is the largest.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = ranked(per, ["source"]).withColumn("weight", turn).withColumn("by_weight", F.col("source_size") / F.col("weight"))
    per = cut(before(per, ["by_weight", "source"], {"held": F.col("source_size"), "weighed": F.col("weight")}))
    total, weight = per.agg(F.sum("source_size"), F.sum("weight")).first()
    level = per.agg(F.max((F.lit(total).cast("long") - cap * F.col("held")) / (F.lit(weight).cast("long") - F.col("weighed")))).first()[0]
    target = F.least(F.col("source_size") * F.lit(float(cap)), F.col("weight") * F.lit(float(level or 0.0)))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    return per.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else df


def _with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    rates = _small(rates.withColumnRenamed("source", "of"))
    return rows.join(rates, rows.source.eqNullSafe(F.col("of")), "left").drop("of")


def _numbered(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Add ``nth``, from 1, among the rows of equal ``key``; ``repeated`` holds the keys of more than one row.

    Rows of a repeated key are numbered inside the partitions that they lie in, after one row for each
    partition has told how many come before it, so that a key may have any number of rows.
    """
    if repeated.isEmpty():
        return rows.withColumn("nth", F.lit(1).cast("long"))
    repeated = _small(repeated)
    alone = rows.join(repeated, "key", "left_anti").withColumn("nth", F.lit(1).cast("long"))
    again = stored(rows.join(repeated, "key", "left_semi").withColumn("part", F.spark_partition_id()))
    counts = again.groupBy("key", "part").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.select("key", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("earlier")))
    inside = F.row_number().over(Window.partitionBy("key", "part").orderBy("key"))
    again = again.withColumn("inside", inside).join(counts, ["key", "part"])
    return alone.union(again.withColumn("nth", F.col("earlier") + F.col("inside")).select(*alone.columns))


def _sized(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, key) of every row, and the keys of repeated rows."""
    sizes = cut(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words(F.col("text").cast("string")).alias("size"), _key().alias("key")))
    return sizes, cut(sizes.groupBy("key").count().where("count > 1").select("key"))


def _rates(drawn: DataFrame) -> DataFrame:
    """``targets`` with the seed of each source."""
    rates = cut(targets(drawn))
    groups = _with_rates(drawn, rates).groupBy("source", "target")
    sums = groups.agg(*[F.sum(F.col("size") * _copies(F.lit(k))).alias(f"s{k}") for k in range(SEEDS)])
    off = F.array(*[F.struct(F.abs(F.col(f"s{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS)])
    seeds = cut(sums.select(F.col("source").alias("of"), F.array_min(off)["seed"].alias("seed")))
    return cut(rates.join(seeds, rates.source.eqNullSafe(F.col("of")), "left").drop("of"))


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source, ...): doc_id, size, source_size, target, taken, copies.

    A wordless or null text has size 0 and counts for nothing, a very long one is counted whole; repeated rows
    and rows without a doc_id draw each for itself; equal sources tie in no order; a corpus without words has
    targets 0; an empty table gives an empty one; other columns take no part, whatever their names.
    """
    sizes, repeated = _sized(docs)
    drawn = cut(_drawn(_numbered(sizes, repeated)))
    out = _with_rates(drawn, _rates(drawn)).withColumn("copies", _copies(F.col("seed")).cast("int"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` themselves, each as often as the mix takes it; wordless rows by the same rates.

    All columns come back as they are, whatever their names; rows that are equal in doc_id, source and text are
    exchangeable, so which of them is taken is left open; an empty table gives an empty one.
    """
    sizes, repeated = _sized(docs)
    rates = _rates(cut(_drawn(_numbered(sizes, repeated))))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("source"), _key().alias("key"))
    out = _with_rates(_drawn(_numbered(rows, repeated)), rates).withColumn("copies", _copies(F.col("seed")).cast("int")).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


#: The same rows in DuckDB, for ``documents``.
SQL = """WITH d AS (SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS bigint) AS size,
        md5(concat(coalesce(cast(doc_id AS varchar), 'null'), '|', coalesce('=' || source, 'null'), '|', coalesce(text, ''))) AS key FROM documents),
    m AS (SELECT doc_id, source, size, md5(key || '|' || cast(row_number() OVER (PARTITION BY key) AS varchar)) AS digits FROM d),
    n AS (SELECT doc_id, source, size, cast('0x' || substring(digits, 1, 11) AS bigint) / 17592186044416.0::double AS draw,
                 cast('0x' || substring(digits, 12, 11) AS bigint) / 17592186044416.0::double AS turn FROM m),
    p AS (SELECT source, cast(sum(size) AS bigint) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, [1, 2, 3][cast((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS int)] AS weight FROM p),
    h AS (SELECT *, cast(coalesce(sum(source_size) OVER o, 0) AS bigint) AS held, cast(coalesce(sum(weight) OVER o, 0) AS bigint) AS weighed FROM w
          WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT max(((SELECT cast(sum(source_size) AS bigint) FROM w) - 3 * held) / ((SELECT cast(sum(weight) AS bigint) FROM w) - weighed)) AS level FROM h),
    t AS (SELECT source, source_size, least(3.0::double * source_size, weight * level) AS target FROM w, l),
    r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::double) ELSE 0.0::double END AS rate FROM t),
    c AS (SELECT n.*, r.source_size, r.target, k.k AS seed, floor(r.rate) + CASE WHEN n.draw + k.k * n.turn - floor(n.draw + k.k * n.turn) < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS copies
          FROM n JOIN r ON r.source IS NOT DISTINCT FROM n.source, (SELECT unnest(range(32)) AS k) k),
    s AS (SELECT source, seed, abs(sum(size * copies) - any_value(target)) AS off FROM c GROUP BY source, seed),
    b AS (SELECT source, seed FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, seed) = 1)
    SELECT doc_id, size, source_size, target, cast(copies * size AS bigint) AS taken, cast(copies AS int) AS copies
    FROM c JOIN b ON b.source IS NOT DISTINCT FROM c.source AND b.seed = c.seed"""
