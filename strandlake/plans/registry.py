"""Every query of the engine with the SQL that must give the same rows.

Queries on reads use superblocks of 256 so that small tables span several; titles of events use the default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.fixtures import COLOR_READS_SQL, EVENT_TITLES_SQL, READS_SQL, event_titles, reads, table
from strandlake.functions.scalars import SUPERBLOCK, bit_length, kept_length, last_kept, n_count, run_estimate
from strandlake.operators import deltas, huffman, overlap, profile, quality_coding, runs, sizes, title_coding, titles, transforms
from strandlake.sources import archive, coded, fastq

SB = 256
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_WITH = f"WITH RECURSIVE reads AS ({READS_SQL}), color_reads AS ({COLOR_READS_SQL}), titles AS ({EVENT_TITLES_SQL})"


def query(sql: str | None = None):
    """Register a query; ``sql`` sees the views reads, color_reads and titles besides the tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            join = ",\n" if sql.lstrip().startswith(",") else "\n"
            ORACLE_SQL[f.__name__] = _WITH + (join + sql.lstrip().lstrip(",") if join == ",\n" else join + sql)
        return f

    return add


def _chars(column: str, source: str, extra: str = "rec_no") -> str:
    """Rows (extra, p, ch) of the characters of a column, p from 0."""
    return f"SELECT {extra}, unnest(range(0, length({column}))) AS p, unnest(string_split({column}, '')) AS ch FROM {source} WHERE length({column}) > 0"


def _sb(size: int = SB) -> str:
    return f"cast(rec_no // {size} AS bigint)"


@query(f"SELECT {_sb()} AS sb_id, ch AS base, cast(count(*) AS bigint) AS n FROM ({_chars('seq', 'reads')}) GROUP BY ALL")
def base_composition(spark, sf_dir):
    return profile.base_composition(reads(spark, sf_dir), SB)


@query(
    f"""SELECT sb_id, kind, symbol, cast(dense_rank() OVER (PARTITION BY sb_id, kind ORDER BY symbol) - 1 AS int) AS code FROM (
        SELECT DISTINCT {_sb()} AS sb_id, 'base' AS kind, ch AS symbol FROM ({_chars('seq', 'reads')}) WHERE ch <> 'N'
        UNION SELECT DISTINCT {_sb()}, 'quality', ch FROM ({_chars('quality', 'reads')}))"""
)
def alphabet_codes(spark, sf_dir):
    r = reads(spark, sf_dir)
    parts = [profile.alphabet_codes(r, c, SB).select("sb_id", F.lit(k).alias("kind"), "symbol", "code") for c, k in (("seq", "base"), ("quality", "quality"))]
    return parts[0].union(parts[1])


@query(
    f"""SELECT sb_id, records, blocks, min_len, max_len, cast(max(max_len) OVER (ORDER BY sb_id) AS int) AS running_max_len FROM (
        SELECT {_sb()} AS sb_id, cast(count(*) AS bigint) AS records, cast(ceil(count(*) / 32.0) AS bigint) AS blocks,
               cast(min(length(quality)) AS int) AS min_len, cast(max(length(quality)) AS int) AS max_len FROM reads GROUP BY 1)"""
)
def read_length_profile(spark, sf_dir):
    return profile.read_lengths(reads(spark, sf_dir), SB)


@query("SELECT rec_no, replace(seq, 'N', '') AS seq, array_to_string(list_filter(list_transform(string_split(seq, ''), lambda c, i: CASE WHEN c = 'N' THEN i ELSE 0 END), lambda p: p > 0), ',') AS n_pos, cast(length(seq) - length(replace(seq, 'N', '')) AS int) AS n_count FROM reads")
def n_transfer(spark, sf_dir):
    r = reads(spark, sf_dir).select("rec_no", "seq", n_count(F.col("seq")).alias("n_count"))
    return transforms.n_transfer(r).select("rec_no", "seq", F.array_join(F.col("n_pos").cast("array<string>"), ",").alias("n_pos"), "n_count")


@query("SELECT rec_no, seq FROM reads")
def n_restore(spark, sf_dir):
    return transforms.n_restore(transforms.n_transfer(reads(spark, sf_dir).select("rec_no", "seq")))


@query(f"SELECT rec_no, length(plus) = 1 AS plus_only, bool_and(length(plus) = 1) OVER (PARTITION BY {_sb(32)}) AS block_plus_only FROM reads")
def plus_flags(spark, sf_dir):
    r = transforms.plus_flags(reads(spark, sf_dir)).withColumn("b", F.floor(F.col("rec_no") / 32))
    return r.join(r.groupBy("b").agg(F.bool_and("plus_only").alias("block_plus_only")), "b").select("rec_no", "plus_only", "block_plus_only")


@query("SELECT rec_no, plus FROM reads")
def plus_rebuild(spark, sf_dir):
    return transforms.plus_rebuild(transforms.plus_store(reads(spark, sf_dir))).select("rec_no", "plus")


@query("SELECT rec_no, cast(greatest(length(rtrim(quality, '#')), 1) AS int) AS kept, cast(greatest(length(rtrim(quality, '#')) - 1, 0) AS int) AS last_kept FROM reads")
def tail_trim(spark, sf_dir):
    q = F.col("quality")
    return reads(spark, sf_dir).select("rec_no", kept_length(q).alias("kept"), last_kept(q).alias("last_kept"))


_RUN_ESTIMATE = "1 + len(list_filter(list_zip(string_split(quality, '')[2:], string_split(quality, '')[:-2]), lambda t: t[1] <> t[2])) - CASE WHEN quality LIKE '%#' THEN 1 ELSE 0 END"


@query(f"SELECT rec_no, cast({_RUN_ESTIMATE} AS int) AS runs FROM reads")
def run_estimates(spark, sf_dir):
    return reads(spark, sf_dir).select("rec_no", run_estimate(F.col("quality")).alias("runs"))


_METHOD = "CASE WHEN trunc > 1.25 * runs THEN 'rle' WHEN raw - trunc < 3 * sampled THEN 'plain' ELSE 'truncate' END"
_SAMPLE = f"""SELECT {_sb()} AS sb_id, cast(count(*) AS bigint) AS sampled, cast(sum(length(quality)) AS bigint) AS raw,
    cast(sum(greatest(length(rtrim(quality, '#')) - 1, 0)) AS bigint) AS trunc, cast(sum({_RUN_ESTIMATE}) AS bigint) AS runs
    FROM reads WHERE rec_no % 32 = 0 GROUP BY 1"""


@query(f"SELECT *, {_METHOD} AS method FROM ({_SAMPLE})")
def quality_method(spark, sf_dir):
    return profile.quality_method(reads(spark, sf_dir), SB)


def _hist(source: str) -> str:
    return f""", c AS (SELECT {_sb()} AS sb_id, cast(p + 1 AS int) AS pos, ch AS symbol FROM ({_chars('quality', source)}))
    SELECT sb_id, pos, symbol, cast(count(*) AS bigint) AS n FROM c GROUP BY ALL
    UNION ALL SELECT sb_id, 0, symbol, cast(count(*) AS bigint) FROM c GROUP BY ALL"""


@query(_hist("reads"))
def quality_hist_by_position(spark, sf_dir):
    return profile.quality_histogram(reads(spark, sf_dir), SB)


@query(_hist("(SELECT rec_no, substring(quality, 1, cast(greatest(length(rtrim(quality, '#')), 1) AS int)) AS quality FROM reads)"))
def quality_hist_truncated(spark, sf_dir):
    return profile.quality_histogram(reads(spark, sf_dir), SB, truncate=True)


_RUNS = f""", s AS (SELECT {_sb(32)} AS block_id, rec_no, p, ch FROM ({_chars('quality', 'reads')})),
    e AS (SELECT *, CASE WHEN lag(ch) OVER (PARTITION BY block_id ORDER BY rec_no, p) = ch THEN 0 ELSE 1 END AS new FROM s),
    i AS (SELECT *, sum(new) OVER (PARTITION BY block_id ORDER BY rec_no, p ROWS UNBOUNDED PRECEDING) AS island FROM e),
    w AS (SELECT block_id, island, ch, count(*) AS n FROM i GROUP BY ALL),
    x AS (SELECT *, unnest(range(0, cast(ceil(n / 255.0) AS bigint))) AS piece FROM w),
    runs AS (SELECT block_id, cast(row_number() OVER (PARTITION BY block_id ORDER BY island, piece) - 1 AS int) AS run_no, ch AS symbol,
                    cast(least(255, n - 255 * piece) AS int) AS run_len FROM x)"""


@query(_RUNS + " SELECT * FROM runs")
def quality_runs(spark, sf_dir):
    return runs.quality_runs(reads(spark, sf_dir))


@query(_RUNS + " SELECT cast(block_id // 8 AS bigint) AS sb_id, symbol, run_len, cast(count(*) AS bigint) AS n FROM runs GROUP BY ALL")
def run_length_hist(spark, sf_dir):
    return runs.run_histogram(runs.quality_runs(reads(spark, sf_dir)), 8)


@query(_RUNS + ", g AS (SELECT *, coalesce(lag(symbol) OVER (PARTITION BY block_id ORDER BY run_no), '') AS context FROM runs) SELECT cast(block_id // 8 AS bigint) AS sb_id, context, symbol, cast(count(*) AS bigint) AS n FROM g GROUP BY ALL")
def quality_bigrams(spark, sf_dir):
    return runs.run_bigrams(reads(spark, sf_dir), 8)


@query(_RUNS + " SELECT cast(block_id // 8 AS bigint) AS sb_id, cast(count(DISTINCT symbol) AS bigint) AS n_symbols, cast(max(run_len) AS int) AS max_run FROM runs GROUP BY 1")
def run_alphabet(spark, sf_dir):
    coded = runs.quality_runs(reads(spark, sf_dir))
    return coded.groupBy(F.floor(F.col("block_id") / 8).cast("bigint").alias("sb_id")).agg(F.countDistinct("symbol").alias("n_symbols"), F.max("run_len").alias("max_run"))


@query("SELECT rec_no, quality FROM reads")
def quality_runs_restore(spark, sf_dir):
    r = reads(spark, sf_dir)
    return runs.restored(runs.coded_blocks(r), r.select("rec_no", F.length("quality").alias("len")))


_TOKENS = "list_zip(string_split_regex(title, '[ ._,=:/-]'), list_append(regexp_extract_all(title, '[ ._,=:/-]'), ''))"


def _tokens(source: str, extra: str) -> str:
    return f"SELECT {extra}, cast(i - 1 AS int) AS field_no, t[i][1] AS txt, t[i][2] AS sep FROM (SELECT {extra}, {_TOKENS} AS t, unnest(range(1, len({_TOKENS}) + 1)) AS i FROM {source})"


@query(_tokens("(SELECT page_id AS rec_no, url AS title FROM pages)", "rec_no"))
def title_tokens(spark, sf_dir):
    return titles.title_tokens(table(spark, sf_dir, "pages").select(F.col("page_id").alias("rec_no"), F.col("url").alias("title")))


_SPLIT = f""", first AS (SELECT {_sb(SUPERBLOCK)} AS sb_id, min_by(title, rec_no) AS title FROM titles GROUP BY 1),
    expected AS ({_tokens('first', 'sb_id')}),
    steps AS (SELECT {_sb(SUPERBLOCK)} AS sb_id, rec_no, 0 AS field_no, title AS rest FROM titles
              UNION ALL SELECT s.sb_id, s.rec_no, s.field_no + 1, substring(s.rest, cast(strpos(s.rest, e.sep) + 1 AS int)) FROM steps s
              JOIN expected e ON e.sb_id = s.sb_id AND e.field_no = s.field_no WHERE e.sep <> '' AND strpos(s.rest, e.sep) > 0),
    good AS (SELECT s.sb_id, s.rec_no FROM steps s JOIN expected e ON e.sb_id = s.sb_id AND e.field_no = s.field_no WHERE e.sep = ''),
    fields AS (SELECT s.sb_id, s.rec_no, cast(s.field_no AS int) AS field_no, CASE WHEN e.sep = '' THEN s.rest ELSE substring(s.rest, 1, cast(strpos(s.rest, e.sep) - 1 AS int)) END AS txt
               FROM steps s JOIN expected e ON e.sb_id = s.sb_id AND e.field_no = s.field_no JOIN good g ON g.sb_id = s.sb_id AND g.rec_no = s.rec_no)"""
_NUMERIC = "regexp_matches(txt, '^(0|[1-9][0-9]{0,17})$')"
_VALUE = f"CASE WHEN {_NUMERIC} THEN try_cast(txt AS bigint) END"


@query(
    _SPLIT
    + f"""SELECT e.sb_id, e.field_no, e.sep, min(txt) = max(txt) AS constant, cast(min(length(txt)) AS int) AS min_len, cast(max(length(txt)) AS int) AS max_len,
        bool_and(regexp_matches(txt, '^[0-9]*$')) AS digits, bool_and({_NUMERIC}) AS numeric,
        CASE WHEN bool_and({_NUMERIC}) THEN min({_VALUE}) END AS min_value, CASE WHEN bool_and({_NUMERIC}) THEN max({_VALUE}) END AS max_value
        FROM (SELECT sb_id, field_no, sep FROM expected) e JOIN fields f ON f.sb_id = e.sb_id AND f.field_no = e.field_no GROUP BY e.sb_id, e.field_no, e.sep"""
)
def title_schema(spark, sf_dir):
    return titles.field_schema(event_titles(spark, sf_dir))


@query(_SPLIT + " SELECT sb_id, rec_no, field_no, txt FROM fields")
def title_split_expected(spark, sf_dir):
    return titles.split_expected(event_titles(spark, sf_dir))


@query(
    _SPLIT
    + f"""SELECT t.sb_id, t.titles, cast(coalesce(g.n, 0) AS bigint) AS conforming, t.titles = coalesce(g.n, 0) AS all_conform
        FROM (SELECT {_sb(SUPERBLOCK)} AS sb_id, cast(count(*) AS bigint) AS titles FROM titles GROUP BY 1) t
        LEFT JOIN (SELECT sb_id, count(*) AS n FROM good GROUP BY 1) g ON g.sb_id = t.sb_id"""
)
def title_conformity(spark, sf_dir):
    return titles.conformity(event_titles(spark, sf_dir))


@query(
    _SPLIT
    + f""", v AS (SELECT {_sb(32)} AS block_id, field_no, rec_no, txt, {_VALUE} AS value FROM fields),
        d AS (SELECT *, value - lag(value) OVER (PARTITION BY block_id, field_no ORDER BY rec_no) AS delta FROM v)
        SELECT block_id, field_no, min(txt) = max(txt) AS text_constant,
               coalesce(min(value) = max(value) AND count(value) = count(*), false) AS value_constant,
               coalesce(min(delta) = max(delta) AND count(value) = count(*), false) AS delta_constant FROM d GROUP BY 1, 2"""
)
def title_block_constants(spark, sf_dir):
    return titles.block_constants(event_titles(spark, sf_dir))


def _names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 256).cast("bigint").alias("sb_id"), F.lit(0).alias("field_no"), F.col("c_custkey").alias("rec_no"), F.col("c_name").alias("txt"))


_NAMES = ", names AS (SELECT c_custkey AS rec_no, cast(c_custkey // 256 AS bigint) AS sb_id, c_name AS txt FROM customer)"
_NAME_CHARS = _chars("txt", "names", "sb_id, rec_no")


@query(_NAMES + f" SELECT sb_id, 0 AS field_no, cast(least(p, 128) AS int) AS pos, ch, cast(count(*) AS bigint) AS n FROM ({_NAME_CHARS}) GROUP BY ALL")
def title_char_hist(spark, sf_dir):
    return titles.char_histogram(_names(spark, sf_dir))


@query(
    _NAMES
    + f""", c AS ({_NAME_CHARS}), f AS (SELECT sb_id, min_by(txt, rec_no) AS txt0, count(*) AS records FROM names GROUP BY 1)
        SELECT c.sb_id, 0 AS field_no, cast(p AS int) AS pos, bool_and(ch = substring(txt0, cast(p + 1 AS int), 1)) AND count(*) = max(records) AS constant
        FROM c JOIN f ON f.sb_id = c.sb_id WHERE p < length(txt0) GROUP BY c.sb_id, p"""
)
def title_char_mask(spark, sf_dir):
    return titles.char_mask(_names(spark, sf_dir))


@query(f"SELECT {_sb(SUPERBLOCK)} AS sb_id, rec_no, cast(user_id - coalesce(lag(user_id) OVER (PARTITION BY {_sb(SUPERBLOCK)} ORDER BY rec_no), 0) AS bigint) AS delta FROM (SELECT event_id AS rec_no, user_id FROM events)")
def title_numeric_deltas(spark, sf_dir):
    return deltas.deltas(table(spark, sf_dir, "events").select(F.col("event_id").alias("rec_no"), F.col("user_id").alias("value")))


@query("SELECT event_id AS rec_no, user_id AS value FROM events")
def delta_restore(spark, sf_dir):
    return deltas.restore(title_numeric_deltas(spark, sf_dir))


def _bits(x: str) -> str:
    return f"cast(CASE WHEN {x} <= 0 THEN 0 ELSE length(bin({x})) END AS int)"


_NUMBERS = _SPLIT + f", n AS (SELECT sb_id, field_no, rec_no, txt::bigint AS value FROM fields WHERE (sb_id, field_no) IN (SELECT (sb_id, field_no) FROM fields GROUP BY sb_id, field_no HAVING bool_and({_NUMERIC})))"


@query(
    _NUMBERS
    + f""", d AS (SELECT *, value - lag(value) OVER (PARTITION BY sb_id, field_no ORDER BY rec_no) AS delta FROM n),
        s AS (SELECT sb_id, field_no, max(value) - min(value) AS vr, coalesce(max(delta) - min(delta), 0) AS dr, count(DISTINCT value) AS nv, count(DISTINCT delta) AS nd FROM d GROUP BY 1, 2)
        SELECT sb_id, field_no, CASE WHEN vr < dr THEN 'value' ELSE 'delta' END AS coding, CASE WHEN vr < dr THEN {_bits('vr')} ELSE {_bits('dr')} END AS bits,
               CASE WHEN vr < dr THEN nv ELSE nd END <= 512 AS table_kept FROM s"""
)
def delta_or_value(spark, sf_dir):
    return titles.value_or_delta(titles.numeric_values(event_titles(spark, sf_dir)))


@query("SELECT rec_no, title FROM reads")
def title_rejoin(spark, sf_dir):
    return titles.restored(reads(spark, sf_dir).select("rec_no", "title"), SB)


@query(f"SELECT event_id, {_bits('user_id')} AS bits FROM events")
def bit_lengths(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", bit_length(F.col("user_id")).alias("bits"))


@query("SELECT rec_no, seq, quality FROM color_reads")
def color_encode(spark, sf_dir):
    return transforms.color_encode(reads(spark, sf_dir).select("rec_no", "seq", "quality"))


@query("SELECT rec_no, seq, quality FROM reads")
def color_decode(spark, sf_dir):
    return transforms.color_decode(color_encode(spark, sf_dir))


@query(
    f"""SELECT {_sb()} AS sb_id, bool_or(regexp_matches(substring(seq, 2, 1), '[0-3]')) AS color,
        min(substring(seq, 1, 1)) = max(substring(seq, 1, 1)) AND min(substring(quality, 1, 1)) = max(substring(quality, 1, 1)) AS constant_start
        FROM (SELECT rec_no, seq, quality FROM color_reads WHERE rec_no % 512 < 256 UNION ALL SELECT rec_no, seq, quality FROM reads WHERE rec_no % 512 >= 256) GROUP BY 1"""
)
def color_space(spark, sf_dir):
    whole = reads(spark, sf_dir).where("rec_no % 512 >= 256").select("rec_no", "seq", "quality")
    return profile.color_space(color_encode(spark, sf_dir).where("rec_no % 512 < 256").union(whole), SB)


@query(
    """, d AS (SELECT rec_no, length(seq) AS n, length(seq) - length(replace(seq, 'N', '')) AS others, list_transform(string_split(rpad(translate(seq, 'ACGTN', '01230'), cast(ceil(length(seq) / 4.0) * 4 AS int), '0'), ''), lambda c: cast(c AS int)) AS d FROM reads)
    SELECT rec_no, cast(n AS int) AS n_bases, cast(others AS int) AS others, array_to_string(list_transform(range(1, cast(len(d) // 2 + 1 AS bigint)), lambda i: substring('0123456789ABCDEF', 4 * d[2 * i - 1] + d[2 * i] + 1, 1)), '') AS packed FROM d"""
)
def pack_two_bit(spark, sf_dir):
    return transforms.pack_bases(reads(spark, sf_dir)).select("rec_no", "n_bases", F.size("others").alias("others"), F.hex("packed").alias("packed"))


@query("SELECT rec_no, seq FROM reads")
def unpack_two_bit(spark, sf_dir):
    return transforms.unpack_bases(transforms.pack_bases(reads(spark, sf_dir)).drop("seq")).select("rec_no", "seq")


_LOG = "CASE WHEN ascii(ch) < 34 OR ascii(ch) > 126 THEN -10.0 ELSE log10(1 - pow(10.0, -(ascii(ch) - 33) / 10.0)) END"
_LOGS = f""", l AS (SELECT rec_no, p, {_LOG} AS v FROM ({_chars('quality', 'reads')})),
    w AS (SELECT rec_no, p, sum(v) OVER (PARTITION BY rec_no ORDER BY p ROWS BETWEEN CURRENT ROW AND 35 FOLLOWING) AS s,
                 count(*) OVER (PARTITION BY rec_no ORDER BY p ROWS BETWEEN CURRENT ROW AND 35 FOLLOWING) AS k FROM l)"""


@query(_LOGS + " SELECT rec_no, cast(count(*) AS int) AS windows, cast(count(*) FILTER (round(s, 9) > -1) AS int) AS eligible, round(max(s), 6) AS best FROM w WHERE k = 36 GROUP BY 1")
def window_probability(spark, sf_dir):
    return overlap.window_logs(reads(spark, sf_dir)).where("windows > 0").select("rec_no", "windows", "eligible", F.round("best", 6).alias("best"))


_ANCHORS = (
    _LOGS
    + """, a AS (SELECT r.rec_no, cast(o.off AS int) AS off, substring(r.seq, cast(o.off + 1 AS int), 36) AS kmer FROM reads r, LATERAL (SELECT unnest(range(0, cast(length(r.seq) - 36 AS bigint), 12)) AS off) o WHERE length(r.seq) > 36),
    anchors AS (SELECT kmer, a.rec_no, off FROM a JOIN w ON w.rec_no = a.rec_no AND w.p = a.off AND w.k = 36 WHERE s > -1 AND kmer NOT LIKE '%N%'
                QUALIFY row_number() OVER (PARTITION BY kmer ORDER BY a.rec_no, off) <= 12)"""
)


@query(_ANCHORS + " SELECT kmer, rec_no, off FROM anchors")
def overlap_anchors(spark, sf_dir):
    return overlap.anchors(reads(spark, sf_dir))


_BEST = (
    _ANCHORS
    + """, pr AS (SELECT rec_no, seq, cast(i AS int) AS i, substring(seq, cast(i + 1 AS int), 36) AS kmer FROM (SELECT *, unnest(range(0, least(12, cast(length(seq) - 35 AS bigint)))) AS i FROM reads WHERE length(seq) >= 36)),
    met AS (SELECT pr.rec_no, pr.i, n.rec_no AS ref_rec_no, n.off - pr.i AS ref_off, split_part(substring(pr.seq, 1, 291), 'N', 1) AS a,
                   split_part(substring(r.seq, cast(n.off - pr.i + 1 AS int), 291), 'N', 1) AS b
            FROM pr JOIN anchors n ON n.kmer = pr.kmer JOIN reads r ON r.rec_no = n.rec_no WHERE n.rec_no < pr.rec_no AND n.off >= pr.i),
    m AS (SELECT *, coalesce(list_position(list_transform(range(1, least(length(a), length(b)) + 1), lambda k: substring(a, cast(k AS int), 1) = substring(b, cast(k AS int), 1)), false) - 1, least(length(a), length(b))) AS match_len FROM met),
    best AS (SELECT rec_no, ref_rec_no, cast(ref_off AS int) AS ref_off, cast(match_len AS int) AS match_len FROM m WHERE match_len >= 36
             QUALIFY row_number() OVER (PARTITION BY rec_no ORDER BY match_len DESC, i, ref_rec_no, ref_off) = 1)"""
)


@query(_BEST + " SELECT * FROM best")
def overlap_best(spark, sf_dir):
    return overlap.best_overlaps(reads(spark, sf_dir))


@query("SELECT rec_no, seq FROM reads")
def overlap_restore(spark, sf_dir):
    r = reads(spark, sf_dir).select("rec_no", "seq", "quality")
    return overlap.restore(overlap.strip(r, overlap.best_overlaps(r)))


@query("SELECT rec_no, seq FROM reads")
def overlap_depth1_restore(spark, sf_dir):
    r = reads(spark, sf_dir).select("rec_no", "seq", "quality")
    return overlap.restore(overlap.strip(r, overlap.best_overlaps(r, mode="depth1")))


@query()
def huffman_lengths(spark, sf_dir):
    return huffman.huffman(sizes.models(reads(spark, sf_dir), SB))


@query("SELECT rec_no, quality FROM reads")
def huffman_round_trip(spark, sf_dir):
    r = reads(spark, sf_dir).select("rec_no", "quality")
    methods = profile.quality_method(r, SB)
    methods = methods.withColumn("method", F.element_at(F.array(F.lit("rle"), F.lit("plain"), F.lit("truncate")), (F.col("sb_id") % 3 + 1).cast("int")))  # all three
    codes = archive.stored(huffman.huffman(quality_coding.models(r, methods, SB)), "codes")
    return quality_coding.decode(quality_coding.lengths(r, methods, SB), quality_coding.encode(r, methods, codes, SB), codes)


@query("SELECT rec_no, title, seq, plus, quality FROM reads")
def archive_encode_decode(spark, sf_dir):
    path = archive.scratch(spark, "coded")
    coded.write(reads(spark, sf_dir), path, SB)
    return coded.read(spark, path)


@query("SELECT rec_no, title, seq, plus, quality FROM reads WHERE rec_no = 150")
def coded_lookup(spark, sf_dir):
    path = archive.scratch(spark, "coded")
    coded.write(reads(spark, sf_dir), path, SB)
    return coded.lookup(spark, path, 150)


@query()
def size_report(spark, sf_dir):
    return sizes.size_report(reads(spark, sf_dir), SB)


@query(
    _RUNS
    + f""" SELECT f.sb_id, records, plus_only, variable_length, max_len, n_bases, n_qualities, color, constant_start_base, constant_start_quality, start_base, start_quality,
        max_len > 36 AS overlaps, {_METHOD} AS method, color AND only_colors AND constant_start_base AND constant_start_quality AS in_colors,
        cast(greatest(CASE WHEN n_bases <= 1 THEN 0 ELSE length(bin(n_bases - 1)) END, 2) AS int) AS base_mode, CASE WHEN {_METHOD} = 'rle' THEN longest END AS max_run,
        cast(max(max_len) OVER (ORDER BY f.sb_id) AS int) AS running_max_len
        FROM (SELECT {_sb()} AS sb_id, cast(count(*) AS bigint) AS records, bool_and(length(plus) = 1) AS plus_only, min(length(quality)) <> max(length(quality)) AS variable_length,
                     cast(max(length(quality)) AS int) AS max_len, bool_or(regexp_matches(substring(seq, 2, 1), '[0-3]')) AS color,
                     min(substring(seq, 1, 1)) = max(substring(seq, 1, 1)) AS constant_start_base, min(substring(quality, 1, 1)) = max(substring(quality, 1, 1)) AS constant_start_quality,
                     min(substring(seq, 1, 1)) AS start_base, min(substring(quality, 1, 1)) AS start_quality, bool_and(regexp_matches(seq, '^[ACGT][0-3.N]*$')) AS only_colors FROM mixed GROUP BY 1) f
        JOIN ({_SAMPLE}) s ON s.sb_id = f.sb_id
        JOIN (SELECT {_sb()} AS sb_id, cast(count(DISTINCT ch) AS int) AS n_bases FROM ({_chars('seq', 'mixed')}) WHERE ch <> 'N' GROUP BY 1) b ON b.sb_id = f.sb_id
        JOIN (SELECT {_sb()} AS sb_id, cast(count(DISTINCT ch) AS int) AS n_qualities FROM ({_chars('quality', 'mixed')}) GROUP BY 1) q ON q.sb_id = f.sb_id
        JOIN (SELECT cast(block_id // 8 AS bigint) AS sb_id, cast(max(run_len) AS int) AS longest FROM runs GROUP BY 1) l ON l.sb_id = f.sb_id""".replace("FROM mixed", "FROM reads").replace("mixed", "reads")
)
def superblock_header(spark, sf_dir):
    return profile.superblock_header(reads(spark, sf_dir), SB)


@query("SELECT rec_no, title, seq, plus, quality FROM reads")
def archive_round_trip(spark, sf_dir):
    path = archive.scratch(spark, "archive")
    archive.write(reads(spark, sf_dir), path)
    return archive.read(spark, path)


@query("SELECT rec_no, title, seq, plus, quality FROM reads WHERE rec_no = 33")
def record_lookup(spark, sf_dir):
    path = archive.scratch(spark, "archive")
    archive.write(reads(spark, sf_dir), path)
    return archive.lookup(spark, path, 33)


@query(
    f"""SELECT cast(rec_no // 256 AS bigint) AS sb_id, cast(rec_no % 256 // 32 AS int) AS block_in_sb, cast(count(*) AS bigint) AS rows,
        cast(sum(length(title) + length(seq) + length(plus) + length(quality) + 4) AS bigint) AS bytes,
        cast(coalesce(sum(sum(length(title) + length(seq) + length(plus) + length(quality) + 4)) OVER (PARTITION BY rec_no // 256 ORDER BY rec_no % 256 // 32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS byte_offset
        FROM reads GROUP BY rec_no // 256, rec_no % 256 // 32"""
)
def block_index(spark, sf_dir):
    return archive.block_index(reads(spark, sf_dir), SB)


@query("SELECT rec_no, rec_no % 7 <> 0 AND rec_no % 11 <> 0 AS ok FROM reads")
def fastq_valid(spark, sf_dir):
    r = reads(spark, sf_dir)
    bad = {"title": F.when(F.col("rec_no") % 7 == 0, F.expr("substring(title, 2)")).otherwise(F.col("title")), "quality": F.when(F.col("rec_no") % 11 == 0, F.concat("quality", F.lit("I"))).otherwise(F.col("quality"))}
    return r.withColumns(bad).select("rec_no", fastq.valid().alias("ok"))


@query("SELECT title, seq, plus, quality FROM reads")
def fastq_round_trip(spark, sf_dir):
    path = archive.scratch(spark, "fastq")
    fastq.write(reads(spark, sf_dir), path)
    return fastq.read_lines(spark, path).select("title", "seq", "plus", "quality")


@query("SELECT rec_no, title FROM titles")
def title_decode(spark, sf_dir):
    source = event_titles(spark, sf_dir)
    return title_coding.decode(title_coding.encode(source), source)


_TITLE_CODES = (
    _NUMBERS
    + f""", k AS (SELECT sb_id, field_no, min(txt) = max(txt) AS constant, bool_and({_NUMERIC}) AS numeric, min(length(txt)) AS min_len, min({_VALUE}) AS min_value, count(*) AS records FROM fields GROUP BY 1, 2),
    a AS (SELECT *, value - lag(value) OVER (PARTITION BY sb_id, field_no ORDER BY rec_no) AS delta FROM n),
    g AS (SELECT sb_id, field_no, coalesce(min(delta), 0) AS min_delta, max(value) - min(value) < coalesce(max(delta) - min(delta), 0) AS by_value FROM a GROUP BY 1, 2),
    e AS (SELECT n.*, {_sb(32)} AS block_id, value - lag(value) OVER (PARTITION BY {_sb(32)}, field_no ORDER BY rec_no) AS delta FROM n),
    fl AS (SELECT block_id, e.field_no, min(value) = max(value) AS same_value, coalesce(min(delta) = max(delta) AND max(delta) = any_value(min_delta), false) AS least_delta
           FROM e JOIN g ON g.sb_id = e.sb_id AND g.field_no = e.field_no GROUP BY 1, 2),
    numbers AS (SELECT e.sb_id, e.block_id, e.rec_no, e.field_no, CASE WHEN delta IS NULL THEN value - min_value WHEN same_value OR (NOT by_value AND least_delta) THEN NULL
                       WHEN by_value THEN value - min_value ELSE delta - min_delta END AS num, NULL::varchar AS chars
                FROM e JOIN k ON k.sb_id = e.sb_id AND k.field_no = e.field_no AND NOT constant JOIN g ON g.sb_id = e.sb_id AND g.field_no = e.field_no JOIN fl ON fl.block_id = e.block_id AND fl.field_no = e.field_no),
    ch AS (SELECT sb_id, field_no, rec_no, unnest(range(0, length(txt))) AS p, unnest(string_split(txt, '')) AS c FROM fields WHERE length(txt) > 0),
    fixed AS (SELECT ch.sb_id, ch.field_no, p FROM ch JOIN k ON k.sb_id = ch.sb_id AND k.field_no = ch.field_no GROUP BY 1, 2, 3 HAVING min(c) = max(c) AND count(*) = max(records)),
    loose AS (SELECT sb_id, field_no, rec_no, string_agg(c, '' ORDER BY p) AS chars FROM ch ANTI JOIN fixed USING (sb_id, field_no, p) GROUP BY 1, 2, 3),
    texts AS (SELECT f.sb_id, cast(f.rec_no // 32 AS bigint) AS block_id, f.rec_no, f.field_no, cast(length(txt) - min_len AS bigint) AS num, coalesce(chars, '') AS chars
              FROM fields f JOIN k ON k.sb_id = f.sb_id AND k.field_no = f.field_no AND NOT constant AND NOT numeric LEFT JOIN loose l ON l.sb_id = f.sb_id AND l.field_no = f.field_no AND l.rec_no = f.rec_no),
    odd AS (SELECT {_sb(SUPERBLOCK)} AS sb_id, {_sb(32)} AS block_id, rec_no, -1 AS field_no, NULL::bigint AS num, title AS chars FROM titles ANTI JOIN good USING (rec_no))"""
)


@query(_TITLE_CODES + " SELECT * FROM numbers WHERE num IS NOT NULL UNION ALL SELECT * FROM texts UNION ALL SELECT * FROM odd")
def title_encode(spark, sf_dir):
    return title_coding.encode(event_titles(spark, sf_dir)).rows


_FREQ = " SELECT sb_id, field_no, value, cast(n AS bigint) AS n FROM (SELECT *, count(*) OVER (PARTITION BY sb_id, field_no) AS k FROM (SELECT sb_id, field_no, value, count(*) AS n FROM {source} GROUP BY ALL)) WHERE k <= 512"


@query(_NUMBERS + _FREQ.format(source="n"))
def title_value_frequencies(spark, sf_dir):
    return titles.frequencies(titles.numeric_values(event_titles(spark, sf_dir)))


@query(_NUMBERS + ", d AS (SELECT sb_id, field_no, value - lag(value) OVER (PARTITION BY sb_id, field_no ORDER BY rec_no) AS value FROM n)" + _FREQ.format(source="(SELECT * FROM d WHERE value IS NOT NULL)"))
def title_delta_frequencies(spark, sf_dir):
    return titles.frequencies(titles.numeric_values(event_titles(spark, sf_dir)), deltas=True)


@query("SELECT rec_no, cast(rec_no // 16384 AS bigint) AS sb_id, cast(rec_no // 32 AS bigint) AS block_id, cast(rec_no % 16384 // 32 AS int) AS block_in_sb, cast(rec_no % 32 AS int) AS slot FROM titles")
def record_numbers(spark, sf_dir):
    return profile.record_numbers(event_titles(spark, sf_dir))


@query("SELECT rec_no, substring(quality, 1, cast(greatest(length(rtrim(quality, '#')), 1) AS int)) AS quality, cast(greatest(length(quality) - greatest(length(rtrim(quality, '#')), 1), 0) AS int) AS dropped FROM reads")
def tail_truncate(spark, sf_dir):
    return profile.truncated(reads(spark, sf_dir).select("rec_no", "quality")).select("rec_no", "quality", "dropped")


@query("SELECT rec_no, quality FROM reads")
def tail_restore(spark, sf_dir):
    return profile.refilled(profile.truncated(reads(spark, sf_dir).select("rec_no", "quality"))).select("rec_no", "quality")


@query(_hist("reads").replace("SELECT sb_id, pos, symbol, cast(count(*) AS bigint) AS n FROM c GROUP BY ALL", ", h AS (SELECT sb_id, pos, symbol, cast(count(*) AS bigint) AS n FROM c GROUP BY ALL", 1) + f""")
    SELECT sb_id, pos, cast(8 + {_bits('count(*)')} + count(*) * {_bits('max(n)')} AS bigint) AS bits FROM h GROUP BY sb_id, pos""")
def histogram_sizes(spark, sf_dir):
    return profile.histogram_bits(profile.quality_histogram(reads(spark, sf_dir), SB))


@query()
def compression_ratio(spark, sf_dir):
    return sizes.compression(reads(spark, sf_dir), SB)


@query("SELECT rec_no, seq FROM reads WHERE rec_no = 150")
def overlap_lookup(spark, sf_dir):
    r = reads(spark, sf_dir).select("rec_no", "seq", "quality")
    path = archive.scratch(spark, "stripped")
    overlap.strip(r, overlap.best_overlaps(r)).repartitionByRange("rec_no").sortWithinPartitions("rec_no").write.parquet(path)
    return overlap.lookup(spark.read.parquet(path), 150)
