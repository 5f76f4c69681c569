"""Tables of reads derived from whole texts of the general test tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.batches import flat, sliced, texts

# Letter maps of the derived fixtures.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SEQ_LETTERS = "ACGTACGTACGTACGTACGTACGTNA"
QUAL_LETTERS = "IFFFIFFFIFFFFFIFFFFFIFFFI#"


def _reads_sql(documents: str, text_type: str, flags: str) -> str:
    return f"""
SELECT rec_no, title, translate(raw, '{LETTERS}', '{SEQ_LETTERS}') AS seq,
       CASE WHEN mod(rec_no, 5) = 0 THEN concat('+', substring(title, 2)) ELSE '+' END AS plus,
       translate(raw, '{LETTERS}', '{QUAL_LETTERS}') AS quality
FROM (SELECT doc_id AS rec_no,
             concat('@DOC.', cast(doc_id AS {text_type}), ' ', lang, ':', cast(n_chars AS {text_type}), '/1') AS title,
             concat(lower(regexp_replace(text, '[^a-zA-Z]', ''{flags})),
                    repeat('z', cast(mod(doc_id, 7) AS int))) AS raw
      FROM {documents}) r
WHERE length(raw) > 0"""


def _event_titles_sql(events: str, text_type: str) -> str:
    return f"""
SELECT event_id AS rec_no,
       concat('@EV.', cast(event_id AS {text_type}), ' ', cast(user_id AS {text_type}), ':', event_type, '/',
              cast(mod(event_id, 2) + 1 AS {text_type})) AS title
FROM {events}"""


READS_SQL = _reads_sql("documents", "varchar", ", 'g'")
EVENT_TITLES_SQL = _event_titles_sql("events", "varchar")
#: Colors of reads after the start symbol T, code 3; an N stays where it is, and colors go on across it.
COLOR_READS_SQL = f"""
SELECT rec_no, 'T' || string_agg(CASE WHEN code < 0 THEN ch ELSE cast(xor(code, coalesce(before, 3)) AS varchar) END, '' ORDER BY p) AS seq, '!' || any_value(quality) AS quality
FROM (SELECT *, last_value(CASE WHEN code >= 0 THEN code END IGNORE NULLS) OVER (PARTITION BY rec_no ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM (SELECT rec_no, quality, p, ch, cast(strpos('ACGT', ch) - 1 AS int) AS code
            FROM (SELECT rec_no, quality, unnest(range(0, length(seq))) AS p, unnest(string_split(seq, '')) AS ch FROM ({READS_SQL}))))
GROUP BY rec_no"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CODES = np.zeros((2, 256), np.uint8)
for _k, _to in enumerate((SEQ_LETTERS, QUAL_LETTERS)):
    for _c, _t in zip(LETTERS, _to):
        _CODES[_k][[ord(_c), ord(_c.upper())]] = ord(_t)


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters of texts, and ``extra`` times z behind them, as bases and as qualities; rows without any are left out."""
    for b in (part for batch in batches for part in sliced(batch)):
        data, at = flat(b.column("text"))
        keep = _CODES[0][data] > 0
        data, extra = data[keep], b.column("extra").fill_null(0).to_numpy()
        size = np.diff(np.concatenate(([0], np.cumsum(keep)))[at])
        begin = np.concatenate(([0], np.cumsum(size + extra)))
        place = np.arange(len(data)) + np.repeat(begin[:-1] - np.cumsum(size) + size, size)
        columns = []
        for codes in _CODES:
            out = np.full(begin[-1], codes[ord("z")])
            out[place] = codes[data]
            columns.append(texts(out, begin))
        some = pa.array(size + extra > 0)
        for name in ("text", "extra"):
            some = pc.and_(some, b.column(name).is_valid())
        made = pa.RecordBatch.from_arrays([b.column("rec_no"), b.column("title"), columns[0], b.column("plus"), columns[1]], ["rec_no", "title", "seq", "plus", "quality"])
        yield made.filter(some)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_no, title, seq, plus, quality) made from ``documents``: the rows of ``READS_SQL``, with the letters cut and
    mapped by a kernel, as these texts are made anew by each pass over them."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("bigint").alias("rec_no"),
        F.expr("concat('@DOC.', cast(doc_id AS string), ' ', lang, ':', cast(n_chars AS string), '/1')").alias("title"),
        F.expr("CASE WHEN doc_id IS NOT NULL THEN greatest(cast(mod(doc_id, 7) AS bigint), 0) END").alias("extra"),
        "text",
    )
    docs = docs.withColumn("plus", F.expr("CASE WHEN mod(rec_no, 5) = 0 THEN concat('+', substring(title, 2)) ELSE '+' END"))
    return docs.mapInArrow(_letters, "rec_no bigint, title string, seq string, plus string, quality string")


def event_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_no, title) made from ``events``."""
    return spark.sql(_event_titles_sql("{events}", "string"), events=table(spark, sf_dir, "events"))
