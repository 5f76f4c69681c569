"""Queries of the training-data operators, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import ann, langid, licenses, mixing, pieces, quality, simhash, sketch, substrings, warc
from strandlake.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_with_next(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_ann, op3_language_id, op4_quality, op5_license_scan, op6_suffix_dedup, op7_document_fingerprints, op8_source_mixing, op9_warc, op10_sentencepiece)
    return {f.__name__: f for f in found}


#: The five-bit digits of a SHA-1 in base 32, each from the two hex digits that hold it.
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda k: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + (
    ((16 * (strpos('0123456789abcdef', substring(h, cast(5 * k // 4 + 1 AS int), 1)) - 1) + strpos('0123456789abcdef', substring(h, cast(5 * k // 4 + 2 AS int), 1)) - 1)
     >> cast(3 - 5 * k % 4 AS int)) & 31) AS int), 1)), '')"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_suffix_dedup": substrings.SQL,
        "op8_source_mixing": mixing.SQL,
        "op9_warc": f"""SELECT page_id, cast(strlen(p) AS bigint) AS payload_bytes, {_BASE32} AS payload_digest,
            CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
            FROM (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages)"""
    }
