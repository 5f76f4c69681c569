"""Scalar functions on reads, as column expressions that stay in generated code where Spark allows it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK, SUPERBLOCK, RUN_CAP = 32, 16384, 255
SEPARATORS = "[ ._,=:/-]"
BASES = "ACGT"


def bit_length(x: Column) -> Column:
    """Smallest n with x < 2**n, so that 0 takes 0 bits."""
    return F.when(x <= 0, 0).otherwise(F.length(F.bin(x))).cast("int")


def block_id(rec_no: Column, size: int = BLOCK) -> Column:
    return F.floor(rec_no / size).cast("bigint")


def kept_length(quality: Column) -> Column:
    """Length without the trailing run of #, and 1 if nothing else is there."""
    return F.greatest(F.length(F.rtrim(quality, F.lit("#"))), F.lit(1))


def last_kept(quality: Column) -> Column:
    """Index of the last byte that is not #, 0 if there is none: the estimator's form of the trim."""
    return F.greatest(F.length(F.rtrim(quality, F.lit("#"))) - 1, F.lit(0))


def runs(quality: Column, cap: int | None = None) -> Column:
    """The runs of equal symbols as an array of strings, each at most ``cap`` long."""
    more = "*" if cap is None else f"{{0,{cap - 1}}}"
    return F.regexp_extract_all(quality, F.lit(f"(?s)((.)\\2{more})"), F.lit(1))


def run_estimate(quality: Column) -> Column:
    """Number of runs, less one if the read ends in #."""
    return F.size(runs(quality)) - F.when(quality.endswith("#"), 1).otherwise(0)


def n_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))


def phred_log(symbol: Column) -> Column:
    """log10 of the probability that a base is right; codes below 34 or from 127 on count as -10."""
    code = F.ascii(symbol)
    return F.when((code < 34) | (code > 126), F.lit(-10.0)).otherwise(F.log10(1 - F.pow(F.lit(10.0), -(code - 33) / 10.0)))


def symbols(text: Column) -> Column:
    return F.split(text, "")
