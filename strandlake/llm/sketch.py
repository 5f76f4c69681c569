"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below ``2**64 / SCALE``, and where that leaves fewer than ``FLOOR``,
the ``FLOOR`` least hashes. The same shingle is kept or dropped alike in every document, so sketches merge into
that of the union, and the share of one sketch found in another estimates containment however unequal the
documents are. Its size follows the document's. Two sketches are compared below the bound up to which both are
whole; a text of fewer than ``FLOOR`` shingles is whole throughout, so short texts compare exactly.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import map_batches

SHINGLE, SEED, SCALE, FLOOR = 5, 42, 8, 16
NULL_ID, LAST = -(1 << 63), (1 << 63) - 1


class Shingles:
    """The words of a text and the hash of every shingle, in order."""

    def __init__(self, text: str, width: int = SHINGLE, like: Shingles | None = None, shared: int = 0):
        """``like`` and ``shared``: the first so many words are those of another text, whose hashes hold here."""
        words, get = text.encode().lower().split(), xxhash.xxh64_intdigest
        self.words, self.n = len(words), max(len(words) - width + 1, min(len(words), 1))
        old = max(0, min(shared, len(words)) - width + 1) if like is not None and len(words) > width else 0
        words = words[old:]
        line = b" ".join(words)
        if not words:
            new = []
        elif self.n == 1:
            new = [get(line, SEED)]
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            new = [get(line[s:e], SEED) for s, e in zip(starts[: self.n - old].tolist(), ends[width - 1 :].tolist())]
        self.hashes = np.fromiter(new, np.uint64, len(new))
        if old:
            self.hashes = np.concatenate((like.hashes[:old], self.hashes))

    def sketch(self, scale: int = SCALE, floor: int = FLOOR) -> np.ndarray:
        return _sketched(self.hashes, scale, floor)


def _sketched(hashes: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> np.ndarray:
    kept = np.unique(hashes[hashes < np.uint64((1 << 64) // scale)])
    return kept if len(kept) >= floor else np.unique(hashes)[:floor]


def whole_to(sketch: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> np.uint64:
    """The largest hash up to which a sketch holds every hash of its document."""
    return np.uint64(max((1 << 64) // scale - 1, int(sketch[-1])) if len(sketch) >= floor else (1 << 64) - 1)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two documents together."""
    return _sketched(np.union1d(a, b))


def _comparable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bound = min(whole_to(a), whole_to(b))
    return a[: np.searchsorted(a, bound, side="right")], b[: np.searchsorted(b, bound, side="right")]


def containment(a: np.ndarray, b: np.ndarray) -> float | None:
    """Estimated share of a's shingles that b has too; None where no hash of a is comparable."""
    a, b = _comparable(a, b)
    return float(np.isin(a, b, assume_unique=True).mean()) if len(a) else None


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity, exact where both documents have fewer than ``FLOOR`` shingles; 1 if neither
    has a word."""
    a, b = _comparable(a, b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def written(sketch: np.ndarray) -> str:
    """A sketch as text: its ascending hashes, big-endian, in base 64."""
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([written(Shingles(t or "").sketch()) for t in b.column("text").to_pylist()], pa.string())], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of whole texts; a null text counts as empty and has an empty sketch."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _sketch, "doc_id long, fingerprint string")


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_edited double, in_next double"


def _row(doc_id: int | None, text: str, own: Shingles, after: str, after_own: Shingles) -> tuple:
    n = len(text)
    k = n // 4
    kept = text[: n - k]
    edited = kept + after[:k]
    # words before the cut are shared, but for the last, which the edit may have changed
    shared = max(0, len(kept.encode().split()) - 1)
    changed = own if edited == text else Shingles(edited, like=own, shared=shared)
    a, b, c = own.sketch(), changed.sketch(), after_own.sketch()
    near_edited = 1.0 if edited == text else likeness(a, b)
    near_next = 1.0 if after == text else likeness(a, c)
    return doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), written(a), written(b), near_edited, near_next, containment(a, b), containment(a, c)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by stretch and order; the last of each stretch is the first of the next and gets no row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), *((c, pa.float64()) for c in ("near_edited", "near_next", "in_edited", "in_next"))])
    held = None
    for b in batches:
        out = []
        for stretch, halo, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("stretch", "halo", "doc_id", "text"))):
            text = text or ""
            if held and held[0] == stretch and held[1]:
                continue  # further rows that are equal to the next stretch's first
            own = Shingles(text)
            if held and held[0] == stretch:
                out.append(_row(*held[2:], text, own))
            held = (stretch, halo, doc_id, text, own)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)


def _bounds(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most 2 n bounds (at, key), ascending, between stretches of (at, key): quantiles of ``at``, and of
    ``key`` within an ``at`` that takes several of them."""
    shares = [i / n for i in range(1, n)]
    quantiles = lambda c: F.percentile_approx(c, shares, 100 * n)
    found = rows.agg(quantiles("at")).first()[0] if shares else None
    at, times = np.unique(np.array(found or [], np.int64), return_counts=True)
    hot = [int(v) for v in at[times > 1]]
    inside = {r["at"]: r["q"] for r in rows.where(F.col("at").isin(hot)).groupBy("at").agg(quantiles("key").alias("q")).collect()} if hot else {}
    out = {(v, LAST) for v in at.tolist()}
    for v, m in zip(at.tolist(), times.tolist()):
        out |= {(v, inside[v][(i * len(inside[v])) // (m + 1)]) for i in range(1, m + 1)} if v in inside else set()
    out = sorted(out)
    return np.array([b[0] for b in out], np.int64), np.array([b[1] for b in out], np.int64)


def _places(bounds: tuple[np.ndarray, np.ndarray], at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How many bounds each (at, key) lies above."""
    out, end = np.searchsorted(bounds[0], at, side="left"), np.searchsorted(bounds[0], at, side="right")
    for i in np.unique(out[end > out]):
        own = np.flatnonzero((out == i) & (end > i))
        out[own] += np.searchsorted(bounds[1][i : end[own[0]]], key[own], side="left")
    return out


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint each text, its edited text, and the next document's, in ascending doc_id, equal ones by XXH64
    of the text.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the
    next document's; after the last comes the first. Null doc_ids come first, null texts are empty, repeated
    rows follow each other, a single document is its own next, an empty table gives an empty one. Likeness is
    the Jaccard estimate of the sketches (1 for equal texts), in_edited and in_next the containment of the
    document's sketch (null where it has no word). Very long texts are taken whole; other columns take no part.

    Texts are shuffled once: into stretches of (doc_id, hash) between quantiles, each with a copy of the next
    stretch's first document. A doc_id that many rows share spans several stretches. Only one place per stretch
    passes through the driver.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("at"), F.xxhash64(text).alias("key"))
    bounds = _bounds(docs.select("at", "key"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    @F.pandas_udf("int")
    def stretch_of(at, key):
        import pandas as pd

        return pd.Series(_places(bounds, at.to_numpy(), key.to_numpy()).astype(np.int32))

    least = docs.select("at", "key", stretch_of("at", "key").alias("stretch")).groupBy("stretch").agg(F.min(F.struct("at", "key")).alias("first"))
    firsts = sorted((r.stretch, tuple(r.first)) for r in least.collect())
    previous = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}

    @F.pandas_udf("array<struct<stretch:int,halo:boolean>>")
    def places(at, key):
        import pandas as pd

        own, out = _places(bounds, at.to_numpy(), key.to_numpy()).tolist(), []
        for s, where in zip(own, zip(at.tolist(), key.tolist())):
            out.append([{"stretch": s, "halo": False}] + ([{"stretch": previous[where], "halo": True}] if where in previous else []))
        return pd.Series(out)

    rows = docs.withColumn("p", F.explode(places("at", "key"))).select("p.*", "doc_id", "text", "at", "key")
    rows = rows.repartitionById(len(bounds[0]) + 1, "stretch").sortWithinPartitions("stretch", "halo", "at", "key", "text")
    return map_batches(rows.select("stretch", "halo", "doc_id", "text"), _compare, COMPARED)
