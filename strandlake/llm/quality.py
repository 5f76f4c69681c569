"""Quality scores by histogram gradient-boosted trees over document statistics.

The trees are grown on the driver from a bounded sample of labelled rows, binned once; fitted, they are five
flat arrays in which a leaf is its own child, so that a worker walks all trees for all rows of a batch at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import map_batches

#: Labelled documents to learn from at most; they are taken by the least hash of their id.
LABELLED = 12_000
THRESHOLD = 0.7
TREES, DEPTH, BINS, RATE, L2, LEAF = 120, 5, 64, 0.1, 1.0, 8

NAMES = [
    "log_chars", "log_words", "mean_word", "upper", "lower", "digit", "punct", "symbol", "space", "high", "newlines",
    "entropy", "distinct_words", "top_word", "twice", "same_next", "distinct_pairs", "word_symbols", "upper_words", "digit_words",
    "long_words", "line_words", "same_lines", "bars", "stops", "repeated_lines",
]
_KINDS = np.zeros(256, np.int64)  # 0 other
for _i in range(256):
    _c = chr(_i)
    _KINDS[_i] = 6 if _i >= 0x80 else 1 if "A" <= _c <= "Z" else 2 if "a" <= _c <= "z" else 3 if _c.isdigit() else 5 if _c.isspace() else 4 if _c in ".,;:'\"()-?" else 0


def features(text: str | None) -> list[float]:
    """Statistics of the whole text; all zero where it is null or empty."""
    if not text:
        return [0.0] * len(NAMES)
    data = np.frombuffer(text.encode(), np.uint8)
    by_byte = np.bincount(data, minlength=256)
    n = len(data)
    kinds = np.bincount(_KINDS, weights=by_byte, minlength=7) / n
    p = by_byte[by_byte > 0] / n
    words = text.split()
    w = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    seen = Counter(words)
    top = max(seen.values(), default=0)
    pairs = len(set(zip(words, words[1:])))
    same = sum(a == b for a, b in zip(words, words[1:]))
    alnum = sum(map(str.isalnum, words))
    upper = sum(map(str.isupper, words))
    numeric = sum(x[0].isdigit() for x in words)
    longest = sum(len(x) > 14 for x in words)
    by_line = Counter(lines)
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / w, kinds[1], kinds[2], kinds[3], kinds[4], kinds[0], kinds[5], kinds[6], by_byte[10] / w,
        float(-(p * np.log2(p)).sum()), len(seen) / w, top / w, sum(c > 1 for c in seen.values()) / w, same / w, pairs / w, 1 - alnum / w, upper / w, numeric / w,
        longest / w, len(words) / max(1, len(lines)), sum(c for c in by_line.values() if c > 1) / max(1, len(lines)), by_byte[ord("|")] / w, by_byte[ord(".")] / w, len(by_line) / max(1, len(lines)),
    ]


class Trees:
    """Fitted trees as flat arrays: ``feature``, ``limit``, ``left``, ``right`` and ``value`` of each node."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        self.roots, nodes = [], []
        margin = np.full(n, self.base)
        flat = binned + np.arange(width) * BINS
        for _ in range(TREES):
            prob = 1 / (1 + np.exp(-margin))
            grad, hess = prob - y, prob * (1 - prob)
            self.roots.append(len(nodes))
            nodes.append([0, np.inf, 0, 0, 0.0])
            open_ = [(len(nodes) - 1, np.arange(n))]
            for depth in range(DEPTH + 1):
                grown = []
                for at, rows in open_:
                    g, h = grad[rows].sum(), hess[rows].sum()
                    nodes[at][2:] = [at, at, -RATE * g / (h + L2)]
                    split = self._split(flat, grad, hess, rows, width, g, h) if depth < DEPTH and len(rows) >= 2 * LEAF else None
                    if split is None:
                        margin[rows] += nodes[at][4]
                        continue
                    f, b = split
                    right = binned[rows, f] > b
                    kids = (len(nodes), len(nodes) + 1)
                    nodes[at] = [f, edges[f][b], *kids, 0.0]
                    nodes += [[0, np.inf, k, k, 0.0] for k in kids]
                    grown += [(kids[0], rows[~right]), (kids[1], rows[right])]
                open_ = grown
        f, limit, left, right, value = zip(*nodes)
        self.feature, self.left, self.right = (np.array(v, np.int32) for v in (f, left, right))
        self.limit, self.value, self.roots = np.array(limit), np.array(value), np.array(self.roots, np.int32)

    @staticmethod
    def _split(flat, grad, hess, rows, width, g, h):
        """(feature, last bin on the left) of the best split by its gain, or None."""
        at = flat[rows].ravel()
        sums = lambda v: np.bincount(at, weights=np.repeat(v, width), minlength=width * BINS).reshape(width, BINS).cumsum(1)
        gl, hl, nl = sums(grad[rows]), sums(hess[rows]), np.bincount(at, minlength=width * BINS).reshape(width, BINS).cumsum(1)
        gain = gl**2 / (hl + L2) + (g - gl) ** 2 / (h - hl + L2) - g**2 / (h + L2)
        gain[(nl < LEAF) | (len(rows) - nl < LEAF)] = 0
        best = int(gain.argmax())
        return (best // BINS, best % BINS) if gain.ravel()[best] > 1e-6 else None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = np.where(x[rows, self.feature[node]] > self.limit[node], self.right[node], self.left[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(1))))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learned from; a null id counts as 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("0"))) % 4 == 2


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [np.array(features(t)).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(made, pa.binary())], ["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = LABELLED) -> Trees | None:
    """Learn from ``most`` labelled rows that are not held out; None if there are none. Of several labels for
    one document the largest counts, of several texts under one id the one with the least statistics."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, most / max(1, known.count()))  # a hash share first: what is left to sort is bounded
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    if not picked:
        return None
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in picked], "doc_id long, label int")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    made = map_batches(rows, _statistics, "doc_id long, label int, x binary")
    one = made.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("one"))  # rows may share an id: ``most`` rows at most
    got = sorted((r.label, bytes(r.x)) for r in one.select("one.*").collect())
    if not got:
        return None
    return Trees(np.stack([np.frombuffer(x) for _, x in got]), np.array([y > 0 for y, _ in got], float))


def _score(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for b in batches:
            x = np.array([features(t) for t in b.column("text").to_pylist()]).reshape(-1, len(NAMES))
            score = trees.score(x) if trees is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, held_out, score, predicted.

    Null and empty texts have all-zero statistics and are scored like any other; equal texts get equal scores;
    without a label to learn from every score is 0.5; a null doc_id is not held out; repeated rows stay
    repeated; an empty table gives an empty one. Other columns take no part.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label))
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string"))
    return map_batches(rows, _score(model, threshold), "doc_id long, held_out boolean, score double, predicted int")
