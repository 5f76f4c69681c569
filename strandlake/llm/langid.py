"""Language identification by hierarchical discrimination.

A text becomes a histogram of hashed letter bigrams and trigrams of all of it. One linear support vector
machine per family picks the family first; inside it, one machine per pair of languages votes. All are fitted
on the driver from a bounded sample of labelled rows; what goes to the workers is a few small matrices.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import map_batches

DIMS, PIECE = 4096, 1 << 20
#: Labelled rows to learn from: so many of each language, and so many in all.
PER_LANGUAGE, IN_ALL = 400, 8000
UNKNOWN, _SHARES = "und", 1 << 30
#: Language families by ISO 639-1 code. Codes not listed are families of their own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "indo-aryan": "bn gu hi mr ne pa sd si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"other:{lang}")


#: ASCII bytes that are no letters become one kind of space; all bytes of other letters stay.
_FOLD = np.array([i if i >= 0x80 or chr(i).isalpha() else 0x20 for i in range(256)], np.uint32)


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of square-rooted n-gram counts over the whole text; None if it has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    data = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)
    counts = np.zeros(DIMS)
    for at in range(0, len(data), PIECE):  # pieces overlap by two bytes, so that no n-gram is lost
        x = _FOLD[data[at : at + PIECE + 2]]
        if len(x) < 2:
            break
        two = (x[:-1] << 8) | x[1:]
        three = (two[:-1] << 8) | x[2:]
        two = two[: min(len(two), PIECE)]
        # spaces next to spaces say nothing about a language
        counts += np.bincount((two[two != 0x2020] * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)
        counts += np.bincount((three[(three & 0xFFFF != 0x2020) & (three >> 8 != 0x2020)] * np.uint32(2246822519)) >> np.uint32(20), minlength=DIMS)
    norm = np.sqrt(counts.sum())
    return (np.sqrt(counts) / norm).astype(np.float32) if norm else None


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 120) -> np.ndarray:
    """Weights (with the bias last) of a linear machine with squared hinge loss, by accelerated gradients.

    y holds 1 and -1; both classes weigh the same in sum.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    c = np.where(y > 0, cost / max(1, (y > 0).sum()), cost / max(1, (y < 0).sum())).astype(np.float32)
    w = back = np.zeros(x.shape[1], np.float32)
    rate = 1.0 / (1.0 + 2 * 2 * cost * 2)  # rows have norm sqrt(2) with the bias
    for k in range(rounds):
        z = w + (k / (k + 3)) * (w - back)
        slack = np.maximum(0, 1 - y * (x @ z))
        back, w = w, z - rate * (z - 2 * ((c * slack * y) @ x))
    return w


class Model:
    """Machines for families and, inside each, for pairs of languages."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family(v) for v in self.langs})
        own = np.array([family(v) for v in langs])
        lang = np.array(langs)
        one = lambda rows, yes: svm(x[rows], np.where(yes[rows], 1.0, -1.0).astype(np.float32))
        every = np.ones(len(lang), bool)
        self.tops = np.array([one(every, own == f) for f in self.families]) if len(self.families) > 1 else None
        self.inside = {}
        for f in self.families:
            members = [v for v in self.langs if family(v) == f]
            pairs = list(combinations(range(len(members)), 2))
            machines = np.array([one((lang == members[a]) | (lang == members[b]), lang == members[a]) for a, b in pairs])
            self.inside[f] = (members, pairs, machines)

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """(language, score) for each row: family first, then the votes within it, ties by margin and code."""
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
        if self.tops is None:
            top, p_top = np.zeros(len(x), int), np.ones(len(x))
        else:
            margins = np.clip(x @ self.tops.T, -20, 20)
            top = margins.argmax(1)
            e = np.exp(4 * (margins - margins.max(1, keepdims=True)))
            p_top = 1 / e.sum(1)
        out = [("", 0.0)] * len(x)
        for k, f in enumerate(self.families):
            members, pairs, machines = self.inside[f]
            rows = np.flatnonzero(top == k)
            if not len(rows):
                continue
            votes, prob = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            if pairs:
                m = x[rows] @ machines.T
                for (a, b), margin in zip(pairs, m.T):
                    p = sure(margin)
                    votes[:, a] += margin > 0
                    votes[:, b] += margin <= 0
                    prob[:, a] += p
                    prob[:, b] += 1 - p
                prob /= len(members) - 1
            else:
                prob += 1
            best = (votes + prob / len(members)).argmax(1)
            for i, r in enumerate(rows):
                out[r] = (members[best[i]], float(min(1.0, max(0.0, p_top[r] * prob[i, best[i]]))))
        return out


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning; a null id counts as 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("0"))) % 3 == 1


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [(lang, v) for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()) if (v := features(t)) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1].astype(np.float16).tobytes() for m in made], pa.binary())], ["lang", "x"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> Model | None:
    """Learn from the rows with a language that are not held out: of each language ``per_language`` different
    texts picked by their hashes, ``in_all`` at most. None if there is nothing to learn from."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    keys = rows.select("lang", F.xxhash64("text").alias("key"))
    # a hash share of each language's different texts, twice what is wanted, leaves few to rank however many tasks
    # there are; copies share a hash and pass or fail together, so they must count once here too
    counts = keys.distinct().groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(in_all).collect()
    if not counts:
        return None
    most = min(per_language, max(1, in_all // len(counts)))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r.lang, min(_SHARES, 2 * most * _SHARES // r.n + 1))])
    keys = keys.where(F.pmod("key", F.lit(_SHARES)) < share[F.col("lang")]).distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    picked = keys.withColumn("n", first).where(F.col("n") <= most).select("lang", "key").collect()
    if not picked:
        return None
    chosen = rows.sparkSession.createDataFrame([tuple(r) for r in picked], "lang string, key long")
    sample = rows.withColumn("key", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "key"])  # in_all rows at most
    sample = sample.dropDuplicates(["lang", "key"]).select("lang", "text")
    got = sorted((r.lang, bytes(r.x)) for r in map_batches(sample, _vectors, "lang string, x binary").collect())
    if not got:
        return None
    x = np.stack([np.frombuffer(v, np.float16) for _, v in got]).astype(np.float32)
    return Model(x, [lang for lang, _ in got])


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            vectors = [features(t) for t in b.column("text").to_pylist()]
            known = [i for i, v in enumerate(vectors) if v is not None and m is not None]
            out = [(UNKNOWN, 0.0)] * len(vectors)
            if known:
                for i, said in zip(known, m.predict(np.stack([vectors[i] for i in known]))):
                    out[i] = said
            extra = [b.column(c) for c in b.schema.names if c != "text"]
            names = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*extra, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], [*names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, ...): doc_id, held_out, lang_pred, score.

    lang_pred is ``und`` with score 0 where the text is null or has no letter, or if no row can be learned
    from. Equal texts get equal predictions; repeated rows stay repeated; a null doc_id is not held out; an
    empty table gives an empty one. Other columns take no part.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string"))
    return map_batches(rows, _predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def _keep(model, least: float):
    predict = _predict(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = next(predict(iter([b.select(["text"])])))
            keep = [lang != UNKNOWN and score >= least for lang, score in zip(said.column("lang_pred").to_pylist(), said.column("score").to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def identified(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with a score of at least ``least``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    return map_batches(docs, _keep(model, least), docs.schema)


def fold(doc_id: int, n: int = 3) -> int:
    """The remainder that held_out goes by."""
    return zlib.crc32(str(doc_id).encode()) % n


def checksum(model: Model) -> str:
    """Names a fitted model, to compare two fits."""
    parts = [model.tops.tobytes() if model.tops is not None else b"", *(m[2].tobytes() for m in model.inside.values())]
    return hashlib.sha256(b"".join(parts)).hexdigest()
