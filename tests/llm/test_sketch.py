import hashlib

import numpy as np
import pytest
import xxhash

from strandlake.llm import sketch


def slow_hashes(text):
    words = (text or "").encode().lower().split()
    shingles = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    return sorted(xxhash.xxh64_intdigest(s, 42) for s in shingles)


def slow_sketch(text):
    every = slow_hashes(text)
    return every[: max(16, sum(h < (1 << 64) // 8 for h in every))]


def slow_likeness(a, b):
    """Over the hashes that both sketches would hold."""
    bound = min([(1 << 64) // 8 - 1 if s[-1] < (1 << 64) // 8 else s[-1] for s in (slow_sketch(a), slow_sketch(b)) if len(s) >= 16], default=1 << 64)
    x, y = ({h for h in slow_hashes(t) if h <= bound} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def true_jaccard(a, b):
    def shingles(t):
        w = t.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (xxhash.xxh64_intdigest((r[1] or "").encode(), 42) + (1 << 63)) % (1 << 64)))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), slow_sketch(text), slow_sketch(edited), slow_likeness(text, edited), slow_likeness(text, after)))
    return out


def plain(rows):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, sketch.read(r.fingerprint).tolist(), sketch.read(r.edited_fingerprint).tolist(), r.near_edited, r.near_next) for r in rows), key=str)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert plain(sketch.compare_with_next(docs).collect()) == sorted(brute(rows), key=str)
    only = {r.doc_id: sketch.read(r.fingerprint).tolist() for r in sketch.fingerprints(docs).collect()}
    assert only == {i: slow_sketch(t) for i, t in rows}


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    off = []
    for _ in range(20):
        a = [words[i] for i in rng.integers(0, 4000, 3000)]
        b = a[: int(rng.integers(500, 3000))] + [words[i] for i in rng.integers(0, 4000, 1000)]
        x, y = " ".join(a), " ".join(b)
        off.append(sketch.likeness(sketch.Shingles(x).sketch(), sketch.Shingles(y).sketch()) - true_jaccard(x, y))
    assert abs(np.mean(off)) < 0.02 and np.abs(off).max() < 0.1
    small, large = sketch.Shingles(" ".join(words[:200])).sketch(), sketch.Shingles(" ".join(words)).sketch()
    assert sketch.containment(small, large) == 1.0
    assert np.array_equal(sketch.merge(small, large), large)


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_edges(spark, partitions):
    schema = "doc_id long, text string, at int, stretch string, halo int"
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert sketch.compare_with_next(spark.createDataFrame([], schema)).collect() == []
        for rows in ([(5, "one two three four five six seven")], [(1, "a b c d e f"), (1, "a b c d e f"), (1, "z"), (None, None), (None, "é" * 9), (7, ""), (-3, "\U0001f600 b c d e f g " * 400), (9, " \n")], [(2, "x y z")] * 5):
            df = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], schema)
            assert plain(sketch.compare_with_next(df).collect()) == sorted(brute(rows), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_short_texts_compare_exactly(spark):
    rows = [(i, t) for i, t in enumerate(["x y z", "é" * 9, "", " \n", "a b c d e f", "a b c d e g", "one two three four five six seven", *("to be or not to be %d" % k for k in range(30))])]
    got = {r.doc_id: r for r in sketch.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        after = rows[(i + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert got[i].near_edited == pytest.approx(true_jaccard(text, edited)) and got[i].near_next == pytest.approx(true_jaccard(text, after))
    assert got[0].near_next == 0.0 and got[2].near_next == 1.0


def test_merged_sketches_are_those_of_the_union():
    rng = np.random.default_rng(4)
    for n, m in ((3, 5), (3, 400), (20, 30), (400, 900)):
        a, b = rng.integers(0, 1 << 64, n, dtype=np.uint64), rng.integers(0, 1 << 64, m, dtype=np.uint64)
        assert np.array_equal(sketch.merge(sketch._sketched(a), sketch._sketched(b)), sketch._sketched(np.concatenate((a, b))))


def test_one_id_with_most_rows(spark):
    rows = [(None if i % 3 else i, f"text {i % 40} of many " * 5) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain(sketch.compare_with_next(df).collect()) == sorted(brute(rows), key=str)
    keyed = df.selectExpr("coalesce(doc_id, -9223372036854775808) AS at", "xxhash64(text) AS key")
    bounds = sketch._bounds(keyed, 8)
    at, key = (np.array(c) for c in zip(*[tuple(r) for r in keyed.collect()]))
    assert np.bincount(sketch._places(bounds, at, key)).max() < 200
