from collections import Counter

import numpy as np
import pytest
import xxhash

from strandlake.llm import simhash


def slow_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    bits = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        bits.update(i for i in range(64) if h >> i & 1)
    return sum(1 << i for i in range(64) if bits[i] * 2 > len(shingles))


def brute_components(ids, prints):
    """Smallest id reachable, by all pairs."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = d if r not in least or least[r] is None else least[r] if d is None else min(least[r], d)
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("text", [None, "", "  \t", "One", "a B", "A b C", "ß É x\x0by z w", "w " * 500 + "end"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def test_near_pairs_against_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (400, 2), dtype=np.uint64)
    fp = np.unique(base[rng.integers(0, 12, 400)] ^ flips[:, 0] ^ flips[:, 1])
    for node in (np.zeros(len(fp), np.int64), np.sort(rng.integers(0, 30, len(fp)))):
        order = np.lexsort((simhash.gray_rank(fp), node))
        i, j = simhash.near_pairs(fp[order], node[order])
        got = set(zip(i.tolist(), j.tolist()))
        want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if node[order][a] == node[order][b] and int(fp[order][a] ^ fp[order][b]).bit_count() <= 2}
        assert got == want and len(i) == len(got)


@pytest.mark.parametrize("split_at", [4096, 3])
def test_components(spark, split_at):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(25):
        text = [words[k] for k in rng.integers(0, 60, 120)]
        for _ in range(6):
            copy = list(text)
            if rng.random() < 0.8:
                copy[int(rng.integers(0, 120))] = "edit"
            rows.append(" ".join(copy))
    rows += [None, "", " ", "one", "One", "one two", rows[0], rows[0]]
    ids = list(range(100, 100 + len(rows)))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, rows)], "doc_id long, text string, fingerprint string, fp int")
    got = {r.doc_id: r for r in simhash.near_duplicates(df, split_at).collect()}
    prints = [slow_fingerprint(t) for t in rows]
    want = brute_components(ids, prints)
    assert [int(got[i].fingerprint, 16) for i in ids] == prints
    assert [got[i].component_id for i in ids] == want


def test_long_chain(spark):
    prints = [0]
    for k in range(40):
        prints.append(prints[-1] ^ (1 << k))
    df = spark.createDataFrame([(np.uint64(p).astype(np.int64).item(),) for p in prints], "fp long")
    from strandlake.llm.graph import components

    roots = components(simhash.links(df)).collect()
    assert len(roots) == 41 and {r.root for r in roots} == {0}


def test_empty_and_repeated(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s t u")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("1", "1"), ("1", "1"), ("None", "1"), ("None", "None")]


def test_representatives(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s t u"), (None, "q r s t u"), (2, None), (5, ""), (4, "something else again here")]
    df = spark.createDataFrame([(*r, "l", "s", 1) for r in rows], schema)
    out = simhash.representatives(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted([("1", "a b c d"), ("None", "q r s t u"), ("2", "None"), ("4", "something else again here")])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in simhash.representatives(docs).collect()}
    assert kept == {r.component_id for r in simhash.near_duplicates(docs).collect()}


def test_representatives_keep_clashing_columns(spark):
    names = ["_id", "_none", "_key", "id", "none", "key", "row", "fp", "one"]
    df = spark.createDataFrame([(3, "a b c d", *["x"] * 9), (1, "a b c d", *names), (2, "quite another text", *["z"] * 9)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    assert sorted(map(tuple, simhash.representatives(df).collect())) == [(1, "a b c d", *names), (2, "quite another text", *["z"] * 9)]
    assert simhash.representatives(df.where("false")).collect() == []


def test_hot_component(spark):
    """A star whose centre has most of the links: no aggregate directly below a join, so that it can be split."""
    from strandlake.llm import graph

    edges = spark.range(1, 2000).selectExpr("0L AS u", "id AS v")
    assert {r.root for r in graph.components(edges).collect()} == {0}
    plan = graph._large_star(graph.cut(edges))._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "HashAggregate" not in plan
