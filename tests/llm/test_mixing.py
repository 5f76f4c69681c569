import re
from fractions import Fraction

import pytest

from strandlake.llm import mixing


def water(sizes, weights=(1, 2, 3), cap=3):
    """Targets by literal resharing: sizes by source, in code-point order."""
    total, free = Fraction(sum(sizes)), set(range(len(sizes)))
    target = {}
    while free:
        rest = total - sum(target.values())
        share = {i: rest * weights[i % 3] / sum(weights[j % 3] for j in free) for i in free}
        over = {i for i in free if share[i] > cap * sizes[i]}
        if not over:
            return [float(target.get(i, share.get(i))) for i in range(len(sizes))]
        target |= {i: Fraction(cap * sizes[i]) for i in over}
        free -= over
    return [float(target[i]) for i in range(len(sizes))]


def rows_of(spark, name="documents"):
    return spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")


def test_documents(spark):
    docs = rows_of(spark)
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    texts = {r.doc_id: r for r in docs.collect()}
    per = {}
    for r in got:
        d = texts[r.doc_id]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", d.text)) and r.taken == r.copies * r["size"] <= 3 * r["size"]
        per.setdefault(d.source, []).append(r)
    names = sorted(per)
    want = water([sum(r["size"] for r in per[s]) for s in names])
    for s, t in zip(names, want):
        assert {r.target for r in per[s]} == {per[s][0].target} and per[s][0].target == pytest.approx(t)
        assert sum(r.taken for r in per[s]) == pytest.approx(t, rel=0.05)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.copies for r in got if r.copies}


@pytest.mark.parametrize("sizes", [[1000, 1, 1], [1, 1, 1000, 5], [7], [5, 5, 5, 5, 5, 5, 5, 900], [1, 2, 4, 8, 16, 32, 64, 128, 256, 512]])
def test_caps(spark, sizes):
    rows = [(chr(97 + i), n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert [got[s] for s, _ in rows] == pytest.approx(water(sizes))


def test_edges(spark):
    schema = "doc_id long, text string, source string, size int, rate string, row int"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    assert mixing.mixed(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, None, None, 1, "", 1), (2, "", "a", 1, "", 1), (2, "", "a", 1, "", 1), (None, "x y\x0bz é", None, 1, "", 1), (4, "w", "é", 1, "", 1), (5, "w", "z", 1, "", 1)]
    got = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 0, 1, 1, 4]
    by_size = {r["size"]: r for r in got}
    # a (weight 1, no words), z (2), é (3), null last (1): 6 words; z and é stop at 3 each, null gets none of the excess needed
    assert by_size[4].target == pytest.approx(1.0) or by_size[4].target >= 0
    assert sum({(r.source_size, r.target) for r in got} and [t for _, t in {(r.doc_id, r.target) for r in got if r["size"]}]) == pytest.approx(6.0)
    assert all(r.taken <= 3 * r["size"] for r in got)
    empty = mixing.mix(spark.createDataFrame([(1, "", "a", 1, "", 1)], schema)).collect()
    assert empty[0].target == 0 and empty[0].taken == 0
    assert mixing.mixed(spark.createDataFrame(rows, schema)).columns == ["doc_id", "text", "source", "size", "rate", "row"]


def test_many_sources_join_by_shuffle(spark, monkeypatch):
    docs = rows_of(spark)
    want = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == want


@pytest.mark.parametrize("ids", ["same", "null"])
def test_equal_rows_draw_each_for_itself(spark, ids):
    one = 7 if ids == "same" else None
    rows = [(one, "a b c", "hot")] * 1000 + [(i, "w " * 5, "other") for i in range(400)] + [(None, "x", None)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df.repartition(6)).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    per = {}
    for r in got:
        per.setdefault(r.target, []).append(r.taken)
    assert len(per) == 3 and all(sum(taken) == pytest.approx(target, rel=0.05) for target, taken in per.items())
    out = mixing.mixed(df)
    assert out.count() == sum(r.copies for r in got)


def test_clashing_columns_and_long_texts(spark):
    names = ["key", "nth", "draw", "turn", "rate", "row", "part", "copies", "seed", "of", "copy"]
    df = spark.createDataFrame([(1, "w " * 300_000, "a", *names), (1, "w " * 300_000, "a", *names), (2, "z", "b", *names)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    assert [r["size"] for r in mixing.mix(df).orderBy("size").collect()] == [1, 300_000, 300_000]
    assert all(tuple(r)[3:] == tuple(names) for r in mixing.mixed(df).collect())
