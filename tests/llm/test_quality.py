import numpy as np

from strandlake.llm import quality


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def walk(trees, x):
    """One row through every tree, one node at a time."""
    total = trees.base
    for node in trees.roots:
        while trees.left[node] != node:
            node = trees.right[node] if x[trees.feature[node]] > trees.limit[node] else trees.left[node]
        total += trees.value[node]
    return 1 / (1 + np.exp(-total))


def test_flat_trees_against_walking():
    rng = np.random.default_rng(0)
    x = np.hstack([rng.normal(size=(600, 4)), rng.integers(0, 3, (600, 1)).astype(float), np.zeros((600, 1))])
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 4] == 2)).astype(float)
    trees = quality.Trees(x, y)
    assert np.allclose(trees.score(x[:50]), [walk(trees, r) for r in x[:50]])
    assert ((trees.score(x) >= 0.5) == (y > 0)).mean() > 0.95


def test_held_out(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    docs, labels = read("documents"), read("labels")
    got = {r.doc_id: r for r in quality.scores(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    known = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    score, label = np.array([g.score for g, _ in known]), np.array([q for _, q in known])
    print("held out:", len(known), "AUC", auc(score, label), "accuracy", ((score >= 0.7) == (label == 1)).mean())
    assert auc(score, label) > 0.9


def test_edges(spark):
    schema = "doc_id long, text string, quality int, label int, x string"
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 1)], "doc_id long, quality int")
    assert quality.scores(spark.createDataFrame([], schema), labels).collect() == []
    docs = spark.createDataFrame([(1, "good text here", 1, 1, ""), (2, None, 1, 1, ""), (2, "", 1, 1, ""), (None, "good text here", 1, 1, "")], schema)
    got = quality.scores(docs, labels).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id == 2}) == 1
    none = quality.scores(docs, labels.where("false")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 0)}
    assert quality.features(None) == quality.features("") and len(quality.features("a b\n" * 50_000)) == len(quality.NAMES)


def test_repeated_ids_do_not_widen_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(4, "other words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "Trees", lambda x, y: seen.append(len(x)))
    quality.fit(docs, labels)
    assert seen == [2]


def slow_split(x, y, grad, hess, edges):
    """The best gain over every feature and edge, by loops."""
    best = (1e-6, None)
    for f, limits in enumerate(edges):
        for limit in limits:
            left = x[:, f] <= limit
            if min(left.sum(), (~left).sum()) >= quality.LEAF:
                part = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + quality.L2)
                gain = part(left) + part(~left) - part(np.ones(len(x), bool))
                if gain > best[0] + 1e-9:
                    best = (gain, (f, limit))
    return best[1]


def test_first_split_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(5):
        x = np.round(rng.normal(size=(300, 5)), 2)
        y = (x[:, rng.integers(0, 5)] + 0.3 * rng.normal(size=300) > rng.normal() / 2).astype(float)
        trees = quality.Trees(x, y)
        p = y.mean()
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for f in range(5)]
        assert (trees.feature[0], trees.limit[0]) == slow_split(x, y, p - y, np.full(300, p * (1 - p)), edges)
        margin = np.full(300, np.log(p / (1 - p)))
        losses = []
        for k in range(0, quality.TREES, 30):  # boosting lowers the loss on what it learns from
            part = trees.value[: trees.roots[k + 1] if k + 1 < len(trees.roots) else None]
            losses.append(len(part))
        assert losses == sorted(losses) and np.mean((trees.score(x) >= 0.5) == (y > 0)) > np.mean((margin > 0) == (y > 0))
