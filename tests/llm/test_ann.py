import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandlake.llm import ann


def naive(rows, every=20, k=20):
    """Plain loops over all pairs."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for i, q in good:
        if i % every == 0:
            best = sorted((-(q * c).sum(), j) for j, c in good if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 0.9), ("sf0.1", 0.9)])
def test_recall(spark, sf, least):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = ann.search(df).collect()
    want = ann.exact(df)
    truth = {(q, v): s for q, _, v, s in want}
    hit = [(r.query_id, r.vec_id) in truth for r in got]
    assert len(got) == len(want)
    assert all(abs(truth[r.query_id, r.vec_id] - r.score) < 1e-12 for r, h in zip(got, hit) if h)
    print(sf, "recall", np.mean(hit))
    assert np.mean(hit) >= least


def test_exact_scores_and_ties():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[50:250] = x[50]
    ids = rng.permutation(300)
    rows = list(zip(ids.tolist(), x.tolist()))
    i, found, score = ann.top(x, ids, x, ids, 20)
    place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
    got = sorted((int(ids[a]), int(p) + 1, int(b), s) for a, p, b, s in zip(i, place, found, score))
    want = naive(rows, every=1)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)


def test_parts_are_balanced_and_learned():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16)) * 4
    x = centres[rng.integers(0, 8, 2000)] + rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    part = ann.partition(x, 8)
    sizes = np.bincount(part, minlength=8)
    assert sizes.max() - sizes.min() <= 3
    router = ann.Router(x, part, 8)
    assert (router.order(x)[:, 0] == part).mean() > 0.8
    truth = ann.neighbours(x, 20)
    assert ann.probes(ann.Parts(router), x, np.repeat(np.arange(2000), 20), router.order(x)[:, 0][truth].ravel()) <= 4


def test_small_and_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, v string, part int"
    assert ann.search(spark.createDataFrame([], schema)).collect() == []
    rows = [(0, [1.0, 2.0]), (20, [0.5, -1.0]), (3, [1.0, 2.0]), (4, [0.0, 0.0]), (5, None), (40, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [3.0, 4.0]), (9, [1.0, 2.0]), (-20, [2.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows] + [(60, [1.0, 2.0, 3.0], 1, "x", 2), (3, [1.0, 2.0], 1, "x", 2)], schema)
    got = sorted(tuple(r) for r in ann.search(df).collect())
    want = naive([*rows, (3, [1.0, 2.0])])
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])


def test_hot_vector(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in ann.search(df).collect())
    want = {(q, r): (v, s) for q, r, v, s in ann.exact(df)}
    assert len(got) == len(want)
    same = [want[q, r][0] == v for q, r, v, _ in got if (q % 3) == 0]
    assert np.mean(same) > 0.95


def test_repeated_query_ids_take_no_places():
    rng = np.random.default_rng(7)
    near = rng.normal(size=8)
    # 0 with 30 equal rows, 20 with 30 rows that differ and score best, and equal and other candidates
    rows = [(0, near)] * 30 + [(20, near * (2 + k / 50)) for k in range(30)] + [(100 + k, near) for k in range(25)] + [(200 + k, rng.normal(size=8) * 0.1) for k in range(60)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    asked = np.array([near, near * 2])
    i, found, score = ann.top(asked, np.array([0, 20]), x, ids, 20)
    for a, q in enumerate((0, 20)):
        want = sorted((-(asked[a] * v).sum(), j) for j, v in rows if j != q)[:20]
        assert found[i == a].tolist() == [j for _, j in want]
        assert np.allclose(score[i == a], [-s for s, _ in want])


def vectors(spark, folder, n, dims=24, seed=5):
    """Clusters of clusters, n vectors, as a Parquet table and as a matrix."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 200, dims))
    x = centres[rng.integers(0, len(centres), n)] + 0.35 * rng.normal(size=(n, dims))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    flat = pa.array(x.ravel())
    table = pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.ListArray.from_arrays(pa.array(np.arange(0, n * dims + 1, dims), pa.int32()), flat)})
    pq.write_table(table, f"{folder}/v{n}.parquet", row_group_size=16_384)
    return spark.read.parquet(f"{folder}/v{n}.parquet"), x.astype(np.float64)


def measured_recall(found, x, queries=300):
    near = {}
    for r in found.where(f"query_id < {20 * queries}").collect():
        near.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.arange(0, 20 * queries, 20)
    truth = ann.neighbours(x, 20, asked)
    assert set(near) == set(asked.tolist()) and all(len(v) == 20 for v in near.values())
    return np.mean([len(near[q] & set(t)) / 20 for q, t in zip(asked.tolist(), truth.tolist())])


def shuffled(df, rows_a_part, most_top):
    left, right = ann.planned(df, 20, 20, ann.RECALL, rows_a_part, most_top)
    return left.count() + right.count()


def test_two_levels(spark, tmp_path):
    rows = {}
    for n in (10_000, 40_000):
        df, x = vectors(spark, tmp_path, n)
        rows[n] = shuffled(df, 256, 16)
        if n == 40_000:
            parts, _ = ann.fit(ann.usable(df), n, ann.RECALL, 256, 16)
            assert parts.low and parts.parts > 64
            found = ann.search(df, rows_a_part=256, most_top=16)
            assert found.count() == n
            assert measured_recall(found, x) >= 0.9
    assert np.log(rows[40_000] / rows[10_000]) / np.log(4) <= 1.2


def test_order_of_two_levels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    top = ann.Router(x, ann.partition(x, 4), 4)
    low = {p: ann.Router(x, ann.partition(x, 2, seed=p), 2) for p in (0, 2)}
    parts = ann.Parts(top, low)
    assert parts.parts == 6
    order = parts.order(x[:50])
    assert all(sorted(o[o >= 0]) == list(range(6)) for o in order)
    p_top = top.probable(x[:50])
    want = np.hstack([p_top[:, [0]] * low[0].probable(x[:50]), p_top[:, [1]], p_top[:, [2]] * low[2].probable(x[:50]), p_top[:, [3]]])
    assert np.array_equal(order[:, :6], np.argsort(-want, axis=1, kind="stable"))
