import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from strandlake.llm import substrings


def brute(rows, length=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[s : s + length] for _, d in data for s in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = True
        left = bytes(b for b, g in zip(d, gone) if not g)
        n_spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
        out.append((i, len(d), int(gone.sum()), n_spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def corpus(rng, n):
    word = lambda: "".join(rng.choice(list("abcdeé "), int(rng.integers(2, 9))))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(int(rng.integers(30, 90))) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.integers(0, 6)
        if kind == 0 and rows:
            t = rows[int(rng.integers(0, len(rows)))]
        elif kind == 1 and rows:
            old = rows[int(rng.integers(0, len(rows)))]
            k = int(rng.integers(0, len(old) + 1))
            t = old[:k] + "X" + old[k + 1 :]
        elif kind == 2:
            t = text(int(rng.integers(1, 40))) + shared[int(rng.integers(0, 6))] + text(int(rng.integers(1, 40)))
        elif kind == 3:
            s = shared[int(rng.integers(0, 6))]
            k = int(rng.integers(0, len(s)))
            t = text(20) + s[k:] + s[: k + 40] + text(3)
        else:
            t = text(int(rng.integers(1, 120)))
        rows.append(t)
    return rows


@pytest.mark.parametrize("hot_spans", [2000, 2])
def test_against_brute_force(spark, hot_spans):
    rows = list(enumerate(corpus(np.random.default_rng(5), 150)))
    rows += [(900, "a" * 199), (901, "b" * 200), (902, "b" * 201), (903, "c" * 1000), (904, "ab" * 300), (905, "x" * 150 + "b" * 250), (906, "é" * 120), (907, "")]
    df = spark.createDataFrame([(i, t, "s", 1, "b") for i, t in rows], "doc_id long, text string, bytes string, n int, cuts string")
    got = sorted(map(tuple, substrings.report(df, hot_spans).collect()), key=str)
    assert got == brute(rows)


def test_large_bucket_and_pieces(spark, monkeypatch):
    rng = np.random.default_rng(6)
    passage = "".join(rng.choice(list("abcdefgh "), 260))
    rows = [(i, "".join(rng.choice(list("ijklmnop "), int(rng.integers(5, 300)))) + passage + "".join(rng.choice(list("qrstuvw "), 200))) for i in range(60)]
    rows.append((61, "".join(rng.choice(list("xyz "), 150_000)) + passage))  # longer than a piece
    rows.append((62, rows[-1][1][60_000:140_000]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sorted(map(tuple, substrings.report(df, 20).collect()), key=str) == want
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 1)
    assert sorted(map(tuple, substrings.report(df).collect()), key=str) == want


def test_suffix_ranks_sort_like_bytes():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 3, 600, dtype=np.uint8)
    text = np.concatenate([base, np.zeros(40, np.uint8), base, rng.integers(0, 3, 500, dtype=np.uint8)])
    starts = np.arange(0, len(text) - 200)
    starts = starts[starts % 64 == 5]
    order = substrings.suffix_ranks(text, starts)
    want = [text[s : s + 200].tobytes() for s in starts]
    assert [want[i] for i in np.argsort(order.rank, kind="stable")] == sorted(want)
    counts = Counter(want)
    assert set(order.tied.tolist()) == {i for i, w in enumerate(want) if counts[w] > 1}


def test_difference_cover():
    for period in (7, 64, 100):
        d = substrings.difference_cover(period)
        assert {(a - b) % period for a in d for b in d} == set(range(period)) and len(d) < 3 * period**0.5


def test_edges(spark):
    schema = "doc_id long, text string, lang string, n_chars long"
    assert substrings.report(spark.createDataFrame([], schema)).collect() == []
    assert substrings.deduplicated(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, None), (1, "e" + "é" * 150), (1, "e" + "é" * 150), (2, "x" + "é" * 150 + "y"), (3, "keep")]
    df = spark.createDataFrame([(i, t, "l", 9) for i, t in rows], schema)
    assert sorted(map(tuple, substrings.report(df).collect()), key=str) == brute(rows)
    out = substrings.deduplicated(df)
    assert out.columns == df.columns
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(None, None, "l", None), (1, "", "l", 0), (1, "", "l", 0), (2, "xy", "l", 2), (3, "keep", "l", 4)], key=str)


def test_split_spans_keep_every_start_and_bring_equal_strings_together():
    rng = np.random.default_rng(9)
    for width in (69, 35, 18, 9, 5, 3, 2, 1):
        base = rng.integers(97, 100, 400, dtype=np.uint8).tobytes()
        spans = []
        for lead, n in ((136, 137), (100, 60), (40, 41), (7, 3), (0, 1)):
            spans.append((1, 1000, n, lead, base[136 - lead : 136 - lead + n - 1 + 200]))
        seen = {}
        for anchor, start, n, lead, piece in spans:
            parts = substrings.split_span(anchor, start, n, lead, piece, width)
            assert sorted(s + i for _, _, s, m, _, _ in parts for i in range(m)) == list(range(start, start + n))
            for a, _, s, m, far, part in parts:
                assert len(part) == m - 1 + 200
                for i in range(m):
                    seen.setdefault((far - i, part[i : i + 200]), set()).add(a)
        assert all(len(v) == 1 for v in seen.values())


def test_clashing_columns_stay(spark):
    names = ["bytes", "t1", "t2", "row", "none", "cuts", "anchor", "salt", "new_text"]
    df = spark.createDataFrame([(1, "x" * 300, *names), (2, "some text", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    assert sorted(map(tuple, substrings.deduplicated(df).collect())) == [(1, "", *names), (2, "some text", *names)]


def test_periodic_texts(spark):
    """Strings whose ends agree while the change from one period to the next lies elsewhere are not equal."""
    words = ["Des. ", "Sur, ", "le\u00e9 ", "of ", "ing ", "heti ", "\u00e7 "]
    rng = np.random.default_rng(3)
    texts = ["".join(w * int(rng.integers(20, 60)) for w in rng.permutation(words)) for _ in range(40)]
    texts += ["Des. " * 40 + "Sur, " * 40, "Nd, " * 34 + "ing " * 34]
    rows = list(enumerate(texts))
    got = sorted(map(tuple, substrings.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_ranks_take_little_besides_the_text():
    """No number for each byte of a block: only starts and samples have some."""
    text = np.random.default_rng(5).integers(97, 123, 1 << 20, dtype=np.uint8)
    text[1 << 19 : (1 << 19) + 300] = text[:300]
    starts = np.array([0, 10, 64, 1000, 1 << 19, (1 << 19) + 64, (1 << 20) - 200])
    tracemalloc.start()
    try:
        order = substrings.suffix_ranks(text, starts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(order.tied.tolist()) == [0, 2, 4, 5] and order.rank[0] == order.rank[4] and order.rank[2] == order.rank[5]
    assert peak < 4 * len(text)
