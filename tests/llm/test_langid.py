from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import langid


def slow_features(text):
    data = (" " + text.lower() + " ").encode()
    data = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in data)
    counts = np.zeros(langid.DIMS)
    for i in range(len(data) - 1):
        two = data[i] << 8 | data[i + 1]
        if two != 0x2020:
            counts[(two * 2654435761 & 0xFFFFFFFF) >> 20] += 1
        if i + 2 < len(data) and two != 0x2020 and data[i + 1 : i + 3] != b"  ":
            counts[((two << 8 | data[i + 2]) * 2246822519 & 0xFFFFFFFF) >> 20] += 1
    return np.sqrt(counts / counts.sum())


@pytest.mark.parametrize("piece", [1 << 20, 7, 2])
def test_features(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    for t in ["a", "Ein Wörtchen, 12 3!", "é" * 50, "x " * 40, "日本 go\n\n"]:
        assert np.allclose(langid.features(t), slow_features(t), atol=1e-6)
    for t in [None, "", " 12 !?", "\n"]:
        assert langid.features(t) is None


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert set(got) == set(truth)
    assert all(r.held_out == (langid.fold(i) == 1) and 0 <= r.score <= 1 for i, r in got.items())
    mine = [got[i].lang_pred == lang for i, lang in truth.items() if got[i].held_out and lang]
    print("held-out accuracy", np.mean(mine))
    assert np.mean(mine) > 0.97
    assert langid.identified(docs).columns == docs.columns


def test_same_model_whatever_the_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert langid.checksum(langid.fit(docs)) == langid.checksum(langid.fit(docs.repartition(7)))


def test_families():
    assert langid.family("de") == langid.family("en-GB") != langid.family("fr")
    assert langid.family("xx") == "other:xx"


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score int, held_out string"
    assert langid.identify(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "hello there", "en", 1, ""), (2, None, "en", 1, ""), (2, None, "en", 1, ""), (None, "hello there", None, 1, ""), (4, "", "de", 1, ""), (5, "12 34", None, 1, "")]
    got = langid.identify(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and {r.lang_pred for r in got if r.doc_id in (2, 4, 5)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id in (1, None)} == {"en"} and not [r for r in got if r.doc_id is None][0].held_out
    nothing = langid.identify(spark.createDataFrame([(1, "hello", None, 1, "")], schema)).collect()
    assert (nothing[0].lang_pred, nothing[0].score) == ("und", 0.0)
    assert langid.identified(spark.createDataFrame(rows, schema)).count() == 2


def test_copies_do_not_thin_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "Model", lambda x, langs: Counter(langs))
    letters = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, F.concat(F.lit("word "), letters)).otherwise("a copy").alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    assert langid.fit(docs, per_language=50) == {"en": 50, "de": 50}


def slow_predict(model, x):
    """Family by the largest margin; inside it every pair of languages votes, one at a time."""
    x = np.append(x, 1.0)
    top = model.families[0]
    if model.tops is not None:
        top = max(zip(model.families, model.tops), key=lambda f: float(x @ f[1]))[0]
    members, pairs, machines = model.inside[top]
    votes, prob = Counter(), Counter()
    for (a, b), w in zip(pairs, machines):
        margin = float(x @ w)
        p = 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))
        votes[a if margin > 0 else b] += 1
        prob[a] += p
        prob[b] += 1 - p
    return members[max(range(len(members)), key=lambda i: (votes[i] + prob[i] / max(1, len(members) - 1) / len(members), -i))]


def test_predictions_against_one_text_at_a_time(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    for r in docs.collect():
        x = langid.features(r.text)
        assert got[r.doc_id] == ("und" if x is None else slow_predict(model, x))
