"""One very long text through every operator on documents, next to short ones."""

import numpy as np
import public_tokenizers
import pytest

from strandlake.llm import langid, licenses, mixing, pieces, quality, simhash, sketch, substrings

WORDS = 300_000


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    words = np.array([f"wort{i}" for i in range(5000)])
    text = " ".join(words[rng.integers(0, 5000, WORDS)]) + " Released under the MIT License."
    rows = [(0, text, "de", "s", len(text)), (1, "kurz und gut", "de", "s", 12), (2, "x" * 500_000, "en", "t", 500_000), (3, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()


def test_all(spark, docs):
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    assert simhash.near_duplicates(docs).count() == 4
    assert langid.identify(docs).count() == 4
    assert quality.scores(docs, labels).count() == 4
    assert {r.doc_id: r.license for r in licenses.scan(docs).collect()} == {0: "MIT", 1: None, 2: None, 3: None}
    removed = {r.doc_id: (r.n_bytes, r.n_removed) for r in substrings.report(docs).collect()}
    assert removed[2] == (500_000, 500_000) and removed[0][1] == 0 and removed[3] == (0, 0)
    near = {r.doc_id: r for r in sketch.compare_with_next(docs).collect()}
    assert near[0].n_chars > 2_000_000 and 0.5 < near[0].in_edited < 1
    assert {r.doc_id: r["size"] for r in mixing.mix(docs).collect()} == {0: WORDS + 5, 1: 3, 2: 1, 3: 0}
    tokens = {r.doc_id: r.n_tokens for r in pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert tokens[0] > WORDS and tokens[3] == 1
