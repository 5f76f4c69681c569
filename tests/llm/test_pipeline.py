"""The pipeline's stages against plain versions, each on its own input."""

import hashlib

import corpus_pipeline
import public_tokenizers
import sentencepiece
from strandlake.llm import langid, simhash

from test_simhash import brute_components, slow_fingerprint
from test_substrings import brute as brute_cuts

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, out = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name != "encode":
            assert after.columns == columns
        out[name] = (docs.collect(), after.collect())
        docs = after

    before, after = out["language_id"]
    known = {r.doc_id: r for r in langid.identify(spark.read.parquet(f"{DIR}/documents.parquet")).collect()}
    stay = {r.doc_id for r in before if known[r.doc_id].lang_pred != "und" and known[r.doc_id].score >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    assert {r.doc_id for r in after} == stay and len(stay) > 0.95 * len(before)

    before, after = out["near_dedup"]
    ids = [r.doc_id for r in before]
    named = brute_components(ids, [slow_fingerprint(r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(set(named))

    before, after = out["substring_dedup"]
    want = {r[0]: r for r in brute_cuts([(r.doc_id, r.text) for r in before])}
    assert sorted(r.doc_id for r in after) == sorted(want)
    texts = {r.doc_id: r.text for r in before}
    for r in after:
        if want[r.doc_id][2] == 0:
            assert r.text == texts[r.doc_id]
        else:
            assert len(r.text.encode()) <= want[r.doc_id][1] - want[r.doc_id][2] and r.n_chars == len(r.text)

    before, after = out["mix_sources"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    words = sum(len(r.text.split()) for r in after)
    assert abs(words / sum(len(r.text.split()) for r in before) - 1) < 0.1

    before, after = out["encode"]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda ids: hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert sorted((r.doc_id, r.ids_sha256) for r in after) == sorted((r.doc_id, sha(lib.encode(r.text, add_eos=True))) for r in before)


def test_run(spark):
    assert corpus_pipeline.run(spark, DIR).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert simhash.MAX_BITS == 2
