import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from strandlake.llm import pieces
from strandlake.llm.common import map_batches

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "   ", "a", " a", "a ", "a  b", "▁a ▁▁b", "Zwei Wörter.\nNeue\t\tZeile ", "\n \n", "\r\n\x00x", "日本語 テキスト \U0001f600", "<s> </s> <unk> <0x0A>", "é é ﬁ　x", "word " * 3000, "x" * 5000, "1 2  3   4    5     " * 9]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("table_bytes", [1 << 28, 2000])
def test_ids_are_the_librarys(library, table_bytes):
    encoder = pieces.Encoder(open(MODEL, "rb").read(), table_bytes)
    assert encoder.chunked
    rng = random.Random(1)
    parts = [*" ▁aé日\U0001f600\n\t\x00<s>0", "  ", "word", "</s>", "<0x0A>", " ⁇ ", "　"]
    for t in TEXTS + ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]:
        ids, said = encoder.ids(t)
        assert encoder.coded(t)[2] == library.decode(ids), repr(t[:40])
        assert ids == library.encode(t, add_eos=True), repr(t[:40])
        assert said == " ".join(map(str, ids))
    encoder.chunked = False
    assert encoder.ids("a  b")[0] == library.encode("a  b", add_eos=True)


def test_the_table_is_bounded(library):
    encoder = pieces.Encoder(open(MODEL, "rb").read(), 1 << 20)
    for k in range(300):
        encoder.coded(" ".join(f"w{k}x{i}" for i in range(200)))
        assert encoder.held < (1 << 19) + 200 * 500 and len(encoder.old) + len(encoder.young) < 4000


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in pieces.encode(docs, MODEL, keep_ids=True).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_eos=True)
        sha = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        text = hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), sha, text)
        assert got[r.doc_id].ids == ids
    back = pieces.decode(pieces.encode(docs, MODEL, keep_ids=True), MODEL)
    assert back.count() == docs.count()


def test_a_worker_that_serves_another_operator_lets_go_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(8)
    pieces.encode(docs, MODEL).collect()

    def alive(batches):
        import gc

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(type(o) is pieces.Encoder for o in gc.get_objects())], pa.int64())], ["n"])

    got = map_batches(spark.range(800, numPartitions=8), alive, "n long").collect()
    assert len(got) >= 8 and {r.n for r in got} == {0}


def test_edges(spark):
    schema = "doc_id long, text string, ids string, n_tokens int"
    assert pieces.encode(spark.createDataFrame([], schema), MODEL).collect() == []
    got = pieces.encode(spark.createDataFrame([(None, None, "x", 1), (3, "", "x", 1), (3, "", "x", 1)], schema), MODEL).collect()
    assert [r.n_tokens for r in got] == [1, 1, 1] and {r.decoded_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
