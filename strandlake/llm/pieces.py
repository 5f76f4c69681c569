"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the vocabulary continues past a whitespace marker, merges never cross the border before
one, so a text's ids are those of its marked words in turn, and its decoded text is that of its words. A
worker process keeps one table from marked word to ids and decoded text for all its tasks: a word is segmented
and decoded once by the library, and every text is put together by looking its words up in their order. The
table is bounded in bytes: words not met since half of it was filled make room.

The table belongs to a worker. One table for the whole corpus would be joined back by a shuffle of a row for
every word of it, which costs more than segmenting a word again in each worker. Models whose pieces do cross a
marker, or that change texts before segmenting, are detected when loaded and encoded text by text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from operator import itemgetter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import cache, map_batches

MARK = "▁"
#: Bytes of a worker's table, what an entry takes besides its strings, and words that are looked up at a time.
TABLE_BYTES, ENTRY_BYTES, SEGMENT = 96 << 20, 350, 1 << 16
#: Characters that a normaliser other than the identity would change.
PROBE = " a  ﬁÉéＡ　\t\r\n\x0b ​½ \U0001f600 "


class Encoder:
    """One worker's library handle and its table from marked word (without its first marker) to (number of ids,
    ids as decimals, decoded text)."""

    def __init__(self, proto: bytes, table_bytes: int = TABLE_BYTES):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.chunk = re.compile(f"{MARK}+[^{MARK}]*")
        self.half, self.young, self.old, self.held = table_bytes // 2, {}, {}, 0
        self.end, self.alone = self.lib.eos_id(), [self.lib.piece_to_id(MARK)]
        self.before, self.unknown = self.lib.encode("a"), self.lib.unk_id()
        pieces = (self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()))
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.chunked = not crossing and self.lib.normalize(PROBE) == MARK + PROBE.replace(" ", MARK)
        self.chunked = self.chunked and all(self.coded(t)[2] == self.lib.decode(self.lib.encode(t)) for t in (PROBE, " a", "  a b  ", "\U0001f600\x01 x"))

    def _make_room(self) -> None:
        if self.held > self.half:
            self.old, self.young, self.held = self.young, {}, 0

    def _learn(self, words: set[str]) -> None:
        """Take words into the table: from its older half, or from the library."""
        new = [w for w in words if w not in self.old]
        entries = {w: self.old[w] for w in words if w in self.old}
        # the library puts the first marker back as its prefix
        coded = [self.lib.encode(w) if w else self.alone for w in new]
        # pieces spell the word, byte pieces too; only where the unknown piece stands must the library say what it decodes to
        texts = [self.lib.decode(self.before + ids)[1:] if self.unknown in ids else " " + w.replace(MARK, " ") for w, ids in zip(new, coded)]
        entries.update((w, (len(ids), " ".join(map(str, ids)), text)) for w, ids, text in zip(new, coded, texts))
        self.held += sum(2 * len(w) + len(said) + 2 * len(text) + ENTRY_BYTES for w, (_, said, text) in entries.items())
        self.young.update(entries)

    def _words(self, text: str) -> list[str]:
        """The marked words of a text, each without its first marker."""
        words = text.replace(MARK, " ").split(" ")
        if "" not in words:
            return words
        return [c[1:] for c in self.chunk.findall(MARK + text.replace(" ", MARK))] if text else []

    def coded(self, text: str) -> tuple[int, str, str]:
        """Number of ids with the end id, the ids as decimals joined by one space, and the decoded text."""
        if not self.chunked:
            ids = self.lib.encode(text, add_eos=True)
            return len(ids), " ".join(map(str, ids)), self.lib.decode(ids)
        words, n, said, decoded = self._words(text), 1, [], []
        for at in range(0, len(words), SEGMENT):
            part = words[at : at + SEGMENT]
            hits = list(map(self.young.get, part))
            if None in hits:
                self._make_room()
                self._learn({word for word in part if word not in self.young})
                hits = list(map(self.young.get, part))
            n += sum(map(itemgetter(0), hits))
            said += map(itemgetter(1), hits)
            decoded += map(itemgetter(2), hits)
        said.append(str(self.end))
        return n, " ".join(said), "".join(decoded).removeprefix(" ")

    def ids(self, text: str) -> tuple[list[int], str]:
        said = self.coded(text)[1]
        return list(map(int, said.split(" "))), said


OWNER = "pieces"


def encoder_of(proto: bytes) -> Encoder:
    """The worker process's own encoder of a model; one model at a time keeps its table, until the process serves
    another operator."""
    name, encoders = hashlib.sha1(proto).digest(), cache(OWNER)
    if name not in encoders:
        encoders.clear()
        encoders[name] = Encoder(proto)
    return encoders[name]


def _encode(proto, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(proto.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                n, said, decoded = encoder.coded(text or "")
                out.append((n, list(map(int, said.split(" "))) if keep_ids else None, sha(said), sha(decoded)))
            n, ids, a, d = zip(*out) if out else ((), (), (), ())
            columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, model: str, keep_ids: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_tokens, ids_sha256, decoded_sha256 and, on
    request, ids themselves.

    ``model`` is a SentencePiece model file that the driver can read; its bytes go to the workers. A null text
    counts as empty, whose only id is the end id. A very long text is encoded whole. Repeated rows stay repeated,
    null ids stay null, an empty table gives an empty one, and columns besides doc_id and text are ignored.
    """
    proto = docs.sparkSession.sparkContext.broadcast(Path(model).read_bytes())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _encode(proto, keep_ids), schema, owner=OWNER)


def _decode(proto):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = encoder_of(proto.value).lib
        for b in batches:
            texts = [lib.decode(ids) if ids is not None else None for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids; null ids give a null text."""
    proto = encoded.sparkSession.sparkContext.broadcast(Path(model).read_bytes())
    return map_batches(encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")), _decode(proto), "doc_id long, text string", owner=OWNER)
