"""Record transforms: projections over single reads, without a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.batches import by_pieces, flat
from strandlake.functions.scalars import BASES


def n_transfer(reads: DataFrame) -> DataFrame:
    """Take every N out of ``seq`` and keep its 1-based positions in ``n_pos``."""
    where = F.expr("filter(transform(split(seq, ''), (c, i) -> if(c = 'N', i + 1, 0)), p -> p > 0)")
    return reads.withColumns({"n_pos": F.when(F.contains("seq", F.lit("N")), where).otherwise(F.array().cast("array<int>")), "seq": F.replace("seq", F.lit("N"), F.lit(""))})


def n_restore(reads: DataFrame) -> DataFrame:
    """Inverse of ``n_transfer``: the pieces of ``seq`` between the positions, joined by N."""
    pieces = F.expr(
        """transform(sequence(0, size(n_pos)), k -> substring(seq,
               if(k = 0, 1, element_at(n_pos, k) - k + 1),
               if(k = size(n_pos), length(seq), element_at(n_pos, k + 1) - k - 1) - if(k = 0, 0, element_at(n_pos, k) - k)))"""
    )
    return reads.withColumn("seq", F.when(F.size("n_pos") > 0, F.array_join(pieces, "N")).otherwise(F.col("seq"))).drop("n_pos")


def plus_flags(reads: DataFrame) -> DataFrame:
    """Whether the plus line is bare."""
    return reads.withColumn("plus_only", F.length("plus") == 1)


def plus_store(reads: DataFrame) -> DataFrame:
    """Keep of the plus line only what the title does not tell: null where it can be rebuilt."""
    rebuilt = F.when(F.col("plus_only"), F.lit("+")).otherwise(F.concat(F.lit("+"), F.expr("substring(title, 2)")))
    return plus_flags(reads).withColumn("plus_text", F.when(F.col("plus") != rebuilt, F.col("plus"))).drop("plus")


def plus_rebuild(stored: DataFrame) -> DataFrame:
    made = F.when(F.col("plus_only"), F.lit("+")).otherwise(F.concat(F.lit("+"), F.expr("substring(title, 2)")))
    return stored.withColumn("plus", F.coalesce("plus_text", made)).drop("plus_text", "plus_only")


_LETTERS = np.frombuffer(BASES.encode(), np.uint8)
_CODE, _BASE, _COLOR = np.zeros(256, np.uint8), np.zeros(256, bool), np.zeros(256, bool)
for _k, _c in enumerate(BASES):
    _CODE[[ord(_c), ord(str(_k))]] = _k
    _BASE[ord(_c)], _COLOR[ord(str(_k))] = True, True


class _Texts:
    """A column of an Arrow batch, or of a piece of one, as one run of bytes; all rows are worked on at once."""

    def __init__(self, column: pa.Array):
        self.valid = column.is_valid()
        self.data, self.at = flat(column)
        self.size = np.diff(self.at)
        self.row = np.repeat(np.arange(len(column)), self.size)

    def made(self, data: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
        """Rows of new sizes; null where the column was."""
        at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data, np.uint8))])
        return pc.if_else(self.valid, out.cast(kind), pa.scalar(None, kind))


def color_encode(reads: DataFrame, start: str | Column = "T", start_quality: str | Column = "!") -> DataFrame:
    """Bases to colors: each color is the XOR of a base's code and that of the base before it, after a start symbol.

    Other letters than A, C, G and T stay as they are, and colors go on across them; a digit is an error. The
    start symbols may be columns.
    """

    def colors(seq: pa.Array, first: pa.Array) -> pa.Array:
        t, head = _Texts(seq), _Texts(first).data
        if _COLOR[t.data].any():
            raise ValueError("a sequence holds colors already")
        base, code, here = _BASE[t.data], _CODE[t.data], np.arange(len(t.data))
        last = np.concatenate(([-1], np.maximum.accumulate(np.where(base, here, -1))[:-1])) if len(here) else here
        before = np.where(last >= t.at[t.row], code[last], _CODE[head[t.row]])
        out = np.zeros(len(t.data) + len(t.size), np.uint8)
        out[t.at[:-1] + np.arange(len(t.size))] = head
        out[here + t.row + 1] = np.where(base, (code ^ before) + ord("0"), t.data)
        return t.made(out, t.size + 1, pa.string())

    start, start_quality = (F.lit(c) if isinstance(c, str) else c for c in (start, start_quality))
    return reads.withColumns({"seq": F.arrow_udf(by_pieces(colors), "string")("seq", start), "quality": F.concat(start_quality, "quality")})


def color_decode(reads: DataFrame) -> DataFrame:
    """Colors to bases by a running XOR from the start symbol, which goes with its quality."""

    def bases(seq: pa.Array) -> pa.Array:
        t = _Texts(seq)
        head = np.zeros(len(t.data), bool)
        head[t.at[:-1][t.size > 0]] = True
        color = _COLOR[t.data] & ~head
        total = np.bitwise_xor.accumulate(np.where(color | head, _CODE[t.data], 0)) if len(t.data) else t.data
        earlier = np.concatenate(([0], total))[t.at[:-1]].astype(np.uint8)  # what the rows before have summed to
        out = np.where(color, _LETTERS[total ^ earlier[t.row]], t.data)
        return t.made(out[~head], np.maximum(t.size - 1, 0), pa.string())

    return reads.withColumns({"seq": F.arrow_udf(by_pieces(bases), "string")("seq"), "quality": F.expr("substring(quality, 2)")})


_OTHERS = "array<struct<pos: int, byte: int>>"


def pack_bases(reads: DataFrame) -> DataFrame:
    """Four bases of A, C, G, T to a byte, the first in the highest bits: ``packed`` BINARY, ``n_bases``, and in
    ``others`` the place (from 0) and byte of what is none of the four, which is packed as A."""

    def pack(seq: pa.Array) -> pa.Array:
        t = _Texts(seq)
        sizes = -(-t.size // 4)
        base = np.concatenate(([0], np.cumsum(sizes)))[:-1] * 4
        four = np.zeros(4 * int(sizes.sum()), np.uint8)
        place = np.arange(len(t.data)) - t.at[t.row]
        four[base[t.row] + place] = np.where(_BASE[t.data], _CODE[t.data], 0)
        four = four.reshape(-1, 4)
        packed = t.made(four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3], sizes, pa.binary())
        odd = np.flatnonzero(~_BASE[t.data])
        ends = np.searchsorted(odd, t.at).astype(np.int32)
        each = pa.StructArray.from_arrays([pa.array(place[odd].astype(np.int32)), pa.array(t.data[odd].astype(np.int32))], ["pos", "byte"])
        return pa.StructArray.from_arrays([packed, pa.ListArray.from_arrays(pa.array(ends), each)], ["packed", "others"])

    made = F.arrow_udf(by_pieces(pack), f"struct<packed: binary, others: {_OTHERS}>")("seq")
    return reads.withColumns({"made": made, "n_bases": F.octet_length("seq")}).withColumns({"packed": F.col("made.packed"), "others": F.col("made.others")}).drop("made")


def unpack_bases(packed: DataFrame) -> DataFrame:
    """Inverse of ``pack_bases``, from packed, n_bases and others."""

    def unpack(data: pa.Array, n: pa.Array, others: pa.Array) -> pa.Array:
        t = _Texts(data)
        sizes = n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        every = _LETTERS[np.stack([t.data >> 6, t.data >> 4 & 3, t.data >> 2 & 3, t.data & 3], 1).ravel()]
        begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        out = every[np.repeat(4 * t.at[:-1] - begin, sizes) + np.arange(sizes.sum())].copy()
        lists = others.fill_null([]) if others.null_count else others
        row, each = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), lists.flatten()
        out[begin[row] + each.field("pos").to_numpy(zero_copy_only=False)] = each.field("byte").to_numpy(zero_copy_only=False)
        return t.made(out, sizes, pa.string())

    return packed.withColumn("seq", F.arrow_udf(by_pieces(unpack), "string")("packed", "n_bases", "others"))
