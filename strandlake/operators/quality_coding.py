"""Qualities as coded bits and back, by the method that suits each superblock.

"plain" codes a symbol by its position, "truncate" does so without the trailing #, and "rle" codes a block's runs:
each symbol by that of the run before, each length by its symbol. The codes come from the superblock's own
histograms. A block of 32 reads is one string of bits; a superblock's codes are loaded once for all of its blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.batches import binaries, flat, symbols, whole_groups
from strandlake.functions.scalars import BLOCK, SUPERBLOCK, block_id, kept_length
from strandlake.operators import profile, runs

BLOCKS = pa.schema([("sb_id", pa.int64()), ("block_id", pa.int64()), ("data", pa.binary()), ("n_bits", pa.int64())])


def models(reads: DataFrame, methods: DataFrame, size: int = SUPERBLOCK) -> DataFrame:
    """(model, sb_id, context, symbol, n): the histograms that each superblock's method codes by."""
    rows = profile.superblocks(reads, size).join(methods.select("sb_id", "method"), "sb_id").select("rec_no", "quality", "method")
    per = size // BLOCK

    text = F.when(F.col("method") == "truncate", F.substring("quality", F.lit(1), kept_length(F.col("quality")))).otherwise(F.col("quality"))
    hist = profile.quality_histogram(rows.where("method <> 'rle'").withColumn("quality", text), size).where("pos > 0")
    plain = hist.select(F.lit("quality_plain").alias("model"), "sb_id", F.col("pos").cast("string").alias("context"), "symbol", "n")
    coded = runs.run_models(rows.where("method = 'rle'"), per)
    return plain.union(coded)


#: Codes of up to so many bits are found by one look at a table, fewer where positions are many: so many entries in all.
LOOK, ENTRIES = 12, 1 << 20


def _values(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes as numbers, and how many bits each has."""
    data, at = flat(codes)
    size = np.diff(at)
    if size.max(initial=0) > 63:
        raise ValueError("a code of over 63 bits")
    bits = (data == ord("1")).astype(np.uint64) << (np.repeat(at[1:], size) - np.arange(len(data)) - 1).astype(np.uint64)
    value = np.zeros(len(size), np.uint64)
    if len(data):
        value[size > 0] = np.add.reduceat(bits, at[:-1][size > 0])
    return value, size


class _Lines:
    """The codes of a superblock by a number for each context and symbol."""

    def __init__(self, codes: pa.RecordBatch):
        value, size = _values(codes.column("code"))
        model, context, symbol = (codes.column(c) for c in ("model", "context", "symbol"))
        of = {m: np.flatnonzero(pc.equal(model, m).to_numpy(zero_copy_only=False)) for m in ("quality_plain", "run_symbol", "run_length")}
        self.plain = np.full(0, -1)
        if len(of["quality_plain"]):
            at = context.take(pa.array(of["quality_plain"])).cast(pa.int64()).to_numpy() - 1
            code = symbols(symbol.take(pa.array(of["quality_plain"])))[0]
            self.plain = np.full((int(at.max()) + 1) * 256, -1)
            self.plain[at * 256 + code] = of["quality_plain"]
        one = lambda text: ord(text) if text else -1
        pick = lambda column, rows: column.take(pa.array(rows)).to_pylist()
        self.pairs = {(one(b), one(s)): r for b, s, r in zip(pick(context, of["run_symbol"]), pick(symbol, of["run_symbol"]), of["run_symbol"].tolist())}
        self.sizes = {(one(s), int(n)): r for s, n, r in zip(pick(context, of["run_length"]), pick(symbol, of["run_length"]), of["run_length"].tolist())}
        self.value, self.size = value, size

    def rows(self, method: str, codes: np.ndarray, at: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes that stand for the reads of some blocks, and where each block's begin."""
        if method != "rle":
            if codes.dtype != np.uint8:
                raise ValueError("qualities by position must be ASCII")
            key = (np.arange(len(codes)) - np.repeat(at[:-1], np.diff(at))) * 256 + codes
            return self._known(self.plain[key] if key.max(initial=0) < len(self.plain) else np.array([-1])), begins
        run, size = runs.cut_runs(codes, begins)
        symbol = codes[run].astype(np.int64)
        before = np.concatenate(([-1], symbol[:-1]))[: len(run)]
        before[np.isin(run, begins)] = -1
        out = np.empty(2 * len(run), np.int64)
        for k, (left, right, table) in enumerate(((before, symbol, self.pairs), (symbol, size, self.sizes))):
            key, of = np.unique((left + 1 << 32) + right, return_inverse=True)
            out[k::2] = np.array([table.get(((x >> 32) - 1, x & 0xFFFFFFFF), -1) for x in key.tolist()], np.int64)[of]
        return self._known(out), 2 * np.searchsorted(run, begins)

    @staticmethod
    def _known(rows: np.ndarray) -> np.ndarray:
        if rows.min(initial=0) < 0:
            raise ValueError("a symbol without a code")
        return rows

    def packed(self, rows: np.ndarray, begins: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Each block's bits behind a leading 1, which keeps their number, and that number."""
        size = self.size[rows]
        ends = np.concatenate(([0], np.cumsum(size)))
        bounds = ends[np.append(begins, len(rows))]
        n = np.diff(bounds)
        whole = 8 * (n // 8 + 1)
        base = np.concatenate(([0], np.cumsum(whole)))
        out = np.zeros(base[-1], np.uint8)
        first = base[:-1] + whole - n
        out[first - 1] = 1
        place = np.arange(bounds[-1])
        shift = (np.repeat(ends[1:], size) - place - 1).astype(np.uint64)
        out[place + np.repeat(first - bounds[:-1], n)] = np.repeat(self.value[rows], size) >> shift & np.uint64(1)
        return binaries(np.packbits(out), base // 8), n


class _Table:
    """What the next bits mean, by the first ``width`` of them: (meaning, bits); codes of over ``most`` bits apart."""

    def __init__(self, codes: list[tuple[str, object]], most: int = LOOK):
        self.width = min(most, max(len(c) for c, _ in codes))
        self.near: list[tuple | None] = [None] * (1 << self.width)
        self.far = {c: (s, len(c)) for c, s in codes if len(c) > self.width}
        for c, s in codes:
            if len(c) <= self.width:
                low = int(c or "0", 2) << self.width - len(c)
                self.near[low : low + (1 << self.width - len(c))] = [(s, len(c))] * (1 << self.width - len(c))

    def late(self, bits: np.ndarray, at: int) -> tuple:
        """A code that the table does not hold."""
        for n in sorted({len(c) for c in self.far}):
            if at + n <= len(bits) and (found := self.far.get("".join(map(str, bits[at : at + n].tolist())))):
                return found
        raise ValueError("bits end inside a code")


class _Book:
    """A superblock's codes, turned: from bits to symbols."""

    def __init__(self, codes: pa.RecordBatch):
        tables: dict[str, dict[str, list[tuple[str, str]]]] = {"quality_plain": {}, "run_symbol": {}, "run_length": {}}
        for model, context, symbol, code in zip(*(codes.column(c).to_pylist() for c in ("model", "context", "symbol", "code"))):
            tables[model].setdefault(context, []).append((code, symbol))
        made: dict[tuple, _Table] = {}  # many positions have the same codes

        def table(codes: list[tuple[str, object]]) -> _Table:
            key = tuple(codes)
            if key not in made:
                made[key] = _Table(codes, most)
            return made[key]

        at = tables["quality_plain"]
        most = min(LOOK, max(3, (ENTRIES // (len(at) + 1)).bit_length() - 1))
        none = _Table([("", "")])
        plain = [table(at[str(i + 1)]) if str(i + 1) in at else none for i in range(max(map(int, at), default=0))]
        self.plain = [(t.near, LOOK - t.width, t) for t in plain]
        sizes = {symbol: table([(c, int(n)) for c, n in codes]) for symbol, codes in tables["run_length"].items()}
        self.after = {before: _Table([(c, (s, sizes[s])) for c, s in codes]) for before, codes in tables["run_symbol"].items()}

    def qualities(self, method: str, data: bytes, lengths: list[int]) -> list[str]:
        """The reads of a block. A lone symbol takes no bits."""
        bits = np.unpackbits(np.frombuffer(data, np.uint8))
        bits = bits[int(np.argmax(bits)) + 1 :]
        padded = np.concatenate((bits, np.zeros(LOOK, np.uint8))).astype(np.uint16)
        look = np.zeros(len(bits) + 1, np.uint16)
        for k in range(LOOK):
            look |= padded[k : k + len(look)] << (LOOK - 1 - k)
        at, out, shown = 0, [], memoryview(look)
        try:
            if method != "rle":
                for n in lengths:
                    line = []
                    if n > len(self.plain):
                        raise ValueError("a read longer than its superblock's codes")
                    for near, shift, t in self.plain[:n]:
                        symbol, m = near[shown[at] >> shift] or t.late(bits, at)
                        line.append(symbol)
                        at += m
                    out.append("".join(line))
            else:
                line, before, left = [], "", sum(lengths)
                while left > 0:
                    t = self.after[before]
                    (before, t), m = t.near[shown[at] >> LOOK - t.width] or t.late(bits, at)
                    at += m
                    n, m = t.near[shown[at] >> LOOK - t.width] or t.late(bits, at)
                    at += m
                    line.append(before * n)
                    left -= n
                whole, begin = "".join(line), 0
                for n in lengths:
                    out.append(whole[begin : begin + n])
                    begin += n
        except IndexError:
            raise ValueError("bits end inside a code") from None
        if at > len(bits):
            raise ValueError("bits end inside a code")
        return out


def _sorted(table: pa.Table, key: str) -> pa.RecordBatch:
    table = table.combine_chunks()
    return (table.take(pa.array(np.argsort(table.column(key).to_numpy(), kind="stable"))).combine_chunks().to_batches() or [pa.RecordBatch.from_pylist([], table.schema)])[0]


def _encode(reads: pa.Table, codes: pa.Table) -> pa.Table:
    if not reads.num_rows:
        return BLOCKS.empty_table()
    rows = _sorted(reads, "rec_no")
    method, sb_id = rows.column("method")[0].as_py(), rows.column("sb_id")[0].as_py()
    lines, out = _Lines((codes.combine_chunks().to_batches() or [pa.RecordBatch.from_pylist([], codes.schema)])[0]), []
    for b in whole_groups(iter([rows]), "block_id"):
        text, at = symbols(b.column("quality"))
        blocks, first = np.unique(b.column("block_id").to_numpy(), return_index=True)
        data, n = lines.packed(*lines.rows(method, text, at, at[first]))
        out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), sb_id)), pa.array(blocks), data, pa.array(n)], schema=BLOCKS))
    return pa.Table.from_batches(out, BLOCKS)


def _decode(sizes: pa.Table, both: pa.Table) -> pa.Table:
    """``both`` holds a superblock's codes and its blocks."""
    kind = pa.schema([("rec_no", pa.int64()), ("quality", pa.string())])
    if not sizes.num_rows:
        return kind.empty_table()
    both, rows = both.combine_chunks(), _sorted(sizes, "rec_no")
    codes = both.filter(both.column("data").is_null()).combine_chunks().to_batches()
    book = _Book(codes[0] if codes else pa.RecordBatch.from_pylist([], both.schema))
    blocks = both.select(["block_id", "data"]).filter(both.column("data").is_valid())
    data = dict(zip(blocks.column("block_id").to_pylist(), blocks.column("data").to_pylist()))
    method, out = rows.column("method")[0].as_py(), []
    for b in whole_groups(iter([rows]), "block_id"):
        block, first = np.unique(b.column("block_id").to_numpy(), return_index=True)
        kept, made = b.column("kept").to_pylist(), []
        for number, i, j in zip(block.tolist(), first, [*first[1:], b.num_rows]):
            made += book.qualities(method, data[number], kept[i:j])
        out.append(pa.RecordBatch.from_arrays([b.column("rec_no"), pa.array(made, pa.string())], schema=kind))
    return pa.Table.from_batches(out, kind)


def _by_superblock(left: DataFrame, right: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return left.groupBy("sb_id").cogroup(right.groupBy("sb_id")).applyInArrow(fn, schema)


def _cut(reads: DataFrame, methods: DataFrame, size: int) -> DataFrame:
    """Reads with their block and method, without what "truncate" drops."""
    rows = profile.superblocks(reads, size).join(methods.select("sb_id", "method"), "sb_id").withColumn("block_id", block_id(F.col("rec_no")))
    short = profile.truncated(rows.select("rec_no", "quality", "sb_id", "block_id", "method"))
    return short.withColumns({"quality": F.when(F.col("method") == "truncate", F.col("quality")).otherwise(F.concat("quality", F.repeat(F.lit("#"), F.col("dropped")))), "dropped": F.when(F.col("method") == "truncate", F.col("dropped")).otherwise(0)})


def lengths(reads: DataFrame, methods: DataFrame, size: int = SUPERBLOCK) -> DataFrame:
    """(rec_no, sb_id, block_id, method, kept, dropped): what the bits alone do not tell."""
    return _cut(reads, methods, size).select("rec_no", "sb_id", "block_id", "method", F.length("quality").alias("kept"), "dropped")


def encode(reads: DataFrame, methods: DataFrame, codes: DataFrame, size: int = SUPERBLOCK) -> DataFrame:
    """(sb_id, block_id, data, n_bits) of (rec_no, quality); ``codes`` are those of ``models``."""
    rows = _cut(reads, methods, size).select("sb_id", "block_id", "rec_no", "method", "quality")
    return _by_superblock(rows, codes.select("sb_id", "model", "context", "symbol", "code"), _encode, "sb_id long, block_id long, data binary, n_bits long")


def decode(sizes: DataFrame, blocks: DataFrame, codes: DataFrame) -> DataFrame:
    """(rec_no, quality) from ``lengths``, the blocks and the codes."""
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    book = codes.select("sb_id", "model", "context", "symbol", "code", null("long", "block_id"), null("binary", "data"))
    both = book.union(blocks.select("sb_id", null("string", "model"), null("string", "context"), null("string", "symbol"), null("string", "code"), "block_id", "data"))
    made = _by_superblock(sizes.select("sb_id", "block_id", "rec_no", "method", "kept"), both, _decode, "rec_no long, quality string")
    return profile.refilled(made.join(sizes.select("rec_no", "dropped"), "rec_no"))
