"""Prefix codes from histograms. The tree itself has no relational form: an Arrow kernel builds it for each
small group, of a few hundred symbols at most."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODES = "model string, sb_id bigint, context string, symbol string, n bigint, code string, bits int"
_TYPES = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32())
#: Rows of histograms that a kernel builds trees for at once.
ROWS = 1 << 16


def codes(counts: list[int]) -> list[str]:
    """The code of each symbol, by position; '' for a lone symbol.

    The two smallest by (count, node) are joined, the first as 0; joined nodes are numbered after all
    symbols, so symbols win ties. Symbols without a count get no node while more than two are left.
    """
    n = len(counts)
    heap = [(c, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    while len(heap) > 2 and heap[0][0] == 0:
        heapq.heappop(heap)
    children = {}
    node = n
    while len(heap) > 1:
        zero, one = heapq.heappop(heap), heapq.heappop(heap)
        children[node] = (zero[1], one[1])
        heapq.heappush(heap, (zero[0] + one[0], node))
        node += 1
    out = [""] * n
    open_ = [(heap[0][1], "")] if heap else []
    while open_:
        at, prefix = open_.pop()
        if at < n:
            out[at] = prefix
        else:
            zero, one = children[at]
            open_ += [(zero, prefix + "0"), (one, prefix + "1")]
    return out


def _coded(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """Rows with their codes; groups with the same counts share a tree."""
    n, size = rows.column("n").to_numpy(), np.diff(np.append(starts, rows.num_rows))
    texts, of = [""], np.zeros(rows.num_rows, np.int64)
    for k in np.unique(size[size > 1]).tolist():
        at = starts[size == k][:, None] + np.arange(k)
        counts, same = np.unique(n[at], axis=0, return_inverse=True)
        of[at] = len(texts) + same.reshape(-1, 1) * k + np.arange(k)
        texts += [code for row in counts.tolist() for code in codes(row)]
    bits = np.array([len(code) for code in texts], np.int32)[of]
    return pa.RecordBatch.from_arrays([*(c.cast(t) for c, t in zip(rows.columns, _TYPES)), pa.array(texts, pa.string()).take(pa.array(of)), pa.array(bits)], [*rows.schema.names, "code", "bits"])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group and symbol; a group may go on in the next batch."""
    held: list[pa.RecordBatch] = []

    def joined() -> tuple[pa.RecordBatch, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for key in ("model", "sb_id", "context"):
            column = rows.column(key)
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
        return rows, np.flatnonzero(new)

    for b in batches:
        held += [b] * bool(b.num_rows)
        if sum(h.num_rows for h in held) >= ROWS:
            rows, starts = joined()
            if len(starts) > 1:
                yield _coded(rows.slice(0, starts[-1]), starts[:-1])
            held = [rows.slice(starts[-1])]
    if held:
        yield _coded(*joined())


def huffman(histogram: DataFrame) -> DataFrame:
    """Codes of (model, sb_id, context, symbol, n), one tree per (model, sb_id, context), symbols in byte order.

    Groups are many and tiny, so a task walks its sorted rows once and builds a tree whenever a group ends.
    """
    rows = histogram.select("model", F.col("sb_id").cast("bigint"), F.col("context").cast("string"), F.col("symbol").cast("string"), F.col("n").cast("bigint"))
    keys = ["model", "sb_id", "context"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "symbol").mapInArrow(_build, CODES)


def decode(bits: str, table: dict[str, str]) -> list[str]:
    """The symbols that a string of 0 and 1 spells under a table from symbol to code."""
    symbol, out, at = {code: s for s, code in table.items()}, [], ""
    for bit in bits:
        at += bit
        if at in symbol:
            out.append(symbol[at])
            at = ""
    if at:
        raise ValueError("bits end inside a code")
    return out
