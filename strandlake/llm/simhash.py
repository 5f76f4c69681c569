"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints at most ``MAX_BITS`` = 2 bits apart are linked. Two such fingerprints agree on at least
two of four 16-bit blocks, so in one of six block pairs they hang below the same upper node of the
index: a node whose mask covers the pair's 32 bits and whose pattern all its fingerprints share. A
worker sorts the fingerprints of a node by Gray rank (neighbours then differ in few bits), groups them
by eight, stores at each group the bits that all members share and its parent does not hold yet, and
walks down with the differences added up so far: a group over two bits is dropped whole.

An upper node of over ``SPLIT_AT`` fingerprints is split by the six pairs of its remaining bits' four
8-bit blocks. A node of the second level fixes 48 bits and so holds at most 2^16 distinct fingerprints:
no group is unbounded, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import cut, map_batches, utf8
from strandlake.llm.graph import components

SHINGLE, SEED, MAX_BITS = 3, 42, 2
SPLIT_AT, FAN_OUT, WALK = 4096, 8, 1 << 20


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 where the text has no word."""
    words = (text or b"").lower().split()  # bytes.lower() folds A-Z only; bytes.split() knows x20 and x09-x0D only
    if not words:
        return 0
    line, get = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return get(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    h = np.fromiter((get(line[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t) for t in utf8(b, "text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of whole texts."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _sign, "doc_id long, fp long")


def _pairs(parts: list[int]) -> list[int]:
    """Masks of every choice of two of the given blocks, as signed longs."""
    return [int(np.uint64(a | b).astype(np.int64)) for a, b in combinations(parts, 2)]


#: Upper nodes: two of four blocks of 16 bits.
UPPER = _pairs([0xFFFF << (16 * i) for i in range(4)])


def _lower(mask: int) -> list[int]:
    """Second level below an upper mask: two of the four 8-bit blocks it leaves open, added to it."""
    open_ = [0xFF << (8 * i) for i in range(8) if not (mask >> (8 * i)) & 0xFF]
    return [m | mask for m in _pairs(open_)]


def _nodes(fp: Column, masks: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(m).alias("mask"), fp.bitwiseAND(F.lit(m)).alias("pattern")) for m in masks])


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order."""
    g = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        g ^= g >> np.uint64(s)
    return g


def near_pairs(fp: np.ndarray, node: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i < j) of the fingerprints of one node that differ in at most ``limit`` bits.

    ``fp`` uint64, with the rows of each node together and in Gray order; ``node`` numbers them upwards.
    """
    n = len(fp)
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    # levels[0] holds the fingerprints; above, groups of FAN_OUT rows of the same node
    levels = [{"and": fp, "or": fp, "first": first, "size": size}]
    while levels[-1]["size"].max(initial=0) > 1:
        low = levels[-1]
        up = -(-low["size"] // FAN_OUT)
        at = np.repeat(low["first"], up) + FAN_OUT * (np.arange(up.sum()) - np.repeat(np.cumsum(up) - up, up))
        levels.append({"and": np.bitwise_and.reduceat(low["and"], at), "or": np.bitwise_or.reduceat(low["or"], at), "first": np.cumsum(up) - up, "size": up})
    for k in reversed(range(len(levels))):
        level = levels[k]
        level["mask"] = ~(level["and"] ^ level["or"])  # bits that all members share
        level["own"] = level["mask"].copy()
        if k + 1 < len(levels):  # what the parent holds is not stored or compared again
            place = np.arange(len(level["mask"])) - np.repeat(level["first"], level["size"])
            parent = np.repeat(levels[k + 1]["first"], level["size"]) + place // FAN_OUT
            level["own"] &= ~levels[k + 1]["mask"][parent]
    which = np.repeat(np.arange(len(first)), size)
    out_i, out_j = [], []
    asks = np.flatnonzero(size[which] > 1)
    top = len(levels) - 1
    step = max(1, WALK // (FAN_OUT * 64))
    for at in range(0, len(asks), step):
        q = asks[at : at + step]
        g = levels[top]["first"][which[q]]
        far = _popcount((fp[q] ^ levels[top]["and"][g]) & levels[top]["own"][g])
        q, g, far = (x[far <= limit] for x in (q, g, far))
        for k in range(top - 1, -1, -1):
            level, above = levels[k], levels[k + 1]
            w = which[q]
            child = level["first"][w] + FAN_OUT * (g - above["first"][w])
            n_child = np.minimum(FAN_OUT, level["first"][w] + level["size"][w] - child)
            pick = np.repeat(np.arange(len(q)), n_child)
            g = child[pick] + np.arange(len(pick)) - np.repeat(np.cumsum(n_child) - n_child, n_child)
            q, far = q[pick], far[pick]
            far = far + _popcount((fp[q] ^ level["and"][g]) & level["own"][g])
            keep = far <= limit
            q, g, far = q[keep], g[keep], far[keep]
        out_i.append(q[q < g])
        out_j.append(g[q < g])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least index linked to each, within one worker's rows."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        root = new
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each node's near pairs. Rows come sorted by node; whole nodes are handled at a time."""

    def done(mask: np.ndarray, pattern: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1]))) if len(fp) else np.zeros(0, bool)
        node = np.cumsum(new)
        counts = np.bincount(node)[node] if len(fp) else node
        node, fp = node[counts > 1], fp[counts > 1].view(np.uint64)
        order = np.lexsort((gray_rank(fp), node))
        node, fp = node[order], fp[order]
        i, j = near_pairs(fp, node)
        root = _forest(i, j, len(fp))
        tied = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[tied].view(np.int64)), pa.array(fp[root[tied]].view(np.int64))], ["u", "v"])

    held = [np.zeros(0, np.int64)] * 3
    for b in batches:
        held = [np.concatenate((h, b.column(c).to_numpy())) for h, c in zip(held, ("mask", "pattern", "fp"))]
        if len(held[0]) < 1 << 16:
            continue
        last = (held[0] != held[0][-1]) | (held[1] != held[1][-1])
        end = np.flatnonzero(last)[-1] + 1 if last.any() else 0
        if end:
            yield done(*(h[:end] for h in held))
            held = [h[end:] for h in held]
    yield done(*held)


def links(prints: DataFrame, split_at: int = SPLIT_AT) -> DataFrame:
    """(u, v) of a distinct ``fp`` column: links that connect what lies within MAX_BITS, without all pairs."""
    rows = prints.select("fp", F.explode(_nodes(F.col("fp"), UPPER)).alias("n")).select("n.*", "fp")
    hot = rows.groupBy("mask", "pattern").count().where(F.col("count") > split_at).select("mask", "pattern", F.lit(True).alias("hot"))
    rows = rows.join(hot, ["mask", "pattern"], "left")
    deeper = F.coalesce(*[F.when(F.col("mask") == m, _nodes(F.col("fp"), _lower(m))) for m in UPPER])
    whole = F.array(F.struct("mask", "pattern"))
    rows = rows.select("fp", F.explode(F.when(F.col("hot"), deeper).otherwise(whole)).alias("n")).select("n.*", "fp")
    rows = rows.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
    return map_batches(rows, _link, "u long, v long", 4096)


def _named(signed: DataFrame, split_at: int) -> DataFrame:
    """(fp, component_id) of rows with fp and doc_id."""
    first = cut(signed.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(first.select("fp"), split_at))
    tied = first.join(roots, first.fp == roots.node).select("fp", "root", "first")
    least = cut(tied.groupBy("root").agg(F.min("first").alias("component_id")))  # cut: a root may have most rows
    tied = tied.join(least, "root").select("fp", "root", "component_id")
    return cut(first.join(tied, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id")))


def near_duplicates(docs: DataFrame, split_at: int = SPLIT_AT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most 2 bits. A null or wordless text has
    fingerprint zero and links like any other; rows with a null doc_id keep it and never name a component
    unless all of its rows do; repeated rows come back repeated; an empty table gives an empty one. Other
    columns of ``docs`` are ignored, whatever their names.
    """
    signed = cut(fingerprints(docs))
    named = _named(signed, split_at)
    return signed.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sign_keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t) for t in utf8(b, "text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(fp)], ["doc_id", "key", "fp"])


def representatives(docs: DataFrame, split_at: int = SPLIT_AT) -> DataFrame:
    """The rows of ``docs`` less all but one of each component: its smallest doc_id (null after all others),
    of equal ids the smallest hash of the text; of rows that agree in both, any one.

    Null and empty texts are copies of each other; an empty table gives an empty one; all columns of ``docs``
    come back as they are, whatever their names."""
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    key = F.xxhash64(F.coalesce(text, F.lit("")))
    signed = cut(map_batches(docs.select(id_.alias("doc_id"), key.alias("key"), text.alias("text")), _sign_keyed, "doc_id long, key long, fp long"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    by_print = cut(signed.groupBy("fp").agg(F.min(place).alias("one")))
    kept = by_print.join(_named(signed, split_at), "fp").groupBy("root").agg(F.min("one").alias("one"))
    kept = cut(kept.select(F.coalesce("one.doc_id", F.lit(0)).alias("id"), F.col("one.none").alias("none"), F.col("one.key").alias("key")))
    own = docs.select(F.coalesce(id_, F.lit(0)).alias("id"), id_.isNull().alias("none"), key.alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    one = own.groupBy("id", "none", "key").agg(F.any_value("row").alias("row"))  # before the join: repeated rows go on the map side
    return one.join(kept, ["id", "none", "key"], "left_semi").select(*[F.col("row")[c].alias(c) for c in docs.columns])
