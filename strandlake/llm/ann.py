"""Approximate nearest neighbours by learned partitions.

On the driver, a bounded sample's neighbour graph is cut into balanced parts by recursive bisection, and a small
network learns to tell a vector's part. Where there are more rows than ``MOST_TOP`` parts of ``ROWS_A_PART`` hold,
each part is cut and learned again by the same method, from a bounded sample of its own on the executors, so that
parts grow in number and not in size. Every row is filed under its most probable part; a query goes to its most
probable parts, as many as are needed for ``RECALL`` of the true neighbours of ``MEASURED`` sampled vectors, and all
rows there are reranked by their exact inner product in double precision.

A part is searched in blocks of rows against blocks of queries, each part in as many as its own rows and queries
need, so that no task grows with a part: one part may hold most rows. Within a block equal vectors are scored once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import map_batches

NEAREST, EVERY = 20, 20
#: Rows of a part; parts (powers of two) of the first level and below each of them; sample rows for each part:
#: 16,384 on the driver, 8,192 for each part that is cut again.
ROWS_A_PART, MOST_TOP, MOST_LOW, SAMPLE_A_PART = 4096, 512, 256, 32
LEAST_SAMPLE, GRAPH, HIDDEN, EPOCHS = 8192, 10, 128, 40
#: Parts of the first level whose own parts a query may go to.
WIDE = 16
#: Share of true neighbours that the probed parts must hold, and the vectors it is measured with.
RECALL, MEASURED = 0.96, 256
BLOCK = (512, 16_384)


def neighbours(x: np.ndarray, k: int, of: np.ndarray | None = None) -> np.ndarray:
    """Indices of the k rows of largest inner product with each asked row, itself left out."""
    of = np.arange(len(x)) if of is None else of
    k = min(k, len(x) - 1)
    out = np.empty((len(of), k), np.int64)
    for at in range(0, len(of), 512):
        own = of[at : at + 512]
        s = x[own] @ x.T
        s[np.arange(len(own)), own] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def bisect(src: np.ndarray, dst: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 40, swaps: int = 8) -> np.ndarray:
    """Halve a graph of n nodes evenly with few edges cut: a spectral start, then swaps that pay."""
    a, b = np.concatenate((src, dst)), np.concatenate((dst, src))
    degree = np.bincount(a, minlength=n) + 1.0
    v = rng.normal(size=n)
    for _ in range(rounds):
        v = (np.bincount(a, weights=v[b], minlength=n) + v) / degree
        v -= (v * degree).sum() / degree.sum()
        v /= np.linalg.norm(v) or 1.0
    side = np.zeros(n, bool)
    side[np.lexsort((np.arange(n), v))[n // 2 :]] = True
    for _ in range(swaps):
        other = side[a] != side[b]
        gain = np.bincount(a, weights=np.where(other, 1.0, -1.0), minlength=n)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        pays = np.flatnonzero(gain[left[:m]] + gain[right[:m]] <= 0)
        m = min(pays[0] if len(pays) else m, max(1, n // 20))
        if not m:
            break
        before = other.sum()
        trial = side.copy()
        trial[left[:m]], trial[right[:m]] = True, False
        if (trial[a] != trial[b]).sum() >= before:
            break
        side = trial
    return side


def partition(x: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Balanced parts (a power of two) of the neighbour graph of x."""
    rng = np.random.default_rng(seed)
    near = neighbours(x, GRAPH)
    src, dst = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    part = np.zeros(len(x), np.int64)
    step = 1
    while step < parts:
        for p in range(step):
            nodes = np.flatnonzero(part == p)
            place = np.full(len(x), -1)
            place[nodes] = np.arange(len(nodes))
            inside = (place[src] >= 0) & (place[dst] >= 0)
            part[nodes[bisect(place[src[inside]], place[dst[inside]], len(nodes), rng)]] += step
        step *= 2
    return part


class Router:
    """A network with one hidden layer that gives each vector's probability of lying in each part."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int, seed: int = 0, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.parts, self.scale = parts, 1.0 / max(1e-300, float(np.sqrt((x**2).sum(1).mean())))
        self.w = [rng.normal(size=(x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]) * 4, np.zeros(hidden), rng.normal(size=(hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        x = x * self.scale
        for _ in range(EPOCHS if parts > 1 else 0):
            for own in np.array_split(rng.permutation(len(x)), -(-len(x) // 256)):
                hidden, p = self._forward(x[own])
                p[np.arange(len(own)), part[own]] -= 1
                p /= len(own)
                back = (p @ self.w[2].T) * (hidden > 0)
                step += 1
                for i, g in enumerate((x[own].T @ back, back.sum(0), hidden.T @ p, p.sum(0))):
                    g = g + 1e-4 * self.w[i]
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(0, x @ self.w[0] + self.w[1])
        z = hidden @ self.w[2] + self.w[3]
        e = np.exp(z - z.max(1, keepdims=True))
        return hidden, e / e.sum(1, keepdims=True)

    def probable(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x * self.scale)[1]

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each vector from the most to the least probable."""
        return np.argsort(-self.probable(x), axis=1, kind="stable")


class Parts:
    """The parts of both levels, numbered through; those of the first level that were not cut again count as one."""

    def __init__(self, top: Router, low: dict[int, Router] | None = None):
        self.top, self.low = top, low or {}
        self.sizes = np.array([self.low[p].parts if p in self.low else 1 for p in range(top.parts)])
        self.base = np.concatenate(([0], np.cumsum(self.sizes)))
        self.parts = int(self.base[-1])

    def of(self, x: np.ndarray) -> np.ndarray:
        """The most probable part of each vector."""
        first = self.top.order(x)[:, 0] if len(x) else np.zeros(0, np.int64)
        out = self.base[first]
        for p in np.unique(first):
            if p in self.low:
                own = first == p
                out[own] += self.low[p].order(x[own])[:, 0]
        return out

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each vector from the most probable on; -1 fills up."""
        if not self.low:
            return self.top.order(x)
        p_top = self.top.probable(x)
        first = np.argsort(-p_top, axis=1, kind="stable")[:, :WIDE]
        width = int(self.sizes.max())
        prob, ids = np.full((len(x), first.shape[1] * width), -1.0), np.full((len(x), first.shape[1] * width), -1)
        for j in range(first.shape[1]):
            for p in np.unique(first[:, j]):
                own, at = np.flatnonzero(first[:, j] == p)[:, None], j * width + np.arange(self.sizes[p])
                inside = self.low[p].probable(x[own[:, 0]]) if p in self.low else 1.0
                prob[own, at], ids[own, at] = p_top[own, p] * inside, self.base[p] + np.arange(self.sizes[p])
        return np.take_along_axis(ids, np.argsort(-prob, axis=1, kind="stable"), axis=1)


def probes(parts: Parts, asked: np.ndarray, query: np.ndarray, part: np.ndarray, recall: float = RECALL) -> int:
    """Least number of parts that hold ``recall`` of true neighbours: a neighbour of asked row ``query`` lies in ``part``."""
    if not len(query):
        return parts.parts
    order = parts.order(asked)
    hit = order[query] == part[:, None]
    at = np.sort(np.where(hit.any(1), hit.argmax(1), order.shape[1] - 1))
    return int(at[int(np.ceil(recall * len(at))) - 1]) + 1


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def top(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the k best rows for each query, by exact score and then by id."""
    # equal vectors: of each, only the k smallest ids besides the query's own can be among the best; ids may repeat
    order = np.lexsort((ids, *rows.T[::-1]))
    rows, ids = rows[order], ids[order]
    new = np.concatenate(([True], (rows[1:] != rows[:-1]).any(1)))
    first, size = np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(rows)))
    kinds, norm = rows[first], np.sqrt((rows[first] ** 2).sum(1))
    kind_of, by_id = np.repeat(np.arange(len(kinds)), size), np.argsort(ids, kind="stable")
    out = []
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        s = q @ kinds.T
        lo, hi = (np.searchsorted(ids[by_id], q_ids[at : at + 256], side=side) for side in ("left", "right"))
        asks = np.repeat(np.arange(len(q)), hi - lo)
        of = kind_of[by_id[np.arange(len(asks)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)]]
        own = np.zeros(s.shape, np.int32)  # rows of each kind that carry the query's id
        np.add.at(own, (asks, of), 1)
        alone = own[asks, of] == size[of]
        s[asks[alone], of[alone]] = -np.inf
        least = np.partition(s, max(0, len(kinds) - k - 1), axis=1)[:, max(0, len(kinds) - k - 1)] if len(kinds) > k else np.full(len(q), -np.inf)
        slack = 1e-12 * np.sqrt((q**2).sum(1))[:, None] * norm  # what the order of summing may change
        i, j = np.nonzero(s >= least[:, None] - slack)
        n = np.minimum(size[j], k + own[i, j])
        which = np.repeat(np.arange(len(i)), n)
        member = first[j[which]] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        score = (q[i] * kinds[j]).sum(1)[which]
        i, got = i[which], ids[member]
        keep = got != q_ids[at + i]
        i, got, score = i[keep], got[keep], score[keep]
        best = np.lexsort((got, -score, i))
        i, got, score = i[best], got[best], score[best]
        place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        out.append((at + i[place < k], got[place < k], score[place < k]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return FOUND.empty_table()
        q_ids = queries.column("vec_id").to_numpy()
        i, ids, score = top(_matrix(queries.column("v")), q_ids, _matrix(rows.column("v")), rows.column("vec_id").to_numpy(), k)
        return pa.Table.from_arrays([pa.array(q_ids[i]), pa.array(ids), pa.array(score)], schema=FOUND)

    return run


def _filed(parts):
    """(part) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = parts.value.of(_matrix(b.column("v"))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32))], [*b.schema.names, "part"])

    return run


def _sent(parts, counts: np.ndarray, least_parts: int, least_rows: int):
    """The parts that each query goes to: ``least_parts`` of them, and on until they hold ``least_rows`` rows; if its
    probable parts do not, the largest ones besides."""
    largest = np.argsort(-counts, kind="stable")
    largest = largest[: int((np.cumsum(counts[largest]) < least_rows).sum()) + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            order = parts.value.order(_matrix(b.column("v")))
            held = np.cumsum(np.where(order >= 0, counts[order], 0), axis=1)
            n = np.maximum(least_parts, (held < least_rows).sum(1) + 1)
            chosen = [o[:m][o[:m] >= 0] for o, m in zip(order, n)]
            chosen = [np.union1d(c, largest) if h[-1] < least_rows else c for c, h in zip(chosen, held)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.astype(np.int32) for c in chosen], pa.list_(pa.int32()))], [*b.schema.names, "parts"])

    return run


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: with an id and a finite vector that is neither null nor zero.
    Where lengths differ, the vectors of the most frequent length take part (the longer one on a tie)."""
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if kind == "float" else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (sizes[0].n if sizes else 0))


_SHARES = 1 << 30


def _power(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


def _nearest_parts(shared):
    """Of the rows of a task, the parts of those nearest to each asked vector; rows equal to it are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, asked = shared.value
        own, kept = (asked**2).sum(1)[:, None], [np.zeros((len(asked), 0)), np.zeros((len(asked), 0), np.int64)]
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"))
            s = asked @ x.T
            same = (np.abs(s - own) <= 1e-9 * own) & (np.abs((x**2).sum(1)[None] - own) <= 1e-9 * own)
            s[same] = -np.inf
            s, part = np.hstack([kept[0], s]), np.hstack([kept[1], np.broadcast_to(parts.of(x), s.shape)])
            k = min(NEAREST, s.shape[1])
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            kept = [np.take_along_axis(s, best, axis=1), np.take_along_axis(part, best, axis=1)]
        q, j = np.nonzero(np.isfinite(kept[0]))
        columns = [pa.array(q.astype(np.int32)), pa.array(kept[1][q, j].astype(np.int32)), pa.array(kept[0][q, j])]
        yield pa.RecordBatch.from_arrays(columns, ["q", "part", "score"])

    return run


def _learned(low: dict[int, int]):
    """A part's own parts, learned where its sample lies."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        x = _matrix(table.column("v"))
        x = x[np.argsort(table.column("key").to_numpy(), kind="stable")]
        parts = low[part]
        while parts > 1 and len(x) < 8 * parts:
            parts //= 2
        router = Router(x, partition(x, parts), parts, hidden=HIDDEN // 2)
        router.w = [w.astype(np.float32) for w in router.w]
        return pa.table({"part": pa.array([part], pa.int32()), "model": pa.array([pickle.dumps(router)], pa.binary())})

    return run


def fit(rows: DataFrame, n: int, recall: float = RECALL, rows_a_part: int = ROWS_A_PART, most_top: int = MOST_TOP, most_low: int = MOST_LOW) -> tuple[Parts, int]:
    """The parts, learned from hash samples of the distinct vectors, and how many of them to probe.

    How many are needed is measured with ``MEASURED`` of the sampled vectors and their nearest among all rows, so
    that it does not depend on how thin the sample is."""
    top = min(most_top, _power(max(16, n / rows_a_part)))
    most = max(LEAST_SAMPLE, SAMPLE_A_PART * top)
    keyed = rows.select(F.xxhash64("v").alias("key"), "v")
    place = F.pmod(F.col("key"), F.lit(_SHARES))
    sample = keyed.where(place < int(min(1.0, most / max(1, n)) * _SHARES) + 1).dropDuplicates(["key"])
    x = np.array([r.v for r in sample.orderBy("key").limit(most).collect()], np.float64)
    while top > 1 and len(x) < 8 * top:
        top //= 2
    parts = Parts(Router(x, partition(x, top), top) if len(x) else Router(np.zeros((1, 1)), np.zeros(1, int), 1))
    if n > rows_a_part * most_top:
        kind = rows.schema["v"].dataType.simpleString()
        filed = map_batches(keyed, _filed(rows.sparkSession.sparkContext.broadcast(parts)), f"key long, v {kind}, part int", 4096)
        counts = {r.part: r["count"] for r in filed.groupBy("part").count().collect()}
        low = {p: c for p, m in counts.items() if (c := min(most_low, _power(m / rows_a_part))) > 1}
        share = F.create_map(*[F.lit(v) for p, c in low.items() for v in (p, int(min(1.0, SAMPLE_A_PART * c / counts[p]) * _SHARES) + 1)]) if low else None
        if low:  # a row of at most 100 KB for each part of the first level
            own = filed.where(place < share[F.col("part")]).dropDuplicates(["key"]).groupBy("part").applyInArrow(_learned(low), "part int, model binary")
            parts = Parts(parts.top, {r.part: pickle.loads(r.model) for r in own.collect()})
    if parts.parts == 1:
        return parts, 1
    asked = x[np.unique(np.linspace(0, len(x) - 1, min(MEASURED, len(x))).astype(int))]
    near = map_batches(rows.select("v"), _nearest_parts(rows.sparkSession.sparkContext.broadcast((parts, asked))), "q int, part int, score double", 4096)
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    got = near.withColumn("r", best).where(F.col("r") <= NEAREST).select("q", "part").collect()
    return parts, probes(parts, asked, np.array([r.q for r in got], int), np.array([r.part for r in got], int), recall)


def _blocks(n: int, size: int) -> int:
    return max(1, -(-n // size))


def search(table: DataFrame, every: int = EVERY, k: int = NEAREST, recall: float = RECALL, rows_a_part: int = ROWS_A_PART, most_top: int = MOST_TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, its ``k`` nearest.

    Rows that ``usable`` leaves out are neither queries nor candidates. Ties go to the smaller vec_id. Rows with
    the query's own vec_id are no candidates; of rows that repeat a query's vec_id the least vector is searched;
    other repeated rows are candidates each. With fewer than k candidates all are returned; an empty table
    gives an empty one. Columns besides vec_id and embedding take no part.
    """
    left, right = planned(table, every, k, recall, rows_a_part, most_top)
    keys = ["part", "rb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def planned(table: DataFrame, every: int, k: int, recall: float, rows_a_part: int, most_top: int) -> tuple[DataFrame, DataFrame]:
    """Rows and queries as they are shuffled: each with its part and its block of rows (rb) and of queries (qb)."""
    spark = table.sparkSession
    rows = usable(table)
    n = rows.count()
    parts, least_parts = fit(rows, n, recall, rows_a_part, most_top)
    shared = spark.sparkContext.broadcast(parts)
    kind = rows.schema["v"].dataType.simpleString()
    filed = map_batches(rows, _filed(shared), f"vec_id long, v {kind}, part int", 4096)
    counts, queries = np.zeros(parts.parts, np.int64), np.zeros(parts.parts, np.int64)
    for r in filed.groupBy("part").count().collect():  # a row for each part
        counts[r.part] = r["count"]
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    sent = map_batches(asked, _sent(shared, counts, least_parts, 2 * k), f"vec_id long, v {kind}, parts array<int>", 512)
    sent = sent.select("vec_id", "v", F.explode("parts").alias("part"))
    for r in sent.groupBy("part").count().collect():
        queries[r.part] = r["count"]
    block = int(min(BLOCK[1], max(BLOCK[0], n / (2 * parts.parts))))
    sizes = [(p, _blocks(int(counts[p]), block), _blocks(int(queries[p]), block)) for p in range(parts.parts)]
    sizes = F.broadcast(spark.createDataFrame(sizes, "part int, rbs int, qbs int"))  # a row for each part, 131,072 at most
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    salt = lambda count: F.pmod(F.xxhash64("vec_id", "part"), F.col(count)).cast("int")
    left = filed.join(sizes, "part").withColumn("rb", salt("rbs")).withColumn("qb", spread("qbs"))
    right = sent.join(sizes, "part").withColumn("qb", salt("qbs")).withColumn("rb", spread("rbs"))
    return left.select("vec_id", "v", "part", "rb", "qb"), right.select("vec_id", "v", "part", "rb", "qb")


def exact(table: DataFrame, every: int = EVERY, k: int = NEAREST) -> list[tuple[int, int, int, float]]:
    """The same by brute force on the driver: for small tables, to measure recall."""
    got = usable(table).collect()
    if not got:
        return []
    ids, x = np.array([r.vec_id for r in got]), np.array([r.v for r in got], np.float64)
    asked = np.flatnonzero(ids % every == 0)
    i, found, score = top(x[asked], ids[asked], x, ids, k)
    place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
    return [(int(ids[asked][a]), int(p) + 1, int(b), float(s)) for a, p, b, s in zip(i, place, found, score)]
