"""Nearest neighbours over learned partitions.

1. On a bounded sample (``SAMPLE_ROWS`` vectors, those with the smallest hash of their
   id) the exact neighbour graph is built and cut into partitions of equal size by
   recursive bisection (spectral start, then swaps that lower the number of cut edges).
2. A small neural network learns, from a vector, where its neighbours lie. The share
   of probability that a query has to cover is the smallest that reaches
   ``TARGET_RECALL`` on sample queries, so clustered vectors need few partitions and
   vectors without structure many.
3. Every vector is put in its most probable partition; large partitions are dealt over
   blocks, so that a vector with very many copies does not fill one task. A query goes to
   its most probable partitions, all blocks of them, and is compared there with exact
   cosines in double precision; its best of all blocks remain. Queries that found fewer
   than k rows there, though there are more, go to all partitions.

Vectors that are null, zero, of another length than most, or that hold null or non-finite
components take no part. Ties go to the smaller id. Rows with a null id take no part, as
they cannot be named; of rows with one id each is a candidate and, if its id asks for it, a
query of its own, whose candidates are all rows but itself. Other columns are not read,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLE_ROWS = 6_000
ROWS_PER_PARTITION, MAX_PARTITIONS = 8_192, 64
BLOCK_ROWS, QUERY_ROWS = 2_048, 32_768
NEIGHBOURS = 10
TARGET_RECALL = 0.97
HIDDEN, EPOCHS, RATE = 64, 30, 3e-3


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each unit row's k nearest others."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, max(k, 0)), np.int64)
    for at in range(0, n, 1024):
        s = x[at:at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        if k > 0:
            out[at:at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def bisect(nodes: np.ndarray, edges: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Halves of ``nodes`` (a mask) with few edges (pairs of positions) between them."""
    n = len(nodes)
    a, b = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    v = rng.standard_normal(n)
    for _ in range(60):   # towards the second eigenvector of the walk on the graph
        v = (v + np.bincount(a, v[b], n) / degree) / 2
        v -= (v * degree).sum() / degree.sum()
        v /= np.sqrt((v * v).sum()) or 1
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[n // 2:]] = True
    for _ in range(10):
        gain = np.bincount(a, np.where(side[a] != side[b], 1.0, -1.0), n)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        swaps = int((gain[left[:m]] + gain[right[:m]] > 0).sum()) // 2
        if not swaps:
            break
        before, trial = (side[a] != side[b]).sum(), side.copy()
        trial[left[:swaps]], trial[right[:swaps]] = True, False
        if (trial[a] != trial[b]).sum() >= before:
            break
        side = trial
    return side


def partition(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Balanced partition labels of the graph's nodes; ``parts`` is a power of two."""
    label = np.zeros(len(graph), np.int64)
    pairs = np.stack([np.repeat(np.arange(len(graph)), graph.shape[1]), graph.reshape(-1)], axis=1)
    size = 1
    while size < parts:
        for p in range(size):
            nodes = np.flatnonzero(label == p)
            place = np.full(len(graph), -1)
            place[nodes] = np.arange(len(nodes))
            inner = place[pairs]
            label[nodes[bisect(nodes, inner[(inner >= 0).all(axis=1)], rng)]] += size
        size *= 2
    return label


class Router:
    """A network with one hidden layer over unit vectors: a probability per partition."""

    def __init__(self, dims: int, parts: int, rng: np.random.Generator):
        self.w = [rng.standard_normal((dims, HIDDEN)) / np.sqrt(dims), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]
        self.mass = 1.0

    def _layers(self, x):
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return h, p / p.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._layers(x)[1]

    def fit(self, x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> None:
        m = [[np.zeros_like(w), np.zeros_like(w)] for w in self.w]
        step = 0
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                step += 1
                h, p = self._layers(x[rows])
                d = (p - target[rows]) / len(rows)
                back = (d @ self.w[2].T) * (h > 0)
                for w, g, (m1, m2) in zip(self.w, (x[rows].T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0)), m):
                    m1 += 0.1 * (g - m1)
                    m2 += 0.001 * (g * g - m2)
                    w -= RATE * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)

    def routes(self, x: np.ndarray) -> list[np.ndarray]:
        """Per row its most probable partitions, as many as reach the mass."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        upto = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
        count = np.minimum((upto < self.mass - 1e-12).sum(axis=1) + 1, p.shape[1])
        return [o[:c] for o, c in zip(order, count)]


def learn(x: np.ndarray, parts: int, k: int, target: float = TARGET_RECALL, seed: int = 5) -> Router:
    """Partitions and router from sample vectors (rows of one length)."""
    rng = np.random.default_rng(seed)
    router = Router(x.shape[1], parts, rng)
    if len(x) < 2 or parts < 2:
        return router
    x = unit(x)
    graph = neighbour_graph(x, NEIGHBOURS)
    label = partition(graph, parts, rng)
    share = np.stack([(label[graph] == p).mean(axis=1) for p in range(parts)], axis=1)
    router.fit(x, (share + np.eye(parts)[label]) / 2, rng)
    home = router.probabilities(x).argmax(axis=1)
    test = rng.choice(len(x), min(400, len(x)), replace=False)
    near = home[neighbour_graph(x, k)[test]]
    for mass in (0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.925, 0.95, 0.97, 0.98, 0.99, 0.995, 0.999, 1.0):
        router.mass = mass
        if np.mean([np.isin(f, r).mean() for f, r in zip(near, router.routes(x[test]))]) >= target:
            break
    return router


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows; equal rows give equal numbers."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def _place(router: Router, all_routes: bool):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_matrix(batch.column("v")))
            parts = router.routes(x) if all_routes else [[p] for p in router.probabilities(x).argmax(axis=1)]
            take = pa.array(np.repeat(np.arange(len(x)), list(map(len, parts))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("row", "id", "v")), pa.array(np.concatenate(parts), pa.int32())], names=["row", "id", "v", "part"])
    return run


def _compare(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and rows.num_rows:
            qid, rid, qrow, rrow = queries["id"].to_numpy(), rows["id"].to_numpy(), queries["row"].to_numpy(), rows["row"].to_numpy()
            q, r = _matrix(queries["v"]), _matrix(rows["v"])
            uq, ur = unit(q), unit(r)
            for at in range(0, len(q), 512):
                s = uq[at:at + 512] @ ur.T
                s[qrow[at:at + 512, None] == rrow[None, :]] = -np.inf
                n = min(k, len(r))
                bar = -np.partition(-s, n - 1, axis=1)[:, n - 1]
                for i in range(len(s)):
                    near = np.flatnonzero(s[i] >= max(bar[i] - 1e-9, -2))
                    if len(near):
                        score = cosines(np.broadcast_to(q[at + i], (len(near), q.shape[1])), r[near])
                        best = np.lexsort((rid[near], -score))[:k]
                        out.append((np.full(len(best), qrow[at + i]), np.full(len(best), qid[at + i]), rrow[near][best], rid[near][best], score[best]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 5
        kinds = [pa.int64()] * 4 + [pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["row", "query_id", "found", "vec_id", "score"])
    return run


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which
    ``is_query(id)`` holds, among all rows but its own."""
    usable = F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)")
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null and v is not null").filter(usable)
    dims = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    good = good.filter(F.size("v") == (dims["d"] if dims else 0))
    total = dims["count"] if dims else 0
    sample = good.withColumn("h", F.md5(F.col("id").cast("string"))).orderBy("h", "v").limit(sample_rows).collect()   # bounded by sample_rows
    parts = 1
    while parts < min(MAX_PARTITIONS, max(8, total / ROWS_PER_PARTITION), len(sample) / 32):
        parts *= 2
    router = learn(np.array([r["v"] for r in sample], np.float64).reshape(len(sample), dims["d"] if dims else 1), parts, k)

    placed = "row bigint, id bigint, v array<double>, part int"
    # numbered in the staged table: a row's number stays whatever is computed again
    rows = materialize(good.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_place(router, False), placed), "ann-rows")
    sizes = {r["part"]: -(-r["count"] // BLOCK_ROWS) for r in rows.groupBy("part").count().collect()}   # one row per partition
    asked = rows.filter(is_query(F.col("id"))).drop("part")
    groups = max(1, -(-asked.count() // QUERY_ROWS))
    blocks = F.coalesce(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("part")], F.lit(0)) if sizes else F.lit(0)
    key = ["part", "block", "qgroup"]
    table = (rows.withColumn("block", F.pmod(F.xxhash64("row"), blocks).cast("int"))
             .withColumn("qgroup", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))).groupBy(*key)
    found_schema = "row bigint, query_id bigint, found bigint, vec_id bigint, score double"

    def compared(queries: DataFrame) -> DataFrame:
        queries = (queries.withColumn("qgroup", F.pmod(F.hash("row"), F.lit(groups))).filter(blocks > 0)
                   .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))))
        return queries.groupBy(*key).cogroup(table).applyInArrow(_compare(k), found_schema)

    def first(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "found")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    asked = materialize(asked, "ann-queries")
    best = materialize(first(compared(asked.mapInArrow(_place(router, True), placed))), "ann-found")
    enough = best.filter(F.col("rank") >= min(k, max(0, total - 1))).select("row").distinct()
    short = asked.join(enough, "row", "left_anti") if total > 1 else asked.limit(0)
    if not short.isEmpty():
        everywhere = short.withColumn("part", F.explode(F.array(*[F.lit(p) for p in sizes])))
        best = first(compared(everywhere).union(best.join(enough, "row", "left_semi").drop("rank")))
    return best.select("query_id", "rank", "vec_id", "score")
