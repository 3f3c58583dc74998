"""Approximate nearest neighbours: learned partitions.

A bounded sample's neighbour graph is cut into equal parts with few edges between them; a small network learns to tell a
vector's part, and the parts of its neighbours, from the vector. Every row is filed under its most probable part. A query
goes to its several most probable parts, whose rows are all compared with it. How many parts a query visits is set on the
sample, so that the sample's own searches find TARGET of what brute force finds.

Parts are dealt out in blocks of bounded size on both sides, so a part that holds a third of all rows is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mailglass.llm.common import cut


@dataclass(frozen=True)
class Settings:
    """sample: most rows the graph and the network are fitted on. block: most rows of a part in one task, on either side."""

    sample: int = 8192
    graph_k: int = 16
    hidden: int = 128
    epochs: int = 40
    target: float = 0.97
    block: int = 16384
    seed: int = 3


@dataclass(frozen=True)
class Router:
    """A network of one hidden layer; probes: parts a query visits."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def top_rows(q: np.ndarray, x: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """For each row of q the indexes of the k rows of x of largest inner product, without its own."""
    out = []
    for a in range(0, len(q), 128):
        s = q[a : a + 128] @ x.T
        if own is not None:
            s[np.arange(len(s)), own[a : a + 128]] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def bisect(nodes: np.ndarray, src: np.ndarray, dst: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A half of `nodes` (True) such that few of the edges cross: the graph's second eigenvector, cut at its median, then
    swaps of pairs as long as they save edges."""
    n = len(nodes)
    degree = np.bincount(src, minlength=n) + 1.0
    root = np.sqrt(degree)
    first = root / np.linalg.norm(root)
    v = rng.standard_normal(n)
    for _ in range(40):
        v -= first * (first @ v)
        u = v / root
        v = (np.bincount(src, u[dst], n) + u) / root + v
        v /= np.linalg.norm(v) + 1e-300
    side = np.zeros(n, bool)
    side[np.argsort(v / root, kind="stable")[n // 2 :]] = True
    for _ in range(20):
        cross = side[src] != side[dst]
        gain = np.bincount(src, np.where(cross, 1.0, -1.0), n)
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        good = int((gain[a[:m]] + gain[b[:m]] > 0).sum())
        if not good:
            break
        swap = max(1, good // 4)
        trial = side.copy()
        trial[a[:swap]], trial[b[:swap]] = True, False
        if (trial[src] != trial[dst]).sum() >= cross.sum():
            break
        side = trial
    return side


def partition_graph(near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each node of the neighbour graph, all parts equally large (to one)."""
    n, k = near.shape
    src, dst = np.repeat(np.arange(n), k), near.ravel()
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    part = np.zeros(n, np.int64)
    size = 1
    while size < parts:
        new = part * 2
        for p in range(size):
            nodes = np.flatnonzero(part == p)
            local = np.full(n, -1)
            local[nodes] = np.arange(len(nodes))
            keep = (local[src] >= 0) & (local[dst] >= 0)
            if len(nodes) > 1:
                new[nodes] += bisect(nodes, local[src[keep]], local[dst[keep]], rng)
        part, size = new, size * 2
    return part


def train_router(x: np.ndarray, targets: np.ndarray, s: Settings, rng: np.random.Generator) -> Router:
    """Adam on cross entropy against the parts of each row and its neighbours."""
    d, p = x.shape[1], targets.shape[1]
    w = [rng.standard_normal((d, s.hidden)) * np.sqrt(2 / d), np.zeros(s.hidden), rng.standard_normal((s.hidden, p)) * np.sqrt(1 / s.hidden), np.zeros(p)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    t = 0
    for _ in range(s.epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            i = order[a : a + 256]
            h = np.maximum(x[i] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            e = (q / q.sum(axis=1, keepdims=True) - targets[i]) / len(i)
            back = (e @ w[2].T) * (h > 0)
            t += 1
            for j, g in enumerate((x[i].T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0))):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                w[j] -= 0.003 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return Router(*w, probes=p)


def fit(x: np.ndarray, rows: int, k: int, s: Settings) -> Router:
    """The router for a table of `rows` rows, from a sample x. The number of parts grows with the square root of rows."""
    rng = np.random.default_rng(s.seed)
    n, d = x.shape
    parts = 1
    while parts < min(256, np.sqrt(rows) / 4) and 32 * parts <= n:
        parts *= 2
    if parts == 1:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    near = top_rows(x, x, min(s.graph_k, n - 1), np.arange(n))
    part = partition_graph(near, parts, rng)
    targets = np.zeros((n, parts))
    np.add.at(targets, (np.arange(n)[:, None], part[near]), 1.0)
    targets[np.arange(n), part] += 2
    router = train_router(x, targets / targets.sum(axis=1, keepdims=True), s, rng)
    # Probes: the fewest with which the sample's searches reach the target.
    filed = router.scores(x).argmax(axis=1)
    ask = rng.permutation(n)[:512]
    want = filed[top_rows(x[ask], x, min(k, n - 1), ask)]
    rank = np.argsort(np.argsort(-router.scores(x[ask]), axis=1, kind="stable"), axis=1)
    found = np.take_along_axis(rank, want, axis=1)
    recall = [(found < p).mean() for p in range(1, parts + 1)]
    probes = next(p for p, r in enumerate(recall, 1) if r >= s.target or p == parts)
    return Router(router.w1, router.b1, router.w2, router.b2, probes)


def usable(c: str) -> Column:
    """The vector has no null or non-finite component and is not zero."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(c).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(c, lambda x: x != 0), F.lit(False))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of q and x in a fixed order of addition, so that equal vectors score equally."""
    return np.einsum("ij,ij->i", q, x)


def _first_ids(copy: np.ndarray, vid: np.ndarray, nth: np.ndarray, k: int) -> np.ndarray:
    """Rows that stay: the first of equal vectors in order of id. Rows of one id count as often as they come, so where ids
    repeat all rows stay."""
    if len(np.unique(vid)) < len(vid):
        return np.arange(len(vid))
    return np.flatnonzero(nth <= k)


def best_of_block(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score: each query's k best rows of a block, ties to the smaller id."""
    order = np.argsort(vid, kind="stable")
    vid, x = vid[order], np.ascontiguousarray(x[order]) + 0.0
    # Of equal vectors only the k + 1 smallest ids can be among a query's k best (one may be its own), so more need not be
    # looked at, however many copies there are.
    copy = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    by_copy = np.argsort(copy, kind="stable")
    nth = np.empty(len(copy), np.int64)
    nth[by_copy] = np.arange(len(copy)) - np.searchsorted(copy[by_copy], copy[by_copy])
    some = _first_ids(copy, vid, nth, k)
    vid, x = vid[some], x[some]
    out: list[tuple] = []
    for a in range(0, len(q), 256):
        s = q[a : a + 256] @ x.T
        s[qid[a : a + 256, None] == vid[None, :]] = -np.inf
        if len(vid) > k:
            edge = np.partition(s, len(vid) - k, axis=1)[:, len(vid) - k]
            # A margin for the last digits; among equal vectors, the smallest ids come first and k of them suffice.
            close = s >= (edge - 1e-9 * np.maximum(1.0, np.abs(edge)))[:, None]
        else:
            close = np.ones(s.shape, bool)
        close &= s > -np.inf
        i, j = np.nonzero(close)
        score = exact_scores(q[a + i], x[j])
        o = np.lexsort((vid[j], -score, i))
        i, j, score = i[o], j[o], score[o]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        out.append((qid[a + i[keep]], vid[j[keep]], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


ROUTED = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("is_query", T.BooleanType()), T.StructField("vec", T.BinaryType())])
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def search(vectors: DataFrame, is_query: Column, k: int = 20, settings: Settings = Settings(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest inner product found for each query, in doubles.

    Queries are the rows where `is_query` holds; candidates are all rows but those of the query's id. Vectors that are
    null, zero, or hold a null or non-finite component, rows without an id, and vectors of another length than most of the
    sample take no part. Ties go to the smaller id. A query with fewer candidates returns them all. Other columns are not
    read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.filter(usable("v") & F.col("vec_id").isNotNull())
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if size is None:
        return empty
    rows = rows.filter(F.size("v") == size["d"])
    sample = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample).toArrow()
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in sample["v"].chunks]).reshape(sample.num_rows, -1)
    router = spark.sparkContext.broadcast(fit(x, size["count"], k, settings))
    probes = router.value.probes

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = router.value
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            order = np.argsort(-r.scores(x), axis=1, kind="stable")
            raw = [v.tobytes() for v in x]
            ask = np.flatnonzero(np.asarray(b.column(2)))
            ids = b.column(0).to_numpy()
            for i, parts, flag in ((np.arange(len(x)), order[:, 0], False), (np.repeat(ask, probes), order[ask, :probes].ravel(), True)):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(parts.astype(np.int32)), pa.array([flag] * len(i), pa.bool_()), pa.array([raw[j] for j in i], pa.binary())], names=ROUTED.names)

    routed = cut(rows.mapInArrow(route, ROUTED))
    block = settings.block
    # Blocks of each part, on both sides; a row per part.
    sizes = routed.groupBy("part").agg(F.ceil(F.sum((~F.col("is_query")).cast("int")) / block).alias("c"), F.ceil(F.sum(F.col("is_query").cast("int")) / block).alias("q")).filter("c > 0 and q > 0")
    at = routed.join(F.broadcast(sizes), "part").withColumn("h", F.abs(F.xxhash64("vec_id", "vec")))
    cand = at.filter("not is_query").select(F.col("part").alias("c_part"), (F.col("h") % F.col("c")).alias("cb"), F.explode(F.expr("sequence(0L, q - 1)")).alias("qb"), F.col("vec_id").alias("c_id"), F.col("vec").alias("c_vec"))
    ask = at.filter("is_query").select("part", F.explode(F.expr("sequence(0L, c - 1)")).alias("cb"), (F.col("h") % F.col("q")).alias("qb"), "vec_id", "vec")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        to = lambda c: np.frombuffer(b"".join(c.to_pylist())).reshape(len(c), -1)
        got = best_of_block(left["vec_id"].to_numpy(), to(left["vec"]), right["c_id"].to_numpy(), to(right["c_vec"]), k)
        return pa.table(dict(zip(FOUND.names, map(pa.array, got), strict=True)))

    cand = cand.toDF("c_part", "c_cb", "c_qb", "c_id", "c_vec")
    found = ask.groupBy("part", "cb", "qb").cogroup(cand.groupBy("c_part", "c_cb", "c_qb")).applyInArrow(meet, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
