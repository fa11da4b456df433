"""Approximate nearest neighbours by learned partitions.

On a bounded sample the graph of nearest neighbours is cut into balanced parts with few edges between
them, and a small network learns a vector's part from the parts of its neighbours. The network
assigns every row to its most probable part, and routes a query to the few most probable ones,
where exact distances rank the rows. How many parts a query needs is measured on the sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import hashed_sample, stored

#: Rows that the parts are learned from, chosen by a hash of the vector and its id.
SAMPLE = 4096
NEIGHBOURS, HIDDEN, EPOCHS, RATE, BATCH = 10, 128, 40, 3e-3, 128
#: Sampled rows for each part at least, and the sampled queries' recall that sets the parts searched.
ROWS_A_PART, RECALL = 32, 0.98
#: Rows, and queries, of a part that meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    out, norms = np.empty((len(x), k), np.int64), (x * x).sum(1)
    for at in range(0, len(x), 512):
        far = norms - 2 * x[at:at + 512] @ x.T
        far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        out[at:at + 512] = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)
    return out


def _bisected(a: np.ndarray, b: np.ndarray, n: int, left: int, seed: int) -> np.ndarray:
    """Which `left` of n nodes go left: a slow vector of the random walk over the edges a-b, cut at its
    quantile, then pairs swapped while that takes edges off the cut."""
    rng = np.random.default_rng(seed)
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    v = rng.standard_normal(n)
    for _ in range(150):
        v = v - (v * degree).sum() / degree.sum()
        v = (v + np.bincount(a, v[b], n) / degree) / 2
        v /= np.linalg.norm(v) or 1.0
    side = np.ones(n, bool)
    side[np.argsort(v, kind="stable")[:left]] = False
    for _ in range(20):
        across = np.bincount(a, side[a] != side[b], n)
        gain = 2 * across - np.bincount(a, minlength=n)
        zero, one = (np.flatnonzero(side == s) for s in (False, True))
        zero, one = zero[np.argsort(-gain[zero], kind="stable")], one[np.argsort(-gain[one], kind="stable")]
        m = min(len(zero), len(one), max(1, n // 50))
        better = gain[zero[:m]] + gain[one[:m]] > 2
        if not better.any():
            break
        after = side.copy()
        after[zero[:m][better]], after[one[:m][better]] = True, False
        if np.count_nonzero(after[a] != after[b]) >= np.count_nonzero(side[a] != side[b]):
            break
        side = after
    return side


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 1) -> np.ndarray:
    """A part for each node; parts are equal but for one node."""
    n = len(graph)
    a = np.repeat(np.arange(n), graph.shape[1])
    a, b = np.concatenate([a, graph.ravel()]), np.concatenate([graph.ravel(), a])
    out = np.zeros(n, np.int64)

    def cut(nodes: np.ndarray, first: int, k: int) -> None:
        if k == 1 or not len(nodes):
            out[nodes] = first
            return
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        inside = (place[a] >= 0) & (place[b] >= 0)
        side = _bisected(place[a[inside]], place[b[inside]], len(nodes), round(len(nodes) * (k // 2) / k), seed + first + k)
        cut(nodes[~side], first, k // 2)
        cut(nodes[side], first + k // 2, k - k // 2)

    cut(np.arange(n), 0, parts)
    return out


@dataclass(frozen=True)
class Router:
    """A network of one hidden layer from vectors to their parts."""

    mean: np.ndarray
    scale: float
    layers: tuple[np.ndarray, ...]
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) * self.scale @ w1 + b1, 0) @ w2 + b2

    def best(self, x: np.ndarray, k: int) -> np.ndarray:
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :k]


def _trained(x: np.ndarray, wanted: np.ndarray, seed: int = 2) -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], wanted.shape[1]
    layers = [rng.standard_normal((d, HIDDEN)) * (2 / d) ** 0.5, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * HIDDEN**-0.5, np.zeros(parts)]
    m, v, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            some, goal = x[order[at:at + BATCH]], wanted[order[at:at + BATCH]]
            hidden = np.maximum(some @ layers[0] + layers[1], 0)
            out = hidden @ layers[2] + layers[3]
            p = np.exp(out - out.max(1, keepdims=True))
            error = (p / p.sum(1, keepdims=True) - goal) / len(some)
            back = (error @ layers[2].T) * (hidden > 0)
            step += 1
            for i, g in enumerate((some.T @ back, back.sum(0), hidden.T @ error, error.sum(0))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                layers[i] -= RATE * (1 - epoch / EPOCHS) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(layers)


def learn(x: np.ndarray, parts: int) -> Router:
    """The router for a sample of vectors; one part where the sample is too small to cut."""
    mean = x.mean(0)
    scale = 1 / (x.std() or 1.0)
    k = min(NEIGHBOURS, len(x) - 1)
    if parts < 2 or k < 1:
        d = x.shape[1]
        return Router(mean, scale, (np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1)
    graph = neighbour_graph(x, k)
    part = balanced_parts(graph, parts)
    wanted = np.zeros((len(x), parts))
    np.add.at(wanted, (np.repeat(np.arange(len(x)), k), part[graph].ravel()), 0.5 / k)
    wanted[np.arange(len(x)), part] += 0.5
    router = Router(mean, scale, _trained((x - mean) * scale, wanted), parts)
    ranks = router.best(x, parts)
    held = ranks[:, 0]  # where rows are indexed
    place = np.empty_like(ranks)
    np.put_along_axis(place, ranks, np.arange(parts)[None, :].repeat(len(x), 0), 1)
    needed = np.sort(np.take_along_axis(place, held[graph], 1).ravel()) + 1
    return Router(mean, scale, router.layers, int(needed[int(np.ceil(RECALL * len(needed))) - 1]))


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks]
    return np.concatenate([np.zeros(0), *flat]).astype(np.float64).reshape(-1, d)


def _ranked(k: int, d: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def rank(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        x, ids = _matrix(rows.column("vector"), d), rows.column("vec_id").to_numpy()
        q, asked = _matrix(queries.column("query"), d), queries.column("query_id").to_numpy()
        norms = (x * x).sum(1)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(q), 64):
            some = q[at:at + 64]
            sizes = (some * some).sum(1)[:, None]
            far = norms + sizes - 2 * some @ x.T
            for i, query in enumerate(asked[at:at + 64]):
                far[i, ids == query] = np.inf
                mine = far[i]
                # what rounding could put among the first k is measured exactly
                last = np.partition(mine, min(k, len(mine)) - 1)[min(k, len(mine)) - 1]
                near = np.flatnonzero(mine <= last + 1e-9 * (sizes[i, 0] + norms.max())) if np.isfinite(last) else np.flatnonzero(np.isfinite(mine))
                exact = np.sqrt(((x[near] - some[i]) ** 2).sum(1))
                best = np.lexsort((ids[near], exact))[:k]
                out.append((np.full(len(best), query), ids[near][best], exact[best]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    return rank


def nearest(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of the k nearest rows found for
    each query, nearest first and ties by the smaller vec_id, of vectors(vec_id, embedding).

    Queries are the rows where `is_query` holds. Rows whose vector is null, zero, or has a null or
    non-finite component take no part, nor do rows with a null vec_id or a vector of another length
    than most have. A query never finds its own vec_id; other repeated rows are found like any, and a
    repeated query asks once. A query gets k rows wherever the table has as many of other ids: it goes
    on along its ranked parts until they hold them. A table without usable rows gives an empty result;
    other columns are ignored. Every row is indexed;
    rows and queries meet in blocks of bounded size, so a part of any share of the rows is split."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").head()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = lengths
    rows = rows.filter(F.size("vector") == d)
    x = np.array([r.vector for r in sorted(hashed_sample(rows.select("vec_id", "vector"), SAMPLE, "vec_id", "vector"))])
    router = learn(x, max(1, min(round(n**0.5 / 4), len(x) // ROWS_A_PART)))

    def routed(batches):
        for batch in batches:
            part = router.best(_matrix(batch.column("vector"), d), 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "vector", "asks")), pa.array(part.astype(np.int32))], ["vec_id", "vector", "asks", "part"])

    index = stored(rows.mapInArrow(routed, "vec_id long, vector array<double>, asks boolean, part int"), "ann-index")
    # a number a part, and no more parts than SAMPLE allows
    sizes = np.zeros(router.layers[3].size, np.int64)
    for r in index.groupBy("part").count().collect():
        sizes[r["part"]] = r["count"]

    def probed(batches):
        """A query searches its most probable parts: so many as the recall needs, and on until they hold k rows of other ids."""
        for batch in batches:
            ranks = router.best(_matrix(batch.column("query"), d), len(sizes))
            before = np.cumsum(sizes[ranks], 1) - sizes[ranks]
            searched = (np.arange(len(sizes)) < router.probes) | (before < k + batch.column("own").to_numpy()[:, None])
            parts = pa.array([r[s].tolist() for r, s in zip(ranks, searched)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("query"), parts], ["query_id", "query", "parts"])

    asking = index.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")).distinct()
    own = index.join(asking.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").groupBy(F.col("vec_id").alias("query_id")).agg(F.count(F.lit(1)).alias("own"))
    queries = stored(asking.join(own, "query_id").mapInArrow(probed, "query_id long, query array<double>, parts array<int>"), "ann-queries")
    queries = queries.select("query_id", "query", F.explode("parts").alias("part"))
    held = index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("row_blocks"))
    wanted = queries.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("query_blocks"))
    # one row a part, and no more parts than SAMPLE allows
    blocks = F.broadcast(held.join(wanted, "part"))

    def dealt(df: DataFrame, own: str, others: str, *columns: str) -> DataFrame:
        """Each row to one block of its own kind, and to all of the other kind."""
        mine = F.pmod(F.xxhash64(*columns), F.col(own)).cast("int").alias(own[:-1])
        return df.join(blocks, "part").select(*columns, F.col("part").alias("part"), mine, F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(others[:-1]))

    key = ["part", "row_block", "query_block"]
    left = dealt(index, "row_blocks", "query_blocks", "vec_id", "vector").groupBy(*key)
    right = dealt(queries, "query_blocks", "row_blocks", "query_id", "query").groupBy(*key)
    found = left.cogroup(right).applyInArrow(_ranked(k, d), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
