"""Approximate nearest neighbours by learned partitions.

On a bounded sample of the vectors (``SAMPLE``, by a digest of the vector) the exact neighbour graph is
built and cut into ``PARTS`` parts of equal size, moving vertices to the part that holds most of their
neighbours. A small network (one hidden layer) learns the parts of a vector's neighbours. It places
every vector in its most probable part and sends each query to several: the number of parts is the
least that reaches ``RECALL`` on sample vectors left out of the fit. Candidates are reranked exactly.

Parts are cut into blocks of at most ``BLOCK`` rows and queries into blocks of their own; each block
pair returns at most k rows a query, so neither a hot part nor a frequent vector gathers in one task.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite component take no part;
vectors of another length than the commonest are searched exactly, among those of their length; equal
distances go by smaller vec_id (null last); repeated rows are candidates of their own (a query excludes
only its own row); with fewer than k candidates all are returned; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from logmill.llm.common import batched, per_batch, stored

SAMPLE, LEFT_OUT, PARTS, HIDDEN, BLOCK, RECALL = 8_192, 512, 32, 128, 4_096, 0.97
DEGREE, K = 10, 10
FOUND = "query_row bigint, query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("vector"))
        .filter(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
        .withColumn("dim", F.size("vector"))
    )


def _nearest(queries: np.ndarray, base: np.ndarray, k: int, skip_own: bool = False) -> np.ndarray:
    out = np.empty((len(queries), k), np.int64)
    for a in range(0, len(queries), 512):
        d = (base**2).sum(1) - 2 * queries[a : a + 512] @ base.T
        if skip_own:
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, start: np.ndarray, parts: int) -> np.ndarray:
    """A part for each vertex of the neighbour graph (rows of vertex numbers), none above its share by
    more than five in a hundred. Vertices first take their place in ``start`` order (cut evenly), then
    move, in rounds, to the part that holds most of their neighbours and has room."""
    n = len(graph)
    part = np.empty(n, np.int64)
    part[start] = np.arange(n) * parts // n
    room = int(np.ceil(1.05 * n / parts))
    both = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()]),
                           np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])], axis=1)
    for _ in range(20):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (both[0], part[both[1]]), 1)
        size = np.bincount(part, minlength=parts)
        gain = votes.max(1) - votes[np.arange(n), part]
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            for p in np.argsort(-votes[v], kind="stable")[:4]:
                if votes[v, p] <= votes[v, part[v]]:
                    break
                if size[p] < room:
                    size[part[v]] -= 1
                    size[p] += 1
                    part[v] = p
                    moved += 1
                    break
        if moved < n // 200:
            break
    return part


@dataclass
class Router:
    """A small network over scaled vectors; ``probes`` parts are searched for a query."""

    dim: int
    mean: np.ndarray
    scale: float
    weights: tuple[np.ndarray, ...]
    probes: int = 1

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the parts."""
        w1, b1, w2, b2 = self.weights
        return np.maximum((x - self.mean) * self.scale @ w1 + b1, 0) @ w2 + b2


def trained(x: np.ndarray, soft: np.ndarray, hidden: int = HIDDEN, rounds: int = 60) -> Router:
    """Adam on cross entropy against the neighbours' shares of the parts."""
    rng = np.random.default_rng(7)
    mean = x.mean(0)
    scale = float(1 / max((x - mean).std(), 1e-12))
    z = (x - mean) * scale
    weights = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden),
               rng.normal(0, (2 / hidden) ** 0.5, (hidden, soft.shape[1])), np.zeros(soft.shape[1])]
    m, s, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(rounds):
        order = rng.permutation(len(z))
        for a in range(0, len(z), 256):
            rows = order[a : a + 256]
            h = np.maximum(z[rows] @ weights[0] + weights[1], 0)
            out = h @ weights[2] + weights[3]
            p = np.exp(out - out.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - soft[rows]) / len(rows)
            gh = (g @ weights[2].T) * (h > 0)
            t += 1
            for k, slope in enumerate((z[rows].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * slope
                s[k] = 0.999 * s[k] + 0.001 * slope**2
                weights[k] -= 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return Router(x.shape[1], mean, scale, tuple(weights))


def fit(vectors: DataFrame, sample: int = SAMPLE, parts: int = PARTS, recall: float = RECALL, k: int = K) -> Router | None:
    """The router of the commonest vector length; null if there are no vectors."""
    sizes = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return None
    dim, count = sizes
    own = vectors.filter(F.col("dim") == dim)
    share = min(1.0, sample / count)
    rows = own.filter(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < share * (1 << 30)).select("vector").distinct().limit(2 * sample).toPandas()
    x = np.array(rows["vector"].tolist(), np.float64).reshape(-1, dim)
    x = x[np.lexsort(x.T[::-1])][np.random.default_rng(3).permutation(len(x))]
    held, x = x[: min(LEFT_OUT, len(x) // 8)], x[min(LEFT_OUT, len(x) // 8) :]
    parts = max(1, min(parts, len(x) // (4 * DEGREE)))
    if parts == 1:
        return Router(dim, np.zeros(dim), 1.0, (np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)))
    graph = _nearest(x, x, DEGREE, skip_own=True)
    # a first order of the vertices: by the main direction of the whole, then of each half, and so on
    order = [np.arange(len(x))]
    while len(order) < parts:
        halves = []
        for rows_ in order:
            z = x[rows_] - x[rows_].mean(0)
            along = z @ np.linalg.svd(z[:2_000], full_matrices=False)[2][0]
            rank = rows_[np.argsort(along, kind="stable")]
            halves += [rank[: len(rank) // 2], rank[len(rank) // 2 :]]
        order = halves
    part = balanced_parts(graph, np.concatenate(order), parts)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.repeat(np.arange(len(x)), DEGREE), part[graph].ravel()), 1 / (DEGREE + 2))
    soft[np.arange(len(x)), part] += 2 / (DEGREE + 2)
    router = trained(x, soft)
    if len(held) and len(x) > k:
        home = router.ranked(x).argmax(1)
        true = home[_nearest(held, x, k)]
        rank = np.argsort(np.argsort(-router.ranked(held), axis=1), axis=1)
        deep = np.take_along_axis(rank, true, axis=1)
        router.probes = next(m for m in range(1, parts + 1) if (deep < m).mean() >= recall or m == parts)
    return router


def _search(queries: pd.DataFrame, base: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of the block for each query, by exact double distances, ties by vec_id."""
    out = []
    if len(queries) and len(base):
        x = np.array(base["vector"].tolist(), np.float64)
        ids = base["vec_id"].astype("Int64").fillna(np.iinfo(np.int64).max).to_numpy(np.int64)
        null = base["vec_id"].isna().to_numpy()
        row = base["row"].to_numpy()
        square = (x**2).sum(1)
        for own, name, v in zip(queries["query_row"], queries["query_id"], queries["query"]):
            q = np.array(v, np.float64)
            rough = square - 2 * (x @ q) + q @ q
            rough[row == own] = np.inf
            at = min(k, len(x)) - 1
            # all within rounding of the k-th are compared exactly
            near = np.flatnonzero(rough <= np.partition(rough, at)[at] + 1e-9 * (square.max() + q @ q))
            near = near[row[near] != own]
            score = np.sqrt(((x[near] - q) ** 2).sum(1))
            for j in np.lexsort((ids[near], score))[:k]:
                out.append((own, name, None if null[near[j]] else ids[near[j]], score[j]))
    return pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "score"]).astype(
        {"query_row": "int64", "query_id": "Int64", "vec_id": "Int64", "score": "float64"}
    )


def search(vectors: DataFrame, is_query, k: int = K, router: Router | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row that ``is_query`` (a condition on
    vec_id) selects, among all other rows."""
    spark = batched(vectors.sparkSession)
    rows = stored(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    router = router or fit(rows, k=k)

    def place(batch: pa.RecordBatch) -> dict:
        dim = batch.column("dim").to_numpy(zero_copy_only=False)
        odds = np.zeros((len(dim), router.weights[3].size))
        own = np.flatnonzero(dim == router.dim)
        if len(own):
            flat = batch.column("vector").take(pa.array(own)).flatten().to_numpy(zero_copy_only=False)
            odds[own] = router.ranked(flat.reshape(-1, router.dim))
        ranked = np.argsort(-odds, axis=1, kind="stable").astype(np.int32)
        ranked[dim != router.dim] = 0
        return {**{c: batch.column(c) for c in ("vec_id", "vector", "dim", "row")}, "parts": list(ranked)}

    if router is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    placed = stored(per_batch(rows, place, "vec_id bigint, vector array<double>, dim int, row bigint, parts array<int>"), "parts")
    base = placed.select("vec_id", "vector", "dim", "row", F.element_at("parts", 1).alias("part"))
    held = dict(base.filter(F.col("dim") == router.dim).groupBy("part").count().collect())  # a row per part
    size = F.array(*(F.lit(held.get(p, 0)).cast("bigint") for p in range(router.weights[3].size)))

    def before(i):
        """Rows in the parts ahead of the i-th most probable one."""
        return F.aggregate(F.slice("parts", 1, i), F.lit(0).cast("bigint"), lambda a, p: a + F.get(size, p))

    # the most probable parts, and more of them while these hold too few rows
    probed = F.array_distinct(F.filter("parts", lambda p, i: (i < router.probes) | (before(i) <= k)))
    asked = placed.filter(is_query).select(
        F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "vector", "dim", F.explode(probed).alias("part")
    )

    def blocks(of: DataFrame, name: str) -> DataFrame:
        return of.groupBy("dim", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    cuts = blocks(base, "blocks").join(blocks(asked, "query_blocks"), ["dim", "part"])

    def dealt(of: DataFrame, row: str, own: str, other: str) -> DataFrame:
        """Each row in one block of its own side, against every block of the other."""
        one = F.pmod(F.xxhash64(row), F.col(own)).cast("int").alias(own)
        return of.join(cuts, ["dim", "part"]).select(
            *of.columns, one, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
        )

    keys = ["dim", "part", "blocks", "query_blocks"]
    sought = dealt(asked, "query_row", "query_blocks", "blocks").select(
        "query_row", "query_id", F.col("vector").alias("query"), *(F.col(c).alias(f"{c}_") for c in keys)
    )
    found = (
        dealt(base, "row", "blocks", "query_blocks").groupBy(*keys).cogroup(sought.groupBy(*(f"{c}_" for c in keys)))
        .applyInPandas(lambda b, q: _search(q, b, k), FOUND)
    )
    order = Window.partitionBy("query_row").orderBy("score", F.col("vec_id").asc_nulls_last())
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
