"""Approximate nearest neighbours by collision counting (query-aware hashing).

Each vector has `PROJECTIONS` random projections. The index is, for each part of the rows,
one array of values in order for each projection. A query opens a window around its own
value in every array; the windows of radius r, r * GROWTH, ... stand for one hash function
of ever wider buckets (virtual rehashing). A vector that lies in the windows of at least
`SHARE` of the projections is verified by its true distance. A query is done with a part
when it has k verified vectors nearer than the radius stands for; otherwise the windows
grow until they hold every row, so a part gives all its rows if k are not found.

A part has about `PART_ROWS` rows (fewer where a table is small). Its rows come to a task first, then every query as a
row: the index is built once a part and its queries pass by one after the other, so a task holds one part,
and the driver nothing. Each part gives at most k rows a query.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do
rows without vec_id. A query meets vectors of its own length only. Rows with the same
vec_id as a query are not its candidates; a repeated query id is asked once, with the
smallest of its vectors. Equal distances go to the smaller vec_id. Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 48
SHARE = 0.6
STOP = 0.9
GROWTH = 1.25
PART_ROWS, FEW_ROWS = 20_000, 500
SEED = 20


def usable(c: str = "embedding") -> Column:
    v = F.col(c)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


class Part:
    """The index over some rows of one length: for each projection, the values in order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by], vectors[by]
        dim = vectors.shape[1]
        self.axes = np.random.default_rng([SEED, dim]).standard_normal((dim, PROJECTIONS))
        p = self.vectors @ self.axes
        self.order = np.argsort(p, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(p.T, self.order, 1)

    def search(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, float]]:
        n = len(self.ids)
        at = q @ self.axes
        least = int(np.ceil(SHARE * PROJECTIONS))
        count = np.zeros(n, np.int16)
        mid = np.array([np.searchsorted(v, x) for v, x in zip(self.values, at)])
        low, high = mid.copy(), mid.copy()
        near = np.full(n, np.inf)
        known = self.ids == query_id
        found = 0
        # the first radius: the median gap to the k-th value around the query
        reach = min(n - 1, max(1, 2 * k))
        ends = np.clip(mid + reach // 2, 0, n - 1)
        radius = max(float(np.median(np.abs(self.values[np.arange(PROJECTIONS), ends] - at))), 1e-12)
        while True:
            whole = True
            for j in range(PROJECTIONS):
                v = self.values[j]
                lo, hi = np.searchsorted(v, at[j] - radius, "left"), np.searchsorted(v, at[j] + radius, "right")
                lo, hi = min(lo, low[j]), max(hi, high[j])
                count[self.order[j, lo : low[j]]] += 1
                count[self.order[j, high[j] : hi]] += 1
                low[j], high[j] = lo, hi
                whole &= lo == 0 and hi == n
            new = np.flatnonzero((count >= least) & ~known)
            if len(new):
                known[new] = True
                near[new] = np.sqrt(((self.vectors[new] - q) ** 2).sum(1))
                found += len(new)
            if whole:
                break
            # a vector at distance STOP * radius is expected to collide in more than SHARE of the projections
            if found >= k and np.partition(near, k - 1)[k - 1] <= radius * STOP:
                break
            radius *= GROWTH
        best = np.flatnonzero(np.isfinite(near))
        if len(best) > k:
            edge = np.partition(near[best], k - 1)[k - 1]
            best = best[near[best] <= edge]
        best = best[np.lexsort((self.ids[best], near[best]))][:k]
        return [(int(self.ids[i]), float(near[i])) for i in best]


def by_length(ids: list[int], vectors: list[np.ndarray]) -> dict[int, Part]:
    size = np.array([len(v) for v in vectors])
    return {int(d): Part(np.array(ids)[size == d], np.stack([v for v, n in zip(vectors, size) if n == d]).astype(float)) for d in np.unique(size)}


def search(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score for each query; rows and queries: vec_id, embedding."""
    spark = rows.sparkSession
    good = rows.where(usable()).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = (
        queries.where(usable()).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
        .groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    )

    n = good.count()
    parts = max(-(-n // PART_ROWS), min(-(-n // FEW_ROWS), spark.sparkContext.defaultParallelism), 1)
    # by place, not by id: rows of one id may be a third of all
    held = good.select(F.pmod(F.monotonically_increasing_id(), F.lit(parts)).alias("part"), F.lit(0).alias("asks"), "vec_id", "embedding")
    sent = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(1).alias("asks"), "vec_id", "embedding")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, ids, vectors, index = None, [], [], None
        for b in batches:
            out = []
            for p, asks, i, v in zip(b["part"].tolist(), b["asks"].tolist(), b["vec_id"].tolist(), b["embedding"]):
                if p != part:
                    part, ids, vectors, index = p, [], [], None
                if not asks:
                    ids.append(i)
                    vectors.append(v)
                    continue
                if index is None:  # the part's last row has come: from here on its queries
                    index = by_length(ids, vectors)
                if len(v) in index:
                    out += [(i, j, d) for j, d in index[len(v)].search(i, np.asarray(v, float), k)]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    both = held.unionByName(sent).repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "asks")
    parts = both.mapInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def stated_queries(rows: DataFrame) -> DataFrame:
    """The rows whose id is divisible by 100."""
    return rows.where(F.col("vec_id") % 100 == 0)
