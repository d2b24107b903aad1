"""Connected components by alternating large and small stars, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges (a, b: long) but the roots; root is the smallest node reached.

    Each round hangs a node's larger neighbours, then its smaller ones, under the smallest
    it knows; the number of rounds grows with the square of the logarithm of the nodes at
    most. Every round is written to the shared folder. No group is collected: minima are partial sums,
    and the joins have both sides shuffled, so a large star can be split.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = Stored(edges.where(F.col("a") != F.col("b")).select(u, v).distinct())
    while True:
        # done when each node has one neighbour, which is nobody's node: then all are (node, root)
        ends = now.df.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(now.df.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        open_ = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out > 0 and in > 0)")
        if open_.isEmpty():
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, Stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        last.drop()
