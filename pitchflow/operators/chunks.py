"""Chunks of time: plans with overlap, tumbling and sliding windows, sessions, late correction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def plan(spans: DataFrame, seconds: float = 30.0, before: float = 0.0, after: float = 0.0) -> DataFrame:
    """Chunks of each row's span [t0, t1): cid, core [c_t0, c_t1) and processed [p_t0, p_t1); the last may be short, the first has nothing before it."""
    n = F.greatest(F.lit(0), F.ceil((F.col("t1") - F.col("t0")) / seconds))
    each = spans.withColumn("cid", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))))
    each = each.withColumn("c_t0", F.col("t0") + F.col("cid") * seconds).withColumn("c_t1", F.least(F.col("c_t0") + seconds, F.col("t1")))
    first = F.when(F.col("cid") == 0, F.col("c_t0")).otherwise(F.greatest(F.col("c_t0") - before, F.col("t0")))
    return each.withColumns({"p_t0": first, "p_t1": F.least(F.col("c_t1") + after, F.col("t1"))}).drop("t0", "t1")


def corrected(base: DataFrame, late: DataFrame, by: tuple[str, ...] = ("match_id",)) -> DataFrame:
    """base with rows of late in place of those of the same tracks over late's range of frames; other tracks keep theirs.

    The range is that of each value of `by`: of a match, or of a chunk of one.
    """
    span = late.groupBy(*by).agg(F.min("frame").alias("_a"), F.max("frame").alias("_b"))
    ids = late.select(*by, "track_id").distinct().join(span, list(by))
    cond = [base[c] == ids[c] for c in (*by, "track_id")] + [base.frame.between(ids._a, ids._b)]
    return base.join(ids, cond, "left_anti").unionByName(late)


def sessions(df: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Stretches of frames with no gap longer than `gap`."""
    w = Window.partitionBy(*keys).orderBy("frame")
    new = F.when(F.col("frame") - F.lag("frame").over(w) > gap, 1).otherwise(0)
    s = df.withColumn("session", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*keys, "session").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n"))
