"""Frame selection and nearest frames: time ranges, strides, as-of in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import KEYS


def frame_range(t0: float, t1: float, fps: float, frames: int | None = None) -> tuple[int, int]:
    """[first, end) by truncation; `frames` bounds the end."""
    end = int(t1 * fps)
    return int(t0 * fps), end if frames is None else min(frames, end)


def sampled(df: DataFrame, t0: float, t1: float, fps: float, stride: int = 1) -> DataFrame:
    """Every stride-th frame of a time range; the range is a filter that reaches the scan."""
    first, end = frame_range(t0, t1, fps)
    return df.where((F.col("frame") >= first) & (F.col("frame") < end) & ((F.col("frame") - first) % stride == 0))


def at_time(df: DataFrame, t: float, fps: float) -> DataFrame:
    return df.where(F.col("frame") == int(t * (fps if fps > 0 else 20.0)))


def nearest(df: DataFrame, targets: DataFrame, value: str) -> DataFrame:
    """For each row of targets (keys, frame) the row of df with the nearest frame; the earlier one on ties.

    Both sides run through one window in frame order, so no pairs are formed.
    """
    cols = F.struct("frame", value)
    both = df.select(*KEYS, "frame", cols.alias("_v"), F.lit(0).alias("_t")).unionByName(
        targets.select(*KEYS, "frame", F.lit(None).cast(df.select(cols.alias("v")).schema["v"].dataType).alias("_v"), F.lit(1).alias("_t"))
    )
    w = Window.partitionBy(*KEYS).orderBy("frame", "_t")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*KEYS).orderBy(F.desc("frame"), "_t").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"_l": F.last("_v", ignorenulls=True).over(back), "_r": F.last("_v", ignorenulls=True).over(ahead)}).where("_t = 1")
    left = F.col("_r").isNull() | (F.col("frame") - F.col("_l.frame") <= F.col("_r.frame") - F.col("frame"))
    pick = F.when(F.col("_l").isNotNull() & left, F.col("_l")).otherwise(F.col("_r"))
    return found.withColumn("_p", pick).select(*KEYS, "frame", F.col("_p.frame").alias("near_frame"), F.col(f"_p.{value}").alias(value))
