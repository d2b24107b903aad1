"""Per-track smoothing, speed, runs, features and labels; all by windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Field, LabelRules

KEYS = ("match_id", "track_id")


def in_field(x: Column, z: Column, field: Field, margin: float = 0.0, near: float | None = None, far: float | None = None, ends: float | None = None) -> Column:
    """Inside the field with a margin for each edge; borders count as inside."""
    n, f, e = (margin if v is None else v for v in (near, far, ends))
    return (F.abs(x) <= field.length / 2 + e) & (z >= -n) & (z <= field.width + f)


def of_class(detections: DataFrame, column: str, wanted: int = 0) -> DataFrame:
    """The detections of one class of the detector; those without a class go."""
    return detections.where(F.col(column) == wanted)


def plausible(x: Column, z: Column, field: Field) -> Column:
    ok = (z >= -12.0) & (z <= field.width + 15.0) & (F.abs(x) <= field.length / 2 + 25.0)
    return F.coalesce(ok & ~F.isnan(x) & ~F.isnan(z), F.lit(False))


def deep(x: Column, z: Column, field: Field, depth: float = 5.0) -> Column:
    return (z >= depth) & (z <= field.width - depth) & (F.abs(x) <= field.length / 2)


def smooth(df: DataFrame, width: int = 5) -> DataFrame:
    """sx, sz: the sum of up to `width` rows around, over `width` even at the ends; short tracks as they are."""
    key = Window.partitionBy(*KEYS)
    near = key.orderBy("frame").rowsBetween(-(width // 2), width // 2)
    n = F.count("*").over(key)
    each = lambda c: F.when(n < width, F.col(c)).otherwise(F.sum(c).over(near) / width)
    return df.withColumns({"sx": each("x"), "sz": each("z")})


def speeds(df: DataFrame, dt: float, x: str = "x", z: str = "z") -> DataFrame:
    """speed from the row before; null on the first."""
    w = Window.partitionBy(*KEYS).orderBy("frame")
    return df.withColumn("speed", F.hypot(F.col(x) - F.lag(x).over(w), F.col(z) - F.lag(z).over(w)) / max(dt, 1e-6))


def runs(df: DataFrame, flag: Column) -> DataFrame:
    """The stretches of consecutive rows where flag holds: one row each with n, first and last frame."""
    w = Window.partitionBy(*KEYS).orderBy("frame")
    island = df.withColumn("_on", flag).withColumn("_i", F.row_number().over(w) - F.sum(F.col("_on").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.where("_on").groupBy(*KEYS, "_i").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame")).drop("_i")


def recent(df: DataFrame, flag: Column, seconds: float, dt: float) -> DataFrame:
    """recent_s: time with flag within the last rows, by the difference of two running sums."""
    win = max(1, round(seconds / dt))
    w = Window.partitionBy(*KEYS).orderBy("frame")
    total = df.withColumn("_c", F.sum(flag.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return total.withColumn("recent_s", (F.col("_c") - F.coalesce(F.lag("_c", win).over(w), F.lit(0))) * F.lit(dt)).drop("_c")


def features(df: DataFrame, dt: float, field: Field = Field(), rules: LabelRules = LabelRules()) -> DataFrame:
    """One row a track. Windows and aggregates share the partitioning by track: one shuffle."""
    w = Window.partitionBy(*KEYS).orderBy("frame")
    s = speeds(smooth(df), dt, "sx", "sz")
    s = s.withColumns({"on": in_field(F.col("sx"), F.col("sz"), field, rules.buffer), "deep": deep(F.col("sx"), F.col("sz"), field, rules.deep)})
    s = s.withColumn("_i", F.row_number().over(w) - F.sum(F.col("deep").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_run", F.sum(F.col("deep").cast("int")).over(Window.partitionBy(*KEYS, "_i")))
    key = Window.partitionBy(*KEYS)
    s = s.withColumns({"mx": F.percentile("sx", F.lit(0.5)).over(key), "mz": F.percentile("sz", F.lit(0.5)).over(key)})
    f = s.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.coalesce(F.percentile("speed", F.lit(0.85)), F.lit(0.0)).alias("p85_speed"), F.first("mx").alias("x_med"), F.first("mz").alias("z_med"),
        F.max("sz").alias("z_max"), (F.max("sx") - F.min("sx")).alias("x_span"), F.avg(F.col("on").cast("int")).alias("frac_on"), F.avg(F.col("deep").cast("int")).alias("frac_deep"),
        (F.max("_run") * F.lit(dt)).alias("max_deep_run_s"), (F.sum(F.col("deep").cast("int")) * F.lit(dt)).alias("total_deep_s"),
        F.percentile(F.hypot(F.col("sx") - F.col("mx"), F.col("sz") - F.col("mz")), F.lit(0.5)).alias("pos_spread"),
        F.hypot(F.stddev_pop("sx"), F.stddev_pop("sz")).alias("pos_std"),
    )
    return f.withColumns({"dur_s": F.col("n") * F.lit(dt), "med_in_field": in_field(F.col("x_med"), F.col("z_med"), field, rules.buffer)})


def labels(features: DataFrame, field: Field = Field(), rules: LabelRules = LabelRules()) -> DataFrame:
    """features with `label`: foreign, sideline or player, by the first rule that holds."""
    r2 = lambda c: F.round(c, 2)
    far = r2("z_med") > field.width - rules.side_band
    side = (r2("z_med") < rules.side_band) | far
    need = F.when(side & (F.col("pos_std") < rules.commit_move), rules.side_run_s).otherwise(rules.deep_run_s)
    label = (
        F.when(~F.col("med_in_field") & (r2("frac_on") < rules.foreign_frac) & (F.col("max_deep_run_s") < rules.deep_run_s), "foreign")
        .when((r2("dur_s") > rules.static_s) & (F.col("pos_spread") < F.when(far, rules.far_static_spread).otherwise(rules.static_spread)), "sideline")
        .when(F.col("max_deep_run_s") >= need, "player").otherwise("sideline")
    )
    return features.withColumn("label", label)
