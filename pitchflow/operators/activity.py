"""Hysteresis and probation: which rows of a player track count as active and as stable."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ActivityRules, Field
from ..sources.shared import kept
from .features import KEYS, deep, in_field, recent


def frames_of(seconds: float, dt: float) -> int:
    return max(0, round(seconds / dt))


def hold(x: Column, z: Column, committed: Column, dt: float, field: Field, rules: ActivityRules) -> Column:
    """How many rows off the field end the activity, by the edges that are crossed."""
    near, far, ends = z < -rules.near, z > field.width + rules.far, F.abs(x) > field.length / 2 + rules.ends
    n = {k: frames_of(v, dt) for k, v in (("near", rules.hold_near_s), ("far", rules.hold_far_s), ("ends", rules.hold_ends_s), ("committed", rules.hold_committed_s))}
    most = F.greatest(
        F.when(near, n["near"]), F.when(far, n["far"]), F.when(ends, n["ends"]), F.when(committed & (near | far), n["committed"])
    )
    return F.coalesce(most, F.lit(n["near"]))


def activity(df: DataFrame, dt: float, field: Field = Field(), rules: ActivityRules = ActivityRules()) -> DataFrame:
    """active, well_in. The switch is a last event: on where inside, off where a run off the field reaches its hold."""
    x, z = F.col("x"), F.col("z")
    w = Window.partitionBy(*KEYS).orderBy("frame")
    on = in_field(x, z, field, near=rules.near, far=rules.far, ends=rules.ends)
    off = ~in_field(x, z, field, near=rules.near + rules.band, far=rules.far + rules.band, ends=rules.ends + rules.band)
    s = recent(df, deep(x, z, field), rules.committed_window_s, dt)
    s = s.withColumns({"_on": on, "_off": off & ~on, "_hold": hold(x, z, F.col("recent_s") >= rules.committed_deep_s, dt, field, rules)})
    s = s.withColumn("_i", F.row_number().over(w) - F.sum(F.col("_off").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_run", F.sum(F.col("_off").cast("int")).over(Window.partitionBy(*KEYS, "_i").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)))
    event = F.when(F.col("_on"), 1).when(F.col("_off") & (F.col("_run") >= F.col("_hold")), 0)
    active = F.coalesce(F.last(event, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) == 1
    inside = in_field(x, z, field, near=rules.inside_near, far=rules.inside_far, ends=rules.inside_ends)
    return s.withColumn("active", active).withColumn("well_in", F.col("active") & inside).drop("_on", "_off", "_hold", "_i", "_run", "recent_s")


def active_runs(df: DataFrame, dt: float, rules: ActivityRules = ActivityRules()) -> DataFrame:
    """Rows of active stretches with run, start, start_well and by_count: the frame at which inside rows suffice."""
    w = Window.partitionBy(*KEYS).orderBy("frame")
    run = F.sum(F.when(F.col("active") & ~F.coalesce(F.lag("active").over(w), F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("run", run).where("active")
    key = Window.partitionBy(*KEYS, "run")
    upto = key.orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"start": F.min("frame").over(key), "_c": F.sum(F.col("well_in").cast("int")).over(upto)})
    enough = frames_of(rules.probation_s, dt) if rules.probation_s > 0 else 0
    return rows.withColumns({
        "by_count": F.min(F.when((F.col("_c") >= enough) & (F.col("frame") > F.col("start")), F.col("frame"))).over(key),
        "start_well": F.max(F.when(F.col("frame") == F.col("start"), F.col("well_in"))).over(key),
    }).drop("_c")


def near_starts(rows: DataFrame, rules: ActivityRules = ActivityRules()) -> DataFrame:
    """(run that starts, older active run within reach in that frame).

    The join goes by grid cells as wide as the reach: a start, of which a run has one, is put into its own and the
    neighbouring cells, and meets the rows of those in its frame.
    """
    cell = lambda c, i=F.lit(0): F.floor(F.col(c) / rules.isolated) + i
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    begun = rows.where("frame = start and start_well").withColumn("_o", F.explode(around))
    begun = begun.select("match_id", "frame", cell("x", F.col("_o.i")).alias("_cx"), cell("z", F.col("_o.j")).alias("_cz"), F.col("track_id").alias("a_track"), F.col("run").alias("a_run"), F.col("x").alias("ax"), F.col("z").alias("az"))
    old = rows.where("frame > start").select("match_id", "frame", cell("x").alias("_cx"), cell("z").alias("_cz"), F.col("track_id").alias("b_track"), F.col("run").alias("b_run"), F.col("x").alias("bx"), F.col("z").alias("bz"))
    met = begun.join(old, ["match_id", "frame", "_cx", "_cz"]).where(F.hypot(F.col("ax") - F.col("bx"), F.col("az") - F.col("bz")) <= rules.isolated)
    return met.select("match_id", "a_track", "a_run", "b_track", "b_run")


def stable(df: DataFrame, dt: float, rules: ActivityRules = ActivityRules()) -> DataFrame:
    """The rows of df (with active, well_in) that are past probation."""
    return states(kept(active_runs(df, dt, rules), "runs"), rules).where("stable").drop("stable")


def states(rows: DataFrame, rules: ActivityRules = ActivityRules()) -> DataFrame:
    """The active rows (those of active_runs, which are read several times here) with `stable`: whether past probation.

    Promotion depends on runs that were promoted in an earlier frame, so it is solved over
    the runs of a match in order of their start: a few rows a track, one group a match.
    """
    runs = rows.where("frame = start").select("match_id", "track_id", "run", "start", "by_count")
    edges = near_starts(rows, rules).groupBy("match_id", "a_track", "a_run").agg(F.collect_set(F.struct("b_track", "b_run")).alias("near"))
    table = runs.join(edges.withColumnsRenamed({"a_track": "track_id", "a_run": "run"}), ["match_id", "track_id", "run"], "left")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "track_id"], kind="stable")
        at: dict[tuple[int, int], float] = {}
        for t, r, start, count, near in zip(pdf["track_id"], pdf["run"], pdf["start"], pdf["by_count"], pdf["near"]):
            soon = near is not None and any(at.get((e["b_track"], e["b_run"]), float("inf")) < start for e in near)
            at[t, r] = start if soon else (float("inf") if pd.isna(count) else count)
        pdf["promoted"] = [at[k] for k in zip(pdf["track_id"], pdf["run"])]
        pdf = pdf[pdf["promoted"] < float("inf")]
        return pdf[["match_id", "track_id", "run", "promoted"]].astype("int64")

    since = table.groupBy("match_id").applyInPandas(solve, "match_id long, track_id long, run long, promoted long")
    out = rows.join(since, ["match_id", "track_id", "run"], "left").withColumn("stable", F.coalesce(F.col("frame") >= F.col("promoted"), F.lit(False)))
    return out.drop("run", "start", "by_count", "start_well", "promoted")


def final_labels(positions: DataFrame, track_labels: DataFrame, active_rows: DataFrame) -> DataFrame:
    """Labels of all rows: tracks keep theirs, except that player tracks are split by state (the rows of `states`)."""
    row = [*KEYS, "frame"]
    named = positions.join(track_labels.select(*KEYS, "label"), list(KEYS), "left").withColumn("label", F.coalesce("label", F.lit("player")))
    out = named.join(active_rows.select(*row, F.col("stable").alias("_s")), row, "left")
    label = F.when(F.col("label") != "player", F.col("label")).when(F.col("_s"), "player").when(~F.col("_s"), "probation").otherwise("sideline")
    return out.withColumn("label", label).drop("_s")


def framing_pool(positions: DataFrame, stable_rows: DataFrame) -> DataFrame:
    return positions.join(stable_rows.select(*KEYS, "frame"), [*KEYS, "frame"], "left_semi")
