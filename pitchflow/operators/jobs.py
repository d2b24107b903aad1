"""The batch queue as tables: stage plans, routing, recovery, retry and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN = ("pending", "interrupted")


def mode(asked: Column, seconds: Column) -> Column:
    """auto means the chunked pipeline from two minutes on."""
    return F.when(asked != "auto", asked).when(seconds >= 120, "pipeline").otherwise("sequential")


def stage_plan(files: Column, mode: Column, interpolate: Column, audio: Column) -> Column:
    """The names of a job's stages in order."""
    one = lambda ok, *names: F.when(ok, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    return F.concat(one(files > 1, "concat"), F.when(mode == "pipeline", F.array(F.lit("pipeline"))).otherwise(F.array(*map(F.lit, ("track", "classify", "campath", "render")))), one(interpolate, "interpolate"), one(audio, "audio_mux"))


def silent_intermediate(interpolate: Column, audio: Column) -> Column:
    """The rendered file is an intermediate where more follows."""
    return interpolate | audio


def recovered(jobs: DataFrame, stages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After a restart: running jobs were interrupted, running stages failed."""
    fix = lambda to: F.when(F.col("status") == "running", to).otherwise(F.col("status"))
    return jobs.withColumn("status", fix("interrupted")), stages.withColumn("status", fix("failed"))


def first_open(stages: DataFrame) -> DataFrame:
    """The first stage of each job that is not done."""
    return stages.where("status <> 'done'").groupBy("job_id").agg(F.min("stage_pos").alias("stage_pos"), F.min_by("stage", "stage_pos").alias("stage"))


def step_status(stages: DataFrame) -> DataFrame:
    """done as recorded; pending where all before are done; else blocked."""
    w = Window.partitionBy("job_id").orderBy("stage_pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.min(F.when(F.col("status") == "done", 1).otherwise(0)).over(w), F.lit(1))
    return stages.withColumn("step", F.when(F.col("status") == "done", "done").when(before == 1, "pending").otherwise("blocked"))


def retried(stages: DataFrame) -> DataFrame:
    """Failed stages open again, done ones kept; a job's retry_count (0 where absent) rises by one if it has any."""
    before = F.coalesce("retry_count", F.lit(0)) if "retry_count" in stages.columns else F.lit(0)
    w = Window.partitionBy("job_id")
    failed = F.max(F.when(F.col("status") == "failed", 1).otherwise(0)).over(w)
    return stages.select("job_id", "stage_pos", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status")).alias("status"), (before + failed).alias("retry_count"))


def next_job(jobs: DataFrame) -> DataFrame:
    """The first job of each owner's queue that can run."""
    return jobs.where(F.col("status").isin(*OPEN)).groupBy("owner").agg(F.min_by("job_id", "queue_pos").alias("job_id"))


def swapped(jobs: DataFrame, up: Column) -> DataFrame:
    """Queue positions after each job with `up` and the one before it have changed places."""
    w = Window.partitionBy("owner").orderBy("queue_pos")
    j = jobs.withColumns({"_n": F.row_number().over(w), "_up": up})
    j = j.withColumns({"_me": F.col("_up") & (F.col("_n") > 1), "_next": F.coalesce(F.lead("_up").over(w), F.lit(False))})
    return j.withColumn("place", F.when(F.col("_me"), F.col("_n") - 1).when(F.col("_next"), F.col("_n") + 1).otherwise(F.col("_n")).cast("long")).drop("_n", "_up", "_me", "_next")


def job_state(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """A job's state from those of its stages: failed, then running, then done, else as it was."""
    s = stages.groupBy("job_id").agg(F.bool_or(F.col("status") == "failed").alias("f"), F.bool_or(F.col("status") == "running").alias("r"), F.bool_and(F.col("status") == "done").alias("d"))
    state = F.when(F.col("f"), "failed").when(F.col("r"), "running").when(F.col("d"), "done").otherwise(F.when(F.col("status") == "done", "interrupted").otherwise(F.col("status")))
    return jobs.join(s, "job_id", "left").select("job_id", state.alias("state"))


def post_process(upscale: Column, interpolate: Column) -> Column:
    """Steps after rendering, in order: enlarging comes before new frames are made, as it then works on fewer."""
    return F.array_compact(F.array(F.when(upscale, "upscale"), F.when(interpolate, "interpolate")))


def flags(options: Column) -> Column:
    """A map of options as a command line: true is a bare flag, false and null are left out."""
    kept = F.map_filter(options, lambda k, v: v.isNotNull() & (v != "false"))
    parts = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.when(e["value"] == "true", F.concat(F.lit("--"), e["key"])).otherwise(F.concat(F.lit("--"), e["key"], F.lit(" "), e["value"])))
    return F.array_join(parts, " ")


def clock(seconds: Column) -> Column:
    """hh:mm:ss"""
    s = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def eta(elapsed: Column, fraction: Column) -> Column:
    return F.when(fraction > 0, elapsed * (1 - fraction) / F.when(fraction > 0, fraction))
