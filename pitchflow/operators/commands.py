"""The command of each stage of a job, as a list of words: one builder a stage, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The program that works on pictures; this library makes none.
PROGRAM = ("worker",)


def words(*parts: str | Column) -> Column:
    return F.array(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def given(name: str, value: Column) -> Column:
    """--name value where there is a value."""
    return F.when(value.isNotNull(), words(f"--{name}", value)).otherwise(F.array().cast("array<string>"))


def flag(name: str, on: Column) -> Column:
    return F.when(F.coalesce(on, F.lit(False)), words(f"--{name}")).otherwise(F.array().cast("array<string>"))


def options(m: Column) -> Column:
    """A map of options in the order of their names: true is a bare flag; false and null are left out."""
    kept = F.array_sort(F.map_entries(F.map_filter(m, lambda k, v: v.isNotNull() & (v != "false"))))
    one = lambda e: F.when(e["value"] == "true", F.array(F.concat(F.lit("--"), e["key"]))).otherwise(F.array(F.concat(F.lit("--"), e["key"]), e["value"]))
    return F.coalesce(F.flatten(F.transform(kept, one)), F.array().cast("array<string>"))


def with_paths(jobs: DataFrame) -> DataFrame:
    """jobs with the paths of what their stages write: work files beside the result, in a folder of its name."""
    stem = F.regexp_extract("result", r"([^/]*?)(\.[^./]*)?$", 1)
    parent = F.regexp_extract("result", r"^(.*?)/?[^/]*$", 1)
    work = F.concat(F.when(parent == "", F.lit("")).otherwise(F.concat(parent, F.lit("/"))), F.lit("work/"), stem)
    made = jobs.withColumn("work", work)
    silent, between = F.concat("work", F.lit("/silent.mp4")), F.concat("work", F.lit("/silent_interpolated.mp4"))
    return made.withColumns({
        "rendered": F.when(F.col("interpolate") | F.col("audio"), silent).otherwise(F.col("result")),
        "interpolated": F.when(F.col("audio"), between).otherwise(F.col("result")),
        "to_mux": F.when(F.col("interpolate"), between).otherwise(silent),
        "source": F.when(F.col("files") > 1, F.col("joined")).otherwise(F.col("video")),
    })


def commands(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """job_id, stage_pos, stage, args of each stage (job_id, stage_pos, stage); args are null for a stage that has no builder.

    jobs: job_id, result, joined, video, project (paths), files, audio, interpolate, enlarge, stride, t0, t1 (null: not
    given), flags and interpolate_flags (maps of text).
    """
    j = stages.join(with_paths(jobs), "job_id")
    c = F.col
    at = lambda name: F.concat(c("work"), F.lit(f"/{name}"))
    span = F.concat(given("t0", c("t0")), given("t1", c("t1")))
    run = lambda name, *parts: F.concat(words(*PROGRAM, name), *parts)
    builders = {
        "concat": F.concat(words("ffmpeg", "-y", "-f", "concat", "-safe", "0", "-i", at("files.txt"), "-c", "copy"), F.when(c("audio"), F.array().cast("array<string>")).otherwise(words("-an")), words(c("joined"))),
        "track": run("track", words("--project", c("project"), "--video", c("source"), "--out", at("tracks.json")), given("stride", c("stride")), span, options(c("flags"))),
        "classify": run("classify", words(at("tracks.json"), "--project", c("project"), "--out", at("players.json"))),
        "campath": run("campath", words(at("players.json"), "--project", c("project"), "--out", at("campath.json"))),
        "render": run("render", words(at("campath.json"), "--project", c("project"), "--video", c("source"), "--out", c("rendered")), flag("sr", c("enlarge")), span),
        "pipeline": run("pipeline", words("--project", c("project"), "--video", c("source"), "--out", c("rendered"), "--work-dir", at("chunks")), given("stride", c("stride")), span, flag("sr", c("enlarge")), options(c("flags"))),
        "interpolate": run("interpolate", words(c("rendered"), "--out", c("interpolated")), options(c("interpolate_flags"))),
        "audio_mux": words("ffmpeg", "-y", "-i", c("to_mux"), "-i", c("source"), "-map", "0:v", "-map", "1:a", "-c", "copy", "-shortest", c("result")),
    }
    args = F.lit(None).cast("array<string>")
    for name, built in builders.items():
        args = F.when(c("stage") == name, built).otherwise(args)
    return j.select("job_id", "stage_pos", "stage", args.alias("args"))
