"""Clips: what a probe's text says, when they were taken, whether they can be joined as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VIDEO_SUFFIXES = ("mp4", "mov", "mkv", "avi", "m4v", "mts")


def is_video(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)).isin(*VIDEO_SUFFIXES)


def existing(clips: DataFrame, folder: str) -> DataFrame:
    """The clips whose `name` is a file of the folder (which only Spark needs to read); files are listed, not opened."""
    files = clips.sparkSession.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return clips.join(files.distinct(), "name", "left_semi").select(*clips.columns)


def has_audio(probe: Column) -> Column:
    return probe.rlike("Stream #[^;]*: Audio:")


def codec(probe: Column) -> Column:
    return F.regexp_extract(probe, "Video: ([A-Za-z0-9]+)", 1)


def taken_at(name: Column, tag: Column, file_time: Column) -> Column:
    """The time in the name, else in the tag, else of the file, else empty; as text."""
    day, clock = F.regexp_extract(name, r"_DST(\d{8})_(\d{6})_", 1), F.regexp_extract(name, r"_DST(\d{8})_(\d{6})_", 2)
    part = lambda c, i, n: F.substring(c, i, n)
    named = F.when(day != "", F.concat(part(day, 1, 4), F.lit("-"), part(day, 5, 2), F.lit("-"), part(day, 7, 2), F.lit(" "), part(clock, 1, 2), F.lit(":"), part(clock, 3, 2), F.lit(":"), part(clock, 5, 2)))
    return F.coalesce(named, tag, file_time, F.lit(""))


def duration(frames: Column, fps: Column) -> Column:
    return F.when(fps > 0, frames / F.when(fps > 0, fps)).otherwise(0.0)


def offsets(clips: DataFrame) -> DataFrame:
    """start_s of each clip when a project's clips run in order."""
    w = Window.partitionBy("project").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return clips.withColumn("start_s", F.coalesce(F.sum("seconds").over(w), F.lit(0.0)))


def signature(clips: DataFrame) -> Column:
    return F.struct(codec(F.col("probe")).alias("codec"), F.col("width"), F.col("height"), F.round("fps", 2).alias("fps"))


def consistency(clips: DataFrame) -> DataFrame:
    """One row a project: how many signatures, the audio state, total seconds, and how to join."""
    a = has_audio(F.col("probe"))
    g = clips.withColumns({"_s": signature(clips), "_a": a}).groupBy("project").agg(
        F.count("*").alias("n"), F.count_distinct("_s").alias("signatures"), F.bool_and("_a").alias("_all"), F.bool_or("_a").alias("_any"), F.sum("seconds").alias("seconds")
    )
    audio = F.when(F.col("_all"), "all_have").when(~F.col("_any"), "none_have").otherwise("mixed")
    how = F.when(F.col("n") < 2, "single").when(audio == "mixed", "blocked").when(F.col("signatures") > 1, "reencode").otherwise("copy")
    return g.select("project", "n", "signatures", F.when(F.col("signatures") == 1, "consistent").otherwise("mismatch").alias("state"), audio.alias("audio"), "seconds", how.alias("how"))


def signature_counts(clips: DataFrame) -> DataFrame:
    return clips.withColumn("_s", signature(clips)).groupBy("project", "_s").agg(F.count("*").alias("n")).select("project", "_s.*", "n")


def encoder(width: Column, height: Column) -> Column:
    """Frames over 4096 on a side need the newer codec."""
    return F.when(F.greatest(width, height) > 4096, "hevc").otherwise("h264")


def trimmed(clips: DataFrame, t0: float, t1: float) -> DataFrame:
    """Clips of the joined run that lie in [t0, t1), with their part of it."""
    o = offsets(clips).withColumn("end_s", F.col("start_s") + F.col("seconds"))
    cut = o.where((F.col("start_s") < t1) & (F.col("end_s") > t0))
    return cut.select("project", "pos", F.greatest("start_s", F.lit(float(t0))).alias("from_s"), F.least("end_s", F.lit(float(t1))).alias("to_s"))
