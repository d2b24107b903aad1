"""Positions, path and project documents: nested JSON at the edge, flat tables inside."""

from __future__ import annotations

import copy
import json
import os
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PATH_DOC, POSITIONS_DOC, Field, Lens
from .layouts import LENS_KEYS, PROJECT


def _match(doc: DataFrame) -> Column:
    own = F.col("match_id").cast("long") if "match_id" in doc.columns else F.xxhash64(F.col("_metadata.file_path"))
    return own.alias("match_id")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """One row a player and frame of the documents under path; frames without players give none.

    match_id is that of the folders which write_positions makes, else the hash of the file's path,
    so documents of many matches can be read at once.
    """
    doc = spark.read.schema(POSITIONS_DOC).option("multiLine", True).option("mode", "FAILFAST").json(path)
    frames = doc.select(_match(doc), "video", "fps", "stride", F.explode("frames").alias("f"))
    return frames.select("match_id", "video", "fps", "stride", F.explode("f.players").alias("p"), F.col("f.frame").alias("frame"), F.col("f.t").alias("t")).select(
        "match_id", F.col("p.id").alias("track_id"), "frame", "t", F.col("p.X").alias("x"), F.col("p.Z").alias("z"), F.col("p.conf").alias("conf"), F.col("p.label").alias("label"), F.col("p.boxes").alias("boxes"), "video", "fps", "stride"
    )


def nested(positions: DataFrame, fps: float, keys: tuple[str, ...] = ("match_id",), digits: int = 3) -> DataFrame:
    """One row a match with frames in order, numbers at the document's decimals.

    Players are gathered by frame first, so that a match's row is built of its frames.
    """
    optional = [c for c in ("label", "boxes") if c in positions.columns]
    player = F.struct(F.col("track_id").alias("id"), F.round("x", digits).alias("X"), F.round("z", digits).alias("Z"), F.round("conf", digits).alias("conf"), *optional)
    by = positions.groupBy(*keys, "frame").agg(F.sort_array(F.collect_list(player)).alias("players"))
    frame = F.struct("frame", F.round(F.col("frame") / fps, digits).alias("t"), "players")
    return by.groupBy(*keys).agg(F.sort_array(F.collect_list(frame)).alias("frames"))


def write_positions(positions: DataFrame, path: str, fps: float, video: str = "", stride: int = 3, fld: Field = Field()) -> None:
    """A document a match; its output stride is 1, that of detection is kept beside it."""
    head = {"video": F.lit(video), "fps": F.lit(float(fps)), "stride": F.lit(1), "perception_stride": F.lit(stride), "field_length_m": F.lit(fld.length), "field_width_m": F.lit(fld.width)}
    nested(positions, fps).withColumns(head).write.mode("overwrite").partitionBy("match_id").json(path)


def write_labelled(labelled: DataFrame, pool: DataFrame, path: str, fps: float) -> tuple[str, str]:
    """The framing pool and, beside it, the labelled positions."""
    other = path.replace(".json", "_labeled.json")
    write_positions(pool, path, fps)
    write_positions(labelled, other, fps)
    return path, other


def read_path(spark: SparkSession, path: str) -> DataFrame:
    """match_id (as read_positions has it), frame, yaw, pitch, fov and d; fov is vfov for rectilinear paths, hfov for others; d is 0 where absent."""
    doc = spark.read.schema(PATH_DOC).option("multiLine", True).json(path)
    rows = doc.select(_match(doc), "projection", "out_w", "out_h", F.posexplode("path").alias("n", "p"))
    fov = F.when(F.col("projection") == "rectilinear", F.coalesce("p.vfov", "p.hfov")).otherwise(F.coalesce("p.hfov", "p.vfov"))
    return rows.select("match_id", "projection", "p.frame", "p.yaw", "p.pitch", fov.alias("fov"), F.coalesce("p.d", F.lit(0.0)).alias("d"))


def write_path(path_rows: DataFrame, path: str, fps: float, out_w: int = 1920, out_h: int = 1080, projection: str = "panini", end: dict[str, float] | None = None) -> None:
    pose = F.struct("frame", *[F.round(c, 4).alias(c) for c in ("yaw", "pitch", "hfov", "d")])
    doc = path_rows.groupBy("match_id").agg(F.sort_array(F.collect_list(pose)).alias("path"))
    state = F.create_map(*[F.lit(v) for kv in (end or {}).items() for v in kv]) if end else F.lit(None).cast("map<string,double>")
    doc.withColumns({"fps": F.lit(float(fps)), "out_w": F.lit(out_w), "out_h": F.lit(out_h), "projection": F.lit(projection), "smoother_final_state": state}).write.mode("overwrite").partitionBy("match_id").json(path)


def write_table(positions: DataFrame, path: str, mode: str = "append") -> None:
    """The engine's own form: Parquet by match, rows in order of frames for range filters."""
    positions.repartition("match_id").sortWithinPartitions("match_id", "frame").write.mode(mode).partitionBy("match_id").parquet(path)


class Project:
    """Settings of one video: the keys of `layouts.PROJECT` and `pano` as attributes.

    Keys that are missing take the default; keys that are unknown are kept and written again.
    """

    def __init__(self, pano: dict[str, Any] | None = None, **values: Any):
        self.pano = dict(LENS_KEYS) | (pano or {})
        self.values = copy.deepcopy(PROJECT) | values

    def __getattr__(self, key: str) -> Any:
        if key in ("values", "pano") or key not in self.values:
            raise AttributeError(key)
        return self.values[key]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Project) and (self.values, self.pano) == (other.values, other.pano)

    @property
    def unknown(self) -> dict[str, Any]:
        return {k: v for k, v in self.values.items() if k not in PROJECT}

    @classmethod
    def load(cls, path: str) -> Project:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        if not isinstance(d, dict) or not isinstance(d.get("pano", {}), dict):
            raise TypeError(f"{path} is no project document")
        return cls(**d)

    @classmethod
    def for_video(cls, video: str, width: int, height: int) -> Project:
        return cls({"src_w": width, "src_h": height}, source_video=video)

    def save(self, path: str) -> None:
        write_json(path, {"source_video": self.values["source_video"], "pano": self.pano} | self.values)

    @property
    def lens(self) -> Lens:
        return Lens(**{k: v for k, v in self.pano.items() if k in LENS_KEYS})


def write_json(path: str, value: Any) -> None:
    """All or nothing: written beside, flushed, then put in place."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def assert_output_safe(output: str, inputs: list[str]) -> None:
    """Refuses to write over what is read; paths are compared normalised, without case."""
    key = lambda p: os.path.normcase(os.path.normpath(os.path.abspath(p))).casefold()
    if key(output) in {key(i) for i in inputs}:
        raise ValueError(f"the output {output} is one of the inputs")


def read_jobs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A queue document: malformed jobs are left out, unknown keys dropped, missing ones null."""
    doc = spark.read.schema(f"paused boolean, jobs array<struct<{schema}>>").option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return doc.select(F.posexplode("jobs").alias("queue_pos", "job")).select("queue_pos", "job.*")
