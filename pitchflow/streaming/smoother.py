"""Structured Streaming forms of the recurrences: state by match, handed from micro-batch to micro-batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.camera import PATH, smooth_path
from ..operators.tracker import HITS, Tracker, follow
from ..schema import CameraRules, TrackRules
from ..sources.shared import folder, in_order, stepped

TARGETS = "match_id long, frame long, yaw_t double, pitch_t double, hfov_t double"


def smooth_stream(targets: DataFrame, rules: CameraRules) -> DataFrame:
    """The camera path of a stream of targets. Rows of a match must come in order of their frames; state is a few numbers a match."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values("frame", kind="stable")
        old = json.loads(state.get[0]) if state.exists else None
        out, end = smooth_path(pdf, rules, {k: tuple(v) for k, v in old.items()} if old else None)
        state.update((json.dumps(end),))
        yield out

    return targets.groupBy("match_id").applyInPandasWithState(step, PATH, "state string", "append", GroupStateTimeout.NoTimeout)


def track_stream(points: DataFrame, rules: TrackRules) -> DataFrame:
    """Hits of a stream of fused points (match_id, frame, cluster, x, z, conf, tiles): live tracks are the state."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts))
        old = json.loads(state.get[0]) if state.exists else None
        tracker = Tracker.from_dict(rules, old["tracker"]) if old else Tracker(rules)
        out = follow(pdf, tracker, first=old["next_frame"] if old else None)
        state.update((json.dumps({"tracker": tracker.as_dict(), "next_frame": int(pdf["frame"].max()) + 1}),))
        yield out

    return points.groupBy("match_id").applyInPandasWithState(step, HITS, "state string", "append", GroupStateTimeout.NoTimeout)


def played(stream: DataFrame, at: str) -> DataFrame:
    """Runs a query over what its source holds now and gives what it wrote under `at`."""
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def replay(targets: DataFrame, rules: CameraRules, chunk: int = 600) -> DataFrame:
    """Plays a finished table of targets as a stream, a micro-batch a chunk of frames, through the smoother."""
    spark, at = targets.sparkSession, folder(targets.sparkSession, "replay")
    in_order(stepped(targets, "chunk", chunk), f"{at}/in", "chunk")
    stream = spark.readStream.schema(TARGETS).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    return played(smooth_stream(stream, rules), at)
