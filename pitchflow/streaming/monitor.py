"""Watching streams: progress documents as a stream with staleness by timers, and queries that fail together.

A worker's progress document is replaced while it works; each version is a row here. A worker
that has not ended and has not been heard of for a while is reported once as stale, by a
processing-time timer, and again as heard when it comes back.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.progress import ENDED, STALE_S

DOCUMENT = "command string, status string, step string, step_progress double, updated_at double, error string"
SIGNS = "worker string, event string, status string, step string, at double"


def progress_stream(spark: SparkSession, path: str) -> DataFrame:
    """Documents that come to a folder, a worker a file name up to its first dot; unreadable ones are passed over."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1).alias("worker")
    docs = spark.readStream.schema(f"{DOCUMENT}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return docs.select("*", name).where("_corrupt is null and status is not null").drop("_corrupt")


class Staleness(StatefulProcessor):
    """A worker's last words, and a timer that each of them puts off."""

    def __init__(self, stale_s: float):
        self.stale_ms = int(stale_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, step string, at double")

    def close(self) -> None:
        pass

    def _timers(self, at: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        pdf = pd.concat(list(rows))
        r = pdf.sort_values("updated_at", na_position="first", kind="stable").iloc[-1]
        if self.last.exists() and (self.last.get()[2] or 0) > (r.updated_at or 0):
            return  # an older version, listed late
        self.last.update((r.status, r.step, r.updated_at))
        ended = r.status in ENDED
        self._timers(None if ended else timerValues.getCurrentProcessingTimeInMs() + self.stale_ms)
        yield pd.DataFrame([(key[0], "ended" if ended else "heard", r.status, r.step, r.updated_at)], columns=[c.split()[0] for c in SIGNS.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N803
        status, step, at = self.last.get()
        yield pd.DataFrame([(key[0], "stale", status, step, at)], columns=[c.split()[0] for c in SIGNS.split(", ")])


def signs(progress: DataFrame, stale_s: float = STALE_S) -> DataFrame:
    """SIGNS of a stream of progress documents. The session needs the RocksDB state store, the query a trigger that keeps running."""
    return progress.groupBy("worker").transformWithStateInPandas(Staleness(stale_s), SIGNS, "Append", "ProcessingTime")


class StreamsFailed(RuntimeError):
    """One of several queries failed; the others were stopped."""

    def __init__(self, name: str, cause: Exception):
        super().__init__(f"{name} failed, its peers were stopped: {str(cause).splitlines()[0] if str(cause) else cause!r}")
        self.name, self.cause = name, cause


def together(queries: list[StreamingQuery], every: float = 0.2, timeout: float | None = None) -> bool:
    """Waits until all queries have ended, or so many seconds; once one fails the others are stopped and one error is raised for all.

    Gives whether all ended. The first failure in the order of `queries` names the error.
    """
    began = time.monotonic()
    try:
        while True:
            for k, q in enumerate(queries):
                if not q.isActive and (cause := q.exception()) is not None:
                    raise StreamsFailed(q.name or f"query {k}", cause)
            if not any(q.isActive for q in queries):
                return True
            if timeout is not None and time.monotonic() - began > timeout:
                return False
            time.sleep(every)
    except BaseException:
        for q in queries:
            if q.isActive:
                q.stop()
        raise
