"""Progress documents: throttled writing, tolerant reading, and a listener for streams."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql.streaming import StreamingQueryListener

from .documents import write_json

STALE_S = 30.0
ENDED = ("done", "failed", "cancelled")


class Progress:
    """Writes the latest values at most once in `every` seconds, unless forced; a full disk stops nothing."""

    def __init__(self, path: str, every: float = 1.5, clock: Callable[[], float] = time.time):
        self.path, self.every, self.clock, self.values, self.last = path, every, clock, {}, float("-inf")

    def update(self, force: bool = False, **values: Any) -> bool:
        self.values |= values
        now = self.clock()
        if not force and now - self.last < self.every:
            return False
        self.last = now
        try:
            write_json(self.path, self.values | {"updated_at": now})
        except OSError:
            return False
        return True


def read(path: str, now: float) -> dict[str, Any] | None:
    """The values with `stale`; null while missing or half written."""
    try:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
    except (OSError, ValueError):
        return None
    d["stale"] = d.get("status") not in ENDED and now - d.get("updated_at", 0) > STALE_S
    return d


class StreamProgress(StreamingQueryListener):
    """Keeps a progress document of a streaming query; rows are those of all its batches."""

    def __init__(self, progress: Progress):
        self.progress, self.rows = progress, 0

    def onQueryStarted(self, event) -> None:
        self.rows = 0
        self.progress.update(force=True, status="running", query=str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows += p.numInputRows
        self.progress.update(batch=p.batchId, rows=self.rows, rows_per_s=p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        self.progress.update()

    def onQueryTerminated(self, event) -> None:
        self.progress.update(force=True, status="failed" if event.exception else "done", error=event.exception)
