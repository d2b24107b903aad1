"""The job state machine: a log of events folded in order to the state after each.

A job has `stages` stages that run one after the other; `closed` counts those that are done or
skipped. Events: start (a worker takes it), ok, fail and stop (how the running stage ended), pause and
resume (of its queue), skip (its next stage), retry. What an event does:

- start: a pending or interrupted job that is not paused runs its first open stage; with none left it is done;
- ok: the running stage is closed; the job is done after the last one, pending where a pause was
  asked for meanwhile (it takes effect at the boundary of stages), else it runs on;
- fail, stop: the job is failed, or interrupted, at the stage that ran, which stays open;
- skip: a job that does not run closes its next stage;
- retry: a failed or interrupted job is pending again with its closed stages kept; a failed one counts it.

Any other event, and one that does not fit the state, changes nothing. Events of one job with the same place in
the order are taken by name; rows without job or place are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

START = ("pending", 0, 0, 0)
HISTORY = "job_id long, seq long, event string, status string, closed long, paused long, retries long"
State = tuple[str, int, int, int]


def step(state: State, event: str, stages: int) -> State:
    """(status, closed, paused, retries) after one event."""
    status, closed, paused, retries = state
    if event in ("pause", "resume"):
        return status, closed, int(event == "pause"), retries
    if event == "start" and status in ("pending", "interrupted") and not paused:
        return "running" if closed < stages else "done", closed, paused, retries
    if status == "running":
        if event == "ok":
            closed += 1
            status = "done" if closed >= stages else "pending" if paused else "running"
        elif event in ("fail", "stop"):
            status = "failed" if event == "fail" else "interrupted"
    elif event == "skip" and closed < stages:
        closed += 1
        status = "done" if closed == stages else status
    elif event == "retry" and status in ("failed", "interrupted"):
        retries, status = retries + (status == "failed"), "pending"
    return status, closed, paused, retries


def _known(events: DataFrame) -> DataFrame:
    return events.where("job_id is not null and seq is not null").select("job_id", "seq", "event", F.coalesce("stages", F.lit(0)).cast("long").alias("stages"))


def history(events: DataFrame) -> DataFrame:
    """HISTORY of events (job_id, seq, event, stages): jobs sorted within their tasks and folded as they pass, so only a state is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, state = None, START
        for b in batches:
            out = []
            for j, seq, event, stages in zip(*(b.column(c).to_pylist() for c in ("job_id", "seq", "event", "stages"))):
                if j != job:
                    job, state = j, START
                state = step(state, event, stages)
                out.append((j, seq, event, *state))
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in HISTORY.split(", ")])

    return _known(events).repartition("job_id").sortWithinPartitions("job_id", "seq", "event").mapInArrow(run, HISTORY)


def latest(events: DataFrame) -> DataFrame:
    """Each job's state after its last event."""
    last = F.max(F.struct("seq", "event", "status", "closed", "paused", "retries"))
    return history(events).groupBy("job_id").agg(last.alias("s")).select("job_id", "s.seq", "s.status", "s.closed", "s.paused", "s.retries")


def history_stream(events: DataFrame) -> DataFrame:
    """HISTORY of a stream of events that come in order a job: its state is four values."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now: State = tuple(json.loads(state.get[0])) if state.exists else START
        out = []
        for r in pd.concat(list(parts)).sort_values(["seq", "event"], kind="stable").itertuples(index=False):
            now = step(now, r.event, r.stages)
            out.append((key[0], r.seq, r.event, *now))
        state.update((json.dumps(now),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in HISTORY.split(", ")])

    return _known(events).groupBy("job_id").applyInPandasWithState(fold, HISTORY, "state string", "append", GroupStateTimeout.NoTimeout)
