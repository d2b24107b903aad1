"""The job state machine: its transitions, and its batch and stream forms."""

import random

import pytest
from pitchflow.operators import job_log as L

EVENTS = "job_id long, seq long, event string, stages long"


def run(*events, stages=3, state=L.START):
    for e in events:
        state = L.step(state, e, stages)
    return state


@pytest.mark.parametrize(
    ("events", "want"),
    [
        (["start", "ok", "ok", "ok"], ("done", 3, 0, 0)),
        (["ok"], ("pending", 0, 0, 0)),
        (["start", "pause"], ("running", 0, 1, 0)),
        (["start", "pause", "ok"], ("pending", 1, 1, 0)),
        (["start", "pause", "ok", "start"], ("pending", 1, 1, 0)),
        (["start", "pause", "ok", "resume", "start", "ok", "ok"], ("done", 3, 0, 0)),
        (["start", "pause", "ok", "resume", "start", "pause", "ok", "resume", "start", "pause", "ok"], ("done", 3, 1, 0)),
        (["start", "ok", "fail"], ("failed", 1, 0, 0)),
        (["start", "ok", "fail", "start"], ("failed", 1, 0, 0)),
        (["start", "ok", "fail", "retry", "start", "ok", "ok"], ("done", 3, 0, 1)),
        (["start", "ok", "stop"], ("interrupted", 1, 0, 0)),
        (["start", "ok", "stop", "start", "ok"], ("running", 2, 0, 0)),
        (["start", "stop", "retry"], ("pending", 0, 0, 0)),
        (["skip", "start", "skip", "ok"], ("running", 2, 0, 0)),
        (["skip", "skip", "skip", "skip"], ("done", 3, 0, 0)),
        (["start", "ok", "fail", "skip", "skip"], ("done", 3, 0, 0)),
        (["what", None], ("pending", 0, 0, 0)),
    ],
)
def test_transitions(events, want):
    assert run(*events) == want


def test_a_job_without_stages_is_done_when_started():
    assert run("start", stages=0) == ("done", 0, 0, 0) and run("skip", stages=0) == ("pending", 0, 0, 0)


def log(seed, jobs=12, events=80):
    r = random.Random(seed)
    kinds = ["start"] * 4 + ["ok"] * 6 + ["pause", "resume", "resume", "fail", "stop", "retry", "retry", "skip", "?"]
    return [(j, s, r.choice(kinds), 5 + j) for j in range(jobs) for s in range(r.randint(1, events))]


def test_history_equals_a_loop_and_the_stream(spark, tmp_path):
    rows = log(7)
    want, state = set(), {}
    for j, s, e, n in rows:
        state[j] = L.step(state.get(j, L.START), e, n)
        want.add((j, s, e, *state[j]))
    df = spark.createDataFrame(rows + [(None, 1, "start", 3), (3, None, "start", 3)], EVENTS)
    assert {tuple(r) for r in L.history(df).collect()} == want
    assert {(r.job_id, (r.status, r.closed, r.paused, r.retries)) for r in L.latest(df).collect()} == set(state.items())
    assert {"done", "failed", "pending"} <= {x[3] for x in want}
    for a in (0, 30, 60):
        df.where(f"seq between {a} and {a + 29} or seq is null").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = L.history_stream(stream).writeStream.format("memory").queryName("jobs_seen").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("jobs_seen").collect()} == want
    assert L.history(df.limit(0)).count() == 0
