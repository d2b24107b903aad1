"""Streams against the batch forms of the same operators."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pitchflow.operators import camera as C
from pitchflow.operators import chunks as K
from pitchflow.schema import CameraRules
from pitchflow.sources import progress
from pitchflow.sources.shared import in_order, stepped
from pitchflow.streaming import delay, monitor
from pitchflow.streaming.corrections import Corrected
from pyspark.sql import functions as F

SIGNALS = "match_id long, frame long, yaw double, pitch double, hfov double"


def signals(spark, seed=1, matches=(1, 2, 9), frames=130):
    r = random.Random(seed)
    rows = [(m, f + 7 * m, r.uniform(-30, 30), r.uniform(-5, 5), r.uniform(30, 80)) for m in matches for f in range(frames - 13 * m)]
    return spark.createDataFrame(rows, SIGNALS)


def rows_of(df, columns=None):
    columns = columns or df.columns
    return sorted(map(tuple, df.toPandas()[columns].round(9).itertuples(index=False)))


@pytest.mark.parametrize("how", ["median", "mean"])
def test_delayed_targets_equal_batch(spark, how):
    rules = CameraRules(lookahead_s=0.5, aggregator=how)
    df = signals(spark)
    want = C.look_ahead(df, rules).select("match_id", "frame", "yaw_t", "pitch_t", "hfov_t")
    for chunk in (10, 25, 400):
        assert rows_of(delay.replayed_targets(df, rules, chunk)) == rows_of(want)
    with pytest.raises(ValueError, match="shorter"):
        delay.replayed_targets(df, rules, 9)


def test_delay_waits_for_the_next_chunk(spark):
    """Without end marks: of 100 frames in chunks of 20 the first four go; the timer, which another match's frames push on, releases the rest."""
    rules = CameraRules(lookahead_s=0.5)
    one = spark.createDataFrame([(1, f, 1.0 * f, 0.0, 40.0) for f in range(100)], SIGNALS)
    got = delay.replayed_targets(one, rules, 20, end_marks=False)
    assert sorted(r.frame for r in got.collect()) == list(range(80))
    other = spark.createDataFrame([(2, f, 1.0, 0.0, 40.0) for f in range(100, 200)], SIGNALS)
    got = delay.replayed_targets(one.unionByName(other), rules, 20, end_marks=False)
    assert rows_of(got.where("match_id = 1")) == rows_of(C.look_ahead(one, rules).select(*got.columns))


def test_delay_keeps_one_state_for_a_span_of_matches(spark, tmp_path):
    """State calls grow with the spans, not the matches; each match still waits, ends and is timed out by itself."""
    rules = CameraRules(lookahead_s=0.5)
    r = random.Random(3)
    df = spark.createDataFrame([(m, f, r.uniform(-30, 30), 1.0 * m, r.uniform(30, 80)) for m in range(0, 40, 2) for f in range(m % 7, 100 - m)], SIGNALS)
    ended = df.where("match_id < 10")
    marks = ended.groupBy("match_id").agg(F.lit(500).cast("long").alias("frame")).selectExpr("match_id", "frame", "null yaw", "null pitch", "null hfov", "true ended")
    clock = spark.createDataFrame([(99, f, 0.0, 0.0, 40.0) for f in (200, 300)], SIGNALS)
    rows = df.unionByName(clock).selectExpr("*", "false ended").unionByName(marks)
    session = spark.newSession()
    session.conf.set(delay._STORE, delay._ROCKS)
    delay.in_order(delay.stepped(rows, "chunk", 20), f"file://{tmp_path}/in", "chunk")
    stream = session.readStream.schema(delay.SIGNALS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = delay.delayed_targets(stream, rules, 20).writeStream.format("memory").queryName("spans").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
    q.awaitTermination()
    got = session.table("spans").where("match_id < 99")
    assert rows_of(got) == rows_of(C.look_ahead(df, rules).select(*got.columns)) and got.count() > 500
    timers = [p.stateOperators[0].customMetrics["numRegisteredTimers"] for p in q.recentProgress if p.stateOperators]
    assert 2 <= max(timers) <= 4


def test_late_rows_of_a_released_chunk_are_passed_over(spark, tmp_path):
    rules = CameraRules(lookahead_s=0.5)
    session = spark.newSession()
    session.conf.set(delay._STORE, delay._ROCKS)
    batches = [[(1, f, 1.0, 0.0, 40.0, False) for f in fs] for fs in (range(0, 60), [3, 5, 61, 62], range(63, 100))] + [[(1, 100, None, None, None, True)]]
    for b in batches:
        session.createDataFrame(b, delay.SIGNALS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.02)
    stream = session.readStream.schema(delay.SIGNALS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = delay.delayed_targets(stream, rules, 20, "10 seconds").writeStream.format("memory").queryName("late").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.frame for r in session.table("late").collect()) == [f for f in range(100) if f != 60]


def test_streamed_path_equals_batch_across_chunks(spark):
    rules = CameraRules(lookahead_s=0.5)
    df = signals(spark, 2, (1, 2), 90)
    want = pd.concat([C.smooth_path(g.sort_values("frame"), rules)[0] for _, g in C.look_ahead(df, rules).toPandas().groupby("match_id")])
    got = delay.streamed_path(df, rules, 20).toPandas()
    assert sorted(map(tuple, got.round(6).itertuples(index=False))) == sorted(map(tuple, want.round(6).itertuples(index=False)))


def test_ahead():
    v = np.array([3.0, 1.0, 2.0, 5.0])
    assert delay.ahead(v, 2, "median").tolist() == [2.0, 2.0, 3.5, 5.0] and delay.ahead(v, 2, "max").tolist() == [3.0, 5.0, 5.0, 5.0]


# corrections

POS = "match_id long, track_id long, frame long, x double"


def table(spark, seed=3):
    r = random.Random(seed)
    return spark.createDataFrame([(m, t, f, r.random()) for m in (1, 2) for t in range(4) for f in range(60) if r.random() < 0.8], POS)


def test_corrections_equal_batch_joins(spark, tmp_path):
    base = table(spark)
    sure = lambda seed, p: base.where(F.rand(seed) < p).withColumn("x", F.col("x") + seed).cache()
    late = [sure(5, 0.3), sure(6, 0.1).where("match_id = 1"), base.limit(0), spark.createDataFrame([(3, 1, 5, 0.5), (1, 9, 200, 0.7)], POS)]
    kept = Corrected(spark, f"file://{tmp_path}/t", POS, 20).start(base)
    sink, want = kept.sink(), stepped(base, "chunk", 20)
    for epoch, b in enumerate(late):
        sink(b, epoch)
        want = K.corrected(want, stepped(b, "chunk", 20), by=("match_id", "chunk"))
        assert rows_of(kept.current()) == rows_of(want.drop("chunk"))
    after = rows_of(kept.current())
    for epoch in (3, 1, 1, 0):  # a batch that comes again makes the same rows from what stood before it
        before = rows_of(kept.current(before=epoch))
        sink(late[epoch], epoch)
        assert rows_of(kept.current(before=epoch)) == before and rows_of(kept.current()) == after
    # written, but without its manifest: not there yet
    stepped(base.withColumn("x", F.lit(0.0)), "chunk", 20).write.parquet(f"file://{tmp_path}/t/data/epoch=9")
    assert rows_of(kept.current()) == after


def test_corrections_after_a_restart(spark, tmp_path):
    """A query that is started again goes on behind its last batch; one row without a frame is passed over."""
    base = table(spark)
    kept = Corrected(spark, f"file://{tmp_path}/t", POS, 20).start(base)
    base.limit(0).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(POS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    late = base.where("track_id = 2").withColumn("x", F.lit(7.0))
    for k in (0, 1):
        late.where(f"match_id = {k + 1}").unionByName(spark.createDataFrame([(1, 1, None, 1.0)], POS)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = stream.writeStream.foreachBatch(kept.sink()).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    want = K.corrected(stepped(base, "chunk", 20), stepped(late, "chunk", 20), by=("match_id", "chunk"))
    assert rows_of(kept.current()) == rows_of(want.drop("chunk"))


def test_files_in_order(spark, tmp_path):
    df = spark.range(100).withColumn("step", F.col("id") % 7)
    assert in_order(df, f"file://{tmp_path}/o", "step") == 7
    got = []
    stream = spark.readStream.schema("id long, step long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/o")
    q = stream.writeStream.foreachBatch(lambda b, e: got.append({r.step for r in b.collect()})).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert got == [{k} for k in range(7)]


# monitoring


def write(path, name, **doc):
    progress.write_json(str(path / name), doc)


def test_staleness_by_timers(spark, tmp_path):
    """Of three workers one ends, one falls silent and comes back, one is heard all along; half a document says nothing."""
    folder = tmp_path / "in"
    folder.mkdir()
    session = spark.newSession()
    session.conf.set(delay._STORE, delay._ROCKS)
    write(folder, "a.1.json", status="done", step="render", updated_at=1.0)
    write(folder, "b.1.json", status="running", step="track", updated_at=1.0)
    write(folder, "c.1.json", status="running", step="track", updated_at=1.0)
    (folder / "d.1.json").write_text('{"status": "runn')
    q = monitor.signs(monitor.progress_stream(session, str(folder)), 6.0).writeStream.format("memory").queryName("signs").option("checkpointLocation", f"{tmp_path}/s").trigger(processingTime="500 milliseconds").start()
    try:
        seen = lambda: [(r.worker, r.event) for r in session.table("signs").collect()]
        until = time.time() + 90
        k = 2
        while ("b", "stale") not in seen() and time.time() < until:
            write(folder, f"c.{k}.json", status="running", step="track", updated_at=float(k))
            k += 1
            time.sleep(1)
        write(folder, "b.2.json", status="running", step="classify", updated_at=500.0)
        while seen().count(("b", "heard")) < 2 and time.time() < until:
            time.sleep(0.5)
        got = seen()
    finally:
        q.stop()
    assert ("a", "ended") in got and ("a", "stale") not in got and not [x for x in got if x[0] == "d"]
    assert [e for w, e in got if w == "b"][:3] == ["heard", "stale", "heard"] and got.count(("c", "heard")) >= 2


def test_one_failing_query_ends_its_peers(spark, tmp_path):
    def broken(batch, epoch):
        if epoch >= 1:
            raise ValueError("no room left")

    rate = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    start = lambda name, sink: rate.writeStream.queryName(name).foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/{name}").start()
    good, bad = start("good", lambda b, e: None), start("bad", broken)
    with pytest.raises(monitor.StreamsFailed, match="bad failed") as error:
        monitor.together([good, bad], timeout=90)
    assert error.value.name == "bad" and "no room left" in str(error.value.cause) and not good.isActive and not bad.isActive
    assert monitor.together([]) is True
    one = start("one", lambda b, e: None)
    assert monitor.together([one], timeout=0.5) is False and one.isActive
    one.stop()
    assert monitor.together([one]) is True


def test_stream_progress_document(spark, tmp_path):
    """The listener's document follows a query: batches and rows while it runs, then done or failed."""
    listener = progress.StreamProgress(progress.Progress(str(tmp_path / "p.json"), every=0.0))
    spark.streams.addListener(listener)
    try:
        for k, fail in ((0, False), (1, True)):
            def sink(batch, epoch, fail=fail):
                if fail:
                    raise ValueError("broken sink")
                batch.write.format("noop").mode("overwrite").save()

            spark.range(7).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
            q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c{k}").trigger(availableNow=True).start()
            try:
                q.awaitTermination()
            except Exception:  # noqa: BLE001  the document says it
                assert fail
            until = time.time() + 30
            want = "failed" if fail else "done"
            while (progress.read(str(tmp_path / "p.json"), time.time()) or {}).get("status") != want and time.time() < until:
                time.sleep(0.2)
            d = progress.read(str(tmp_path / "p.json"), time.time())
            assert d["status"] == want and d["query"] == str(q.id)
            assert ("broken sink" in d["error"]) if fail else (d.get("rows"), d.get("batch")) == (7, 0), d
    finally:
        spark.streams.removeListener(listener)
