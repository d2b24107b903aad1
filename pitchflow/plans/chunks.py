"""Queries over chunks of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..operators import chunks as C
from .camera import _PATH_ROWS
from .bindings import DETECTIONS, HITS, POSITIONS, detections, hits, positions, rounded, table


@query(
    "chunk_plan",
    sql=f"""WITH {DETECTIONS}, span AS (SELECT match_id, min(frame) * 1.0::DOUBLE AS t0, max(frame) + 1.0::DOUBLE AS t1 FROM detections GROUP BY match_id), c AS (SELECT *, unnest(range(CAST(ceil((t1 - t0) / 30) AS BIGINT))) AS cid FROM span)
SELECT match_id, cid, t0 + 30 * cid AS c_t0, least(t0 + 30 * cid + 30, t1) AS c_t1, CASE WHEN cid = 0 THEN t0 ELSE greatest(t0 + 30 * cid - 2, t0) END AS p_t0, least(least(t0 + 30 * cid + 30, t1) + 4, t1) AS p_t1 FROM c""",
)
def chunk_plan(spark, sf_dir):
    """Chunks of 30 hours over each match's own range."""
    d = detections(spark, sf_dir).groupBy("match_id").agg(F.min("frame").cast("double").alias("t0"), (F.max("frame") + 1).cast("double").alias("t1"))
    return C.plan(d, 30.0, 2.0, 4.0)


@query("tumbling_counts", sql="SELECT epoch_us(ts) // 3600000000 AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rounded(g.select(F.floor(F.unix_micros("w.start") / 3600000000).alias("hour"), "event_type", "n", "total"), 6)


@query("sliding_counts", sql="SELECT b AS start_hour, count(*) AS n FROM (SELECT epoch_us(ts) // 3600000000 AS h FROM events) e, (VALUES (0), (1), (2)) t(k), LATERAL (SELECT h - k AS b) GROUP BY b")
def sliding_counts(spark, sf_dir):
    """Three-hour windows that start every hour."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    g = e.groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.floor(F.unix_micros("w.start") / 3600000000).alias("start_hour"), "n")


@query("session_lives", sql=f"WITH {HITS}, f AS (SELECT *, CASE WHEN frame - lag(frame) OVER w > 12 THEN 1 ELSE 0 END AS nw FROM hits WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame)), s AS (SELECT *, sum(nw) OVER (PARTITION BY match_id, track_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS session FROM f) SELECT match_id, track_id, CAST(session AS BIGINT) AS session, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n FROM s GROUP BY ALL")
def session_lives(spark, sf_dir):
    """Track lives: a gap of more than twelve hours ends one."""
    return C.sessions(hits(spark, sf_dir), ["match_id", "track_id"], 12)


@query(
    "back_emit_merge",
    sql=f"""WITH {POSITIONS}, late AS (SELECT match_id, track_id, frame, x + 1 AS x FROM positions WHERE conf >= 0.7), span AS (SELECT match_id, min(frame) AS a, max(frame) AS b FROM late GROUP BY 1)
SELECT match_id, track_id, frame, round(x, 9) AS x FROM positions p WHERE NOT EXISTS (SELECT 1 FROM late l JOIN span s USING (match_id) WHERE l.match_id = p.match_id AND l.track_id = p.track_id AND p.frame BETWEEN s.a AND s.b) UNION ALL SELECT match_id, track_id, frame, round(x, 9) FROM late""",
)
def back_emit_merge(spark, sf_dir):
    p = positions(spark, sf_dir).select("match_id", "track_id", "frame", "x", "conf")
    late = p.where("conf >= 0.7").select("match_id", "track_id", "frame", (F.col("x") + 1).alias("x"))
    return rounded(C.corrected(p.drop("conf"), late))


@query("distinct_ids", sql=f"WITH {DETECTIONS} SELECT frame, count(DISTINCT track_id) AS tracks, count(DISTINCT tile) AS tiles FROM detections GROUP BY frame")
def distinct_ids(spark, sf_dir):
    return detections(spark, sf_dir).groupBy("frame").agg(F.count_distinct("track_id").alias("tracks"), F.count_distinct("tile").alias("tiles"))


@query("chunked_camera_path", sql=_PATH_ROWS)
def chunked_camera_path(spark, sf_dir):
    """Targets streamed through the stateful smoother in micro-batches of files; the result is read back."""
    from ..streaming.smoother import replay
    from .camera import GROUND, RULES, _frames
    from ..operators.camera import targets

    p = positions(spark, sf_dir)
    return rounded(replay(targets(p, _frames(p), GROUND, RULES), RULES), 4)


@query(
    "streamed_correction",
    sql=f"""WITH {POSITIONS}, p AS (SELECT match_id, track_id, frame, x, conf, frame // 20 AS chunk FROM positions), late AS (SELECT match_id, track_id, frame, chunk, x + 1 AS x FROM p WHERE conf >= 0.7), span AS (SELECT match_id, chunk, min(frame) AS a, max(frame) AS b FROM late GROUP BY ALL)
SELECT match_id, track_id, frame, round(x, 9) AS x FROM p WHERE NOT EXISTS (SELECT 1 FROM late l JOIN span s USING (match_id, chunk) WHERE l.match_id = p.match_id AND l.chunk = p.chunk AND l.track_id = p.track_id AND p.frame BETWEEN s.a AND s.b) UNION ALL SELECT match_id, track_id, frame, round(x, 9) FROM late""",
)
def streamed_correction(spark, sf_dir):
    """Late rows come a chunk of 20 frames a micro-batch and replace their tracks' rows there."""
    from ..sources.shared import stepped
    from ..streaming.corrections import replayed_corrections

    p = positions(spark, sf_dir).select("match_id", "track_id", "frame", "x", "conf")
    late = stepped(p.where("conf >= 0.7").withColumn("x", F.col("x") + 1), "chunk", 20).drop("conf")
    return rounded(replayed_corrections(p.drop("conf"), late, "chunk", 20))
