"""Queries over dense positions: filters, windows, features, labels, activity, probation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..operators import activity as A
from ..operators import features as P
from ..operators import sampling as S
from ..schema import Field
from ..sources.shared import kept
from .bindings import DT, POSITIONS, positions, rounded

FIELD = Field()
_ROW = "match_id, track_id, frame"
_W = "WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame)"


@query("frame_sampling", sql=f"WITH {POSITIONS} SELECT {_ROW}, round(x, 9) AS x, round(z, 9) AS z FROM positions WHERE frame >= 10 AND frame < 50 AND (frame - 10) % 3 = 0")
def frame_sampling(spark, sf_dir):
    return rounded(S.sampled(positions(spark, sf_dir), 0.5, 2.5, 20.0, 3).select("match_id", "track_id", "frame", "x", "z"))


@query("frame_at_time", sql=f"WITH {POSITIONS} SELECT {_ROW}, round(x, 9) AS x, round(z, 9) AS z FROM positions WHERE frame = 21")
def frame_at_time(spark, sf_dir):
    return rounded(S.at_time(positions(spark, sf_dir), 1.05, 0.0).select("match_id", "track_id", "frame", "x", "z"))


@query(
    "nearest_frame",
    sql=f"""WITH {POSITIONS}, kept AS (SELECT * FROM positions WHERE conf >= 0.6), targets AS (SELECT {_ROW} FROM positions)
SELECT t.match_id, t.track_id, t.frame, min_by(k.frame, struct_pack(d := abs(k.frame - t.frame), f := k.frame)) AS near_frame, round(min_by(k.x, struct_pack(d := abs(k.frame - t.frame), f := k.frame)), 9) AS x
FROM targets t LEFT JOIN kept k ON k.match_id = t.match_id AND k.track_id = t.track_id GROUP BY ALL""",
)
def nearest_frame(spark, sf_dir):
    p = positions(spark, sf_dir)
    return rounded(S.nearest(p.where("conf >= 0.6"), p.select("match_id", "track_id", "frame"), "x"))


@query(
    "position_filters",
    sql=f"""WITH {POSITIONS} SELECT {_ROW},
CAST(abs(x) <= 51 AND z >= -1 AND z <= 38 AS INT) AS in_field, CAST(abs(x) <= 52 AND z >= 0.5 AND z <= 35 AS INT) AS in_active,
CAST(z >= -12 AND z <= 52 AND abs(x) <= 75 AS INT) AS plausible, CAST(z >= 5 AND z <= 32 AND abs(x) <= 50 AS INT) AS deep FROM positions""",
)
def position_filters(spark, sf_dir):
    x, z = F.col("x"), F.col("z")
    flags = {"in_field": P.in_field(x, z, FIELD, 1.0), "in_active": P.in_field(x, z, FIELD, near=-0.5, far=-2.0, ends=2.0), "plausible": P.plausible(x, z, FIELD), "deep": P.deep(x, z, FIELD)}
    return positions(spark, sf_dir).select("match_id", "track_id", "frame", *[v.cast("int").alias(k) for k, v in flags.items()])


_SMOOTH = f"""{POSITIONS}, smoothed AS (SELECT *, CASE WHEN n < 5 THEN x ELSE bx / 5 END AS sx, CASE WHEN n < 5 THEN z ELSE bz / 5 END AS sz FROM (SELECT *, count(*) OVER (PARTITION BY match_id, track_id) AS n,
  sum(x) OVER (PARTITION BY match_id, track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS bx, sum(z) OVER (PARTITION BY match_id, track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS bz FROM positions))"""


@query("boxcar_smooth", sql=f"WITH {_SMOOTH} SELECT {_ROW}, round(sx, 9) AS sx, round(sz, 9) AS sz FROM smoothed")
def boxcar_smooth(spark, sf_dir):
    return rounded(P.smooth(positions(spark, sf_dir)).select("match_id", "track_id", "frame", "sx", "sz"))


@query("speeds", sql=f"WITH {POSITIONS} SELECT {_ROW}, round(sqrt((x - lag(x) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) / 0.05, 9) AS speed FROM positions {_W}")
def speeds(spark, sf_dir):
    return rounded(P.speeds(positions(spark, sf_dir), DT).select("match_id", "track_id", "frame", "speed"))


@query(
    "deep_runs",
    sql=f"""WITH {POSITIONS}, flagged AS (SELECT *, row_number() OVER w - sum(CASE WHEN z >= 5 AND z <= 32 AND abs(x) <= 50 THEN 1 ELSE 0 END) OVER w AS island, z >= 5 AND z <= 32 AND abs(x) <= 50 AS d FROM positions {_W})
SELECT match_id, track_id, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame FROM flagged WHERE d GROUP BY match_id, track_id, island""",
)
def deep_runs(spark, sf_dir):
    return P.runs(positions(spark, sf_dir), P.deep(F.col("x"), F.col("z"), FIELD))


@query(
    "recent_deep",
    sql=f"""WITH {POSITIONS} SELECT {_ROW}, round(sum(CASE WHEN z >= 5 AND z <= 32 AND abs(x) <= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, track_id ORDER BY frame ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) * 0.05, 9) AS recent_s FROM positions""",
)
def recent_deep(spark, sf_dir):
    p = positions(spark, sf_dir)
    return rounded(P.recent(p, P.deep(F.col("x"), F.col("z"), FIELD), 5.0, DT).select("match_id", "track_id", "frame", "recent_s"))


_FEATURES = f"""{_SMOOTH}, f1 AS (SELECT *, sx - lag(sx) OVER w AS dx, sz - lag(sz) OVER w AS dz, abs(sx) <= 51 AND sz >= -1 AND sz <= 38 AS "on", sz >= 5 AND sz <= 32 AND abs(sx) <= 50 AS deep,
  row_number() OVER w - sum(CASE WHEN sz >= 5 AND sz <= 32 AND abs(sx) <= 50 THEN 1 ELSE 0 END) OVER w AS island, quantile_cont(sx, 0.5) OVER (PARTITION BY match_id, track_id) AS mx, quantile_cont(sz, 0.5) OVER (PARTITION BY match_id, track_id) AS mz FROM smoothed {_W}),
f2 AS (SELECT *, sum(CAST(deep AS INT)) OVER (PARTITION BY match_id, track_id, island) AS run FROM f1),
features AS (SELECT match_id, track_id, count(*) AS n, coalesce(quantile_cont(sqrt(dx * dx + dz * dz) / 0.05, 0.85), 0) AS p85_speed, any_value(mx) AS x_med, any_value(mz) AS z_med, max(sz) AS z_max, max(sx) - min(sx) AS x_span,
  avg(CAST("on" AS INT)) AS frac_on, avg(CAST(deep AS INT)) AS frac_deep, max(run) * 0.05 AS max_deep_run_s, sum(CAST(deep AS INT)) * 0.05 AS total_deep_s, quantile_cont(sqrt((sx - mx) ** 2 + (sz - mz) ** 2), 0.5) AS pos_spread,
  sqrt(var_pop(sx) + var_pop(sz)) AS pos_std, count(*) * 0.05 AS dur_s FROM f2 GROUP BY match_id, track_id),
labelled AS (SELECT *, abs(x_med) <= 51 AND z_med >= -1 AND z_med <= 38 AS med_in_field,
  CASE WHEN NOT (abs(x_med) <= 51 AND z_med >= -1 AND z_med <= 38) AND round(frac_on, 2) < 0.4 AND max_deep_run_s < 2 THEN 'foreign'
  WHEN round(dur_s, 2) > 6 AND pos_spread < CASE WHEN round(z_med, 2) > 32 THEN 2.0 ELSE 0.5 END THEN 'sideline'
  WHEN max_deep_run_s >= CASE WHEN (round(z_med, 2) < 5 OR round(z_med, 2) > 32) AND pos_std < 2.5 THEN 7.0 ELSE 2.0 END THEN 'player' ELSE 'sideline' END AS label FROM features)"""
_COLS = ["p85_speed", "x_med", "z_med", "z_max", "x_span", "frac_on", "frac_deep", "max_deep_run_s", "total_deep_s", "pos_spread", "pos_std", "dur_s"]


@query("track_features", sql=f"WITH {_FEATURES} SELECT match_id, track_id, n, CAST(med_in_field AS INT) AS med_in_field, {', '.join(f'round({c}, 6) AS {c}' for c in _COLS)} FROM labelled")
def track_features(spark, sf_dir):
    f = P.features(positions(spark, sf_dir), DT)
    return rounded(f.withColumn("med_in_field", F.col("med_in_field").cast("int")), 6)


@query("track_labels", sql=f"WITH {_FEATURES} SELECT match_id, track_id, label FROM labelled")
def track_labels(spark, sf_dir):
    return P.labels(P.features(positions(spark, sf_dir), DT)).select("match_id", "track_id", "label")


@query("label_counts", sql=f"WITH {_FEATURES} SELECT label, count(*) AS n FROM labelled GROUP BY label")
def label_counts(spark, sf_dir):
    return track_labels(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


_ACTIVITY = f"""{POSITIONS}, a1 AS (SELECT *, abs(x) <= 52 AND z >= 0.5 AND z <= 35 AS ai, NOT (abs(x) <= 53.5 AND z >= -1 AND z <= 36.5) AS co,
  sum(CASE WHEN z >= 5 AND z <= 32 AND abs(x) <= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, track_id ORDER BY frame ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) * 0.05 >= 3.0 AS committed FROM positions),
a2 AS (SELECT *, row_number() OVER w - sum(CASE WHEN co AND NOT ai THEN 1 ELSE 0 END) OVER w AS island,
  coalesce(greatest(CASE WHEN z < 0.5 THEN 6 END, CASE WHEN z > 35 THEN 6 END, CASE WHEN abs(x) > 52 THEN 200 END, CASE WHEN committed AND (z < 0.5 OR z > 35) THEN 140 END), 6) AS hold FROM a1 {_W}),
a3 AS (SELECT *, sum(CASE WHEN co AND NOT ai THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, track_id, island ORDER BY frame ROWS UNBOUNDED PRECEDING) AS off_run FROM a2),
a4 AS (SELECT *, CASE WHEN ai THEN 1 WHEN co AND off_run >= hold THEN 0 END AS ev FROM a3),
acts AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY match_id, track_id ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS active FROM a4)"""


@query("activity", sql=f"WITH {_ACTIVITY} SELECT {_ROW}, active, CAST(active = 1 AND abs(x) <= 52 AND z >= 1 AND z <= 34 AS INT) AS well_in FROM acts")
def activity(spark, sf_dir):
    a = A.activity(positions(spark, sf_dir), DT)
    return a.select("match_id", "track_id", "frame", F.col("active").cast("int").alias("active"), F.col("well_in").cast("int").alias("well_in"))


def _states(spark, sf_dir):
    """Positions, the tracks' labels, and the players' active rows with `stable`; what is read more than once is written down once."""
    p = positions(spark, sf_dir)
    named = kept(P.labels(P.features(p, DT)).select("match_id", "track_id", "label"), "labels")
    players = p.join(named.where("label = 'player'"), ["match_id", "track_id"], "left_semi")
    rows = kept(A.active_runs(A.activity(players, DT), DT), "runs")
    return p, named, A.states(rows)


# a run is promoted by its own rows, or at its start by a near run that was promoted before: facts that only grow
_STABLE = f"""RECURSIVE {_FEATURES}, players AS (SELECT p.* FROM positions p JOIN labelled USING (match_id, track_id) WHERE label = 'player'),
{_ACTIVITY[len(POSITIONS) + 2:].replace("FROM positions", "FROM players")},
r1 AS (SELECT *, active = 1 AND abs(x) <= 52 AND z >= 1 AND z <= 34 AS well, lag(active) OVER w AS before FROM acts {_W}),
r2 AS (SELECT *, sum(CASE WHEN active = 1 AND coalesce(before, 0) = 0 THEN 1 ELSE 0 END) OVER w AS run FROM r1 {_W}),
r3 AS (SELECT *, min(frame) OVER (PARTITION BY match_id, track_id, run) AS start, sum(CAST(well AS INT)) OVER (PARTITION BY match_id, track_id, run ORDER BY frame ROWS UNBOUNDED PRECEDING) AS c FROM r2 WHERE active = 1),
rows_ AS MATERIALIZED (SELECT match_id, track_id, frame, x, z, run, start, well, min(CASE WHEN c >= 60 AND frame > start THEN frame END) OVER (PARTITION BY match_id, track_id, run) AS by_count FROM r3),
met AS MATERIALIZED (SELECT DISTINCT a.match_id, a.track_id AS a_track, a.run AS a_run, a.start, b.track_id AS b_track, b.run AS b_run FROM rows_ a JOIN rows_ b ON a.match_id = b.match_id AND a.frame = b.frame WHERE a.frame = a.start AND a.well AND b.frame > b.start AND sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2) <= 8),
facts AS (SELECT DISTINCT match_id, track_id, run, by_count AS since FROM rows_ WHERE by_count IS NOT NULL UNION SELECT m.match_id, m.a_track, m.a_run, m.start FROM facts f JOIN met m ON m.match_id = f.match_id AND m.b_track = f.track_id AND m.b_run = f.run WHERE f.since < m.start),
since AS (SELECT match_id, track_id, run, min(since) AS since FROM facts GROUP BY ALL),
states AS (SELECT r.*, coalesce(r.frame >= s.since, false) AS stable FROM rows_ r LEFT JOIN since s USING (match_id, track_id, run))"""


@query("stable_positions", sql=f"WITH {_STABLE} SELECT {_ROW} FROM states WHERE stable")
def stable_positions(spark, sf_dir):
    return _states(spark, sf_dir)[2].where("stable").select("match_id", "track_id", "frame")


@query("framing_pool", sql=f"WITH {_STABLE} SELECT {_ROW}, round(x, 9) AS x, round(z, 9) AS z FROM states WHERE stable")
def framing_pool(spark, sf_dir):
    p, _, states = _states(spark, sf_dir)
    return rounded(A.framing_pool(p, states.where("stable")).select("match_id", "track_id", "frame", "x", "z"))


@query(
    "labelled_positions",
    sql=f"WITH {_STABLE} SELECT p.match_id, p.track_id, p.frame, CASE WHEN coalesce(l.label, 'player') <> 'player' THEN l.label WHEN s.stable THEN 'player' WHEN NOT s.stable THEN 'probation' ELSE 'sideline' END AS label FROM positions p LEFT JOIN labelled l USING (match_id, track_id) LEFT JOIN states s USING (match_id, track_id, frame)",
)
def labelled_positions(spark, sf_dir):
    return A.final_labels(*_states(spark, sf_dir)).select("match_id", "track_id", "frame", "label")


@query("position_label_join", sql=f"WITH {_FEATURES} SELECT p.match_id, p.track_id, p.frame, coalesce(l.label, 'player') AS label FROM positions p LEFT JOIN (SELECT * FROM labelled WHERE label <> 'foreign') l USING (match_id, track_id)")
def position_label_join(spark, sf_dir):
    p = positions(spark, sf_dir)
    named = P.labels(P.features(p, DT)).where("label <> 'foreign'").select("match_id", "track_id", "label")
    return p.join(named, ["match_id", "track_id"], "left").select("match_id", "track_id", "frame", F.coalesce("label", F.lit("player")).alias("label"))


@query("active_run_table", sql=f"""WITH {_ACTIVITY}, r1 AS (SELECT *, sum(CASE WHEN active = 1 AND coalesce(lag_active, 0) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, track_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, lag(active) OVER w AS lag_active FROM acts {_W}))
SELECT match_id, track_id, CAST(run AS BIGINT) AS run, min(frame) AS start, max(frame) AS stop, count(*) AS n FROM r1 WHERE active = 1 GROUP BY ALL""")
def active_run_table(spark, sf_dir):
    rows = A.active_runs(A.activity(positions(spark, sf_dir), DT), DT)
    return rows.groupBy("match_id", "track_id", "run", "start").agg(F.max("frame").alias("stop"), F.count("*").alias("n"))


@query("track_distance", sql=f"WITH {POSITIONS} SELECT match_id, track_id, round(sum(d), 6) AS distance, round(max(d) / 0.05, 6) AS top_speed FROM (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS d FROM positions {_W}) GROUP BY ALL")
def track_distance(spark, sf_dir):
    """Roadmap: distance and top speed of each track."""
    s = P.speeds(positions(spark, sf_dir), DT)
    return rounded(s.groupBy("match_id", "track_id").agg(F.sum(F.col("speed") * DT).alias("distance"), F.max("speed").alias("top_speed")), 6)


@query("heat_map", sql=f"WITH {POSITIONS} SELECT match_id, CAST(floor(x / 5) AS BIGINT) AS cell_x, CAST(floor(z / 5) AS BIGINT) AS cell_z, count(*) AS n FROM positions GROUP BY ALL")
def heat_map(spark, sf_dir):
    """Roadmap: rows in each 5 m cell."""
    return positions(spark, sf_dir).groupBy("match_id", F.floor(F.col("x") / 5).alias("cell_x"), F.floor(F.col("z") / 5).alias("cell_z")).agg(F.count("*").alias("n"))


@query("radar_trail", sql=f"WITH {POSITIONS} SELECT {_ROW}, list(frame) OVER (PARTITION BY match_id, track_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS trail FROM positions")
def radar_trail(spark, sf_dir):
    """Roadmap: the frames of the last five positions."""
    from pyspark.sql import Window

    w = Window.partitionBy("match_id", "track_id").orderBy("frame").rowsBetween(-4, 0)
    return positions(spark, sf_dir).select("match_id", "track_id", "frame", F.collect_list("frame").over(w).alias("trail"))
