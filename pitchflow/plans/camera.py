"""Queries over framing and camera paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..operators import backends
from ..operators import camera as C
from ..schema import CameraRules
from .bindings import POSITIONS, positions, rounded
from .geometry import _RAYS, GROUND

RULES = CameraRules()

_EXT = f"""{_RAYS}, ext AS (SELECT match_id, frame, (min(degrees(atan2(r0, r2))) + max(degrees(atan2(r0, r2)))) / 2 AS yaw, max(degrees(atan2(r0, r2))) - min(degrees(atan2(r0, r2))) + 16 AS hfov, quantile_cont(degrees(asin(greatest(least(-r1, 1), -1))), 0.5) AS el FROM rays GROUP BY ALL)"""


@query("frame_extents", sql=f"WITH {_EXT} SELECT match_id, frame, round(yaw, 6) AS yaw, round(hfov, 6) AS hfov, round(el, 6) AS el FROM ext")
def frame_extents(spark, sf_dir):
    return rounded(C.extents(positions(spark, sf_dir), GROUND, RULES), 6)


def _frames(p):
    return p.groupBy("match_id").agg(F.explode(F.sequence(F.min("frame"), F.max("frame"))).alias("frame"))


def _spring(name: str, axis: C.Axis) -> str:
    """The next speed of a spring at `name`_p with speed `name`_v towards `name`_t."""
    rate, gap = f"{2 / max(axis.smooth, 1e-3)!r}::DOUBLE", f"({name}_t - {name}_p)"
    ease = f"CASE WHEN abs({gap}) < {axis.deadzone!r}::DOUBLE THEN power(abs({gap}) / {axis.deadzone!r}::DOUBLE, 2) ELSE 1 END" if axis.deadzone > 0 else "1"
    force = f"greatest(least({rate} * {rate} * {gap} * {ease} - 2 * {rate} * {name}_v, {axis.a_max!r}::DOUBLE), -{axis.a_max!r}::DOUBLE)"
    return f"greatest(least({name}_v + {RULES.dt!r}::DOUBLE * {force}, {axis.v_max!r}::DOUBLE), -{axis.v_max!r}::DOUBLE)"


def _springs(rows: str, into: str, names: tuple[str, ...]) -> str:
    """A recursion over `rows` (match_id, frame, i and goals `name`_t) that moves one spring a name."""
    ax = C.axes(RULES)
    cols = lambda f: ", ".join(f(n) for n in names)
    return f"""{into} AS (SELECT match_id, frame, i, {cols(lambda n: f"{n}_t AS {n}_p, 0.0::DOUBLE AS {n}_v")} FROM {rows} WHERE i = 1
 UNION ALL SELECT match_id, frame, i, {cols(lambda n: f"{n}_p + {RULES.dt!r}::DOUBLE * {n}_n, {n}_n")} FROM (SELECT match_id, frame, i, {cols(lambda n: f"{n}_p, {_spring(n, ax[n])} AS {n}_n")}
  FROM (SELECT n.match_id, n.frame, n.i, {cols(lambda n: f"n.{n}_t, s.{n}_p, s.{n}_v")} FROM {into} s JOIN {rows} n ON n.match_id = s.match_id AND n.i = s.i + 1)))"""


_LIMIT = max(0, round(RULES.dropout_hold_s / RULES.dt))
_HELD = f"""{_EXT}, seen AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame) AS i FROM ext),
held AS (SELECT match_id, frame, yaw, hfov, i, true AS taken, hfov AS ref, CAST(NULL AS BIGINT) AS since FROM seen WHERE i = 1
 UNION ALL SELECT match_id, frame, yaw, hfov, i, NOT (low AND frame - begun < {_LIMIT}), CASE WHEN low AND frame - begun < {_LIMIT} THEN ref ELSE hfov END, CASE WHEN low AND frame - begun < {_LIMIT} THEN begun END
  FROM (SELECT *, CASE WHEN low THEN coalesce(since, frame) END AS begun FROM (SELECT n.match_id, n.frame, n.yaw, n.hfov, n.i, s.ref, s.since, n.hfov < {RULES.dropout_frac!r}::DOUBLE * s.ref AS low FROM held s JOIN seen n ON n.match_id = s.match_id AND n.i = s.i + 1)))"""
_AHEAD = max(1, round(RULES.lookahead_s / RULES.dt))
_D_RAW = f"""CASE WHEN room <= 0 THEN {RULES.d_cap!r}::DOUBLE WHEN t * c >= s THEN 0 WHEN t - s <= 1e-9 THEN {RULES.d_cap!r}::DOUBLE ELSE least({RULES.d_cap!r}::DOUBLE, greatest(0, (s - t * c) / (t - s))) END"""
_PATH = f"""WITH RECURSIVE {_HELD},
span AS (SELECT match_id, unnest(range(min(frame), max(frame) + 1)) AS frame FROM positions GROUP BY match_id),
full_ AS (SELECT match_id, frame, coalesce(last_value(yaw IGNORE NULLS) OVER b, first_value(yaw IGNORE NULLS) OVER a) AS yaw, coalesce(last_value(hf IGNORE NULLS) OVER b, first_value(hf IGNORE NULLS) OVER a) AS hfov
 FROM span LEFT JOIN (SELECT match_id, frame, yaw, least(greatest(hfov, {RULES.hfov_min!r}::DOUBLE), {RULES.hfov_max!r}::DOUBLE) AS hf FROM held WHERE taken) USING (match_id, frame)
 WINDOW b AS (PARTITION BY match_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY match_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
goals AS MATERIALIZED (SELECT match_id, frame, row_number() OVER (PARTITION BY match_id ORDER BY frame) AS i, quantile_cont(yaw, 0.5) OVER w AS yaw_t, {GROUND.fixed_pitch()!r}::DOUBLE AS pitch_t, max(hfov) OVER w AS hfov_t FROM full_
 WINDOW w AS (PARTITION BY match_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND {_AHEAD} FOLLOWING)),
{_springs("goals", "moved", ("yaw", "pitch", "hfov"))},
views AS (SELECT match_id, frame, i, yaw_p AS yaw, pitch_p AS pitch, least(greatest(hfov_p, {RULES.hfov_min!r}::DOUBLE), {RULES.hfov_max!r}::DOUBLE) AS hfov FROM moved),
rooms AS (SELECT *, {RULES.lens.vfov_deg / 2 - RULES.d_safety_deg!r}::DOUBLE - abs(pitch + {RULES.lens.pitch0_deg!r}::DOUBLE) + {RULES.d_black_deg!r}::DOUBLE AS room, {RULES.out_h / RULES.out_w!r}::DOUBLE * sin(radians(hfov) / 2) AS s, cos(radians(hfov) / 2) AS c FROM views),
wants AS MATERIALIZED (SELECT match_id, frame, i, {_D_RAW} AS d_t FROM (SELECT *, tan(radians(room)) AS t FROM rooms)),
{_springs("wants", "bent", ("d",))},
path AS (SELECT v.match_id, v.frame, v.yaw, v.pitch, v.hfov, CASE WHEN least(greatest(d_p, 0), {RULES.d_cap!r}::DOUBLE) < {RULES.d_min!r}::DOUBLE THEN 0 ELSE least(greatest(d_p, 0), {RULES.d_cap!r}::DOUBLE) END AS d FROM views v JOIN bent USING (match_id, i))"""
_PATH_ROWS = f"{_PATH} SELECT match_id, frame, round(yaw, 4) AS yaw, round(pitch, 4) AS pitch, round(hfov, 4) AS hfov, round(d, 4) AS d FROM path"


@query("dropout_hold", sql=f"WITH RECURSIVE {_HELD} SELECT match_id, frame, round(hfov, 6) AS hfov, CAST(taken AS INT) AS taken FROM held")
def dropout_hold(spark, sf_dir):
    ext = C.extents(positions(spark, sf_dir), GROUND, RULES)
    return rounded(C.hold_dropouts(ext, RULES).select("match_id", "frame", "hfov", F.col("taken").cast("int").alias("taken")), 6)


_SPARSE = f"{POSITIONS}, kept AS (SELECT match_id, frame, max(x) AS yaw, min(z) AS hfov FROM positions WHERE conf >= 0.84 GROUP BY ALL), frames AS (SELECT match_id, unnest(range(0, CAST(max(frame) + 1 AS BIGINT))) AS frame FROM positions GROUP BY match_id)"


def _sparse(spark, sf_dir):
    p = positions(spark, sf_dir)
    frames = p.groupBy("match_id").agg(F.explode(F.sequence(F.lit(0).cast("long"), F.max("frame"))).alias("frame"))
    return frames, p.where("conf >= 0.84").groupBy("match_id", "frame").agg(F.max("x").alias("yaw"), F.min("z").alias("hfov"))


_FILLED = f"{_SPARSE}, filled AS (SELECT match_id, frame, coalesce(last_value(yaw IGNORE NULLS) OVER b, first_value(yaw IGNORE NULLS) OVER a) AS yaw, coalesce(last_value(hfov IGNORE NULLS) OVER b, first_value(hfov IGNORE NULLS) OVER a) AS hfov FROM frames LEFT JOIN kept USING (match_id, frame) WINDOW b AS (PARTITION BY match_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY match_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@query("carried_frames", sql=f"WITH {_FILLED} SELECT match_id, frame, round(yaw, 9) AS yaw, round(hfov, 9) AS hfov FROM filled")
def carried_frames(spark, sf_dir):
    frames, kept = _sparse(spark, sf_dir)
    return rounded(C.fill(frames, kept, ["yaw", "hfov"]))


@query("look_ahead", sql=f"WITH {_FILLED} SELECT match_id, frame, round(quantile_cont(yaw, 0.5) OVER w, 9) AS yaw_t, round(max(hfov) OVER w, 9) AS hfov_t FROM filled WINDOW w AS (PARTITION BY match_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING)")
def look_ahead(spark, sf_dir):
    frames, kept = _sparse(spark, sf_dir)
    return rounded(C.look_ahead(C.fill(frames, kept, ["yaw", "hfov"]), RULES, ("yaw",)).select("match_id", "frame", "yaw_t", "hfov_t"))


@query(
    "delayed_targets",
    sql=f"WITH {_FILLED} SELECT match_id, frame, round(quantile_cont(yaw, 0.5) OVER w, 9) AS yaw_t, round(quantile_cont(yaw / 2, 0.5) OVER w, 9) AS pitch_t, round(max(hfov) OVER w, 9) AS hfov_t FROM filled WINDOW w AS (PARTITION BY match_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING)",
)
def delayed_targets(spark, sf_dir):
    """The look-ahead as a stream: each chunk of 60 frames waits for the one after it. Half the yaw stands for a pitch."""
    from ..streaming.delay import replayed_targets

    frames, kept = _sparse(spark, sf_dir)
    full = C.fill(frames, kept, ["yaw", "hfov"]).withColumn("pitch", F.col("yaw") / 2)
    return rounded(replayed_targets(full, RULES, 60))


@query("look_ahead_mean", sql=f"WITH {_FILLED} SELECT match_id, frame, round(avg(yaw) OVER (PARTITION BY match_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING), 9) AS yaw_t FROM filled")
def look_ahead_mean(spark, sf_dir):
    frames, kept = _sparse(spark, sf_dir)
    return rounded(C.look_ahead(C.fill(frames, kept, ["yaw", "hfov"]), CameraRules(aggregator="mean"), ("yaw",), ()).select("match_id", "frame", "yaw_t"))


@query(
    "damped_follow",
    sql=f"""WITH RECURSIVE {_FILLED}, num AS (SELECT match_id, frame, yaw, row_number() OVER (PARTITION BY match_id ORDER BY frame) AS i FROM filled),
s AS (SELECT match_id, frame, i, yaw AS pos, 0.0::DOUBLE AS vel FROM num WHERE i = 1
 UNION ALL SELECT match_id, frame, i, pos + nv * 0.05::DOUBLE, nv FROM (SELECT match_id, frame, i, pos, greatest(least(vel + greatest(least(w * w * gap * CASE WHEN abs(gap) < 1 THEN gap * gap ELSE 1 END - 2 * w * vel, 120), -120) * 0.05::DOUBLE, 35), -35) AS nv
  FROM (SELECT n.match_id, n.frame, n.i, s.pos, s.vel, n.yaw - s.pos AS gap, 2.0::DOUBLE / 0.9::DOUBLE AS w FROM s JOIN num n ON n.match_id = s.match_id AND n.i = s.i + 1)))
SELECT match_id, frame, round(pos, 6) AS yaw FROM s""",
)
def damped_follow(spark, sf_dir):
    frames, kept = _sparse(spark, sf_dir)
    full = C.fill(frames, kept, ["yaw"])
    axis, dt = C.axes(RULES)["yaw"], RULES.dt

    def solve(pdf):
        pdf = pdf.sort_values("frame", kind="stable")
        return pdf.assign(yaw=C.follow(pdf["yaw"].to_numpy(), dt, axis)[0])

    return rounded(full.groupBy("match_id").applyInPandas(solve, "match_id long, frame long, yaw double"), 6)


@query("camera_path", sql=_PATH_ROWS)
def camera_path(spark, sf_dir):
    p = positions(spark, sf_dir)
    return rounded(C.camera_path(p, _frames(p), GROUND, RULES), 4)


@query("camera_path_summary", sql=f"{_PATH} SELECT match_id, {', '.join(f'round(min({c}), 4) AS {c}_min, round(max({c}), 4) AS {c}_max' for c in ('yaw', 'pitch', 'hfov'))}, count(*) FILTER (d > 0) AS d_active, round(avg(d) FILTER (d > 0), 4) AS d_mean FROM path GROUP BY match_id")
def camera_path_summary(spark, sf_dir):
    p = positions(spark, sf_dir)
    return rounded(C.summary(C.camera_path(p, _frames(p), GROUND, RULES)), 4)


@query(
    "path_resample",
    sql=f"""WITH {_SPARSE}, b AS (SELECT match_id, f.frame, max(k.frame) FILTER (k.frame <= f.frame) AS l, min(k.frame) FILTER (k.frame >= f.frame) AS r FROM frames f JOIN kept k USING (match_id) GROUP BY ALL)
SELECT b.match_id, b.frame, round(CASE WHEN l IS NULL THEN kr.yaw WHEN r IS NULL OR l = r THEN kl.yaw ELSE kl.yaw + (kr.yaw - kl.yaw) * (CAST(b.frame - l AS DOUBLE) / (r - l)) END, 9) AS yaw FROM b LEFT JOIN kept kl ON kl.match_id = b.match_id AND kl.frame = l LEFT JOIN kept kr ON kr.match_id = b.match_id AND kr.frame = r""",
)
def path_resample(spark, sf_dir):
    frames, kept = _sparse(spark, sf_dir)
    return rounded(C.at_frames(kept, frames, ["yaw"]))


@query("boundary_velocity", sql=f"WITH {_FILLED} SELECT match_id, round(last(yaw ORDER BY frame), 9) AS yaw_pos, round((max_by(yaw, frame) - max_by(prev, frame)) * 20, 9) AS yaw_vel FROM (SELECT *, lag(yaw) OVER (PARTITION BY match_id ORDER BY frame) AS prev FROM filled) GROUP BY match_id")
def boundary_velocity(spark, sf_dir):
    frames, kept = _sparse(spark, sf_dir)
    return rounded(C.boundary_velocity(C.fill(frames, kept, ["yaw"]), 20.0, ["yaw"]))


@query("sub_frames", sql=f"WITH {_SPARSE}, n AS (SELECT *, lead(frame) OVER (PARTITION BY match_id ORDER BY frame) AS nx FROM frames) SELECT match_id, frame, k, round(k / 3.0::DOUBLE, 9) AS part FROM n, (VALUES (0), (1), (2)) t(k) WHERE k = 0 OR nx IS NOT NULL")
def sub_frames(spark, sf_dir):
    return rounded(C.sub_frames(_sparse(spark, sf_dir)[0], 3))


@query("snapped_d", sql=f"WITH {POSITIONS} SELECT match_id, track_id, frame, round(CASE WHEN least(greatest(z / 20, 0), 1.5) < 0.3 THEN 0 ELSE least(greatest(z / 20, 0), 1.5) END, 9) AS d FROM positions")
def snapped_d(spark, sf_dir):
    from ..functions.geometry import clip

    d = clip(F.col("z") / 20, 0.0, 1.5)
    return rounded(positions(spark, sf_dir).select("match_id", "track_id", "frame", F.when(d < 0.3, 0.0).otherwise(d).alias("d")))


_GAPS = f"""WITH {_FILLED}, g AS (SELECT match_id, frame, yaw, hfov, lead(yaw) OVER w AS yaw2, lead(hfov) OVER w AS hfov2, lead(frame) OVER w IS NOT NULL AS more FROM filled WINDOW w AS (PARTITION BY match_id ORDER BY frame)), k(k) AS (VALUES (0), (1), (2), (3)),
s AS (SELECT *, k / 4.0::DOUBLE AS t FROM g JOIN k ON k = 0 OR more)"""


@query("interpolated_path", sql=f"{_GAPS} SELECT match_id, frame, CAST(k AS INT) AS k, round(CASE WHEN k = 0 THEN yaw ELSE yaw + (yaw2 - yaw) * t END, 9) AS yaw, round(CASE WHEN k = 0 THEN hfov ELSE hfov + (hfov2 - hfov) * t END, 9) AS hfov FROM s")
def interpolated_path(spark, sf_dir):
    """Three rows between frames, by the backend that takes all steps at once."""
    frames, kept = _sparse(spark, sf_dir)
    return rounded(backends.interpolated(C.fill(frames, kept, ["yaw", "hfov"]), ["yaw", "hfov"], 4))


@query("eased_path", sql=f"{_GAPS} SELECT match_id, frame, CAST(k AS INT) AS k, round(CASE WHEN k = 0 THEN yaw ELSE yaw + (yaw2 - yaw) * (t * t * (3 - 2 * t)) END, 9) AS yaw, round(CASE WHEN k = 0 THEN hfov ELSE hfov + (hfov2 - hfov) * (t * t * (3 - 2 * t)) END, 9) AS hfov FROM s")
def eased_path(spark, sf_dir):
    """The same by the backend that takes one step at a time."""
    frames, kept = _sparse(spark, sf_dir)
    return rounded(backends.interpolated(C.fill(frames, kept, ["yaw", "hfov"]), ["yaw", "hfov"], 4, "ease"))
