"""Queries over raw detections and hits: fusion, tracking, densified positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..operators import densify as D
from ..operators import features as P
from ..operators import fusion, tracker
from ..schema import TrackRules
from ..sources.shared import kept
from .bindings import DETECTIONS, HITS, detections, hits, rounded, table

#: Hourly frames: six hours of coasting.
HOURLY = TrackRules(fps=1.0, stride=1, coast_s=6.0, min_hits=3, stationary_spread=15.0, stationary_s=100.0, phantom_s=24.0, phantom_spread=12.0, phantom_tiles=1)
SPLIT = TrackRules(near_tiles=2)
_K = "match_id, track_id"

_PAIRS = f"""{DETECTIONS}, met AS (SELECT a.match_id, a.frame, a.det_id AS a_id, b.det_id AS b_id, a.tile AS ta, b.tile AS tb, (a.x + b.x) / 2 - 0.0 AS mx, (a.z + b.z) / 2 + 8.0 AS mz, a.x - b.x AS dx, a.z - b.z AS dz
  FROM detections a JOIN detections b ON a.match_id = b.match_id AND a.frame = b.frame AND a.det_id < b.det_id),
polar AS (SELECT *, (dx * mx + dz * mz) / sqrt(mx * mx + mz * mz) AS radial, CASE WHEN (ta < 2) <> (tb < 2) THEN 2.0 ELSE 1.0 END AS s FROM met WHERE sqrt(mx * mx + mz * mz) >= 1e-6),
pairs AS (SELECT match_id, frame, a_id, b_id, sqrt((sqrt(greatest(dx * dx + dz * dz - radial * radial, 0)) / (0.6 * s)) ** 2 + (radial / (2.5 * s)) ** 2) AS score FROM polar)"""


@query("detection_pairs", sql=f"WITH {_PAIRS} SELECT match_id, frame, a_id, b_id, round(score, 6) AS score FROM pairs WHERE score < 1")
def detection_pairs(spark, sf_dir):
    return rounded(fusion.pairs(detections(spark, sf_dir), SPLIT), 6)


_CLUSTERS = f"""RECURSIVE {_PAIRS}, edges AS (SELECT match_id, frame, a_id, b_id FROM pairs WHERE score < 1 UNION ALL SELECT match_id, frame, b_id, a_id FROM pairs WHERE score < 1),
reach AS (SELECT match_id, frame, a_id AS src, b_id AS dst FROM edges UNION SELECT r.match_id, r.frame, r.src, e.b_id FROM reach r JOIN edges e ON e.match_id = r.match_id AND e.frame = r.frame AND e.a_id = r.dst),
roots AS (SELECT match_id, frame, src AS det_id, min(dst) AS m FROM reach GROUP BY ALL),
named AS (SELECT d.*, coalesce(least(r.m, d.det_id), d.det_id) AS cluster FROM detections d LEFT JOIN roots r USING (match_id, frame, det_id))"""


@query("detection_clusters", sql=f"WITH {_CLUSTERS} SELECT match_id, frame, det_id, cluster FROM named")
def detection_clusters(spark, sf_dir):
    return fusion.clusters(detections(spark, sf_dir), SPLIT).select("match_id", "frame", "det_id", "cluster")


@query(
    "fused_detections",
    sql=f"""WITH {_CLUSTERS}, g AS (SELECT match_id, frame, cluster, bool_or(tile < 2) AND bool_or(tile >= 2) AS mixed, max_by(x, struct_pack(h := height, i := -det_id)) AS tx, max_by(z, struct_pack(h := height, i := -det_id)) AS tz,
  sum(x * conf) / sum(conf) AS wx, sum(z * conf) / sum(conf) AS wz, max(conf) AS conf, count(*) AS n, count(DISTINCT tile) AS tiles FROM named GROUP BY ALL)
SELECT match_id, frame, cluster, round(CASE WHEN mixed THEN tx ELSE wx END, 6) AS x, round(CASE WHEN mixed THEN tz ELSE wz END, 6) AS z, round(conf, 6) AS conf, n, tiles FROM g""",
)
def fused_detections(spark, sf_dir):
    return rounded(fusion.fused(detections(spark, sf_dir), SPLIT).drop("boxes"), 6)


@query(
    "suppressed_boxes",
    sql=f"""WITH RECURSIVE {DETECTIONS}, boxes AS (SELECT match_id, frame, tile, det_id, conf, x AS x1, z AS y1, x + 30 AS x2, z + 20 AS y2, row_number() OVER (PARTITION BY match_id, frame, tile ORDER BY conf DESC, det_id) AS i FROM detections WHERE conf >= 0.5),
kept AS (SELECT match_id, frame, tile, i, [struct_pack(d := det_id, c := conf, x := x1, y := y1)] AS k FROM boxes WHERE i = 1
 UNION ALL SELECT b.match_id, b.frame, b.tile, b.i, CASE WHEN len(list_filter(s.k, lambda v: greatest(0, 30 - abs(v.x - b.x1)) * greatest(0, 20 - abs(v.y - b.y1)) > 0.5 * (1200 - greatest(0, 30 - abs(v.x - b.x1)) * greatest(0, 20 - abs(v.y - b.y1))))) = 0 THEN list_append(s.k, struct_pack(d := b.det_id, c := b.conf, x := b.x1, y := b.y1)) ELSE s.k END
 FROM kept s JOIN boxes b ON b.match_id = s.match_id AND b.frame = s.frame AND b.tile = s.tile AND b.i = s.i + 1),
last AS (SELECT match_id, frame, tile, unnest(k) AS v FROM kept QUALIFY i = max(i) OVER (PARTITION BY match_id, frame, tile))
SELECT match_id, frame, tile, v.d AS det_id, round(v.c, 9) AS conf, round(v.x, 9) AS x1, round(v.y, 9) AS y1, round(v.x + 30, 9) AS x2, round(v.y + 20, 9) AS y2 FROM last""",
)
def suppressed_boxes(spark, sf_dir):
    d = detections(spark, sf_dir)
    box = d.select("match_id", "frame", "tile", "det_id", "conf", F.col("x").alias("x1"), F.col("z").alias("y1"), (F.col("x") + 30).alias("x2"), (F.col("z") + 20).alias("y2"))
    return rounded(fusion.suppress(box))


@query("tracks")
def tracks(spark, sf_dir):
    return rounded(tracker.track(detections(spark, sf_dir), HOURLY))


@query("tracked_positions")
def tracked_positions(spark, sf_dir):
    """The tracker runs once: its hits are written down, as lengths, stationary tracks, frames and phantoms each read them."""
    h = kept(tracker.track(detections(spark, sf_dir), HOURLY), "hits")
    return rounded(D.emitted(h, HOURLY))


_DENSE = f"""{HITS}, seg AS (SELECT match_id, track_id, frame, x, z, conf, lead(frame) OVER w AS f2, lead(x) OVER w AS x2, lead(z) OVER w AS z2, lead(conf) OVER w AS c2 FROM hits WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame)),
steps AS (SELECT *, coalesce(f2 - frame, 1) AS gap, unnest(range(0, coalesce(f2 - frame, 1))) AS s FROM seg),
dense AS (SELECT match_id, track_id, frame + s AS frame, CASE WHEN s = 0 THEN x ELSE x + (x2 - x) * (CAST(s AS DOUBLE) / gap) END AS x, CASE WHEN s = 0 THEN z ELSE z + (z2 - z) * (CAST(s AS DOUBLE) / gap) END AS z,
  CASE WHEN s = 0 THEN conf ELSE conf + (c2 - conf) * (CAST(s AS DOUBLE) / gap) END AS conf, CAST(s = 0 AS INT) AS is_hit FROM steps WHERE least(s, gap - s) <= 6)"""


@query("densified", sql=f"WITH {_DENSE} SELECT match_id, track_id, frame, round(x, 9) AS x, round(z, 9) AS z, round(conf, 9) AS conf, is_hit FROM dense")
def densified(spark, sf_dir):
    return rounded(D.densify(hits(spark, sf_dir), HOURLY).withColumn("is_hit", F.col("is_hit").cast("int")))


@query(
    "nearest_hit_distance",
    sql=f"""WITH {HITS}, spans AS (SELECT match_id, track_id, min(frame) AS a, max(frame) AS b FROM hits GROUP BY ALL), frames AS (SELECT match_id, track_id, unnest(range(a, b + 1)) AS frame FROM spans)
SELECT f.match_id, f.track_id, f.frame, min(abs(h.frame - f.frame)) AS dist FROM frames f JOIN hits h ON h.match_id = f.match_id AND h.track_id = f.track_id GROUP BY ALL""",
)
def nearest_hit_distance(spark, sf_dir):
    return D.hit_distances(hits(spark, sf_dir))


_SPREAD = f"""{HITS}, mid AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY {_K}) AS mx, quantile_cont(z, 0.5) OVER (PARTITION BY {_K}) AS mz FROM hits),
spread AS (SELECT match_id, track_id, count(*) AS hit_count, max(frame) - min(frame) AS span, CASE WHEN count(*) >= 2 THEN quantile_cont(sqrt((x - mx) ** 2 + (z - mz) ** 2), 0.5) ELSE 'infinity'::DOUBLE END AS pos_spread FROM mid GROUP BY match_id, track_id)"""
_STILL = "span >= 100 AND pos_spread < 15"


@query("stationary_tracks", sql=f"WITH {_SPREAD} SELECT match_id, track_id, round(pos_spread, 9) AS pos_spread, span FROM spread WHERE {_STILL.replace('15', '27')}")
def stationary_tracks(spark, sf_dir):
    from dataclasses import replace

    s = D.stationary(hits(spark, sf_dir), replace(HOURLY, stationary_spread=27.0))
    return rounded(s.select("match_id", "track_id", "pos_spread", "span"))


@query(
    "emit_stats",
    sql=f"WITH {_SPREAD} SELECT match_id, count(*) AS n_history, CAST(sum(CAST(hit_count < 3 AS INT)) AS BIGINT) AS n_short, CAST(sum(CAST(hit_count >= 3 AND {_STILL} AS INT)) AS BIGINT) AS n_stationary, CAST(sum(CAST(hit_count >= 3 AND NOT ({_STILL}) AS INT)) AS BIGINT) AS n_emitted FROM spread GROUP BY match_id",
)
def emit_stats(spark, sf_dir):
    return D.emit_stats(hits(spark, sf_dir), HOURLY)


_TILED = f"{HITS}, tiled AS (SELECT *, CAST(tile % 2 + 1 AS BIGINT) AS tiles FROM hits)"


_PHANTOMS = f"""WITH {_TILED}, near AS (SELECT f.match_id, f.track_id, f.frame, h.x, h.z, h.tiles, quantile_cont(h.x, 0.5) OVER g AS mx, quantile_cont(h.z, 0.5) OVER g AS mz FROM tiled f JOIN tiled h ON h.match_id = f.match_id AND h.track_id = f.track_id AND h.frame BETWEEN f.frame - 24 AND f.frame + 24 WINDOW g AS (PARTITION BY f.match_id, f.track_id, f.frame))
SELECT match_id, track_id, frame, round(quantile_cont(sqrt((x - mx) ** 2 + (z - mz) ** 2), 0.5), 6) AS near_spread FROM near GROUP BY ALL HAVING count(*) >= 2 AND max(tiles) BETWEEN 1 AND 1 AND quantile_cont(sqrt((x - mx) ** 2 + (z - mz) ** 2), 0.5) < 12"""


@query("phantom_frames", sql=_PHANTOMS)
def phantom_frames(spark, sf_dir):
    h = hits(spark, sf_dir).withColumn("tiles", (F.col("tile") % 2 + 1).cast("long"))
    return rounded(D.phantoms(h.select("match_id", "track_id", "frame"), h, HOURLY), 6)


@query("phantom_counts", sql=f"SELECT match_id, count(frame) AS n_phantom FROM (SELECT DISTINCT user_id // 32 AS match_id FROM events) LEFT JOIN ({_PHANTOMS}) USING (match_id) GROUP BY match_id")
def phantom_counts(spark, sf_dir):
    h = hits(spark, sf_dir).withColumn("tiles", (F.col("tile") % 2 + 1).cast("long"))
    return D.phantom_counts(h.select("match_id", "track_id", "frame"), h, HOURLY)


@query(
    "hits_around",
    sql=f"WITH {HITS} SELECT match_id, track_id, frame, count(*) OVER w AS n, round(max(conf) OVER w, 9) AS best FROM hits WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame RANGE BETWEEN 24 PRECEDING AND 24 FOLLOWING)",
)
def hits_around(spark, sf_dir):
    h = hits(spark, sf_dir).withColumn("tiles", F.lit(1))
    hs = h.select("match_id", "track_id", "frame", F.col("conf").alias("x"), "z", "tiles")
    return rounded(D.around(h.select("match_id", "track_id", "frame"), hs, 24).select("match_id", "track_id", "frame", F.size("near").cast("long").alias("n"), F.array_max(F.transform("near", lambda v: v["hx"])).alias("best")))


@query("min_hit_tracks", sql=f"WITH {HITS} SELECT match_id, track_id, count(*) AS n FROM hits GROUP BY ALL HAVING count(*) >= 3")
def min_hit_tracks(spark, sf_dir):
    return D.long_enough(hits(spark, sf_dir), HOURLY).groupBy("match_id", "track_id").agg(F.count("*").alias("n"))


@query("wanted_detections", sql=f"WITH {DETECTIONS} SELECT match_id, frame, det_id FROM detections WHERE tile = 0")
def wanted_detections(spark, sf_dir):
    """The tile stands for the detector's class, of which the table has none."""
    return P.of_class(detections(spark, sf_dir), "tile").select("match_id", "frame", "det_id")


@query("detections_per_step", sql=f"WITH {DETECTIONS} SELECT match_id, frame, tile, count(*) AS n, round(max(conf), 9) AS best FROM detections GROUP BY ALL")
def detections_per_step(spark, sf_dir):
    return rounded(detections(spark, sf_dir).groupBy("match_id", "frame", "tile").agg(F.count("*").alias("n"), F.max("conf").alias("best")))


@query(
    "edge_cut_filter",
    sql=f"WITH {DETECTIONS} SELECT match_id, frame, det_id, CAST(top_cut AS INT) AS top_cut, CAST(bot_cut AS INT) AS bot_cut FROM (SELECT *, z <= 6 AS top_cut, z + height / 10 >= 34 AS bot_cut FROM detections WHERE tile <> 4) WHERE NOT (top_cut AND bot_cut) AND conf >= 0.5",
)
def edge_cut_filter(spark, sf_dir):
    """One class only, sure enough, and not cut at both edges."""
    from ..functions.boxes import cuts

    top, bottom = cuts(F.col("z"), F.col("z") + F.col("height") / 10, 40.0)
    d = detections(spark, sf_dir).where("tile <> 4 and conf >= 0.5").withColumns({"top_cut": top, "bot_cut": bottom}).where("not (top_cut and bot_cut)")
    return d.select("match_id", "frame", "det_id", F.col("top_cut").cast("int").alias("top_cut"), F.col("bot_cut").cast("int").alias("bot_cut"))


@query("tile_lookup", sql=f"WITH {DETECTIONS}, tiles(tile, yaw) AS (VALUES (0, -60.0::DOUBLE), (1, -20.0::DOUBLE), (2, 20.0::DOUBLE), (3, 60.0::DOUBLE)) SELECT match_id, frame, det_id, yaw FROM detections JOIN tiles USING (tile)")
def tile_lookup(spark, sf_dir):
    tiles = spark.createDataFrame([(0, -60.0), (1, -20.0), (2, 20.0), (3, 60.0)], "tile int, yaw double")
    return detections(spark, sf_dir).join(F.broadcast(tiles), "tile").select("match_id", "frame", "det_id", "yaw")


@query("unmatched_detections", sql=f"WITH {HITS} SELECT match_id, frame, det_id FROM detections WHERE det_id NOT IN (SELECT det_id FROM hits)")
def unmatched_detections(spark, sf_dir):
    return detections(spark, sf_dir).join(hits(spark, sf_dir).select("det_id"), "det_id", "left_anti").select("match_id", "frame", "det_id")


@query(
    "nearest_same_frame",
    sql=f"""WITH {DETECTIONS}, sure AS (SELECT * FROM detections WHERE conf >= 0.9), low AS (SELECT * FROM detections WHERE conf < 0.4)
SELECT l.match_id, l.frame, l.det_id, min_by(s.det_id, struct_pack(d := round(sqrt((l.x - s.x) ** 2 + (l.z - s.z) ** 2), 9), i := s.det_id)) AS near_id, round(min(sqrt((l.x - s.x) ** 2 + (l.z - s.z) ** 2)), 9) AS dist
FROM low l JOIN sure s ON s.match_id = l.match_id AND s.frame = l.frame GROUP BY ALL""",
)
def nearest_same_frame(spark, sf_dir):
    """Each unsure detection's nearest sure one in its frame: by cell first, then by frame for those without one near."""
    d = detections(spark, sf_dir)
    return fusion.nearest(d.where("conf < 0.4"), d.where("conf >= 0.9"), 5.0)


@query("customer_activity", sql="SELECT c_custkey, CAST(EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS INT) AS active FROM customer")
def customer_activity(spark, sf_dir):
    """A flag by membership in another table: left join on its distinct keys."""
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_a", F.lit(1))
    return table(spark, sf_dir, "customer").join(seen, "c_custkey", "left").select("c_custkey", F.coalesce("_a", F.lit(0)).alias("active"))
