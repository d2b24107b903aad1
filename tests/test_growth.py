"""What larger tables showed: values to the bit as SQL has them, and steps that stay small as tables grow."""

import math
import random

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from pitchflow import catalog
from pitchflow.operators import densify as D
from pitchflow.operators import tracker as T
from pitchflow.plans import tracking
from pitchflow.plans.bindings import detections, rounded


def test_spread_is_the_root_of_squares_to_the_bit(spark):
    r = random.Random(5)
    hits = [(0, t, f, round(r.uniform(-52, 52), 2), 0.45 * r.randrange(100) - 4.0) for t in range(300) for f in (0, 1)]
    want = {}
    for t in range(300):
        (_, _, _, x0, z0), (_, _, _, x1, z1) = hits[2 * t : 2 * t + 2]
        mx, mz = (min(x0, x1) * 0.5 + max(x0, x1) * 0.5), (min(z0, z1) * 0.5 + max(z0, z1) * 0.5)
        far = sorted(math.sqrt((x - mx) * (x - mx) + (z - mz) * (z - mz)) for x, z in ((x0, z0), (x1, z1)))
        want[t] = far[0] * 0.5 + far[1] * 0.5
    df = spark.createDataFrame(hits, "match_id long, track_id long, frame long, x double, z double")
    assert {r.track_id: r.pos_spread for r in D.spread(df, ["match_id", "track_id"]).collect()} == want


def test_rounding_next_to_halves(spark):
    import duckdb

    values = [7919 * i / 1e5 + 5e-10 + 20 for i in range(2000)]
    got = [r.v for r in rounded(spark.createDataFrame([(v,) for v in values], "v double")).collect()]
    assert got == [x for (x,) in duckdb.execute("SELECT round(v, 9) FROM (SELECT unnest(?) AS v)", [values]).fetchall()]


def test_positions_do_not_track_again(spark):
    got = catalog.QUERIES["tracked_positions"](spark, SF)
    assert "InPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = rounded(D.emitted(T.track(detections(spark, SF), tracking.HOURLY), tracking.HOURLY))
    assert sorted(got.collect()) == sorted(want.collect())


def test_matching_over_few_columns_is_the_whole_one():
    r = np.random.default_rng(0)
    for _ in range(500):
        cost = r.uniform(0, 8, (r.integers(1, 7), r.integers(1, 12)))
        cost[cost > 4] = T.UNGATED
        i, j = T.matched(cost)
        want = [(a, b) for a, b in T.assign(cost) if cost[a, b] < T.UNGATED]
        assert sorted(zip(i.tolist(), j.tolist())) == want
        wide = cost.T if cost.shape[0] > cost.shape[1] else cost
        assert T._rows_of(wide)[1:].tolist() == T._rows_of_few(wide.tolist())[1:]


def test_phantoms_where_both_sides_are_coalesced_apart(spark, tmp_path):
    from pitchflow.plans.bindings import hits

    hits(spark, "/root/testdata/sf0.1").withColumn("tiles", F.lit(1).cast("long")).write.parquet(f"{tmp_path}/hits")

    def found(adaptive):
        session = spark.newSession()
        session.conf.set("spark.sql.adaptive.enabled", adaptive)
        h = session.read.parquet(f"{tmp_path}/hits")
        kept = D.long_enough(h, tracking.HOURLY).join(D.stationary(h, tracking.HOURLY).select("match_id", "track_id"), ["match_id", "track_id"], "left_anti")
        return D.phantoms(D.densify(kept, tracking.HOURLY), kept, tracking.HOURLY).count()

    assert found("true") == found("false") > 0


def test_distances_shuffle_hits_alone(spark):
    hits = [(0, 1, f) for f in (3, 4, 9, 9, 15)] + [(0, 2, 7)]
    got = D.hit_distances(spark.createDataFrame(hits, "match_id long, track_id long, frame long"))
    assert sorted(map(tuple, got.collect())) == [(0, t, f, min(abs(f - h) for _, k, h in hits if k == t)) for t, a, b in ((1, 3, 15), (2, 7, 7)) for f in range(a, b + 1)]
    plan = catalog.QUERIES["nearest_hit_distance"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Window")  # above all windows, so nothing exploded is sorted
