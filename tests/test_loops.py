"""Recurrences and rewrites against plain loops."""

import itertools
import math
import random
import time

import numpy as np
import pandas as pd
from pitchflow.operators import activity as A
from pitchflow.operators import camera as C
from pitchflow.operators import densify as D
from pitchflow.operators import fusion
from pitchflow.operators.tracker import Tracker, assign, segments, track
from pitchflow.schema import ActivityRules, CameraRules, Field, TrackRules

DT, FIELD = 0.05, Field()
RULES = ActivityRules(hold_near_s=0.1, hold_far_s=0.15, hold_ends_s=0.3, hold_committed_s=0.4, committed_window_s=0.4, committed_deep_s=0.15, probation_s=0.25)


def walks(seed, tracks=8, frames=60):
    r, rows = random.Random(seed), []
    for t in range(tracks):
        x, z = r.uniform(-55, 55), r.uniform(-3, 40)
        for f in range(frames):
            x, z = x + r.uniform(-3, 3), z + r.uniform(-3, 3)
            x, z = max(-58.0, min(58.0, x)), max(-5.0, min(42.0, z))
            if r.random() > 0.1:
                rows.append((seed, t, f, round(x, 2), round(z, 2)))
    return rows


def inside(x, z, near, far, ends):
    return abs(x) <= 50 + ends and -near <= z <= 37 + far


def loop(rows):
    """(active, well_in) and stable rows, row by row."""
    by, act, well = {}, set(), set()
    for _, t, f, x, z in rows:
        by.setdefault(t, []).append((f, x, z))
    fr = lambda s: max(0, round(s / DT))
    for t, pts in by.items():
        on, off, deep = False, 0, []
        for f, x, z in pts:
            deep.append(5 <= z <= 32 and abs(x) <= 50)
            committed = sum(deep[-max(1, fr(RULES.committed_window_s)) :]) * DT >= RULES.committed_deep_s
            if inside(x, z, RULES.near, RULES.far, RULES.ends):
                on, off = True, 0
            elif not inside(x, z, RULES.near + 1.5, RULES.far + 1.5, RULES.ends + 1.5):
                off += 1
                near, far, ends = z < 0.5, z > 35, abs(x) > 52
                holds = [fr(RULES.hold_near_s)] * near + [fr(RULES.hold_far_s)] * far + [fr(RULES.hold_ends_s)] * ends + [fr(RULES.hold_committed_s)] * (committed and (near or far))
                if off >= max(holds or [fr(RULES.hold_near_s)]):
                    on = False
            else:
                off = 0
            if on:
                act.add((t, f))
                if inside(x, z, RULES.inside_near, RULES.inside_far, RULES.inside_ends):
                    well.add((t, f))
    stable, state = set(), {t: {"was": False, "up": False, "n": 0} for t in by}
    for f in sorted({r[2] for r in rows}):
        here = [(t, x, z) for _, t, g, x, z in rows if g == f]
        for t, *_ in here:
            if (t, f) not in act:
                state[t] = {"was": False, "up": False, "n": 0}
        live = [(t, x, z) for t, x, z in here if (t, f) in act]
        old = [(x, z) for t, x, z in live if state[t]["was"] and state[t]["up"]]
        for t, x, z in live:
            s = state[t]
            s["n"] += (t, f) in well
            if not s["was"]:
                s["up"] = any(np.hypot(x - a, z - b) <= RULES.isolated for a, b in old) and (t, f) in well
            elif s["n"] >= fr(RULES.probation_s):
                s["up"] = True
            s["was"] = True
            if s["up"]:
                stable.add((t, f))
    return act, well, stable


def test_activity_and_probation(spark):
    rows = [r for s in range(6) for r in walks(s)]
    df = spark.createDataFrame(rows, "match_id long, track_id long, frame long, x double, z double")
    got = A.activity(df, DT, FIELD, RULES)
    a = got.toPandas()
    st = A.stable(got, DT, RULES).toPandas()
    for s in range(6):
        act, well, stable = loop([r for r in rows if r[0] == s])
        m = a[a.match_id == s]
        assert {(t, f) for t, f in m[m.active][["track_id", "frame"]].itertuples(index=False)} == act
        assert {(t, f) for t, f in m[m.well_in][["track_id", "frame"]].itertuples(index=False)} == well
        assert {(t, f) for t, f in st[st.match_id == s][["track_id", "frame"]].itertuples(index=False)} == stable


def test_assignment_is_optimal():
    r = np.random.default_rng(3)
    for n, m in itertools.product(range(1, 6), range(1, 6)):
        for _ in range(4):
            c = np.where(r.random((n, m)) < 0.4, 1e6, r.random((n, m)))
            small, big = min(n, m), max(n, m)
            best = min(sum((c if n <= m else c.T)[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
            found = assign(c)
            assert len({i for i, _ in found}) == len({j for _, j in found}) == small
            assert abs(sum(c[i, j] for i, j in found) - best) < 1e-6


def test_dropout_hold():
    rules = CameraRules(dropout_hold_s=0.2)
    h = np.array([100, 40, 40, 40, 40, 40, 90, 30, 80.0])
    assert C.held(h, np.arange(9), rules).tolist() == [True, False, False, False, False, True, True, False, True]


def test_follow_keeps_its_limits_and_hands_on():
    r = np.random.default_rng(1)
    goal = np.cumsum(r.normal(0, 4, 300))
    axis = C.Axis(0.9, 35.0, 120.0, 1.0)
    whole, end = C.follow(goal, DT, axis)
    assert np.abs(np.diff(whole)).max() <= 35 * DT + 1e-9
    a, s = C.follow(goal[:120], DT, axis)
    b, e = C.follow(goal[120:], DT, axis, state=s)
    assert np.array_equal(np.concatenate([a, b]), whole) and e == end


def test_tracker_hands_on_between_chunks():
    r, rules = np.random.default_rng(2), TrackRules()
    steps = [r.uniform(-20, 20, (r.integers(0, 5), 2)) for _ in range(60)]
    one = Tracker(rules)
    want = [one.step(p).tolist() for p in steps]
    two = Tracker(rules)
    got = [two.step(p).tolist() for p in steps[:25]]
    two = Tracker.from_dict(rules, two.as_dict())
    assert got + [two.step(p).tolist() for p in steps[25:]] == want


def slow_tracks(frames, rules):
    """Whole steps, one track and one frame at a time; the matching by trying all. frames: {frame: [(x, z), ...]}; (frame, place in it) -> id."""
    dt, live, owner, ids = rules.dt, [], {}, itertools.count()
    move = np.array([[1, 0, dt, 0], [0, 1, 0, dt], [0, 0, 1, 0], [0, 0, 0, 1.0]])
    look = np.array([[1.0, 0, 0, 0], [0, 1, 0, 0]])
    a = rules.q_accel**2
    noise = np.zeros((4, 4))
    for k in (0, 1):
        noise[k, k], noise[k, k + 2], noise[k + 2, k], noise[k + 2, k + 2] = dt**4 / 4 * a, dt**3 / 2 * a, dt**3 / 2 * a, dt * dt * a
    seen = rules.r_pos**2 * np.eye(2)

    def correct(t, p):
        gain = t["P"] @ look.T @ np.linalg.inv(look @ t["P"] @ look.T + seen)
        t["s"] = t["s"] + gain @ (np.array(p) - look @ t["s"])
        t["P"] = (np.eye(4) - gain @ look) @ t["P"]
        t["misses"] = 0

    for f in range(min(frames), max(frames) + 1):
        points = frames.get(f, [])
        for t in live:
            t["s"], t["P"], t["misses"] = move @ t["s"], move @ t["P"] @ move.T + noise, t["misses"] + 1
        cost = np.full((len(live), len(points)), 1e6)
        for i, t in enumerate(live):
            for j, p in enumerate(points):
                y = np.array(p) - look @ t["s"]
                d = math.sqrt(y @ np.linalg.inv(look @ t["P"] @ look.T + seen) @ y)
                if d <= rules.gate:
                    cost[i, j] = d
        m, n = cost.shape
        turned = cost if m <= n else cost.T
        ways = itertools.permutations(range(max(m, n)), min(m, n))
        best = min(ways, key=lambda w: sum(turned[i, j] for i, j in enumerate(w)))
        for i, j in enumerate(best):
            i, j = (i, j) if m <= n else (j, i)
            if cost[i, j] < 1e6:
                correct(live[i], points[j])
                owner[f, j] = live[i]["id"]
        for j, p in enumerate(points):
            if (f, j) not in owner:
                t = {"id": next(ids), "s": np.array([*p, 0, 0], float), "P": np.diag([rules.r_pos**2, rules.r_pos**2, 25.0, 25.0])}
                correct(t, p)
                live.append(t)
                owner[f, j] = t["id"]
        live = [t for t in live if t["misses"] <= rules.max_age]
    return owner


def lanes(seed, rules):
    """Detections of four lanes over 160 steps with dropouts, long gaps, and gaps just short of and at max_age."""
    r, rows, det = random.Random(seed), [], 0
    for match in (3, 4):
        x = [r.uniform(-30, 30) for _ in range(4)]
        silent = set(range(40, 40 + rules.max_age)) | set(range(90, 91 + rules.max_age)) | set(range(130, 150))
        for f in range(160):
            x = [v + r.uniform(-1.5, 1.5) for v in x]
            for lane in range(4):
                if r.random() < 0.6 and f not in silent:
                    rows.append((match, f, det, x[lane], 5.0 + 10 * lane + r.uniform(-1.5, 1.5), 0.9, 0, 50.0))
                    det += 1
    return rows


def test_tracks_equal_whole_steps(spark):
    rules = TrackRules(fps=10.0, stride=2, coast_s=0.5, q_accel=3.0)
    for seed in (1, 2):
        rows = lanes(seed, rules)
        d = spark.createDataFrame(rows, "match_id long, frame long, det_id long, x double, z double, conf double, tile int, height double")
        out = track(d, rules).toPandas()
        assert len(out) == len(rows) and out.groupby("match_id").track_id.nunique().min() > 8
        for match, g in out.groupby("match_id"):
            frames = {}
            for m, f, _, x, z, *_ in rows:
                if m == match:
                    frames.setdefault(f, []).append((x, z))
            place = {(f, round(x, 9), round(z, 9)): (f, j) for f, points in frames.items() for j, (x, z) in enumerate(points)}
            got = {place[f, round(x, 9), round(z, 9)]: i for f, x, z, i in g[["frame", "x", "z", "track_id"]].itertuples(index=False)}
            assert got == slow_tracks(frames, rules)
        points = fusion.fused(d, rules).select("match_id", "frame", "x")
        assert segments(points, rules).select("match_id", "segment").distinct().count() == 6
    assert track(d.limit(0), rules).count() == 0


def test_streamed_tracks_equal_batch(spark, tmp_path):
    from pitchflow.streaming.smoother import track_stream

    rules = TrackRules(fps=10.0, stride=1, coast_s=0.5)
    d = spark.createDataFrame(lanes(5, rules), "match_id long, frame long, det_id long, x double, z double, conf double, tile int, height double")
    points = fusion.fused(d, rules).select("match_id", "frame", "cluster", "x", "z", "conf", "tiles").cache()
    for a in (0, 55, 110):
        points.where(f"frame between {a} and {a + 54}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.02)
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = track_stream(stream, rules).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted(map(tuple, df.toPandas()[["match_id", "track_id", "frame", "x", "z"]].round(9).itertuples(index=False)))
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(track(d, rules))


def test_tracking_finds_two_walkers(spark):
    rows = [(0, f, 2 * f + k, -10.0 + 0.05 * f + 20 * k, 10.0 + 3 * k, 0.9, 0, 50.0) for f in range(0, 90, 3) for k in (0, 1)]
    d = spark.createDataFrame(rows, "match_id long, frame long, det_id long, x double, z double, conf double, tile int, height double")
    t = track(d, TrackRules(stride=1, fps=20.0)).toPandas()
    assert t.track_id.nunique() == 2 and t.groupby("track_id").z.nunique().tolist() == [1, 1]


def test_fusion_does_not_depend_on_order(spark):
    r = random.Random(5)
    rows = [(0, f, 20 * f + i, r.uniform(-6, 6), r.uniform(5, 12), r.random(), i % 3, r.uniform(10, 90)) for f in range(5) for i in range(20)]
    s = "match_id long, frame long, det_id long, x double, z double, conf double, tile int, height double"
    rules = TrackRules(near_tiles=1)
    key = lambda df: sorted(map(tuple, fusion.fused(df, rules).drop("boxes").toPandas().round(9).itertuples(index=False)))
    a = key(spark.createDataFrame(rows, s))
    r.shuffle(rows)
    assert key(spark.createDataFrame(rows, s)) == a and len(a) < 100


def test_suppression_against_a_loop(spark):
    r = random.Random(6)
    rows = [(0, 0, 0, i, round(r.random(), 2), *(lambda x, y: (x, y, x + 10, y + 10))(r.uniform(0, 30), r.uniform(0, 30))) for i in range(40)]
    df = spark.createDataFrame(rows, "match_id long, frame long, tile int, det_id long, conf double, x1 double, y1 double, x2 double, y2 double")
    got = set(fusion.suppress(df, 0.3, 0.2).toPandas().det_id)

    def iou(a, b):
        w, h = min(a[7], b[7]) - max(a[5], b[5]), min(a[8], b[8]) - max(a[6], b[6])
        c = max(0, w) * max(0, h)
        return c / (200 - c)

    keep = []
    for b in sorted((x for x in rows if x[4] >= 0.2), key=lambda x: (-x[4], x[3])):
        if all(iou(b, k) <= 0.3 for k in keep):
            keep.append(b)
    assert got == {b[3] for b in keep}


def test_densify_edges(spark):
    s = "match_id long, track_id long, frame long, x double, z double, conf double"
    df = spark.createDataFrame([(0, 1, 0, 0.0, 0.0, 1.0), (0, 1, 10, 10.0, 5.0, 0.0), (0, 2, 4, 1.0, 1.0, 0.5)], s)
    all_frames = D.densify(df, TrackRules(coast_s=0.0)).toPandas()
    assert len(all_frames) == 12 and all_frames.query("track_id == 1 and frame == 5").x.item() == 5.0
    near = D.densify(df, TrackRules(coast_s=0.1)).toPandas()
    assert sorted(near[near.track_id == 1].frame) == [0, 1, 2, 8, 9, 10]
    assert D.densify(df.limit(0), TrackRules()).count() == 0


def test_streamed_path_equals_batch(spark):
    from pitchflow.streaming.smoother import replay, smooth_stream  # noqa: F401

    r, rules = random.Random(9), CameraRules()
    rows = [(m, f, r.uniform(-30, 30), 4.0, r.uniform(30, 80)) for m in (1, 2) for f in range(50)]
    df = spark.createDataFrame(rows, "match_id long, frame long, yaw_t double, pitch_t double, hfov_t double")
    got = replay(df, rules, chunk=20).toPandas().sort_values(["match_id", "frame"], ignore_index=True)
    want = pd.concat([C.smooth_path(g.sort_values("frame"), rules)[0] for _, g in df.toPandas().groupby("match_id")], ignore_index=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_phantoms_against_a_loop(spark):
    """Every frame's window read anew; repeated frames, ties, still and moving stretches, several tiles."""
    r, rules = random.Random(12), TrackRules(fps=1.0, phantom_s=6.0, phantom_spread=2.0, phantom_tiles=1)
    hits = []
    for m, t in itertools.product((1, 2), range(5)):
        x = z = 10.0
        for f in sorted(r.choices(range(200), k=120)):
            moving = (f // 30) % 2
            x, z = (x + r.uniform(-4, 4) * moving, z + r.choice([0.0, 0.5, -0.5]))
            hits.append((m, t, f, x, z, r.choice([1, 1, 1, 1, 1, 1, 1, 2]) if t else 1))
    frames = [(m, t, f) for m in (1, 2) for t in range(6) for f in range(-9, 210)]
    h = spark.createDataFrame(hits, "match_id long, track_id long, frame long, x double, z double, tiles long")
    got = D.phantoms(spark.createDataFrame(frames, "match_id long, track_id long, frame long"), h, rules).collect()
    want = {}
    for m, t, f in frames:
        near = [q for q in hits if q[:2] == (m, t) and abs(q[2] - f) <= 6]
        if len(near) >= 2 and max(q[5] for q in near) <= 1:
            mx, mz = np.median([q[3] for q in near]), np.median([q[4] for q in near])
            s = float(np.median([math.hypot(q[3] - mx, q[4] - mz) for q in near]))
            if s < 2.0:
                want[m, t, f] = round(s, 9)
    assert {(q.match_id, q.track_id, q.frame): round(q.near_spread, 9) for q in got} == want and len(got) == len(want) > 100
    assert D.phantoms(h.select("match_id", "track_id", "frame").limit(0), h, rules).count() == 0


def test_nearest_in_frame(spark):
    """All pairs of a frame, with points near and far, ties, and frames without any."""
    r = random.Random(4)
    rows = lambda base, n: [(m, f, base + 1000 * m + 100 * f + i, round(r.uniform(-40, 40)), round(r.uniform(0, 30))) for m in (1, 2) for f in range(8) for i in range(n if f else 0)]
    asked, points = rows(0, 9) + [(1, 0, 99_999, 0.0, 0.0)], rows(50_000, 12)
    schema = "match_id long, frame long, det_id long, x double, z double"
    make = lambda x: spark.createDataFrame([(m, f, i, float(a), float(b)) for m, f, i, a, b in x], schema)
    want = {}
    for m, f, i, x, z in asked:
        near = [(round(math.hypot(x - a, z - b), 9), j) for n, g, j, a, b in points if (n, g) == (m, f)]
        if near:
            want[i] = min(near)
    for reach in (2.0, 9.0, 200.0):
        got = {q.det_id: (q.dist, q.near_id) for q in fusion.nearest(make(asked), make(points), reach).collect()}
        assert got == want
    assert fusion.nearest(make(asked).limit(0), make(points)).count() == 0
