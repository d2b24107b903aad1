"""Geometry, fitting, documents, progress and guards."""

import json
from dataclasses import replace

import numpy as np
import pytest
from pitchflow.functions import fitting
from pitchflow.functions import geometry as G
from pitchflow.plans.geometry import GROUND, LENS, plan_tiles, synthetic_marks
from pitchflow.schema import Field, Lens
from pitchflow.sources import documents, layouts, progress


def test_lens_inverts():
    r = np.random.default_rng(0)
    px = np.column_stack([r.uniform(600, 4000, 200), r.uniform(200, 1500, 200)])
    assert np.abs(fitting.np_pixel(fitting.np_direction(px, LENS), LENS) - px).max() < 1e-3


def test_homography_from_marks():
    m = synthetic_marks()
    H = fitting.fit(m, LENS, Field())
    p = fitting.to_points(H, fitting.np_direction(m.corners, LENS))
    assert np.abs(p - m.corner_points).max() < 1e-2
    assert fitting.rms(fitting.to_points(H, fitting.np_direction(m.near, LENS)), 0.0) < 1e-2
    assert abs(fitting.camera_height(H / np.linalg.norm(H)) - 6.0) < 0.1
    with pytest.raises(ValueError):
        fitting.homography(np.zeros((3, 3)), np.zeros((3, 2)))


def test_distortion_and_level():
    true = Lens(k1=-0.1)
    lines = []
    for a, b in (((-3, 1, 4), (3, 1.2, 4)), ((-2, -1.5, 3), (2.5, -1, 4)), ((-1, 2, 3), (4, 1, 3))):
        v = np.linspace(a, b, 9)
        lines.append(fitting.np_pixel(v / np.linalg.norm(v, axis=1, keepdims=True), true))
    assert abs(fitting.fit_distortion(lines, Lens()).k1 + 0.1) < 5e-3
    tilted = Lens(pitch0_deg=5.0, roll0_deg=2.0)
    az = np.linspace(-1.2, 1.2, 25)
    horizon = fitting.np_pixel(np.column_stack([np.sin(az), 0 * az, np.cos(az)]), tilted)
    pitch, roll = fitting.level(horizon, replace(tilted, pitch0_deg=0.0, roll0_deg=0.0))
    assert abs(pitch - 5) < 0.3 and abs(roll - 2) < 0.3


def test_joint_fit_keeps_a_good_lens():
    m = synthetic_marks()
    _, lens = fitting.fit_with_lens(m, LENS, Field())
    assert abs(lens.k1 - LENS.k1) < 1e-3


def test_camera_place_and_tiles(spark):
    x, z = GROUND.camera()
    assert abs(x) < 1e-6 and abs(z + 8.0) < 1e-6
    tiles = [r.asDict() for r in plan_tiles(spark).orderBy("tile").collect()]
    assert {t["out_h"] for t in tiles} == {960, 720} and all(t["vfov"] <= 88 for t in tiles)
    assert -2.0 <= G.synthetic_ground().fixed_pitch() <= 10.0


def test_documents(spark, tmp_path):
    rows = [(7, 1, f, f * 0.1, 2.0, 0.5) for f in range(5)] + [(7, 2, 3, 1.23456, 2.0, 0.5)]
    df = spark.createDataFrame(rows, "match_id long, track_id long, frame long, x double, z double, conf double")
    documents.write_positions(df, str(tmp_path / "doc"), 20.0, "v.mp4")
    back = documents.read_positions(spark, str(tmp_path / "doc")).toPandas()
    assert set(back.match_id) == set(r.match_id for r in df.select("match_id").collect())
    assert len(back) == 6 and back.query("track_id == 2").x.item() == 1.235 and back.t.max() == 0.2
    path = spark.createDataFrame([(7, f, 1.0, 2.0, 60.0, 0.1) for f in range(3)], "match_id long, frame long, yaw double, pitch double, hfov double, d double")
    documents.write_path(path, str(tmp_path / "path"), 20.0, end={"yaw_pos": 1.0})
    assert documents.read_path(spark, str(tmp_path / "path")).count() == 3
    documents.write_table(df, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 6


def test_project(tmp_path):
    p = documents.Project.for_video("a.mp4", 100, 50)
    p.save(str(tmp_path / "p.json"))
    assert documents.Project.load(str(tmp_path / "p.json")) == p and p.lens.src_w == 100
    real = {"source_video": "m.mp4", "calib_lines": [[[1.0, 2.0], [3.0, 4.0]]], "field_polygon": [[0, 1]], "projection_blend": 0.4, "pano": {"src_w": 10, "src_h": 5, "k1": 0.1, "odd": 3}, "later_key": {"a": [1]}}
    (tmp_path / "q.json").write_text(json.dumps(real))
    q = documents.Project.load(str(tmp_path / "q.json"))
    assert (q.projection_blend, q.near_trust, q.lens.k1, q.unknown) == (0.4, 3.0, 0.1, {"later_key": {"a": [1]}})
    q.save(str(tmp_path / "r.json"))
    back = json.loads((tmp_path / "r.json").read_text())
    assert all(back[k] == v for k, v in real.items() if k != "pano") and back["pano"]["odd"] == 3 and documents.Project.load(str(tmp_path / "r.json")) == q
    (tmp_path / "q.json").write_text("[1]")
    with pytest.raises(TypeError):
        documents.Project.load(str(tmp_path / "q.json"))
    with pytest.raises(AttributeError):
        q.nothing


def test_guard(tmp_path):
    documents.assert_output_safe(str(tmp_path / "b"), [str(tmp_path / "a")])
    with pytest.raises(ValueError):
        documents.assert_output_safe(str(tmp_path / "x" / ".." / "A"), [str(tmp_path / "a")])


def test_progress(tmp_path):
    now = [0.0]
    p = progress.Progress(str(tmp_path / "p.json"), clock=lambda: now[0])
    assert p.update(status="running") and not p.update(n=1)
    now[0] = 2.0
    assert p.update(n=2) and progress.read(p.path, 10.0)["stale"] is False and progress.read(p.path, 60.0)["stale"] is True
    (tmp_path / "p.json").write_text("{")
    assert progress.read(p.path, 0.0) is None


def test_queue_document(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"paused": False, "jobs": [{"id": "a", "status": "running", "odd": 1}, {"id": "b"}]}))
    rows = documents.read_jobs(spark, str(tmp_path / "q.json"), "id: string, status: string").collect()
    assert [(r.queue_pos, r.id, r.status) for r in rows] == [(0, "a", "running"), (1, "b", None)]


def test_project_table(spark, tmp_path):
    """Many project documents as rows: defaults, values of a wrong type, unknown keys, and what is no document."""
    docs = {"a": {"source_video": "a.mp4", "near_trust": 2, "homography": [1, 2.5], "pano": {"k1": 0.2, "src_w": 99}, "later": [1, "x"], "field_marks": {"corners": [[1, 2]]}}, "b": {"out_w": "wide", "panini_d_adaptive": False}, "c": [1]}
    for k, d in docs.items():
        (tmp_path / f"{k}.json").write_text(json.dumps(d, indent=2))
    (tmp_path / "d.json").write_text('{"source_video": ')
    rows = {r.path[-6]: r for r in layouts.projects_of(layouts.whole(spark, str(tmp_path))).collect()}
    a = rows["a"]
    assert (a.source_video, a.near_trust, a.homography, a.pano.k1, a.pano.src_w, a.pano.src_h, a.out_w) == ("a.mp4", 2.0, [1.0, 2.5], 0.2, 99, 1728, 2560)
    assert json.loads(a.extra["later"]) == [1, "x"] and json.loads(a.field_marks) == {"corners": [[1, 2]]} and a.problem is None
    assert (rows["b"].out_w, rows["b"].panini_d_adaptive, rows["b"].extra, rows["b"].calib_lines) == (2560, False, {}, [])
    assert rows["c"].problem and rows["d"].problem and rows["d"].out_h == 1440


def test_queue_layouts(spark, tmp_path):
    """An older layout is planned anew, a crash is recovered, one malformed job goes alone, unknown keys stay."""
    jobs = [
        {"id": "a", "status": "running", "stages": [{"name": "track", "status": "done"}, {"name": "classify", "status": "running"}], "odd": {"x": 1}},
        "broken",
        {"id": "b", "status": "failed", "concat_files": ["1", "2"], "has_audio": True, "interp_args": {"fps": 60}, "stages": [{"name": "concat", "status": "done"}, {"name": "pipeline", "status": "failed"}], "retry_count": 2},
        {"id": "c", "stages": [1, 2]},
        {"id": "d", "status": "done", "stages": [{"name": "pipeline", "status": "done"}], "has_audio": True, "preserve_concat_audio": False},
        {"id": "e", "tracking_params": {"mode": "pipeline"}, "stages": [{"name": "pipeline"}]},
        {"id": "f"},
        None,
    ]
    (tmp_path / "q.json").write_text(json.dumps({"paused": True, "jobs": jobs}, indent=1))
    (tmp_path / "half.json").write_text('{"paused": true, "jobs": [{"id"')
    (tmp_path / "none.json").write_text('{"paused": true}')
    r = {x.job_id: x for x in layouts.jobs_of(layouts.whole(spark, str(tmp_path))).collect()}
    assert sorted(r) == ["a", "b", "d", "e", "f"] and [r[k].queue_pos for k in "abdef"] == [0, 2, 4, 5, 6]
    assert r["a"].status == "interrupted" and [tuple(s) for s in r["a"].stages] == [("track", "done"), ("classify", "failed")] and json.loads(r["a"].extra["odd"]) == {"x": 1}
    assert r["b"].status == "pending" and [s.name for s in r["b"].stages] == ["concat", "track", "classify", "campath", "render", "interpolate", "audio_mux"] and {s.status for s in r["b"].stages} == {"pending"} and r["b"].retry_count == 2
    assert r["d"].status == "done" and [s.name for s in r["d"].stages] == ["track", "classify", "campath", "render"] and r["d"].migrated
    assert [s.name for s in r["e"].stages] == ["pipeline"] and r["e"].status == "pending" and r["f"].stages == [] and r["f"].status == "pending"


def test_backends(spark):
    from pitchflow.operators import backends as B

    rows = [(1, 0, 0.0, 5.0), (1, 10, 8.0, None), (1, 11, 4.0, 1.0), (2, 3, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "match_id long, frame long, a double, b double")
    out = {(r.match_id, r.frame, r.k): (r.a, r.b) for r in B.interpolated(df, ["a", "b"], 4).collect()}
    assert len(out) == 4 + 3 * 2 and out[1, 0, 1] == (2.0, None) and out[1, 10, 3] == (5.0, None) and out[2, 3, 0] == (1.0, 1.0)
    eased = {(r.match_id, r.frame, r.k): r.a for r in B.interpolated(df, ["a", "b"], 4, "ease").collect()}
    assert eased[1, 0, 2] == 4.0 and abs(eased[1, 0, 1] - 8 * 0.15625) < 1e-12
    assert B.interpolated(df, ["a"], 1).count() == 4 and B.interpolated(df.limit(0), ["a"], 3).count() == 0
    for wrong in (lambda: B.interpolated(df, ["a"], 2, "none"), lambda: B.interpolated(df, ["a"], 0), lambda: B.backend("linear")(B.Linear)):
        with pytest.raises(ValueError):
            wrong()


def test_pad_rows(spark):
    """Against equal steps drawn one by one, single rows and fades that would meet included."""
    from pyspark.sql import functions as F

    for h, p, f in ((12, 4, 3), (12, 1, 1), (12, 0, 2), (12, 3, 0), (6, 2, 3), (12, 2, 1)):
        wide, seam, source = G.pad_rows(F.col("id"), F.lit(h), F.lit(p), F.lit(f))
        got = spark.range(h + 2 * p).select(wide.alias("w"), seam.alias("s"), source.alias("o")).toPandas()
        want = np.zeros((h + 2 * p, 3))
        want[:, 2] = 1
        want[:p] = np.column_stack([w := np.linspace(1, 0, p), 1 - w, 0 * w])
        if p:
            want[-p:] = np.column_stack([w := np.linspace(0, 1, p), 1 - w, 0 * w])
        if f > 0 and 2 * f < h:
            want[p : p + f] = np.column_stack([0 * (w := np.linspace(1, 0, f)), w, 1 - w])
            want[p + h - f : p + h] = np.column_stack([0 * (w := np.linspace(0, 1, f)), w, 1 - w])
        assert np.allclose(got.to_numpy(float), want), (h, p, f)


def test_ankles_below_the_box_move_the_foot(spark):
    from pitchflow.functions import boxes

    tile = {"yaw": 0.0, "pitch": 14.0, "vfov": 60.0, "out_w": 1920, "out_h": 960}
    rows = [(0, 900.0, 300.0, 920.0, 400.0, None, None), (1, 900.0, 300.0, 920.0, 400.0, 950.0, 420.0), (2, 900.0, 300.0, 920.0, 400.0, 950.0, 390.0), (3, 940.0, 300.0, 960.0, 420.0, None, None)]
    df = spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double, ankle_x double, ankle_y double")
    g = {r.id: (r.gx, r.gz) for r in boxes.to_ground(df, tile, LENS, GROUND).collect()}
    plain = {r.id: (r.gx, r.gz) for r in boxes.to_ground(df.drop("ankle_x", "ankle_y"), tile, LENS, GROUND).collect()}
    assert g[0] == plain[0] == g[2] and g[1] != plain[1] and g[1] == g[3]


def test_existing_clips_and_strict_fill(spark, tmp_path):
    from pitchflow.operators import camera, clips

    (tmp_path / "a.mp4").write_bytes(b"1")
    df = spark.createDataFrame([("a.mp4", 1), ("b.mp4", 2)], "name string, pos int")
    assert [tuple(r) for r in clips.existing(df, str(tmp_path)).collect()] == [("a.mp4", 1)]
    frames = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "match_id long, frame long")
    taken = spark.createDataFrame([(1, 1, 5.0)], "match_id long, frame long, yaw double")
    assert {(r.match_id, r.frame, r.yaw) for r in camera.fill(frames, taken, ["yaw"]).collect()} == {(1, 0, 5.0), (1, 1, 5.0), (2, 0, None)}
    assert camera.fill(frames.where("match_id = 1"), taken, ["yaw"], strict=True).count() == 2
    with pytest.raises(Exception, match="no frame of match 2"):
        camera.fill(frames, taken, ["yaw"], strict=True).collect()


def test_labelled_and_pool_files(spark, tmp_path):
    rows = [(7, t, f, 1.0, 2.0, 0.5, "player" if t else "sideline") for t in (0, 1) for f in range(3)]
    df = spark.createDataFrame(rows, "match_id long, track_id long, frame long, x double, z double, conf double, label string")
    path, other = documents.write_labelled(df, df.where("label = 'player'"), str(tmp_path / "players.json"), 20.0)
    assert other.endswith("players_labeled.json")
    pool, labelled = documents.read_positions(spark, path), documents.read_positions(spark, other)
    assert pool.count() == 3 and {(r.track_id, r.label) for r in labelled.collect()} == {(0, "sideline"), (1, "player")}
