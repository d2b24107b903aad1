"""The command line over tables and documents, as a user calls it."""

import json
import random

import pytest
from pitchflow.__main__ import main
from pitchflow.functions.geometry import synthetic_ground
from pitchflow.plans import geometry as P
from pitchflow.schema import Lens

from test_calibration import rows as marks


@pytest.fixture
def project(tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"source_video": "v.mp4", "homography": list(synthetic_ground().H), "pano": {"src_w": 4608, "src_h": 1728}}))
    return str(path)


@pytest.fixture
def detections(spark, tmp_path):
    """Six players of one match who run along the field for some seconds."""
    r, rows = random.Random(1), []
    for k in range(6):
        x, z = r.uniform(-20, 20), 3.0 + 6 * k
        for f in range(0, 240, 3):
            x += 0.2 * (-1) ** k + r.uniform(-0.1, 0.1)
            rows.append((5, f, len(rows), x, z + r.uniform(-0.1, 0.1), 0.9, 0, 60.0))
    path = str(tmp_path / "dets")
    spark.createDataFrame(rows, "match_id long, frame long, det_id long, x double, z double, conf double, tile int, height double").write.parquet(path)
    return path


def test_pipeline(spark, tmp_path, project, detections):
    work, out = str(tmp_path / "work"), str(tmp_path / "path")
    assert main(["pipeline", detections, "--project", project, "--work-dir", work, "--out", out, "--stride", "1", "--view", "wide"]) == 0
    labelled, path = spark.read.parquet(f"{work}/labelled"), spark.read.parquet(out)
    assert labelled.select("track_id").distinct().count() == 6 and labelled.where("label = 'player'").count() > 0
    assert path.count() > 100 and path.where("hfov between 26 and 110").count() == path.count()
    fine = str(tmp_path / "fine")
    assert main(["interpolate", out, "--out", fine, "--factor", "2", "--backend", "ease"]) == 0
    assert spark.read.parquet(fine).count() == 2 * path.count() - 1
    # the steps one by one give the same
    again = str(tmp_path / "again")
    assert main(["campath", f"{work}/pool", "--project", project, "--out", again, "--view", "wide"]) == 0
    key = lambda p: sorted(map(tuple, spark.read.parquet(p).toPandas().round(9).itertuples(index=False)))
    assert key(again) == key(out)


def test_calibrate_and_tiles(spark, tmp_path, project):
    path = str(tmp_path / "marks")
    spark.createDataFrame(marks(3, synthetic_ground(), Lens(k1=0.05)), P.calibration.MARKS).write.parquet(path)
    assert main(["calibrate", path, "--out", str(tmp_path / "c"), "--free", "k1,hfov_deg"]) == 0
    assert abs(spark.read.parquet(str(tmp_path / "c")).first().k1 - 0.05) < 0.01
    assert main(["tiles", "--project", project, "--out", str(tmp_path / "t")]) == 0
    assert spark.read.parquet(str(tmp_path / "t")).count() >= 4


def test_queue_monitor_and_queries(spark, tmp_path, capsys):
    (tmp_path / "q.json").write_text(json.dumps({"jobs": [{"id": "a", "status": "running"}]}))
    assert main(["queue", str(tmp_path / "q.json"), "--out", str(tmp_path / "jobs")]) == 0
    assert spark.read.parquet(str(tmp_path / "jobs")).first().status == "interrupted"
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.json").write_text(json.dumps({"status": "done", "step": "x", "updated_at": 1}))
    (tmp_path / "w" / "b.json").write_text("{")
    (tmp_path / "w" / "c.json").write_text(json.dumps({"status": "running", "updated_at": 1}))
    assert main(["monitor", str(tmp_path / "w")]) == 0
    assert [x.split("\t")[:2] for x in capsys.readouterr().out.splitlines()] == [["a", "done"], ["b", "unreadable"], ["c", "stale"]]
    assert main(["query"]) == 0 and "tracks" in capsys.readouterr().out.split()
    assert main(["query", "label_counts", "--tables", "/root/testdata/sf0.001", "--out", str(tmp_path / "n")]) == 0
    assert spark.read.parquet(str(tmp_path / "n")).count() >= 1


def test_what_cannot_be_done_is_said(tmp_path, capsys, detections):
    bare = tmp_path / "bare.json"
    bare.write_text("{}")
    for args in (["campath", detections, "--project", str(bare)], ["query", "nothing"], ["interpolate", detections, "--out", "x", "--backend", "none"], ["calibrate", "m", "--free", "k9"], ["campath", detections, "--project", str(bare), "--view", "odd"]):
        assert main(args) == 2 and capsys.readouterr().err
    with pytest.raises(SystemExit):
        main(["render"])
