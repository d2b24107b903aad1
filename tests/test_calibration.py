"""Calibration: bounded least squares against known answers, cameras against their true lenses."""

from dataclasses import replace

import numpy as np
import pytest
from pitchflow.functions import fitting
from pitchflow.functions import geometry as G
from pitchflow.operators import calibration as K
from pitchflow.plans import geometry as P
from pitchflow.schema import LENS_BOUNDS, Field, Lens

FIELD, SF = Field(), "/root/testdata/sf0.001"


def seen(points, ground, lens):
    v = np.column_stack([points, np.ones(len(points))]) @ ground.matrix.T
    return fitting.np_pixel(v / np.linalg.norm(v, axis=1, keepdims=True), lens)


def rows(camera, ground, lens, noise=0.0, seed=0):
    r, x = np.random.default_rng(seed), np.linspace(-44, 44, 12)
    near, far = np.column_stack([x, 0 * x]), np.column_stack([x, 0 * x + FIELD.width])
    at = lambda p: seen(p, ground, lens) + r.normal(0, noise, (len(p), 2))
    corner = [(camera, "corner", *map(float, px), float(x), float(z)) for px, (x, z) in zip(at(P._CORNERS), P._CORNERS)]
    return corner + [(camera, kind, *map(float, px), None, None) for kind, p in (("near", near), ("far", far)) for px in at(p)]


def test_least_squares_stops_at_bounds():
    """The least point of a quadratic in a box, against a fine search; a term at its bound lets the others go on."""
    A, b = np.array([[2.0, 1.0, 0.0], [0.0, 1.0, 1.0], [1.0, 0.0, 3.0], [0.5, 0.5, 0.5]]), np.array([4.0, -3.0, 2.0, 1.0])
    lo, hi = np.array([-1.0, -1.0, -1.0]), np.array([1.0, 1.0, 1.0])
    got = fitting.least_squares(lambda p: A @ p - b, np.zeros(3), lo=lo, hi=hi)
    grid = np.stack(np.meshgrid(*[np.linspace(-1, 1, 81)] * 3, indexing="ij"), -1).reshape(-1, 3)
    best = grid[np.argmin(((grid @ A.T - b) ** 2).sum(1))]
    assert np.abs(got - best).max() < 0.03 and ((A @ got - b) ** 2).sum() <= ((A @ best - b) ** 2).sum() + 1e-9
    free = fitting.least_squares(lambda p: A @ p - b, np.zeros(3))
    assert np.abs(free - np.linalg.lstsq(A, b, rcond=None)[0]).max() < 1e-6
    valley = fitting.least_squares(lambda p: np.array([10 * (p[1] - p[0] ** 2), 1 - p[0]]), np.array([-1.2, 1.0]))
    assert np.abs(valley - 1).max() < 1e-4


def test_pose_term_holds_a_camera():
    """The more the pose weighs against noisy marks, the nearer the homography's axes are to one length and right angles."""
    r = rows(1, G.synthetic_ground(6.0, 8.0, 2.0), Lens(), noise=2.0, seed=4)
    px = lambda k: np.array([x[2:4] for x in r if x[1] == k])
    m = fitting.Marks(px("corner"), P._CORNERS, px("near"), px("far"))
    H0 = fitting.homography(fitting.np_direction(m.corners, Lens()), m.corner_points)
    free, held = fitting.refine(H0, m, Lens(), FIELD), fitting.refine(H0, m, Lens(), FIELD, pose=50.0)
    firm = fitting.refine(H0, m, Lens(), FIELD, pose=5000.0)
    size = lambda h: np.abs(fitting.pose_terms(h)).max()
    assert size(held) < 0.5 * size(free) and size(firm) < 0.01 * size(free)
    tall = fitting.refine(H0, m, Lens(), FIELD, pose=50.0, height=7.0)
    assert abs(fitting.camera_height(tall / np.linalg.norm(tall)) - 7.0) < abs(fitting.camera_height(held / np.linalg.norm(held)) - 7.0)


def test_cameras_recover_their_lenses(spark):
    """Noisy marks of six cameras whose k1 and width of view are not those the fit starts from."""
    truth = {c: (G.synthetic_ground(5.0 + c % 3, 7.0 + c % 2, 1.0 * c), Lens(k1=0.02 * c, hfov_deg=188.0 + c % 4)) for c in range(6)}
    r = [x for c, (g, lens) in truth.items() for x in rows(c, g, lens, noise=0.3, seed=c)]
    out = {x.camera_id: x for x in K.calibrate(spark.createDataFrame(r, K.MARKS), Lens(), FIELD, K.TERMS).collect()}
    one = {x.camera_id: x for x in K.calibrate(spark.createDataFrame(r, K.MARKS), Lens(), FIELD, None).collect()}
    assert sorted(out) == sorted(one) == list(range(6))
    spots = np.array([(x, z) for x in (-30.0, 0.0, 30.0) for z in (4.0, 18.0, 33.0)])
    better = 0
    for c, (g, lens) in truth.items():
        x = out[c]
        assert x.problem is None and x.marks == 28
        assert all(LENS_BOUNDS[k][0] <= getattr(x, k) <= LENS_BOUNDS[k][1] for k in K.TERMS)
        px = seen(spots, g, lens)
        off = lambda h, model: np.abs(fitting.to_points(np.array(h).reshape(3, 3), fitting.np_direction(px, model)) - spots).max()
        joint, alone = off(x.h, replace(Lens(), **{k: getattr(x, k) for k in K.TERMS})), off(one[c].h, Lens())
        better += joint < alone
        assert joint < 0.4
    assert better >= 5
    assert abs(out[4].k1 - 0.08) < 0.03 and abs(out[0].k1) < 0.03


def test_cameras_that_cannot_be_fitted(spark):
    good = rows(1, G.synthetic_ground(), Lens())
    three = [(2, *x[1:]) for x in good[:3] + good[4:]]
    odd = [(1, "pole", 3.0, 4.0, None, None), (1, "corner", 3.0, 4.0, None, 1.0), (1, "near", None, 4.0, None, None), (None, "near", 1.0, 2.0, None, None)]
    df = spark.createDataFrame(good + three + odd, K.MARKS)
    for free in (None, ("k1",), ()):
        out = {x.camera_id: x for x in K.calibrate(df, Lens(), FIELD, free).collect()}
        assert out[1].problem is None and out[1].marks == 28 and out[1].corner_rms < 0.02
        assert "four" in out[2].problem and out[2].h is None and out[2].k1 is None
    assert K.calibrate(df.limit(0), Lens(), FIELD).count() == 0


def test_calibration_queries_read_the_table(spark):
    from pitchflow import catalog

    n = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id div 32 as m").distinct().count()
    for name in ("fitted_homography", "calibrated_cameras"):
        out = catalog.QUERIES[name](spark, SF).collect()
        assert len(out) == n and all(r.near_rms is None or r.near_rms < 1.5 for r in out)


@pytest.mark.parametrize("angles", [(0.0, 0.0), (15.0, 4.0), (-70.0, -9.0)])
def test_look_is_a_rotation(spark, angles):
    from pyspark.sql import functions as F

    v = [F.lit(0.3), F.lit(-0.5), F.lit(0.8)]
    got = spark.range(1).select(*G.look(v, F.lit(angles[0]), F.lit(angles[1]))).first()
    assert np.allclose(list(got), G.rotation(angles[1], angles[0]) @ [0.3, -0.5, 0.8])
