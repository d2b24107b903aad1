"""Queries over projective geometry: rays, pixels, views, tiles, marks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..functions import boxes, fitting
from ..functions import geometry as G
from ..operators import calibration
from ..schema import Field, Lens
from .bindings import POSITIONS, positions, rounded

FIELD = Field()
GROUND = G.synthetic_ground()
LENS = Lens(pitch0_deg=12.0, k1=-0.08, k2=0.01)
_H = [repr(float(v)) + "::DOUBLE" for v in GROUND.matrix.ravel()]
_I = [repr(float(v)) + "::DOUBLE" for v in np.linalg.inv(GROUND.matrix).ravel()]
_ROW = ("match_id", "track_id", "frame")


_VIEWS = f"{POSITIONS}, views AS (SELECT match_id, frame, (min(x) + max(x)) / 2 AS yaw, max(z) / 10 - 2 AS pitch, 26.0::DOUBLE + least(84.0::DOUBLE, max(x) - min(x)) AS hfov FROM positions GROUP BY match_id, frame)"


def _views(spark, sf_dir):
    """A view a frame: in the middle of its players, as wide as they are apart."""
    wide = F.lit(26.0) + F.least(F.lit(84.0), F.max("x") - F.min("x"))
    return positions(spark, sf_dir).groupBy("match_id", "frame").agg(((F.min("x") + F.max("x")) / 2).alias("yaw"), (F.max("z") / 10 - 2).alias("pitch"), wide.alias("hfov"))


def _mul(m: list[str], v: tuple[str, str, str]) -> list[str]:
    return [f"({m[3 * i]} * {v[0]} + {m[3 * i + 1]} * {v[1]} + {m[3 * i + 2]} * {v[2]})" for i in range(3)]


def _m(a: np.ndarray) -> list[str]:
    return [repr(float(v)) + "::DOUBLE" for v in a.ravel()]


_RAYS = f"""{POSITIONS}, raw AS (SELECT *, {', '.join(f'{e} AS q{i}' for i, e in enumerate(_mul(_H, ('x', 'z', '1.0'))))} FROM positions),
rays AS (SELECT *, q0 / sqrt(q0 * q0 + q1 * q1 + q2 * q2) AS r0, q1 / sqrt(q0 * q0 + q1 * q1 + q2 * q2) AS r1, q2 / sqrt(q0 * q0 + q1 * q1 + q2 * q2) AS r2 FROM raw)"""


def _rays(spark, sf_dir):
    p = positions(spark, sf_dir)
    r = GROUND.ray(F.col("x"), F.col("z"))
    return p.select(*_ROW, "x", "z", *[c.alias(f"r{i}") for i, c in enumerate(r)])


def _v():
    return F.col("r0"), F.col("r1"), F.col("r2")


@query("ground_rays", sql=f"WITH {_RAYS} SELECT match_id, track_id, frame, round(r0, 9) AS r0, round(r1, 9) AS r1, round(r2, 9) AS r2, round(degrees(atan2(r0, r2)), 6) AS az, round(degrees(asin(greatest(least(-r1, 1), -1))), 6) AS el FROM rays")
def ground_rays(spark, sf_dir):
    az, el = G.azimuth_elevation(_v())
    return rounded(_rays(spark, sf_dir).select(*_ROW, "r0", "r1", "r2", F.round(az, 6).alias("az"), F.round(el, 6).alias("el")))


_BACK = _mul(_I, ("r0", "r1", "r2"))


@query("ray_to_ground", sql=f"WITH {_RAYS} SELECT match_id, track_id, frame, round({_BACK[0]} / {_BACK[2]}, 6) AS gx, round({_BACK[1]} / {_BACK[2]}, 6) AS gz FROM rays")
def ray_to_ground(spark, sf_dir):
    x, z = GROUND.point(_v())
    return rounded(_rays(spark, sf_dir).select(*_ROW, x.alias("gx"), z.alias("gz")), 6)


_LR = G.rotation(pitch=LENS.pitch0_deg) @ G.rotation(roll=LENS.roll0_deg)
_CX, _CY, _N = G._centre(LENS)
_S = _mul(_m(_LR), ("r0", "r1", "r2"))
_PIXELS = f"""{_RAYS}, ideal AS (SELECT *, (atan2({_S[0]}, {_S[2]}) / {math.radians(LENS.hfov_deg)!r}::DOUBLE + 0.5) * {LENS.src_w - 1} AS ix, (0.5 - asin(greatest(least({_S[1]}, 1), -1)) / {math.radians(LENS.vfov_deg)!r}::DOUBLE) * {LENS.src_h - 1} AS iy FROM rays),
nrm AS (SELECT *, (ix - {_CX}) / {_N!r}::DOUBLE AS nx, (iy - {_CY}) / {_N!r}::DOUBLE AS ny FROM ideal),
pixels AS (SELECT *, {_CX} + nx * (1 + {LENS.k1}::DOUBLE * (nx * nx + ny * ny) + {LENS.k2}::DOUBLE * (nx * nx + ny * ny) ** 2) * {_N!r}::DOUBLE AS sx, {_CY} + ny * (1 + {LENS.k1}::DOUBLE * (nx * nx + ny * ny) + {LENS.k2}::DOUBLE * (nx * nx + ny * ny) ** 2) * {_N!r}::DOUBLE AS sy FROM nrm)"""


@query("source_pixels", sql=f"WITH {_PIXELS} SELECT match_id, track_id, frame, round(sx, 6) AS sx, round(sy, 6) AS sy FROM pixels")
def source_pixels(spark, sf_dir):
    x, y = G.pixel_of(_v(), LENS)
    return rounded(_rays(spark, sf_dir).select(*_ROW, x.alias("sx"), y.alias("sy")), 6)


@query("pixel_round_trip", sql=f"WITH {_RAYS} SELECT match_id, track_id, frame, round(r0, 6) AS v0, round(r1, 6) AS v1, round(r2, 6) AS v2 FROM rays")
def pixel_round_trip(spark, sf_dir):
    """Ray to distorted pixel and back: the ray again, to six decimals."""
    x, y = G.pixel_of(_v(), LENS)
    p = _rays(spark, sf_dir).select(*_ROW, x.alias("sx"), y.alias("sy"))
    v = G.direction_of(F.col("sx"), F.col("sy"), LENS)
    return rounded(p.select(*_ROW, *[c.alias(f"v{i}") for i, c in enumerate(v)]), 6)


_R1, _R2, _R3, _T = GROUND.pose()
_RHS = -(_R2 * 1.75 + _T)


def _det(a, b, c) -> str:
    return f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {b[0]} * ({a[1]} * {c[2]} - {a[2]} * {c[1]}) + {c[0]} * ({a[1]} * {b[2]} - {a[2]} * {b[1]}))"


_P, _Q, _M, _WV = _m(_R1), _m(_R3), _m(_RHS), ["(-r0)", "(-r1)", "(-r2)"]


@query("head_to_ground", sql=f"WITH {_RAYS}, dets AS (SELECT *, nullif({_det(_P, _Q, _WV)}, 0) AS d, {_det(_P, _Q, _M)} AS l, {_det(_M, _Q, _WV)} AS a, {_det(_P, _M, _WV)} AS b FROM rays) SELECT match_id, track_id, frame, round(CASE WHEN l / d > 0 THEN a / d END, 6) AS hx, round(CASE WHEN l / d > 0 THEN b / d END, 6) AS hz FROM dets")
def head_to_ground(spark, sf_dir):
    x, z = GROUND.below_head(_v())
    return rounded(_rays(spark, sf_dir).select(*_ROW, x.alias("hx"), z.alias("hz")), 6)


_VR = G.rotation(4.0, 15.0, 0.0).T
_VC = _mul(_m(_VR), ("r0", "r1", "r2"))
_FL = 1080 / 2 / math.tan(math.radians(60.0) / 2)


@query("view_pixels", sql=f"WITH {_RAYS}, cam AS (SELECT *, {_VC[0]} AS c0, {_VC[1]} AS c1, {_VC[2]} AS c2 FROM rays) SELECT match_id, track_id, frame, round(CASE WHEN c2 > 1e-6 THEN {_FL!r}::DOUBLE * c0 / c2 + 959.5 END, 6) AS u, round(CASE WHEN c2 > 1e-6 THEN -{_FL!r}::DOUBLE * c1 / c2 + 539.5 END, 6) AS v FROM cam")
def view_pixels(spark, sf_dir):
    u, v = G.view_pixel(_v(), 15.0, 4.0, 60.0, 1920, 1080)
    return rounded(_rays(spark, sf_dir).select(*_ROW, u.alias("u"), v.alias("v")), 6)


_SIDES = """sides AS (SELECT side, i, CASE side WHEN 0 THEN i / 7.0::DOUBLE * 1919 WHEN 1 THEN 1919.0 WHEN 2 THEN 1919 - i / 7.0::DOUBLE * 1919 ELSE 0.0 END AS px,
  CASE side WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN i / 7.0::DOUBLE * 1079 WHEN 2 THEN 1079.0 ELSE 1079 - i / 7.0::DOUBLE * 1079 END AS py FROM range(4) a(side), range(8) b(i))"""


def outline(views: DataFrame, w: int, h: int, samples: int = 128) -> DataFrame:
    """views with side, i, px, py: samples along each edge of a frame, clockwise from the top left, for every row."""
    each = views.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(4 * samples - 1))))
    each = each.withColumns({"side": F.floor(F.col("_k") / samples), "i": F.col("_k") % samples})
    x, y = F.col("i") / (samples - 1) * (w - 1), F.col("i") / (samples - 1) * (h - 1)
    px = F.when(F.col("side") == 0, x).when(F.col("side") == 1, float(w - 1)).when(F.col("side") == 2, (w - 1) - x).otherwise(0.0)
    py = F.when(F.col("side") == 0, 0.0).when(F.col("side") == 1, y).when(F.col("side") == 2, float(h - 1)).otherwise((h - 1) - y)
    return each.withColumns({"px": px, "py": py}).drop("_k")


_OS = _mul(_m(_LR), ("w0", "w1", "w2"))


@query(
    "view_outline",
    sql=f"""WITH {_VIEWS}, {_SIDES}, c AS (SELECT match_id, frame, side, i, radians(yaw) AS b, radians(pitch) AS a, px - 959.5 AS u, -(py - 539.5) AS v, 540 / tan(radians(hfov) / 2) AS f FROM views, sides),
r AS (SELECT *, u / sqrt(u * u + v * v + f * f) AS v0, v / sqrt(u * u + v * v + f * f) AS v1, f / sqrt(u * u + v * v + f * f) AS v2 FROM c),
t AS (SELECT match_id, frame, side, i, b, v0, cos(a) * v1 - sin(a) * v2 AS w1, sin(a) * v1 + cos(a) * v2 AS z FROM r), w AS (SELECT *, cos(b) * v0 + sin(b) * z AS w0, cos(b) * z - sin(b) * v0 AS w2 FROM t),
ideal AS (SELECT match_id, frame, side, i, (atan2({_OS[0]}, {_OS[2]}) / {math.radians(190.0)!r}::DOUBLE + 0.5) * 4607 AS ix, (0.5 - asin(greatest(least({_OS[1]}, 1), -1)) / {math.radians(80.0)!r}::DOUBLE) * 1727 AS iy FROM w),
n AS (SELECT *, (ix - {_CX}) / {_N!r}::DOUBLE AS nx, (iy - {_CY}) / {_N!r}::DOUBLE AS ny FROM ideal), k AS (SELECT *, 1 + {LENS.k1}::DOUBLE * (nx * nx + ny * ny) + {LENS.k2}::DOUBLE * (nx * nx + ny * ny) ** 2 AS g FROM n)
SELECT match_id, frame, side, i, round({_CX} + nx * g * {_N!r}::DOUBLE, 5) AS sx, round({_CY} + ny * g * {_N!r}::DOUBLE, 5) AS sy FROM k""",
)
def view_outline(spark, sf_dir):
    """Where the edge of each frame's view lies in the source."""
    o = outline(_views(spark, sf_dir), 1920, 1080, 8)
    ray = G.look(G.view_ray(F.col("px") - 959.5, F.col("py") - 539.5, F.col("hfov"), 1920, 1080), F.col("yaw"), F.col("pitch"))
    x, y = G.pixel_of(ray, LENS)
    return rounded(o.select("match_id", "frame", "side", F.col("i").cast("long").alias("i"), x.alias("sx"), y.alias("sy")), 5)


@query("projection_round_trip", sql=f"WITH {POSITIONS}, p(projection) AS (VALUES ('cylindrical'), ('panini'), ('rectilinear')) SELECT projection, match_id, track_id, frame, round((x + 52) * 12.2::DOUBLE, 4) AS u, round((z + 4) * 15.9::DOUBLE, 4) AS v FROM positions, p")
def projection_round_trip(spark, sf_dir):
    """Each position as a pixel of a view of 1280 by 720, to its ray and back, in each of the three projections."""
    p, out = positions(spark, sf_dir).select(*_ROW, ((F.col("x") + 52) * 12.2).alias("px"), ((F.col("z") + 4) * 15.9).alias("py")), None
    for name, fov, blend in (("cylindrical", 100.0, 0.6), ("panini", 100.0, 0.8), ("rectilinear", 60.0, 1.0)):
        ray = G.turn(G.rotation(3.0, -20.0), G.view_ray(F.col("px") - 639.5, F.col("py") - 359.5, fov, 1280, 720, name, blend))
        w = p.select(*_ROW, *[c.alias(f"r{k}") for k, c in enumerate(ray)])
        u, v = G.view_pixel(_v(), -20.0, 3.0, fov, 1280, 720, projection=name, blend=blend)
        one = w.select(F.lit(name).alias("projection"), *_ROW, (F.round(u, 4) + 0.0).alias("u"), (F.round(v, 4) + 0.0).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


def boundary(fields: DataFrame, step: float = 1.0) -> DataFrame:
    """edge, k, x, z around each row's field (length, width), counterclockwise from the near left corner."""
    hx, w = F.col("length") / 2, F.col("width")
    zero, one = F.lit(0.0), F.lit(float(step))
    edge = lambda name, far, x0, dx, z0, dz: F.struct(F.lit(name).alias("edge"), F.floor(far / step).cast("int").alias("n"), x0.alias("x0"), dx.alias("dx"), z0.alias("z0"), dz.alias("dz"))
    edges = F.array(edge("near", 2 * hx, -hx, one, zero, zero), edge("right", w, hx, zero, zero, one), edge("far", 2 * hx, hx, -one, w, zero), edge("left", w, -hx, zero, w, -one))
    each = fields.withColumn("_e", F.explode(edges)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_e.n").cast("long"))))
    return each.withColumns({"edge": F.col("_e.edge"), "x": F.col("_e.x0") + F.col("k") * F.col("_e.dx"), "z": F.col("_e.z0") + F.col("k") * F.col("_e.dz")}).drop("_e")


_FIELDS = f"{POSITIONS}, fields AS (SELECT match_id, 2 * ceil(max(abs(x))) AS len, ceil(max(z)) AS wid FROM positions GROUP BY match_id)"


@query(
    "field_boundary",
    sql=f"""WITH {_FIELDS}, e AS (SELECT match_id, 'near' AS edge, unnest(range(0, CAST(len AS BIGINT) + 1)) AS k, len, wid FROM fields UNION ALL SELECT match_id, 'right', unnest(range(0, CAST(wid AS BIGINT) + 1)), len, wid FROM fields
UNION ALL SELECT match_id, 'far', unnest(range(0, CAST(len AS BIGINT) + 1)), len, wid FROM fields UNION ALL SELECT match_id, 'left', unnest(range(0, CAST(wid AS BIGINT) + 1)), len, wid FROM fields)
SELECT match_id, edge, k, CASE edge WHEN 'near' THEN k - len / 2 WHEN 'right' THEN len / 2 WHEN 'far' THEN len / 2 - k ELSE -len / 2 END + 0.0 AS x, CASE edge WHEN 'near' THEN 0.0 WHEN 'right' THEN k WHEN 'far' THEN wid ELSE wid - k END + 0.0::DOUBLE AS z FROM e""",
)
def field_boundary(spark, sf_dir):
    """The boundary, a metre apart, of a field that holds each match's positions."""
    fields = positions(spark, sf_dir).groupBy("match_id").agg((2 * F.ceil(F.max(F.abs("x")))).cast("double").alias("length"), F.ceil(F.max("z")).cast("double").alias("width"))
    return boundary(fields).select("match_id", "edge", "k", (F.col("x") + 0.0).alias("x"), (F.col("z") + 0.0).alias("z"))


def plan_tiles(spark, ground: G.Ground = GROUND, tile_w: int = 1920, tile_h: int = 720, near_h: int = 960, overlap: float = 0.15, margin: float = 6.0, down: float = 20.0, rows: int = 2, row_overlap: float = 16.0, far_head: float = 6.0) -> DataFrame:
    """Views that cover the field: tile, yaw, pitch, vfov, out_w, out_h.

    The extents of a grid of ground points give one row; it becomes a row a band of heights
    and then one a view, evenly spread over the band.
    """
    f = ground.field
    step = lambda first, last, n, k: F.lit(first) + k * ((last - first) / (n - 1))
    grid = spark.range(70 * 28).select(step(-f.length / 2 - 1, f.length / 2 + 1, 70, F.col("id") % 70).alias("x"), step(-1.5, f.width + 1.5, 28, F.floor(F.col("id") / 70)).alias("z"))
    az, el = G.azimuth_elevation(ground.ray(F.col("x"), F.col("z")))
    seen = grid.agg((F.min(az) - margin).alias("west"), (F.max(az) + margin).alias("east"), F.min(-el).alias("foot"), F.max(-el).alias("top"))
    head = F.least(F.greatest(F.abs("foot") * 0.85, F.lit(14.0)), F.lit(38.0))
    middle, foot, top = (F.col("foot") + F.col("top")) / 2, F.col("foot"), F.col("top")
    band = lambda low, high, height: F.struct(low.alias("low"), high.alias("high"), F.lit(height).alias("out_h"))
    near = band(foot - down, F.greatest(middle + row_overlap / 2, foot + head), near_h)
    bands = F.array(near, band(middle - row_overlap / 2, top + far_head, tile_h)) if rows > 1 else F.array(band(foot - down, top + head, near_h + tile_h))
    wide = seen.select("west", "east", F.posexplode(bands).alias("band", "b")).select("*", F.least(F.col("b.high") - F.col("b.low"), F.lit(88.0)).alias("vfov"))
    wide = wide.withColumn("hfov", F.col("vfov") * tile_w / F.col("b.out_h")).withColumn("span", F.col("east") - F.col("west"))
    views = wide.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("span") / (F.col("hfov") * (1 - overlap)))).cast("int"))
    views = views.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    # centres from one half view inside the west end to one inside the east end; a single one in the middle
    part = F.when(F.col("n") > 1, F.col("k") / F.greatest(F.col("n") - 1, F.lit(1))).otherwise(0.5)
    yaw = (F.col("west") + F.col("east")) / 2 + (part - 0.5) * (F.col("span") - F.col("hfov"))
    tile = F.row_number().over(Window.orderBy("band", "k")) - 1  # some tens of rows
    return views.select(tile.alias("tile"), yaw.alias("yaw"), (-(F.col("b.low") + F.col("b.high")) / 2).alias("pitch"), "vfov", F.lit(tile_w).alias("out_w"), F.col("b.out_h").alias("out_h"))


def covering(rays: DataFrame, tiles: list) -> DataFrame:
    """rays (az, el in degrees) with `tile` and `off`: of a plan's views the one whose middle is nearest among those that hold the ray; nulls where none does.

    A plan has some tens of views, so they are literals.
    """
    views = []
    for t in tiles:
        off = F.hypot(F.col("az") - t.yaw, F.col("el") - t.pitch)
        inside = (F.abs(F.col("az") - t.yaw) <= t.vfov * t.out_w / t.out_h / 2) & (F.abs(F.col("el") - t.pitch) <= t.vfov / 2)
        views.append(F.when(inside, F.struct(F.round(off, 6).alias("off"), F.lit(t.tile).alias("tile"))))
    return rays.withColumn("_t", F.array_min(F.filter(F.array(*views), lambda v: v.isNotNull()))).withColumns({"tile": F.col("_t.tile"), "off": F.col("_t.off")}).drop("_t")


@query(
    "tile_plan",
    sql=f"""WITH {_RAYS}, grid AS (SELECT {-FIELD.length / 2 - 1}::DOUBLE + i * {(FIELD.length + 2) / 69!r}::DOUBLE AS x, -1.5::DOUBLE + j * {(FIELD.width + 3) / 27!r}::DOUBLE AS z FROM range(70) a(i), range(28) b(j)),
graw AS (SELECT {', '.join(f'{e} AS q{i}' for i, e in enumerate(_mul(_H, ('x', 'z', '1.0'))))} FROM grid),
seen AS (SELECT min(degrees(atan2(q0, q2))) - 6 AS west, max(degrees(atan2(q0, q2))) + 6 AS east, min(degrees(asin(q1 / sqrt(q0 * q0 + q1 * q1 + q2 * q2)))) AS foot, max(degrees(asin(q1 / sqrt(q0 * q0 + q1 * q1 + q2 * q2)))) AS top FROM graw),
bands AS (SELECT west, east, 0 AS band, foot - 20 AS low, greatest((foot + top) / 2 + 8, foot + least(greatest(0.85 * abs(foot), 14), 38)) AS high, 960 AS out_h FROM seen UNION ALL SELECT west, east, 1, (foot + top) / 2 - 8, top + 6, 720 FROM seen),
wide AS (SELECT *, least(high - low, 88) AS vfov, least(high - low, 88) * 1920 / out_h AS hfov FROM bands),
many AS (SELECT *, CAST(greatest(1, ceil((east - west) / (hfov * 0.85))) AS INT) AS n FROM wide),
views AS (SELECT *, unnest(range(n)) AS k FROM many),
plan AS (SELECT CAST(row_number() OVER (ORDER BY band, k) - 1 AS INT) AS tile, (west + east) / 2 + (CASE WHEN n > 1 THEN CAST(k AS DOUBLE) / greatest(n - 1, 1) ELSE 0.5 END - 0.5) * (east - west - hfov) AS yaw, -(low + high) / 2 AS pitch, vfov, hfov FROM views),
d AS (SELECT match_id, track_id, frame, degrees(atan2(r0, r2)) AS az, degrees(asin(greatest(least(-r1, 1), -1))) AS el FROM rays),
met AS (SELECT match_id, track_id, frame, min(struct_pack(o := round(sqrt((az - yaw) ** 2 + (el - pitch) ** 2), 6), t := tile)) AS best FROM d JOIN plan ON abs(az - yaw) <= hfov / 2 AND abs(el - pitch) <= vfov / 2 GROUP BY ALL)
SELECT match_id, track_id, frame, best.t AS tile, best.o AS off FROM d LEFT JOIN met USING (match_id, track_id, frame)""",
)
def tile_plan(spark, sf_dir):
    """The tile of the plan that sees each position best."""
    az, el = G.azimuth_elevation(_v())
    seen = _rays(spark, sf_dir).select(*_ROW, az.alias("az"), el.alias("el"))
    return covering(seen, plan_tiles(spark).orderBy("tile").collect()).select(*_ROW, "tile", "off")


_BF = 480 / math.tan(math.radians(30.0))
_BW, _BSRC, _BBACK = _mul(_m(G.rotation(14.0, 0.0)), ("v0", "v1", "v2")), _mul(_m(_LR), ("r0", "r1", "r2")), _mul(_I, ("r0", "r1", "r2"))
# the lens and its inverse cancel on the way to the ground; where a pixel is tells whether it is on the source
_BOXES = f"""WITH {POSITIONS}, box AS (SELECT match_id, track_id, frame, (x + 52) * 18 AS x1, (z + 4) * 20 AS y1, (x + 52) * 18 + 20 + tile * 12 AS x2, (z + 4) * 20 + 70 AS y2 FROM positions),
ends AS (SELECT *, 'h' AS k, y1 AS y FROM box UNION ALL SELECT *, 'f', y2 FROM box),
p AS (SELECT *, floor(least(greatest((x1 + x2) / 2, 0), 1919)) - 959.5 AS u, -(floor(least(greatest(y, 0), 959)) - 479.5) AS v FROM ends),
u AS (SELECT *, u / sqrt(u * u + v * v + {_BF * _BF!r}::DOUBLE) AS v0, v / sqrt(u * u + v * v + {_BF * _BF!r}::DOUBLE) AS v1, {_BF!r}::DOUBLE / sqrt(u * u + v * v + {_BF * _BF!r}::DOUBLE) AS v2 FROM p),
r AS (SELECT *, {_BW[0]} AS r0, {_BW[1]} AS r1, {_BW[2]} AS r2 FROM u),
i AS (SELECT *, ((atan2({_BSRC[0]}, {_BSRC[2]}) / {math.radians(LENS.hfov_deg)!r}::DOUBLE + 0.5) * {LENS.src_w - 1} - {_CX}) / {_N!r}::DOUBLE AS nx, ((0.5 - asin(greatest(least({_BSRC[1]}, 1), -1)) / {math.radians(LENS.vfov_deg)!r}::DOUBLE) * {LENS.src_h - 1} - {_CY}) / {_N!r}::DOUBLE AS ny FROM r),
s AS (SELECT *, {_CX} + nx * (1 + {LENS.k1}::DOUBLE * (nx * nx + ny * ny) + {LENS.k2}::DOUBLE * (nx * nx + ny * ny) ** 2) * {_N!r}::DOUBLE AS sx, {_CY} + ny * (1 + {LENS.k1}::DOUBLE * (nx * nx + ny * ny) + {LENS.k2}::DOUBLE * (nx * nx + ny * ny) ** 2) * {_N!r}::DOUBLE AS sy,
  nullif({_det(_P, _Q, _WV)}, 0) AS d, {_det(_P, _Q, _M)} AS l, {_det(_M, _Q, _WV)} AS a, {_det(_P, _M, _WV)} AS b, nullif({_BBACK[2]}, 0) AS w FROM i),
g AS (SELECT *, CASE WHEN k = 'f' THEN {_BBACK[0]} / w WHEN l / d > 0 THEN a / d END AS gx, CASE WHEN k = 'f' THEN {_BBACK[1]} / w WHEN l / d > 0 THEN b / d END AS gz FROM s),
ok AS (SELECT *, sx >= 0 AND sx < {LENS.src_w} AND sy >= 0 AND sy < {LENS.src_h} AND gz >= -12 AND gz <= 52 AND abs(gx) <= 75 AS fine FROM g),
one AS (SELECT match_id, track_id, frame, any_value(x2 - x1) AS wide, any_value(y2 - y1) AS tall, any_value(y1 <= 6) AS top, any_value(y2 >= 954) AS bottom, max(CASE WHEN k = 'h' AND fine THEN struct_pack(x := gx, z := gz) END) AS h, max(CASE WHEN k = 'f' AND fine THEN struct_pack(x := gx, z := gz) END) AS f FROM ok GROUP BY ALL),
best AS (SELECT match_id, track_id, frame, CASE WHEN bottom AND NOT top THEN h WHEN top AND NOT bottom THEN f WHEN tall / greatest(wide, 1) < 2 THEN coalesce(h, f) ELSE coalesce(f, h) END AS v FROM one)
SELECT match_id, track_id, frame, round(v.x, 5) AS gx, round(v.z, 5) AS gz FROM best"""


@query("box_to_ground", sql=_BOXES)
def box_to_ground(spark, sf_dir):
    tile = {"yaw": 0.0, "pitch": 14.0, "vfov": 60.0, "out_w": 1920, "out_h": 960}
    x1, y1 = (F.col("x") + 52) * 18, (F.col("z") + 4) * 20
    box = positions(spark, sf_dir).select(*_ROW, x1.alias("x1"), y1.alias("y1"), (x1 + 20 + F.col("tile") * 12).alias("x2"), (y1 + 70).alias("y2"))
    return rounded(boxes.to_ground(box, tile, LENS, GROUND).select(*_ROW, "gx", "gz"), 5)


@query(
    "adaptive_d",
    sql=f"""WITH {_VIEWS}, s AS (SELECT match_id, frame, 38.0::DOUBLE - abs(pitch) AS room, 9.0::DOUBLE / 16 * sin(radians(hfov) / 2) AS s, cos(radians(hfov) / 2) AS c FROM views)
SELECT match_id, frame, round(CASE WHEN room <= 0 THEN 1.5 WHEN tan(radians(room)) * c >= s THEN 0 WHEN tan(radians(room)) - s <= 1e-9 THEN 1.5 ELSE least(1.5, greatest((s - tan(radians(room)) * c) / (tan(radians(room)) - s), 0)) END, 9) AS d FROM s""",
)
def adaptive_d(spark, sf_dir):
    """The least d of each frame's view."""
    d = F.least(F.lit(1.5), G.least_d(F.col("hfov"), F.col("pitch"), Lens(), 9 / 16))
    return rounded(_views(spark, sf_dir).select("match_id", "frame", d.alias("d")))


@query(
    "required_pad",
    sql=f"""WITH {_VIEWS} SELECT match_id, round(max(greatest(degrees(atan(1.5 * 9 / 16 * sin(radians(hfov) / 2) / (0.5 + cos(radians(hfov) / 2)))) + abs(pitch) - 40, 0)) + 2, 9) AS pad_deg FROM views GROUP BY match_id""",
)
def required_pad(spark, sf_dir):
    """The margin that each match's views need at d = 0.5."""
    over = G.overflow(F.col("hfov"), F.col("pitch"), F.lit(0.5), Lens(), 9 / 16)
    return rounded(_views(spark, sf_dir).groupBy("match_id").agg((F.max(over) + 2.0).alias("pad_deg")))


@query(
    "pad_ramp",
    sql=f"""WITH {_VIEWS}, pads AS (SELECT match_id, CAST(ceil(max(greatest(degrees(atan(1.5 * 9 / 16 * sin(radians(hfov) / 2) / (0.5 + cos(radians(hfov) / 2)))) + abs(pitch) - 40, 0)) + 2) AS BIGINT) AS p, match_id % 3 * 3 AS f FROM views GROUP BY match_id),
r AS (SELECT match_id, p, f, unnest(range(40 + 2 * p)) AS i FROM pads),
w AS (SELECT match_id, i, CASE WHEN i < p THEN 1 - i / greatest(p - 1, 1)::DOUBLE WHEN i >= 40 + p THEN CASE WHEN p > 1 THEN (i - 40 - p) / (p - 1)::DOUBLE ELSE 0 END ELSE 0 END AS wide,
  CASE WHEN i < p OR i >= 40 + p THEN NULL WHEN f > 0 AND i - p < f THEN 1 - (i - p) / greatest(f - 1, 1)::DOUBLE WHEN f > 0 AND i - p >= 40 - f THEN (i - p - 40 + f) / (f - 1)::DOUBLE ELSE 0 END AS soft FROM r)
SELECT match_id, i AS "row", round(wide, 9) AS wide, round(coalesce(soft, 1 - wide), 9) AS seam, round(1 - wide - coalesce(soft, 1 - wide), 9) + 0.0 AS source FROM w""",
)
def pad_ramp(spark, sf_dir):
    """Weights of each row of a source of 40 rows, padded by a row for each degree that a match's views need, with a fade of 0, 3 or 6 rows."""
    over = G.overflow(F.col("hfov"), F.col("pitch"), F.lit(0.5), Lens(), 9 / 16)
    pads = _views(spark, sf_dir).groupBy("match_id").agg(F.ceil(F.max(over) + 2.0).alias("pad")).withColumn("fade", F.col("match_id") % 3 * 3)
    rows = pads.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), 39 + 2 * F.col("pad"))))
    wide, seam, source = G.pad_rows(F.col("row"), F.lit(40), F.col("pad"), F.col("fade"))
    return rounded(rows.select("match_id", "row", wide.alias("wide"), seam.alias("seam"), source.alias("source"))).withColumn("source", F.col("source") + 0.0)


@query(
    "crop_decision",
    sql=f"WITH {_PIXELS}, b AS (SELECT match_id, frame, greatest(0, CAST(floor(min(sx)) AS BIGINT)) AS x0, least(4607, CAST(ceil(max(sx)) AS BIGINT)) AS x1, greatest(0, CAST(floor(min(sy)) AS BIGINT)) AS y0, least(1727, CAST(ceil(max(sy)) AS BIGINT)) AS y1 FROM pixels GROUP BY ALL) SELECT match_id, frame, x1 - x0 + 1 AS crop_w, y1 - y0 + 1 AS crop_h, CAST(x1 - x0 + 1 >= 8 AND y1 - y0 + 1 >= 8 AND greatest(1920.0::DOUBLE / (x1 - x0 + 1), 1080.0::DOUBLE / (y1 - y0 + 1)) >= 1.2 AS INT) AS upscale FROM b",
)
def crop_decision(spark, sf_dir, least: float = 1.2):
    x, y = G.pixel_of(_v(), LENS)
    p = _rays(spark, sf_dir).select("match_id", "frame", F.round(x, 9).alias("sx"), F.round(y, 9).alias("sy"))
    lo = lambda c: F.greatest(F.lit(0).cast("long"), F.floor(F.min(c)))
    b = p.groupBy("match_id", "frame").agg((F.least(F.lit(4607).cast("long"), F.ceil(F.max("sx"))) - lo("sx") + 1).alias("crop_w"), (F.least(F.lit(1727).cast("long"), F.ceil(F.max("sy"))) - lo("sy") + 1).alias("crop_h"))
    worth = (F.col("crop_w") >= 8) & (F.col("crop_h") >= 8) & (F.greatest(1920.0 / F.col("crop_w"), 1080.0 / F.col("crop_h")) >= least)
    return b.withColumn("upscale", worth.cast("int"))


@query("sideline_marks", sql=f"WITH {POSITIONS}, m AS (SELECT track_id, frame, x, z, CASE WHEN abs(z) < abs(z - 37) THEN 'near' ELSE 'far' END AS side FROM positions WHERE abs(z) < 5 OR abs(z - 37) < 5), g AS (SELECT track_id, side, count(*) AS n, sqrt(avg(power(z - CASE side WHEN 'near' THEN 0 ELSE 37 END, 2))) AS rms FROM m GROUP BY ALL) SELECT track_id, side, n, round(rms, 9) AS rms, CASE WHEN rms < 1 THEN 'good' WHEN rms < 5 THEN 'warn' ELSE 'bad' END AS grade FROM g")
def sideline_marks(spark, sf_dir):
    """Marks near a sideline by class, outliers of 5 m left out, with the residual and its grade."""
    z = F.col("z")
    near = F.abs(z) < F.abs(z - FIELD.width)
    gap = F.when(near, z).otherwise(z - FIELD.width)
    m = positions(spark, sf_dir).where(F.abs(gap) < 5).select("track_id", F.when(near, "near").otherwise("far").alias("side"), gap.alias("gap"))
    g = m.groupBy("track_id", "side").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow("gap", F.lit(2)))).alias("rms"))
    return rounded(g.withColumn("grade", F.when(F.col("rms") < 1, "good").when(F.col("rms") < 5, "warn").otherwise("bad")))


@query("mark_hit_test", sql=f"WITH {POSITIONS}, marks(mark, mx, mz) AS (VALUES ('c0', -50.0::DOUBLE, 0.0::DOUBLE), ('c1', 50.0, 0.0), ('c2', 50.0, 37.0), ('c3', -50.0, 37.0), ('m', 0.0, 18.5)), d AS (SELECT match_id, track_id, frame, mark, round(sqrt((x - mx) ** 2 + (z - mz) ** 2), 9) AS dist FROM positions, marks) SELECT match_id, track_id, frame, min_by(mark, struct_pack(d := dist, m := mark)) AS mark, min(dist) AS dist FROM d WHERE dist <= 25 GROUP BY ALL")
def mark_hit_test(spark, sf_dir):
    """The nearest of a fixed handful of marks within reach; the marks are literals, so no join is needed."""
    marks = [("c0", -50.0, 0.0), ("c1", 50.0, 0.0), ("c2", 50.0, 37.0), ("c3", -50.0, 37.0), ("m", 0.0, 18.5)]
    each = F.array_sort(F.array(*[F.struct(F.round(F.hypot(F.col("x") - x, F.col("z") - z), 9).alias("dist"), F.lit(k).alias("mark")) for k, x, z in marks]))
    return positions(spark, sf_dir).withColumn("m", F.get(each, 0)).where("m.dist <= 25").select(*_ROW, "m.mark", "m.dist")


def synthetic_marks(lens: Lens = LENS, ground: G.Ground = GROUND) -> fitting.Marks:
    """Corner and sideline marks as the synthetic camera sees them."""
    w, hx = ground.field.width, ground.field.length / 2
    see = lambda p: fitting.np_pixel(np.column_stack([p, np.ones(len(p))]) @ ground.matrix.T / np.linalg.norm(np.column_stack([p, np.ones(len(p))]) @ ground.matrix.T, axis=1, keepdims=True), lens)
    corners = np.array([[-hx, 0], [hx, 0], [hx, w], [-hx, w]], float)
    line = np.linspace(-hx * 0.9, hx * 0.9, 10)
    return fitting.Marks(see(corners), corners, see(np.column_stack([line, np.zeros(10)])), see(np.column_stack([line, np.full(10, w)])))


def camera_marks(spark, sf_dir) -> DataFrame:
    """Marks of a camera a match: the field's corners, and each track's mean position taken to the nearer sideline, as that camera sees them.

    Cameras differ in height, tilt and lens by their match; a track's mean conf moves its mark by part of a pixel.
    """

    def see(pdf):
        m = int(pdf["match_id"].iloc[0])
        ground = G.synthetic_ground(5.0 + m % 4, 6.0 + m % 5, 1.0 * (m % 3), FIELD)
        lens = Lens(k1=-0.02 * (m % 5), hfov_deg=188.0 + m % 5)
        pdf = pdf.sort_values("track_id", kind="stable")
        side = np.where(np.abs(pdf["z"]) < np.abs(pdf["z"] - FIELD.width), "near", "far")
        points = np.vstack([_CORNERS, np.column_stack([np.clip(pdf["x"], -45, 45), np.where(side == "near", 0.0, FIELD.width)])])
        v = np.column_stack([points, np.ones(len(points))]) @ ground.matrix.T
        px = fitting.np_pixel(v / np.linalg.norm(v, axis=1, keepdims=True), lens)
        px[4:] += (pdf["conf"].to_numpy() - 0.6)[:, None] * [4.0, -4.0]
        corner = np.arange(len(points)) < 4
        return pd.DataFrame({"camera_id": m, "kind": ["corner"] * 4 + list(side), "px": px[:, 0], "py": px[:, 1], "x": np.where(corner, points[:, 0], np.nan), "z": np.where(corner, points[:, 1], np.nan)})

    # spread along the line, as means lie near the middle
    mean = positions(spark, sf_dir).groupBy("match_id", "track_id").agg((F.avg("x") * 8).alias("x"), F.avg("z").alias("z"), F.avg("conf").alias("conf"))
    return mean.groupBy("match_id").applyInPandas(see, calibration.MARKS)


_CORNERS = np.array([[-FIELD.length / 2, 0], [FIELD.length / 2, 0], [FIELD.length / 2, FIELD.width], [-FIELD.length / 2, FIELD.width]])


@query("fitted_homography")
def fitted_homography(spark, sf_dir):
    """Each camera's homography from its marks, the lens as it is."""
    c = calibration.calibrate(camera_marks(spark, sf_dir), Lens(), FIELD, None)
    return rounded(c.select("camera_id", "marks", *[F.get("h", i).alias(f"h{i // 3}{i % 3}") for i in range(9)], "near_rms", "far_rms", "height"), 5)


@query("calibrated_cameras")
def calibrated_cameras(spark, sf_dir):
    """Each camera's homography and six lens terms together."""
    c = calibration.calibrate(camera_marks(spark, sf_dir), Lens(), FIELD, calibration.TERMS)
    return rounded(c.select("camera_id", "marks", *calibration.TERMS, "corner_rms", "near_rms", "far_rms", "height"), 4)
