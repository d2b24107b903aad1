"""Lens, ground and view geometry as column expressions; models are literals from the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import Field, Lens

Vec = tuple[Column, Column, Column]


def rotation(pitch: float = 0.0, yaw: float = 0.0, roll: float = 0.0) -> np.ndarray:
    """yaw about y, then pitch about x, then roll about z (degrees, right-handed)."""
    a, b, c = (math.radians(v) for v in (pitch, yaw, roll))
    x = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
    y = np.array([[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]])
    z = np.array([[math.cos(c), -math.sin(c), 0], [math.sin(c), math.cos(c), 0], [0, 0, 1]])
    return y @ x @ z


def turn(m: np.ndarray, v: Vec) -> Vec:
    """m @ v with m as literals."""
    return tuple(sum((F.lit(float(m[i, j])) * v[j] for j in range(1, 3)), F.lit(float(m[i, 0])) * v[0]) for i in range(3))


def look(v: Vec, yaw: Column, pitch: Column) -> Vec:
    """v of a camera that looks along yaw and pitch (columns of degrees) in the world: as `turn` by `rotation(pitch, yaw)`."""
    a, b = F.radians(pitch), F.radians(yaw)
    y, z = F.cos(a) * v[1] - F.sin(a) * v[2], F.sin(a) * v[1] + F.cos(a) * v[2]
    return F.cos(b) * v[0] + F.sin(b) * z, y, F.cos(b) * z - F.sin(b) * v[0]


def unit(v: Vec) -> Vec:
    n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return tuple(c / n for c in v)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi)))


def _centre(lens: Lens) -> tuple[float, float, float]:
    cx = lens.cx if lens.cx >= 0 else (lens.src_w - 1) / 2
    cy = lens.cy if lens.cy >= 0 else (lens.src_h - 1) / 2
    return cx, cy, math.hypot(lens.src_w / 2, lens.src_h / 2)


def distort(x: Column, y: Column, lens: Lens) -> tuple[Column, Column]:
    """Ideal pixels to those of the lens."""
    if lens.k1 == 0 and lens.k2 == 0:
        return x, y
    cx, cy, n = _centre(lens)
    dx, dy = (x - cx) / n, (y - cy) / n
    r2 = dx * dx + dy * dy
    f = 1 + lens.k1 * r2 + lens.k2 * r2 * r2
    return cx + dx * f * n, cy + dy * f * n


def undistort(x: Column, y: Column, lens: Lens, rounds: int = 12) -> tuple[Column, Column]:
    """The inverse, by a fixed number of fixed-point rounds folded over a sequence."""
    if lens.k1 == 0 and lens.k2 == 0:
        return x, y
    cx, cy, n = _centre(lens)
    dx, dy = (x - cx) / n, (y - cy) / n
    rd = F.sqrt(dx * dx + dy * dy)
    r = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), rd, lambda r, _: rd / (1 + lens.k1 * r * r + lens.k2 * r * r * r * r))
    s = F.when(rd > 1e-9, r / F.greatest(rd, F.lit(1e-9))).otherwise(1.0)
    return cx + dx * s * n, cy + dy * s * n


def pixel_of(v: Vec, lens: Lens) -> tuple[Column, Column]:
    """World direction to source pixel."""
    x, y, z = turn(rotation(pitch=lens.pitch0_deg) @ rotation(roll=lens.roll0_deg), v)
    lon, lat = F.atan2(x, z), F.asin(clip(y, -1, 1))
    return distort((lon / math.radians(lens.hfov_deg) + 0.5) * (lens.src_w - 1), (0.5 - lat / math.radians(lens.vfov_deg)) * (lens.src_h - 1), lens)


def direction_of(x: Column, y: Column, lens: Lens) -> Vec:
    """Source pixel to unit world direction."""
    ix, iy = undistort(x, y, lens)
    lon, lat = (ix / (lens.src_w - 1) - 0.5) * math.radians(lens.hfov_deg), (0.5 - iy / (lens.src_h - 1)) * math.radians(lens.vfov_deg)
    back = (rotation(pitch=lens.pitch0_deg) @ rotation(roll=lens.roll0_deg)).T
    return turn(back, (F.sin(lon) * F.cos(lat), F.sin(lat), F.cos(lon) * F.cos(lat)))


@dataclass(frozen=True)
class Ground:
    """A homography from the ground plane to rays, row by row."""

    H: tuple[float, ...]
    field: Field = Field()

    @property
    def matrix(self) -> np.ndarray:
        return np.array(self.H, float).reshape(3, 3)

    def ray(self, x: Column, z: Column) -> Vec:
        return unit(turn(self.matrix, (x, z, F.lit(1.0))))

    def point(self, v: Vec) -> tuple[Column, Column]:
        """Null where the ray is parallel to the ground."""
        a, b, c = turn(np.linalg.inv(self.matrix), v)
        c = F.when(c != 0, c)
        return a / c, b / c

    def pose(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(r1, r2, r3, t): axes of the plane made orthonormal, and the offset, at unit scale."""
        h = self.matrix
        h = h * (2 / max(np.linalg.norm(h[:, 0]) + np.linalg.norm(h[:, 1]), 1e-9))
        u, _, vt = np.linalg.svd(h[:, :2], full_matrices=False)
        axes = u @ vt
        axes *= np.where((axes * h[:, :2]).sum(0) < 0, -1, 1)
        r1, r3 = axes.T
        return r1, np.cross(r3, r1), r3, h[:, 2]

    def camera(self) -> tuple[float, float]:
        """The camera's place on the ground; the origin where the pose is singular."""
        r1, r2, r3, t = self.pose()
        try:
            c = -np.linalg.solve(np.column_stack([r1, r2, r3]), t)
        except np.linalg.LinAlgError:
            return 0.0, 0.0
        return float(c[0]), float(c[2])

    def below_head(self, v: Vec, height: float = 1.75) -> tuple[Column, Column]:
        """The ground under a head seen along v, by Cramer's rule; null behind the camera or where singular."""
        r1, r2, r3, t = self.pose()
        rhs = -(r2 * height + t)
        lit = lambda a: tuple(F.lit(float(x)) for x in a)

        def det(a: Vec, b: Vec, c: Vec) -> Column:
            return a[0] * (b[1] * c[2] - b[2] * c[1]) - b[0] * (a[1] * c[2] - a[2] * c[1]) + c[0] * (a[1] * b[2] - a[2] * b[1])

        p, q, m, w = lit(r1), lit(r3), lit(rhs), tuple(-c for c in v)
        d = det(p, q, w)
        d = F.when(d != 0, d)
        ok = det(p, q, m) / d > 0
        return F.when(ok, det(m, q, w) / d), F.when(ok, det(p, m, w) / d)

    def fixed_pitch(self) -> float:
        """A steady tilt towards the middle of the field, with headroom."""
        v = self.matrix @ np.array([0.0, self.field.width / 2, 1.0])
        v /= np.linalg.norm(v)
        return float(np.clip(math.degrees(math.asin(np.clip(-v[1], -1, 1))) - 6.0, -2.0, 10.0))


def synthetic_ground(height: float = 6.0, back: float = 8.0, pitch_deg: float = 0.0, field: Field = Field()) -> Ground:
    """The homography of a camera behind the near sideline that looks down by pitch_deg."""
    # a ground point (x, z) stands at (x, -height, z + back) from the camera, before the tilt
    plane = np.array([[1.0, 0, 0], [0, 0, -height], [0, 1.0, back]])
    return Ground(tuple((rotation(pitch=pitch_deg).T @ plane).ravel()), field)


def azimuth_elevation(v: Vec) -> tuple[Column, Column]:
    """Degrees; elevation grows downwards."""
    return F.degrees(F.atan2(v[0], v[2])), F.degrees(F.asin(clip(-v[1], -1, 1)))


def view_ray(u: Column, v: Column, fov_deg: float | Column, out_w: int, out_h: int, projection: str = "rectilinear", blend: float = 1.0) -> Vec:
    """Unit ray of a view's pixel, offsets from its middle."""
    if isinstance(fov_deg, Column):
        if projection != "rectilinear":
            raise ValueError("a column of widths is for rectilinear views")
        return unit((u, -v, out_h / 2 / F.tan(F.radians(fov_deg) / 2)))
    half = math.radians(fov_deg) / 2
    if projection == "cylindrical":
        flat, bent = out_w / 2 / math.tan(half), out_w / 2 / half
        az = (1 - blend) * F.atan(u / flat) + blend * (u / bent)
        return unit((F.sin(az), -(v / bent), F.cos(az)))
    if projection == "panini":
        scale = out_w / 2 / ((blend + 1) * math.sin(half) / (blend + math.cos(half)))
        s = u / scale / (blend + 1)
        lam = F.atan(s) + F.asin(clip(s * blend / F.sqrt(1 + s * s), -1, 1))
        phi = F.atan(v / scale / (blend + 1) * (blend + F.cos(lam)))
        return F.sin(lam) * F.cos(phi), -F.sin(phi), F.cos(lam) * F.cos(phi)
    return unit((u, -v, F.lit(out_h / 2 / math.tan(half))))


def view_pixel(world: Vec, yaw: float, pitch: float, fov_deg: float, out_w: int, out_h: int, roll: float = 0.0, projection: str = "rectilinear", blend: float = 1.0) -> tuple[Column, Column]:
    """World ray to the view's pixel; null behind the camera."""
    x, y, z = turn(rotation(pitch, yaw, roll).T, world)
    half, mid = math.radians(fov_deg) / 2, ((out_w - 1) / 2, (out_h - 1) / 2)
    if projection == "rectilinear":
        f = out_h / 2 / math.tan(half)
        z = F.when(z > 1e-6, z)
        return f * x / z + mid[0], -f * y / z + mid[1]
    az, flat_r = F.atan2(x, z), F.greatest(F.sqrt(x * x + z * z), F.lit(1e-9))
    if projection == "cylindrical":
        flat, bent = out_w / 2 / math.tan(half), out_w / 2 / half

        def newton(u: Column, _: Column) -> Column:
            g = (1 - blend) * F.atan(u / flat) + blend * (u / bent) - az
            return u - g / ((1 - blend) / (flat * (1 + (u / flat) * (u / flat))) + blend / bent)

        u = F.aggregate(F.sequence(F.lit(1), F.lit(8)), az * bent, newton)
        return F.when(z > 0, u + mid[0]), F.when(z > 0, -y / flat_r * bent + mid[1])
    scale = out_w / 2 / ((blend + 1) * math.sin(half) / (blend + math.cos(half)))
    d = F.when((z > 0) & (blend + F.cos(az) > 1e-6), blend + F.cos(az))
    return (blend + 1) * F.sin(az) / d * scale + mid[0], (blend + 1) * (-y / flat_r) / d * scale + mid[1]


def least_d(hfov: Column, pitch: Column, lens: Lens, aspect: float, safety: float = 2.0, black: float = 0.0) -> Column:
    """The least d of the projection that leaves no black at the top or bottom of a view: 0 where none is needed, infinite where none will do."""
    room = lens.vfov_deg / 2 - safety - F.abs(pitch + lens.pitch0_deg) + black
    t, s, c = F.tan(F.radians(room)), aspect * F.sin(F.radians(hfov) / 2), F.cos(F.radians(hfov) / 2)
    gap = t - s
    inf = F.lit(float("inf"))
    return F.when(room <= 0, inf).when(t * c >= s, 0.0).when(gap <= 1e-9, inf).otherwise(F.greatest((s - t * c) / gap, F.lit(0.0)))


def overflow(hfov: Column, pitch: Column, d: Column, lens: Lens, aspect: float) -> Column:
    """Degrees by which a view reaches beyond the source, above or below."""
    h = F.radians(hfov) / 2
    top = F.degrees(F.atan((d + 1) * aspect * F.sin(h) / F.greatest(d + F.cos(h), F.lit(1e-9))))
    return F.greatest(top + F.abs(pitch + lens.pitch0_deg) - lens.vfov_deg / 2, F.lit(0.0))


def pad_rows(row: Column, height: Column, pad: Column, fade: Column) -> tuple[Column, Column, Column]:
    """Weights of the wide blur, the seam's blur and the source in each row of a frame padded above and below.

    From the outer edge to the seam the wide blur gives way to the seam's in equal steps; in the first `fade` rows
    of the source the seam's blur gives way to the source. There is no fade where both would meet.
    """
    part = lambda i, n: F.when(n > 1, i / F.greatest(n - 1, F.lit(1))).otherwise(0.0)  # noqa: E731  from 0 at the first to 1 at the last
    from_top, from_end = row, height + 2 * pad - 1 - row
    outer = F.least(from_top, from_end)
    inner = outer - pad
    fades = (fade > 0) & (2 * fade < height)
    # a single padded row is the wide blur's above, the seam's below
    wide = F.when(outer < pad, F.when(pad > 1, 1 - part(outer, pad)).otherwise(F.when(from_top < pad, 1.0).otherwise(0.0))).otherwise(0.0)
    soft = F.when(fades & (inner < fade), F.when(fade > 1, 1 - part(inner, fade)).otherwise(F.when(from_top < pad + fade, 1.0).otherwise(0.0))).otherwise(0.0)
    seam = F.when(outer < pad, 1 - wide).otherwise(soft)
    return wide, seam, 1 - wide - seam
