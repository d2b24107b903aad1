"""Multi-object tracking: constant-velocity Kalman filters and optimal assignment, one stretch of a match a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TrackRules
from .fusion import fused


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """The cheapest one-to-one matching of all rows or all columns (Kuhn-Munkres with potentials)."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    row_of = _rows_of_few(c.tolist()) if c.size <= FEW else _rows_of(c)
    found = [(int(row_of[j]) - 1, j - 1) for j in range(1, c.shape[1] + 1) if row_of[j]]
    return sorted((j, i) if turned else (i, j) for i, j in found)


#: Cells up to which plain numbers are faster than arrays.
FEW = 400


def _rows_of_few(c: list[list[float]]) -> list[int]:
    """As `_rows_of`, step for step, over lists."""
    n, m = len(c), len(c[0]) if c else 0
    u, v, row_of, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, used, free = [float("inf")] * (m + 1), [0], list(range(1, m + 1))
        while True:
            i0 = row_of[j0]
            row, base = c[i0 - 1], u[i0]
            j1, delta = 0, float("inf")
            for j in free:
                cur = row[j - 1] - base - v[j]
                if cur < least[j]:
                    least[j], way[j] = cur, j0
                if least[j] < delta or not j1:
                    j1, delta = j, least[j]
            for j in used:
                u[row_of[j]] += delta
                v[j] -= delta
            for j in free:
                least[j] -= delta
            j0 = j1
            if not row_of[j0]:
                break
            used.append(j0)
            free.remove(j0)
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    return row_of


def _rows_of(c: np.ndarray) -> np.ndarray:
    """The row (from 1) of each column (from 1), 0 where none; at least as many columns as rows."""
    n, m = c.shape
    u, v, row_of, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = row_of[j0]
            free = np.flatnonzero(~used[1:]) + 1
            cur = c[i0 - 1, free - 1] - u[i0] - v[free]
            better = cur < least[free]
            least[free[better]] = cur[better]
            way[free[better]] = j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[row_of[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if row_of[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            row_of[j0] = row_of[j1]
            j0 = j1
    return row_of


UNGATED = 1e6


def matched(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the gated pairs of the cheapest matching.

    Where the cheapest columns of the rows differ, they are the matching: each row is at its least. Else the
    matching is solved over the few columns that it can use: of k rows none needs more than its k cheapest.
    """
    best = cost.argmin(1)
    i = (cost.min(1) < UNGATED).nonzero()[0]
    j = best[i]
    if len(set(j.tolist())) == len(j):
        return i, j
    few = cost[i]
    k = len(i)
    use = np.array(sorted(set(few.argpartition(k - 1, axis=1)[:, :k].ravel().tolist()))) if k < few.shape[1] else np.arange(few.shape[1])
    rows, columns = np.array(assign(few[:, use])).T
    i, j = i[rows], use[columns]
    held = cost[i, j] < UNGATED
    return i[held], j[held]


class Tracker:
    """All live tracks of one match, a row each of two arrays. `as_dict` and `from_dict` hand them from chunk to chunk.

    The model treats both axes alike and apart, so a covariance is three numbers: of place, of place and speed, of speed.
    """

    def __init__(self, rules: TrackRules):
        dt, q, r = rules.dt, rules.q_accel**2, rules.r_pos**2
        self.rules, self.next_id, self.r = rules, 0, r
        # x, z, their speeds and the three covariances a step on: rows @ move + noise
        self.move = np.eye(7)
        self.move[2, 0] = self.move[3, 1] = self.move[6, 5] = dt
        self.move[5, 4], self.move[6, 4] = 2 * dt, dt * dt
        self.noise = q * np.array([0, 0, 0, 0, dt**4 / 4, dt**3 / 2, dt * dt])
        # the first point updates its own filter, which keeps it in place
        self.fresh = np.array([0.0, 0.0, r - r * r / (r + r) if r else 0.0, 0.0, 25.0])
        self.rows, self.counts = np.zeros((0, 7)), np.zeros((0, 3), np.int64)  # counts: id, hits, misses

    def costs(self, points: np.ndarray) -> np.ndarray:
        """Mahalanobis distance of each point from each track's predicted place; UNGATED beyond the gate."""
        x, z = points[:, :1] - self.rows[:, 0], points[:, 1:] - self.rows[:, 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.sqrt((x * x + z * z) / (self.rows[:, 4] + self.r))
        return np.where(d <= self.rules.gate, d, UNGATED)  # false for nan

    def step(self, points: np.ndarray) -> np.ndarray:
        """One detection step over points (n, 2); the track of each point."""
        self.rows = self.rows @ self.move + self.noise
        self.counts[:, 2] += 1
        owner = np.full(len(points), -1, np.int64)
        if len(self.rows) and len(points):
            j, i = matched(self.costs(points))
            if len(i):
                t = self.rows[i]
                gain = t[:, 4:6] / (t[:, 4:5] + self.r)
                off = points[j] - t[:, :2]
                t[:, :2] += gain[:, :1] * off
                t[:, 2:4] += gain[:, 1:] * off
                t[:, 6] -= gain[:, 1] * t[:, 5]
                t[:, 4:6] -= gain[:, :1] * t[:, 4:6]
                self.rows[i] = t
                self.counts[i, 1] += 1
                self.counts[i, 2] = 0
                owner[j] = self.counts[i, 0]
        live = self.counts[:, 2] <= self.rules.max_age
        if not live.all():
            self.rows, self.counts = self.rows[live], self.counts[live]
        new = (owner < 0).nonzero()[0]
        if len(new):
            owner[new] = self.next_id + np.arange(len(new))
            self.next_id += len(new)
            rows, counts = np.empty((len(new), 7)), np.zeros((len(new), 3), np.int64)
            rows[:, :2], rows[:, 2:] = points[new], self.fresh
            counts[:, 0], counts[:, 1] = owner[new], 1
            self.rows, self.counts = np.concatenate([self.rows, rows]), np.concatenate([self.counts, counts])
        return owner

    def as_dict(self) -> dict:
        state = lambda t: {"state": t[:4], "P": np.kron([[t[4], t[5]], [t[5], t[6]]], np.eye(2)).tolist()}
        return {"next_id": self.next_id, "tracks": [{"id": n, **state(t), "hits": h, "misses": m} for t, (n, h, m) in zip(self.rows.tolist(), self.counts.tolist())]}

    @classmethod
    def from_dict(cls, rules: TrackRules, d: dict) -> Tracker:
        out, held = cls(rules), d["tracks"]
        out.next_id = d["next_id"]
        out.counts = np.array([[t[c] for c in ("id", "hits", "misses")] for t in held], np.int64).reshape(-1, 3)
        out.rows = np.array([[*t["state"], t["P"][0][0], t["P"][0][2], t["P"][2][2]] for t in held], float).reshape(-1, 7)
        return out


HITS = "match_id long, track_id long, frame long, x double, z double, conf double, tiles long"


def follow(pdf: pd.DataFrame, tracker: Tracker, first: int | None = None, last: int | None = None) -> pd.DataFrame:
    """Hits with track_id: one step for each frame from first to last, also where nothing was seen."""
    pdf = pdf.sort_values(["frame", "cluster"], kind="stable")
    frames, points = pdf["frame"].to_numpy(np.int64), pdf[["x", "z"]].to_numpy(float)
    some = len(frames) > 0
    lo = (frames[0] if some else 0) if first is None else first
    hi = (frames[-1] if some else -1) if last is None else last
    owner = np.zeros(len(frames), np.int64)
    ends = np.searchsorted(frames, np.arange(lo, hi + 2)).tolist()
    for a, b in zip(ends, ends[1:]):
        owner[a:b] = tracker.step(points[a:b])
    kept = slice(ends[0], ends[-1])
    columns = [c.split()[0] for c in HITS.split(", ")]
    return pdf.assign(track_id=owner).iloc[kept][columns]


def segments(points: DataFrame, rules: TrackRules) -> DataFrame:
    """points with `segment`: after more than max_age frames without any point no track of a match lives, so what follows starts anew."""
    order = Window.partitionBy("match_id").orderBy("frame")
    cut = F.coalesce(F.col("frame") - F.lag("frame").over(order) > rules.max_age + 1, F.lit(False))
    return points.withColumn("_cut", cut.cast("long")).withColumn("segment", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def track(dets: DataFrame, rules: TrackRules) -> DataFrame:
    """Hits of all matches, with the ids that one tracker a match would give.

    A tracker is a recurrence over frames, but it forgets: the stretches of a match between long
    enough gaps are followed side by side, each with ids from 0, and shifted by the number of
    tracks that began before them.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = follow(pdf, Tracker(rules))
        return out.assign(segment=pdf["segment"].iloc[0], begins=(~out["track_id"].duplicated()).astype("int64"))

    points = fused(dets, rules).select("match_id", "frame", "cluster", "x", "z", "conf", "tiles")
    # by both columns, as a window's partitioning by match alone would hold a match in one task; and in a
    # stated number of parts, as few bytes are much work here and would be put into one task
    parts = int(dets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    apart = segments(points, rules).repartition(parts, "match_id", "segment")
    hits = apart.groupBy("match_id", "segment").applyInPandas(solve, HITS + ", segment long, begins long")
    before = Window.partitionBy("match_id").orderBy("segment").rangeBetween(Window.unboundedPreceding, -1)
    shifted = hits.withColumn("track_id", F.col("track_id") + F.coalesce(F.sum("begins").over(before), F.lit(0)))
    return shifted.select(*[c.split()[0] for c in HITS.split(", ")])
