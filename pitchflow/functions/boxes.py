"""Boxes to ground points, with the anchor chosen by shape and by what the tile's edge cuts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.features import plausible
from ..schema import Lens
from .geometry import Ground, direction_of, pixel_of, rotation, turn, undistort, view_ray


def cuts(y1: Column, y2: Column, height: float, edge: float = 6.0) -> tuple[Column, Column]:
    """(cut at the top, cut at the bottom)"""
    return y1 <= edge, y2 >= height - edge


def to_ground(df: DataFrame, tile: dict, lens: Lens, ground: Ground, height: float = 1.75, edge: float = 6.0) -> DataFrame:
    """The ground under boxes.

    df (x1, y1, x2, y2: a box in the tile with yaw, pitch, vfov, out_w, out_h) with gx, gz; null where neither anchor is plausible.

    Cut at the bottom: the head alone; cut at the top: the foot alone; else the head first
    for boxes less than twice as tall as wide, the foot first for others. Each stage is a
    column of its own, so that no expression holds another twice. Where df has ankle_x and
    ankle_y and they lie below the box, the foot is there.
    """
    w, h = tile["out_w"], tile["out_h"]
    turned = rotation(tile["pitch"], tile["yaw"])
    within = lambda c, n: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(n - 1.0)))  # noqa: E731  pixels are whole, as of a remapped tile
    names = list(df.columns)
    middle, foot_x, foot_y = (F.col("x1") + F.col("x2")) / 2, (F.col("x1") + F.col("x2")) / 2, F.col("y2")
    if {"ankle_x", "ankle_y"} <= set(names):
        low = F.coalesce(F.col("ankle_y") > F.col("y2"), F.lit(False)) & F.col("ankle_x").isNotNull()
        foot_x, foot_y = F.when(low, F.col("ankle_x")).otherwise(middle), F.when(low, F.col("ankle_y")).otherwise(foot_y)
    for k, x, y in (("h", middle, F.col("y1")), ("f", foot_x, foot_y)):
        df = df.withColumns({f"_{k}u": within(x, w) - (w - 1) / 2, f"_{k}v": within(y, h) - (h - 1) / 2})
        df = df.withColumns({f"_{k}r{i}": c for i, c in enumerate(view_ray(F.col(f"_{k}u"), F.col(f"_{k}v"), tile["vfov"], w, h))})
        df = df.withColumns({f"_{k}w{i}": c for i, c in enumerate(turn(turned, tuple(F.col(f"_{k}r{i}") for i in range(3))))})
        df = df.withColumns(dict(zip((f"_{k}x", f"_{k}y"), pixel_of(tuple(F.col(f"_{k}w{i}") for i in range(3)), lens))))
        df = df.withColumns(dict(zip((f"_{k}ix", f"_{k}iy"), undistort(F.col(f"_{k}x"), F.col(f"_{k}y"), lens))))
        plain = replace(lens, k1=0.0, k2=0.0)
        df = df.withColumns({f"_{k}d{i}": c for i, c in enumerate(direction_of(F.col(f"_{k}ix"), F.col(f"_{k}iy"), plain))})
        v = tuple(F.col(f"_{k}d{i}") for i in range(3))
        df = df.withColumns(dict(zip((f"_{k}gx", f"_{k}gz"), ground.below_head(v, height) if k == "h" else ground.point(v))))
        inside = (F.col(f"_{k}x") >= 0) & (F.col(f"_{k}x") < lens.src_w) & (F.col(f"_{k}y") >= 0) & (F.col(f"_{k}y") < lens.src_h)
        ok = inside & plausible(F.col(f"_{k}gx"), F.col(f"_{k}gz"), ground.field)
        df = df.withColumns({f"_{k}px": F.when(ok, F.col(f"_{k}gx")), f"_{k}pz": F.when(ok, F.col(f"_{k}gz"))})
    top, bottom = cuts(F.col("y1"), F.col("y2"), h, edge)
    wide = (F.col("y2") - F.col("y1")) / F.greatest(F.col("x2") - F.col("x1"), F.lit(1.0)) < 2.0

    def pick(c: str) -> Column:
        head, foot = F.col(f"_hp{c}"), F.col(f"_fp{c}")
        return F.when(bottom & ~top, head).when(top & ~bottom, foot).when(wide, F.coalesce(head, foot)).otherwise(F.coalesce(foot, head))

    return df.select(*names, pick("x").alias("gx"), pick("z").alias("gz"))
