"""Per-frame fusion of detections: pairs by a bearing-aware distance, components, one point each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TrackRules


def pair_score(ax: Column, az: Column, at: Column, bx: Column, bz: Column, bt: Column, rules: TrackRules) -> Column:
    """Below 1 for pairs that merge: lateral and radial gap about the camera over their tolerances; null at the camera."""
    cx, cz = rules.camera
    mx, mz = (ax + bx) / 2 - cx, (az + bz) / 2 - cz
    r = F.sqrt(mx * mx + mz * mz)
    dx, dz = ax - bx, az - bz
    radial = (dx * mx + dz * mz) / F.when(r >= 1e-6, r)
    lateral = F.sqrt(F.greatest(dx * dx + dz * dz - radial * radial, F.lit(0.0)))
    n = rules.near_tiles
    scale = F.when((at < n) != (bt < n), rules.cross_row).otherwise(1.0) if n > 0 else F.lit(1.0)
    p, q = lateral / (rules.lat_tol * scale), radial / (rules.rad_tol * scale)
    return F.sqrt(p * p + q * q)


def pairs(dets: DataFrame, rules: TrackRules) -> DataFrame:
    """a_id < b_id and score of the pairs of a frame that merge.

    A pair that merges is nearer than the radial tolerance, so the join goes by grid cells of
    that size and a detection meets its own and neighbouring cells only.
    """
    reach = rules.rad_tol * (rules.cross_row if rules.near_tiles > 0 else 1.0)
    cell = dets.withColumns({"_cx": F.floor(F.col("x") / reach), "_cz": F.floor(F.col("z") / reach)})
    side = lambda p: [F.col("det_id").alias(p + "_id"), *[F.col(c).alias(p + c) for c in ("x", "z", "tile")]]
    a = cell.select("match_id", "frame", *side("a"), "_cx", "_cz")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = cell.select("match_id", "frame", *side("b"), F.explode(around).alias("_o"), "_cx", "_cz").withColumns({"_cx": F.col("_cx") + F.col("_o.i"), "_cz": F.col("_cz") + F.col("_o.j")}).drop("_o")
    met = a.join(b, ["match_id", "frame", "_cx", "_cz"]).where("a_id < b_id")
    score = pair_score(F.col("ax"), F.col("az"), F.col("atile"), F.col("bx"), F.col("bz"), F.col("btile"), rules)
    return met.withColumn("score", score).where("score < 1").select("match_id", "frame", "a_id", "b_id", "score")


def nearest(asked: DataFrame, points: DataFrame, reach: float = 5.0) -> DataFrame:
    """match_id, frame, det_id, near_id, dist: the nearest of points in the frame of each of asked; frames without points have none.

    Both have match_id, frame, det_id, x, z; distances count to nine decimals, ties go to the smaller id. A point within
    reach lies in the own or a neighbouring cell, so an equi-join by cell settles all that have one; only the
    others meet their whole frame.
    """
    dx, dz = F.col("x") - F.col("px"), F.col("z") - F.col("pz")
    gap = F.sqrt(dx * dx + dz * dz)  # as SQL has it, to the bit
    p = points.select("match_id", "frame", F.col("det_id").alias("p_id"), F.col("x").alias("px"), F.col("z").alias("pz"))
    cell = lambda c, i=F.lit(0): F.floor(F.col(c) / reach) + i
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    by_cell = p.withColumn("_o", F.explode(around)).withColumns({"_cx": cell("px", F.col("_o.i")), "_cz": cell("pz", F.col("_o.j"))}).drop("_o")
    key = ["match_id", "frame", "det_id"]

    def least(met: DataFrame) -> DataFrame:
        d = met.withColumn("dist", F.round(gap, 9))
        return d.groupBy(*key).agg(F.min_by("p_id", F.struct("dist", "p_id")).alias("near_id"), F.min("dist").alias("dist"))

    own = asked.select(*key, "x", "z")
    close = least(own.withColumns({"_cx": cell("x"), "_cz": cell("z")}).join(by_cell, ["match_id", "frame", "_cx", "_cz"]).where(gap <= reach))
    settled = own.join(close, key, "left")
    far = least(settled.where("near_id is null").drop("near_id", "dist").join(p, ["match_id", "frame"]))
    return settled.where("near_id is not null").select(*key, "near_id", "dist").unionByName(far)


def clusters(dets: DataFrame, rules: TrackRules) -> DataFrame:
    """dets with cluster: the smallest det_id of its component within the frame."""
    linked = pairs(dets, rules).groupBy("match_id", "frame").agg(F.collect_list(F.struct("a_id", "b_id")).alias("edges"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for m, f, edges in zip(b["match_id"], b["frame"], b["edges"]):
                parent: dict[int, int] = {}

                def find(i: int) -> int:
                    while parent.setdefault(i, i) != i:
                        parent[i] = parent[parent[i]]
                        i = parent[i]
                    return i

                for e in edges:
                    x, y = find(e["a_id"]), find(e["b_id"])
                    parent[max(x, y)] = min(x, y)
                out += [(m, f, i, find(i)) for i in list(parent)]
            yield pd.DataFrame(out, columns=["match_id", "frame", "det_id", "cluster"])

    named = linked.mapInPandas(solve, "match_id long, frame long, det_id long, cluster long")
    return dets.join(named, ["match_id", "frame", "det_id"], "left").withColumn("cluster", F.coalesce("cluster", "det_id"))


def fused(dets: DataFrame, rules: TrackRules) -> DataFrame:
    """One row a cluster: the mean by confidence (the tallest box where rows of tiles mix), the best confidence, its boxes."""
    near = F.col("tile") < rules.near_tiles
    mixed = F.lit(rules.near_tiles > 0) & F.bool_or(near) & F.bool_or(~near)
    wsum = F.when(F.sum("conf") > 1e-9, F.sum("conf")).otherwise(1.0)
    pos = lambda c: F.when(mixed, F.max_by(c, F.struct("height", -F.col("det_id")))).otherwise(F.sum(F.col(c) * F.col("conf")) / wsum)
    return clusters(dets, rules).groupBy("match_id", "frame", "cluster").agg(
        pos("x").alias("x"), pos("z").alias("z"), F.max("conf").alias("conf"), F.count("*").alias("n"), F.count_distinct("tile").alias("tiles"),
        F.array_sort(F.collect_list(F.struct("det_id", "tile", "conf"))).alias("boxes"),
    )


def suppress(boxes: DataFrame, overlap: float = 0.5, least: float = 0.5) -> DataFrame:
    """Greedy non-maximum suppression in each (match, frame, tile): boxes x1, y1, x2, y2 with conf, the surest first.

    Boxes come sorted, so a task passes over its frames once and holds what it has kept of one tile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, []
        for b in batches:
            mask = []
            for m, f, t, x1, y1, x2, y2 in zip(*(b.column(c).to_pylist() for c in ("match_id", "frame", "tile", "x1", "y1", "x2", "y2"))):
                if (m, f, t) != key:
                    key, kept = (m, f, t), []
                area, free = max(0.0, x2 - x1) * max(0.0, y2 - y1), True
                for k1, l1, k2, l2, other in kept:
                    common = max(0.0, min(x2, k2) - max(x1, k1)) * max(0.0, min(y2, l2) - max(y1, l1))
                    if common > overlap * max(area + other - common, 1e-12):
                        free = False
                        break
                if free:
                    kept.append((x1, y1, x2, y2, area))
                mask.append(free)
            yield b.filter(pa.array(mask, pa.bool_()))

    keys = ("match_id", "frame", "tile")
    ordered = boxes.where(F.col("conf") >= least).repartition(*keys).sortWithinPartitions(*keys, F.desc("conf"), "det_id")
    return ordered.mapInArrow(run, boxes.schema)
