"""Whole steps over tables: detections to positions, positions to labels, positions to a camera path."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.geometry import Ground
from .operators import activity as A
from .operators import camera as C
from .operators import densify as D
from .operators import features as P
from .operators import tracker
from .schema import VIEW_PRESETS, CameraRules, Field, TrackRules
from .sources.documents import Project
from .sources.shared import kept


def positions(detections: DataFrame, rules: TrackRules) -> DataFrame:
    """Every frame's positions (match_id, track_id, frame, x, z, conf) of raw detections."""
    return D.emitted(kept(tracker.track(detections, rules), "hits"), rules)


def classified(positions: DataFrame, dt: float, fld: Field = Field()) -> tuple[DataFrame, DataFrame]:
    """(the framing pool, all positions with their labels)"""
    named = kept(P.labels(P.features(positions, dt, fld), field=fld).select("match_id", "track_id", "label"), "labels")
    players = positions.join(named.where("label = 'player'"), ["match_id", "track_id"], "left_semi")
    rows = kept(A.active_runs(A.activity(players, dt, fld), dt), "runs")
    states = kept(A.states(rows), "states")
    return A.framing_pool(positions, states.where("stable")), A.final_labels(positions, named, states)


def camera_path(pool: DataFrame, project: Project, rules: CameraRules) -> DataFrame:
    """The camera path over all frames between a match's first and last of the pool."""
    frames = pool.groupBy("match_id").agg(F.explode(F.sequence(F.min("frame"), F.max("frame"))).alias("frame"))
    return C.camera_path(pool, frames, ground_of(project), rules)


def ground_of(project: Project) -> Ground:
    if not project.homography:
        raise ValueError("the project has no homography: calibrate its camera first")
    return Ground(tuple(map(float, project.homography)), Field(project.field_length_m, project.field_width_m))


def camera_rules(project: Project, view: str = "default", **given: float) -> CameraRules:
    """A named view's margins, the project's settings of d, and what is given."""
    if view not in VIEW_PRESETS:
        raise ValueError(f"no view {view!r}; there are {', '.join(sorted(VIEW_PRESETS))}")
    d = {"d_cap": project.panini_d_cap, "d_safety_deg": project.panini_d_safety_deg, "d_black_deg": project.panini_d_black_tolerance_deg, "d_min": project.panini_d_min_threshold}
    return replace(CameraRules(lens=project.lens, out_w=project.out_w, out_h=project.out_h), **VIEW_PRESETS[view], **d, **{k: v for k, v in given.items() if v is not None})
