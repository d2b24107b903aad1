"""Calibration of cameras from a table of marks, one camera a group.

A mark is a pixel of the source: a corner with its ground point, or a point on the near or far
sideline. A camera has some tens of marks, whatever the number of cameras.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import fitting
from ..schema import LENS_DRIFT, Field, Lens

MARKS = "camera_id long, kind string, px double, py double, x double, z double"
TERMS = tuple(LENS_DRIFT)
CAMERAS = "camera_id long, marks long, h array<double>, " + ", ".join(f"{k} double" for k in TERMS) + ", corner_rms double, near_rms double, far_rms double, height double, problem string"


def marks_of(pdf: pd.DataFrame) -> fitting.Marks:
    px = lambda kind: pdf.loc[pdf["kind"] == kind, ["px", "py"]].to_numpy(float)
    return fitting.Marks(px("corner"), pdf.loc[pdf["kind"] == "corner", ["x", "z"]].to_numpy(float), px("near"), px("far"))


def calibrate(marks: DataFrame, lens: Lens, fld: Field, free: tuple[str, ...] | None = ("k1", "pitch0_deg", "roll0_deg")) -> DataFrame:
    """CAMERAS: each camera's homography (nine entries of unit norm), lens and residuals in metres.

    `free` are the lens terms fitted together with the homography; None keeps the lens and fits the
    homography alone, by weighted marks. Marks with a null or a kind of their own are left out. A
    camera that cannot be fitted has nulls and says why in `problem`.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {"camera_id": pdf["camera_id"].iloc[0], "marks": len(pdf), "h": None, **dict.fromkeys(TERMS), "corner_rms": None, "near_rms": None, "far_rms": None, "height": None, "problem": None}
        m = marks_of(pdf.sort_values(["kind", "px", "py"], kind="stable"))
        try:
            H, model = (fitting.fit(m, lens, fld), lens) if free is None else fitting.fit_with_lens(m, lens, fld, free)
        except (ValueError, np.linalg.LinAlgError) as error:
            return pd.DataFrame([row | {"problem": str(error)}])
        H = H / np.linalg.norm(H)
        at = lambda px: fitting.to_points(H, fitting.np_direction(px, model))
        row |= {"h": H.ravel().tolist(), **{k: getattr(model, k) for k in TERMS}, "height": fitting.camera_height(H)}
        row["corner_rms"] = float(np.sqrt(np.mean(((at(m.corners) - m.corner_points) ** 2).sum(1))))
        for side, z in (("near", 0.0), ("far", fld.width)):
            if len(getattr(m, side)):
                row[f"{side}_rms"] = fitting.rms(at(getattr(m, side)), z)
        return pd.DataFrame([row])

    known = marks.where("camera_id is not null and px is not null and py is not null and (kind in ('near', 'far') or kind = 'corner' and x is not null and z is not null)")
    # few bytes are much work here: as many parts as the session states
    parts = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return known.repartition(parts, "camera_id").groupBy("camera_id").applyInPandas(solve, CAMERAS)
