"""Constants, settings and row types shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """X runs along the long side, centred; Z is the depth from the near sideline."""

    length: float = 100.0
    width: float = 37.0


@dataclass(frozen=True)
class Lens:
    src_w: int = 4608
    src_h: int = 1728
    hfov_deg: float = 190.0
    vfov_deg: float = 80.0
    pitch0_deg: float = 0.0
    roll0_deg: float = 0.0
    k1: float = 0.0
    k2: float = 0.0
    cx: float = -1.0
    cy: float = -1.0


@dataclass(frozen=True)
class LabelRules:
    buffer: float = 1.0
    deep: float = 5.0
    deep_run_s: float = 2.0
    side_band: float = 5.0
    side_run_s: float = 7.0
    static_s: float = 6.0
    static_spread: float = 0.5
    far_static_spread: float = 2.0
    commit_move: float = 2.5
    foreign_frac: float = 0.4


@dataclass(frozen=True)
class ActivityRules:
    near: float = -0.5
    far: float = -2.0
    ends: float = 2.0
    band: float = 1.5
    hold_near_s: float = 0.3
    hold_far_s: float = 0.3
    hold_ends_s: float = 10.0
    hold_committed_s: float = 7.0
    committed_window_s: float = 5.0
    committed_deep_s: float = 3.0
    inside_near: float = -1.0
    inside_far: float = -3.0
    inside_ends: float = 2.0
    isolated: float = 8.0
    probation_s: float = 3.0


@dataclass(frozen=True)
class TrackRules:
    fps: float = 20.0
    stride: int = 3
    coast_s: float = 1.0
    min_hits: int = 2
    gate: float = 4.0
    q_accel: float = 3.0
    r_pos: float = 0.8
    lat_tol: float = 0.6
    rad_tol: float = 2.5
    cross_row: float = 2.0
    near_tiles: int = 0
    camera: tuple[float, float] = (0.0, -8.0)
    stationary_spread: float = 0.5
    stationary_s: float = 5.0
    phantom_s: float = 0.0
    phantom_spread: float = 0.5
    phantom_tiles: int = 1

    @property
    def dt(self) -> float:
        return self.stride / self.fps

    @property
    def coast_frames(self) -> int:
        return max(0, round(self.coast_s * self.fps))

    @property
    def max_age(self) -> int:
        per = max(1.0, self.dt * self.fps)
        return max(round(2 * self.coast_s * self.fps / per), round(self.fps / per))


@dataclass(frozen=True)
class CameraRules:
    fps: float = 20.0
    stride: int = 1
    out_w: int = 1920
    out_h: int = 1080
    margin_deg: float = 8.0
    hfov_min: float = 26.0
    hfov_max: float = 110.0
    dropout_frac: float = 0.5
    dropout_hold_s: float = 4.0
    lookahead_s: float = 2.5
    aggregator: str = "median"
    smooth_s: float = 0.9
    yaw_deadzone: float = 1.0
    pitch_deadzone: float = 1.0
    hfov_deadzone: float = 1.5
    soft: bool = True
    d_cap: float = 1.5
    d_safety_deg: float = 2.0
    d_black_deg: float = 0.0
    d_min: float = 0.0
    d_smooth_s: float = 0.4
    d_deadzone: float = 0.02
    lens: Lens = field(default_factory=Lens)

    @property
    def dt(self) -> float:
        return self.stride / self.fps


#: How far a calibration may move each lens term, and the drift that weighs as one metre's residual does.
LENS_BOUNDS = {"k1": (-0.1, 0.3), "k2": (-0.2, 0.2), "pitch0_deg": (-5.0, 5.0), "roll0_deg": (-5.0, 5.0), "hfov_deg": (170.0, 210.0), "vfov_deg": (70.0, 90.0)}
LENS_DRIFT = {"k1": 0.05, "k2": 0.05, "pitch0_deg": 2.0, "roll0_deg": 2.0, "hfov_deg": 5.0, "vfov_deg": 3.0}

#: Named margins and floors of the framing.
VIEW_PRESETS = {"default": {"hfov_min": 26.0, "margin_deg": 8.0}, "wide": {"hfov_min": 26.0, "margin_deg": 15.0}}
#: Named values of the projection's d.
PROJECTION_PRESETS = {"rectilinear": 0.0, "panini": 1.0}

BOX = T.StructType([T.StructField("tile", T.IntegerType()), T.StructField("xyxy", T.ArrayType(T.IntegerType())), T.StructField("conf", T.DoubleType())])
PLAYER = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("X", "Z", "conf")], T.StructField("label", T.StringType()), T.StructField("boxes", T.ArrayType(BOX))])
FRAME = T.StructType([T.StructField("frame", T.LongType()), T.StructField("t", T.DoubleType()), T.StructField("players", T.ArrayType(PLAYER))])
POSITIONS_DOC = T.StructType([
    T.StructField("video", T.StringType()), T.StructField("fps", T.DoubleType()), T.StructField("stride", T.IntegerType()), T.StructField("perception_stride", T.IntegerType()),
    T.StructField("field_length_m", T.DoubleType()), T.StructField("field_width_m", T.DoubleType()), T.StructField("frames", T.ArrayType(FRAME)),
])
POSE = T.StructType([T.StructField("frame", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("yaw", "pitch", "hfov", "vfov", "d")]])
PATH_DOC = T.StructType([
    T.StructField("video", T.StringType()), T.StructField("fps", T.DoubleType()), T.StructField("out_w", T.IntegerType()), T.StructField("out_h", T.IntegerType()), T.StructField("projection", T.StringType()),
    T.StructField("smoother_final_state", T.MapType(T.StringType(), T.DoubleType())), T.StructField("path", T.ArrayType(POSE)),
])
