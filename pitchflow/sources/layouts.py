"""Documents whose layout has changed over time, read by what they hold: schema on read with VARIANT.

A document is parsed once to a variant; known keys are taken out of it with their types (a value
of another type counts as absent), the rest is kept as text, so that a document goes out
with what came in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs as J

JOB_KEYS = (
    "id", "name", "concat_files", "project_path", "concat_output_path", "broadcast_output_path", "interp_output_path", "pipeline_args", "interp_args", "tracking_params", "has_audio",
    "preserve_concat_audio", "concat_no_audio_copy", "keep_intermediates", "status", "stages", "current_stage_idx", "retry_count", "error", "added_at",
)


def whole(spark: SparkSession, path: str) -> DataFrame:
    """path and doc (text) of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))


def take(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def extra(v: Column, known: tuple[str, ...]) -> Column:
    """The other keys of an object, their values as JSON text."""
    held = take(v, "$", "map<string,variant>")
    return F.transform_values(F.map_filter(held, lambda k, _: ~k.isin(*known)), lambda _, x: F.to_json(x))


def truthy(v: Column, path: str) -> Column:
    """Whether a value is there and neither false, 0, empty nor null."""
    return F.coalesce(~take(v, path, "string").isin("", "false", "0", "0.0", "[]", "{}"), F.lit(False))


def jobs_of(docs: DataFrame) -> DataFrame:
    """The jobs of queue documents (path, doc), as they go on after a restart.

    Columns: path, queue_pos, job_id, name, status, files, mode, stages (names and statuses in order), retry_count, error,
    migrated, extra. A document that is no JSON has no jobs. A job that is no object, or whose stages
    are not a list of objects, is left out alone; its place in the queue stays. A running job was
    interrupted and its running stage failed. Where a job still has the one stage `pipeline`, its stages are
    planned anew from its files and parameters and it starts over, unless it was done.
    """
    v = docs.select("path", F.try_parse_json("doc").alias("_v"))
    each = v.select("path", F.posexplode(take(F.col("_v"), "$.jobs", "array<variant>")).alias("queue_pos", "j"))
    j = F.col("j")
    stages = take(j, "$.stages", "array<variant>")
    objects = F.forall(stages, lambda s: take(s, "$", "map<string,variant>").isNotNull())
    each = each.where(take(j, "$", "map<string,variant>").isNotNull())
    # a job without stages has none yet
    none = take(j, "$.stages", "variant").isNull()
    each = each.where(none | F.coalesce(objects, F.lit(False)))
    listed = F.transform(F.coalesce(stages, F.array().cast("array<variant>")), lambda s: F.struct(take(s, "$.name", "string").alias("name"), F.coalesce(take(s, "$.status", "string"), F.lit("pending")).alias("status")))
    interpolate = truthy(j, "$.tracking_params.interpolate_fps") | truthy(j, "$.interp_args.fps") | truthy(j, "$.interp_output_path")
    # older documents lack the second key: then audio is kept
    audio = truthy(j, "$.has_audio") & (take(j, "$.preserve_concat_audio", "boolean").isNull() | truthy(j, "$.preserve_concat_audio"))
    rows = each.select(
        "path", "queue_pos", take(j, "$.id", "string").alias("job_id"), take(j, "$.name", "string").alias("name"), F.coalesce(take(j, "$.status", "string"), F.lit("pending")).alias("was"),
        F.coalesce(F.size(take(j, "$.concat_files", "array<variant>")), F.lit(0)).alias("files"), F.coalesce(take(j, "$.tracking_params.mode", "string"), F.lit("sequential")).alias("mode"),
        listed.alias("listed"), F.coalesce(take(j, "$.retry_count", "int"), F.lit(0)).alias("retry_count"), take(j, "$.error", "string").alias("said"),
        interpolate.alias("interpolate"), audio.alias("audio"), extra(j, JOB_KEYS).alias("extra"),
    )
    rows = rows.withColumn("files", F.greatest("files", F.lit(0)))
    old = F.exists("listed", lambda s: s["name"] == "pipeline")
    planned = F.transform(J.stage_plan(F.col("files"), F.col("mode"), F.col("interpolate"), F.col("audio")), lambda n: F.struct(n.alias("name"), F.lit("pending").alias("status")))
    halted = F.transform("listed", lambda s: F.struct(s["name"].alias("name"), F.when((F.col("was") == "running") & (s["status"] == "running"), "failed").otherwise(s["status"]).alias("status")))
    starts_over = old & (F.col("was") != "done")
    return rows.select(
        "path", "queue_pos", "job_id", "name", F.when(starts_over, "pending").when(F.col("was") == "running", "interrupted").otherwise(F.col("was")).alias("status"), "files", "mode",
        F.when(old, planned).otherwise(halted).alias("stages"), "retry_count",
        F.when(starts_over, "stages planned anew").when(F.col("was") == "running", "interrupted").otherwise(F.col("said")).alias("error"), old.alias("migrated"), "extra",
    )


#: The keys of a project document and what stands for a missing one.
PROJECT = {
    "source_video": "", "out_w": 2560, "out_h": 1440, "calib_lines": [], "field_polygon": [], "field_length_m": 100.0, "field_width_m": 37.0, "homography": None, "field_marks": {},
    "projection_blend": 0.6, "panini_d": 0.0, "panini_d_adaptive": True, "panini_d_cap": 1.5, "panini_d_safety_deg": 2.0, "panini_d_black_tolerance_deg": 0.0, "panini_d_min_threshold": 0.0,
    "pano_edge_fill_mode": "blur", "pano_edge_fill_blur_deg": None, "pano_edge_fill_blur_sigma_px": 40.0, "pano_edge_fill_blur_boundary_sigma_px": 8.0, "pano_edge_fill_blur_fade_deg": 2.0,
    "debug_overlay": False, "cam_height_m": None, "corner_weights": None, "auto_balance_marks": True, "near_trust": 3.0, "show_guides": True, "show_fitbox": True, "last_scrub_t": None,
    "show_level_line": True, "show_calib_overlay": True, "level_line_y_frac": 0.0,
}
LENS_KEYS = {"src_w": 4608, "src_h": 1728, "hfov_deg": 190.0, "vfov_deg": 80.0, "pitch0_deg": 0.0, "roll0_deg": 0.0, "k1": 0.0, "k2": 0.0, "cx": -1.0, "cy": -1.0}
_KINDS = {bool: "boolean", int: "int", float: "double", str: "string"}
_NULLABLE = {"homography": "array<double>", "corner_weights": "array<double>", "calib_lines": "array<array<array<double>>>", "field_polygon": "array<array<double>>"}


def projects_of(docs: DataFrame) -> DataFrame:
    """path, the keys of PROJECT and pano (a struct) of project documents (path, doc); field_marks as JSON text, other keys in extra.

    Missing keys, and those with a value of another type, have the default. A document that is no
    object has `problem` and the defaults.
    """
    v = F.col("_v")
    read = docs.select("path", F.try_parse_json("doc").alias("_v"))
    columns = []
    for k, default in PROJECT.items():
        if k == "field_marks":
            columns.append(F.coalesce(F.to_json(take(v, "$.field_marks", "variant")), F.lit("{}")).alias(k))
            continue
        kind = _NULLABLE.get(k) or _KINDS.get(type(default), "double")
        got = take(v, f"$.{k}", kind)
        columns.append((got if default is None else F.coalesce(got, F.lit(default) if default != [] else F.array().cast(kind))).alias(k))
    pano = F.struct(*[F.coalesce(take(v, f"$.pano.{k}", _KINDS[type(d)]), F.lit(d)).alias(k) for k, d in LENS_KEYS.items()])
    bad = take(v, "$", "map<string,variant>").isNull()
    return read.select("path", *columns, pano.alias("pano"), F.when(~bad, extra(v, (*PROJECT, "pano"))).alias("extra"), F.when(bad, "no project document").alias("problem"))
