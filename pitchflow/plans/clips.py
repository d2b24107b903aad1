"""Queries over clips, and the relational idioms the pipeline uses around them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query
from ..operators import clips as C
from .bindings import CLIPS, clips, rounded, table

_SIG = "codec, width, height, round(fps, 2)"
_PROBED = f"{CLIPS}, probed AS (SELECT *, regexp_extract(probe, 'Video: ([A-Za-z0-9]+)', 1) AS codec, regexp_matches(probe, 'Stream #[^;]*: Audio:') AS audio FROM clips)"


@query(
    "clip_probe",
    sql=f"""WITH {_PROBED} SELECT project, pos, name, codec, CAST(audio AS INT) AS audio, CAST(lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) IN ('mp4','mov','mkv','avi','m4v','mts') AS INT) AS video,
coalesce(CASE WHEN regexp_matches(name, '_DST(\\d{{8}})_(\\d{{6}})_') THEN strftime(strptime(regexp_extract(name, '_DST(\\d{{8}}_\\d{{6}})_', 1), '%Y%m%d_%H%M%S'), '%Y-%m-%d %H:%M:%S') END, tag_time, file_time, '') AS taken,
CASE WHEN fps > 0 THEN round(seconds * 100 / fps, 6) ELSE 0 END AS duration, CASE WHEN greatest(width, height) > 4096 THEN 'hevc' ELSE 'h264' END AS encoder FROM probed""",
)
def clip_probe(spark, sf_dir):
    c = clips(spark, sf_dir)
    return rounded(c.select(
        "project", "pos", "name", C.codec(F.col("probe")).alias("codec"), C.has_audio(F.col("probe")).cast("int").alias("audio"), C.is_video(F.col("name")).cast("int").alias("video"),
        C.taken_at(F.col("name"), F.col("tag_time"), F.col("file_time")).alias("taken"), C.duration(F.col("seconds") * 100, F.col("fps")).alias("duration"), C.encoder(F.col("width"), F.col("height")).alias("encoder"),
    ), 6)


@query("clip_offsets", sql=f"WITH {CLIPS} SELECT project, pos, round(coalesce(sum(seconds) OVER (PARTITION BY project ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS start_s FROM clips")
def clip_offsets(spark, sf_dir):
    return rounded(C.offsets(clips(spark, sf_dir)).select("project", "pos", "start_s"), 6)


@query(
    "clip_consistency",
    sql=f"""WITH {_PROBED}, g AS (SELECT project, count(*) AS n, count(DISTINCT struct_pack(a := codec, b := width, c := height, d := round(fps, 2))) AS signatures, bool_and(audio) AS al, bool_or(audio) AS an, sum(seconds) AS seconds FROM probed GROUP BY project),
h AS (SELECT *, CASE WHEN al THEN 'all_have' WHEN NOT an THEN 'none_have' ELSE 'mixed' END AS audio FROM g)
SELECT project, n, signatures, CASE WHEN signatures = 1 THEN 'consistent' ELSE 'mismatch' END AS state, audio, round(seconds, 6) AS seconds, CASE WHEN n < 2 THEN 'single' WHEN audio = 'mixed' THEN 'blocked' WHEN signatures > 1 THEN 'reencode' ELSE 'copy' END AS how FROM h""",
)
def clip_consistency(spark, sf_dir):
    return rounded(C.consistency(clips(spark, sf_dir)), 6)


@query("clip_signatures", sql=f"WITH {_PROBED} SELECT project, codec, width, height, round(fps, 2) AS fps, count(*) AS n FROM probed GROUP BY project, {_SIG}")
def clip_signatures(spark, sf_dir):
    return C.signature_counts(clips(spark, sf_dir))


@query("clip_trim", sql=f"WITH {CLIPS}, o AS (SELECT *, coalesce(sum(seconds) OVER (PARTITION BY project ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM clips) SELECT project, pos, round(greatest(s, 20), 6) AS from_s, round(least(s + seconds, 60), 6) AS to_s FROM o WHERE s < 60 AND s + seconds > 20")
def clip_trim(spark, sf_dir):
    return rounded(C.trimmed(clips(spark, sf_dir), 20.0, 60.0), 6)


@query("clip_dedup", sql=f"WITH {CLIPS} SELECT project, part, min(pos) AS pos FROM clips GROUP BY project, part")
def clip_dedup(spark, sf_dir):
    """The first clip of each source in a project."""
    return clips(spark, sf_dir).groupBy("project", "part").agg(F.min("pos").alias("pos"))


@query("clip_concat", sql=f"WITH {CLIPS}, u AS (SELECT project, pos, name FROM clips WHERE height = 1728 UNION ALL SELECT project, pos + 100, name FROM clips WHERE height <> 1728) SELECT project, row_number() OVER (PARTITION BY project ORDER BY pos) AS n, name FROM u")
def clip_concat(spark, sf_dir):
    """Ordered union of two groups of clips."""
    c = clips(spark, sf_dir)
    u = c.where("height = 1728").select("project", "pos", "name").unionByName(c.where("height <> 1728").select("project", (F.col("pos") + 100).alias("pos"), "name"))
    return u.select("project", F.row_number().over(Window.partitionBy("project").orderBy("pos")).cast("long").alias("n"), "name")


@query("audio_mux", sql=f"WITH {CLIPS}, v AS (SELECT project, sum(seconds) AS v FROM clips WHERE height = 1728 GROUP BY 1), a AS (SELECT project, sum(seconds) AS a FROM clips WHERE height <> 1728 GROUP BY 1) SELECT project, round(least(v, a), 6) AS seconds FROM v JOIN a USING (project)")
def audio_mux(spark, sf_dir):
    """Picture of one group, sound of the other: as long as the shorter."""
    c = clips(spark, sf_dir)
    v = c.where("height = 1728").groupBy("project").agg(F.sum("seconds").alias("v"))
    a = c.where("height <> 1728").groupBy("project").agg(F.sum("seconds").alias("a"))
    return rounded(v.join(a, "project").select("project", F.least("v", "a").alias("seconds")), 6)


@query("clip_extraction", sql=f"WITH {CLIPS}, o AS (SELECT *, coalesce(sum(seconds) OVER (PARTITION BY project ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM clips), tags(t, d, tag) AS (VALUES (5.0::DOUBLE, 10.0::DOUBLE, 'goal'), (50.0, 5.0, 'catch'), (90.0, 30.0, 'break')) SELECT project, tag, min(pos) AS first_pos, max(pos) AS last_pos FROM o JOIN tags ON s < t + d AND s + seconds > t GROUP BY ALL")
def clip_extraction(spark, sf_dir):
    """Roadmap: the clips that tagged stretches touch. The tags are a fixed handful, so each row opens those that it meets."""
    tags = [(5.0, 10.0, "goal"), (50.0, 5.0, "catch"), (90.0, 30.0, "break")]
    end = F.col("start_s") + F.col("seconds")
    met = F.array_compact(F.array(*[F.when((F.col("start_s") < t + d) & (end > t), F.lit(tag)) for t, d, tag in tags]))
    o = C.offsets(clips(spark, sf_dir)).select("project", "pos", F.explode(met).alias("tag"))
    return o.groupBy("project", "tag").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query("page_urls", sql="SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '/([0-9]+)', 1) AS number, CAST(regexp_matches(html, '<article>') AS INT) AS article FROM pages")
def page_urls(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(u, "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(u, "://([^/?#]+)", 1).alias("host"), F.regexp_extract(u, "/([0-9]+)", 1).alias("number"), F.col("html").rlike("<article>").cast("int").alias("article"))


@query("fps_multiples", sql=f"WITH {CLIPS} SELECT project, pos, CAST(round(60 / nullif(fps, 0)) AS BIGINT) AS factor FROM clips WHERE fps > 0 AND abs(60 / nullif(fps, 0) - round(60 / nullif(fps, 0))) <= 1e-4 AND round(60 / nullif(fps, 0)) >= 2")
def fps_multiples(spark, sf_dir, target: float = 60.0):
    """Clips whose rate the target is a whole multiple of."""
    f = target / F.when(F.col("fps") > 0, F.col("fps"))
    return clips(spark, sf_dir).where((F.abs(f - F.round(f)) <= 1e-4) & (F.round(f) >= 2)).select("project", "pos", F.round(f).cast("long").alias("factor"))
