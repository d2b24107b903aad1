"""Queries over the job queue and stage timings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query
from ..operators import commands as C
from ..operators import job_log
from ..operators import jobs as J
from .bindings import JOB_EVENTS, JOBS, STAGES, job_events, jobs, rounded, stages

_MODE = "CASE WHEN mode <> 'auto' THEN mode WHEN seconds >= 120 THEN 'pipeline' ELSE 'sequential' END"


@query(
    "stage_plan",
    sql=f"""WITH {JOBS} SELECT job_id, {_MODE} AS mode, array_to_string(list_concat(list_concat(CASE WHEN files > 1 THEN ['concat'] ELSE [] END, CASE WHEN {_MODE} = 'pipeline' THEN ['pipeline'] ELSE ['track','classify','campath','render'] END), list_concat(CASE WHEN interpolate THEN ['interpolate'] ELSE [] END, CASE WHEN audio THEN ['audio_mux'] ELSE [] END)), ',') AS plan, CAST(interpolate OR audio AS INT) AS silent FROM jobs""",
)
def stage_plan(spark, sf_dir):
    m = J.mode(F.col("mode"), F.col("seconds"))
    j = jobs(spark, sf_dir).withColumn("mode", m)
    return j.select("job_id", "mode", F.array_join(J.stage_plan(F.col("files"), F.col("mode"), F.col("interpolate"), F.col("audio")), ",").alias("plan"), J.silent_intermediate(F.col("interpolate"), F.col("audio")).cast("int").alias("silent"))


@query("recovered_jobs", sql=f"WITH {JOBS} SELECT job_id, CASE status WHEN 'running' THEN 'interrupted' ELSE status END AS status FROM jobs")
def recovered_jobs(spark, sf_dir):
    return J.recovered(jobs(spark, sf_dir), stages(spark, sf_dir))[0].select("job_id", "status")


@query("first_open_stage", sql=f"WITH {STAGES} SELECT job_id, min(stage_pos) AS stage_pos, min_by(stage, stage_pos) AS stage FROM stages WHERE status <> 'done' GROUP BY job_id")
def first_open_stage(spark, sf_dir):
    return J.first_open(stages(spark, sf_dir))


@query("step_status", sql=f"WITH {STAGES} SELECT job_id, stage_pos, CASE WHEN status = 'done' THEN 'done' WHEN coalesce(min(CASE WHEN status = 'done' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY stage_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) = 1 THEN 'pending' ELSE 'blocked' END AS step FROM stages")
def step_status(spark, sf_dir):
    return J.step_status(stages(spark, sf_dir)).select("job_id", "stage_pos", "step")


@query("retried_stages", sql=f"WITH {STAGES} SELECT job_id, stage_pos, CASE status WHEN 'failed' THEN 'pending' ELSE status END AS status, CAST(job_id % 3 AS INT) + max(CAST(status = 'failed' AS INT)) OVER (PARTITION BY job_id) AS retry_count FROM stages")
def retried_stages(spark, sf_dir):
    return J.retried(stages(spark, sf_dir).withColumn("retry_count", (F.col("job_id") % 3).cast("int")))


@query("post_process_order", sql=f"WITH {JOBS} SELECT job_id, CAST(unnest(range(len(s))) AS INT) AS place, unnest(s) AS step FROM (SELECT job_id, list_concat(CASE WHEN audio THEN ['upscale'] ELSE [] END, CASE WHEN interpolate THEN ['interpolate'] ELSE [] END) AS s FROM jobs)")
def post_process_order(spark, sf_dir):
    """The jobs' audio switch stands for enlarging, which the table has no column for."""
    return jobs(spark, sf_dir).select("job_id", F.posexplode(J.post_process(F.col("audio"), F.col("interpolate"))).alias("place", "step"))


@query("next_job", sql=f"WITH {JOBS} SELECT owner, min_by(job_id, queue_pos) AS job_id FROM jobs WHERE status IN ('pending', 'interrupted') GROUP BY owner")
def next_job(spark, sf_dir):
    return J.next_job(jobs(spark, sf_dir))


@query("queue_reorder", sql=f"WITH {JOBS}, n AS (SELECT *, row_number() OVER w AS n, files = 2 AND row_number() OVER w % 3 = 2 AS up FROM jobs WINDOW w AS (PARTITION BY owner ORDER BY queue_pos)), m AS (SELECT *, coalesce(lead(up) OVER (PARTITION BY owner ORDER BY queue_pos), false) AS nx FROM n) SELECT job_id, CASE WHEN up AND n > 1 THEN n - 1 WHEN nx THEN n + 1 ELSE n END AS place FROM m")
def queue_reorder(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("owner").orderBy("queue_pos"))
    j = jobs(spark, sf_dir).withColumn("up", (F.col("files") == 2) & (n % 3 == 2))
    return J.swapped(j, F.col("up")).select("job_id", "place")


@query("job_state", sql=f"WITH {JOBS}, {STAGES}, s AS (SELECT job_id, bool_or(status = 'failed') AS f, bool_or(status = 'running') AS r, bool_and(status = 'done') AS d FROM stages GROUP BY job_id) SELECT job_id, CASE WHEN f THEN 'failed' WHEN r THEN 'running' WHEN d THEN 'done' WHEN status = 'done' THEN 'interrupted' ELSE status END AS state FROM jobs LEFT JOIN s USING (job_id)")
def job_state(spark, sf_dir):
    return J.job_state(jobs(spark, sf_dir), stages(spark, sf_dir))


@query("stage_lookup", sql=f"WITH {JOBS}, {STAGES} SELECT job_id, stage_pos, owner FROM stages JOIN jobs USING (job_id) WHERE stage = 'classify'")
def stage_lookup(spark, sf_dir):
    return stages(spark, sf_dir).where("stage = 'classify'").join(jobs(spark, sf_dir), "job_id").select("job_id", "stage_pos", "owner")


@query("job_flags", sql=f"WITH {JOBS} SELECT job_id, concat_ws(' ', CASE WHEN audio THEN '--audio' END, '--files ' || files, CASE WHEN interpolate THEN '--interpolate' END) AS flags FROM jobs")
def job_flags(spark, sf_dir):
    m = F.create_map(F.lit("files"), F.col("files").cast("string"), F.lit("audio"), F.col("audio").cast("string"), F.lit("interpolate"), F.col("interpolate").cast("string"), F.lit("none"), F.lit(None).cast("string"))
    return jobs(spark, sf_dir).select("job_id", J.flags(m).alias("flags"))


@query("job_clock", sql=f"WITH {JOBS} SELECT job_id, printf('%02d:%02d:%02d', CAST(floor(seconds * 37) AS BIGINT) // 3600, CAST(floor(seconds * 37) AS BIGINT) // 60 % 60, CAST(floor(seconds * 37) AS BIGINT) % 60) AS clock, round(seconds * (1 - files / 4.0::DOUBLE) / nullif(files / 4.0::DOUBLE, 0), 6) AS eta_s FROM jobs")
def job_clock(spark, sf_dir):
    return rounded(jobs(spark, sf_dir).select("job_id", J.clock(F.col("seconds") * 37).alias("clock"), J.eta(F.col("seconds"), F.col("files") / 4.0).alias("eta_s")), 6)


@query("stale_jobs", sql="SELECT user_id, epoch_us(max(ts)) // 1000000 AS last_s, CAST(epoch_us(max(ts)) // 1000000 < 1706659200 - 86400 AND max_by(event_type, ts) <> 'purchase' AS INT) AS stale FROM events GROUP BY user_id")
def stale_jobs(spark, sf_dir):
    """The last sign of life of each worker; stale after a while unless it ended."""
    from .bindings import table

    e = table(spark, sf_dir, "events").withColumn("s", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000))
    g = e.groupBy("user_id").agg(F.max("s").alias("last_s"), F.max_by("event_type", "ts").alias("last"))
    return g.select("user_id", "last_s", ((F.col("last_s") < 1706659200 - 86400) & (F.col("last") != "purchase")).cast("int").alias("stale"))


@query("stage_timings", sql=f"WITH {STAGES} SELECT coalesce(stage, 'all') AS stage, coalesce(status, 'all') AS status, count(*) AS n, round(sum(seconds), 3) AS seconds FROM stages GROUP BY ROLLUP (stage, status)")
def stage_timings(spark, sf_dir):
    r = stages(spark, sf_dir).rollup("stage", "status").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))
    return rounded(r.select(F.coalesce("stage", F.lit("all")).alias("stage"), F.coalesce("status", F.lit("all")).alias("status"), "n", "seconds"), 3)


@query("wall_saving", sql=f"WITH {STAGES}, g AS (SELECT job_id, sum(seconds) AS serial, max(seconds) AS wall FROM stages GROUP BY job_id) SELECT job_id, round(serial, 6) AS serial, round(wall, 6) AS wall, round(100 * (1 - wall / serial), 6) AS saving FROM g")
def wall_saving(spark, sf_dir):
    """Stages one after the other against all at once."""
    g = stages(spark, sf_dir).groupBy("job_id").agg(F.sum("seconds").alias("serial"), F.max("seconds").alias("wall"))
    return rounded(g.withColumn("saving", 100 * (1 - F.col("wall") / F.col("serial"))), 6)


@query("timing_percentiles", sql=f"WITH {STAGES} SELECT stage, round(quantile_cont(seconds, 0.5), 6) AS median, round(quantile_cont(seconds, 0.9), 6) AS p90 FROM stages GROUP BY stage")
def timing_percentiles(spark, sf_dir):
    return rounded(stages(spark, sf_dir).groupBy("stage").agg(F.percentile("seconds", F.lit(0.5)).alias("median"), F.percentile("seconds", F.lit(0.9)).alias("p90")), 6)


@query("last_timings", sql=f"WITH {STAGES} SELECT stage, job_id, stage_pos, seconds FROM stages QUALIFY row_number() OVER (PARTITION BY stage ORDER BY job_id DESC, stage_pos DESC) <= 5")
def last_timings(spark, sf_dir):
    """A report: the last five timings of each stage."""
    w = Window.partitionBy("stage").orderBy(F.desc("job_id"), F.desc("stage_pos"))
    return stages(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("stage", "job_id", "stage_pos", "seconds")


_HISTORY = f"""RECURSIVE {JOB_EVENTS}, states AS (SELECT job_id, CAST(0 AS BIGINT) AS seq, '' AS event, 'pending' AS status, CAST(0 AS BIGINT) AS closed, CAST(0 AS BIGINT) AS paused, CAST(0 AS BIGINT) AS retries FROM log WHERE seq = 1
 UNION ALL SELECT l.job_id, l.seq, l.event,
  CASE WHEN l.event = 'start' AND s.status IN ('pending', 'interrupted') AND s.paused = 0 THEN CASE WHEN s.closed < l.stages THEN 'running' ELSE 'done' END
   WHEN s.status = 'running' THEN CASE l.event WHEN 'ok' THEN CASE WHEN s.closed + 1 >= l.stages THEN 'done' WHEN s.paused = 1 THEN 'pending' ELSE 'running' END WHEN 'fail' THEN 'failed' WHEN 'stop' THEN 'interrupted' ELSE 'running' END
   WHEN l.event = 'skip' AND s.closed + 1 = l.stages THEN 'done' WHEN l.event = 'retry' AND s.status IN ('failed', 'interrupted') THEN 'pending' ELSE s.status END,
  s.closed + CASE WHEN l.event = 'ok' AND s.status = 'running' OR l.event = 'skip' AND s.status <> 'running' AND s.closed < l.stages THEN 1 ELSE 0 END,
  CASE l.event WHEN 'pause' THEN 1 WHEN 'resume' THEN 0 ELSE s.paused END,
  s.retries + CASE WHEN l.event = 'retry' AND s.status = 'failed' THEN 1 ELSE 0 END
 FROM states s JOIN log l ON l.job_id = s.job_id AND l.seq = s.seq + 1)"""


@query("job_history", sql=f"WITH {_HISTORY} SELECT * FROM states WHERE seq > 0")
def job_history(spark, sf_dir):
    """The state of each job after each of its events."""
    return job_log.history(job_events(spark, sf_dir))


@query("job_latest", sql=f"WITH {_HISTORY} SELECT job_id, seq, status, closed, paused, retries FROM states QUALIFY seq = max(seq) OVER (PARTITION BY job_id)")
def job_latest(spark, sf_dir):
    return job_log.latest(job_events(spark, sf_dir))


@query(
    "queue_documents",
    sql="""WITH o AS (SELECT o_custkey AS owner, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS queue_pos,
  o_orderkey % 4 = 0 AS old, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'running' ELSE 'pending' END AS was, o_custkey % 3 AS files, o_custkey % 2 = 0 AND o_orderkey % 3 <> 0 AS audio, o_orderkey % 5 = 0 AS interp FROM orders)
SELECT owner, CAST(queue_pos AS INT) AS queue_pos, CAST(k AS VARCHAR) AS job_id, CASE WHEN old AND was <> 'done' THEN 'pending' WHEN was = 'running' THEN 'interrupted' ELSE was END AS status,
  CASE WHEN old THEN concat_ws(',', CASE WHEN files > 1 THEN 'concat' END, 'track,classify,campath,render', CASE WHEN interp THEN 'interpolate' END, CASE WHEN audio THEN 'audio_mux' END) ELSE 'track' END AS stages,
  CASE WHEN old THEN 'pending' WHEN was = 'running' THEN 'failed' ELSE was END AS first_status, CAST(old AS INT) AS migrated, CAST(k % 7 AS VARCHAR) AS later
FROM o WHERE k % 11 <> 0""",
)
def queue_documents(spark, sf_dir):
    """Each customer's orders as one queue document, every fourth job in the older layout and every eleventh broken, read back."""
    from ..sources import layouts
    from .bindings import table

    o = table(spark, sf_dir, "orders")
    was = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'running' ELSE 'pending' END"
    job = f"""CASE WHEN o_orderkey % 11 = 0 THEN '"broken"' ELSE to_json(named_struct('id', string(o_orderkey), 'status', {was}, 'concat_files', array_repeat('f', int(o_custkey % 3)), 'has_audio', o_custkey % 2 = 0,
      'preserve_concat_audio', o_orderkey % 3 <> 0, 'tracking_params', named_struct('interpolate_fps', if(o_orderkey % 5 = 0, 60, 0)), 'later', o_orderkey % 7,
      'stages', array(named_struct('name', if(o_orderkey % 4 = 0, 'pipeline', 'track'), 'status', {was})))) END"""
    docs = o.groupBy(F.col("o_custkey").cast("string").alias("path")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.expr(job).alias("job")))).alias("jobs"))
    docs = docs.select("path", F.concat(F.lit('{"paused": false, "jobs": ['), F.array_join("jobs.job", ","), F.lit("]}")).alias("doc"))
    j = layouts.jobs_of(docs)
    return j.select(
        F.col("path").cast("long").alias("owner"), "queue_pos", "job_id", "status", F.array_join("stages.name", ",").alias("stages"), F.get("stages", F.lit(0))["status"].alias("first_status"),
        F.col("migrated").cast("int").alias("migrated"), F.col("extra")["later"].alias("later"),
    )


@query(
    "stage_commands",
    sql=f"""WITH {JOBS}, {STAGES}, j AS (SELECT job_id, files, audio, interpolate, 'out/' || owner || '/j' || job_id || '.mp4' AS result, 'out/' || owner || '/work/j' || job_id AS work, CASE WHEN files > 1 THEN 'in/' || job_id || '_all.mp4' ELSE 'in/' || job_id || '.mp4' END AS source,
  CASE WHEN files = 2 THEN ' --stride 3' ELSE '' END AS stride, CASE WHEN job_id % 4 = 1 THEN ' --t0 2.5' ELSE '' END || CASE WHEN job_id % 3 = 1 THEN ' --t1 90.0' ELSE '' END AS span, CASE WHEN job_id % 5 = 0 THEN ' --sr' ELSE '' END AS sr FROM jobs),
p AS (SELECT *, CASE WHEN interpolate OR audio THEN work || '/silent.mp4' ELSE result END AS rendered, CASE WHEN audio THEN work || '/silent_interpolated.mp4' ELSE result END AS between_, CASE WHEN interpolate THEN work || '/silent_interpolated.mp4' ELSE work || '/silent.mp4' END AS to_mux FROM j)
SELECT job_id, stage_pos, stage, CASE stage
  WHEN 'concat' THEN 'ffmpeg -y -f concat -safe 0 -i ' || work || '/files.txt -c copy' || CASE WHEN audio THEN '' ELSE ' -an' END || ' in/' || job_id || '_all.mp4'
  WHEN 'track' THEN 'worker track --project p.json --video ' || source || ' --out ' || work || '/tracks.json' || stride || span || ' --gpu --tiles ' || files
  WHEN 'classify' THEN 'worker classify ' || work || '/tracks.json --project p.json --out ' || work || '/players.json'
  WHEN 'campath' THEN 'worker campath ' || work || '/players.json --project p.json --out ' || work || '/campath.json'
  WHEN 'render' THEN 'worker render ' || work || '/campath.json --project p.json --video ' || source || ' --out ' || rendered || sr || span
  WHEN 'interpolate' THEN 'worker interpolate ' || rendered || ' --out ' || between_ || ' --fps 60'
  WHEN 'audio_mux' THEN 'ffmpeg -y -i ' || to_mux || ' -i ' || source || ' -map 0:v -map 1:a -c copy -shortest ' || result END AS command
FROM stages JOIN p USING (job_id)""",
)
def stage_commands(spark, sf_dir):
    """The command of each stage of each job."""
    j = jobs(spark, sf_dir).select(
        "job_id", "files", "audio", "interpolate", F.concat(F.lit("out/"), "owner", F.lit("/j"), "job_id", F.lit(".mp4")).alias("result"), F.concat(F.lit("in/"), "job_id", F.lit("_all.mp4")).alias("joined"),
        F.concat(F.lit("in/"), "job_id", F.lit(".mp4")).alias("video"), F.lit("p.json").alias("project"), (F.col("job_id") % 5 == 0).alias("enlarge"), F.when(F.col("files") == 2, 3).alias("stride"),
        F.when(F.col("job_id") % 4 == 1, 2.5).alias("t0"), F.when(F.col("job_id") % 3 == 1, 90.0).alias("t1"),
        F.create_map(F.lit("tiles"), F.col("files").cast("string"), F.lit("gpu"), F.lit("true"), F.lit("none"), F.lit("false")).alias("flags"), F.create_map(F.lit("fps"), F.lit("60")).alias("interpolate_flags"),
    )
    return C.commands(j, stages(spark, sf_dir)).select("job_id", "stage_pos", "stage", F.array_join("args", " ").alias("command"))
