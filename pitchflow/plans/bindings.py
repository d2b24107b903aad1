"""The driver's tables as positions, detections, clips and jobs; each in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DT = 0.05

_X = "CAST((event_id * 7919) % 10400 AS DOUBLE) / 100.0D - 52.0D"
_Z = "CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS DOUBLE) * 0.45D - 4.0D"
_CONF = "0.2D + CAST((event_id * 104729) % 80 AS DOUBLE) / 100.0D"
_TILE = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"


def _sql(x: str) -> str:
    return x.replace("100.0D", "100.0::DOUBLE").replace("52.0D", "52.0::DOUBLE").replace("0.45D", "0.45::DOUBLE").replace("4.0D", "4.0::DOUBLE").replace("0.2D", "0.2::DOUBLE")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _match():
    """Matches grow in number with the users: 32 in each."""
    return F.floor(F.col("user_id") / 32)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense positions: match_id, track_id, frame, x, z, conf, tile."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        _match().alias("match_id"), F.col("user_id").alias("track_id"), (F.row_number().over(order) - 1).cast("long").alias("frame"),
        F.expr(_X).alias("x"), F.expr(_Z).alias("z"), F.expr(_CONF).alias("conf"), F.expr(_TILE).alias("tile"),
    )


POSITIONS = f"""positions AS (SELECT user_id // 32 AS match_id, user_id AS track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame,
  {_sql(_X)} AS x, {_sql(_Z)} AS z, {_sql(_CONF)} AS conf, {_TILE} AS tile FROM events)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw detections by the hour: match_id (a match for each 32 users), track_id, frame, det_id, x, z, conf, tile, height."""
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0) - 1704067200) / 3600).cast("long")
    return table(spark, sf_dir, "events").select(
        _match().alias("match_id"), F.col("user_id").alias("track_id"), hour.alias("frame"), F.col("event_id").alias("det_id"),
        F.expr(_X).alias("x"), F.expr(_Z).alias("z"), F.expr(_CONF).alias("conf"), F.expr(_TILE).alias("tile"), F.col("value").alias("height"),
    )


DETECTIONS = f"""detections AS (SELECT user_id // 32 AS match_id, user_id AS track_id, CAST(floor((epoch_us(ts) / 1000000.0::DOUBLE - 1704067200) / 3600) AS BIGINT) AS frame, event_id AS det_id,
  {_sql(_X)} AS x, {_sql(_Z)} AS z, {_sql(_CONF)} AS conf, {_TILE} AS tile, value AS height FROM events)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hit for each track and frame: the detection with the highest id."""
    best = Window.partitionBy("track_id", "frame").orderBy(F.desc("det_id"))
    return detections(spark, sf_dir).withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


HITS = DETECTIONS + """,
hits AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY track_id, frame ORDER BY det_id DESC) AS rn FROM detections) WHERE rn = 1)"""


def _line():
    """The place of a line in its order: line numbers repeat there."""
    return F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of a project (order): name, probe text, file time, seconds, frame size and rate."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("project"), _line().alias("pos"), F.col("l_partkey").alias("part"),
        F.expr("CASE WHEN l_linenumber % 3 = 1 THEN concat('cam_DST', date_format(l_shipdate, 'yyyyMMdd'), '_', lpad(cast(l_partkey % 24 as string), 2, '0'), '0102_a.MP4') ELSE concat('clip', cast(l_linenumber as string), CASE WHEN l_linenumber % 2 = 0 THEN '.txt' ELSE '.mov' END) END").alias("name"),
        F.expr("concat('Stream #0:0: Video: ', CASE l_returnflag WHEN 'R' THEN 'hevc' ELSE 'h264' END, ' (High), yuv420p', CASE WHEN l_linestatus = 'O' THEN '; Stream #0:1(und): Audio: aac (LC)' ELSE '' END)").alias("probe"),
        F.expr("CASE WHEN l_linenumber % 3 = 2 THEN date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss') END").alias("tag_time"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("file_time"), F.col("l_quantity").alias("seconds"),
        F.expr("CASE WHEN l_returnflag = 'A' THEN 4608 ELSE 3840 END").alias("width"), F.expr("CASE WHEN l_returnflag = 'A' THEN 1728 ELSE 2160 END").alias("height"),
        F.expr("CASE WHEN l_partkey % 5 = 0 THEN 0.0D ELSE 20.0D + (l_suppkey % 3) * 0.001D END").alias("fps"),
    )


CLIPS = """clips AS (SELECT l_orderkey AS project, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_partkey AS part,
  CASE WHEN l_linenumber % 3 = 1 THEN concat('cam_DST', strftime(l_shipdate, '%Y%m%d'), '_', lpad(cast(l_partkey % 24 as varchar), 2, '0'), '0102_a.MP4') ELSE concat('clip', cast(l_linenumber as varchar), CASE WHEN l_linenumber % 2 = 0 THEN '.txt' ELSE '.mov' END) END AS name,
  concat('Stream #0:0: Video: ', CASE l_returnflag WHEN 'R' THEN 'hevc' ELSE 'h264' END, ' (High), yuv420p', CASE WHEN l_linestatus = 'O' THEN '; Stream #0:1(und): Audio: aac (LC)' ELSE '' END) AS probe,
  CASE WHEN l_linenumber % 3 = 2 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS tag_time, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS file_time, l_quantity AS seconds,
  CASE WHEN l_returnflag = 'A' THEN 4608 ELSE 3840 END AS width, CASE WHEN l_returnflag = 'A' THEN 1728 ELSE 2160 END AS height,
  CASE WHEN l_partkey % 5 = 0 THEN 0.0::DOUBLE ELSE 20.0::DOUBLE + (l_suppkey % 3) * 0.001::DOUBLE END AS fps FROM lineitem)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs (orders) in queue order: mode, status and switches."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS job_id", "o_custkey AS owner", "o_orderkey AS queue_pos",
        "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'running' ELSE 'pending' END AS status",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN 'pipeline' WHEN o_orderpriority = '2-HIGH' THEN 'auto' ELSE 'sequential' END AS mode",
        "CAST(o_custkey % 3 AS INT) AS files", "o_custkey % 2 = 0 AS audio", "o_custkey % 5 = 0 AS interpolate", "o_totalprice / 1000.0D AS seconds",
    )


JOBS = """jobs AS (SELECT o_orderkey AS job_id, o_custkey AS owner, o_orderkey AS queue_pos,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'running' ELSE 'pending' END AS status,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'pipeline' WHEN o_orderpriority = '2-HIGH' THEN 'auto' ELSE 'sequential' END AS mode,
  CAST(o_custkey % 3 AS INT) AS files, o_custkey % 2 = 0 AS audio, o_custkey % 5 = 0 AS interpolate, o_totalprice / 1000.0::DOUBLE AS seconds FROM orders)"""


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages (lines) of jobs: position, name, status and seconds taken."""
    return table(spark, sf_dir, "lineitem").withColumn("stage_pos", _line()).selectExpr(
        "l_orderkey AS job_id", "stage_pos", "element_at(array('concat','track','classify','campath','render','interpolate','audio_mux'), l_linenumber) AS stage",
        "CASE WHEN l_linestatus = 'F' THEN 'done' WHEN l_returnflag = 'R' THEN 'failed' WHEN l_suppkey % 4 = 0 THEN 'running' ELSE 'pending' END AS status", "l_quantity AS seconds",
    )


STAGES = """stages AS (SELECT l_orderkey AS job_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS stage_pos, ['concat','track','classify','campath','render','interpolate','audio_mux'][l_linenumber] AS stage,
  CASE WHEN l_linestatus = 'F' THEN 'done' WHEN l_returnflag = 'R' THEN 'failed' WHEN l_suppkey % 4 = 0 THEN 'running' ELSE 'pending' END AS status, l_quantity AS seconds FROM lineitem)"""


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles at a fixed number of decimals, so that engines compare.

    Scaled, rounded to whole numbers and scaled back, as DuckDB does: Spark's own rounding to decimals goes by
    the digits in writing and differs next to halves.
    """
    by = float(10**digits)
    return df.select(*[(F.round(F.col(c) * by) / by).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_EVENT = "CASE event_type WHEN 'click' THEN 'ok' WHEN 'purchase' THEN 'start' WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'pause' ELSE 'resume' END WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'stop' ELSE 'retry' END ELSE CASE WHEN event_id % 4 = 0 THEN 'skip' ELSE 'start' END END"


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of job events: a user is a job of 6 to 25 stages, in the order of its events."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), F.row_number().over(order).cast("long").alias("seq"), F.expr(_EVENT).alias("event"), (6 + F.col("user_id") % 20).alias("stages")
    )


JOB_EVENTS = f"""log AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, {_EVENT} AS event, 6 + user_id % 20 AS stages FROM events)"""
