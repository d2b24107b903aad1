"""Folders that the driver and all executors share, and tables kept there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[int, str] = {}
_kept: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder's path under spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        key = id(spark.sparkContext)
        base = _own[key] = _own.get(key) or "file://" + tempfile.mkdtemp(prefix="pitchflow-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@atexit.register
def _clean() -> None:
    for spark, path in _kept:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """df written once as Parquet in the shared folder and read from there by all that follows; it goes when Python ends."""
    path = folder(df.sparkSession, name)
    _kept.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, path: str, step: str) -> int:
    """Writes df once, a folder for each value of its whole-number column `step`, so that a file stream takes lower steps first.

    The source goes by the files' times: those of a step are set to the step's rank. Gives the number of files.
    """
    spark = df.sparkSession
    df.repartition(step).write.partitionBy(step).parquet(path)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = fs_path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    steps = sorted((int(s.getPath().getName().split("=")[1]), s.getPath()) for s in fs.listStatus(root) if s.isDirectory())
    began, files = 1_000_000_000_000, 0
    for rank, (_, at) in enumerate(steps):
        for f in fs.listStatus(at):
            fs.setTimes(f.getPath(), began + 1000 * rank, -1)
            files += 1
    return files


def stepped(df: DataFrame, step: str, frames: int) -> DataFrame:
    """df with `step`: which run of so many frames a row is in."""
    return df.withColumn(step, F.floor(F.col("frame") / frames))
