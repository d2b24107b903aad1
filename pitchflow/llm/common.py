"""What the operators share: table access, tables in the shared folder, bounded samples."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_own: dict[int, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where unset, a temporary one, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = id(spark.sparkContext)
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="pitchflow-")
        spark.sparkContext.setCheckpointDir(_own[key])
    return _own[key]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


class Stored:
    """A DataFrame written once as Parquet in the shared folder, which cuts its lineage.

    The files outlive lost executors. Shuffle files of the write go with its end, as nothing
    reads them again. `drop` removes the table once nothing reads it any more; what is left
    goes when Python ends. `repeats` tells whether values recur enough for dictionaries.
    """

    def __init__(self, df: DataFrame, repeats: bool = True):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/pitchflow-{uuid.uuid4().hex}"
        _written.append((self.spark, self.path))
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("parquet.enable.dictionary", str(repeats).lower()).parquet(self.path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        if (self.spark, self.path) in _written:
            _remove(self.spark, self.path)
            _written.remove((self.spark, self.path))


def stored(df: DataFrame) -> DataFrame:
    return Stored(df).df


def text_id(name: str) -> Column:
    """A long id as text, for Python workers: pandas would turn it to a double beside a null."""
    return F.col(name).cast("long").cast("string").alias(name)


def exact_ids(df: DataFrame, name: str) -> DataFrame:
    """df with the id that went as text a long again."""
    return df.withColumn(name, F.col(name).cast("long"))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int) -> list[tuple[bytes, int]]:
    """At most `most` labelled rows as (text bytes, label), the same ones on every run.

    The ids come first, by the order of their hash; so the broadcast side has `most`
    rows at the most and documents are read once, without a shuffle.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    rows = (
        docs.select("doc_id", F.col("text").cast("binary").alias("text"))
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id", "label").agg(F.min("text").alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: r.doc_id)
    return [(bytes(r.text or b""), r.label) for r in rows]
