"""Late correction as a stream: chunks of a kept table replaced by micro-batches, each as often as it comes.

The table is kept by version: batch e writes the chunks that it changes under epoch=e, made of what stood before e,
and then a manifest of them. A reader takes each chunk of a match from the last epoch whose
manifest names it. So a batch that is run again (a restart, a lost executor) makes the same rows again
in its own place, one that died half-way is not seen, and no reader meets a chunk half written.
A chunk that no batch corrected stays where it was first written.

Corrections are those of `operators.chunks.corrected`, over the range of frames that the batch has of
a chunk: its rows replace those of the same tracks, other tracks keep theirs. Rows of a batch without
match or frame have no chunk and are passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import corrected
from ..sources.shared import folder, in_order, stepped

KEY = ["match_id", "chunk"]


class Corrected:
    """A table of positions under `path`, in chunks of so many frames, that late rows correct."""

    def __init__(self, spark: SparkSession, path: str, schema: str, chunk: int = 600):
        self.spark, self.path, self.schema, self.chunk = spark, path, schema, chunk

    def _write(self, rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/data/epoch={epoch}")
        # what was written, not what would be: the manifest comes second and is one small file
        held = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/epoch={epoch}")
        held.select(*KEY).distinct().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/epoch={epoch}")

    def start(self, base: DataFrame) -> Corrected:
        """Writes the table as it is before any correction."""
        self._write(stepped(base, "chunk", self.chunk), -1)
        return self

    def current(self, before: int | None = None) -> DataFrame:
        """The rows as they are now, or were before an epoch."""
        data = self.spark.read.schema(f"{self.schema}, chunk long, epoch long").parquet(f"{self.path}/data")
        named = self.spark.read.schema("match_id long, chunk long, epoch long").parquet(f"{self.path}/manifest")
        if before is not None:
            data, named = data.where(F.col("epoch") < before), named.where(F.col("epoch") < before)
        last = named.groupBy(*KEY).agg(F.max("epoch").alias("epoch"))
        return data.join(last, [*KEY, "epoch"], "left_semi").drop("epoch", "chunk")

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch."""

        def write(batch: DataFrame, epoch: int) -> None:
            late = stepped(batch, "chunk", self.chunk).where("match_id is not null and chunk is not null").persist()
            try:
                base = stepped(self.current(before=epoch), "chunk", self.chunk).join(late.select(*KEY).distinct(), KEY, "left_semi")
                self._write(corrected(base, late.select(*base.columns), by=tuple(KEY)), epoch)
            finally:
                late.unpersist()

        return write


def replayed_corrections(base: DataFrame, late: DataFrame, order: str, chunk: int = 600) -> DataFrame:
    """Plays late rows as a stream, a micro-batch for each value of the whole-number column `order`, onto base; the rows after it."""
    spark = base.sparkSession
    at = folder(spark, "corrected")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema)
    table = Corrected(spark, at, schema, chunk).start(base)
    if not in_order(late.select(*base.columns, order), f"{at}/in", order):
        return table.current()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in").select(*base.columns)
    query = stream.writeStream.foreachBatch(table.sink()).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return table.current()
