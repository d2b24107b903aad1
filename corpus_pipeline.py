"""The corpus pipeline: quality rules, line dedup, n-gram join, mixing, packing.

Each stage gets the rows its predecessor kept. All but the last return the columns of
documents; n_chars is brought up to date where a stage changes texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchflow.llm import line_dedup, mixing, ngram_join, packing, quality
from pitchflow.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; rows without doc_id cannot be told apart and go too."""
    docs = docs.where(F.col("doc_id").isNotNull())
    kept = quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")), passing=True)
    return kept.select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar lines one stays; documents left without a visible character go."""
    out = line_dedup.dedup(docs).where(F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8 the one with the smallest doc_id stays."""
    first = ngram_join.linked(docs, n=5, percent=80).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their fitted rate says."""
    return mixing.mix(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
