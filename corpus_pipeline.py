"""Training-corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding.

Each stage works on what its predecessor kept. The first four return the columns of
documents; the last gives each kept row (mixing repeats a document that is
taken more than once) its shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pressfold.llm import decontaminate, ftrl, mixing, neardup, sharding
from pressfold.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled documents, accepts."""
    return ftrl.keep_accepted(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near-duplicates."""
    return neardup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.apply_mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.shard_rows(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot")


STAGES = [("quality", quality), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mix), ("sharding", shards)]

#: The classifier's updates, set similarity links and alignments have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
