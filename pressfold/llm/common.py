"""Shared helpers of the training-data operators: shared storage, batches, numbering."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressfold.session import shared_dir

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Upper bounds of one Arrow batch that is handed to Python, in rows and bytes.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    That cuts the lineage, survives lost executors and, unlike ``checkpoint()``,
    keeps file sizes that the optimizer can go by when it picks joins.
    """
    return written(df, name)[0]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``materialize``, with the folder, which :func:`remove` frees."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Free a folder that ``written`` made and nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, whatever the rows' sizes (the defaults allow 10,000 rows of any length)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null for a null id)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % folds


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with the column ``name``: 0, 1, 2, ... in the order of the columns ``order``.

    A range partition sorts the rows over all tasks; the offsets of the partitions
    come from their row counts (one count for each partition), so no task holds
    more than its range. ``df`` should be narrow: it is written once.
    """
    spark = df.sparkSession
    cols = [F.col(c).asc_nulls_first() for c in order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *cols).sortWithinPartitions(*cols)
    placed = placed.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    kept = materialize(placed, "numbered")
    counts = sorted((r["_part"], r["n"]) for r in kept.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "_part int, _start long")  # one row for each partition
    return kept.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_seq")).drop("_part", "_seq", "_start")


def keyed(docs: DataFrame, name: str = "key") -> DataFrame:
    """``docs`` with a long column ``name`` that is unique and ascends with doc_id: doc_id itself where it is unique and never null.

    Otherwise rows are numbered by doc_id (null last) and text, and written once.
    """
    seen = docs.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    if not seen.filter(F.col("_id").isNull() | (F.col("_n") > 1)).take(1):
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    return numbered(docs.withColumn("_last", F.col("doc_id").isNull()), ["_last", "doc_id", "text"], name).drop("_last")
