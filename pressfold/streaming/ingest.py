"""Incremental ingest: each micro-batch goes through the batch functions and is appended once.

``ingest`` compares each batch with the whole store. ``keep_up`` holds the keys of what is stored in keyed state, so that the work of a batch
follows the batch: the stored articles are a second stream, which brings what the batch before has kept into the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pressfold.functions.text import normalize_url
from pressfold.sources.payloads import new_articles

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(stream: DataFrame, store: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], empty: DataFrame) -> StreamingQuery:
    """Append the new articles of ``stream`` to the parquet table ``store`` and stop when all input is taken.

    Late rows of any date are taken: what is stored decides, not a watermark. A batch that runs again writes its own
    folder anew, so rows are never doubled.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(store)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        others = [f"{store}/{n}" for n in names if n.startswith("batch=") and n != f"batch={number}"]
        stored = spark.read.schema(empty.schema).parquet(*others) if others else empty
        path = f"{store}/batch={number}"
        new_articles(prepare(batch), stored).write.mode("overwrite").parquet(path)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Held(StatefulProcessor):
    """For each key (a url, or a title and outlet) whether a stored article has it. Candidates pass; keys that candidates have give a row of their own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "held boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, asked = self.held.exists(), False
        for part in rows:
            if not held and part["kept"].any():
                held = True
                self.held.update((True,))
            asked = asked or not part["kept"].all()
            there = part["row"][part["row"].notna()]
            if len(there):
                yield pd.DataFrame({"k": key[0], "held": False, "row": there})
        if asked and held:
            yield pd.DataFrame({"k": [key[0]], "held": [True], "row": [None]})

    def close(self) -> None:
        pass


def _keys(rows: DataFrame) -> DataFrame:
    """``rows`` (url, title, outlet) with their keys u and t as hashes; null equals null."""
    hashed = lambda kind, *c: F.concat(F.lit(kind), F.sha2(F.to_json(F.struct(*c), {"ignoreNullFields": "false"}), 256))
    return rows.withColumns({"u": hashed("u", normalize_url(F.col("url")).alias("url")), "t": hashed("t", "title", "outlet")})


def keep_up(stream: DataFrame, store: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Append the new articles of ``stream`` to the parquet table ``store`` until all input is taken; returns the stopped query.

    ``prepare`` makes rows (ord, url, title, outlet, ...) of the stream's, one by one. A row is new as in ``new_articles``. Late rows of any date are taken. A batch that runs again
    writes its own folder anew, so rows are never doubled.
    """
    spark: SparkSession = stream.sparkSession
    provider = spark.conf.get(PROVIDER)
    rows = prepare(stream)
    schema, empty = rows.schema, spark.createDataFrame([], rows.schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(store)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    asked = _keys(rows.withColumn("row", F.to_json(F.struct(*schema.names))))
    asked = asked.select(F.explode(F.array(F.struct(F.col("u").alias("k"), "row"), F.struct(F.col("t").alias("k"), F.lit(None).cast("string").alias("row")))).alias("x")).select("x.k", F.lit(False).alias("kept"), "x.row")
    kept = _keys(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(store).select("url", "title", "outlet"))
    kept = kept.select(F.explode(F.array("u", "t")).alias("k"), F.lit(True).alias("kept"), F.lit(None).cast("string").alias("row"))
    judged = asked.unionByName(kept).groupBy("k").transformWithStateInPandas(statefulProcessor=Held(), outputStructType="k string, held boolean, row string", outputMode="Append", timeMode="None")

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            found = batch.filter("row IS NOT NULL").select(F.from_json("row", schema).alias("r")).select("r.*")
            if not found.take(1):
                return
            held = batch.filter("held").select("k")
            fresh = _keys(found).join(held.withColumnRenamed("k", "u"), "u", "left_anti").join(held.withColumnRenamed("k", "t"), "t", "left_anti").drop("u", "t")
            new_articles(fresh, empty).select(schema.names).write.mode("overwrite").parquet(f"{store}/batch={number}")
        finally:
            batch.unpersist()

    spark.conf.set(PROVIDER, ROCKSDB)  # keyed state needs it
    try:
        query = judged.writeStream.foreachBatch(one).outputMode("append").option("checkpointLocation", checkpoint).start()
    finally:
        spark.conf.set(PROVIDER, provider)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query
