"""The folder that all executors share, and durable cuts of a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or where that is unset one of our own.

    On a local master that is a temporary folder. On a cluster it lies in the warehouse, if that is no local path.
    """
    set_one = spark.conf.get("spark.checkpoint.dir", None)
    if set_one:
        return set_one.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if spark.sparkContext.master.startswith("local"):
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        else:
            warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            if warehouse.startswith(("file:", "/")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            _own_dirs[app] = f"{warehouse}/_checkpoints/{app}"
    return _own_dirs[app]


def durable(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder: its lineage is cut, and unlike with a checkpoint it is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
