"""Numbers of rows in an order, over all rows or within groups of any size, without gathering a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressfold.session import durable


def placed(rows: DataFrame, order: Sequence[str], name: str = "part") -> DataFrame:
    """``rows`` range-partitioned and sorted by ``order`` (nulls first), with the number of their range."""
    cols = [F.col(c).asc_nulls_first() for c in order]
    return durable(rows.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn(name, F.spark_partition_id()))


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with the column ``name``: 0, 1, 2, ... by ``order``. One row for each range reaches the driver."""
    cols = [F.col(c).asc_nulls_first() for c in order]
    seq = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = durable(rows.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_part", F.spark_partition_id()).withColumn("_seq", seq))
    starts, total = [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in kept.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts, "_part int, _start long")
    return kept.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_seq")).drop("_part", "_seq", "_start")


def marked_before(ranges: DataFrame, by: str, order: str, mark: str, name: str, small: bool = False) -> DataFrame:
    """``ranges`` (``placed`` by ``by`` and ``order``) with the number of earlier rows of the same ``by`` that have the boolean ``mark``.

    A running sum within each range and group, and the sums of the group's earlier ranges: no window holds more than one range of a group.
    The sums are not sent whole unless ``ranges`` is known to be ``small``.
    """
    n = F.col(mark).cast("long")
    inside = F.sum(n).over(Window.partitionBy("part", by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    sums = ranges.groupBy("part", by).agg(F.sum(n).alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_ahead", F.coalesce(ahead, F.lit(0))).select(F.col("part").alias("_part"), F.col(by).alias("_by"), "_ahead")
    rows = ranges.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    # ranges that were written compress well, and their size on disk would have large sums sent whole
    rows = rows.join(sums if small else sums.hint("merge"), (F.col("part") == F.col("_part")) & F.col(by).eqNullSafe(F.col("_by")))
    return rows.withColumn(name, F.col("_inside") + F.col("_ahead")).drop("_inside", "_ahead", "_part", "_by")
