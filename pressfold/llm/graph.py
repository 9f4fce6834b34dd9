"""Connected components of links by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressfold.llm.common import materialize


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(key, comp) of every key in ``links`` (a, b) or in the earlier ``labels``: the smallest key reachable.

    Each round takes the smallest label among the neighbours, then jumps to the
    label's own label. Rounds follow the logarithm of a chain's length; each is
    written to the shared folder. The aggregates combine in the map tasks and the joins can be
    split where a key has very many links.
    """
    if labels is not None and not links.take(1):
        return labels
    ends = links.select(F.col("a").alias("key")).union(links.select(F.col("b").alias("key"))).distinct()
    now = ends.withColumn("comp", F.col("key"))
    if labels is not None:
        now = ends.join(labels, "key", "full").select("key", F.coalesce("comp", "key").alias("comp"))
    now = materialize(now, "labels")
    both = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).union(now.select("key", "comp").filter("key <> comp")).union(now.select("comp", "key").filter("key <> comp")), "links")
    while True:
        seen = both.join(now.select(F.col("key").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = now.join(seen.withColumnRenamed("a", "key"), "key", "left").select("key", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        step = materialize(step, "labels")
        jump = step.select(F.col("key").alias("comp"), F.col("comp").alias("next"))
        step = step.join(jump, "comp", "left").select("key", "old", F.coalesce("next", "comp").alias("comp"))
        step = materialize(step, "labels")
        now = step.select("key", "comp")
        if not step.filter("old <> comp").take(1):
            return now
