"""Raw API payloads as tables: flattening into articles, retention, image backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressfold.functions.text import blank_to_null, normalize_url
from pressfold.operators.stories import dedup_keys, first_wins

ARTICLES = "articles array<struct<title: string, content: string, description: string, url: string, source: map<string, string>, publishedAt: string, urlToImage: string, image: string>>"


def utc_moment(instant: Column) -> Column:
    """An instant as the time in UTC, without a zone; the session's zone plays no part."""
    seconds = F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1000000).cast("decimal(7,0)")
    return F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def utc_time(stamp: Column) -> Column:
    """The time in UTC of an ISO date or date and time, whatever the session's zone; without a zone of its own it is taken as UTC. Null for anything else."""
    whole = F.when(stamp.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(stamp, F.lit("T00:00:00Z"))).when(stamp.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), stamp).otherwise(F.concat(stamp, F.lit("Z")))
    return utc_moment(F.try_to_timestamp(whole))


def articles(payloads: DataFrame, as_of: Column) -> DataFrame:
    """One row for each article of ``payloads`` (id, source, payload); broken JSON and empty lists give none.

    The outlet is Unknown only where no name is given; an explicit null stays null.
    """
    parsed = payloads.select("id", "source", F.posexplode(F.from_json("payload", ARTICLES)["articles"]).alias("pos", "a"))
    second = F.col("source") == "gnews"
    content = F.when(second, F.coalesce(F.nullif("a.content", F.lit("")), F.nullif("a.description", F.lit("")), F.lit(""))).otherwise(F.coalesce("a.content", F.lit("")))
    return parsed.select(
        "id", "pos", F.col("a.title").alias("title"), content.alias("content"), F.col("a.url").alias("url"),
        F.when(F.coalesce(F.map_contains_key("a.source", "name"), F.lit(False)), F.col("a.source")["name"]).otherwise("Unknown").alias("source_name"),
        F.coalesce(utc_time(F.col("a.publishedAt")), as_of).alias("published_at"),
        F.when(second, F.col("a.image")).otherwise(F.col("a.urlToImage")).alias("image_url"),
    )


def land(found: DataFrame, path: str) -> None:
    """Append raw payloads (source, topic_name, payload, fetched_at) to the table at ``path``, before anything else is done with them."""
    found.write.mode("append").parquet(path)


def recent(rows: DataFrame, column: str, as_of: Column, days: int) -> DataFrame:
    return rows.filter(F.col(column) >= as_of - F.make_dt_interval(F.lit(days)))


def retained(payloads: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Without what was fetched more than ``days`` ago."""
    return payloads.filter(F.col("fetched_at").isNull() | (F.col("fetched_at") >= as_of - F.make_dt_interval(F.lit(days))))


def backfill_images(stored: DataFrame, found: DataFrame) -> DataFrame:
    """``stored`` (url, image_url, ...) with missing images from the first payload article of the same normalised url."""
    first = found.filter(blank_to_null(F.col("image_url")).isNotNull()).groupBy(normalize_url(F.col("url")).alias("_url")).agg(F.min_by("image_url", F.struct("id", "pos")).alias("_image"))
    joined = stored.withColumn("_url", normalize_url(F.col("url"))).join(first, "_url", "left")
    return joined.withColumn("image_url", F.coalesce(blank_to_null(F.col("image_url")), "_image")).drop("_url", "_image")


def new_articles(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``batch`` (ord, url, title, outlet, ...) that are new, with normalised urls.

    A row is left out if ``stored``, or a row of the batch that was taken before it, has its url or its title and outlet.
    """
    keyed = batch.withColumn("url", normalize_url(F.col("url")))
    fresh = keyed.join(stored.select("url").distinct(), "url", "left_anti").join(stored.select("title", "outlet").distinct(), ["title", "outlet"], "left_anti")
    taken = first_wins(fresh.select(F.col("ord").alias("id"), *dedup_keys("url", "title", "outlet")))
    return fresh.join(taken.select(F.col("id").alias("ord")), "ord", "left_semi")
