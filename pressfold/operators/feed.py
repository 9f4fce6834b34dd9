"""The feed as a table that is kept up: counts and dates of stories follow batches of changes, and pages go on from a key."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feed_state(articles: DataFrame) -> DataFrame:
    """(story_id, articles, latest) of the stories that have ``articles`` (story_id, date, ...)."""
    return articles.filter("story_id IS NOT NULL").groupBy("story_id").agg(F.count(F.lit(1)).alias("articles"), F.max("date").alias("latest"))


def feed_after(state: DataFrame, added: DataFrame, removed: DataFrame, articles: DataFrame) -> DataFrame:
    """``state`` after articles were ``added`` and ``removed`` (story_id, date); a moved one is both. ``articles`` is the table afterwards.

    Counts add up. A story's date follows from what was added, unless its latest article was removed: only such stories are read from ``articles`` again.
    Stories without articles go.
    """
    plus = added.filter("story_id IS NOT NULL").groupBy("story_id").agg(F.count(F.lit(1)).alias("plus"), F.max("date").alias("newest"))
    minus = removed.filter("story_id IS NOT NULL").groupBy("story_id").agg(F.count(F.lit(1)).alias("minus"), F.max("date").alias("lost"))
    delta = plus.join(minus, "story_id", "full")
    both = state.join(delta, "story_id", "full").withColumn("articles", F.coalesce("articles", F.lit(0)) + F.coalesce("plus", F.lit(0)) - F.coalesce("minus", F.lit(0)))
    both = both.withColumn("unsure", F.coalesce(F.col("lost") >= F.greatest("latest", "newest"), F.lit(False)) & (F.col("articles") > 0))
    again = articles.join(both.filter("unsure").select("story_id"), "story_id", "left_semi").groupBy("story_id").agg(F.max("date").alias("seen"))
    now = both.join(again, "story_id", "left").withColumn("latest", F.when(F.col("unsure"), F.col("seen")).otherwise(F.greatest("latest", "newest")))
    return now.filter("articles > 0").select("story_id", "articles", "latest")


def next_page(state: DataFrame, after: tuple[datetime.datetime | None, int] | None = None, least: int = 1, size: int = 25) -> DataFrame:
    """The page of stories with at least ``least`` articles that follows the story ``after`` (latest, story_id), latest first.

    Nothing before the page is sorted or counted, so deep pages cost what the first does.
    """
    rows = state.filter(F.col("articles") >= least)
    if after is not None:
        latest, story = after
        date = F.lit(latest).cast(dict(state.dtypes)["latest"])
        later = F.col("story_id") > story
        rows = rows.filter(F.col("latest").isNotNull() | later) if latest is None else rows.filter((F.col("latest") < date) | ((F.col("latest") == date) & later))
    return rows.orderBy(F.desc_nulls_first("latest"), "story_id").limit(size)
