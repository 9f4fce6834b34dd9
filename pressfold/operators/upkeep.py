"""Upkeep of the stored tables: queues of what is missing, updates, the fetch gate, key-value state.

A queue is ordered by id where the order does not matter otherwise, so that runs agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from pressfold.functions.text import domain
from pressfold.operators.quality import bad_scrape, route


def blank(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) == ""


def parameter(c: Column) -> Column:
    """A form's value without blanks around it; null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def readable(content: Column) -> Column:
    return F.coalesce(F.length(content) > 100, F.lit(False))


def unrated(outlets: DataFrame) -> DataFrame:
    return outlets.filter("bias_score IS NULL")


def missing_embeddings(articles: DataFrame, most: int = 50) -> DataFrame:
    return articles.filter("embedding IS NULL").orderBy("id").limit(most)


def missing_summaries(stories: DataFrame, most: int = 10) -> DataFrame:
    """Stories without a summary, or with their title in its place."""
    return stories.filter(F.col("summary").isNull() | (F.col("summary") == F.col("title"))).orderBy("id").limit(most)


def several(articles: DataFrame) -> DataFrame:
    """(id) of stories with two articles or more."""
    return articles.groupBy(F.col("story_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("id")


def missing_headlines(stories: DataFrame, articles: DataFrame) -> DataFrame:
    return stories.filter(blank("headline")).join(several(articles), "id", "left_semi")


def missing_reports(stories: DataFrame, articles: DataFrame, as_of: Column, days: int = 2, most: int = 5) -> DataFrame:
    """The best ranked recent stories of several articles that have no report."""
    due = stories.filter((F.col("headline_score") > 0) & (F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days))) & blank("deep_report"))
    return due.join(several(articles), "id", "left_semi").orderBy(F.desc("headline_score"), "id").limit(most)


def missing_content(articles: DataFrame, least: int = 500, most: int | None = 20) -> DataFrame:
    """Articles to scrape again; ``most`` None is all of them."""
    short = articles.filter(blank("content") | (F.length("content") < least))
    return short if most is None else short.orderBy("id").limit(most)


def set_if_produced(rows: DataFrame, produced: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with the value of ``column`` that ``produced`` (key, column) has for them; null and empty ones change nothing."""
    new = F.col(column).isNotNull()
    if dict(produced.dtypes)[column] == "string":
        new &= F.col(column) != ""
    new = produced.filter(new).groupBy(F.col(key)).agg(F.max(column).alias("_new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).select(rows.columns)


def reset_headlines(stories: DataFrame, articles: DataFrame) -> DataFrame:
    """Stories of one article show its title."""
    many = several(articles).withColumn("_many", F.lit(True))
    return stories.join(many, "id", "left").withColumn("headline", F.when(F.col("_many"), F.col("headline"))).select(stories.columns)


def clear_content(articles: DataFrame, cleared: DataFrame) -> DataFrame:
    """Without the content of the articles in ``cleared`` (id)."""
    gone = cleared.select("id").distinct().withColumn("_gone", F.lit(True))
    return articles.join(gone, "id", "left").withColumn("content", F.when(F.col("_gone").isNull(), F.col("content"))).select(articles.columns)


def without(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """``rows`` (stories, or a bridge to them) without those whose ``key`` is in ``deleted``."""
    return rows.join(deleted.select(key).distinct(), key, "left_anti")


def first_articles(articles: DataFrame) -> DataFrame:
    """(story_id, id, title, content): each story's first article, which a judge compares others with."""
    first = F.min_by(F.struct("id", "title", "content"), "id").alias("a")
    return articles.groupBy("story_id").agg(first).select("story_id", "a.*")


def editorial_ranks(ranked: DataFrame, editorial_score: Column, most: int = 50) -> DataFrame:
    """(story_id, editorial_score, editorial_rank) of the ``most`` best by score; ``editorial_score`` is an answer of a model, or any column."""
    top = ranked.orderBy(F.desc("score"), "story_id").limit(most).withColumn("editorial_score", editorial_score)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("editorial_score"), "story_id"))  # ``most`` rows
    return top.select("story_id", "editorial_score", place.alias("editorial_rank"))


def blocklist_page(blocked: DataFrame) -> DataFrame:
    return blocked.orderBy(F.desc_nulls_first("is_permanent"), F.desc_nulls_first("added_at"), "domain")


def due(last: Column, as_of: Column, hours: int = 1) -> Column:
    """Whether a run is due: there was none, or it is ``hours`` ago."""
    return last.isNull() | (last <= as_of - F.make_dt_interval(hours=F.lit(hours)))


def came_back(status: DataFrame) -> DataFrame:
    """The rows of ``status`` (at, online) where a service is online again: each starts the work on what is missing."""
    before = F.lag("online").over(Window.partitionBy("service").orderBy("at"))
    return status.withColumn("_before", before).filter(F.col("online") & ~F.coalesce("_before", F.lit(True))).drop("_before")


def put_state(state: DataFrame, new: DataFrame) -> DataFrame:
    """Key-value ``state`` (key, value) after the writes ``new`` (key, value, ord); the last write of a key counts."""
    last = new.groupBy("key").agg(F.max_by("value", "ord").alias("value"))
    return state.join(last, "key", "left_anti").select("key", "value").unionByName(last)


#: Candidates in the order in which each route tries them.
TRIES = {"browser": ("browser", "archive"), "crawler": ("crawler", "plain"), "default": ("plain", "browser", "archive")}


def fetched(pages: DataFrame) -> DataFrame:
    """``pages`` (url, plain, browser, archive, crawler: what each way of fetching found, or null) with found and reason.

    Skipped pages have nothing. Others take the first way of their route that found something; ``reason`` says why it is a bad scrape.
    """
    way = route(F.col("url"))
    first = [F.when(way == r, F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ways])) for r, ways in TRIES.items()]
    return pages.withColumn("found", F.coalesce(*first)).withColumn("reason", bad_scrape(F.col("found")))


def scrape(pages: DataFrame, blocked: DataFrame) -> DataFrame:
    """``pages`` (see ``fetched``) with content and reason.

    Blocked and skipped pages have no content. A bad scrape gives no content and its ``reason``, for which the domain is to be blocked (see ``add_blocked``).
    """
    host = blocked.select(F.col("domain").alias("_host")).distinct().withColumn("_blocked", F.lit(True))
    rows = pages.withColumn("_host", domain(F.col("url"))).join(host, "_host", "left")
    ways = [F.when(F.col("_blocked").isNull(), F.col(c)).alias(c) for c in ("plain", "browser", "archive", "crawler")]
    got = fetched(rows.select("url", *ways, F.struct(*pages.columns).alias("_page")))
    return got.select("_page.*", F.when(F.col("reason").isNull(), F.col("found")).alias("content"), "reason")


def story_details(stories: DataFrame, articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """``stories`` (id, ...) with the list ``articles`` of their articles and outlets (null ones where there is none), newest first."""
    of = outlets.select(F.col("id").alias("outlet_id"), F.col("name").alias("outlet"), F.col("bias_score").alias("outlet_bias"))
    rows = articles.join(of, "outlet_id", "left")
    one = F.struct(F.col("date"), F.col("id"), "title", "outlet", "outlet_bias")
    lists = rows.groupBy("story_id").agg(F.sort_array(F.collect_list(one), asc=False).alias("articles"))
    return stories.join(lists, stories["id"] == lists["story_id"], "left").drop("story_id")


def topics_so_far(articles: DataFrame, labels: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, topic): an article gets the topics that its story had when it came: those of ``known`` (story_id, topic) and of
    ``labels`` (id, topic) of the story's articles (story_id, id) up to its own. Earlier articles gain no later topics.

    Labels that carry the story_id of their article spare a join. A story's topics, with when they came, are one list; an article takes its part of it
    before anything is told apart, so articles and not their topics are shuffled.
    """
    tagged = labels if "story_id" in labels.columns else articles.join(labels, "id")
    since = tagged.groupBy("story_id", "topic").agg(F.min("id").alias("_since"))
    rows = articles.join(since.groupBy("story_id").agg(F.collect_list(F.struct("_since", "topic")).alias("_own")), "story_id", "left")
    came = F.coalesce(F.filter("_own", lambda x: x["_since"] <= F.col("id"))["topic"], F.array())
    if known is not None:
        rows = rows.join(known.groupBy("story_id").agg(F.collect_set(F.struct("topic")).alias("_known")), "story_id", "left")
        came = F.concat(came, F.coalesce(F.col("_known")["topic"], F.array()))
    return rows.select("id", F.array_distinct(came).alias("topics")).repartition("id").select("id", F.explode("topics").alias("topic")).distinct()


def counted(rows: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """``rows`` and the counters (conditions) of the run that writes them."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counters.items()]), seen
