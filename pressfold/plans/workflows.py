"""Whole workflows over the stored tables: ingest, catch-up, rebuilds.

A store is a dict of DataFrames named as in :mod:`pressfold.schemas`; a workflow returns the changed ones. Models
are providers (see :mod:`pressfold.functions.models`); without one, what they would give stays missing and the queues
find it later.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressfold.functions import html, models
from pressfold.functions import text as tx
from pressfold.functions.models import Provider
from pressfold.operators import ingest, quality, stories, upkeep
from pressfold.operators.rows import numbered
from pressfold.session import durable
from pressfold.sources import payloads
from pressfold.sources.store import Append, Change, DropDays, ReplaceDays, Tables

Store = dict[str, DataFrame]


def store_articles(batch: DataFrame, store: Store, as_of: Column, scraped: DataFrame | None = None, embed: Provider | None = None, ask: Provider | None = None, accept: float = 0.92, band: float = 0.8, days: int = 7) -> Store:
    """Store a batch of articles (id, title, content, url, source_name, published_at, image_url).

    ids ascend with arrival and are above all stored ones. ``scraped`` (url, plain, browser, archive, crawler) holds what
    was fetched. Rows without title or url, of blocked sources or titles, and repeated ones go. The others get an outlet (made and
    rated if new), an embedding, a story of the last ``days`` days or a new one (named by its first article's id; from ``band`` up to ``accept`` the model is asked),
    the topics that their story has so far, a content and a headline for stories of several articles. The content is the scraped one, unless it is bad, nearly that of the outlet's latest
    (stored or earlier in the batch), or of a domain that is blocked (before, or by an earlier row of the batch); see :mod:`pressfold.operators.ingest`.
    Returns outlets, articles, stories, story_topics, article_topics and scrape_blocklist.
    """
    rows = batch.filter(quality.accepted(F.col("title"), F.col("url"), tx.normalize_url(F.col("url"))))
    rows = rows.withColumn("outlet", F.coalesce("source_name", F.lit("Unknown"))).withColumn("ord", F.col("id"))
    rows = durable(payloads.new_articles(rows, store["articles"].select("url", "title", F.col("source").alias("outlet"))))

    known = store["outlets"]
    top = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = rows.groupBy(F.col("outlet").alias("name")).agg(F.min_by("url", "id").alias("url"), F.min("id").alias("_first")).join(known, "name", "left_anti")
    fresh = fresh.select((F.col("_first") + F.lit(top)).alias("id"), "name", "url", F.lit("N/A").alias("description"), models.outlet_bias(F.col("name"), ask).cast("double").alias("bias_score"))
    outlets = durable(known.unionByName(fresh.select(known.columns)))

    rows = rows.withColumn("embedding", models.embedding(F.col("title"), F.col("content"), embed))
    rows = rows.join(outlets.select(F.col("name").alias("outlet"), F.col("id").alias("outlet_id"), "bias_score"), "outlet")
    rows = durable(rows.withColumn("given", html.scraped_content(F.lit(None).cast("string"), F.col("content"))))

    blocked = store["scrape_blocklist"]
    if scraped is None:
        rows, bad = rows.withColumn("final", F.col("given")), None
    else:
        got = upkeep.fetched(scraped.withColumn("url", tx.normalize_url(F.col("url")))).groupBy("url").agg(F.max("found").alias("found"), F.max("reason").alias("bad"))
        pages = durable(rows.select("id", "url", F.col("outlet_id").alias("outlet"), tx.domain(F.col("url")).alias("domain"), "given").join(got, "url", "left"))
        settled = durable(ingest.settle(pages, store["articles"].select("id", F.col("outlet_id").alias("outlet"), "content"), blocked))
        rows = durable(rows.join(settled.select("id", F.col("content").alias("final")), "id"))
        bad = settled.filter("reason IS NOT NULL").join(pages.select("id", "domain"), "id").select("domain", "reason", F.col("id").alias("ord"))

    recent = payloads.recent(store["stories"], "created_at", as_of, days).select(F.col("id").alias("story_id"))
    members = store["articles"].join(recent, "story_id", "left_semi").filter("embedding IS NOT NULL")
    vectors = members.select("id", "embedding").unionByName(rows.select("id", "embedding"))
    known = members.select("id", F.col("story_id").alias("story"))
    if ask is None:
        found = stories.assign_stories(vectors, accept, known=known)
    else:
        new_titles = rows.select("id", tx.clean_title(F.col("title")).alias("title"), F.col("final").alias("content"))
        judge = _judge(rows.select("id", "title", "content"), store["stories"].select("id", "title").unionByName(new_titles.select("id", "title")), store["articles"].select("story_id", "id", "content").unionByName(new_titles.select(F.col("id").alias("story_id"), "id", "content")), ask)
        found = stories.assign_asked(vectors, judge, accept, band, known)
    rows = durable(rows.join(found.select("id", F.col("story").alias("story_id")), "id"))
    made = rows.filter("id = story_id").join(store["stories"].select("id"), "id", "left_anti")
    new_stories = made.select("id", tx.clean_title(F.col("title")).alias("title"), *[F.lit(None).cast("string").alias(c) for c in ("headline", "summary", "deep_report")], F.lit(None).cast("double").alias("headline_score"), as_of.alias("created_at"))

    labels = durable(rows.select("id", F.explode(models.topics(F.col("title"), F.col("content"), ask)).alias("topic")))
    article_topics = upkeep.topics_so_far(rows.select("story_id", "id"), labels, store["story_topics"]).select(F.col("id").alias("article_id"), "topic")
    story_topics = stories.merge_topics(store["story_topics"], rows.join(labels, "id").select("story_id", "topic"))

    new = rows.select(
        "id", "title", F.col("final").alias("content"), F.col("outlet").alias("source"), "url", "outlet_id", "story_id", F.coalesce("published_at", as_of).alias("date"),
        as_of.alias("fetched_at"), "bias_score", "image_url", "embedding", F.lit(None).cast("string").alias("summary"),
    )
    articles = durable(store["articles"].unionByName(new))
    all_stories = upkeep.reset_headlines(store["stories"].unionByName(new_stories), articles)
    touched = articles.join(rows.select("story_id").distinct(), "story_id", "left_semi")
    all_stories = _headlines(all_stories, touched, ask)
    return {
        "outlets": outlets, "articles": articles, "stories": all_stories, "story_topics": story_topics, "article_topics": stories.merge_topics(store["article_topics"], article_topics),
        "scrape_blocklist": blocked if bad is None else _with_blocked(blocked, bad, as_of),
    }


def _judge(asking: DataFrame, titles: DataFrame, contents: DataFrame, ask: Provider) -> Callable[[DataFrame], DataFrame]:
    """Asks whether the articles ``asking`` (id, title, content) belong to stories, by the stories' ``titles`` (id, title) and the first of their ``contents`` (story_id, id, content)."""

    def judge(pairs: DataFrame) -> DataFrame:
        story = pairs.select("id", F.col("story" if "story" in pairs.columns else "into").alias("story_id"))
        first = contents.join(story.select("story_id").distinct(), "story_id", "left_semi").groupBy("story_id").agg(F.min_by("content", "id").alias("story_content"))
        rows = story.join(asking, "id").join(titles.select(F.col("id").alias("story_id"), F.col("title").alias("story_title")), "story_id", "left").join(first, "story_id", "left")
        return rows.filter(models.same_story(F.col("title"), F.col("content"), F.col("story_title"), F.col("story_content"), ask)).select("id")

    return judge


def _headlines(all_stories: DataFrame, articles: DataFrame, ask: Provider | None) -> DataFrame:
    """Headlines for the stories of several ``articles``."""
    context = stories.title_context(articles.join(upkeep.several(articles).withColumnRenamed("id", "story_id"), "story_id", "left_semi"))
    made = context.select(F.col("story_id").alias("id"), models.story_headline(F.col("context"), ask).alias("headline"))
    return upkeep.set_if_produced(all_stories, made, "id", "headline")


def _with_blocked(blocked: DataFrame, found: DataFrame, as_of: Column) -> DataFrame:
    new = found.filter("domain <> ''").groupBy("domain").agg(F.min_by("reason", "ord").alias("reason"), F.min("ord").alias("id")).join(blocked, "domain", "left_anti")
    return blocked.unionByName(new.select("id", "domain", "reason", as_of.alias("added_at"), F.lit(False).alias("is_permanent")))


def rate_outlets(store: Store, ask: Provider | None) -> Store:
    """Ratings for unrated outlets, and for their articles."""
    rated = upkeep.unrated(store["outlets"]).select("id", models.outlet_bias(F.col("name"), ask).cast("double").alias("bias_score")).filter("bias_score IS NOT NULL")
    rated = durable(rated)
    ratings = rated.select(F.col("id").alias("outlet"), F.col("bias_score").alias("rating"))
    a = store["articles"].withColumnsRenamed({"outlet_id": "outlet", "bias_score": "bias"})
    return {"outlets": upkeep.set_if_produced(store["outlets"], rated, "id", "bias_score"), "articles": stories.rerate(a, ratings).withColumnsRenamed({"outlet": "outlet_id", "bias": "bias_score"})}


def summarize(store: Store, ask: Provider | None, most: int | None = 10) -> Store:
    """Summaries for up to ``most`` stories that lack one (None: new ones for all)."""
    queue = store["stories"] if most is None else upkeep.missing_summaries(store["stories"], most)
    context = stories.story_context(store["articles"].join(queue.select(F.col("id").alias("story_id")), "story_id", "left_semi"))
    kinds = store["story_topics"].groupBy("story_id").agg(tx.analysis_type(F.collect_set("topic")).alias("kind"))
    made = context.join(kinds, "story_id", "left").select(F.col("story_id").alias("id"), models.story_summary(F.coalesce("kind", F.lit("default")), F.col("context"), ask).alias("summary"))
    return {"stories": upkeep.set_if_produced(store["stories"], made, "id", "summary")}


def write_reports(store: Store, as_of: Column, ask: Provider | None, most: int = 5) -> Store:
    """Reports for the best ranked stories that lack one."""
    queue = upkeep.missing_reports(store["stories"], store["articles"], as_of, most=most).select(F.col("id").alias("story_id"))
    rows = store["articles"].join(queue, "story_id", "left_semi").select("story_id", "id", F.col("source").alias("outlet"), "title", "content", F.col("bias_score").alias("bias"))
    kinds = store["story_topics"].groupBy("story_id").agg(tx.analysis_type(F.collect_set("topic")).alias("kind"))
    context = stories.report_context(rows).join(kinds, "story_id", "left").withColumn("kind", F.coalesce("kind", F.lit("default")))
    text = F.when(F.col("kind") == "politics", F.col("by_bias")).otherwise(F.col("context"))
    made = context.select(F.col("story_id").alias("id"), models.deep_report(F.col("kind"), text, ask).alias("deep_report"))
    return {"stories": upkeep.set_if_produced(store["stories"], made, "id", "deep_report")}


def embed_missing(store: Store, embed: Provider | None, most: int = 50) -> Store:
    queue = upkeep.missing_embeddings(store["articles"], most)
    made = queue.select("id", models.ask(tx.embedding_text(F.col("title"), F.col("content"), 500, stripped=False), embed, "array<float>").alias("embedding"))
    return {"articles": upkeep.set_if_produced(store["articles"], made, "id", "embedding")}


def audit(store: Store, as_of: Column) -> Store:
    """Clears bad and copied content and blocks its domains."""
    rows = store["articles"].select("id", F.col("outlet_id").alias("outlet"), tx.domain(F.col("url")).alias("domain"), "content")
    cleared = durable(quality.audit(rows))
    found = cleared.join(rows, ["outlet", "id"]).select("domain", F.lit("audit").alias("reason"), F.col("id").alias("ord"))
    return {"articles": upkeep.clear_content(store["articles"], cleared), "scrape_blocklist": _with_blocked(store["scrape_blocklist"], found, as_of)}


def merge_singles(store: Store, as_of: Column, ask: Provider | None = None, accept: float = 0.92, days: int = 7) -> Store:
    """Stories of one article join similar ones of several, among those of the last ``days`` days; what has moved attracts others."""
    recent = payloads.recent(store["stories"], "created_at", as_of, days).select(F.col("id").alias("story_id"))
    articles = durable(store["articles"].join(recent, "story_id", "left_semi"))
    judge = None if ask is None else _judge(articles.select("id", "title", "content"), store["stories"].select("id", "title"), articles.select("story_id", "id", "content"), ask)
    merges = durable(stories.merge_growing(articles.select("story_id", "id", "embedding"), accept, judge=judge))
    moved = store["articles"].join(merges, "story_id", "left").withColumn("story_id", F.coalesce("into", "story_id")).select(store["articles"].columns)
    kept = upkeep.without(store["stories"], merges.select(F.col("story_id").alias("id")), "id")
    grown = moved.join(merges.select(F.col("into").alias("story_id")).distinct(), "story_id", "left_semi")
    return {"articles": moved, "story_topics": stories.apply_merges(store["story_topics"], merges), "stories": _headlines(kept, grown, ask)}


def catch_up(store: Store, as_of: Column, embed: Provider | None = None, ask: Provider | None = None) -> Store:
    """What is run when the models are back: audit, embeddings, headlines, merges, ratings, summaries."""
    store = dict(store)
    store |= audit(store, as_of)
    store |= embed_missing(store, embed)
    store["stories"] = _headlines(store["stories"], store["articles"].join(upkeep.missing_headlines(store["stories"], store["articles"]).select(F.col("id").alias("story_id")), "story_id", "left_semi"), ask)
    store |= merge_singles(store, as_of, ask)
    store |= rate_outlets(store, ask)
    return store | summarize(store, ask)


def fetch(payload_rows: DataFrame, store: Store, as_of: Column, **providers) -> Store:
    """A run over landed payloads (raw_article_payloads): ratings, articles, summaries; payloads past their time go."""
    store = store | rate_outlets(store, providers.get("ask"))
    top = store["articles"].agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    batch = payloads.articles(payload_rows, as_of)
    batch = numbered(batch, ["id", "pos"], "_n").withColumn("id", F.lit(top + 1) + F.col("_n")).drop("_n", "pos")
    store = store | store_articles(batch, store, as_of, **providers)
    store = store | summarize(store, providers.get("ask"))
    return store | {"raw_article_payloads": payloads.retained(store["raw_article_payloads"].unionByName(payload_rows), as_of)}


def commit_fetch(tables: Tables, payload_rows: DataFrame, as_of: datetime.datetime, days: int = 7, keep: int = 30, **providers) -> int:
    """``fetch`` over stored tables, committed as their next version.

    New articles and topics are appended and only the days of recent stories are written anew, so a run writes what it changes; payloads past
    their time go by whole days. Raises Conflict if another run has committed meanwhile: then the run is to be repeated on the new version.
    """
    base = tables.version()
    store, now = tables.read(base), F.lit(as_of).cast("timestamp_ntz")
    top = store["articles"].agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    known = store["article_topics"]
    out = fetch(payload_rows, store, now, **providers)
    rerated = out["articles"].filter(F.col("id") <= top).join(store["articles"].select("id", F.col("bias_score").alias("_old")), "id").filter(~F.col("bias_score").eqNullSafe(F.col("_old"))).take(1)
    since = (as_of - datetime.timedelta(days=days)).date().isoformat()
    recent = out["stories"].filter(F.date_format("created_at", "yyyy-MM-dd") >= since)
    old_changed = out["stories"].filter(F.coalesce(F.date_format("created_at", "yyyy-MM-dd") < since, F.lit(True))).exceptAll(store["stories"].filter(F.coalesce(F.date_format("created_at", "yyyy-MM-dd") < since, F.lit(True)))).take(1)
    changes: dict[str, Change] = {
        "outlets": out["outlets"],
        "articles": out["articles"] if rerated else Append(out["articles"].filter(F.col("id") > top)),
        "stories": out["stories"] if old_changed else ReplaceDays(recent),
        "story_topics": out["story_topics"],
        "article_topics": Append(out["article_topics"].join(known, ["article_id", "topic"], "left_anti")),
        "scrape_blocklist": out["scrape_blocklist"],
        "raw_article_payloads": Append(payload_rows),
    }
    version = tables.commit(changes, base)
    limit = (as_of - datetime.timedelta(days=keep)).date().isoformat()
    if any(p["day"] and p["day"] < limit for p in tables.manifest(version)["raw_article_payloads"]):
        version = tables.commit({"raw_article_payloads": DropDays(limit)}, version)
    return version


def regroup(store: Store, as_of: Column, embed: Provider | None = None, ask: Provider | None = None, accept: float = 0.92) -> Store:
    """All embeddings, stories, topics and headlines anew, in the order of ids."""
    a = upkeep.set_if_produced(store["articles"], store["articles"].select("id", models.embedding(F.col("title"), F.col("content"), embed).alias("embedding")), "id", "embedding")
    a = durable(a)
    found = stories.assign_stories(a.select("id", "embedding"), accept)
    a = durable(a.drop("story_id").join(found.select("id", F.col("story").alias("story_id")), "id").select(store["articles"].columns))
    new = a.filter("id = story_id").select("id", "title", *[F.lit(None).cast("string").alias(c) for c in ("headline", "summary", "deep_report")], F.lit(None).cast("double").alias("headline_score"), as_of.alias("created_at"))
    return {"articles": a, "stories": _headlines(new, a, ask), **reclassify(store | {"articles": a}, ask)}


def reclassify(store: Store, ask: Provider | None) -> Store:
    """Topics of all stories and articles anew."""
    labels = durable(store["articles"].select("story_id", "id", F.explode(models.topics(F.col("title"), F.col("content"), ask)).alias("topic")))
    bridge = labels.select("story_id", "topic").distinct()
    return {"story_topics": bridge, "article_topics": stories.retopic(store["articles"], bridge).select(F.col("id").alias("article_id"), "topic")}
