"""Stories: feed pages, aggregator suppression, greedy dedup, online clustering, ranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressfold.functions.text import bias_bucket, strip, strip_html
from pressfold.operators.similar import nearest, plain_blocks
from pressfold.session import durable

AGGREGATORS = ("Yahoo News", "Google News", "MSN", "AOL", "Startups")  # fixed names


def feed(stories: DataFrame, articles: DataFrame, least: int = 1, topics: DataFrame | None = None, topic: str | None = None) -> DataFrame:
    """(story_id, articles, latest) of stories with at least ``least`` articles; with ``topic``, those that have it.

    An unknown topic gives no story.
    """
    found = stories.select("story_id").join(articles, "story_id").groupBy("story_id").agg(F.count(F.lit(1)).alias("articles"), F.max("date").alias("latest"))
    if topic is not None:
        found = found.join(topics.filter(F.col("topic") == topic), "story_id", "left_semi")
    return found.filter(F.col("articles") >= least)


def page(rows: DataFrame, number: int = 1, size: int = 25) -> DataFrame:
    """One page of a feed, latest first; beyond the end it is empty."""
    return rows.orderBy(F.desc_nulls_first("latest"), "story_id").offset((number - 1) * size).limit(size)


def shown_articles(articles: DataFrame, long: int = 500) -> DataFrame:
    """Articles (story_id, outlet_id, outlet, title, date, id, content_length) that a story shows, with the column position.

    Of one outlet's equal titles the latest stays. If a story has an original of more than
    ``long`` characters its aggregators are hidden.
    """
    latest = Window.partitionBy("story_id", "title", "outlet_id").orderBy(F.desc_nulls_last("date"), "id")
    once = articles.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")
    aggregator = F.coalesce(F.expr(" OR ".join(f"contains(outlet, '{a}')" for a in AGGREGATORS)), F.lit(False))
    once = once.withColumn("is_aggregator", aggregator)
    good = F.max(~F.col("is_aggregator") & (F.coalesce("content_length", F.lit(0)) > long)).over(Window.partitionBy("story_id"))
    shown = once.withColumn("_good", good).filter(~F.col("_good") | ~F.col("is_aggregator")).drop("_good")
    order = Window.partitionBy("story_id").orderBy(F.desc_nulls_last("date"), "is_aggregator", "id")
    return shown.withColumn("position", F.row_number().over(order))


def first_wins(rows: DataFrame) -> DataFrame:
    """Rows of ``rows`` (id, u, t, ...) that a scan in order of id keeps: neither u nor t belongs to a row kept before.

    In each round the undecided rows that come first by both keys stay, and all rows that share a key with them are
    decided. Rounds follow the longest chain of alternating keys; no key's rows are gathered anywhere.
    """
    undecided, kept = durable(rows), None
    while True:
        by_u, by_t = (undecided.groupBy(k).agg(F.min("id").alias(f"first_{k}")) for k in ("u", "t"))
        taken = durable(undecided.join(by_u, "u").join(by_t, "t").filter("id = first_u AND id = first_t").select(rows.columns))
        kept = taken if kept is None else kept.unionByName(taken)
        undecided = durable(undecided.join(taken.select("u"), "u", "left_anti").join(taken.select("t"), "t", "left_anti"))
        if not undecided.take(1):
            return kept


def dedup_keys(url: str, title: str, outlet: str) -> list[Column]:
    """The keys u (url) and t (title and outlet) as 96-bit hashes; null equals null."""
    hashed = lambda *c: F.struct(F.xxhash64(*c).alias("x"), F.hash(*c).alias("y"))
    return [hashed(F.col(url)).alias("u"), hashed(F.col(title).isNull(), F.col(title), F.col(outlet)).alias("t")]


def greedy_dedup(rows: DataFrame, surplus: int = 500) -> DataFrame:
    """Ids of ``rows`` (id, url, title, outlet, content_length) that stay.

    In order of id a row is a duplicate if its url, or else its title and outlet, belongs to a kept row. A duplicate that
    is longer than its original by more than ``surplus`` takes its place. Only ids, hashes and lengths are shuffled.
    """
    narrow = durable(rows.select("id", *dedup_keys("url", "title", "outlet"), F.coalesce("content_length", F.lit(0)).cast("long").alias("size")))
    kept = first_wins(narrow)
    original = lambda k: kept.select(k, F.col("id").alias(f"id_{k}"), F.col("size").alias(f"size_{k}"))
    copies = narrow.join(kept.select("id"), "id", "left_anti").alias("c")
    for k in ("u", "t"):
        # a kept row that comes later has not been seen yet
        o = original(k).withColumnRenamed(k, "key")
        copies = copies.join(o, (F.col(k) == F.col("key")) & (F.col(f"id_{k}") < F.col("id")), "left").drop("key")
    first, length = F.coalesce("id_u", "id_t"), F.when(F.col("id_u").isNotNull(), F.col("size_u")).otherwise(F.col("size_t"))
    gone = copies.select(F.when(F.col("size") > length + surplus, first).otherwise(F.col("id")).alias("id"))
    return rows.select("id").join(gone.distinct(), "id", "left_anti")


def assign_stories(
    vectors: DataFrame, accept: float = 0.92, ask: float = 0.8, judge: Callable[[DataFrame], DataFrame] | None = None, known: DataFrame | None = None
) -> DataFrame:
    """(id, story): each vector joins the story of its nearest earlier one if that is similar enough, else begins one.

    A story is named by its first id. Among equally near ones the earliest story counts, so a round takes the
    smallest story of all nearest ones; rounds follow the depth of the forest. ``known`` (id, story) holds the
    members of older stories, which stay where they are. ``judge`` gets the pairs (id, other, cosine) from ``ask`` up to
    ``accept`` and returns those to join; without it none is. Equal vectors go with the first of them, so
    a crowd of copies is compared once; a vector without length begins its own story.
    """
    long = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("id", F.when(long, F.col("embedding")).alias("embedding"))
    first = rows.filter("embedding IS NOT NULL").groupBy("embedding").agg(F.min("id").alias("first"))
    whole = durable(rows.join(first, "embedding", "left").select("id", F.coalesce("first", "id").alias("first"), "embedding"))
    heads = whole.filter("id = first").select("id", "embedding")
    pairs = durable(nearest(heads, heads, accept if judge is None else min(ask, accept), earlier=True))
    near = pairs.filter(F.col("cosine") >= accept).select("id", "other")
    if judge is not None:
        near = near.unionByName(judge(pairs.filter(F.col("cosine") < accept)).select("id", "other"))
    now = heads.select("id", F.col("id").alias("story"))
    if known is not None:
        near = near.join(known.select("id"), "id", "left_anti")
        now = now.join(known.select("id", F.col("story").alias("old")), "id", "left").select("id", F.coalesce("old", "story").alias("story"))
    near, now = durable(near), durable(now)
    while True:
        moved = near.join(now.select(F.col("id").alias("other"), "story"), "other").groupBy("id").agg(F.min("story").alias("to"))
        step = durable(now.join(moved, "id", "left").select("id", F.col("story").alias("old"), F.coalesce("to", "story").alias("story")))
        if not step.filter("old <> story").take(1):
            break
        now = step.select("id", "story")
    out = whole.select("id", "first").join(step.select(F.col("id").alias("first"), "story"), "first", "left").select("id", F.coalesce("story", "id").alias("story"))
    if known is not None:
        out = out.join(known.select("id", F.col("story").alias("old")), "id", "left").select("id", F.coalesce("old", "story").alias("story"))
    return out


def assign_asked(vectors: DataFrame, judge: Callable[[DataFrame], DataFrame], accept: float = 0.92, ask: float = 0.8, known: DataFrame | None = None) -> DataFrame:
    """(id, story): as ``assign_stories``, but where the judge is asked whether a vector belongs to a story, the story is known.

    The judge gets (id, other, cosine, story), one row for each vector whose nearest earlier one is in the band, and returns the rows to
    join. A round settles the vectors whose nearest ones are settled; rounds follow the depth of the forest, and each vector is asked about once.
    """
    long = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("id", F.when(long, F.col("embedding")).alias("embedding"))
    first = rows.filter("embedding IS NOT NULL").groupBy("embedding").agg(F.min("id").alias("first"))
    whole = durable(rows.join(first, "embedding", "left").select("id", F.coalesce("first", "id").alias("first"), "embedding"))
    heads = whole.filter("id = first").select("id", "embedding")
    pairs = nearest(heads, heads, min(ask, accept), earlier=True)
    settled = heads.select("id", F.col("id").alias("story"))
    if known is not None:
        pairs = pairs.join(known.select("id"), "id", "left_anti")
        settled = settled.join(known.select("id", F.col("story").alias("old")), "id", "left").select("id", F.coalesce("old", "story").alias("story"))
    pairs = durable(pairs.join(pairs.groupBy("id").agg(F.count(F.lit(1)).alias("ties")), "id"))
    settled = durable(settled.join(pairs.select("id"), "id", "left_anti"))
    while pairs.take(1):
        ready = pairs.join(settled.select(F.col("id").alias("other"), "story"), "other").groupBy("id", "ties", "cosine").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("story", "other")).alias("to"))
        ready = durable(ready.filter("n = ties").select("id", "to.other", "cosine", "to.story"))
        band = ready.filter(F.col("cosine") < accept)
        joined = ready.filter(F.col("cosine") >= accept).select("id", "story").unionByName(band.join(judge(band).select("id"), "id", "left_semi").select("id", "story"))
        new = ready.select("id").join(joined, "id", "left").select("id", F.coalesce("story", "id").alias("story"))
        settled = durable(settled.unionByName(new))
        pairs = durable(pairs.join(ready.select("id"), "id", "left_anti"))
    out = whole.select("id", "first").join(settled.select(F.col("id").alias("first"), "story"), "first", "left").select("id", F.coalesce("story", "id").alias("story"))
    if known is not None:
        out = out.join(known.select("id", F.col("story").alias("old")), "id", "left").select("id", F.coalesce("old", "story").alias("story"))
    return out


def merge_singles(articles: DataFrame, accept: float = 0.92) -> DataFrame:
    """(story_id, into): stories of one article and the story of several articles (story_id, id, embedding) that each joins.

    One pass: the articles that stories had at the start decide, not those that move in meanwhile. Ties go to the smallest story.
    """
    sized = articles.join(articles.groupBy("story_id").agg(F.count(F.lit(1)).alias("_n")), "story_id")
    singles, others = durable(sized.filter("_n = 1")), durable(sized.filter("_n > 1"))
    pairs = nearest(singles.select("id", "embedding"), others.select("id", "embedding"), accept)
    into = pairs.join(others.select(F.col("id").alias("other"), F.col("story_id").alias("into")), "other").groupBy("id").agg(F.min("into").alias("into"))
    return singles.select("id", "story_id").join(into, "id").select("story_id", "into")


def merge_growing(articles: DataFrame, accept: float = 0.92, ask: float = 0.8, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(story_id, into): as ``merge_singles``, but in the order of story_id, and an article that has moved attracts later ones.

    The story with the most similar member decides (ties: the smallest); from ``ask`` up to ``accept`` the ``judge`` does, who gets (id, other, cosine, into), ids being
    the articles', and returns the rows to merge. Where a single article goes rests on earlier ones only, so repeating the rule until nothing changes gives the result of
    the ordered scan; rounds follow the longest chain of articles that follow each other. Of equal vectors that moved the first attracts.
    """
    least = accept if judge is None else min(ask, accept)
    sized = articles.filter("embedding IS NOT NULL").join(articles.groupBy("story_id").agg(F.count(F.lit(1)).alias("_n")), "story_id")
    singles, others = durable(sized.filter("_n = 1").select("story_id", "id", "embedding")), durable(sized.filter("_n > 1").select("story_id", "id", "embedding"))
    queries = singles.select(F.col("story_id").alias("id"), "embedding")
    blocks = plain_blocks(queries)
    first = nearest(queries, others.select("id", "embedding"), least).join(others.select(F.col("id").alias("other"), F.col("story_id").alias("into")), "other")
    static = durable(first.groupBy("id").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "into", "other")).alias("best")))
    # equal vectors by the first of them
    alike = singles.join(singles.groupBy("embedding").agg(F.min("story_id").alias("group")), "embedding").select("story_id", "id", "group")
    alike = durable(alike)
    now = durable(singles.select("story_id").limit(0).withColumns({"into": F.lit(None).cast("long"), "other": F.lit(None).cast("long")}))
    met, grown = now.select("story_id"), None
    while True:
        heads = now.join(alike, "story_id").groupBy("group").agg(F.min_by(F.struct("story_id", "into", "id"), "story_id").alias("h"))
        heads = durable(heads.select("h.story_id", "h.into", F.col("h.id").alias("article")))
        if met.join(now, "story_id", "left_anti").take(1):  # one that does not move after all may hide others
            met, grown = now.limit(0).select("story_id"), None
        # each one that has moved meets the queries once; where it goes may change from round to round
        new = durable(heads.join(met, "story_id", "left_anti").join(singles.select("story_id", "embedding"), "story_id").select(F.col("story_id").alias("id"), "embedding"))
        if new.take(1):
            pairs = durable(nearest(queries, new, least, earlier=True, blocks=blocks))
            grown = pairs if grown is None else grown.unionByName(pairs)
            met = met.unionByName(new.select(F.col("id").alias("story_id")))
        best = static
        if grown is not None:
            led = grown.join(heads.withColumnRenamed("story_id", "other"), "other")
            best = best.unionByName(led.groupBy("id").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "into", F.col("article").alias("other"))).alias("best")))
        best = best.groupBy("id").agg(F.min("best").alias("best")).select(F.col("id").alias("story_id"), (-F.col("best.less")).alias("cosine"), "best.into", "best.other")
        step = best.filter(F.col("cosine") >= accept).select("story_id", "into", "other")
        if judge is not None:
            asked = best.filter(F.col("cosine") < accept).join(singles.select("story_id", "id"), "story_id")
            step = step.unionByName(asked.join(judge(asked.select("id", "other", "cosine", "into")).select("id"), "id", "left_semi").select("story_id", "into", "other"))
        step = durable(step)
        changed = step.join(now, ["story_id", "into"], "left_anti").take(1) or now.join(step, ["story_id", "into"], "left_anti").take(1)
        now = step
        if not changed:
            return now.select("story_id", "into")


def apply_merges(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """``rows`` (story_id, ...), such as articles or a bridge of topics, with merged stories renamed; equal rows stay once."""
    to = rows.join(merges, "story_id", "left").withColumn("story_id", F.coalesce("into", "story_id")).drop("into")
    return to.select(rows.columns).distinct()


def keyword_candidates(articles: DataFrame, stories: DataFrame, most: int = 5, longer_than: int = 3, hot: int = 1000) -> DataFrame:
    """(id, story_id, overlap, position): the stories (story_id, title) that share most words with an article's title (id, title).

    Words are lower-cased and longer than ``longer_than``; ties go to the smaller story_id. Only words of up to ``hot`` stories are joined, so an article meets
    at most ``hot`` stories a word; hot words are counted on the pairs so found. A story that shares nothing but hot words can only be among the first if it is
    among the first by hot words alone. For that equal sets of hot words count once on both sides, with the ``most`` smallest stories of each. The result is exact.
    """

    def words(rows: DataFrame, key: str) -> DataFrame:
        split = F.array_distinct(F.filter(F.split(F.lower("title"), r"\s+"), lambda w: F.length(w) > longer_than))
        return rows.select(key, F.explode(split).alias("word")).distinct()

    def sets(rows: DataFrame, key: str) -> DataFrame:
        return rows.join(common, "word", "left_semi").groupBy(key).agg(F.sort_array(F.collect_set("word")).alias("set"))

    def firsts(rows: DataFrame, by: str, *order: Column | str) -> DataFrame:
        return rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("position") <= most)

    asked, offered = durable(words(articles, "id")), durable(words(stories, "story_id"))
    common = durable(offered.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("word"))
    pairs = asked.join(offered.join(common, "word", "left_anti"), "word").groupBy("id", "story_id").agg(F.count(F.lit(1)).alias("overlap"))
    if common.take(1):
        mine, theirs = durable(sets(asked, "id")), durable(sets(offered, "story_id"))
        both = F.coalesce(F.size(F.array_intersect("set", "other")), F.lit(0))
        pairs = pairs.join(mine, "id", "left").join(theirs.withColumnRenamed("set", "other"), "story_id", "left").select("id", "story_id", (F.col("overlap") + both).alias("overlap"))
        few = firsts(theirs, "set", "story_id").groupBy(F.col("set").alias("other")).agg(F.collect_list("story_id").alias("stories"))
        met = mine.select("set", F.explode("set").alias("word")).distinct().join(few.select("other", "stories", F.explode("other").alias("word")), "word")
        met = met.groupBy("set", "other", "stories").agg(F.count(F.lit(1)).alias("overlap")).select("set", "overlap", F.explode("stories").alias("story_id"))
        best = firsts(met, "set", F.desc("overlap"), "story_id")
        pairs = pairs.unionByName(mine.join(best, "set").select("id", "story_id", "overlap")).groupBy("id", "story_id").agg(F.max("overlap").alias("overlap"))
    return firsts(pairs, "id", F.desc("overlap"), "story_id").select("id", "story_id", "overlap", "position")


def rank_stories(articles: DataFrame, as_of: Column, half_life_hours: float = 24.0, outlets_weight: float = 0.67, top: int = 20) -> DataFrame:
    """Front page: coverage by outlets and number of articles, halved every ``half_life_hours`` (our own decay)."""
    per = articles.groupBy("story_id").agg(F.countDistinct("outlet_id").alias("outlets"), F.count(F.lit(1)).alias("articles"), F.max("date").alias("latest"))
    hours = (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("latest").cast("timestamp"))) / 3600.0
    score = (F.col("outlets") * outlets_weight + F.col("articles") * (1 - outlets_weight)) * F.pow(F.lit(0.5), hours / half_life_hours)
    return per.withColumn("score", score).orderBy(F.desc("score"), "story_id").limit(top)


def final_ranking(ranked: DataFrame, editorial: DataFrame, run_at: Column, base_weight: float = 0.6) -> DataFrame:
    """History rows of a ranking run: ``ranked`` (story_id, score) with the ``editorial`` scores (story_id, editorial_score).

    The base score is taken relative to the highest; a story without an editorial score counts 0 there (our own choices).
    """
    high = ranked.agg(F.max("score").alias("_high"))
    base = ranked.crossJoin(F.broadcast(high)).select("story_id", (F.col("score") / F.nullif("_high", F.lit(0.0))).alias("base_score"))  # one row
    both = base.join(editorial, "story_id", "left")
    final = F.coalesce("base_score", F.lit(0.0)) * base_weight + F.coalesce("editorial_score", F.lit(0.0)) * (1 - base_weight)
    return both.withColumn("final_score", final).withColumn("run_at", run_at)


def bias_counts(articles: DataFrame, bucket: Column, most: int = 15) -> DataFrame:
    """Articles of each bias bucket among a story's first ``most``."""
    first = articles.withColumn("_n", F.row_number().over(Window.partitionBy("story_id").orderBy("id"))).filter(F.col("_n") <= most)
    return first.groupBy("story_id").agg(*[F.count_if(bucket == b).alias(f"n_{b}") for b in ("left", "center", "right", "unrated")])


def _first(articles: DataFrame, most: int) -> DataFrame:
    return articles.withColumn("_n", F.row_number().over(Window.partitionBy("story_id").orderBy("id"))).filter(F.col("_n") <= most)


def title_context(articles: DataFrame, most: int = 10) -> DataFrame:
    """Each story's first titles as lines with a dash."""
    lines = F.sort_array(F.collect_list(F.struct("id", "title")))
    return _first(articles, most).groupBy("story_id").agg(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x["title"])), "\n").alias("context"))


def story_context(articles: DataFrame, most: int = 10, chars: int = 1500) -> DataFrame:
    """Each story's first titles, numbered, with the beginning of their text: what a summary is written from.

    Texts are cut before the shuffle; an article without text gives its title only.
    """
    cut = articles.select("story_id", "id", F.coalesce("title", F.lit("")).alias("title"), F.when(F.col("content") != "", strip(F.left(strip_html(F.col("content")), F.lit(chars)))).alias("text"))
    entry = F.concat(F.lit("Title: "), F.col("title"), F.coalesce(F.concat(F.lit("\n   Content: "), F.col("text")), F.lit("")))
    numbered = _first(cut, most).select("story_id", "_n", F.concat(F.col("_n").cast("string"), F.lit(". "), entry).alias("entry"))
    entries = F.sort_array(F.collect_list(F.struct("_n", "entry")))
    return numbered.groupBy("story_id").agg(F.array_join(F.transform(entries, lambda x: x["entry"]), "\n\n").alias("context"))


HEADINGS = {"left": "LEFT-LEANING", "center": "CENTER", "right": "RIGHT-LEANING", "unrated": "UNRATED"}  # fixed names


def report_context(articles: DataFrame, most: int = 15, chars: int = 300) -> DataFrame:
    """(story_id, context, by_bias): a story's articles (story_id, id, outlet, title, content, bias) for a report.

    Articles follow the buckets left, center, right, unrated; ``by_bias`` puts a heading over each bucket, as political
    stories have it.
    """
    cut = articles.select("story_id", "id", "outlet", "title", "bias", strip(F.left(strip_html(F.col("content")), F.lit(chars))).alias("text"))
    line = F.concat(F.lit("- "), F.coalesce("outlet", F.lit("")), F.lit(": "), F.coalesce("title", F.lit("")), F.when(F.col("text") != "", F.concat(F.lit("\n  Excerpt: "), F.col("text"))).otherwise(""))
    rows = _first(cut, most).select("story_id", bias_bucket(F.col("bias")).alias("bucket"), F.struct("id", line.alias("line")).alias("r"))
    of = lambda b: F.transform(F.sort_array(F.collect_list(F.when(F.col("bucket") == b, F.col("r")))), lambda x: x["line"])
    lists = rows.groupBy("story_id").agg(*[of(b).alias(b) for b in HEADINGS])
    parts = [F.when(F.size(b) > 0, F.concat(F.lit(f"\n{name} Sources:\n"), F.array_join(b, "\n"))).otherwise("") for b, name in HEADINGS.items()]
    return lists.select("story_id", F.array_join(F.concat(*HEADINGS), "\n").alias("context"), F.concat(*parts).alias("by_bias"))


def rerate(articles: DataFrame, ratings: DataFrame) -> DataFrame:
    """``articles`` (outlet, bias, ...) with the new rating of their outlet where ``ratings`` (outlet, rating) has one."""
    joined = articles.join(ratings.groupBy("outlet").agg(F.max("rating").alias("_rating")), "outlet", "left")
    return joined.withColumn("bias", F.coalesce("_rating", "bias")).select(articles.columns)


def add_missing(dimension: DataFrame, batch: DataFrame) -> DataFrame:
    """``dimension`` (name, url, description) with a row for each new outlet name of ``batch`` (ord, name, url): its first url."""
    new = batch.filter("name IS NOT NULL").groupBy("name").agg(F.min_by("url", "ord").alias("url")).join(dimension, "name", "left_anti")
    return dimension.unionByName(new.withColumn("description", F.lit("N/A")))


def retopic(stories: DataFrame, bridge: DataFrame) -> DataFrame:
    """(article id, topic) pairs: every article gets all topics of its story, each once."""
    return stories.join(bridge, "story_id").select("id", "topic").distinct()


def merge_topics(*bridges: DataFrame) -> DataFrame:
    out: Sequence[DataFrame] = bridges
    first = out[0]
    for b in out[1:]:
        first = first.unionByName(b)
    return first.distinct()
