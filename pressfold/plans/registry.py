"""Queries over the test tables, one for each operator or plan, with their SQL.

Stand-ins: orders are stories and lineitem rows their articles (l_suppkey the outlet, l_shipdate the date,
l_partkey the title), s_suppkey % 6 a supplier's bias (0: unrated), o_orderpriority a story's topic, documents articles with
text (source the outlet, the first line the title), conversations model responses, events fetched payloads.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressfold.functions import html, models
from pressfold.functions import text as tx
from pressfold.operators import feed, ingest, quality, stories, upkeep
from pressfold.operators.rows import marked_before, placed
from pressfold.session import shared_dir
from pressfold.sources import feeds, payloads
from pressfold.sources.store import Append, DropDays, ReplaceDays, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _stories(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("story_id"), F.col("o_orderpriority").alias("topic"))


def _articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles with an id that orders them: the natural key of lineitem is not unique."""
    l = _t(spark, d, "lineitem")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.date_format("l_shipdate", "yyyyMMdd"), F.round(F.col("l_extendedprice") * 100).cast("long"))
    return l.select(F.col("l_orderkey").alias("story_id"), key.alias("id"), F.col("l_partkey").alias("title"), F.col("l_suppkey").alias("outlet_id"), F.col("l_shipdate").alias("date"), F.col("l_quantity").alias("quantity"))


ARTICLES_SQL = """SELECT l_orderkey AS story_id, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT, strftime(l_shipdate, '%Y%m%d'), round(l_extendedprice * 100)::BIGINT) AS id,
 l_partkey AS title, l_suppkey AS outlet_id, l_shipdate AS date, l_quantity AS quantity FROM lineitem"""


@query("SELECT o_orderkey AS story_id, count(*) AS articles, max(l_shipdate) AS latest FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(*) > 1 ORDER BY latest DESC NULLS FIRST, story_id LIMIT 25 OFFSET 25")
def feed_page(spark: SparkSession, d: str) -> DataFrame:
    """Second page of stories with several articles."""
    return stories.page(stories.feed(_stories(spark, d), _articles(spark, d), least=2), number=2)


@query("SELECT o_orderkey AS story_id, count(*) AS articles, max(l_shipdate) AS latest FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def feed_topic(spark: SparkSession, d: str) -> DataFrame:
    """All stories of a topic."""
    s = _stories(spark, d)
    return stories.feed(s, _articles(spark, d), topics=s, topic="1-URGENT")


@query("SELECT o_orderkey AS story_id, count(*) AS articles, max(l_shipdate) AS latest FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE false GROUP BY 1")
def feed_unknown_topic(spark: SparkSession, d: str) -> DataFrame:
    s = _stories(spark, d)
    return stories.feed(s, _articles(spark, d), topics=s, topic="no such topic")


@query("SELECT count(*) AS total, ceil(count(*) / 25.0)::BIGINT AS pages FROM (SELECT l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(*) > 1)")
def feed_total(spark: SparkSession, d: str) -> DataFrame:
    return stories.feed(_stories(spark, d), _articles(spark, d), least=2).agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / 25.0).alias("pages"))


@query("SELECT o_orderkey AS story_id, count(l_orderkey) AS articles, count(DISTINCT s_name) AS outlets, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS names FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def story_outlets(spark: SparkSession, d: str) -> DataFrame:
    """Every story with its articles' outlets (outer joins)."""
    a, s = _articles(spark, d), _t(spark, d, "supplier")
    rows = _stories(spark, d).join(a, "story_id", "left").join(s, F.col("outlet_id") == F.col("s_suppkey"), "left")
    return rows.groupBy("story_id").agg(F.count("id").alias("articles"), F.count_distinct("s_name").alias("outlets"), F.nullif(F.array_join(F.sort_array(F.collect_set("s_name")), ","), F.lit("")).alias("names"))


@query(rf"""WITH a AS ({ARTICLES_SQL}),
o AS (SELECT *, CASE WHEN outlet_id % 7 = 0 THEN 'MSN' ELSE 'Outlet ' || outlet_id END AS outlet FROM a),
f AS (SELECT *, row_number() OVER (PARTITION BY story_id, title, outlet_id ORDER BY date DESC NULLS LAST, id) AS n FROM o),
g AS (SELECT *, contains(outlet, 'MSN') AS agg FROM f WHERE n = 1),
h AS (SELECT *, max((NOT agg AND quantity * 20 > 500)::INT) OVER (PARTITION BY story_id) AS good FROM g)
SELECT story_id, id, outlet, row_number() OVER (PARTITION BY story_id ORDER BY date DESC NULLS LAST, agg, id)::INT AS position FROM h WHERE good = 0 OR NOT agg""")
def shown_articles(spark: SparkSession, d: str) -> DataFrame:
    """Deduplicated articles of each story without aggregators where an original is good."""
    a = _articles(spark, d).withColumn("outlet", F.when(F.col("outlet_id") % 7 == 0, "MSN").otherwise(F.concat(F.lit("Outlet "), F.col("outlet_id"))))
    return stories.shown_articles(a.withColumn("content_length", F.col("quantity") * 20)).select("story_id", "id", "outlet", "position")


@query(r"""SELECT page_id, regexp_replace(regexp_extract(url, '^([^?#]*)', 1), ';[^/]*$', '') AS normalized,
regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS domain FROM pages""")
def page_urls(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", tx.normalize_url(F.col("url")).alias("normalized"), tx.domain(F.col("url")).alias("domain"))


CLEAN = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&quot;', '\"'), '&#39;', ''''), '\s+', ' ', 'g'))".replace('\\"', '"')
TAGLESS = r"trim(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, md5({CLEAN.format('html')}) AS stripped, left({TAGLESS.format('html')}, 300) AS snippet FROM pages")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", F.md5(tx.strip_html(F.col("html")).cast("binary")).alias("stripped"), tx.snippet(F.col("html")).alias("snippet"))


_STRONG = " ".join(f"WHEN contains(t, '{s.replace(chr(39), chr(39) * 2)}') THEN 'strong: {s.replace(chr(39), chr(39) * 2)}'" for s in quality.STRONG_SIGNS)
_WEAK = " ".join(f"WHEN length(t) < 300 AND contains(t, '{s}') THEN 'weak: {s} in ' || length(t)" for s in quality.WEAK_SIGNS)


@query(f"SELECT conv_id, turn, CASE WHEN text = '' THEN NULL {_STRONG} {_WEAK} END AS reason FROM (SELECT *, lower({TAGLESS.format('text')}) AS t FROM conversations)")
def bad_scrapes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").select("conv_id", "turn", quality.bad_scrape(F.col("text")).alias("reason"))


@query(r"""WITH p AS (SELECT page_id, length(html) < 1500 AS bad, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS domain FROM pages)
SELECT page_id, domain, bad OR (coalesce(max(bad::INT) OVER (PARTITION BY domain ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AND domain <> '') AS cleared FROM p""")
def domain_suppression(spark: SparkSession, d: str) -> DataFrame:
    """A flagged page clears the later pages of its domain."""
    p = _t(spark, d, "pages").select("page_id", (F.length("html") < 1500).alias("bad"), tx.domain(F.col("url")).alias("domain"))
    return quality.suppress_domains(p, F.col("bad"), [F.col("page_id")]).select("page_id", "domain", "cleared")


@query(r"""WITH p AS (SELECT page_id, length(html) < 1000 AS bad, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS domain FROM pages),
b AS (SELECT domain FROM p WHERE bad AND domain <> '' GROUP BY domain)
SELECT page_id, domain FROM p WHERE domain NOT IN (SELECT domain FROM b)""")
def unblocked_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of domains that are not blocked; domains of very short pages were added to the permanent entries."""
    p = _t(spark, d, "pages").select("page_id", "html", tx.domain(F.col("url")).alias("domain"))
    found = p.filter(F.length("html") < 1000).select("domain", F.lit("short").alias("reason"), F.col("page_id").alias("ord"))
    return p.join(quality.add_blocked(quality.blocklist(spark), found), "domain", "left_anti").select("page_id", "domain")


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


@query(f"""WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages)
SELECT page_id, CASE WHEN {_any('url', quality.SKIPPED)} THEN 'skip' WHEN {_any('url', quality.BROWSER)} THEN 'browser' WHEN {_any('url', quality.CRAWLER)} THEN 'crawler' ELSE 'default' END AS route
FROM p WHERE coalesce(title, '') <> '' AND coalesce(url, '') <> '' AND NOT {_any('url', quality.BLOCKED_SOURCES)} AND NOT {_any('title', quality.BLOCKED_TITLES)}""")
def accepted_pages(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    return p.filter(quality.accepted(F.col("title"), F.col("url"), tx.normalize_url(F.col("url")))).select("page_id", quality.route(F.col("url")).alias("route"))


_AS_OF = "TIMESTAMP '2024-01-25 00:00:00'"


@query("SELECT event_id, ts, (props->>'$.k')::INT AS k FROM events WHERE ts >= TIMESTAMP '2024-01-18 00:00:00'")
def recent_payloads(spark: SparkSession, d: str) -> DataFrame:
    e = payloads.recent(_t(spark, d, "events"), "ts", F.to_timestamp_ntz(F.lit("2024-01-25 00:00:00")), 7)
    return e.select("event_id", "ts", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT event_id, ts FROM events WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-15 00:00:00'")
def retained_payloads(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").withColumn("fetched_at", F.col("ts"))
    return payloads.retained(e, F.to_timestamp_ntz(F.lit("2024-02-14 00:00:00"))).select("event_id", "ts")


@query("""SELECT event_id AS id, 0 AS pos, event_type AS title, user_id::VARCHAR AS content, 'http://x.org/' || user_id AS url, 'Unknown' AS source_name, ts AS published_at, props AS image_url FROM events""")
def payload_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles out of JSON payloads that are made of events."""
    e = _t(spark, d, "events")
    art = F.struct(F.col("event_type").alias("title"), F.col("user_id").cast("string").alias("content"), F.concat(F.lit("http://x.org/"), F.col("user_id")).alias("url"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("publishedAt"), F.col("props").alias("urlToImage"))
    p = e.select(F.col("event_id").alias("id"), F.lit("newsapi").alias("source"), F.to_json(F.struct(F.array(art).alias("articles"))).alias("payload"))
    return payloads.articles(p, F.lit(None).cast("timestamp_ntz"))


@query("""WITH s AS (SELECT o_orderkey AS id, 'http://x.org/' || o_custkey AS url FROM orders),
f AS (SELECT 'http://x.org/' || user_id AS url, arg_min(props, event_id) AS image FROM events GROUP BY 1)
SELECT s.id, s.url, f.image AS image_url FROM s LEFT JOIN f USING (url)""")
def image_backfill(spark: SparkSession, d: str) -> DataFrame:
    stored = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("http://x.org/"), F.col("o_custkey")).alias("url"), F.lit(None).cast("string").alias("image_url"))
    found = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.lit(0).alias("pos"), F.concat(F.lit("http://x.org/"), F.col("user_id"), F.lit("?q")).alias("url"), F.col("props").alias("image_url"))
    return payloads.backfill_images(stored, found)


@query(f"""WITH a AS ({ARTICLES_SQL}), f AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY id) AS n, nullif(outlet_id % 6, 0) AS bias FROM a)
SELECT story_id, count(*) FILTER (bias <= 2) AS n_left, count(*) FILTER (bias = 3) AS n_center, count(*) FILTER (bias > 3) AS n_right, count(*) FILTER (bias IS NULL) AS n_unrated FROM f WHERE n <= 15 GROUP BY 1""")
def bias_buckets(spark: SparkSession, d: str) -> DataFrame:
    return stories.bias_counts(_articles(spark, d), tx.bias_bucket(F.nullif(F.col("outlet_id") % 6, F.lit(0))))


@query("SELECT s_suppkey, CASE s_suppkey % 6 WHEN 1 THEN 'Left' WHEN 2 THEN 'Lean Left' WHEN 3 THEN 'Center' WHEN 4 THEN 'Lean Right' WHEN 5 THEN 'Right' ELSE 'Unrated' END AS label FROM supplier")
def bias_labels(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "supplier").select("s_suppkey", tx.bias_label(F.nullif(F.col("s_suppkey") % 6, F.lit(0))).alias("label"))


@query(f"""WITH a AS ({ARTICLES_SQL}), f AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY id) AS n FROM a)
SELECT story_id, string_agg('- ' || title, chr(10) ORDER BY id, title) AS context FROM f WHERE n <= 10 GROUP BY 1""")
def title_contexts(spark: SparkSession, d: str) -> DataFrame:
    return stories.title_context(_articles(spark, d).withColumn("title", F.col("title").cast("string")))


_CUT = lambda sep: rf"WHEN regexp_matches(t, '(?s)^.* {sep} ') AND len(string_split(trim(regexp_replace(regexp_extract(t, '(?s)^.* {sep} (.*)$', 1), '\s+', ' ', 'g')), ' ')) <= 4 THEN regexp_extract(t, '(?s)^(.*) {sep} .*$', 1)"


@query(rf"""SELECT doc_id, CASE WHEN len(w) > 30 THEN array_to_string(w[1:30], ' ') || '...' ELSE trim(t) END AS title FROM
(SELECT doc_id, t, string_split(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ') AS w FROM
(SELECT doc_id, CASE {_CUT("-")} {_CUT("[|]")} {_CUT("—")} ELSE t END AS t FROM (SELECT doc_id, string_split(text, chr(10))[1] AS t FROM documents)))""")
def all_clean_titles(spark: SparkSession, d: str) -> DataFrame:
    """Every title, those with an outlet's suffix and null ones included."""
    return _t(spark, d, "documents").select("doc_id", tx.clean_title(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))


@query("""WITH c AS (SELECT *, row_number() OVER () AS n FROM conversations),
k(i, t) AS (VALUES (1, 'US Politics'), (2, 'Science/Technology'), (3, 'Gaming'), (4, 'Sports'), (5, 'Business/Finance')),
m AS (SELECT n, conv_id, turn, text, i, t, list_position(list_transform(string_split(lower(coalesce(text, '')), chr(10)), lambda line: contains(line, lower(t))), true) AS p FROM c CROSS JOIN k)
SELECT conv_id, turn, CASE WHEN regexp_matches(trim(text), '^[1-5]$') THEN trim(text)::INT END AS bias, coalesce(list(t ORDER BY p, i) FILTER (p > 0), ['Other']) AS topics FROM m GROUP BY n, conv_id, turn, text""")
def all_model_responses(spark: SparkSession, d: str) -> DataFrame:
    """Every response, those that name topics included."""
    return _t(spark, d, "conversations").select("conv_id", "turn", tx.bias_score(F.col("text")).alias("bias"), tx.topic_labels(F.col("text")).alias("topics"))


_TITLES = rf"""SELECT id, CASE WHEN len(w) > 30 THEN array_to_string(w[1:30], ' ') || '...' ELSE trim(t) END AS title FROM
(SELECT id, t, string_split(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ') AS w FROM (SELECT id, CASE {_CUT("-")} {_CUT("[|]")} {_CUT("—")} ELSE t END AS t FROM titles))"""


@query(f"WITH titles AS (SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)', 1) AS t FROM pages) {_TITLES}")
def clean_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of all pages without their outlets."""
    return _t(spark, d, "pages").select(F.col("page_id").alias("id"), tx.clean_title(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("title"))


_NAMED = "(VALUES (1, 'US Politics'), (2, 'Science/Technology'), (3, 'Gaming'), (4, 'Sports'), (5, 'Business/Finance'))"


@query(f"""WITH k(i, t) AS {_NAMED}, c AS (SELECT doc_id, lang || chr(10) || (SELECT string_agg(t, ' / ' ORDER BY i) FROM k WHERE doc_id % (i + 1) = 0) AS text FROM documents),
m AS (SELECT doc_id, i, t FROM c CROSS JOIN k WHERE contains(lower(text), lower(t)))
SELECT doc_id, coalesce(list(t ORDER BY i) FILTER (t IS NOT NULL), ['Other']) AS topics FROM documents LEFT JOIN m USING (doc_id) GROUP BY doc_id""")
def model_responses(spark: SparkSession, d: str) -> DataFrame:
    """Topics that made responses name, for all documents: none, one or several in a line."""
    names = [t for t in tx.TOPICS if t != "Other"]
    line = F.array_join(F.array(*[F.when(F.col("doc_id") % (k + 2) == 0, t) for k, t in enumerate(names)]), " / ")
    return _t(spark, d, "documents").select("doc_id", tx.topic_labels(F.concat("lang", F.lit("\n"), line)).alias("topics"))


@query(r"""SELECT conv_id, turn, CASE WHEN h <> '' AND len(string_split(trim(regexp_replace(h, '\s+', ' ', 'g')), ' ')) <= 20 THEN h END AS headline FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '^["'']+|["'']+$', '', 'g'), '^\s+|\s+$', '', 'g') AS h FROM conversations)""")
def headlines(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").select("conv_id", "turn", tx.headline(F.col("text")).alias("headline"))


@query("""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS id, b.vec_id AS other, list_cosine_similarity(a.e, b.e) AS c FROM e a JOIN e b ON b.vec_id < a.vec_id),
n AS (SELECT id, arg_max(other, c) AS other FROM p WHERE c >= 0.35 GROUP BY id),
r AS (SELECT vec_id AS id, vec_id AS story FROM e WHERE vec_id NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, r.story FROM n JOIN r ON n.other = r.id)
SELECT id, story FROM r""")
def story_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Online assignment to stories; the threshold is low because the test vectors are far apart."""
    return stories.assign_stories(_t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 0.35)


@query("""WITH a AS (SELECT l_orderkey AS story_id, count(DISTINCT l_suppkey) AS outlets, count(*) AS articles, max(l_shipdate) AS latest FROM lineitem GROUP BY 1),
s AS (SELECT *, (outlets * 0.67 + articles * (1 - 0.67)) * pow(0.5, (epoch(TIMESTAMP '1999-01-01 00:00:00') - epoch(latest)) / 3600.0 / 24.0) AS score FROM a)
SELECT story_id, outlets, articles, latest, round(score, 9) AS score FROM s ORDER BY s.score DESC, story_id LIMIT 20""")
def front_page(spark: SparkSession, d: str) -> DataFrame:
    return stories.rank_stories(_articles(spark, d), F.to_timestamp_ntz(F.lit("1999-01-01 00:00:00"))).withColumn("score", F.round("score", 9))


@query("SELECT doc_id, source FROM documents WHERE text IS NULL OR text = '' OR length(text) < 500")
def missing_text(spark: SparkSession, d: str) -> DataFrame:
    """Work queue: articles without a full text."""
    return _t(spark, d, "documents").filter((F.coalesce("text", F.lit("")) == "") | (F.length("text") < 500)).select("doc_id", "source")


@query("SELECT DISTINCT l_orderkey AS story_id, l_linenumber AS id, o_orderpriority AS topic FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def article_topics(spark: SparkSession, d: str) -> DataFrame:
    """Articles inherit their story's topics."""
    a = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("story_id"), F.struct(F.col("l_orderkey").alias("s"), F.col("l_linenumber").alias("n")).alias("id"))
    return stories.retopic(a, _stories(spark, d)).select(F.col("id.s").alias("story_id"), F.col("id.n").alias("id"), "topic")


@query(r"""WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id AS id, coalesce(md5(text), '') AS u, coalesce(length(text), 0) AS size,
 concat_ws('|', text IS NULL, string_split(text, chr(10))[1], source IS NULL, source) AS t FROM documents),
scan(n, us, ts, kept) AS (SELECT 0, []::VARCHAR[], []::VARCHAR[], false UNION ALL
 SELECT n, CASE WHEN new THEN list_append(us, u) ELSE us END, CASE WHEN new THEN list_append(ts, t) ELSE ts END, new FROM
 (SELECT r.*, us, ts, NOT (list_contains(us, u) OR list_contains(ts, t)) AS new FROM scan JOIN r ON r.n = scan.n + 1)),
k AS (SELECT r.* FROM r JOIN scan USING (n) WHERE kept),
c AS (SELECT r.id, r.size, coalesce(x.id, y.id) AS first, coalesce(x.size, y.size) AS length FROM r LEFT JOIN k x ON x.u = r.u AND x.id < r.id LEFT JOIN k y ON y.t = r.t AND y.id < r.id WHERE r.id NOT IN (SELECT id FROM k))
SELECT id FROM r WHERE id NOT IN (SELECT CASE WHEN size > length + 500 THEN first ELSE id END FROM c)""")
def greedy_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a greedy pass keeps; the url is stood in for by the text's hash."""
    t = _t(spark, d, "documents")
    return stories.greedy_dedup(t.select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("url"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("source").alias("outlet"), F.length("text").alias("content_length")))


_WALL = "This page of ours is open to members only; become one, and read on from here in full, with all pictures, tables and notes, number "


def _walled(spark: SparkSession, d: str) -> DataFrame:
    """Documents as articles; every third holds the same wall instead of its text."""
    wall = F.concat(F.lit(_WALL), F.col("doc_id").cast("string"))
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("outlet"), F.when(F.col("doc_id") % 3 == 0, wall).otherwise(F.col("text")).alias("content"))


_LATEST = """d AS (SELECT doc_id AS id, source AS outlet, doc_id % 3 = 0 AS wall FROM documents WHERE doc_id % 3 = 0 OR text <> ''),
l AS (SELECT *, row_number() OVER (PARTITION BY outlet ORDER BY id DESC) AS n FROM d)"""


@query(f"""WITH {_LATEST}, x AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.id DESC) AS m, b.wall FROM l a JOIN l b ON a.outlet = b.outlet AND b.n <= 11 AND a.id <> b.id WHERE a.wall)
SELECT id, count(*) AS copies FROM x WHERE m <= 10 AND wall GROUP BY id HAVING count(*) >= 2""")
def outlet_near_copies(spark: SparkSession, d: str) -> DataFrame:
    """Articles that resemble at least two of their outlet's latest."""
    return quality.near_copies(_walled(spark, d))


@query(f"""WITH a AS ({ARTICLES_SQL}), f AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY id) AS n FROM a)
SELECT story_id, string_agg(n || '. Title: ' || title || CASE WHEN quantity > 25 THEN chr(10) || '   Content: q ' || quantity::INT ELSE '' END, chr(10) || chr(10) ORDER BY n) AS context FROM f WHERE n <= 10 GROUP BY 1""")
def story_contexts(spark: SparkSession, d: str) -> DataFrame:
    a = _articles(spark, d).withColumn("title", F.col("title").cast("string"))
    return stories.story_context(a.withColumn("content", F.when(F.col("quantity") > 25, F.concat(F.lit("<p>q  "), F.col("quantity").cast("int"), F.lit("</p>"))).otherwise("")))


_LINE = "'- ' || outlet_id || ': ' || title || CASE WHEN quantity > 25 THEN chr(10) || '  Excerpt: q ' || quantity::INT ELSE '' END"


@query(f"""WITH a AS ({ARTICLES_SQL}), f AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY id) AS n, nullif(outlet_id % 6, 0) AS bias FROM a),
g AS (SELECT *, CASE WHEN bias <= 2 THEN 1 WHEN bias = 3 THEN 2 WHEN bias > 3 THEN 3 ELSE 4 END AS b, {_LINE} AS line FROM f WHERE n <= 15),
h AS (SELECT story_id, b, chr(10) || ['LEFT-LEANING', 'CENTER', 'RIGHT-LEANING', 'UNRATED'][b] || ' Sources:' || chr(10) || string_agg(line, chr(10) ORDER BY n) AS part, string_agg(line, chr(10) ORDER BY n) AS lines FROM g GROUP BY 1, 2)
SELECT story_id, string_agg(lines, chr(10) ORDER BY b) AS context, string_agg(part, '' ORDER BY b) AS by_bias FROM h GROUP BY 1""")
def report_contexts(spark: SparkSession, d: str) -> DataFrame:
    a = _articles(spark, d).withColumn("title", F.col("title").cast("string")).withColumn("outlet", F.col("outlet_id").cast("string")).withColumn("bias", F.nullif(F.col("outlet_id") % 6, F.lit(0)))
    return stories.report_context(a.withColumn("content", F.when(F.col("quantity") > 25, F.concat(F.lit("<p>q  "), F.col("quantity").cast("int"), F.lit("</p>")))))


@query(r"""WITH a AS (SELECT DISTINCT doc_id AS id, unnest(regexp_split_to_array(lower(string_split(text, chr(10))[1]), '\s+')) AS word FROM documents),
s AS (SELECT DISTINCT item_id AS story_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM benchmark),
o AS (SELECT id, story_id, count(*) AS overlap FROM a JOIN s USING (word) WHERE length(word) > 3 GROUP BY 1, 2)
SELECT id, story_id, overlap, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, story_id)::INT AS position FROM o QUALIFY position <= 5""")
def keyword_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Stories that share words with a title: items stand for stories."""
    a = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    return stories.keyword_candidates(a, _t(spark, d, "benchmark").select(F.col("item_id").alias("story_id"), F.col("text").alias("title")))


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 4 = 0 THEN vec_id ELSE label + 1000000000 END AS story_id FROM embeddings),
z AS (SELECT *, count(*) OVER (PARTITION BY story_id) AS n FROM e),
p AS (SELECT s.story_id, m.story_id AS into, list_cosine_similarity(s.e, m.e) AS c FROM z s JOIN z m ON s.n = 1 AND m.n > 1),
b AS (SELECT *, max(c) OVER (PARTITION BY story_id) AS top FROM p WHERE c >= 0.35 AND c > 0)
SELECT story_id, min("into") AS "into" FROM b WHERE c = top GROUP BY 1""".replace("AS into,", 'AS "into",'))
def merged_singles(spark: SparkSession, d: str) -> DataFrame:
    """Stories of one article that join one of several: every fourth vector is alone, labels gather the others."""
    e = _t(spark, d, "embeddings").select(F.when(F.col("vec_id") % 4 == 0, F.col("vec_id")).otherwise(F.col("label").cast("long") + 1000000000).alias("story_id"), F.col("vec_id").alias("id"), "embedding")
    return stories.merge_singles(e, 0.35)


@query("SELECT l_orderkey AS story_id, l_linenumber AS n, l_suppkey AS outlet, CASE WHEN l_suppkey % 5 = 0 THEN 9.0 ELSE l_discount END AS bias FROM lineitem")
def rerated_articles(spark: SparkSession, d: str) -> DataFrame:
    """A new rating of an outlet goes to all of its articles."""
    a = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("story_id"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("outlet"), F.col("l_discount").alias("bias"))
    return stories.rerate(a, _t(spark, d, "supplier").filter("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("outlet"), F.lit(9.0).alias("rating")))


@query("""SELECT s_name AS name, 'seed' AS url, 'seed' AS description FROM supplier
UNION ALL SELECT 'user ' || user_id, arg_min(event_type || event_id, event_id), 'N/A' FROM events GROUP BY user_id""")
def outlets_with_new(spark: SparkSession, d: str) -> DataFrame:
    known = _t(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("seed").alias("url"), F.lit("seed").alias("description"))
    e = _t(spark, d, "events")
    return stories.add_missing(known, e.select(F.col("event_id").alias("ord"), F.concat(F.lit("user "), F.col("user_id")).alias("name"), F.concat("event_type", F.col("event_id")).alias("url")))


@query("""WITH a AS (SELECT l_orderkey AS story_id, count(*)::DOUBLE AS score FROM lineitem GROUP BY 1)
SELECT story_id, score / max(score) OVER () AS base_score, CASE WHEN story_id % 3 = 0 THEN 0.5 END AS editorial_score,
round(score / max(score) OVER () * 0.6 + CASE WHEN story_id % 3 = 0 THEN 0.5 ELSE 0 END * 0.4, 9) AS final_score, TIMESTAMP '2024-01-01' AS run_at FROM a""")
def editorial_history(spark: SparkSession, d: str) -> DataFrame:
    ranked = _articles(spark, d).groupBy("story_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    marks = ranked.filter("story_id % 3 = 0").select("story_id", F.lit(0.5).alias("editorial_score"))
    return stories.final_ranking(ranked, marks, F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))).withColumn("final_score", F.round("final_score", 9))


@query(r"""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS raw FROM conversations),
s AS (SELECT conv_id, turn, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS l FROM l),
k AS (SELECT *, contains(l, ':') AND length(regexp_replace(string_split(l, ':')[1], '^\s+|\s+$', '', 'g')) < 35 AS lab FROM s WHERE l <> '')
SELECT conv_id, turn, CASE WHEN lab THEN 'label' ELSE 'para' END AS kind, CASE WHEN lab THEN regexp_replace(string_split(l, ':')[1], '^\s+|\s+$', '', 'g') END AS label,
CASE WHEN lab THEN regexp_replace(l[strpos(l, ':') + 1:], '^\s+|\s+$', '', 'g') ELSE l END AS text FROM k""")
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").select("conv_id", "turn", F.inline(tx.section_lines(F.col("text"))))


@query("SELECT o_orderkey, strftime(o_orderdate, '%b %d, %Y') AS short, strftime(o_orderdate, '%B %d, %Y') AS long, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS title FROM orders")
def display_rows(spark: SparkSession, d: str) -> DataFrame:
    title = tx.display_title(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(""), F.col("o_orderstatus"))
    return _t(spark, d, "orders").select("o_orderkey", tx.short_date(F.col("o_orderdate")).alias("short"), tx.long_date(F.col("o_orderdate")).alias("long"), title.alias("title"))


@query(r"""SELECT doc_id, CASE WHEN contains(t, ':') THEN string_split(t, ':')[1] WHEN contains(t, '-') THEN string_split(t, '-')[1]
ELSE array_to_string(string_split(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ')[1:6], ' ') END AS title FROM (SELECT doc_id, string_split(text, chr(10))[1] AS t FROM documents)""")
def guessed_titles(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", tx.guessed_title(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))


@query()
def page_articles(spark: SparkSession, d: str) -> DataFrame:
    """Sanitised article HTML of every page, by the extraction cascade."""
    return _t(spark, d, "pages").select("page_id", html.article_html(F.col("html")).alias("article"))


@query()
def sanitized_pages(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", html.sanitize(F.col("html")).alias("html"))


@query("""WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS id, b.vec_id AS other, a.label = b.label AS alike, list_cosine_similarity(a.e, b.e) AS c FROM e a JOIN e b ON b.vec_id < a.vec_id),
t AS (SELECT id, arg_max(other, c) AS other, arg_max(alike, c) AS alike, max(c) AS c FROM p WHERE c >= 0.35 GROUP BY id),
n AS (SELECT id, other FROM t WHERE c >= 0.45 OR alike),
r AS (SELECT vec_id AS id, vec_id AS story FROM e WHERE vec_id NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, r.story FROM n JOIN r ON n.other = r.id)
SELECT id, story FROM r""")
def judged_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Assignment with a judge for the middle band; here it takes pairs of one label."""
    e = _t(spark, d, "embeddings")
    label = e.select(F.col("vec_id").alias("id"), "label")

    def judge(pairs: DataFrame) -> DataFrame:
        return pairs.join(label, "id").join(label.select(F.col("id").alias("other"), F.col("label").alias("other_label")), "other").filter("label = other_label")

    return stories.assign_stories(e.select(F.col("vec_id").alias("id"), "embedding"), 0.45, 0.35, judge)


@query()
def retroactive_audit(spark: SparkSession, d: str) -> DataFrame:
    """Documents an audit clears: bad scrapes and near-copies of any others of their outlet, by whole texts, and what follows a cleared one of its domain (the source stands in)."""
    return quality.audit_outlets(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("outlet"), F.col("source").alias("domain"), F.col("text").alias("content")))


@query(f"""WITH {_LATEST} SELECT a.outlet, a.id FROM l a JOIN l b ON a.outlet = b.outlet AND b.n <= 10 AND b.id > a.id AND b.wall WHERE a.wall GROUP BY 1, 2 HAVING count(*) >= 2""")
def walled_audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit without domains: walls go as long as two later ones are among the outlet's latest."""
    return quality.audit(_walled(spark, d).withColumn("domain", F.lit("")))


@query("SELECT doc_id, NULL::INT AS bias, ['Other'] AS topics FROM documents")
def unanswered_models(spark: SparkSession, d: str) -> DataFrame:
    """Without a provider no rating is given and every topic is Other."""
    return _t(spark, d, "documents").select("doc_id", models.article_bias(F.lit(""), F.col("text"), None).alias("bias"), models.topics(F.lit(""), F.col("text"), None).alias("topics"))


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 6 = 0")
def unrated_outlets(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.unrated(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.nullif(F.col("s_suppkey") % 6, F.lit(0)).alias("bias_score"))).select("id")


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 = 0 ORDER BY vec_id LIMIT 50")
def embedding_queue(spark: SparkSession, d: str) -> DataFrame:
    """The first articles without an embedding: a queue of 50."""
    return upkeep.missing_embeddings(_t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding"))).select("id")


def _stored_stories(spark: SparkSession, d: str) -> DataFrame:
    """Orders as stories: every third has no summary, every third its title in its place; every second has a headline, every fifth a report."""
    k, title = F.col("o_orderkey"), F.col("o_orderpriority")
    summary = F.when(k % 3 == 1, title).when(k % 3 == 2, "text")
    return _t(spark, d, "orders").select(k.alias("id"), title.alias("title"), F.when(k % 2 == 0, "head").alias("headline"), summary.alias("summary"), F.when(k % 5 == 0, "report").when(k % 5 == 1, "").alias("deep_report"), (F.col("o_totalprice") - 1000).alias("headline_score"), F.col("o_orderdate").alias("created_at"))


_STORED = """s AS (SELECT o_orderkey AS id, o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'head' END AS headline, CASE o_orderkey % 3 WHEN 1 THEN o_orderpriority WHEN 2 THEN 'text' END AS summary,
 CASE o_orderkey % 5 WHEN 0 THEN 'report' WHEN 1 THEN '' END AS deep_report, o_totalprice - 1000 AS headline_score, o_orderdate AS created_at FROM orders),
m AS (SELECT l_orderkey AS id FROM lineitem GROUP BY 1 HAVING count(*) >= 2)"""


def _members(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).select("story_id", "id")


@query(f"WITH {_STORED} SELECT id FROM s WHERE summary IS NULL OR summary = title ORDER BY id LIMIT 10")
def summary_queue(spark: SparkSession, d: str) -> DataFrame:
    """The first stories without a summary: a queue of 10."""
    return upkeep.missing_summaries(_stored_stories(spark, d)).select("id")


@query(f"WITH {_STORED} SELECT id FROM s JOIN m USING (id) WHERE coalesce(headline, '') = ''")
def headline_queue(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.missing_headlines(_stored_stories(spark, d), _members(spark, d)).select("id")


@query(f"WITH {_STORED} SELECT id, headline_score FROM s JOIN m USING (id) WHERE headline_score > 0 AND created_at >= TIMESTAMP '1995-01-01' AND coalesce(deep_report, '') = '' ORDER BY headline_score DESC, id LIMIT 5")
def report_queue(spark: SparkSession, d: str) -> DataFrame:
    """The five best ranked stories without a report."""
    return upkeep.missing_reports(_stored_stories(spark, d), _members(spark, d), F.to_timestamp_ntz(F.lit("1995-01-03 00:00:00"))).select("id", "headline_score")


@query("SELECT doc_id AS id FROM documents WHERE coalesce(text, '') = '' OR length(text) < 500 ORDER BY doc_id LIMIT 20")
def rescrape_queue(spark: SparkSession, d: str) -> DataFrame:
    """The first articles to scrape again: a queue of 20."""
    return upkeep.missing_content(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))).select("id")


@query(f"WITH {_STORED} SELECT id, CASE WHEN id % 7 = 0 THEN 'new' ELSE summary END AS summary FROM s")
def produced_summaries(spark: SparkSession, d: str) -> DataFrame:
    """New summaries where one was produced."""
    s = _stored_stories(spark, d)
    made = s.filter("id % 7 < 3").select("id", F.when(F.col("id") % 7 == 0, "new").when(F.col("id") % 7 == 1, "").alias("summary"))
    return upkeep.set_if_produced(s, made, "id", "summary").select("id", "summary")


@query(f"WITH {_STORED} SELECT id, CASE WHEN m.id IS NOT NULL THEN headline END AS headline FROM s LEFT JOIN m USING (id)")
def reset_headlines(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.reset_headlines(_stored_stories(spark, d), _members(spark, d)).select("id", "headline")


@query("SELECT doc_id AS id, CASE WHEN length(text) >= 500 THEN md5(text) END AS content FROM documents")
def cleared_content(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("content"), F.length("text").alias("n"))
    return upkeep.clear_content(t, t.filter("n < 500")).select("id", "content")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 2.5 ELSE c_acctbal END AS bias_score FROM customer")
def rated_articles(spark: SparkSession, d: str) -> DataFrame:
    """New ratings of single articles."""
    a = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bias_score"))
    return upkeep.set_if_produced(a, a.filter("id % 4 = 0").select("id", F.lit(2.5).alias("bias_score")), "id", "bias_score")


@query("SELECT o_orderkey AS story_id, o_orderpriority AS topic FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def kept_topics(spark: SparkSession, d: str) -> DataFrame:
    """The topics of stories that were not deleted."""
    return upkeep.without(_stories(spark, d), _articles(spark, d).filter("quantity > 45"), "story_id")


@query(f"WITH a AS ({ARTICLES_SQL}) SELECT story_id, min(id) AS id, arg_min(title, id) AS title FROM a GROUP BY 1")
def first_articles(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.first_articles(_articles(spark, d).withColumn("content", F.lit(""))).drop("content")


@query("""WITH t AS (SELECT o_orderkey AS story_id, o_totalprice AS score FROM orders ORDER BY score DESC, story_id LIMIT 50), e AS (SELECT story_id, CASE WHEN story_id % 3 > 0 THEN (story_id % 10)::DOUBLE END AS editorial_score FROM t)
SELECT *, row_number() OVER (ORDER BY editorial_score DESC NULLS LAST, story_id)::INT AS editorial_rank FROM e""")
def editorial_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best stories in the order of a judge (made of their ids)."""
    ranked = _t(spark, d, "orders").select(F.col("o_orderkey").alias("story_id"), F.col("o_totalprice").alias("score"))
    return upkeep.editorial_ranks(ranked, F.when(F.col("story_id") % 3 > 0, (F.col("story_id") % 10).cast("double")))


@query("""WITH b AS (SELECT 'd' || o_custkey || '.' || o_orderkey AS domain, o_orderstatus = 'F' AS is_permanent, o_orderdate AS added_at FROM orders)
SELECT domain, row_number() OVER (ORDER BY is_permanent DESC, added_at DESC, domain) AS position, strftime(added_at, '%Y-%m-%d') AS since, CASE WHEN is_permanent THEN 'Permanent' ELSE 'Auto-blocked' END AS status FROM b ORDER BY position LIMIT 25""")
def blocklist_first_page(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 entries of a blocklist made of orders, as it is shown."""
    b = _t(spark, d, "orders").select(F.concat(F.lit("d"), F.col("o_custkey"), F.lit("."), F.col("o_orderkey")).alias("domain"), (F.col("o_orderstatus") == "F").alias("is_permanent"), F.col("o_orderdate").alias("added_at"))
    page = upkeep.blocklist_page(b).limit(25)
    shown = page.withColumn("position", F.row_number().over(Window.orderBy(F.desc("is_permanent"), F.desc("added_at"), "domain")).cast("long"))
    return shown.select("domain", "position", tx.blocked_since(F.col("added_at"), F.col("is_permanent")).alias("b")).select("domain", "position", "b.*")


@query(r"SELECT conv_id, turn, coalesce(length(text) > 100, false) AS readable, nullif(trim(text), '') AS parameter, (SELECT first(t::INT) FROM (SELECT unnest(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: regexp_matches(x, '^[0-9]{1,9}$') AND try_cast(x AS INT) <= 9)) AS t)) AS choice FROM conversations")
def turn_values(spark: SparkSession, d: str) -> DataFrame:
    """Small functions over all turns: readable text, trimmed parameter, the first number up to 9."""
    text = F.col("text")
    return _t(spark, d, "conversations").select("conv_id", "turn", upkeep.readable(text).alias("readable"), upkeep.parameter(text).alias("parameter"), tx.match_choice(text, 9).alias("choice"))


@query("SELECT user_id, max(ts) FILTER (value > 20) AS last, coalesce(max(ts) FILTER (value > 20) <= TIMESTAMP '2024-01-25 00:00:00', true) AS due FROM events GROUP BY 1")
def fetch_gate(spark: SparkSession, d: str) -> DataFrame:
    """Users whose last larger event is an hour ago, or who had none."""
    last = _t(spark, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("value") > 20, F.col("ts"))).alias("last"))
    return last.withColumn("due", upkeep.due(F.col("last"), F.to_timestamp_ntz(F.lit("2024-01-25 01:00:00"))))


@query("""SELECT 'user ' || user_id AS key, arg_max(props, event_id) AS value FROM events GROUP BY user_id
UNION ALL SELECT 'user ' || c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def state_after_writes(spark: SparkSession, d: str) -> DataFrame:
    """Key-value state: customers' names, written over by their events."""
    state = _t(spark, d, "customer").select(F.concat(F.lit("user "), F.col("c_custkey")).alias("key"), F.col("c_name").alias("value"))
    return upkeep.put_state(state, _t(spark, d, "events").select(F.concat(F.lit("user "), F.col("user_id")).alias("key"), F.col("props").alias("value"), F.col("event_id").alias("ord")))


@query("""WITH e AS (SELECT *, lag(value > 50) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id AS service, event_id AS at FROM e WHERE value > 50 AND NOT coalesce(before, true)""")
def services_back(spark: SparkSession, d: str) -> DataFrame:
    """Events with which a user's value rises above 50 again."""
    return upkeep.came_back(_t(spark, d, "events").select(F.col("user_id").alias("service"), F.col("event_id").alias("at"), (F.col("value") > 50).alias("online"))).select("service", "at")


@query(rf"""WITH p AS (SELECT page_id, 'https://' || CASE page_id % 6 WHEN 0 THEN 'wired.com' WHEN 1 THEN 'axios.com' WHEN 2 THEN 'x.com' WHEN 3 THEN 'wsj.com' ELSE 'a.org' END || '/' || page_id AS url, page_id % 6 AS r,
 CASE WHEN page_id % 5 > 0 THEN html END AS plain, CASE WHEN page_id % 5 = 1 THEN '' WHEN page_id % 5 = 0 THEN html || ' captcha' ELSE html || 'b' END AS browser, html || 'c' AS crawler FROM pages),
f AS (SELECT page_id, CASE WHEN r IN (2, 3) THEN NULL WHEN r = 0 THEN nullif(browser, '') WHEN r = 1 THEN crawler ELSE coalesce(plain, nullif(browser, '')) END AS found FROM p),
t AS (SELECT *, lower({TAGLESS.format('found')}) AS t FROM f), v AS (SELECT *, CASE WHEN found = '' THEN NULL {_STRONG} {_WEAK} END AS reason FROM t)
SELECT page_id, CASE WHEN reason IS NULL THEN md5(found) END AS content, reason FROM v""")
def scrape_cascade(spark: SparkSession, d: str) -> DataFrame:
    """What remains of made fetches of every page, by route and fallback."""
    k, page = F.col("page_id"), F.col("html")
    hosts = F.array(*[F.lit(h) for h in ("wired.com", "axios.com", "x.com", "wsj.com", "a.org", "a.org")])
    rows = _t(spark, d, "pages").select(
        "page_id", F.concat(F.lit("https://"), F.element_at(hosts, (k % 6 + 1).cast("int")), F.lit("/"), k).alias("url"), F.when(k % 5 > 0, page).alias("plain"),
        F.when(k % 5 == 1, "").when(k % 5 == 0, F.concat(page, F.lit(" captcha"))).otherwise(F.concat(page, F.lit("b"))).alias("browser"), F.lit(None).cast("string").alias("archive"), F.concat(page, F.lit("c")).alias("crawler"),
    )
    blocked = quality.blocklist(spark).filter("domain = 'wsj.com'")
    return upkeep.scrape(rows, blocked).select("page_id", F.md5(F.col("content").cast("binary")).alias("content"), "reason")


@query(f"""WITH a AS ({ARTICLES_SQL}), r AS (SELECT story_id, string_agg(id || ':' || coalesce(s_name, '-'), ',' ORDER BY date DESC, id DESC) AS articles FROM a LEFT JOIN supplier ON outlet_id = s_suppkey AND s_suppkey % 2 = 0 GROUP BY 1)
SELECT o_orderkey AS id, articles FROM orders LEFT JOIN r ON o_orderkey = story_id""")
def story_details(spark: SparkSession, d: str) -> DataFrame:
    """Every story with its articles and their outlets (every second is known), newest first."""
    a = _articles(spark, d).withColumn("title", F.col("title").cast("string"))
    o = _t(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("double").alias("bias_score"))
    rows = upkeep.story_details(_t(spark, d, "orders").select(F.col("o_orderkey").alias("id")), a, o)
    return rows.select("id", F.when(F.col("articles").isNotNull(), F.array_join(F.transform("articles", lambda x: F.concat(x["id"], F.lit(":"), F.coalesce(x["outlet"], F.lit("-")))), ",")).alias("articles"))


@query(f"""WITH a AS (SELECT DISTINCT story_id, id, outlet_id % 4 AS topic FROM ({ARTICLES_SQL}))
SELECT DISTINCT x.id, y.topic::VARCHAR AS topic FROM a x JOIN a y ON x.story_id = y.story_id AND y.id <= x.id UNION SELECT id, o_orderpriority FROM a JOIN orders ON story_id = o_orderkey""")
def topics_so_far(spark: SparkSession, d: str) -> DataFrame:
    """The topics that each article's story had when it came."""
    a = _articles(spark, d).select("story_id", "id", (F.col("outlet_id") % 4).cast("string").alias("topic"))
    return upkeep.topics_so_far(a.select("story_id", "id"), a, _stories(spark, d))


@query("""SELECT event_id AS id, 0 AS pos, event_type AS title, CASE WHEN user_id % 2 = 0 THEN user_id::VARCHAR ELSE 'd' || user_id END AS content, 'http://x.org/' || user_id AS url, 'Outlet' AS source_name, ts AS published_at, props AS image_url FROM events""")
def other_payload_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles out of the second source's payloads: the description stands in for an empty content."""
    even = F.col("user_id") % 2 == 0
    art = F.struct(
        F.col("event_type").alias("title"), F.when(even, F.col("user_id").cast("string")).otherwise("").alias("content"), F.concat(F.lit("d"), F.col("user_id")).alias("description"), F.concat(F.lit("http://x.org/"), F.col("user_id")).alias("url"),
        F.struct(F.lit("Outlet").alias("name")).alias("source"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("publishedAt"), F.col("props").alias("image"),
    )
    p = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("gnews").alias("source"), F.to_json(F.struct(F.array(art).alias("articles"))).alias("payload"))
    return payloads.articles(p, F.lit(None).cast("timestamp_ntz"))


@query(r"""WITH k AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Intro What''s happening: ' || text || ' What''s next: end' WHEN 1 THEN 'What''s happening: ' || text ELSE text END AS s FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN regexp_replace(string_split(string_split(s, 'What''s happening:')[2], 'What''s next:')[1], '^\s+|\s+$', '', 'g') END AS section,
['political analyst', 'gaming journalist', 'professional news analyst'][turn % 3 + 1] AS persona FROM k""")
def summary_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of made summaries, and who writes about a kind."""
    part, text = F.col("turn") % 3, F.col("text")
    made = F.when(part == 0, F.concat(F.lit("Intro What's happening: "), text, F.lit(" What's next: end"))).when(part == 1, F.concat(F.lit("What's happening: "), text)).otherwise(text)
    kind = F.when(part == 0, "politics").when(part == 1, "gaming")
    return _t(spark, d, "conversations").select("conv_id", "turn", tx.whats_happening(made).alias("section"), tx.persona(kind).alias("persona"))


@query()
def document_near_copies(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents that resemble at least two of their outlet's latest, by the texts themselves."""
    return quality.near_copies(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("outlet"), F.col("text").alias("content")), chars=None)


_SETTLED = """o AS (SELECT o_orderkey AS id, o_custkey % 97 AS outlet, (o_custkey % 97) || '-' || o_orderkey % 11 || '.org' AS domain, o_orderkey % 3 AS has, o_orderpriority AS kind, (o_custkey % 41 = 0)::INT AS bad, o_orderkey % 2 AS given FROM orders),
i AS (SELECT *, row_number() OVER (PARTITION BY outlet ORDER BY id) AS k, CASE kind WHEN '1-URGENT' THEN 'u' WHEN '2-HIGH' THEN 'h' ELSE '#' || id END AS text FROM o)"""


@query(f"""WITH RECURSIVE {_SETTLED},
s AS (SELECT outlet, 0::BIGINT AS k, []::VARCHAR[] AS latest, []::VARCHAR[] AS hosts, NULL::BIGINT AS id, NULL::BOOLEAN AS taken, NULL::VARCHAR AS reason FROM i GROUP BY outlet
  UNION ALL
  SELECT outlet, k, CASE WHEN taken THEN list_append(latest, text)[-10:] WHEN given = 1 THEN list_append(latest, '#given')[-10:] ELSE latest END, CASE WHEN reason IS NOT NULL THEN list_append(hosts, domain) ELSE hosts END, id, taken, reason
  FROM (SELECT *, able AND NOT flagged AS taken, CASE WHEN flagged AND bad = 1 THEN 'sign' WHEN flagged THEN 'near copies: ' || copies END AS reason
    FROM (SELECT *, able AND (bad = 1 OR copies >= 2) AS flagged
      FROM (SELECT i.*, s.latest, s.hosts, i.has > 0 AND NOT list_contains(s.hosts, i.domain) AS able, len(list_filter(s.latest, lambda x: x = i.text)) AS copies FROM s JOIN i ON i.outlet = s.outlet AND i.k = s.k + 1))))
SELECT id, taken, reason FROM s WHERE k > 0""")
def settled_batch(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a batch of scraped articles: urgent and high ones get the outlet's wall of that kind, others a text of their own; every domain belongs to one outlet."""
    o = _t(spark, d, "orders")
    outlet, key = F.col("o_custkey") % 97, F.col("o_orderkey").cast("string")
    wall = lambda kind: F.repeat(F.md5(F.concat(F.lit(kind), outlet.cast("string")).cast("binary")), F.lit(6))
    own = F.concat(*[F.md5(F.concat(key, F.lit(str(i))).cast("binary")) for i in range(6)])
    text = F.when(F.col("o_orderpriority") == "1-URGENT", wall("u")).when(F.col("o_orderpriority") == "2-HIGH", wall("h")).otherwise(own)
    batch = o.select(
        F.col("o_orderkey").alias("id"), outlet.alias("outlet"), F.concat(outlet.cast("string"), F.lit("-"), (F.col("o_orderkey") % 11).cast("string"), F.lit(".org")).alias("domain"),
        F.when(F.col("o_orderkey") % 3 > 0, text).alias("found"), F.when(F.col("o_custkey") % 41 == 0, "sign").alias("bad"), F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit("given "), key)).alias("given"),
    )
    none = batch.limit(0).select("id", "outlet", F.lit("").alias("content"))
    return ingest.settle(batch, none, batch.limit(0).select("domain")).select("id", "taken", "reason")


@query("""WITH RECURSIVE e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 3 <> 1 THEN vec_id ELSE label + 1000000000 END AS story_id FROM embeddings),
z AS (SELECT *, count(*) OVER (PARTITION BY story_id) AS n FROM e),
p AS (SELECT s.story_id, m.story_id AS to_story, m.n, round(list_cosine_similarity(s.e, m.e), 12) AS c FROM z s JOIN z m ON s.n = 1 AND (m.n > 1 OR m.story_id < s.story_id)),
f AS (SELECT story_id, max(c) FILTER (n > 1) AS c, list({'c': c, 'other': to_story}) FILTER (n = 1 AND c >= 0.35) AS singles FROM p GROUP BY 1),
g AS (SELECT f.story_id, f.singles, f.c, (SELECT min(to_story) FROM p WHERE p.story_id = f.story_id AND p.n > 1 AND p.c = f.c) AS into_story, row_number() OVER (ORDER BY story_id) AS k FROM f),
m AS (SELECT 0::BIGINT AS k, MAP {}::MAP(BIGINT, BIGINT) AS moved
  UNION ALL
  SELECT g.k, CASE WHEN b.best IS NULL THEN m.moved ELSE map_concat(m.moved, MAP {g.story_id: b.best.into_story}) END
  FROM m JOIN g ON g.k = m.k + 1, LATERAL (SELECT list_sort(list_filter(list_append(list_transform(coalesce(g.singles, []), lambda x: {'less': -x.c, 'into_story': m.moved[x.other]}), {'less': -g.c, 'into_story': g.into_story}), lambda x: x.into_story IS NOT NULL AND x.less <= -0.35))[1] AS best) AS b)
SELECT unnest(map_keys(moved)) AS story_id, unnest(map_values(moved)) AS "into" FROM (SELECT moved FROM m ORDER BY k DESC LIMIT 1)""")
def growing_merges(spark: SparkSession, d: str) -> DataFrame:
    """Stories of one article join others one after the other, and attract later ones once they have moved: two of three vectors are alone."""
    e = _t(spark, d, "embeddings").select(F.when(F.col("vec_id") % 3 != 1, F.col("vec_id")).otherwise(F.col("label").cast("long") + 1000000000).alias("story_id"), F.col("vec_id").alias("id"), "embedding")
    return stories.merge_growing(e, 0.35)


@query("""SELECT event_id AS id, event_type AS source, CASE WHEN ts::DATE = DATE '2024-01-20' THEN 'again' ELSE props END AS payload, ts AS fetched_at FROM events
WHERE ts::DATE >= DATE '2024-01-15' AND (ts::DATE <> DATE '2024-01-20' OR event_id % 2 = 0)""")
def stored_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Events through the versioned store: two appends, one day replaced, days past their time dropped."""
    e = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), F.lit(None).cast("string").alias("topic_name"), F.col("props").alias("payload"), F.col("ts").alias("fetched_at"))
    t = Tables(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    t.commit({"raw_article_payloads": e.filter("id % 3 = 0")})
    t.commit({"raw_article_payloads": Append(e.filter("id % 3 <> 0"))})
    day = t.table("raw_article_payloads").filter((F.to_date("fetched_at") == "2024-01-20") & (F.col("id") % 2 == 0))
    t.commit({"raw_article_payloads": ReplaceDays(day.withColumn("payload", F.lit("again")), days=("2024-01-20",))})
    t.commit({"raw_article_payloads": DropDays("2024-01-15")})
    t.vacuum(keep=1)
    return t.table("raw_article_payloads").drop("topic_name")


@query("SELECT l_orderkey AS story_id, count(*) AS articles, max(l_shipdate) AS latest FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def maintained_feed(spark: SparkSession, d: str) -> DataFrame:
    """The feed kept up through three batches: the first lines of each order, the others, and the removal of what was returned."""
    a = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("story_id"), F.col("l_shipdate").alias("date"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"))
    first, rest, gone = a.filter("n <= 3"), a.filter("n > 3"), a.filter("flag = 'R'")
    state = feed.feed_after(feed.feed_state(first), rest, gone.limit(0), a)
    return feed.feed_after(state, rest.limit(0), gone, a.filter("flag <> 'R'"))


@query("""WITH f AS (SELECT l_orderkey AS story_id, count(*) AS articles, max(l_shipdate) AS latest FROM lineitem GROUP BY 1 HAVING count(*) > 1)
SELECT * FROM f WHERE latest < TIMESTAMP '1998-01-01' OR (latest = TIMESTAMP '1998-01-01' AND story_id > 50) ORDER BY latest DESC, story_id LIMIT 25""")
def feed_next_page(spark: SparkSession, d: str) -> DataFrame:
    """The page that follows a given story, by key."""
    return feed.next_page(feed.feed_state(_articles(spark, d)), (datetime.datetime(1998, 1, 1), 50), least=2)


_FEED = 500  # items


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS pos FROM p)
SELECT pos::INT AS pos, 'Page & ' || page_id AS title, '<p>' || page_id || '</p>' AS content, url, host AS source_name, TIMESTAMP '2024-01-31 19:00:00' + to_minutes(page_id % 60) AS published_at FROM n WHERE page_id % 10 <> 3""")
def feed_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles out of feeds for each host of the pages, up to ``_FEED`` items in a feed; every tenth item is broken."""
    p = _t(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.lit(True).alias("one"))
    p = marked_before(placed(p, ["host", "page_id"]), "host", "page_id", "one", "n").withColumn("id", F.floor(F.col("n") / _FEED).cast("long"))
    amp = F.when(F.col("page_id") % 10 == 3, "&").otherwise("&amp;")
    date = F.concat(F.lit("Wed, 31 Jan 2024 14:"), F.lpad((F.col("page_id") % 60).cast("string"), 2, "0"), F.lit(":00 EST"))
    item = F.concat(F.lit("<item><title>Page "), amp, F.lit(" "), F.col("page_id"), F.lit("</title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link><description><![CDATA[<p>"), F.col("page_id"), F.lit("</p>]]></description><pubDate>"), date, F.lit("</pubDate></item>"))
    items = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", item.alias("item")))), lambda x: x["item"]), "\n")
    rss = p.groupBy("host", "id").agg(items.alias("items")).select("id", F.lit("rss").alias("source"), F.concat(F.lit("<rss><channel><title>"), F.col("host"), F.lit("</title>"), F.col("items"), F.lit("</channel></rss>")).alias("payload"))
    return feeds.feed_items(rss)[0].select((F.col("pos") + F.col("id") * _FEED).cast("int").alias("pos"), "title", "content", "url", "source_name", "published_at")


def _answers(prompts: pd.Series) -> pd.Series:
    """A stand-in for a model that answers by the letters of the text in the prompt."""
    texts = prompts.str.split("\nText: ", n=1).str[1]
    rating = texts.map(lambda t: str(t.count("a") % 7))
    labels = texts.map(lambda t: f"- {tx.TOPICS[len(t) % 6].upper()}\nand {tx.TOPICS[t.count('e') % 6]}")
    return rating.where(prompts.str.startswith("Rate"), labels)


_NAMES = ", ".join(f"'{t}'" for t in tx.TOPICS)


@query(f"""WITH t AS (SELECT doc_id, left(coalesce(text, ''), 200) AS s, left(coalesce(text, ''), 600) AS l FROM documents),
n AS (SELECT doc_id, (length(l) - length(replace(l, 'a', ''))) % 7 AS a, [{_NAMES}][length(s) % 6 + 1] AS x, [{_NAMES}][(length(s) - length(replace(s, 'e', ''))) % 6 + 1] AS y FROM t)
SELECT doc_id, CASE WHEN a BETWEEN 1 AND 5 THEN a END::INT AS bias,
  CASE WHEN x = 'Other' AND y = 'Other' THEN ['Other'] WHEN x = 'Other' THEN [y] WHEN y = 'Other' OR x = y THEN [x] ELSE [x, y] END AS topics FROM n""")
def answered_models(spark: SparkSession, d: str) -> DataFrame:
    """Ratings and topics of every document from a provider, through prompts and parsers."""
    t = _t(spark, d, "documents")
    return t.select("doc_id", models.article_bias(F.lit(""), F.col("text"), _answers).alias("bias"), models.topics(F.lit(""), F.col("text"), _answers).alias("topics"))
