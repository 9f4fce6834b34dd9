"""The data source over fixtures, streams that go on after a stop, and feeds with broken items."""

import json

from pyspark.sql import functions as F

from pressfold.sources import api, feeds, payloads

TOPICS = [api.Topic("US Politics", "query", query="congress", country=None, gnews_query="congress"), api.Topic("Business", category="business", gnews_category="business")]


def answer(request, run):
    if request.topic == "Business" and request.provider == "gnews":
        return None
    name = "urlToImage" if request.provider == "newsapi" else "image"
    return json.dumps({"articles": [{"title": f"{request.provider} {request.endpoint} {run} {k}", "url": f"http://x.org/{run}/{k}", "source": {"name": "S"}, name: "i"} for k in range(2)]})


def test_requests():
    made = api.requests_of(TOPICS, {"newsapi": "k", "gnews": "k"})
    assert [(r.provider, r.topic, r.endpoint) for r in made] == [("newsapi", "US Politics", "everything"), ("gnews", "US Politics", "search"), ("newsapi", "Business", "top-headlines"), ("gnews", "Business", "top-headlines")]
    assert dict(made[0].params) == {"q": "congress", "language": "en", "sortBy": "publishedAt", "pageSize": "100"} and dict(made[2].params) == {"pageSize": "100", "country": "us", "category": "business"}
    assert dict(made[1].params) == {"q": "congress", "lang": "en", "max": "10"} and [r.provider for r in api.requests_of(TOPICS, {"gnews": "k"})] == ["gnews", "gnews"]


def test_batch(spark):
    api.register(spark, answer)
    landed = spark.read.format("news").options(**api.options(TOPICS, "key", "key", run=3)).load()
    assert landed.rdd.getNumPartitions() == 4
    got = sorted((r["source"], r["topic_name"], r["payload"]) for r in landed.collect())
    want = [(r.provider, r.topic, answer(r, 3)) for r in api.requests_of(TOPICS, {"newsapi": "k", "gnews": "k"})]
    assert got == sorted(w for w in want if w[2])
    rows = payloads.articles(landed.withColumn("id", F.lit(1)), F.lit(None).cast("timestamp_ntz")).collect()
    assert len(rows) == 6 and all(r["image_url"] == "i" and r["source_name"] == "S" for r in rows)
    assert spark.read.format("news").options(**api.options(TOPICS)).load().count() == 0  # no key
    assert {r["source"] for r in spark.read.format("news").options(**api.options(TOPICS, gnews="key")).load().collect()} == {"gnews"}


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    runs = tmp_path / "runs"

    def go(last):
        runs.write_text(str(last))
        at = str(runs)
        api.register(spark, answer, latest=lambda: int(open(at).read()))
        stream = spark.readStream.format("news").options(**api.options(TOPICS, "key")).load()
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)
        return sorted(json.loads(r["payload"])["articles"][0]["title"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert go(1) == ["newsapi everything 1 0", "newsapi top-headlines 1 0"]
    assert go(1) == ["newsapi everything 1 0", "newsapi top-headlines 1 0"]  # nothing new
    assert go(3) == [f"newsapi {e} {r} 0" for e in ("everything", "top-headlines") for r in (1, 2, 3)]


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:media="http://m/"><channel><title><![CDATA[The Outlet]]></title><link>http://o.org</link>
<item><title>One &amp; two</title><link>http://o.org/1?x=1</link><description><![CDATA[<p>Text</p>]]></description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><media:content url="m"/><enclosure url="http://o.org/i.png" type="image/png"/></item>
<item><title>Broken & bad</title><link>http://o.org/2</link></item>
<item><title>Three</title><link> http://o.org/3 </link><pubDate>2 Jan 2024 01:30 -0500</pubDate></item><item><title>Cut off</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Atom Outlet</title><entry><title>Entry</title><link rel="self" href="http://a.org/self"/><link href="http://a.org/1"/><summary>S</summary><updated>2024-01-01T00:00:00+02:00</updated></entry></feed>"""


def test_feeds(spark):
    rows = [(1, "s", RSS), (2, "s", ATOM), (3, "s", None), (4, "s", "no xml"), (5, "own name", "<rss><channel><item><title>T</title></item></channel></rss>")]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            articles, broken = feeds.feed_items(spark.createDataFrame(rows, "id long, source string, payload string"))
            got = {(r["id"], r["pos"]): (r["title"], r["content"], r["url"], r["source_name"], r["at"], r["image_url"]) for r in articles.withColumn("at", F.col("published_at").cast("string")).collect()}
            assert got == {
                (1, 0): ("One & two", "<p>Text</p>", "http://o.org/1?x=1", "The Outlet", "2024-01-01 10:00:00", "http://o.org/i.png"),
                (1, 2): ("Three", "", "http://o.org/3", "The Outlet", "2024-01-02 06:30:00", None),
                (2, 0): ("Entry", "S", "http://a.org/1", "Atom Outlet", "2023-12-31 22:00:00", None),
                (5, 0): ("T", "", None, "own name", None, None),
            }
            assert [(r["id"], r["pos"]) for r in broken.collect()] == [(1, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
