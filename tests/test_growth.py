"""What a query holds or sends must not grow faster than its input."""

import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pressfold.functions import html
from pressfold.functions.text import without_tags, without_tags_first
from pressfold.operators import ingest, quality, similar, stories, upkeep
from pressfold.sources import feeds
from tests.test_ingest import edited, scan


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_batch_in_spans_equals_the_scan(spark):
    rnd = random.Random(4)
    walls = ["".join(rnd.choice(string.ascii_lowercase) for _ in range(150)) for _ in range(2)]
    content = lambda: edited(rnd, rnd.choice(walls), 9) if rnd.random() < 0.6 else rnd.choice([None, "", "".join(rnd.choice(string.ascii_lowercase) for _ in range(140))])
    stored = [(i, rnd.choice("ab"), content()) for i in range(10)]
    batch = [(100 + i, rnd.choice("ab"), rnd.choice(["x.org", "y.org", "", f"d{i}.org"]), content(), None, content()) for i in range(30)]
    got = ingest.settle(
        spark.createDataFrame(batch, "id long, outlet string, domain string, found string, bad string, given string"),
        spark.createDataFrame(stored, "id long, outlet string, content string"), spark.createDataFrame([], "domain string"), first=10, growth=2,
    )
    assert "Broadcast" not in plan(got)
    assert {r["id"]: (r["content"], r["taken"], r["reason"], r["copies"]) for r in got.collect()} == scan(batch, stored, set())


def test_a_feed_is_not_carried_by_its_items(spark):
    feed = "<rss><channel><title>N</title>" + "<item><title>t</title></item>" * 3 + "</channel></rss>"
    rows, _ = feeds.feed_items(spark.createDataFrame([(1, "s", feed)], "id long, source string, payload string"))
    kept = re.findall(r"Generate posexplode\(.*\), \[([^\]]*)\]", plan(rows))
    assert kept and "payload" not in kept[0] and plan(rows).count("from_xml") <= 2
    assert [r["source_name"] for r in rows.collect()] == ["N"] * 3


def test_blocks_are_few_and_hold_vectors_as_they_came(spark):
    x = np.random.default_rng(1).standard_normal((5000, 8)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    blocks = similar.plain_blocks(frame)
    assert blocks.count() <= 8 and blocks.agg(F.sum(F.length("m"))).head()[0] == x.nbytes
    pairs, a, _ = similar.block_pairs(frame, frame, 0.9, True)
    assert a.count() <= 8


def test_a_merged_article_meets_the_queries_once(spark, monkeypatch):
    turn = lambda t: [float(np.cos(t)), float(np.sin(t))]
    rows = [(1, 1, turn(0)), (1, 2, turn(0))] + [(10 + k, 10 + k, turn(0.1 * (k + 1))) for k in range(4)]
    met = []

    def counted(queries, candidates, *args, **rest):
        if rest.get("earlier"):
            met.extend(r["id"] for r in candidates.select("id").collect())
        return similar.nearest(queries, candidates, *args, **rest)

    monkeypatch.setattr(stories, "nearest", counted)
    got = stories.merge_growing(spark.createDataFrame(rows, "story_id long, id long, embedding array<float>"), 0.99)
    assert sorted(map(tuple, got.collect())) == [(10 + k, 1) for k in range(4)]
    assert sorted(met) == [10, 11, 12, 13]


def test_tags_are_stripped_once(spark):
    rows = spark.createDataFrame([("<p>x</p> captcha",), ("fine",), ("",), (None,)], "content string")
    judged = rows.select(quality.bad_scrape(F.col("content")).alias("reason"))
    assert plan(judged).count("<[^>]+>") == 1
    assert [r["reason"] for r in judged.collect()] == ["strong: captcha", None, None, None]


def test_the_beginning_without_tags(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["<b>", "<", ">", " ", "\n", " ", "ab", "c"]) for _ in range(rnd.randrange(120))) for _ in range(400)] + [None, "", "a" * 30 + "<" + "b" * 50 + ">c", " " * 90 + "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.filter(~without_tags_first(F.col("t"), 20).eqNullSafe(F.left(without_tags(F.col("t")), F.lit(20)))).count() == 0


def test_topics_are_not_told_apart_before_they_are_spread(spark):
    a = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 12)], "story_id long, id long")
    labels = spark.createDataFrame([(1, 11, "x"), (1, 10, "y"), (2, 12, None)], "story_id long, id long, topic string")
    known = spark.createDataFrame([(1, "x"), (1, "k"), (3, "z")], "story_id long, topic string")
    want = [(10, "k"), (10, "x"), (10, "y"), (11, "k"), (11, "x"), (11, "y"), (12, None)]
    for of in (labels, labels.drop("story_id")):
        assert sorted(map(tuple, upkeep.topics_so_far(a, of, known).collect()), key=str) == want
    assert "Union" not in plan(upkeep.topics_so_far(a, labels, known))


def test_pages_are_read_one_by_one():
    pages = pa.array(["<p>a</p>", None, "", "<script>b</script><p onclick=x>c</p>"] * 50)
    got = html._each(pages, lambda h: (p := html.Page(h)).sanitized(0, len(p.events)))
    assert got.type == pa.string() and got.to_pylist() == ["<p>a</p>", None, "", "b<p>c</p>"] * 50
