import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from pressfold import schemas
from pressfold.functions import text as tx
from pressfold.operators import quality, stories, upkeep
from pressfold.plans import workflows
from pressfold.sources import payloads

DAY = dt.datetime(2024, 3, 9)


def now():
    return F.to_timestamp_ntz(F.lit("2024-03-10 00:00:00"))


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_queues(spark):
    s = spark.createDataFrame(
        [(1, "t", None, None, None, 3.0, DAY), (2, "t", "h", "t", "r", 9.0, DAY), (3, "t", "", "s", "", 5.0, DAY), (4, "t", None, "", None, 0.0, DAY), (5, "t", None, "s", None, 8.0, DAY - dt.timedelta(5))],
        schemas.SCHEMAS["stories"],
    )
    a = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 3), (14, 3), (15, 5), (16, 5), (17, None)], "id long, story_id long")
    assert ids(upkeep.missing_summaries(s)) == [1, 2] and ids(upkeep.missing_summaries(s, 1)) == [1]
    assert ids(upkeep.missing_headlines(s, a)) == [1, 3, 5]
    assert [r["id"] for r in upkeep.missing_reports(s, a, now()).collect()] == [3, 1] and [r["id"] for r in upkeep.missing_reports(s, a, now(), most=1).collect()] == [3]
    assert {r["id"]: r["headline"] for r in upkeep.reset_headlines(s, a).collect()} == {1: None, 2: None, 3: "", 4: None, 5: None}
    made = spark.createDataFrame([(1, "new"), (2, ""), (3, None)], "id long, headline string")
    assert {r["id"]: r["headline"] for r in upkeep.set_if_produced(s, made, "id", "headline").collect()} == {1: "new", 2: "h", 3: "", 4: None, 5: None}
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 499), (4, "x" * 500)], "id long, content string")
    assert ids(upkeep.missing_content(texts)) == [1, 2, 3] and ids(upkeep.missing_content(texts, most=2)) == [1, 2]
    cleared = upkeep.clear_content(texts, spark.createDataFrame([(4,)], "id long"))
    assert {r["id"]: r["content"] for r in cleared.collect()}[4] is None and cleared.filter("id = 3").first()["content"]
    assert ids(upkeep.without(a, s.filter("id = 1").select(F.col("id").alias("story_id")), "story_id")) == [12, 13, 14, 15, 16, 17]
    assert [upkeep.readable(F.lit(x)) is not None for x in ("a",)] and [r[0] for r in texts.select(upkeep.readable(F.col("content"))).collect()] == [False, False, True, True]


def test_gate_state_and_ranks(spark):
    t = spark.createDataFrame([(1, None), (2, dt.datetime(2024, 3, 9, 23)), (3, dt.datetime(2024, 3, 9, 23, 0, 1))], "id int, at timestamp_ntz")
    assert [r[0] for r in t.orderBy("id").select(upkeep.due(F.col("at"), now())).collect()] == [True, True, False]
    state = upkeep.put_state(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), spark.createDataFrame([("b", "3", 1), ("b", "4", 2), ("c", "5", 1)], "key string, value string, ord int"))
    assert dict(state.collect()) == {"a": "1", "b": "4", "c": "5"}
    seen = spark.createDataFrame([("m", 1, False), ("m", 2, True), ("m", 3, True), ("m", 4, False), ("m", 5, True), ("n", 1, True)], "service string, at int, online boolean")
    assert sorted((r["service"], r["at"]) for r in upkeep.came_back(seen).collect()) == [("m", 2), ("m", 5)]
    ranked = spark.createDataFrame([(i, float(i % 60)) for i in range(60)], "story_id long, score double")
    got = upkeep.editorial_ranks(ranked, F.when(F.col("story_id") % 2 == 0, F.col("story_id").cast("double"))).orderBy("editorial_rank").collect()
    assert len(got) == 50 and [r["story_id"] for r in got[:3]] == [58, 56, 54] and got[-1]["story_id"] == 59
    b = spark.createDataFrame([("a", True, DAY), ("b", None, DAY), ("c", True, None), ("d", False, DAY)], "domain string, is_permanent boolean, added_at timestamp_ntz")
    assert [r["domain"] for r in upkeep.blocklist_page(b).collect()] == ["b", "c", "a", "d"]
    shown = [tuple(r[0]) for r in b.select(tx.blocked_since(F.col("added_at"), F.col("is_permanent"))).collect()]
    assert shown == [("2024-03-09", "Permanent"), ("2024-03-09", "Auto-blocked"), ("—", "Permanent"), ("2024-03-09", "Auto-blocked")]
    rows, counters = upkeep.counted(ranked, "run", even=F.col("story_id") % 2 == 0)
    rows.count()
    assert counters.get == {"rows": 60, "even": 30}
    assert all(schemas.empty(spark, t).count() == 0 for t in schemas.SCHEMAS)
    values = spark.createDataFrame([("  a ",), ("  ",), ("",), (None,)], "x string")
    assert [r[0] for r in values.select(upkeep.parameter(F.col("x"))).collect()] == ["a", None, None, None]


def test_scrape(spark):
    long = "word " * 100
    rows = [
        ("https://www.wsj.com/1", long, long, long, long), ("https://x.com/2", long, long, long, long), ("https://a.org/3", "", None, long + "a", long), ("https://axios.com/4", long + "p", long, None, None),
        ("https://a.org/5", long + " captcha", long, None, None), ("https://wired.com/6", long, None, long + "w", None), ("https://a.org/7", None, None, None, None),
    ]
    got = {r["url"][-1]: (r["content"], r["reason"]) for r in upkeep.scrape(spark.createDataFrame(rows, "url string, plain string, browser string, archive string, crawler string"), quality.blocklist(spark)).collect()}
    assert got == {"1": (None, None), "2": (None, None), "3": (long + "a", None), "4": (long + "p", None), "5": (None, "strong: captcha"), "6": (long + "w", None), "7": (None, None)}


def test_story_lists(spark):
    s = spark.createDataFrame([(1,), (2,)], "id long")
    a = spark.createDataFrame([(10, 1, "a", 7, DAY), (11, 1, "b", None, DAY + dt.timedelta(1))], "id long, story_id long, title string, outlet_id long, date timestamp_ntz")
    o = spark.createDataFrame([(7, "O", 2.0)], "id long, name string, bias_score double")
    got = {r["id"]: r["articles"] for r in upkeep.story_details(s, a, o).collect()}
    assert got[2] is None and [(x["id"], x["outlet"]) for x in got[1]] == [(11, None), (10, "O")]
    assert [(r["story_id"], r["id"]) for r in upkeep.first_articles(a.withColumn("content", F.lit("c"))).collect()] == [(1, 10)]
    labels = spark.createDataFrame([(10, "x"), (11, "y")], "id long, topic string")
    known = spark.createDataFrame([(1, "old")], "story_id long, topic string")
    assert sorted(map(tuple, upkeep.topics_so_far(a.select("story_id", "id"), labels, known).collect())) == [(10, "old"), (10, "x"), (11, "old"), (11, "x"), (11, "y")]
    bridge = stories.merge_topics(known, spark.createDataFrame([(1, "old"), (1, "new")], "story_id long, topic string"))
    assert sorted(r["topic"] for r in bridge.collect()) == ["new", "old"]


def vectors(prompts: pd.Series) -> pd.Series:
    return prompts.map(lambda p: [1.0, 0.0, 0.1] if "storm" in p.lower() else [0.0, 1.0, 0.1 * (len(p) % 7)] if "match" in p.lower() else [0.0, 0.1 * (len(p) % 5), 1.0])


def answers(prompts: pd.Series) -> pd.Series:
    return prompts.map(lambda p: "4" if "Rate" in p else "Sports" if "Name every topic" in p and "match" in p.lower() else "US Politics" if "Name every topic" in p else "A headline")


def store(spark):
    return {t: schemas.empty(spark, t) for t in schemas.SCHEMAS}


def test_store_articles(spark):
    batch = [
        (1, "Storm hits", "text", "http://a.org/1?x", "A", None, "i"), (2, "Storm hits", "text", "http://a.org/1", "B", DAY, None), (3, "Storm ends", "", "http://b.org/2", None, DAY, None), (4, "A match", "m", "http://c.org/3", "A", DAY, None),
        (5, "Storm hits", "t", "http://d.org/4", "A", DAY, None), (6, None, "t", "http://d.org/5", "A", DAY, None), (7, "Merged pull request", "t", "http://d.org/6", "A", DAY, None), (8, "Code", "t", "https://github.com/x", "A", DAY, None),
    ]
    schema = "id long, title string, content string, url string, source_name string, published_at timestamp_ntz, image_url string"
    pages = spark.createDataFrame([("http://a.org/1", "<p>whole</p>", None, None, None), ("http://c.org/3", "please verify captcha", None, None, None)], "url string, plain string, browser string, archive string, crawler string")
    out = workflows.store_articles(spark.createDataFrame(batch, schema), store(spark), now(), pages, vectors, answers)
    got = {r["id"]: r for r in out["articles"].collect()}
    assert sorted(got) == [1, 3, 4] and [got[i]["story_id"] for i in (1, 3, 4)] == [1, 1, 4] and got[1]["content"] == "<p>whole</p>" and got[4]["content"] == "m" and got[3]["source"] == "Unknown"
    assert {r["name"]: r["bias_score"] for r in out["outlets"].collect()} == {"A": 4.0, "Unknown": 4.0} and got[1]["bias_score"] == 4.0
    assert {r["id"]: r["headline"] for r in out["stories"].collect()} == {1: "A headline", 4: None}
    assert sorted(map(tuple, out["article_topics"].collect())) == [(1, "US Politics"), (3, "US Politics"), (4, "Sports")] and [r["domain"] for r in out["scrape_blocklist"].collect()] == ["c.org"]
    again = workflows.store_articles(spark.createDataFrame([(20, "Storm again", "t", "http://e.org/1", "A", DAY, None), (21, "Storm hits", "t", "http://e.org/2", "A", DAY, None)], schema), store(spark) | out, now(), None, vectors, answers)
    assert ids(again["articles"]) == [1, 3, 4, 20] and again["articles"].filter("id = 20").first()["story_id"] == 1 and again["outlets"].count() == 2


def test_catch_up_and_rebuilds(spark):
    rows = [(i, f"{w} {i}", f"{w} " * 40 if i else "captcha", "S", f"http://s{i}.org/", 1, i, DAY, DAY, None, None, v, None) for i, (w, v) in enumerate([("storm", None), ("storm", [1.0, 0.0, 0.1]), ("match", None), ("storm", [1.0, 0.0, 0.2])])]
    s = store(spark)
    s["articles"] = spark.createDataFrame(rows, schemas.SCHEMAS["articles"]).withColumn("story_id", F.when(F.col("id") == 1, 3).otherwise(F.col("story_id")).cast("long"))
    s["stories"] = spark.createDataFrame([(i, f"t{i}", None, None, None, 1.0, DAY) for i in (0, 2, 3)], schemas.SCHEMAS["stories"])
    s["outlets"] = spark.createDataFrame([(1, "S", "u", "d", None)], schemas.SCHEMAS["outlets"])
    out = workflows.catch_up(s, now(), vectors, answers)
    a = {r["id"]: r for r in out["articles"].collect()}
    assert a[0]["content"] is None and a[1]["content"] and all(r["bias_score"] == 4.0 and r["embedding"] is not None for r in a.values())
    assert a[0]["story_id"] == 3 and a[2]["story_id"] == 2 and ids(out["stories"]) == [2, 3] and [r["domain"] for r in out["scrape_blocklist"].collect()] == ["s0.org"]
    assert {r["id"]: (r["headline"], r["summary"]) for r in out["stories"].collect()} == {2: (None, "A headline"), 3: ("A headline", "A headline")}
    assert [r["deep_report"] for r in workflows.write_reports(s, now(), answers)["stories"].filter("deep_report is not null").collect()] == ["A headline"]
    new = workflows.regroup(s, now(), vectors, answers)
    assert {r["id"]: r["story_id"] for r in new["articles"].collect()} == {0: 0, 1: 0, 2: 2, 3: 0} and {r["id"]: r["headline"] for r in new["stories"].collect()} == {0: "A headline", 2: None}
    assert sorted(map(tuple, new["story_topics"].collect())) == [(0, "US Politics"), (2, "Sports")]


def test_fetch(spark):
    p = [(7, "newsapi", "t", '{"articles":[{"title":"A match","url":"http://x.org/1","source":{"name":"S"}},{"title":"A storm","url":"http://x.org/2"}]}', DAY), (8, "gnews", "t", "broken", DAY)]
    out = workflows.fetch(spark.createDataFrame(p, schemas.SCHEMAS["raw_article_payloads"]), store(spark), now(), embed=vectors, ask=answers)
    assert sorted(r["title"] for r in out["articles"].collect()) == ["A match", "A storm"] and out["raw_article_payloads"].count() == 2
    assert all(r["summary"] == "A headline" for r in out["stories"].collect())


def test_landed_payloads(spark, tmp_path):
    p = spark.createDataFrame([(7, "newsapi", "t", "{}", DAY)], schemas.SCHEMAS["raw_article_payloads"])
    payloads.land(p, f"{tmp_path}/raw")
    payloads.land(p, f"{tmp_path}/raw")
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 2


def test_parsers_that_had_no_test(spark):
    one = spark.range(1)
    kinds = [["Sports", "US Politics"], ["Science/Technology"], ["Gaming"], ["Business/Finance"], ["Other"], []]
    got = [one.select(tx.analysis_type(F.array(*[F.lit(x) for x in k]).cast("array<string>"))).first()[0] for k in kinds]
    assert got == ["politics", "science", "gaming", "business", "default", "default"]
    summary = F.lit("The big picture: a\nWhy it matters: b\nWhat's happening: c\nWhat's next: d")
    assert tuple(one.select(tx.big_picture(summary), tx.whats_happening(summary)).first()) == ("a", "c")
