"""Ingest with keyed state: equals the scan over all rows, and a batch's work follows the batch."""

import random

from pressfold.streaming.ingest import keep_up

SCHEMA = "ord long, url string, title string, outlet string"


def scan(rows):
    urls, titles, out = set(), set(), []
    for o, url, title, outlet in rows:
        url = url.split("?")[0]
        if url not in urls and (title, outlet) not in titles:
            urls.add(url)
            titles.add((title, outlet))
            out.append(o)
    return out


def test_state_equals_the_scan(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, f"http://x.org/{rnd.randrange(60)}?q={i}", f"t{rnd.randrange(70)}" if rnd.random() < 0.9 else None, rnd.choice("ab")) for i in range(160)]
    rows[:3] = [(0, "http://x.org/u1", "same", "a"), (1, "http://x.org/u2", "same", "a"), (2, "http://x.org/u2", "other", "a")]  # the second holds no url
    where = lambda n: f"{tmp_path}/{n}"
    at = 0
    for k, n in enumerate((1, 1, 60, 58, 40)):
        spark.createDataFrame(rows[at : at + n], SCHEMA).coalesce(1).write.parquet(where(f"in/{k}"))
        at += n
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(where("in/*"))
        if k in (1, 3, 4):  # two files at once, or one
            query = keep_up(stream, where("out"), where("cp"), lambda b: b)
            assert sorted(r["ord"] for r in spark.read.parquet(where("out")).collect()) == scan(rows[:at])
    stored = spark.read.parquet(where("out")).count()
    read = [sum(s["numInputRows"] for s in p["sources"]) for p in query.recentProgress]
    assert sum(read) < 40 + stored  # this run's batch and what it kept, not the history
    keep_up(spark.readStream.schema(SCHEMA).parquet(where("in/*")), where("out"), where("cp"), lambda b: b)
    assert spark.read.parquet(where("out")).count() == stored
