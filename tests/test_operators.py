import difflib
import random
import string

import pytest
from pyspark.sql import functions as F

from pressfold.operators import quality, stories
from pressfold.plans import registry
from pressfold.sources import payloads


def test_bad_scrape(spark):
    rows = [("x" * 400 + " Captcha",), ("subscribe " + "y" * 288,), ("subscribe " + "y" * 290,), ("fine",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(quality.bad_scrape(F.col("x"))).collect()]
    assert got == ["strong: captcha", "weak: subscribe in 298", None, None, None, None]


def test_domains(spark):
    rows = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "a", False), (4, "", True), (5, "", False)], "id int, domain string, bad boolean")
    got = {r["id"]: r["cleared"] for r in quality.suppress_domains(rows, F.col("bad"), [F.col("id")]).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: False}
    blocked = quality.add_blocked(quality.blocklist(spark), spark.createDataFrame([("z.org", "late", 2), ("z.org", "first", 1), ("ft.com", "x", 1)], "domain string, reason string, ord int"))
    assert blocked.filter("domain = 'z.org'").first()["reason"] == "first" and blocked.count() == 14
    assert quality.unblock(quality.unblock(blocked, "z.org"), "ft.com").count() == 13


def greedy(rows, surplus):
    by_u, by_t, size, gone = {}, {}, {}, set()
    for i, u, t, o, n in sorted(rows):
        size[i] = n or 0
        first = by_u.get(u, by_t.get((t, o)))
        if first is None:
            by_u[u] = by_t[t, o] = i
        else:
            gone.add(first if size[i] > size[first] + surplus else i)
    return {r[0] for r in rows} - gone


def test_greedy_dedup(spark):
    schema = "id long, url string, title string, outlet string, content_length int"
    rnd = random.Random(3)
    for rows in ([(1, "u1", "t1", None, 100), (2, "u2", "t1", None, 601), (3, "u2", "t3", None, 1)], [(i, f"u{rnd.randrange(30)}", f"t{rnd.randrange(30)}", rnd.choice(["a", None]), rnd.randrange(2000)) for i in range(60)]):
        got = {r[0] for r in stories.greedy_dedup(spark.createDataFrame(rows, schema)).collect()}
        assert got == greedy(rows, 500)
    assert stories.greedy_dedup(spark.createDataFrame([], schema)).count() == 0


def test_shown_articles(spark):
    schema = "story_id int, id int, title string, outlet_id int, outlet string, date date, content_length int"
    import datetime as dt

    d = dt.date(2024, 1, 1)
    rows = [(1, 1, "a", 1, "Paper", d, 501), (1, 2, "b", 2, "Yahoo News UK", d, 900), (2, 3, "a", 1, "Paper", d, 500), (2, 4, "b", 2, "Yahoo News UK", d, 9), (2, 5, "a", 1, "Paper", None, 9)]
    got = [(r["story_id"], r["id"]) for r in stories.shown_articles(spark.createDataFrame(rows, schema)).orderBy("story_id", "position").collect()]
    assert got == [(1, 1), (2, 3), (2, 4)]


def test_assignment(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01]), (4, [1.0, 1.0]), (5, None), (6, [0.0, 0.0])]
    got = dict(stories.assign_stories(spark.createDataFrame(rows, "id long, embedding array<float>"), 0.7).collect())
    assert got[3] == 1 and got[2] == 2 and got[4] == 1 and got[5] == 5 and got[6] == 6


def test_payloads(spark):
    rows = [(1, "newsapi", '{"articles":[{"title":"a","url":"http://x/1?q","source":{"name":"S"},"publishedAt":"2024-01-02T03:04:05Z","urlToImage":"i"},{"title":"b"}]}'), (2, "gnews", '{"articles":[{"title":"c","description":"d","image":"j","url":"http://x/1"}]}'), (3, "newsapi", "broken"), (4, "newsapi", '{"articles":[]}')]
    got = payloads.articles(spark.createDataFrame(rows, "id int, source string, payload string"), F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")))
    assert [(r["title"], r["content"], r["source_name"], r["image_url"], r["published_at"].day) for r in got.orderBy("id", "pos").collect()] == [("a", "", "S", "i", 2), ("b", "", "Unknown", None, 1), ("c", "d", "Unknown", "j", 1)]
    stored = spark.createDataFrame([("http://x/1", ""), ("http://x/1", "k"), ("http://y", None)], "url string, image_url string")
    assert sorted((r["url"], r["image_url"]) for r in payloads.backfill_images(stored, got).filter("image_url is not null").collect()) == [("http://x/1", "i"), ("http://x/1", "k")]


def test_near_copies_and_audit(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "o", base + f" tail{i}") for i in range(3)] + [(9, "o", " ".join(f"else{i}" for i in range(60))), (10, "p", base)]
    assert sorted(r["id"] for r in quality.near_copies(spark.createDataFrame(rows, "id long, outlet string, content string")).collect()) == [0, 1, 2]


def some_words(rnd, n):
    """Words of letters and, seldom, of the capitals and digits at which the matcher begins."""
    return " ".join("".join(rnd.choices(string.ascii_lowercase * 12 + string.ascii_uppercase + string.digits, k=6)) for _ in range(n))


def test_near_copies_of_documents_are_judged_by_whole_texts(spark, tmp_path):
    """Outlet a: the same beginning, then texts of their own; outlet b: beginnings of their own, then the same text; outlet c: whole near copies."""
    rnd = random.Random(8)
    same, docs = {o: some_words(rnd, 400) for o in "ac"} | {"b": some_words(rnd, 2500)}, []
    for i in range(9):
        o = "abc"[i % 3]
        text = {"a": lambda: f"{same['a']} {some_words(rnd, 900)}", "b": lambda: f"{some_words(rnd, 300)} {same['b']}", "c": lambda: f"{same['c']} {some_words(rnd, 20)}"}[o]()
        docs.append((i, text, "en", o, len(text)))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: n for i, t, _, o, _ in docs if (n := sum(difflib.SequenceMatcher(None, t, u).ratio() > 0.85 for j, u, _, p, _ in docs if p == o and j != i)) >= 2}
    assert sorted(want) == [1, 2, 4, 5, 7, 8]
    assert dict(registry.QUERIES["document_near_copies"](spark, str(tmp_path)).collect()) == want


def scan(rows):
    """The ordered scan itself, over contents."""
    content = {i: c for i, *_, c in rows if c}
    outlet_of, flagged, gone = {i: o for i, o, *_ in rows}, set(), set()
    for i, outlet, domain, c in sorted(rows, key=lambda r: (r[1], r[0])):
        if not c:
            continue
        recent = sorted((j for j in content if outlet_of[j] == outlet and j != i), reverse=True)[:10]
        alike = sum(len(c) >= 100 and len(content[j]) >= 100 and difflib.SequenceMatcher(None, c, content[j]).ratio() > 0.85 for j in recent)
        if domain in flagged or "captcha" in c or alike >= 2:
            gone.add(i)
            del content[i]
            if domain:
                flagged.add(domain)
    return gone


def test_audit_is_the_scan(spark):
    """Cleared rows make room for older ones among an outlet's latest."""
    rnd = random.Random(5)
    walls = [" ".join(f"wall{k}x{j}" for j in range(30)) for k in range(4)]
    rows = []
    for i in range(150):
        text = rnd.choice(walls) + f" {i}" if rnd.random() < 0.4 else " ".join(f"word{rnd.randrange(10**6)}" for _ in range(25))
        text = rnd.choice([text] * 12 + ["", None, "short", text + " captcha"])
        rows.append((i, f"o{i % 4}", rnd.choice(["", "", "", f"d{i % 11}"]), text))
    want = scan(rows)
    got = quality.audit(spark.createDataFrame(rows, "id long, outlet string, domain string, content string")).collect()
    assert {r["id"] for r in got} == want and len(want) > 20


def scan_whole(rows):
    """The ordered scan that looks back on all of an outlet."""
    outlet_of, content = {i: o for i, o, *_ in rows}, {i: c for i, *_, c in rows if c}
    alike, flagged, gone = {}, set(), set()
    for i, outlet, domain, c in sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0])):
        if c and (domain in flagged or "captcha" in c or sum(len(c) >= 100 and len(d) >= 100 and difflib.SequenceMatcher(None, c, d).ratio() > 0.85 for j, d in content.items() if j != i and outlet_of[j] == outlet) >= 2):
            gone.add(i)
            del content[i]
            flagged |= {domain} - {"", None}
    return gone


@pytest.mark.parametrize("first, chars", [(6, 3000), (64, 1 << 21)])
def test_audit_of_whole_outlets_is_the_scan(spark, first, chars):
    """Copies far from the newest ones, equal ones among them, and rows that a domain or an earlier verdict decides on."""
    rnd = random.Random(11)
    walls = [some_words(rnd, rnd.choice([16, 25, 60])) for _ in range(12)]
    rows = []
    for i in range(150):
        text = rnd.choice(walls) + rnd.choice(["", f" {i}", f" {i} {i}"]) if rnd.random() < 0.5 else " ".join(f"word{rnd.randrange(10**6)}" for _ in range(rnd.choice([12, 25, 33])))
        text = rnd.choice([text] * 12 + ["", None, "short", text + " captcha"])
        rows.append((i, rnd.choice(["a", "a", "b", "c", None]), rnd.choice(["", "", "", None, f"d{rnd.randrange(25)}"]), text))
    want = scan_whole(rows)
    got = quality.audit_outlets(spark.createDataFrame(rows, "id long, outlet string, domain string, content string").repartition(3), first=first, growth=3, chars=chars)
    assert {r["id"] for r in got.collect()} == want
    assert 20 < len(want) < 130 and len(want - scan([r for r in rows if r[1]])) > 10


def test_retroactive_audit_meets_older_documents(spark, tmp_path):
    """Three copies, the newest of them before the outlet's ten newest, which all differ; copies only beyond the beginnings in another outlet."""
    rnd = random.Random(12)
    wall, tail = some_words(rnd, 40), some_words(rnd, 2300)
    docs = [(i, f"{wall} {i}" if i in (2, 3, 4) else some_words(rnd, 40), "en", "a", 1) for i in range(20)]
    docs += [(20 + i, f"{some_words(rnd, 300)} {tail}" if i in (1, 2, 3) else some_words(rnd, 40), "en", "b", 1) for i in range(16)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, registry.QUERIES["retroactive_audit"](spark, str(tmp_path)).collect()))
    assert got == [("a", i) for i in range(2, 20)] + [("b", i) for i in range(21, 36)]


def test_copies_of_incoming(spark):
    base = " ".join(f"word{i}" for i in range(60))
    schema = "id long, outlet string, content string"
    stored = spark.createDataFrame([(1, "o", base + " a"), (2, "o", base + " b"), (3, "p", base)], schema)
    new = spark.createDataFrame([(10, "o", base), (11, "p", base), (12, "o", None), (13, None, base)], schema)
    assert [r["id"] for r in quality.near_copies(new, stored).collect()] == [10]


def test_first_in_batch_wins(spark):
    schema = "ord int, url string, title string, outlet string"
    rows = [(1, "u1", "t1", "o"), (2, "u2", "t1", "o"), (3, "u2", "t3", "o"), (4, "u1", "t4", "o"), (5, "u5", "t1", "p")]
    got = payloads.new_articles(spark.createDataFrame(rows, schema), spark.createDataFrame([], schema))
    assert sorted(r["ord"] for r in got.collect()) == [1, 3, 5]


def test_assignment_ties_copies_known_judge(spark):
    schema = "id long, embedding array<float>"
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0])] + [(k, [1.0, 0.0]) for k in range(3, 40)] + [(50, [1.0, 1.0]), (51, [3.0, 0.0])]
    v = spark.createDataFrame(rows, schema)
    got = dict(stories.assign_stories(v, 0.7).collect())
    assert {got[k] for k in range(3, 40)} == {1} and got[50] == 1 and got[51] == 1 and got[2] == 2
    none = dict(stories.assign_stories(v, 0.9, 0.6).collect())
    assert none[50] == 50
    asked = dict(stories.assign_stories(v, 0.9, 0.6, lambda pairs: pairs.filter("other = 2")).collect())
    assert asked[50] == 2
    known = dict(stories.assign_stories(v, 0.9, known=spark.createDataFrame([(1, -7), (2, -8)], "id long, story long")).collect())
    assert known[1] == -7 and known[20] == -7 and known[2] == -8 and known[50] == 50


def test_merge_of_singles(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, [0.9, 0.1]), (2, 3, [1.0, 0.05]), (3, 4, [0.0, 1.0]), (4, 5, None)]
    a = spark.createDataFrame(rows, "story_id long, id long, embedding array<float>")
    merges = stories.merge_singles(a)
    assert [tuple(r) for r in merges.collect()] == [(2, 1)]
    bridge = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, "z")], "story_id long, topic string")
    assert sorted(map(tuple, stories.apply_merges(bridge, merges).collect())) == [(1, "x"), (1, "y"), (3, "z")]


def test_stream(spark, tmp_path):
    from pressfold.streaming.ingest import ingest

    schema = "ord int, url string, title string, outlet string"
    empty = spark.createDataFrame([], schema)
    for k, rows in enumerate([[(1, "http://x/1?a", "t", "o"), (2, "http://x/1", "t2", "o")], [(3, "http://x/1", "t3", "o"), (4, "http://x/2", "t", "o"), (5, "http://x/3", "n", "o")]]):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        ingest(stream, f"{tmp_path}/out", f"{tmp_path}/cp", lambda b: b, empty).awaitTermination(120)
    assert sorted(r["ord"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 5]
