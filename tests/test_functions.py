from pyspark.sql import functions as F

from pressfold.functions import html, models
from pressfold.functions import text as tx


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_urls(spark):
    assert one(spark, tx.normalize_url, "HTTP://Ex.com/a;p?q#f", "https://x.org/a/b/", None) == ["http://Ex.com/a", "https://x.org/a/b/", None]
    assert one(spark, tx.domain, "https://www.A.com:80/x", "no url", None) == ["a.com:80", "", ""]


def test_html(spark):
    assert one(spark, tx.strip_html, "<p>&amp;lt; b</p>  c", None, "a&nbsp;b") == ["< b c", "", "a b"]


def test_titles(spark):
    got = one(spark, tx.clean_title, "A - B C D E", "A - B C D E F", "a - b | c", " ".join(["w"] * 31))
    assert got == ["A", "A - B C D E F", "a", " ".join(["w"] * 30) + "..."]


def test_bias(spark):
    assert one(spark, tx.bias_score, "3", " 3 ", "6", "4.", "Unknown", None) == [3, 3, None, None, None, None]
    df = spark.createDataFrame([(None,), (2.0,), (2.5,), (3.0,), (4.0,)], "x double")
    assert [r[0] for r in df.select(tx.bias_bucket(F.col("x"))).collect()] == ["unrated", "left", "right", "center", "right"]


def test_responses(spark):
    assert one(spark, tx.topic_labels, "sports\nGaming and Other", "none", None) == [["Sports", "Gaming"], ["Other"], ["Other"]]
    assert one(spark, lambda c: tx.match_choice(c, 3), "story 9 no 2", "0", "none") == [2, 0, None]
    assert one(spark, tx.headline, '"Big news"', "", " ".join(["w"] * 21)) == ["Big news", None, None]
    assert one(spark, lambda c: tx.between_markers(c, "What's happening:", "What's next:"), "a What's happening: b What's next: c", "a", "What's happening: z") == ["b", None, "z"]


def test_sections(spark):
    report = "Intro\nWhat happened:\n A thing. \nMarket impact: none\nWhy it matters: x"
    assert one(spark, tx.the_story, report, "The story: all", "none", None, "") == ["A thing.", "all", None, None, None]
    assert one(spark, tx.whats_happening, "What's happening:\nb\nWhat's next: c") == ["b"]
    lines = [[tuple(x) for x in r] for r in one(spark, lambda c: tx.section_lines(c, 30, True), "Why: so: it\n\n• a: b\nplain", None)]
    assert lines == [[("label", "Why", "so: it"), ("bullet", None, "a: b"), ("para", None, "plain")], []]
    assert one(spark, tx.persona, "gaming", "other", None) == ["gaming journalist", "professional news analyst", "professional news analyst"]
    assert one(spark, tx.guessed_title, "A b: c - d", "A-b", "a b c d e f g", None) == ["A b", "A", "a b c d e f", None]
    df = spark.createDataFrame([(None,), (0.0,), (2.9,), (5.0,)], "x double")
    assert [r[0] for r in df.select(tx.outlet_label(F.col("x"))).collect()] == [None, None, "Lean Left", "Right"]


def test_sanitized(spark):
    page = '<div onclick="x"><p class="c">A &amp; <b>b</b><script>var x</script><!-- no --><a href="javascript:1" title="t">l</a><img src="/i.png" onerror="e"></div>'
    assert one(spark, html.sanitize, page, "", None) == ['<p>A &amp; <b>b</b>var x<a title="t">l</a><img src="/i.png"></p>', "", None]
    deep = "<div>" * 20000 + "x" + "</b></div>" * 20000
    assert one(spark, html.sanitize, deep) == ["x"]


def test_article(spark):
    body = "".join(f"<p>Sentence {i}, with words that say something, at length.</p>" for i in range(6))
    links = "<ul>" + "".join(f'<p><a href="/{i}">A link that has many words in it, and commas, too</a></p>' for i in range(30)) + "</ul>"
    got = one(spark, html.article_html, f"<nav>{links}</nav><div id=x>{body}</div><div>{links}</div><footer>f</footer>", "<p>short</p>", f'<div class="a story-body">{"word " * 60}</div>', "", None)
    assert got[0] == body and got[1] is None and got[2] == "word " * 60 and got[3] is None and got[4] is None
    df = spark.createDataFrame([("<p>s</p>", "o"), (None, "a<script>b</script>"), (None, ""), (None, None)], "s string, o string")
    assert [r[0] for r in df.select(html.scraped_content(F.col("s"), F.col("o"))).collect()] == ["<p>s</p>", "ab", "", ""]


def test_models(spark):
    def answers(prompts):
        return prompts.map(lambda p: "Gaming\nOther" if "Name every topic" in p else " 4 " if "political leaning" in p else "1")

    df = spark.createDataFrame([("t", "c"), (None, None)], "t string, c string")
    t, c = F.col("t"), F.col("c")
    got = df.select(models.topics(t, c, answers), models.article_bias(t, c, answers), models.same_story(t, c, t, c, answers), models.story_headline(t, answers), models.deep_report(F.lit("gaming"), c, answers)).collect()
    assert [tuple(r) for r in got] == [(["Gaming"], 4, True, "1", "1"), (["Gaming"], 4, True, None, None)]
    none = df.select(models.topics(t, c, None), models.same_story(t, c, t, c, None), models.story_summary(F.lit("x"), c, None), models.embedding(t, c, None)).first()
    assert tuple(none) == (["Other"], False, None, None)
    assert df.select(models.embedding(t, c, lambda p: p.map(lambda x: [1.0, 2.0]))).first()[0] == [1.0, 2.0]
