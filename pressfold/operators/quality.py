"""Scrape quality: bad-scrape verdicts, blocked domains and the suppression of flagged domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressfold.functions.similarity import char_counts, close_pairs, close_ratio, may_exceed
from pressfold.functions.text import contains_any, without_tags, without_tags_first
from pressfold.session import durable

# Phrases, domains and names that results must be judged by.
STRONG_SIGNS = (
    "unusual activity detected", "verify you are human", "enable javascript to continue", "you have been blocked",
    "access to this page has been denied", "please sign in to continue", "subscribe to continue reading",
    "please verify you're not a robot", "complete the security check", "captcha", "403 forbidden",
    "this content is for subscribers", "create a free account to read", "sign up to read", "your access to this article",
    "to continue reading, please", "this article is for paying subscribers",
)
WEAK_SIGNS = ("sign in", "log in", "subscribe", "premium content")
SKIPPED = ("youtube.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "tiktok.com")
BROWSER = ("bloomberg.com", "wsj.com", "ft.com", "nytimes.com", "washingtonpost.com", "theathletic.com", "wired.com")
CRAWLER = ("axios.com", "politico.com", "theatlantic.com", "thedailybeast.com", "businessinsider.com", "sfgate.com")
PAYWALLS = (
    "nytimes.com", "wsj.com", "ft.com", "washingtonpost.com", "theathletic.com", "bloomberg.com", "thetimes.co.uk",
    "economist.com", "newyorker.com", "foreignpolicy.com", "hbr.org", "seekingalpha.com", "barrons.com",
)
BLOCKED_SOURCES = ("github.com", "github.blog", "dev.to", "stackoverflow.com", "reddit.com", "npmjs.com", "pypi.org")
BLOCKED_TITLES = (
    "starred", "forked", "pull request", "merged", "repository", "npm package", "pypi", "added to pypi", "released on pypi",
    "week in review", "patch tuesday", "added to npm", "new release:", "changelog:", "box office", "box score", "game recap",
    "highlights:", "traded to", "signs with", "scores in",
)
SHORT_TEXT = 300


def bad_scrape(content: Column, text: Column | None = None) -> Column:
    """Why a scraped text is no article: the first strong sign, or a weak one in a short text; null if it is fine. ``text`` is ``content`` without tags, if that is at hand."""

    def reason(text: Column) -> Column:
        strong = [F.when(F.contains(text, F.lit(s)), F.lit(f"strong: {s}")) for s in STRONG_SIGNS]
        weak = [F.when((F.length(text) < SHORT_TEXT) & F.contains(text, F.lit(s)), F.concat(F.lit(f"weak: {s} in "), F.length(text).cast("string"))) for s in WEAK_SIGNS]
        return F.coalesce(*strong, *weak)

    # a list of one, so that tags are stripped once and not for every sign
    return F.when(content != "", F.transform(F.array(F.lower(without_tags(content) if text is None else text)), reason)[0])


def route(url: Column) -> Column:
    """How a page would be fetched."""
    return F.when(contains_any(url, SKIPPED), "skip").when(contains_any(url, BROWSER), "browser").when(contains_any(url, CRAWLER), "crawler").otherwise("default")


def accepted(title: Column, url: Column, normalized: Column) -> Column:
    """Rows that an ingest takes: title and url are there, neither source nor title is blocked."""
    there = (F.coalesce(title, F.lit("")) != "") & (F.coalesce(url, F.lit("")) != "")
    return there & ~contains_any(normalized, BLOCKED_SOURCES) & ~contains_any(title, BLOCKED_TITLES)


def blocklist(spark: SparkSession) -> DataFrame:
    """The permanent entries (domain, reason, is_permanent): 13 rows."""
    return spark.createDataFrame([(d, "hard paywall", True) for d in PAYWALLS], "domain string, reason string, is_permanent boolean")


def add_blocked(blocked: DataFrame, found: DataFrame) -> DataFrame:
    """``blocked`` with the first reason (by ord) of each new domain of ``found`` (domain, reason, ord)."""
    new = found.filter("domain <> ''").groupBy("domain").agg(F.min_by("reason", "ord").alias("reason")).join(blocked, "domain", "left_anti")
    return blocked.unionByName(new.withColumn("is_permanent", F.lit(False)))


def unblock(blocked: DataFrame, domain: str) -> DataFrame:
    """Without ``domain``, unless it is permanent."""
    return blocked.filter(F.col("is_permanent") | (F.col("domain") != domain))


def suppress_domains(rows: DataFrame, bad: Column, order: list[Column]) -> DataFrame:
    """``rows`` (domain, ...) with the column cleared: bad rows, and every row of a domain after a bad one.

    Nulls in ``order`` come last. Each domain's first bad place is joined back, so no domain's rows meet in one task.
    """
    place = F.struct(*[c for k, o in enumerate(order) for c in (o.isNull().alias(f"null_{k}"), o.alias(f"at_{k}"))])
    wrong = F.coalesce(bad, F.lit(False))
    first = rows.filter(wrong & (F.col("domain") != "")).groupBy("domain").agg(F.min(place).alias("_first"))
    return rows.join(first, "domain", "left").withColumn("cleared", wrong | F.coalesce(place > F.col("_first"), F.lit(False))).drop("_first")


def copy_pairs(rows: DataFrame, stored: DataFrame | None = None, last: int = 10, least: float = 0.85, chars: int | None = 2000, short: int = 100) -> DataFrame:
    """(id, other, ratio): rows (id, outlet, content) and those of the outlet's ``last`` highest other ids that they resemble.

    The first ``chars`` characters of texts are compared, or with none given whole texts. With ``stored`` the rows are incoming ones and
    meet the stored rows. A row meets ``last`` + 1 newest rows at most, so a large outlet costs no more a row than a small one. Lengths bound
    the ratio from above before a text is sent to Python; strings that both texts have and the longest common subsequence
    do before it is matched (see :mod:`pressfold.functions.similarity`).
    """

    def cut(df: DataFrame) -> DataFrame:
        return df.withColumn("text", without_tags(F.col("content")) if chars is None else without_tags_first(F.col("content"), chars)).drop("content")

    full = lambda df: df.filter("content <> ''").select("id", "outlet", "content")
    latest = full(rows if stored is None else stored).withColumn("n", F.row_number().over(Window.partitionBy("outlet").orderBy(F.desc("id"))))
    # written, so that the join below may send it whole or split a large outlet
    newest = durable(cut(latest.filter(F.col("n") <= last + 1)))
    pairs = cut(full(rows)).alias("x").join(newest.alias("y"), "outlet").filter("x.id <> y.id")
    # the row itself takes one place among the newest, if it is one of them
    own = newest.select(F.col("id").alias("own_id"), F.col("n").alias("own_n"))
    pairs = pairs.join(own, F.col("x.id") == F.col("own_id"), "left").filter((F.col("y.n") <= last) | F.col("own_n").isNotNull())
    a, b = F.length("x.text"), F.length("y.text")
    # both lengths in each condition: one that names a row's text alone would have its tags stripped twice
    close = pairs.filter((F.least(a, b) >= short) & (F.least(a, b) * 2 > (a + b) * least))
    return close.select(F.col("x.id").alias("id"), F.col("y.id").alias("other"), close_ratio(F.col("x.text"), F.col("y.text"), least).alias("ratio")).filter("ratio IS NOT NULL")


def near_copies(rows: DataFrame, stored: DataFrame | None = None, needed: int = 2, **rules: float) -> DataFrame:
    """(id, copies) of rows that resemble at least ``needed`` of their outlet's latest; see ``copy_pairs`` for the rules."""
    return copy_pairs(rows, stored, **rules).groupBy("id").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") >= needed)


def _place() -> Column:
    """Where a row stands in the order of an audit."""
    return F.struct(F.col("outlet").isNull().alias("last"), F.col("outlet").alias("outlet"), F.col("id").alias("id"))


def audit(rows: DataFrame, last: int = 10, least: float = 0.85, needed: int = 2) -> DataFrame:
    """(outlet, id) of the rows (id, outlet, domain, content) whose content a retroactive audit clears.

    In the order (outlet, id) a row is cleared if it is a bad scrape, follows a cleared row of its domain, or resembles ``needed`` of
    the ``last`` newest other rows of its outlet that have a content then; a cleared row makes room for an older one.
    Only the ``last`` newest rows of an outlet look back on rows that were scanned before them, so all others are judged at once.
    A verdict rests on earlier ones only, so repeating the rule until nothing changes gives the verdicts of the ordered scan; rounds
    follow the longest chain of verdicts, and pairs of texts are compared once.
    """
    base = durable(rows.filter("content <> ''").select("outlet", "id", "domain", bad_scrape(F.col("content")).isNotNull().alias("bad"), _place().alias("place"), without_tags_first(F.col("content"), 2000).alias("text")).withColumn("counts", char_counts(F.col("text"))))
    latest = Window.partitionBy("outlet").orderBy(F.desc("id"))
    newest = durable(base.withColumn("n", F.row_number().over(latest)).filter(F.col("n") <= last).select("outlet", "id", "n", "text", "counts"))

    def alike(pairs: DataFrame) -> DataFrame:
        """(id, other) of those pairs (id, x, x_counts, other, y, y_counts) that resemble each other."""
        a, b = F.length("x"), F.length("y")
        able = pairs.filter((F.least(a, b) >= 100) & (F.least(a, b) * 2 > (a + b) * least) & may_exceed(F.col("x_counts"), F.col("y_counts"), least))
        return durable(able.select("id", "other", close_ratio(F.col("x"), F.col("y"), least).alias("ratio")).filter("ratio IS NOT NULL").select("id", "other"))

    def texts(of: DataFrame, k: str, t: str) -> list[Column]:
        return [of["id"].alias(k), of["text"].alias(t), of["counts"].alias(f"{t}_counts")]

    old = base.join(newest.select("id"), "id", "left_anti")
    seen = newest.select(F.col("outlet").alias("of"), *texts(newest, "other", "y"))
    close = alike(old.select("outlet", *texts(old, "id", "x")).join(seen, F.col("outlet").eqNullSafe(F.col("of"))))
    copied = close.groupBy("id").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") >= needed)
    settled = durable(base.select("outlet", "id", "domain", "place", "bad").join(copied.select("id", F.lit(True).alias("copied")), "id", "left").withColumn("bad", F.col("bad") | F.coalesce("copied", F.lit(False))).drop("copied"))

    now, known, near = settled.withColumn("cleared", F.col("bad")), None, None
    back = Window.partitionBy("id").orderBy(F.desc("other"))
    while True:
        alive = now.filter(~F.col("cleared"))
        older = alive.join(newest.select("id"), "id", "left_anti").withColumn("n", F.row_number().over(latest)).filter(F.col("n") <= last).select("outlet", "id")
        pool = newest.select("outlet", "id").join(now.select("id", "cleared"), "id").select(F.col("outlet").alias("of"), F.col("id").alias("other"), "cleared")
        pool = pool.unionByName(older.select(F.col("outlet").alias("of"), F.col("id").alias("other"), F.lit(False).alias("cleared")))
        views = newest.select("outlet", "id").join(pool, F.col("outlet").eqNullSafe(F.col("of"))).filter((F.col("id") != F.col("other")) & (~F.col("cleared") | (F.col("other") > F.col("id"))))
        views = durable(views.withColumn("n", F.row_number().over(back)).filter(F.col("n") <= last).select("id", "other"))
        fresh = views if known is None else views.join(known, ["id", "other"], "left_anti")
        found = alike(fresh.join(base.select(*texts(base, "id", "x")), "id").join(base.select(*texts(base, "other", "y")), "other"))
        near = found if near is None else near.unionByName(found)
        known = fresh if known is None else durable(known.unionByName(fresh))
        copies = views.join(near, ["id", "other"]).groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
        wrong = F.col("bad") | (F.coalesce("copies", F.lit(0)) >= needed)
        step = settled.join(copies, "id", "left").join(now.select("id", F.col("cleared").alias("before")), "id")
        first = now.filter("cleared AND domain <> ''").groupBy("domain").agg(F.min("place").alias("first"))
        step = durable(step.join(first, "domain", "left").withColumn("cleared", wrong | F.coalesce(F.col("place") > F.col("first"), F.lit(False))).drop("first", "copies"))
        if not step.filter("before <> cleared").take(1):
            return step.filter("cleared").select("outlet", "id")
        now = step.drop("before")


def _alike(texts: DataFrame, asking: DataFrame, least: float, needed: int, chars: int) -> DataFrame:
    """(key, other) of those of ``texts`` (of, strip, part, key, n, text) that have a key of ``asking`` and the others of their outlet that they resemble.

    Texts meet by outlet and strip of lengths, about ``chars`` characters of either side in a task; lengths more than one strip apart cannot resemble each other.
    """
    near = F.explode(F.array(F.col("strip") - 1, F.col("strip"), F.col("strip") + 1)).alias("strip")
    meant = lambda *c: texts.join(asking, "key", "left_semi").select("of", "key", near, *c)
    parts = texts.groupBy("of", "strip").agg((F.max("part") + 1).alias("parts"))
    blocks = meant("n").groupBy("of", "strip").agg(F.ceil(F.sum("n") / chars).cast("int").alias("meant_parts"))
    blocks = durable(blocks.join(parts, ["of", "strip"]))
    by = ["of", "strip", "part", "meant_part"]
    x = meant("text").join(blocks, ["of", "strip"]).withColumn("meant_part", F.pmod(F.xxhash64("key"), "meant_parts").cast("int"))
    x = x.select("of", "strip", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "meant_part", "key", "text")
    y = texts.join(blocks, ["of", "strip"]).select("of", "strip", "part", F.explode(F.sequence(F.lit(0), F.col("meant_parts") - 1)).alias("meant_part"), "key", "text")
    kind = dict(texts.dtypes)["key"]
    x, y = x.toDF(*x.columns), y.toDF(*y.columns)  # columns of their own, as both come from ``texts``
    found = y.groupBy(*by).cogroup(x.groupBy(*by)).applyInArrow(lambda others, asked: close_pairs(others, asked, least, needed), f"key {kind}, other {kind}")
    return durable(found)


def audit_outlets(rows: DataFrame, least: float = 0.85, needed: int = 2, short: int = 100, first: int = 64, growth: int = 4, chars: int = 1 << 21) -> DataFrame:
    """(outlet, id) of the rows (id, outlet, domain, content) whose content an audit clears that looks back on whole outlets and whole texts.

    As ``audit``, but a row is compared with all other rows of its outlet that have a content then, and not with the newest of them.
    Equal texts of an outlet are one class: of its rows only the ``needed`` newest are in question, as older ones have these as copies. A row that an earlier one
    of its domain clears needs no comparison. So the first ``first`` rows of each outlet that nothing clears so far are compared with the outlet, verdicts
    follow, and the next ``growth`` times as many are taken, until every row that is left has been compared. A verdict rests on earlier ones only, so these
    are the verdicts of the ordered scan. Where nothing is cleared, all texts of an outlet of like lengths meet in the end.
    """
    base = rows.filter("content <> ''").select("outlet", "id", "domain", _place().alias("place"), "content", without_tags(F.col("content")).alias("text"))
    base = base.withColumns({"bad": bad_scrape(F.col("content"), F.col("text")).isNotNull(), "hash": F.sha2(F.col("text").cast("binary"), 256), "n": F.length("text")})
    base = durable(base.drop("content"))
    same = Window.partitionBy("outlet", "hash")
    members = base.filter(F.col("n") >= short).select("outlet", "id", "hash", "n").withColumn("k", F.row_number().over(same.orderBy(F.desc("id")))).filter(F.col("k") <= needed)
    members = durable(members.select("outlet", "id", "n", F.max("id").over(same).alias("key")))
    now = base.select("outlet", "id", "domain", "place", "bad", "n").join(members.select("id", F.lit(True).alias("newest")), "id", "left")
    now = now.select("outlet", "id", "domain", "place", (F.col("bad") | ((F.col("n") >= short) & F.col("newest").isNull())).alias("wrong"))

    # a struct, so that rows without an outlet are one
    heads = members.filter("id = key").select(F.struct("outlet").alias("of"), "key", "n", F.floor(F.log("n") / F.log(F.lit((2 - least) / least))).cast("int").alias("strip"))
    sizes = heads.groupBy("of", "strip").agg(F.ceil(F.sum("n") / chars).alias("parts"))
    texts = base.select(F.col("id").alias("key"), "text").join(heads.join(sizes, ["of", "strip"]), "key")
    texts = durable(texts.select("of", "strip", F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"), "key", "n", "text"))

    def links(pairs: DataFrame) -> DataFrame:
        """(id, other, later) for the rows of pairs of classes (key, other)."""
        x, y = members.select("key", "id"), members.select(F.col("key").alias("other"), F.col("id").alias("other_id"))
        met = pairs.join(x, "key").join(y, "other").filter("id <> other_id")
        return durable(met.select("id", F.col("other_id").alias("other"), (F.col("other_id") > F.col("id")).alias("later")))

    def judged(now: DataFrame, known: DataFrame) -> DataFrame:
        """``now`` after the rule has been repeated until nothing changes."""
        while True:
            there = known.join(now.select(F.col("id").alias("other"), "cleared"), "other").filter("later OR NOT cleared")
            copies = there.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
            flagged = now.filter("cleared AND domain <> ''").groupBy("domain").agg(F.min("place").alias("flagged"))
            step = now.withColumnRenamed("cleared", "before").join(copies, "id", "left").join(flagged, "domain", "left")
            cleared = F.col("wrong") | (F.coalesce("copies", F.lit(0)) >= needed) | F.coalesce(F.col("place") > F.col("flagged"), F.lit(False))
            step = durable(step.select("outlet", "id", "domain", "place", "wrong", "before", cleared.alias("cleared")))
            now = step.drop("before")
            if not step.filter("before <> cleared").take(1):
                return now

    now = durable(now.withColumn("cleared", F.col("wrong")))
    known = links(members.filter("id = key").select("key", F.col("key").alias("other")))
    asked, order = members.limit(0).select("key"), Window.partitionBy("outlet").orderBy("id")
    while True:
        now = judged(now, known)
        left = now.filter("NOT cleared").select("id").join(members, "id").join(asked, "key", "left_anti")
        todo = durable(left.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= first).select("key").distinct())
        if not todo.take(1):
            return now.filter("cleared").select("outlet", "id")
        known = known.unionByName(links(_alike(texts, todo, least, needed, chars)))
        asked, first = asked.unionByName(todo), first * growth
