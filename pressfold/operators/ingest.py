"""What a batch of scraped articles leaves in the store: earlier rows of the batch decide on later ones.

In the order of ids a row's page is not fetched if its domain is blocked: by the blocklist, or by an earlier row of
the batch. A fetched text that is a bad scrape, or resembles several of the outlet's latest contents (stored ones and those that
earlier rows of the batch have got by then), is thrown away and blocks its domain. What is thrown away or was never there is replaced
by the content that came with the article.

A verdict rests on earlier rows only. So repeating the rule for all rows at once, until nothing changes, gives the verdicts of
the ordered scan; rounds follow the longest chain of rows that decide on each other, and judge only what comes after a change. Each pair of
texts is compared once, in whichever round it first comes up.

A large batch is settled in spans of ids, each longer than the one before. What a span leaves to the next is small: the domains that it blocked and each outlet's
latest contents. So pages of a domain that was blocked early are never compared. Joins are sorted ones: the tables that rounds write compress so well that
their size on disk would have them sent whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressfold.functions.similarity import char_counts, close_ratio, may_exceed
from pressfold.functions.text import without_tags_first
from pressfold.operators.rows import marked_before, placed
from pressfold.session import durable


def _sorted(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not send it whole."""
    return df.hint("merge")


def _latest(contents: DataFrame, last: int) -> DataFrame:
    """The ``last`` highest ids of each outlet, with their number n from the highest on."""
    return contents.withColumn("n", F.row_number().over(Window.partitionBy("outlet").orderBy(F.desc("id")))).filter(F.col("n") <= last)


def _spans(batch: DataFrame, first: int, growth: int) -> list[Column]:
    """Conditions on id that cut the batch into spans in the order of ids: about ``first`` rows, then ``growth`` times as many as before in all."""
    count = batch.count()
    shares, share = [], max(first / max(count, 1), 1e-3)
    while share < 1:
        shares.append(share)
        share *= growth
    cuts = sorted(set(batch.agg(F.percentile_approx("id", shares).alias("cuts")).head()["cuts"])) if shares else []
    above = [F.lit(True), *[F.col("id") > c for c in cuts]]
    below = [*[F.col("id") <= c for c in cuts], F.lit(True)]
    return [a & b for a, b in zip(above, below, strict=True)]


def settle(
    batch: DataFrame, stored: DataFrame, blocked: DataFrame, last: int = 10, least: float = 0.85, needed: int = 2, chars: int = 2000, short: int = 100, first: int = 20_000, growth: int = 4
) -> DataFrame:
    """(id, content, taken, reason, copies) of the rows of ``batch`` (id, outlet, domain, found, bad, given).

    ``found`` is what the page gave (null: nothing), ``bad`` why it is a bad scrape (or null), ``given`` the content that came
    with the article. ids are numbers that ascend with arrival and are above those of ``stored`` (id, outlet, content). ``blocked`` has the blocked domains.
    ``taken`` says that ``found`` is the content; ``reason`` is why the row blocks its domain, ``copies`` how many contents it resembled.
    The first span of ids has about ``first`` rows; each further one ends at ``growth`` times as many (see above).
    """
    hosts = blocked.select("domain")
    newest = _latest(stored.filter("content <> ''").select("id", "outlet", "content"), last).drop("n")
    newest = durable(newest.join(_sorted(batch.select("outlet").distinct()), "outlet", "left_semi"))
    done, spans = None, _spans(batch, first, growth)
    for k, span in enumerate(spans):
        rows = batch.filter(span)
        now = _settled(rows, newest, hosts, last, least, needed, chars, short, k == 0).select("id", "outlet", "domain", "bad", "fallback", "flagged", "taken", "copies")
        done = now if done is None else done.unionByName(now)
        if k + 1 < len(spans):
            latest = _latest(now.filter("taken OR fallback").select("id", "outlet", "taken"), last)
            left = _sorted(rows.select("id", "found", "given")).join(latest, "id").select("id", "outlet", F.when(F.col("taken"), F.col("found")).otherwise(F.col("given")).alias("content"))
            newest = durable(_latest(newest.unionByName(left), last).drop("n"))
            hosts = durable(hosts.unionByName(now.filter("flagged AND domain <> ''").select("domain")).distinct())
    reason = F.when(F.col("flagged"), F.coalesce(F.col("why"), F.concat(F.lit("near copies: "), F.col("copies").cast("string"))))
    out = _sorted(done).join(batch.select("id", "found", "given", F.col("bad").alias("why")), "id")
    return out.select("id", F.when(F.col("taken"), F.col("found")).otherwise(F.col("given")).alias("content"), "taken", reason.alias("reason"), F.when(F.col("bad"), 0).otherwise(F.col("copies")).cast("int").alias("copies"))


def _settled(batch: DataFrame, newest: DataFrame, blocked: DataFrame, last: int, least: float, needed: int, chars: int, short: int, small: bool) -> DataFrame:
    """The verdicts on one span; ``newest`` (id, outlet, content) are the latest contents before it. In a ``small`` span only texts are kept from being sent whole."""
    held = (lambda df: df) if small else _sorted
    known_hosts = blocked.select(F.col("domain").alias("_host")).distinct().withColumn("_blocked", F.lit(True))
    rows = batch.join(known_hosts, F.col("domain") == F.col("_host"), "left")
    rows = rows.select("id", "outlet", "domain", (F.col("_blocked").isNull() & F.coalesce(F.col("found") != "", F.lit(False))).alias("able"), F.col("bad").isNotNull().alias("bad"), F.coalesce(F.col("given") != "", F.lit(False)).alias("fallback"))
    rows = placed(rows, ["outlet", "id"])

    # stored contents take the places 0, -1, ... of their outlet, those of the batch 1, 2, ...
    old = _latest(newest, last).select("outlet", (1 - F.col("n")).cast("long").alias("place"), F.col("id").alias("other"), F.lit("stored").alias("version"))
    # only outlets in which a page can still be fetched look back
    asking = rows.filter("able AND NOT bad").select("outlet").distinct()
    looked = rows.select("id", "outlet", "able").join(held(asking), "outlet", "left_semi").select("id", "able")
    both = F.array(F.struct(F.lit("found").alias("version"), F.when(F.col("able"), F.col("found")).alias("content")), F.struct(F.lit("given").alias("version"), F.col("given").alias("content")))
    contents = batch.select("id", "found", "given").join(held(looked), "id").select("id", F.inline(both)).unionByName(newest.select("id", F.lit("stored").alias("version"), "content"))
    texts = contents.filter("content <> ''").select("id", "version", without_tags_first(F.col("content"), chars).alias("text"))
    # shorter ones resemble nothing
    texts = durable(texts.filter(F.length("text") >= short).withColumn("counts", char_counts(F.col("text"))))

    def compared(pairs: DataFrame) -> DataFrame:
        """(id, other, version, close) of pairs (id, other, version)."""
        x = texts.filter("version = 'found'").select("id", F.col("text").alias("x"), F.col("counts").alias("x_counts"))
        y = texts.select(F.col("id").alias("other"), "version", F.col("text").alias("y"), F.col("counts").alias("y_counts"))
        a, b = F.length("x"), F.length("y")
        able = (F.least(a, b) * 2 > (a + b) * least) & may_exceed(F.col("x_counts"), F.col("y_counts"), least)
        both = pairs.join(_sorted(x), "id").join(_sorted(y), ["other", "version"]).filter(able)
        close = both.select("id", "other", "version", close_ratio(F.col("x"), F.col("y"), least).alias("ratio")).filter("ratio IS NOT NULL")
        return durable(close.select("id", "other", "version"))

    now = durable(rows.withColumns({"flagged": F.col("able") & F.col("bad"), "taken": F.col("able") & ~F.col("bad"), "copies": F.lit(0), "todo": F.lit(True)}))
    seen = near = None
    while True:
        # which contents each row looks back on
        state = now.join(held(now.filter("todo AND able AND NOT bad").select("outlet").distinct()), "outlet", "left_semi").withColumn("present", F.col("taken") | F.col("fallback"))
        state = durable(marked_before(state, "outlet", "id", "present", "before", small))
        new = state.filter("present").select("outlet", (F.col("before") + 1).alias("place"), F.col("id").alias("other"), F.when(F.col("taken"), "found").otherwise("given").alias("version"))
        asks = state.filter("todo AND able AND NOT bad").select("id", "outlet", F.explode(F.sequence(F.col("before") - (last - 1), F.col("before"))).alias("place"))
        views = durable(asks.join(held(old.unionByName(new)), ["outlet", "place"]).select("id", "other", "version"))
        fresh = views if seen is None else durable(views.join(held(seen), ["id", "other", "version"], "left_anti"))
        found = compared(fresh)
        near = found if near is None else near.unionByName(found)
        seen = fresh if seen is None else seen.unionByName(fresh)
        copies = views.join(held(near), ["id", "other", "version"]).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("found_copies"))
        wrong = F.col("able") & (F.col("bad") | (F.coalesce("found_copies", F.lit(0)) >= needed))
        judged = now.withColumnsRenamed({"flagged": "was_flagged", "taken": "was_taken", "copies": "had"}).join(held(copies), "id", "left")
        judged = durable(judged.withColumn("wrong", F.when(F.col("todo"), wrong).otherwise(F.col("was_flagged"))))
        # the first wrong row of a domain is flagged for sure, and keeps later pages from being fetched
        first = judged.filter("wrong AND domain <> ''").groupBy("domain").agg(F.min("id").alias("first"))
        fetched = F.col("able") & ~F.coalesce(F.col("first") < F.col("id"), F.lit(False))
        count = F.when(fetched & ~F.col("bad"), F.coalesce("found_copies", F.lit(0))).otherwise(0)
        again = lambda new, old: F.when(F.col("todo"), new).otherwise(F.col(old))
        step = judged.join(held(first), "domain", "left")
        step = durable(step.withColumns({"flagged": again(fetched & F.col("wrong"), "was_flagged"), "taken": again(fetched & ~F.col("wrong"), "was_taken"), "copies": again(count, "had")}))
        changed = step.filter("flagged <> was_flagged OR taken <> was_taken")
        if not changed.take(1):
            return step
        # only what comes after a change, in its outlet or (where it blocks) in its domain, is judged again
        outlets = changed.groupBy("outlet").agg(F.min("id").alias("after_outlet"))
        domains = changed.filter("flagged <> was_flagged AND domain <> ''").groupBy("domain").agg(F.min("id").alias("after_host"))
        step = step.select("id", "outlet", "domain", "able", "bad", "fallback", "part", "flagged", "taken", "copies").join(held(outlets), "outlet", "left").join(held(domains), "domain", "left")
        todo = F.coalesce(F.col("id") > F.col("after_outlet"), F.lit(False)) | F.coalesce(F.col("id") > F.col("after_host"), F.lit(False))
        now = durable(step.withColumn("todo", todo).drop("after_outlet", "after_host"))
