"""Feeds in RSS and Atom as rows of articles. Items are cut out and read one by one, so a broken one costs only itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressfold.sources.payloads import utc_moment, utc_time

ITEM = "title string, link string, description string, pubDate string, enclosure struct<_url: string>, _broken string"
ENTRY = "title string, link array<struct<_href: string, _rel: string>>, summary string, content string, published string, updated string, _broken string"

# Zones of dates in mail format, as offsets.
ZONES = {"GMT": "+0000", "UT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def mail_time(stamp: Column) -> Column:
    """The time in UTC of a date as mails have it, the day's name and seconds being optional; null for anything else."""
    rest = F.regexp_replace(F.trim(stamp), r"^[A-Za-z]{3,9}, *", "")
    zone = F.regexp_extract(rest, r"([A-Z]{1,3}|[+-]\d{4})$", 1)
    offset = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair]), zone), zone)
    clock = F.regexp_replace(F.regexp_replace(rest, r" *([A-Z]{1,3}|[+-]\d{4})$", ""), r"( \d{2}:\d{2})$", "$1:00")
    return utc_moment(F.coalesce(F.try_to_timestamp(F.concat_ws(" ", clock, offset), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.concat_ws(" ", clock, offset), F.lit("d MMM yy HH:mm:ss Z"))))


def feed_items(feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, broken) of ``feeds`` (id, source, payload): rows as ``payloads.articles`` gives them, and (id, pos, item) of what is no XML.

    The outlet is the feed's own title, else ``source``. Feeds that are null or hold no items give no rows.
    """
    # a feed's name is read before its items are cut out, once for the feed; each item is read once, and judged by what was read
    named = feeds.select("id", "source", "payload", F.regexp_extract(F.split("payload", r"<item\b|<entry\b", 2)[0], r"<title[^>]*>(?:<!\[CDATA\[)?([^<\]]*)", 1).alias("name"))
    cut = named.select("id", "source", "name", F.posexplode(F.regexp_extract_all("payload", F.lit(r"(?s)<item\b.*?</item>|<entry\b.*?</entry>"), F.lit(0))).alias("pos", "item"))
    options = {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE", "attributePrefix": "_", "ignoreNamespace": "true"}
    rss = F.col("item").startswith("<item")
    one = F.struct(F.when(rss, F.from_xml("item", ITEM, options)).alias("i"), F.when(~rss, F.from_xml("item", ENTRY, options)).alias("e"))
    read = cut.select("*", F.inline(F.array(one)))
    bad = F.coalesce(F.col("i._broken"), F.col("e._broken")).isNotNull() | (F.col("i").isNull() & F.col("e").isNull())
    link = F.coalesce(F.filter("e.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")[0]["_href"], F.col("e.link")[0]["_href"])
    articles = read.filter(~bad).select(
        "id", "pos", F.trim(F.coalesce("i.title", "e.title")).alias("title"), F.coalesce("i.description", "e.content", "e.summary", F.lit("")).alias("content"), F.trim(F.coalesce("i.link", link)).alias("url"),
        F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("source")).alias("source_name"),
        F.coalesce(mail_time(F.col("i.pubDate")), utc_time(F.trim("i.pubDate")), utc_time(F.trim(F.coalesce("e.published", "e.updated")))).alias("published_at"), F.col("i.enclosure._url").alias("image_url"),
    )
    return articles, read.filter(bad).select("id", "pos", "item")
