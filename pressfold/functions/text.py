"""Column functions over URLs, titles, article text and model responses."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels that articles are sorted by.
TOPICS = ("US Politics", "Science/Technology", "Gaming", "Sports", "Business/Finance", "Other")


def strip(c: Column) -> Column:
    """Without white space, line ends included, on both sides."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def normalize_url(url: Column) -> Column:
    """Scheme (lower-cased), host and path of a URL, without parameters, query and fragment."""
    bare = F.regexp_replace(F.regexp_extract(url, r"^([^?#]*)", 1), r";[^/]*$", "")
    scheme = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return F.concat(F.lower(scheme), F.substr(bare, F.length(scheme) + 1))


def domain(url: Column) -> Column:
    """Lower-cased authority without one leading ``www.``; empty if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def without_tags(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, "<[^>]+>", " "))


def without_tags_first(c: Column, n: int) -> Column:
    """The first ``n`` characters of ``without_tags``. The text's beginning is read alone where that decides: it gives enough, and no tag is open at its end."""
    head = F.left(c, F.lit(2 * n))
    start = without_tags(head)
    enough = (F.length(start) >= n) & ~F.contains(F.substring_index(head, ">", -1), F.lit("<"))
    return F.left(F.when(enough, start).otherwise(without_tags(c)), F.lit(n))


def strip_html(c: Column) -> Column:
    """Text without tags; six references are decoded, ``&amp;`` first, so ``&amp;lt;`` ends as ``<``."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return squeeze(out)


def snippet(c: Column, n: int = 300) -> Column:
    return F.left(without_tags(F.coalesce(c, F.lit(""))), F.lit(n))


def embedding_text(title: Column, content: Column, n: int = 400, stripped: bool = True) -> Column:
    """Title and the beginning of the content, as embeddings are computed from it."""
    body = strip_html(content) if stripped else F.coalesce(content, F.lit(""))
    return F.concat_ws(" ", title, F.left(body, F.lit(n)))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether any of ``words`` is a substring of the lower-cased text."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def clean_title(title: Column) -> Column:
    """A title without an outlet's suffix of up to four words, 30 words at most."""
    out, done = title, F.lit(False)
    for sep in (" - ", " | ", " — "):
        tail = F.substring_index(out, sep, -1)
        cut = ~done & F.contains(out, F.lit(sep)) & (F.size(F.split(squeeze(tail), " ")) <= 4)
        out, done = F.when(cut, F.left(out, F.length(out) - F.length(tail) - len(sep))).otherwise(out), done | cut
    words = F.split(squeeze(out), " ")
    return F.when(F.size(words) > 30, F.concat(F.concat_ws(" ", F.slice(words, 1, 30)), F.lit("..."))).otherwise(F.trim(out))


def bias_score(raw: Column) -> Column:
    """1 to 5 from a response, else null."""
    n = strip(raw).try_cast("int")
    return F.when(n.between(1, 5), n)


def bias_label(score: Column) -> Column:
    names = ("Left", "Lean Left", "Center", "Lean Right", "Right")
    return reduce(lambda c, k: c.when(score == k[0], k[1]), enumerate(names[1:], 2), F.when(score == 1, names[0])).otherwise("Unrated")


def bias_bucket(score: Column) -> Column:
    return F.when(score.isNull(), "unrated").when(score <= 2, "left").when(score == 3, "center").otherwise("right")


def topic_labels(response: Column, topics: Sequence[str] = TOPICS) -> Column:
    """The topics that a response's lines name, in order, without Other; Other if none is left."""
    lines = F.split(F.lower(F.coalesce(response, F.lit(""))), "\n")
    known = F.array(*[F.lit(t) for t in topics])
    named = F.flatten(F.transform(lines, lambda line: F.filter(known, lambda t: F.contains(line, F.lower(t)))))
    found = F.array_remove(F.array_distinct(named), "Other")
    return F.when(F.size(found) == 0, F.array(F.lit("Other"))).otherwise(found)


def match_choice(response: Column, n: Column | int) -> Column:
    """The first token of a response that is a number from 0 to n."""
    n = F.lit(n) if isinstance(n, int) else n
    digits = F.filter(F.split(squeeze(response), " "), lambda t: t.rlike("^[0-9]{1,9}$") & (t.try_cast("int") <= n))
    return F.try_element_at(digits, F.lit(1)).cast("int")


def headline(raw: Column) -> Column:
    """A response without quotes around it, if it has 1 to 20 words."""
    text = strip(F.regexp_replace(strip(raw), "^[\"']+|[\"']+$", ""))
    return F.when((text != "") & (F.size(F.split(squeeze(text), " ")) <= 20), text)


def between_markers(text: Column, start: str, end: str) -> Column:
    """What stands after ``start`` up to ``end`` (or the next ``start``, or the text's end); null without ``start``."""
    after = F.try_element_at(F.split(text, rf"\Q{start}\E", -1), F.lit(2))
    return strip(F.element_at(F.split(after, rf"\Q{end}\E", -1), 1))


def whats_happening(summary: Column) -> Column:
    return between_markers(summary, "What's happening:", "What's next:")


def big_picture(summary: Column) -> Column:
    return between_markers(summary, "The big picture:", "Why it matters:")


# Labels of a report's sections, the opening ones in order of priority.
OPENINGS = ("The story:", "What happened:", "The discovery or development:", "The discovery:", "The development:")
FOLLOWING = (
    "How the left is covering it:", "Why it matters:", "What's the game or company:", "Key performances:", "Market impact:",
    "What experts are saying:", "Key details:", "Different perspectives:", "What the research shows:",
    "What the coverage is saying:", "The bigger picture:",
)


def the_story(report: Column) -> Column:
    """A report's opening section, up to the earliest label that may follow it; null if no opening is there."""
    body = F.coalesce(*[F.try_element_at(F.split(report, rf"\Q{m}\E", -1), F.lit(2)) for m in OPENINGS])
    ends = [F.nullif(F.position(F.lit(m), body), F.lit(0)) for m in FOLLOWING]
    return strip(F.left(body, F.least(F.length(body) + 1, *ends) - 1))


def section_lines(text: Column, label_below: int = 35, bullets: bool = False) -> Column:
    """Lines of a report (or, with ``bullets`` and 30, of a summary) as structs kind, label, text.

    A line is a ``label`` if fewer than ``label_below`` characters stand before its first colon, a ``bullet`` if it begins
    with one, else ``para``. Empty lines are left out; null and empty texts give no lines.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != "")

    def shaped(line: Column) -> Column:
        name = strip(F.substring_index(line, ":", 1))
        labelled = F.contains(line, F.lit(":")) & (F.length(name) < label_below)
        dotted = F.startswith(line, F.lit("•")) if bullets else F.lit(False)
        kind = F.when(dotted, "bullet").when(labelled, "label").otherwise("para")
        rest = F.when(dotted, strip(F.substr(line, F.lit(2)))).when(labelled, strip(F.substr(line, F.position(F.lit(":"), line) + 1))).otherwise(line)
        return F.struct(kind.alias("kind"), F.when(~dotted & labelled, name).alias("label"), rest.alias("text"))

    return F.transform(lines, shaped)


PERSONAS = {  # fixed names
    "politics": "political analyst", "science": "science and technology journalist", "gaming": "gaming journalist",
    "sports": "sports journalist", "business": "financial journalist", "default": "professional news analyst",
}


def persona(kind: Column) -> Column:
    """Who writes about stories of a kind."""
    known = F.create_map(*[F.lit(x) for pair in PERSONAS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, kind), F.lit(PERSONAS["default"]))


def guessed_title(title: Column) -> Column:
    """A story's title out of an article's: up to the first colon, or else hyphen, or else six words."""
    words = F.concat_ws(" ", F.slice(F.split(squeeze(title), " "), 1, 6))
    return F.when(F.contains(title, F.lit(":")), F.substring_index(title, ":", 1)).when(F.contains(title, F.lit("-")), F.substring_index(title, "-", 1)).when(title.isNotNull(), words)


def display_title(headline: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(headline, F.lit("")), title)


def outlet_label(score: Column) -> Column:
    """Label of an outlet's rating, cut to a whole number; null for none and 0."""
    return F.nullif(bias_label(score.cast("int")), F.lit("Unrated"))


def short_date(date: Column) -> Column:
    return F.date_format(date, "MMM dd, yyyy")


def long_date(date: Column) -> Column:
    return F.date_format(date, "MMMM dd, yyyy")


def blocked_since(added: Column, permanent: Column) -> Column:
    """How a blocklist shows an entry: since when, and whether for good."""
    return F.struct(F.coalesce(F.date_format(added, "yyyy-MM-dd"), F.lit("—")).alias("since"), F.when(permanent, "Permanent").otherwise("Auto-blocked").alias("status"))


def analysis_type(topics: Column) -> Column:
    """Layout of a story's report: the first kind that one of its topics names."""
    kinds = (("politics", ("us politics",)), ("science", ("science", "technology")), ("gaming", ("gaming",)), ("sports", ("sports",)), ("business", ("business", "finance")))
    named = lambda words: F.exists(topics, lambda t: contains_any(t, words))
    cases = [(k, named(w)) for k, w in kinds]
    return F.coalesce(*[F.when(hit, k) for k, hit in cases], F.lit("default"))

