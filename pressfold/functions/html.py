"""Article HTML out of scraped pages: an allow-list sanitiser and an extraction cascade."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a sanitised article may hold, what is no part of one, and where articles usually are.
ALLOWED_TAGS = frozenset("p br h1 h2 h3 h4 h5 h6 strong em b i u ul ol li blockquote pre code a img table thead tbody tr th td".split())
ALLOWED_ATTRIBUTES = {"a": ("href", "title"), "img": ("src", "alt", "title"), "td": ("colspan", "rowspan"), "th": ("colspan", "rowspan")}
DROPPED = frozenset("script style nav header footer aside advertisement figure figcaption iframe noscript button form".split())
PLACES = (
    ("class", "article-body"), ("class", "article-content"), ("class", "story-body"), ("class", "story-content"),
    ("class", "post-content"), ("class", "entry-content"), ("class", "content-body"), ("id", "article-body"),
    ("id", "story-body"), ("itemprop", "articleBody"), ("class", "body-text"),
)
LEAST = 200
#: Pages whose results are held as strings at once.
PACKED = 64

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SAFE_SCHEMES = ("http", "https", "mailto")


class Page(HTMLParser):
    """A page as a flat list of events; elements are (tag, attributes, first event, end event, parent)."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str, dict]] = []
        self.elements: list[list] = []
        self._open: list[int] = []
        self._names: Counter = Counter()
        self.feed(html)
        self.close()
        self._end(0)

    def _end(self, depth: int) -> None:
        while len(self._open) > depth:
            e = self.elements[self._open.pop()]
            self.events.append(("end", e[0], {}))
            self._names[e[0]] -= 1
            e[3] = len(self.events)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "p" and self._open and self.elements[self._open[-1]][0] == "p":
            self._end(len(self._open) - 1)
        known = {k: v or "" for k, v in attrs}
        self.elements.append([tag, known, len(self.events), len(self.events) + 1, self._open[-1] if self._open else -1])
        self.events.append(("start", tag, known))
        if tag not in VOID:
            self._open.append(len(self.elements) - 1)
            self._names[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if self._names[tag]:
            depth = len(self._open) - 1
            while self.elements[self._open[depth]][0] != tag:
                depth -= 1
            self._end(depth)

    def handle_data(self, data: str) -> None:
        self.events.append(("text", data, {}))

    def within(self, first: int, end: int, dropped: frozenset[str]) -> Iterable[tuple[str, str, dict]]:
        """Events from ``first`` to ``end`` without the elements named in ``dropped``."""
        inside = 0
        for kind, name, attrs in self.events[first:end]:
            if kind != "text" and name in dropped:
                inside += 1 if kind == "start" else -1
            elif inside == 0:
                yield kind, name, attrs

    def text(self, first: int, end: int) -> str:
        return "".join(name.strip() for kind, name, _ in self.within(first, end, DROPPED) if kind == "text")

    def sanitized(self, first: int, end: int, dropped: frozenset[str] = frozenset()) -> str:
        out = []
        for kind, name, attrs in self.within(first, end, dropped):
            if kind == "text":
                out.append(escape(name, quote=False))
            elif name in ALLOWED_TAGS:
                if kind == "end":
                    out.append(f"</{name}>")
                else:
                    kept = [(a, attrs[a]) for a in ALLOWED_ATTRIBUTES.get(name, ()) if a in attrs and (a not in ("href", "src") or _safe(attrs[a]))]
                    out.append(f"<{name}" + "".join(f' {a}="{escape(v)}"' for a, v in kept) + ">")
        return "".join(out)

    def densest(self) -> list | None:
        """The element whose paragraphs hold most text that is not linked."""
        scores: dict[int, float] = defaultdict(float)
        for tag, _, first, end, parent in self.elements:
            if tag == "p" and parent >= 0:
                text = self.text(first, end)
                if len(text) >= 25:
                    scores[parent] += 1 + text.count(",") + min(len(text) / 100, 3)
        if not scores:
            return None

        def worth(k: int) -> float:
            _, _, first, end, _ = self.elements[k]
            linked, whole, depth = 0, 0, 0
            for kind, name, _ in self.within(first, end, DROPPED):
                if kind == "text":
                    whole += len(name)
                    linked += len(name) if depth else 0
                elif name == "a":
                    depth += 1 if kind == "start" else -1
            return scores[k] * (1 - linked / max(whole, 1))

        return self.elements[max(scores, key=lambda k: (worth(k), -k))]


def _safe(target: str) -> bool:
    head = target.split("/", 1)[0]
    return ":" not in head or head.split(":", 1)[0].strip().lower() in SAFE_SCHEMES


def _article(html: str) -> str | None:
    page = Page(html)
    best = page.densest()
    if best is not None and len(found := page.sanitized(best[2], best[3], DROPPED)) > LEAST:
        return found
    kept = _outside_dropped(page)
    spots = [e for e in kept if e[0] == "article"][:1]
    if not spots or len(page.sanitized(spots[0][2], spots[0][3], DROPPED)) < LEAST:
        boxes = [e for e in kept if e[0] in ("div", "section")]
        for key, value in PLACES:
            first = next((e for e in boxes if (value in e[1].get(key, "").split() if key == "class" else e[1].get(key) == value)), None)
            if first is not None and len(page.text(first[2], first[3])) > LEAST:
                spots = [first]
                break
        else:
            spots = [e for e in kept if e[0] == "p"]
    found = "".join(page.sanitized(e[2], e[3], DROPPED) for e in spots)
    return found if len(found) > LEAST else None


def _outside_dropped(page: Page) -> list[list]:
    """Elements that neither are nor lie in a dropped one."""
    out, end = [], 0
    for e in page.elements:
        if e[2] >= end:
            if e[0] in DROPPED:
                end = e[3]
            else:
                out.append(e)
    return out


def _each(html: pa.Array, read: Callable[[str], str | None]) -> pa.Array:
    """``read`` of each page. Pages become strings one by one, and results are packed before there are many."""
    out = [pa.array([], pa.string())]
    for at in range(0, len(html), PACKED):
        out.append(pa.array([None if h is None else read(h) for h in (x.as_py() for x in html.slice(at, PACKED))], pa.string()))
    return pa.concat_arrays(out)


@F.arrow_udf(T.StringType())
def sanitize(html: pa.Array) -> pa.Array:
    """Only allowed tags and attributes; the text of others stays, comments go. Null stays null."""
    return _each(html, lambda h: (p := Page(h)).sanitized(0, len(p.events)))


@F.arrow_udf(T.StringType())
def article_html(html: pa.Array) -> pa.Array:
    """Sanitised HTML of a page's article: its densest container, else an article element, a usual place, or all paragraphs.

    Null if nothing of more than 200 characters is found, or the page is null.
    """
    return _each(html, _article)


def scraped_content(scraped: Column, offered: Column) -> Column:
    """What an article's row holds: the scraped HTML, else the sanitised text that the feed offered, else nothing."""
    wrapped = F.concat(F.lit("<div>"), F.nullif(offered, F.lit("")), F.lit("</div>"))
    return F.coalesce(scraped, sanitize(wrapped), F.lit(""))
