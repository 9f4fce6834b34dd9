"""Main text of web pages by consensus of each host's pages on where the article stands.

1. Every page is parsed once; each container (an element that may hold an article) is
   scored by the text of its own blocks without links, of inner containers by half. The page votes
   for the generalised tag-class path of its best container.
2. Spark counts the votes of each host; the path with the most wins (ties: the higher sum of scores, then
   the first by code point).
3. Every page is read again: the best container at its host's path is the article, or the page's own best
   where it has none there, with what surrounds it: the article or main that it is in, or else the outermost container
   with prose besides (at body: prose in no other container, or in one of the same path). Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
   reader comments inside are left out; what remains is split at block elements. A box that only its class or id casts doubt on stays if it holds
prose, and so does a form that holds most of the page's.

Edge cases: a null or empty page, or one without text, gives an empty text; a null or
malformed url counts as a host of its own name ''; markup that is cut off or never closed ends with the page, and a ``<`` that no ``>`` follows is text; work grows with a page's length whatever it holds;
repeated rows are extracted each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressfold.llm.common import bounded_batches, table

#: Paths (about 100 bytes each) that may be broadcast; beyond that pages and paths are shuffled by host.
BROADCAST_HOSTS = 100_000

NAME = re.compile(r"(/?)([a-zA-Z][\w:-]*)")
STOP = re.compile(r"[>\"']")
#: A tag in order, without < or > inside; it is read no farther than to the next of these.
TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)([^>\"'<]*(?:\"[^\"<>]*\"[^>\"'<]*|'[^'<>]*'[^>\"'<]*)*+)>")
#: Elements whose content is no markup, and where it ends.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "template", "svg", "noscript", "textarea", "title")}
ATTRIBUTE = re.compile(r"([\w:-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div td body".split())

#: Open elements beyond which no missing closing tag is looked for.
BARRIERS = CONTAINERS | {"table", "ul", "ol", "dl"}

#: Characters of a path beyond which a digest stands for it, so that deep markup does not grow with its square.
LONG_PATH = 1000

#: Elements that never belong to an article's text.
LEFT_OUT = frozenset("nav footer aside button select option input iframe object menu dialog head script style noscript template svg canvas audio video label".split())

#: Words in class and id that mark what does not belong to an article, whatever it holds.
MARKED = frozenset(
    "adv advert adverts advertisement advertising sponsor sponsored promoted cookie cookies consent gdpr popup modal overlay newsletter subscribe signup paywall nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar aside masthead topbar toolbar sharing recommended recommendations comment comments commentlist disqus respond reply replies pagination pager".split()
)
#: Words that mark such a box only together with words of page layout, and only if its text is short or holds links.
DOUBTED = frozenset("ad ads promo promotion banner notice notices alert subscription side rail footer header share social related discussion widget login search hidden skip".split())
LAYOUT = frozenset(
    "area article articles bar block bottom box button buttons col column container content entries entry extra follow footer form group header holder icon icons inner item items js left link links list main media module "
    "more news outer page pages panel post posts primary read right row secondary section site small sticky stories story strip tags text title top topics unit us video videos wrap wrapper zone".split()
)
#: A doubted box stays if it has so many characters besides links, and links make up no more than this share of its text.
PROSE = 200
LINKED = 0.1

#: Elements whose id counts for that; of others, such as headings and paragraphs, it is the target of a link.
BOXES = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer header main nav ol section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
STYLES = frozenset("header banner side hidden skip widget alert notice overlay".split())  # words that only describe a heading's or paragraph's look

ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())

#: A closing tag may be missing where one of these starts: open elements that it ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")} | {b: ("p",) for b in BLOCKS - {"html", "body", "li", "dt", "dd", "tr", "td", "th"}}


class Element:
    __slots__ = ("children", "doubted", "links", "out", "own", "path", "tag")

    def __init__(self, tag: str, path: str, out: bool, doubted: bool = False):
        self.tag, self.path, self.out, self.doubted = tag, path, out, doubted
        self.own, self.links = 0, 0  # characters of text, and of those in links
        self.children: list = []  # pieces of text, elements


def tokens(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, tag, attributes) of tags; comments, declarations and raw content have no tag.

    Every character is looked at a bounded number of times: where no ``>``, quote or end of raw content is left that is known, and once a quote
    has turned out to be never closed tags end at the first ``>``.
    """
    last, quotes = html.rfind(">"), {q: html.rfind(q) for q in "\"'"}
    at, broken = 0, False
    while 0 <= (start := html.find("<", at)) < last:
        name = TAG.match(html, start)
        if name:
            end = name.end(3)
        elif html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = len(html) if end < 0 else end + 3
            yield start, at, False, "", ""
            continue
        else:
            name = NAME.match(html, start + 1)
            if not name:
                if html[start + 1] in "!?/":
                    at = html.find(">", start) + 1
                    yield start, at, False, "", ""
                else:
                    at = start + 1
                continue
            end = name.end()
            while not broken:
                stop = STOP.search(html, end)
                if stop is None or (stop[0] != ">" and stop.start() >= quotes[stop[0]]):
                    broken = True
                elif stop[0] == ">":
                    end = stop.start()
                    break
                else:
                    end = html.index(stop[0], stop.end()) + 1
            if broken:
                end = html.find(">", name.end())
        at, tag = end + 1, name[2].lower()
        if tag in RAW and not name[1]:
            closed = RAW[tag].search(html, at)
            at = closed.end() if closed else len(html)
            yield start, at, False, "", ""
        else:
            yield start, at, bool(name[1]), tag, html[name.end(2) : end]


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(raw)} if raw else {}


def _marked(tag: str, attrs: dict[str, str], inside: bool) -> tuple[bool, bool]:
    """Whether an element is left out, and whether that is to be judged by what it holds."""
    if tag in LEFT_OUT or (tag == "header" and not inside):
        return True, False
    if tag == "form":
        return False, True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False, False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in ROLES or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True, False
    return _named(tag, attrs.get("class", ""), attrs.get("id", "") if tag in BOXES else "")


@lru_cache(maxsize=4096)
def _named(tag: str, classes: str, ident: str) -> tuple[bool, bool]:
    """What class and id say."""
    names = [{w.lower() for w in PARTS.findall(t)} for t in [*classes.split(), *ident.split()]]
    names = [n - STYLES for n in names] if tag in HEADINGS else names
    words = set().union(*names)
    if words & {"article", "entry", "story", "post"} and not words & {"comment", "comments", "ad", "ads", "sidebar", "related", "footer", "share", "nav", "menu", "respond"}:
        return False, False
    doubted = any(n & DOUBTED and all(w in DOUBTED or w in LAYOUT or w.isdigit() for w in n) for n in names)
    return bool(words & MARKED) or (doubted and tag not in BLOCKS), doubted


@lru_cache(maxsize=4096)
def _step(tag: str, classes: str) -> str:
    names = sorted(re.sub(r"\d+", "#", c) for c in classes.split())
    return ".".join([tag, *names])


def _short(path: str) -> str:
    return path if len(path) <= LONG_PATH else "#" + hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def parse(html: str) -> Element:
    root = Element("", "", False)
    stack, opened = [root], {}  # open elements, and the places in it of each tag
    held, fences = [root], [0]  # open blocks, and the places of open barriers
    at, in_link, in_article = 0, 0, 0

    def text(piece: str) -> None:
        if piece:
            piece = unescape(piece)
            top = stack[-1]
            top.children.append(piece)
            if not top.out:
                size = len(piece) - piece.count(" ")
                held[-1].own += size
                held[-1].links += size if in_link else 0

    def close(n: int) -> None:
        nonlocal in_link, in_article
        for e in reversed(stack[n:]):
            opened[e.tag].pop()
            if e is held[-1]:
                held.pop()
            in_link -= e.tag == "a"
            in_article -= e.tag in ("article", "main")
        del stack[n:]
        while fences[-1] >= n:
            fences.pop()

    any_doubted = False
    for start, end, closing, tag, raw in tokens(html):
        if start > at:
            text(html[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if opened.get(tag):
                close(opened[tag][-1])
            continue
        for ended in ENDS.get(tag, ()):
            if opened.get(ended) and opened[ended][-1] >= fences[-1]:
                close(opened[ended][-1])
        attrs = _attributes(raw)
        top = stack[-1]
        out, judged = _marked(tag, attrs, in_article > 0)
        element = Element(tag, f"{_short(top.path)}>{_step(tag, attrs.get("class", ""))}" if tag in BLOCKS else top.path, top.out or out, judged and not out)
        any_doubted |= element.doubted and not element.out
        top.children.append(element)
        if tag not in VOID and not raw.endswith("/"):
            opened.setdefault(tag, []).append(len(stack))
            if tag in BARRIERS:
                fences.append(len(stack))
            if tag in BLOCKS:
                held.append(element)
            stack.append(element)
            in_link += tag == "a"
            in_article += tag in ("article", "main")
    if at < len(html):
        text(html[at:])
    if any_doubted:
        _judge(root)
    return root


def _judge(root: Element) -> None:
    """Leave out the doubted boxes that hold no prose, and the forms that do not hold most of the page's."""
    order = walk(root)
    for forms in (False, True):
        own, links = [e.own for e, _ in order], [e.links for e, _ in order]
        for n in range(len(order) - 1, -1, -1):  # children before their parents
            e, up = order[n]
            if e.doubted and not forms and e.tag != "form" and (own[n] - links[n] < PROSE or links[n] > LINKED * own[n]):
                e.out = True
            if e.out:
                own[n] = links[n] = 0
            if up >= 0:
                own[up] += own[n]
                links[up] += links[n]
        for n, (e, _) in enumerate(order):
            if forms and e.tag == "form" and (own[n] - links[n] < PROSE or 2 * (own[n] - links[n]) < own[0] - links[0]):
                e.out = True


def walk(root: Element) -> list[tuple[Element, int]]:
    """(element, place of its parent) in page order, without what is left out."""
    order: list[tuple[Element, int]] = []
    todo = [(root, -1)]
    while todo:
        e, up = todo.pop()
        todo.extend((c, len(order)) for c in reversed(e.children) if isinstance(c, Element) and not c.out)
        order.append((e, up))
    return order


def containers(order: list[tuple[Element, int]]) -> list[tuple[float, int]]:
    """(score, place in ``order``) in page order; what is left out scores nothing."""
    scores = [e.own - 1.5 * e.links for e, _ in order]
    found: list[tuple[float, int]] = []
    for n in range(len(order) - 1, -1, -1):  # children before their parents
        e, up = order[n]
        score = scores[n]
        if e.tag in CONTAINERS or e.tag == "":
            found.append((score * (1.6 if e.tag == "article" else 1.3 if e.tag == "main" else 1.0), n))
            score /= 2
        if up >= 0:
            scores[up] += score
    return found[::-1]


def best(order: list[tuple[Element, int]], path: str | None = None) -> tuple[float, int]:
    """The container with the highest score (the first of equals), at ``path`` if there is one."""
    found = containers(order)
    at_path = [f for f in found if order[f[1]][0].path == path] if path is not None else []
    return max(at_path or found, key=lambda f: f[0])


def whole(order: list[tuple[Element, int]], n: int) -> Element:
    """The article that the container at ``n`` is of: the outermost article around it, else a main around it, else the
    outermost container that has prose (blocks with more text than links) besides. At body only prose outside of other
    containers, or in one of the same path, counts."""
    around = [n]
    while around[-1] > 0:
        around.append(order[around[-1]][1])
    for tag in ("article", "main"):
        named = [i for i in around if order[i][0].tag == tag]
        if named:
            return order[named[-1]][0]
    if order[n][0].tag in ("body", ""):
        return order[n][0]
    prose = [max(0.0, e.own - 1.5 * e.links) for e, _ in order]
    loose = list(prose)  # that in no inner container
    alike: dict[tuple[int, str], float] = {}  # that of the containers with a path in the same outer one
    outer = [0] * len(order)
    for i, (e, up) in enumerate(order[1:], 1):
        outer[i] = up if order[up][0].tag in CONTAINERS or not up else outer[up]
    for i in range(len(order) - 1, 0, -1):
        e, up = order[i]
        prose[up] += prose[i]
        if e.tag in CONTAINERS:
            key = outer[i], e.path
            alike[key] = alike.get(key, 0) + prose[i]
        else:
            loose[up] += loose[i]
    inner = top = n
    while inner:
        i = outer[inner]
        if order[i][0].tag in ("body", ""):
            more = loose[i] + alike[i, order[inner][0].path] - prose[inner]
        else:
            more = prose[i] - prose[inner]
        if more > 0:
            top = i
        inner = i
    return order[top][0]


def blocks(e: Element) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        line = " ".join("".join(run).split())
        run.clear()
        if line:
            out.append(line)

    todo: list = e.children[::-1]
    while todo:
        c = todo.pop()
        if c is None:  # the end of a block
            flush()
        elif isinstance(c, str):
            run.append(c)
        elif c.out or c.tag == "br":
            run.append(" ")
        else:
            if c.tag in BLOCKS:
                flush()
                todo.append(None)
            todo.extend(reversed(c.children))
    flush()
    return out


def vote(html: str) -> tuple[str, float]:
    order = walk(parse(html))
    score, n = best(order)
    return order[n][0].path, score


def extract(html: str, path: str | None) -> str:
    order = walk(parse(html))
    return "\n".join(blocks(whole(order, best(order, path)[1])))


def host(url: Column | str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): for each host the path that most of its pages vote for."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [vote(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([v[0] for v in votes], pa.string()), pa.array([int(v[1]) for v in votes], pa.int64())], ["host", "path", "score"])

    votes = pages.filter("html <> ''").select(host("url").alias("host"), "html").mapInArrow(one, "host string, path string, score long")
    sums = votes.filter("score > 0").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    return sums.groupBy("host").agg(F.min(F.struct(-F.col("votes"), -F.col("score"), F.col("path"))).alias("m")).select("host", "m.path")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    bounded_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    paths = winning_paths(pages).persist()
    rows = pages.withColumn("host", host("url")).join(F.broadcast(paths) if paths.count() <= BROADCAST_HOSTS else paths, "host", "left")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, p) if h else "" for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = pages.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return rows.select("page_id", "url", "html", "path").mapInArrow(one, schema)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
