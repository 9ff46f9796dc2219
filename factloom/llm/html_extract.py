"""Main text of web pages: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks. Each block has its word count and link density, those of the
blocks before and after it, and where it stands: in an article, in a page part that is never main text, under a
name that tells one, in a heading. A decision tree, trained here on the small labelled table BLOCKS, keeps or drops it. Where a page
has an article, its place and the names of its parts decide; where it has none, words and links of the block and its neighbours do.

A line break (br) ends a block, as a new line on the page does; so does the start or end of any element that stands on lines of its own.
A name is a word of class, id or role all of whose parts are known ("site-header", "cookie_notice"; not "header-image"). Ids of
sections and names of headings and table parts tell nothing, for articles number and link these.

Nulls and edges: a null or empty page has the empty text. Broken pages are read as far as they go: unclosed elements, those that are dropped too,
end with their parent (scripts, styles and other raw text with the page); a paragraph ends where the next block begins; a quote that is never closed ends with its tag; an unfinished tag or comment
at the end is dropped; stray end tags are ignored. Pages of any length are read whole. Each row gives one row, repeated ids too. Other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import column, slices, text_or_empty

# Elements of HTML by what they do to text.
RAW = frozenset(["script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes"])
DROPPED = frozenset(["noscript", "template", "svg", "select", "datalist", "audio", "video", "canvas"])
PARTS = frozenset(["nav", "header", "footer", "aside", "form", "dialog", "menu", "fieldset", "button"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
TABLE_PARTS = frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"])
BOXES = frozenset([
    "html", "body", "div", "section", "article", "main", "ul", "ol", "dl", "table", "blockquote", "figure", "details", "summary", "center", "pre", "p", "li", "dt", "dd",
    "caption", "legend", "figcaption", "address", "option", "optgroup",
]) | PARTS | HEADINGS | TABLE_PARTS
BREAKS = BOXES | frozenset(["br", "hr"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
#: An element that its own kind ends, and where to stop looking for one: the list or table around it.
SIBLINGS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"optgroup"}}
#: Words of class, id or role that name page parts beside the article, those that name reader comments, and those that may stand with them.
NAMED = frozenset([
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "alerts", "promo",
    "promos", "promotion", "sponsor", "sponsors", "sponsored", "sidebar", "menu", "menus", "navbar", "nav", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "share",
    "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "popup", "modal", "overlay", "widget", "widgets", "toolbar", "login", "signup", "search",
    "contentinfo", "complementary",
])
COMMENTS = frozenset(["comment", "comments", "respond", "replies", "disqus", "discussion"])
BESIDE = frozenset([
    "site", "page", "main", "top", "bottom", "left", "right", "box", "bar", "list", "link", "links", "button", "buttons", "wrapper", "wrap", "container", "inner", "outer", "block", "section",
    "area", "primary", "secondary", "global", "posts", "item", "items", "slot", "unit", "row", "column", "panel", "mobile", "desktop", "sticky", "fixed", "form", "field", "user", "reader",
    "readers", "thread", "js", "ui", "the",
])

_TAG = r"<(/?)([a-zA-Z][^\s/>]*)"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|{_TAG}((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|{_TAG}([^>]*)(>|\Z)", re.S)
ATTRIBUTES = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|[\s/\"'])(?:hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")


def named_part(name: str, attributes: str) -> bool:
    """Whether the names of an element tell a page part beside the article, or reader comments."""
    for kind, *values in ATTRIBUTES.findall(attributes):
        for word in "".join(values).split():
            parts = [x.lower() for x in CAMEL.split(word) if x]
            known = [x for x in parts if x in NAMED or x in COMMENTS]
            if known and all(x in NAMED or x in COMMENTS or x in BESIDE for x in parts):
                if any(x in COMMENTS for x in known) or not (name == "section" and kind.lower() == "id"):
                    return True
    return False


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "part", "heading")
# Labelled table: blocks of pages read by hand. words and link density of the block, of the one before and of the one after;
# place: 2 in an article or main element, 1 on a page without one, 0 outside it; part: 1 in a menu, header, footer, sidebar, form or a box named as
# such; heading: 1 in h1 to h6; main: 1 if the block is main text.
BLOCKS = """
words links words_before links_before words_after links_after place part heading main
9 0 6 0 80 0 2 0 1 1
1 0 9 0 60 0 2 0 1 1
80 0 9 0 45 0 2 0 0 1
45 0.04 80 0 1 0 2 0 0 1
1 0 45 0.04 2 0 2 0 0 1
2 0 1 0 120 0.1 2 0 0 1
120 0.1 2 0 3 0 2 0 0 1
3 0 120 0.1 9 0 2 0 0 1
30 0.4 60 0 70 0 2 0 0 1
6 1 60 0 70 0 2 0 0 1
1 0 0 0 0 0 2 0 0 1
5 0 0 0 0 0 2 0 0 1
2 0 2 0 0 0 2 0 0 1
3 0 0 0 3 0 2 0 0 1
4 0 1 1 0 0 2 0 0 1
40 0 1 1 9 0 2 0 0 1
6 0 2 1 1 1 2 0 0 1
25 0 1 1 1 1 2 0 0 1
3 0 1 1 40 0 2 0 1 1
12 0 5 0 1 1 2 0 0 1
2 0 5 0 1 1 2 0 1 1
7 0.3 3 0 1 0 2 0 0 1
7 0.3 3 0 40 0 2 0 1 1
8 0.5 1 0 1 0 2 0 0 1
15 0.2 9 0 2 0 2 0 0 1
4 0.6 30 0 25 0 2 0 0 1
2 0.5 60 0 3 0 2 0 0 1
12 0 0 0 0 0 2 0 0 1
400 0 9 0 0 0 2 0 0 1
5 0 400 0 9 0 2 0 0 1
4 1 5 1 4 1 2 0 0 0
3 1 4 1 6 1 2 0 0 0
5 1 90 0 4 1 2 0 0 1
1 1 0 0 1 1 2 1 0 0
1 1 1 1 1 1 2 1 0 0
6 0 40 0 30 0 2 1 0 0
40 0 30 0 20 0 2 1 0 0
90 0.1 60 0 50 0 2 1 0 0
7 0 20 0 90 0 2 1 1 0
1 1 0 0 1 1 0 1 0 0
1 1 1 1 1 1 0 1 0 0
2 1 1 1 12 0 0 1 0 0
12 0 2 1 9 0 0 1 0 0
60 0 12 0 9 0 0 1 0 0
8 0 120 0 0 0 0 1 0 0
15 0.2 300 0 0 0 0 1 0 0
8 0 120 0 0 0 0 0 0 0
25 0 80 0 10 0 0 0 0 0
90 0 60 0 40 0 0 0 0 0
5 0 12 0 30 0 0 0 1 0
1 1 0 0 1 1 1 1 0 0
60 0 1 1 40 0 1 1 0 0
1 1 0 0 60 0 1 1 0 0
12 0 80 0 0 0 1 1 0 0
30 0.1 0 0 90 0 1 1 0 0
5 0 90 0 40 0 1 1 1 0
1 1 0 0 1 1 1 0 0 0
1 1 1 1 1 1 1 0 0 0
2 1 1 1 3 1 1 0 0 0
2 1 0 0 2 1 1 0 0 0
3 1 2 1 7 0 1 0 0 0
1 1 2 1 30 0 1 0 0 0
4 1 3 1 80 0 1 0 0 0
5 1 60 0 4 1 1 0 0 0
6 1 80 0 0 0 1 0 0 0
4 1 60 0 50 0 1 0 0 0
9 1 50 0 8 1 1 0 0 0
18 0.8 4 1 3 1 1 0 0 0
25 0.7 5 1 6 1 1 0 0 0
8 0.6 3 1 2 1 1 0 0 0
12 0.6 70 0 0 0 1 0 0 0
30 0.6 70 0 5 1 1 0 0 0
45 0.9 2 1 3 1 1 0 0 0
2 0 0 0 1 1 1 0 0 0
3 0 0 0 2 1 1 0 0 0
5 0 2 1 1 1 1 0 0 0
4 0 3 1 2 1 1 0 0 0
6 0 1 1 0 0 1 0 0 0
3 0 1 1 4 0 1 0 0 0
3 0 40 0 2 1 1 0 0 0
6 0 20 0 2 1 1 0 0 0
8 0 60 0 3 1 1 0 0 0
4 0 70 0 0 0 1 0 0 0
7 0 45 0 0 0 1 0 0 0
7 0.3 25 0 0 0 1 0 0 0
9 0.4 90 0 0 0 1 0 0 0
8 0 120 0 0 0 1 0 0 0
6 0 3 0 0 0 1 0 0 0
3 0 5 0 6 0 1 0 0 0
4 0 4 0 2 1 1 0 0 0
2 0 3 0 4 0 1 0 0 0
2 0 2 1 3 1 1 0 1 0
3 0 60 0 2 1 1 0 1 0
2 0 0 0 1 1 1 0 1 0
4 0 3 1 5 0 1 0 1 0
7 0 1 1 80 0 1 0 1 1
6 0 30 0 60 0 1 0 1 1
4 0 12 0 45 0 1 0 1 1
2 0 25 0 22 0 1 0 1 1
8 0 0 0 50 0 1 0 1 1
5 0 0 0 18 0.1 1 0 1 1
3 0 2 1 25 0 1 0 1 1
9 0 4 0 30 0 1 0 1 1
2 0 0 0 60 0 1 0 0 1
3 0 0 0 40 0 1 0 0 1
2 0 1 1 60 0 1 0 0 1
8 0 6 0 45 0 1 0 0 1
10 0 1 1 70 0 1 0 0 1
12 0 2 1 35 0 1 0 0 1
5 0 80 0 60 0 1 0 0 1
3 0 40 0 50 0 1 0 0 1
6 0 25 0 30 0 1 0 0 1
2 0 90 0 22 0 1 0 0 1
10 0 40 0 18 0 1 0 0 1
9 0.2 60 0 40 0 1 0 0 1
11 0 20 0 25 0 1 0 0 1
80 0 7 0 60 0 1 0 0 1
60 0 80 0 35 0.1 1 0 0 1
35 0.1 60 0 20 0 1 0 0 1
20 0 35 0.1 14 0 1 0 0 1
16 0 1 1 2 1 1 0 0 1
14 0 20 0 30 0 1 0 0 1
60 0 2 0 0 0 1 0 0 1
60 0 2 0 3 1 1 0 0 1
40 0 1 1 1 1 1 0 0 1
25 0 2 1 3 1 1 0 0 1
30 0.2 4 1 5 1 1 0 0 1
50 0.3 60 0 2 1 1 0 0 1
18 0.1 90 0 2 1 1 0 0 1
22 0 60 0 4 0 1 0 0 1
17 0 0 0 0 0 1 0 0 1
12 0 0 0 25 0 1 0 0 1
200 0 0 0 0 0 1 0 0 1
12 0 0 0 0 0 1 0 0 1
90 0 3 0 5 0 1 0 0 1
30 0 5 0 2 1 1 0 0 1
"""


def labelled() -> tuple[np.ndarray, np.ndarray]:
    rows = [line.split() for line in BLOCKS.strip().splitlines()]
    if tuple(rows[0][:-1]) != FEATURES:
        raise ValueError("the labelled table's columns don't match the features")
    table = np.array(rows[1:], dtype=float)
    return table[:, :-1], table[:, -1].astype(int)


class Tree:
    """A binary decision tree: the split with the least Gini impurity, until leaves are pure or depth is reached."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 10):
        self.feature, self.cut, self.child, self.value = [], [], [], []
        self._grow(x, y, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        node = len(self.value)
        self.feature.append(-1)
        self.cut.append(0.0)
        self.child.append((node, node))
        self.value.append(int(2 * y.sum() >= len(y)))
        best = None
        if depth and 0 < y.sum() < len(y):
            for f in range(x.shape[1]):
                levels = np.unique(x[:, f])
                for cut in (levels[1:] + levels[:-1]) / 2:
                    left = x[:, f] < cut
                    gini = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[left], y[~left]))
                    if best is None or gini < best[0] - 1e-12:
                        best = (gini, f, cut)
        if best:
            _, self.feature[node], self.cut[node] = best
            left = x[:, best[1]] < best[2]
            self.child[node] = (self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1))
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, child, value = map(np.array, (self.feature, self.cut, self.child, self.value))
        node = np.zeros(len(x), dtype=np.int64)
        while (inner := feature[node] >= 0).any():
            at = node[inner]
            node[inner] = child[at, (x[inner, feature[at]] >= cut[at]).astype(int)]
        return value[node]


def blocks_of(page: str) -> tuple[list[str], list[tuple[float, ...]]]:
    """The texts and features of a page's text blocks in order."""
    texts: list[str] = []
    facts: list[tuple[int, float, bool, bool, bool]] = []  # words, link density, in article, in part, in heading
    open_boxes: list[tuple[str, bool, bool, bool]] = []  # name, in article, in part, in heading
    skipped: list[str] = []  # open elements from a dropped one on
    parts: list[str] = []
    words = linked = 0
    links = False
    any_article = False

    def text(raw: str) -> None:
        nonlocal words, linked
        if raw and not skipped:
            n = len(raw.split())
            parts.append(raw)
            words += n
            if links:
                linked += n

    def close() -> None:
        nonlocal words, linked
        if parts:
            own = " ".join(html.unescape("".join(parts)).split())
            if own:
                texts.append(own)
                facts.append((len(own.split()), linked / max(1, words), *(open_boxes[-1][1:] if open_boxes else (False, False, False))))
            parts.clear()
        words = linked = 0

    def end_of(name: str, within: set[str] = frozenset()) -> None:
        """Ends the innermost open box of the name, and those in it; none beyond a box that is in `within`."""
        for k in range(len(open_boxes) - 1, -1, -1):
            if open_boxes[k][0] == name:
                del open_boxes[k:]
                return
            if open_boxes[k][0] in within:
                return

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        slash, name, attributes, stop = m.groups()[:4] if m[2] else m.groups()[4:]
        name = (name or "").lower()
        if not name or not stop:
            continue
        if slash:
            if name in skipped:
                del skipped[len(skipped) - 1 - skipped[::-1].index(name) :]
                continue
            if skipped and any(x[0] == name for x in open_boxes):
                skipped.clear()  # the dropped element ends with its parent
            if skipped:
                continue
            if name == "a":
                links = False
            if name == "p":
                close()
                if open_boxes and open_boxes[-1][0] == "p":
                    open_boxes.pop()
            elif name in BREAKS:
                close()
                end_of(name)
            continue
        if name in RAW:
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = found.end() if found else end
            continue
        if skipped and (name in ("article", "main") or name in BOXES and name not in ("option", "optgroup") and skipped[0] in ("svg", "select")):
            skipped.clear()  # what can't stand in the dropped element ends it
        if skipped:
            if name not in VOID and not CLOSED.search(attributes):
                skipped.append(name)
            continue
        hidden = bool(attributes and HIDDEN.search(attributes))
        if name not in VOID and not CLOSED.search(attributes) and (name in DROPPED or hidden and name not in BREAKS):
            skipped.append(name)
            continue
        if name == "a":
            links = True
        if name in BREAKS:
            close()
            links = links and name == "br"
            if name in BOXES:
                if open_boxes and open_boxes[-1][0] == "p":
                    open_boxes.pop()
                if name in SIBLINGS:
                    for x in ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,):
                        end_of(x, SIBLINGS[name])
                article, part, heading = open_boxes[-1][1:] if open_boxes else (False, False, False)
                own = name in PARTS or name not in HEADINGS | TABLE_PARTS | {"html", "body", "article", "main"} and bool(attributes) and named_part(name, attributes)
                if name in ("article", "main"):
                    any_article = article = True
                if name == "header" and article:  # the head of an article is its own
                    own = False
                open_boxes.append((name, article, part or own or hidden, heading or name in HEADINGS))
    close()
    rows = []
    for i, (n, d, article, part, heading) in enumerate(facts):
        before = facts[i - 1][:2] if i else (0, 0)
        after = facts[i + 1][:2] if i + 1 < len(facts) else (0, 0)
        rows.append((n, d, *before, *after, 2 if article else 0 if any_article else 1, part, heading))
    return texts, rows


def extract(pages: list[str], tree: Tree) -> list[str]:
    found = [blocks_of(p) for p in pages]
    rows = [r for _, rs in found for r in rs]
    keep = tree.predict(np.array(rows, dtype=float)).astype(bool).tolist() if rows else []
    out, at = [], 0
    for texts, _ in found:
        out.append("\n".join(t for t, k in zip(texts, keep[at : at + len(texts)]) if k))
        at += len(texts)
    return out


def extract_text(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars) for every row of pages (page_id, url, html)."""
    tree = Tree(*labelled())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = extract(column(batch, "html").to_pylist(), tree)
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
