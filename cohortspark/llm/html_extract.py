"""Main text of web pages: text-to-tag ratio, Gaussian smoothing, clusters.

The standard library's parser streams events; text between block tags is a
line.  A line's ratio is its text length over the tags in it; the ratios are
smoothed along the page and lines above a threshold form the content clusters.
The region they lie in is the article, of which every line stays except what
page furniture (menus, headers, forms, notices, comments ...) holds.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm.text import texts_of

SIGMA = 1.0        # of the Gaussian, in lines
COVER = 0.9        # share of the carrying lines' text that the region must hold

BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir
    div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html
    legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th
    thead title tr ul""".split())
# elements that can be the region of an article
REGIONS = frozenset("html body main article section div center td table details".split())
VOID = frozenset("""area base br col embed hr img input link meta param source track
    wbr""".split())
UNSEEN = frozenset("""script style noscript template head title iframe object svg canvas
    audio video map annotation annotation-xml""".split())
FURNITURE = frozenset("""nav header footer aside form button select textarea input menu dialog
    fieldset""".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "hgroup")


def _names(words: str, first_only: str = "") -> re.Pattern:
    """Finds a class, id or role whose first or last part is one of the words;
    not what says that the page has or lacks such a thing (has-sidebar)."""
    either = words + ("|" + first_only if first_only else "")
    return re.compile(rf"""(?:^|\s)(?!(?:has|no|with|without)[_-])
        (?:[_-]*(?:{either})(?:$|[\s_-])|\S*[_-](?:{words})(?:$|\s))""", re.X | re.I)


# Words of class, id and role that name page furniture.
OTHERS = r"""related|recommended|comments?|comment-?list|respond|replies|reply|discussion|disqus"""
NAMES = _names(OTHERS + r"""|ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|
    breadcrumbs?|sidebar|masthead|footer|foot|cookies?|consent|gdpr|notices?|alert|popup|
    modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|
    complementary|contentinfo|navigation|toolbar|pager|pagination|tags|widget|skip|
    copyright""", "more|side|form")
# Inside an article names name its own parts too (a section "discussion"): there
# only these whole words mark furniture at once; what else NAMES finds must be
# made of links.
INNER = re.compile(r"""(?:^|\s)(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|
    menu|breadcrumbs?|sidebar|cookies?|consent|newsletter|subscribe|signup|share|sharing|
    share-\w+|social-(?:share|links|icons|media)|pager|pagination|toolbar|widget|comments?|
    comment-?list|comments-area|respond|replies|related|related-\w+|recommended|disqus|notice|
    alert|popup|modal|overlay|copyright|complementary|contentinfo)(?:$|\s)""", re.X | re.I)
OTHERS = _names(OTHERS)  # the text of others, which may be longer than the article
# what may stand in the head; all else ends it
IN_HEAD = frozenset("""base basefont bgsound head link meta noframes noscript script style template
    title""".split())
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
MARKED = FURNITURE | UNSEEN | {"html", "body", "article", "main"}
NOTHING = ("", 0, False, 0)
TAGGED = -1  # furniture by its tag
HEADER = _names("header")  # the page's, not an article's
MAIN = re.compile(r"(?:^|\s)(?:main|article)(?:$|\s)", re.I)

# an open element is closed by the start of one of these, up to the given ancestors
CLOSES = {"p": BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "option", "optgroup",
                         "title", "caption", "legend", "summary", "thead", "tfoot"},
          "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"},
          "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"},
          "option": {"option", "optgroup"}, "head": {"body"}}
SCOPES = frozenset("ul ol dl table td th div section article main body html aside nav".split())


class Lines(HTMLParser):
    """Collects the page's lines: text, number of tags, ancestors, furniture."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # tag, element, unseen, furniture: TAGGED, or the innermost element around
        # that is furniture by its name (or a form) unless its text clears it, or 0
        self.open: list[tuple[str, int, bool, int]] = []
        self.elements = 0
        self.mains: dict[int, tuple[bool, int]] = {}  # not just an article; named one around
        self.named: dict[int, tuple[int, bool]] = {}  # the named one around; others' text
        self.inner: set[int] = set()  # of these, the ones in an article that must hold links
        self.roots: set[int] = set()
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0  # characters of the line inside links
        # text, tags, ancestors, furniture, (characters in links, whether a title)
        self.lines: list[tuple[str, int, tuple[int, ...], int, tuple[int, bool]]] = []

    def cut(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                path = tuple([e for t, e, _, _ in self.open if t in REGIONS])
                self.lines.append((text, self.tags, path, self.open[-1][3] if self.open else 0, (
                    min(self.linked, len(text)), any(t == "h1" for t, _, _, _ in self.open[-4:]))))
            self.parts = []
        self.tags = self.linked = 0

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    def _end_head(self):
        while self.open and self.open[-1][0] == "head":
            self.open.pop()

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._end_head()
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.cut()
            self._close_implied(tag)
        self.tags += 1
        if tag in VOID:
            return
        _, _, unseen, furniture = self.open[-1] if self.open else NOTHING
        self.elements += 1
        if not attrs and tag not in MARKED:  # most tags by far
            self.open.append((tag, self.elements, unseen, furniture))
            return
        named = dict(attrs)
        label = " ".join(filter(None, map(named.get, ("class", "id", "role"))))
        article = tag in ("article", "main") or bool(MAIN.search(named.get("role") or ""))
        marked = False
        if furniture != TAGGED and tag not in ("html", "body"):
            marked = tag == "form" or bool(label) and tag not in HEADINGS and bool(
                NAMES.search(label)) and not (article and not self._commentary(label))
            if marked and tag != "form" and not INNER.search(label) and any(
                    e in self.mains for _, e, _, _ in self.open):
                self.inner.add(self.elements)
            if tag in FURNITURE and tag not in ("header", "form"):
                furniture = TAGGED
            elif tag == "header" or not marked and label and HEADER.search(label):
                if not any(e in self.mains for _, e, _, _ in self.open):
                    marked, furniture = True, TAGGED if tag == "header" else furniture
            if marked and furniture != TAGGED:
                self.named[self.elements] = furniture, bool(OTHERS.search(label))
                furniture = self.elements
        if tag in ("html", "body"):
            self.roots.add(self.elements)
        if article and not marked and furniture != TAGGED:
            self.mains[self.elements] = (
                tag == "main" or "main" in (named.get("role") or "").lower(), furniture)
        hidden = "hidden" in named or bool(HIDDEN.search(named.get("style") or ""))
        self.open.append((tag, self.elements, unseen or hidden or tag in UNSEEN, furniture))

    @staticmethod
    def _commentary(label: str) -> bool:
        return bool(re.search(r"comment|repl(?:y|ies)|teaser|related|promo|card", label, re.I))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close_implied(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if tag in CLOSES.get(name, ()):
                del self.open[k:]
                return
            if name in SCOPES:
                return

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if tag in BLOCKS:
                    self.cut()
                self.tags += 1
                del self.open[k:]
                return
            if tag not in BLOCKS and self.open[k][0] in BLOCKS:
                return  # a stray inline end tag closes no block

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self._end_head()
        if not (self.open and self.open[-1][2]):
            self.parts.append(data)
            if any(t == "a" for t, _, _, _ in self.open[-3:]):
                self.linked += len(data)


def content_clusters(ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines lie in content clusters, their smoothed ratio above the
    threshold (the smaller of mean and standard deviation of the smoothed
    ratios), and which of these carry them, their own ratio above the mean."""
    reach = max(1, int(3 * SIGMA))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * SIGMA ** 2))
    smooth = np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), "valid")
    limit = min(smooth.mean(), smooth.std() or smooth.mean())
    return smooth >= limit, (smooth >= limit) & (ratios >= ratios.mean())


def _carrying(lines) -> tuple[np.ndarray, np.ndarray]:
    """Which lines lie in content clusters, and the lengths of those that carry them."""
    ratios = np.array([len(t) / max(1, n) for t, n, *_ in lines], float)
    content, carrying = content_clusters(ratios)
    return content, np.array([len(t) for t, *_ in lines]) * carrying


def _without_own_parts(parser: Lines, lines: list) -> list:
    """The lines with the article's own parts, named like furniture but not
    made of links, taken for no furniture."""
    if not parser.inner:
        return lines
    size, linked = dict.fromkeys([0, *parser.named], 0), dict.fromkeys([0, *parser.named], 0)
    for t, _, _, w, (in_links, _) in lines:
        size[w] += len(t)
        linked[w] += in_links
    for w in sorted(parser.named, reverse=True):
        around = parser.named[w][0]
        size[around] += size[w]
        linked[around] += linked[w]
    own = {w for w in parser.inner if w in parser.named and 2 * linked[w] < size[w]}

    def beyond(w):
        while w in own:
            w = parser.named[w][0]
        return w

    lines = [(t, n, path, beyond(w), more) for t, n, path, w, more in lines]
    parser.mains = {m: (kind, beyond(w)) for m, (kind, w) in parser.mains.items()}
    parser.named = {w: (beyond(around), others) for w, (around, others) in parser.named.items()
                    if w not in own}
    return lines


def _unnamed(parser: Lines) -> list:
    """The lines outside furniture; leaves the mains outside furniture.

    A name or a form does not make furniture of an element that holds most of
    the page's carrying text (all of it, if the name is that of others' text),
    a ``main``, or an article with as much text as there is outside of such
    elements; unless an article apart from it carries text.
    """
    lines = _without_own_parts(parser, [line for line in parser.lines if line[3] != TAGGED])
    named, cleared = parser.named, {0}
    if lines and named:
        text = dict.fromkeys([0, *named], 0)  # carrying text by innermost named element
        first: dict[int, tuple[int, ...]] = {}  # a path to it
        by_main = dict.fromkeys(parser.mains, 0)
        for (_, _, path, w, _), size in zip(lines, _carrying(lines)[1].tolist()):
            text[w] += size
            first.setdefault(w, path)
            for m in path:
                if m in by_main:
                    by_main[m] += size
        held, plain = dict(text), dict(text)  # with the elements in it; without others' text
        article, main = dict.fromkeys(text, 0), dict.fromkeys(text, 0)
        for m, n in by_main.items():
            kinds, w = (main if parser.mains[m][0] else article), parser.mains[m][1]
            kinds[w] = max(kinds[w], n)
        for w in sorted(named, reverse=True):
            around, others = named[w]
            held[around] += held[w]
            first.setdefault(around, first.get(w, ()))
            if not others:
                plain[around] += plain[w]
                for kinds in (article, main):
                    kinds[around] = max(kinds[around], kinds[w])
        most = plain if plain[0] else held
        outside = text[0]
        live = {m for m, n in by_main.items() if n and not parser.mains[m][1]}
        inner: dict[int, list[int]] = {}
        for m, n in by_main.items():
            if n:
                inner.setdefault(parser.mains[m][1], []).append(m)
        for w in sorted(named, key=lambda w: (-held[w], w)):  # an outer one before its inner ones
            around, others = named[w]
            if not held[w] or around not in cleared or len(live) > len(
                    live.intersection(first[w])):
                continue
            if held[w] == held[0] if others else (
                    2 * most[w] > most[0] or main[w] or article[w] and article[w] >= outside):
                cleared.add(w)
                outside += text[w]
                live.update(inner.get(w, ()))
    parser.mains = {m: x for m, x in parser.mains.items() if x[1] in cleared}
    return [line for line in lines if line[3] in cleared]


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    if parser.rawdata.startswith("<!--"):
        parser.feed("-->")  # an open comment runs to the end
    parser.close()
    parser.cut()
    lines = _unnamed(parser)
    if not lines:
        return ""
    content, sizes = _carrying(lines)
    # the region: the deepest element that holds most of the clusters' text ...
    held: dict[int, int] = {}
    depth: dict[int, int] = {}
    for (_, _, path, _, _), size in zip(lines, sizes.tolist()):
        for d, e in enumerate(path):
            held[e] = held.get(e, 0) + size
            depth[e] = d
    enough = [e for e, n in held.items() if n >= COVER * sizes.sum()]
    region = max(enough, key=lambda e: (depth[e], -e), default=None)
    path = next((line[2] for line in lines if region in line[2]), ())
    # ... widened to the article around it, if it lies in one
    inside = [e for e in path[:path.index(region) + 1] if e in parser.mains] if path else []
    if inside:
        return "\n".join(line[0] for line in lines if inside[0] in line[2])
    # or narrowed to the articles in it
    articles = {e for line in lines for e in line[2] if e in parser.mains}
    if articles:
        return "\n".join(line[0] for line in lines if articles.intersection(line[2]))
    if region is None or region in parser.roots:
        # the body itself: the lines from the first cluster to the last
        at = np.flatnonzero(content)
        first, last = at[0], at[-1] + 1
        chosen = [first <= k < last for k in range(len(lines))]
    else:
        # or widened to all around it in the page's body
        outer = next(e for e in path if e not in parser.roots)
        chosen = [outer in line[2] for line in lines]
    # what carries text beside it stays too, and the title
    titled = any(c and line[4][1] for c, line in zip(chosen, lines))
    for k, (text, _, _, _, (linked, title)) in enumerate(lines):
        if not chosen[k] and 2 * linked < len(text) and (sizes[k] > 0 or title and not titled):
            chosen[k] = True
    return "\n".join(line[0] for c, line in zip(chosen, lines) if c)


def _extract(batches):
    for batch in batches:
        out = [main_text(h.decode()) if h else "" for h in texts_of(batch.column("html"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())],
            names=["page_id", "url", "text"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page.

    ``pages`` needs ``page_id`` (integer), ``url`` and ``html``; other columns
    are not read.  Character references are decoded, white space inside a
    block becomes one space, blocks are joined by a line feed in page order.
    A null or empty page, and one without main text, gives an empty text; null
    ids and urls and repeated rows are returned as they are; an empty table
    gives no rows.  Pages of any length are read whole, broken markup included.
    """
    return (pages.select(F.col("page_id").cast("long").alias("page_id"),
                         F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
            .mapInArrow(_extract, "page_id long, url string, text string")
            .withColumn("n_chars", F.char_length("text").cast("long")))
