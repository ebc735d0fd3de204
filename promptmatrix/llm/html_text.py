"""Main text of HTML pages by tree scoring.

A page becomes a tree of its block elements (inline markup only marks link
text).  Every run of text in a block passes points, for its length and its
commas, to the blocks around it, fewer to each further one and fewer the more
of it is link text.  The container with the most points, after a discount for
its own link density, is the article; an enclosing ``article`` element and
siblings with enough points or plain headings belong to it.  Menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and comments are
known by element, role or class and id, and are left out before scoring.  A
name of a class or id counts only if all its words are such words or plain
words of layout ("ad-box", not "share-price-table"), and not beside a name of
good meaning on the same element; inside an ``article`` or ``main`` the words
that an article can use itself ("legal", "notice") count only for blocks of
link text.  Lists, sections and tables of link text are menus outside these
two elements, and inside them only if element, role or name says so.

White space (any Unicode white space, and ``<br>``) inside a block becomes one
space; blocks are trimmed and joined by one space; empty blocks vanish.
Defined results: null or empty html gives an empty text; html with no tags is
one block; a tag cut off at the end of the page is markup, not text; repeated
rows are extracted each; other columns are ignored.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmatrix.llm.session import bounded_batches, lean

# Element names of HTML and the words that name what is not article text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style noscript template textarea iframe title svg canvas select noembed noframes xmp audio video".split())
DROPPED = frozenset("head nav footer aside form menu dialog button datalist search fieldset".split())
LEAVES = frozenset("p li td th pre blockquote dd dt h1 h2 h3 h4 h5 h6 figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promos promoted promotion nav navbar navigation menu menus submenu dropdown breadcrumb breadcrumbs crumbs "
    "masthead topbar footer sidebar sidebars widget widgets comment comments commentlist disqus reply replies cookie cookies consent gdpr popup modal overlay lightbox "
    "newsletter subscribe subscription sharing sharebar social related recommended recommendations outbrain taboola pagination pager pagenav toolbar tagcloud "
    "banner banners rail respond notice notices alert alerts signup signin login register skip".split()
)
#: Words that name noise outside an article, and inside it only blocks of link text; beside a word of noise they name noise.
WEAK = frozenset("aside discussion share follow teaser teasers foot toc hidden copyright legal disclaimer".split())
#: A name that ends in one of these is that, whatever stands before it; and words before others that only tell of their absence.
HEADS = frozenset("comment comments commentlist ad ads advert adverts advertisement advertisements".split())
STATES = frozenset("no not without has with is".split())
LAYOUT = frozenset("posts stories news articles reads box container wrapper wrap list bar block area section inner outer top bottom left right item items unit slot panel group row col column link links button buttons icon icons site page global main post article entry content body text header title form thread count area zone strip cell holder primary secondary".split())
GOOD = frozenset("article articlebody body content entry main page post text story blog prose".split())
_SOUND = ("article", "main")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_VALUE, _HIDDEN = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"), re.compile(r"(?:^|\s)hidden(?:=|\s|/|$)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
_FENCE = tuple("ul ol dl table body html article section main div".split())


def _named(value: str) -> tuple[bool, bool, bool]:
    """Whether the names of a class or id say noise, weak noise, or something good."""
    noise = weak = good = False
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name) if not w.isdigit()] or [name.lower()]
        whole = "".join(words)
        plain = all(w in NOISE or w in WEAK or w in LAYOUT or len(w) == 1 for w in words)  # a single letter: of a size, as in 300x250
        if whole in GOOD:
            good = True
        elif words[0] in STATES and len(words) > 1:
            continue
        elif whole in NOISE or words[-1] in HEADS or plain and any(w in NOISE for w in words):
            noise = True
        elif plain and any(w in WEAK for w in words):
            weak = True
    return noise, weak, good


class _Page:
    """Blocks with parent, tag, whether they are left out, and what their names say; runs of text with block, text and length of link text."""

    def __init__(self) -> None:
        self.parent, self.tag, self.out, self.good, self.weak, self.menu, self.sound = [-1], ["#root"], [False], [False], [False], [False], [False]
        self.runs: list[tuple[int, str, int]] = []

    def add(self, parent: int, tag: str, attributes: str) -> int:
        out, good, weak, menu = self.out[parent] or tag in DROPPED, False, False, False
        if attributes and not out:
            noise = False
            for name, *values in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), next((v for v in values if v), "")
                if name in ("class", "id"):
                    found = _named(value)
                    noise, weak, good = noise or found[0], weak or found[1], good or found[2]
                elif name == "role" and value.strip().lower() in ROLES or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                    out = True
            free = tag in ("html", "body", "article", "main", *HEADINGS) or good
            out, weak = out or noise and not free or bool(_HIDDEN.search(_VALUE.sub("=", attributes))), weak and not free
            menu = noise or weak
        out = out or (tag == "header" or weak) and not self.sound[parent]
        for column, value in ((self.parent, parent), (self.tag, tag), (self.out, out), (self.good, good), (self.weak, weak), (self.menu, menu), (self.sound, self.sound[parent] or tag in _SOUND)):
            column.append(value)
        return len(self.tag) - 1


def parse(source: str) -> _Page:
    """The block tree of a page; unclosed and unopened tags are mended."""
    page = _Page()
    stack, text, links, in_link = [0], [], 0, 0
    where: dict[str, list[int]] = {}  # the depths at which each tag is open, so that no search walks the stack
    raw, at = "", 0

    def deepest(tags: Iterable[str]) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join("".join(text).split())
            if joined and not page.out[stack[-1]]:
                page.runs.append((stack[-1], joined, min(links, len(joined))))
            text.clear()
        links = 0

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            where[page.tag[stack.pop()]].pop()

    def put(piece: str) -> None:
        nonlocal links
        if "&" in piece:
            piece = entities.unescape(piece)
        text.append(piece)
        if in_link:
            links += len(piece.strip())

    for m in _TOKEN.finditer(source):
        if m.start() < at:
            continue
        if raw:
            if not ((m[1] or m[4]) and (m[2] or m[5]).lower() == raw):
                continue
            raw, at = "", m.end()
            continue
        if m.start() > at:
            put(source[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if source.startswith("<![CDATA[", m.start()):
                put(m[0][9:].removesuffix("]]>"))
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b", re.I).search(source, at)
                raw, at = tag, end.start() if end else len(source)
        elif tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag in BLOCKS or tag in DROPPED:
            if closing:
                depth = deepest((tag,))
                walls = ("body", "html", *(_FENCE if tag == "p" else ()), *(("article",) if tag in ("div", "section", "p") else ()))
                if depth and depth >= deepest(w for w in walls if w != tag):
                    close(depth)
                flush()
                continue
            flush()
            if page.tag[stack[-1]] in ("p", *HEADINGS) and tag in BLOCKS:
                close(len(stack) - 1)
            if ends := _CLOSES.get(tag):
                wall = deepest(f for f in _FENCE if f not in ends)
                inside = [depths[i] for t in ends if (depths := where.get(t)) and (i := bisect.bisect_right(depths, wall)) < len(depths)]
                if inside:
                    close(min(inside))
            if tag == "body" and where.get("head"):
                close(where["head"][0])
            if tag != "hr":
                where.setdefault(tag, []).append(len(stack))
                stack.append(page.add(stack[-1], tag, attributes))
    if not raw and at < len(source):
        put(source[at:])
    flush()
    return page


def main_text(source: str | None) -> str:
    """The article of a page as one line of text."""
    if not source:
        return ""
    page = parse(source)
    runs, parent, tag = page.runs, page.parent, page.tag
    if not runs:
        return ""
    n = len(tag)
    points, size, linked = [0.0] * n, [0] * n, [0] * n
    for node, text, links in runs:
        worth = (1 if len(text) >= 25 else 0.01) + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)
        worth *= 1 - links / len(text)
        up, step = (parent[node], 0) if tag[node] in LEAVES else (node, 0)
        while up > 0 and step < 6:
            points[up] += worth / (1 if step == 0 else 2 if step == 1 else 3 * step)
            up, step = parent[up], step + 1
        size[node] += len(text)
        linked[node] += links
    for i in range(n - 1, 0, -1):  # children come after their parents
        size[parent[i]] += size[i]
        linked[parent[i]] += linked[i]
    total = [(points[i] + (3 if page.good[i] or tag[i] in ("article", "main") else 0)) * (1 - linked[i] / size[i]) if size[i] and not page.out[i] and tag[i] not in LEAVES else -1.0 for i in range(n)]
    best = max(range(n), key=lambda i: (total[i], -i))
    if total[best] < 0:
        best = 0
    up = best
    while up > 0:
        if tag[up] == "article":
            best = up
        up = parent[up]
    kept = {best}
    if best > 0 and tag[best] not in ("body", "html", "article"):
        bar = max(3.0, 0.2 * total[best])
        for i in range(parent[best] + 1, n):
            if parent[i] != parent[best] or page.out[i] or not size[i] or i == best:
                continue
            density = linked[i] / size[i]
            if total[i] >= bar and density < 0.3 or tag[i] in HEADINGS and density < 0.5 or tag[i] in LEAVES and tag[i] != "li" and density < 0.25 and size[i] > 80:
                kept.add(i)
    within, headed = [False] * n, [False] * n
    for i in range(n):
        dense = size[i] > 0 and linked[i] / size[i] > 0.6
        menu = i not in kept and dense and (page.menu[i] or tag[i] in ("ul", "ol", "div", "section", "dl", "table") and not page.sound[i])
        within[i] = i in kept or i > 0 and within[parent[i]] and not menu
        headed[i] = tag[i] == "header" or i > 0 and headed[parent[i]]
    return " ".join(text for node, text, _ in runs if within[node] and (not headed[node] or tag[node] in HEADINGS))


def apply(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``text`` and ``n_chars`` of every page, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col), F.col(html_col).cast("string").alias(html_col))
    return rows.mapInArrow(lean(run), f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
