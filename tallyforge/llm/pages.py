"""Main text of web pages: parser events, text-to-tag ratios of lines, smoothing, regions.

The standard library's parser streams its events over a page.  Text between two block borders is
a line, with the tags since the line before it and its place in the element tree.  What the
markup itself declares to be something else (navigation, forms, scripts, asides, footers, headers
outside the article, hidden parts; classes and ids such as ``cookie-notice`` or ``comments``) is
set aside.  Each line that is left has a text-to-tag ratio: characters outside links per tag, as
a logarithm.  Ratios are smoothed with a Gaussian over neighbouring lines, and lines that reach
one standard deviation are content.  The article elements with content (those with at least half
of the largest one's) are the region; without one, the main element; without that, the smallest
element that holds most of the content, less the blocks around and inside it that are links or
stand outside the content.  All lines of the region are the text, short ones too, and a
first-level heading before a region that has none.

Null and empty pages, and pages without any text, give an empty text.  Plain text without tags is
one block.  Pages of any length are parsed whole; unclosed comments and tags at the end of a page
are no text.  Repeated rows are pages of their own.  An empty table gives no rows.  Ties between
regions: all of them, as all have at least half.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.words import release

SIGMA = 1.0
RADIUS = 3
#: Part of the content that the smallest region without an article element has to hold.
MOST = 0.8
MENU_LINK = 0.5

# Elements of HTML by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HOLDS = frozenset("html body div section center form table tbody tr td font details".split())  # elements that may be a region
GROUPS = frozenset("div section center table tbody tr td ul ol dl menu".split())  # elements that may be a menu or a notice as a whole
DROPPED = frozenset("aside audio button canvas datalist dialog embed footer form frameset head iframe input math menu nav noembed noframes noscript object script search select style svg template textarea title video".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("table", "tr")), "th": ("td th", ("table", "tr")), "option": ("option", ("select",))}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist status".split())
# Words of classes and ids that name what is not the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle adslot sponsor sponsors sponsored promo promos promotion banner cookie cookies consent gdpr notice notices notification notifications announcement alert disclaimer newsletter subscribe subscription signup signin login register paywall popup modal overlay lightbox toast sidebar sidebars sidenav widget widgets related recommended recommendations recommendation suggested share sharing social breadcrumb breadcrumbs menu menus nav navbar topnav subnav navigation toc search searchbox topbar toolbar masthead header footer copyright comment comments commentlist disqus respond replies reply pagination pager paging skip tagcloud hidden".split()
)
#: For elements that are articles themselves.
ARTICLE_NAMES = frozenset("comment comments reply related recommended ad ads advert sponsored promo promotion teaser widget".split())
OWN_NAMES = frozenset("article post entry story".split())
NEGATED = frozenset("has with no without is enabled not".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_NAMES = re.compile(r"[A-Za-z0-9]+")
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


class Page(HTMLParser):
    """Lines of one page with the elements that hold them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.dropped, self.named, self.roots = ["#"], [0], [False], [0], [0]
        self.stack, self.open = [0], Counter()
        self.parts: list[tuple[int, int, str]] = []  # element set aside by its name (or 0), whether in a link, text
        self.links = self.since = 0
        self.lines: list[tuple[str, int, int, int, int]] = []  # text, characters in links, tags, element, element set aside

    def parse_comment(self, i: int, report: bool = True) -> int:
        """As in browsers: a comment without an end goes on to the end of the page."""
        end = self.rawdata.find("-->", i + 2)
        return len(self.rawdata) if end < 0 else end + 3

    def parse_marked_section(self, i: int, report: bool = True) -> int:
        end = self.rawdata.find(">", i + 3)
        return len(self.rawdata) if end < 0 else end + 1

    def flush(self) -> None:
        if self.parts:
            for aside in dict.fromkeys(p[0] for p in self.parts):
                mine = [p for p in self.parts if p[0] == aside]
                if text := " ".join("".join(p[2] for p in mine).split()):
                    linked = sum(len(p[2].strip()) for p in mine if p[1])
                    self.lines.append((text, min(linked, len(text)), self.since, self.stack[-1], aside))
                    self.since = 0
            self.parts = []

    def _pop(self) -> None:
        tag = self.tags[self.stack.pop()]
        self.open[tag] -= 1
        if tag == "a":
            self.links -= 1

    def _close(self, tags: str, within: tuple[str, ...] = ()) -> None:
        """Ends the nearest open element of some tags, unless an element of ``within`` is nearer."""
        wanted = tags.split()
        if not any(self.open[t] for t in wanted):
            return
        for place in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[place]]
            if tag in wanted:
                while len(self.stack) > place:
                    self._pop()
                return
            if tag in within:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.since += 1
        if tag == "br":
            self.handle_data(" ")
        if tag in BLOCK:
            self.flush()
            if self.open["p"]:
                self._close("p", ("button", "td", "th", "table"))
            if tag in CLOSES:
                self._close(*CLOSES[tag])
        if tag in VOID:
            return
        top = self.stack[-1]
        dropped, named, root = self.dropped[top], self.named[top], self.roots[top]
        node = len(self.tags)
        if attrs or tag in DROPPED or tag in ("article", "main", "header"):
            given = dict(attrs)
            role = (given.get("role") or "").strip().lower()
            is_root = 2 if tag == "article" or role == "article" else 1 if tag == "main" or role == "main" or given.get("itemprop") == "articleBody" else 0
            style = given.get("style")
            dropped = dropped or tag in DROPPED or role in ROLES or (tag == "header" and not root) or "hidden" in given or given.get("aria-hidden") == "true" or bool(style and _HIDDEN.search(style))
            if tag not in ("html", "body") and ("class" in given or "id" in given):
                own = f"{given.get('class') or ''} {given.get('id') or ''}"
                names = {w.lower() for w in _WORDS.findall(own)} | {w.lower() for w in _NAMES.findall(own)}
                if root or not names.isdisjoint(OWN_NAMES):
                    names.discard("header")  # the article's own
                if not names.isdisjoint(ARTICLE_NAMES if is_root else NAMES) and names.isdisjoint(NEGATED):
                    named, is_root = named or node, 0
            root = max(root, is_root)
        self.tags.append(tag)
        self.parents.append(top)
        self.dropped.append(dropped)
        self.named.append(named)
        self.roots.append(root)
        self.stack.append(node)
        self.open[tag] += 1
        if tag == "a":
            self.links += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "path", "use"):  # elsewhere the slash means nothing
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.since += 1
        if tag in BLOCK:
            self.flush()
        if self.open[tag]:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if not self.dropped[top]:
            self.parts.append((self.named[top], self.links > 0, data))


def parse(html: str) -> Page:
    tail = html.rfind(">") + 1
    if cut := _OPEN.search(html, tail):  # a tag that the page's end cuts off
        html = html[: cut.start()]
    page = Page()
    page.feed(html)
    page.close()
    page.flush()
    return page


_OPEN = re.compile(r"<[a-zA-Z/!?]")


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian means of neighbouring lines; at the ends, of those that are there."""
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    around = np.convolve(np.ones(len(ratios)), kernel)[RADIUS : RADIUS + len(ratios)]
    return np.convolve(ratios, kernel)[RADIUS : RADIUS + len(ratios)] / around


def content(size: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which lines are content, by characters outside links and tags."""
    level = smoothed(np.log1p(size / np.maximum(tags, 1)))
    return level >= level.std()


def inside(page: Page, chosen: set[int]) -> list[bool]:
    """For every element, whether it is or lies in a chosen one."""
    found = [False] * len(page.tags)
    for node in range(len(page.tags)):
        found[node] = node in chosen or (node > 0 and found[page.parents[node]])
    return found


def sums(page: Page, nodes: list[int], weights: np.ndarray) -> list[float]:
    """Weight of the lines in every element's tree."""
    total = [0.0] * len(page.tags)
    for node, w in zip(nodes, weights.tolist(), strict=True):
        total[node] += w
    for node in range(len(page.tags) - 1, 0, -1):
        total[page.parents[node]] += total[node]
    return total


def set_aside(page: Page) -> set[int]:
    """Elements that their names set aside: not those that hold an article or main element of their own, and none if nothing else has text."""
    named = {n for i, n in enumerate(page.named) if n}
    for node, root in enumerate(page.roots):
        if root and page.roots[page.parents[node]] < root and not page.dropped[node]:
            named.discard(page.named[node])
    return named if any(line[4] not in named for line in page.lines) else set()


def topmost(page: Page, kind: int) -> list[int]:
    """Article (2) or main (1) elements that are in no other one of their kind."""
    return [n for n in range(1, len(page.tags)) if page.roots[n] >= kind > page.roots[page.parents[n]]]


def region_of_content(page: Page, lines: list[tuple[str, int, int, int, int]], mass: np.ndarray, is_content: np.ndarray) -> list[bool]:
    """Lines to keep on a page without an article or main element."""
    nodes = [line[3] for line in lines]
    total = sums(page, nodes, mass)
    best, children = 0, {}
    for node in range(1, len(page.tags)):
        if total[node] >= MOST * total[0] and page.tags[node] in HOLDS:
            children[page.parents[node]] = node
    while best in children:
        best = children[best]
    region = inside(page, {best})
    held = sums(page, nodes, is_content.astype(float))
    chars = sums(page, nodes, np.array([float(len(line[0])) for line in lines]))
    linked = sums(page, nodes, np.array([float(line[1]) for line in lines]))
    places = np.flatnonzero(is_content & np.array([region[n] for n in nodes]))
    first, last = (places[0], places[-1]) if len(places) else (0, len(lines) - 1)
    keep = []
    for i, node in enumerate(nodes):
        good = region[node]
        above = node
        while good and above != best:  # a block of links, or one without content that stands before or after all of it
            if page.tags[above] in GROUPS and (linked[above] > MENU_LINK * chars[above] or (held[above] == 0 and not first <= i <= last)):
                good = False
            above = page.parents[above]
        keep.append(good)
    return keep


def with_title(page: Page, lines: list[tuple[str, int, int, int, int]], keep: list[bool]) -> list[str]:
    """Texts of the lines to keep, and of a first-level heading before them where they have none."""
    titles = [i for i, line in enumerate(lines) if page.tags[line[3]] == "h1"]
    if titles and not any(keep[i] for i in titles) and True in keep and titles[0] < keep.index(True):
        keep[titles[0]] = True
    return [line[0] for line, k in zip(lines, keep, strict=True) if k]


def main_blocks(html: str | None) -> list[str]:
    """Blocks of a page's main text, in page order."""
    if not html:
        return []
    page = parse(html)
    aside = set_aside(page)
    lines = [line for line in page.lines if line[4] not in aside]
    if not lines:
        return []
    size = np.array([len(line[0]) - line[1] for line in lines], float)
    is_content = content(size, np.array([line[2] for line in lines], float))
    mass = np.where(is_content, size, 0.0)
    total = sums(page, [line[3] for line in lines], mass)
    for kind in (2, 1):
        roots = topmost(page, kind)
        most = max((total[n] for n in roots), default=0.0)
        if most > 0:
            region = inside(page, {n for n in roots if total[n] >= most / 2})
            return with_title(page, lines, [region[line[3]] for line in lines])
    return with_title(page, lines, region_of_content(page, lines, mass, is_content))


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: the id and ``blocks`` array<string>."""
    kept = df.select(F.col(id_col), F.col(html_col).alias("__html"))
    kind = kept.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                blocks = pa.array([main_blocks(x.as_py()) for x in some.column(1)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([some.column(0), blocks], [id_col, "blocks"])
        release()

    return kept.mapInArrow(run, f"`{id_col}` {kind}, blocks array<string>")
