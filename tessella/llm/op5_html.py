"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with the root-to-leaf tag path of
its element (markup inside a line, such as b or a, is part of its block). For
each path the length of the text outside links and its punctuation are
aggregated to ratios by block; the ratios are smoothed over neighbouring blocks
of one container, fused by their product and averaged by path; paths that end in no
paragraph, heading or item weigh less. Paths that are mostly links, and blocks inside elements that say what they are (menus, headers,
footers, sidebars, notices, adverts, comments), score nothing.

Paths whose score reaches a share of the mean are selected. The region of the
content is what encloses all selected blocks, widened to the article or main
part that it lies in; if it spans several articles, it is the one with the most
selected text. Every block of the region that scores at all, or shares the path of a menu
but is no link itself, is kept whatever its length, with titles and paragraphs that stand directly in what encloses the
region. Scripts, styles, forms and hidden elements hold no text from the start.

Reading and scoring take time and memory in proportion to the page.

Defined results: null or blank html gives the empty text; markup errors are
repaired the way browsers do for what matters here (implied ends of paragraphs,
cells and items, stray ends, unfinished tags and comments); where nothing scores,
all blocks are kept; repeated rows come back; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .batches import slices

#: Share of the mean score of the text that a path must reach.
THRESHOLD = 0.7
#: Neighbours on each side that smooth a block's ratios, and their weights by distance.
WEIGHTS = (1.0, 0.6, 0.2)
#: Weight of paths that end in a container, not in a paragraph or the like.
PLAIN = 0.1
#: Share of a path's text in links from which it is a menu.
LINKED = 0.6

# Elements of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style template noscript form button select option textarea title iframe object svg canvas audio video fieldset label".split())
BESIDE = frozenset("nav footer aside menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr ruby rb rt rp img label input".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption summary address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset(["", "html", "body"])
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tbody": frozenset(["tr", "td", "th", "thead", "tbody"]),
}
SCOPES = frozenset("html body div table ul ol dl article section main td th nav aside footer header form blockquote".split())
CELLS = frozenset(["td", "th"])
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login menu menus nav navbar navigation navigate breadcrumb breadcrumbs sidebar sidebars footer comment comments reply replies respond "
    "disqus discussion share sharing social related recommended recommendations widget toolbar pagination pager copyright masthead topbar skip search header".split()
)
STEMS = ("advert", "breadcrumb", "comment", "cookie", "disqus", "newsletter", "popup", "sidebar", "sponsor", "subscri")
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?。，；：！？…]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class _Element:
    __slots__ = ("article", "barred", "block", "dropped", "enter", "exit", "linked", "name", "parent", "path", "soft")

    def __init__(self, name: str, parent: _Element | None, enter: int):
        self.name, self.parent, self.enter, self.exit = name, parent, enter, 1 << 62
        self.dropped = self.barred = self.soft = self.linked = False
        self.article: _Element | None = None
        self.block, self.path = self, 0

    def holds(self, other: _Element) -> bool:
        return self.enter <= other.enter < self.exit


class _Block:
    __slots__ = ("container", "element", "linked", "size", "texts")

    def __init__(self, element: _Element):
        self.element, self.texts, self.size, self.linked = element, [], 0, 0
        self.container = element.parent if element.name in PROSE else element

    @property
    def beside(self) -> bool:
        return self.element.barred or self.element.soft


class _Open:
    """The open elements, with the places of each name and of scopes, so that none is searched for."""

    def __init__(self, root: _Element):
        self.stack, self.at, self.scopes, self.wide = [root], defaultdict(list), [], []

    def push(self, e: _Element) -> None:
        self.at[e.name].append(len(self.stack))
        if e.name in SCOPES:
            self.scopes.append(len(self.stack))
            if e.name not in CELLS:
                self.wide.append(len(self.stack))
        self.stack.append(e)

    def close(self, upto: int, count: int) -> bool:
        """Close all from a place on; whether a block ended."""
        ended = False
        while len(self.stack) > upto:
            e = self.stack.pop()
            e.exit = count
            self.at[e.name].pop()
            for scopes in (self.scopes, self.wide):
                if scopes and scopes[-1] == len(self.stack):
                    scopes.pop()
            ended |= e.name not in INLINE
        return ended

    def last(self, *names: str) -> int:
        return max((self.at[n][-1] for n in names if self.at[n]), default=0)


def _marked(name: str, attributes: str, inside_article: bool) -> tuple[bool, bool, bool]:
    """(dropped whatever follows, dropped unless an article follows inside, main part) by an element's attributes."""
    if not attributes:
        return False, False, False
    hard = soft = main = False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            words = {w.lower() for w in _TOKEN.findall(value)}
            soft |= any(w.startswith(STEMS) for w in words) or bool(words & MARKED) and not (inside_article and words & MARKED == {"header"})
        elif key == "role":
            soft |= value.lower() in ROLES
            main |= value.lower() == "main"
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value.lower()):
            hard = True
        elif key == "itemprop":
            main |= value == "articleBody"
    return hard, soft, main


def read_blocks(page: str) -> list[_Block]:
    """The blocks of text of a page in its order."""
    root = _Element("", None, 0)
    open_, blocks, number, last, count, paths = _Open(root), [], 0, -1, 1, {}
    at, n, unquoted = 0, len(page), {'"': False, "'": False}

    def say(text: str) -> None:
        nonlocal last
        e = open_.stack[-1]
        if e.dropped or (e.barred or e.soft) and not (e.block.barred or e.block.soft):
            return  # no text, or an advert within a line
        if number != last:
            blocks.append(_Block(e.block))
            last = number
        own, size = blocks[-1], len(text.strip())
        own.texts.append(text)
        own.size += size
        own.linked += size if e.linked else 0

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            say(page[at:lt])
        if lt == n:
            break
        at, after = lt, page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif after in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif after == "/":
            found = _NAME.match(page, lt + 2)
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            if found:
                name = found[0].lower()
                place = open_.last(name)
                bound = open_.scopes[-1] if open_.scopes and (name in INLINE or name in ("p", "li")) else 0
                if place and place >= bound:
                    number += open_.close(place, count)
                elif not place and name not in INLINE:
                    number += 1
        elif found := _NAME.match(page, lt + 1):
            end = page.find(">", found.end())
            if end < 0:
                break  # an unfinished tag
            attributes = page[found.end() : end]
            for quote in ('"', "'"):
                if attributes.count(quote) % 2 and not unquoted[quote]:
                    other = page.find(quote, end)
                    unquoted[quote] = other < 0  # none from here on, so none is looked for again
                    whole = page.find(">", other) if other >= 0 else -1
                    if whole >= 0:
                        end, attributes = whole, page[found.end() : whole]
                    break
            at, name = end + 1, found[0].lower()
            if name not in INLINE:
                ends = CLOSES.get(name, frozenset()) | (frozenset() if name in ("br", "hr") else {"p"})
                while True:
                    place = open_.last(*ends)
                    scopes = open_.wide if name in ("tr", "tbody", "td", "th") else open_.scopes
                    if not place or place < (scopes[-1] if scopes else 0):
                        break
                    closed = open_.stack[place].name
                    open_.close(place, count)
                    if closed == "p" or name not in ("tr", "tbody"):
                        break
                number += 1
            if name in VOID:
                continue
            parent = open_.stack[-1]
            hard, soft, main = _marked(name, attributes, parent.article is not None)
            begins = name in ("article", "main") or main
            element = _Element(name, parent, count)
            count += 1
            element.linked = name == "a" or parent.linked
            element.soft = (parent.soft and not (begins and parent.article is None)) or soft and name not in ("html", "body", "main")
            element.barred = parent.barred or name in BESIDE or name == "header" and parent.article is None
            element.dropped = parent.dropped or hard or name in DROPPED
            element.article = element if begins and not (element.dropped or element.barred or element.soft) else parent.article
            if name in INLINE:
                element.block, element.path = parent.block, parent.path
            else:
                element.path = paths.setdefault((parent.path, name), len(paths) + 1)
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>]|$)", re.IGNORECASE).search(page, at)
                at = close.start() if close else n
                skip = page.find(">", at)
                at = n if skip < 0 else skip + 1
                continue
            if not attributes.endswith("/") or name not in ("svg", "path"):
                open_.push(element)
        else:  # a bare less-than sign
            say("<")
            at = lt + 1
    return [b for b in blocks if b.size]


def _smoothed(values: list[float], containers: list[_Element | None]) -> list[float]:
    """Weighted means over neighbours in one container."""
    out = []
    for i, own in enumerate(containers):
        total = weight = 0.0
        for d in range(-len(WEIGHTS) + 1, len(WEIGHTS)):
            if 0 <= i + d < len(values) and containers[i + d] is own:
                total += WEIGHTS[abs(d)] * values[i + d]
                weight += WEIGHTS[abs(d)]
        out.append(total / weight)
    return out


def _scores(blocks: list[_Block]) -> list[float]:
    """Fused and smoothed ratios of each block's tag path; 0 for menus and for what stands beside the content."""
    told = [b for b in blocks if not b.beside]
    length, linked, points, count = (defaultdict(float) for _ in range(4))
    for b in told:
        path = b.element.path
        length[path] += b.size - b.linked
        linked[path] += b.linked
        points[path] += sum(len(_PUNCTUATION.findall(t)) for t in b.texts)
        count[path] += 1
    containers = [b.container for b in told]
    texts = _smoothed([length[b.element.path] / count[b.element.path] for b in told], containers)
    marks = _smoothed([points[b.element.path] / count[b.element.path] for b in told], containers)
    fused: dict[int, float] = defaultdict(float)
    for b, t, m in zip(told, texts, marks, strict=True):
        path = b.element.path
        if linked[path] <= LINKED * (length[path] + linked[path]):
            fused[path] += t * (1.0 + m) / count[path] * (1.0 if b.element.name in PROSE else PLAIN)
    return [0.0 if b.beside else fused[b.element.path] for b in blocks]


def _region(selected: list[_Block]) -> _Element:
    """What encloses these blocks, or the best of several articles in it; widened to the article or main part around it."""
    first, last = (f((b.container for b in selected), key=lambda e: e.enter) for f in (min, max))
    region = first
    while not region.holds(last):
        region = region.parent
    held: dict[int, int] = defaultdict(int)
    articles = {}
    for b in selected:
        a = b.element.article
        if a is not None and a is not region and region.holds(a):
            held[a.enter] += b.size
            articles[a.enter] = a
    if len(articles) > 1:
        region = articles[max(held, key=held.get)]
    return region.article or region


def _content(blocks: list[_Block]) -> list[_Block]:
    """The blocks of the content."""
    scores = _scores(blocks)
    if not any(scores):
        return blocks
    level = THRESHOLD * sum(s * b.size for b, s in zip(blocks, scores, strict=True)) / sum(b.size for b, s in zip(blocks, scores, strict=True) if s)
    region = _region([b for b, s in zip(blocks, scores, strict=True) if s and s >= level])

    def around(b: _Block) -> bool:
        """A title or paragraph directly in what encloses the region; of the whole page, a heading before it."""
        if b.element.name not in PROSE or b.container is region or not b.container.holds(region):
            return False
        return b.container.name not in WHOLE or b.element.name in HEADINGS and b.element.enter < region.enter

    def speaks(b: _Block, score: float) -> bool:
        """It scores, or only shares its path with a menu elsewhere."""
        return score > 0 or not b.beside and b.linked <= LINKED * b.size

    return [b for b, s in zip(blocks, scores, strict=True) if speaks(b, s) and (region.holds(b.element) or around(b))]


def main_text(page: str | None) -> str:
    if not page or page.isspace():
        return ""
    # Each text between tags is decoded by itself: markup ends a character reference.
    said = ("".join(entities.unescape(t) for t in b.texts).split() for b in _content(read_blocks(page)))
    return " ".join(" ".join(words) for words in said if words)


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    ship(pages.sparkSession)
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", rows=256):
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = own.schema
    return own.mapInArrow(run, f"page_id {kinds['page_id'].dataType.simpleString()}, url {kinds['url'].dataType.simpleString()}, text string, n_chars long")


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return extract(pages)
