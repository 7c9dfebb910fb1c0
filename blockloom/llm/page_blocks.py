"""Text blocks of a web page with what their place in the document says about them."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head title script style noscript template textarea select option button svg math iframe object canvas audio video map datalist".split())
#: Start tags that end an open element of the same group.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HOLDS = frozenset("ul ol dl table tbody thead tfoot".split())
APART = frozenset("nav footer aside form dialog menu".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
APART_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs cookie cookies comment"
    " comments commentlist consent copyright disclaimer discussion disqus footer gdpr legal login masthead menu menus modal nav"
    " navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion"
    " recommendations recommended related replies reply respond share sharing sidebar sidebars signup skip social sponsor"
    " sponsored subscribe subscription survey teaser toolbar topbar widget widgets alert alerts toast".split()
)
HEADER_NAMES = frozenset(("header", "head", "top"))
#: What follows one of these in a name tells how a page is laid out: ``no-sidebar``, ``has-widgets``.
LAYOUT_PARTS = frozenset(("no", "has", "with", "without"))
DOUBT = 0.3  # of a running word
MAIN = 0.6  # share of the running words from which a box is the main one
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Element:
    tag: str
    number: int
    apart: bool = False
    header: bool = False
    silent: bool = False
    by_name: bool = False  # apart or header by no more than its names or the tag form


@dataclass
class Block:
    path: tuple[int, ...]
    tags: tuple[str, ...]  # of the elements in the path
    marked: tuple[Element, ...]  # apart or header, outermost first
    article: int | None
    heading: bool
    main: bool = False  # the article is a main element
    text: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def apart(self) -> bool:
        return any(e.apart for e in self.marked)

    @property
    def apart_by_kind(self) -> bool:
        """Hidden, or inside an element whose tag or role is that of a menu, footer or the like."""
        return any(e.apart and not e.by_name for e in self.marked)

    @property
    def header(self) -> bool:
        return any(e.header and e.tag not in INLINE for e in self.marked)


class Blocks(HTMLParser):
    """Blocks in page order; character references are decoded, silent elements left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[Element] = []
        self.made = 0
        self.done: list[Block] = []
        self.open: Block | None = None
        self.silent = self.links = 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in ("br", "hr"):
                self.open = None
            return
        if tag in ENDED_BY:
            self._close(ENDED_BY[tag], HOLDS)
        elif tag not in INLINE:
            self._close(("p", "h1", "h2", "h3", "h4", "h5", "h6"), HOLDS | {"td", "th", "li", "div", "section", "article", "body"})
        if tag not in INLINE:
            self.open = None
        self.made += 1
        element = Element(tag, self.made, silent=tag in SILENT)
        self._judge(element, dict(attrs))
        if element.apart and tag in INLINE:
            self.open = None
        self.stack.append(element)
        self.silent += element.silent
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "span", "a", "b", "i"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag == tag:
                self._cut(at)
                return
            if tag in INLINE and self.stack[at].tag not in INLINE:
                return  # an inline end never closes a block

    def handle_data(self, data):
        if self.silent or not data:
            return
        if self.open is None:
            if data.isspace():
                return
            self.open = self._block()
            self.done.append(self.open)
        self.open.text.append(data)
        if self.links:
            self.open.linked += len(data.split())

    def _block(self) -> Block:
        boxes = [e for e in self.stack if e.tag not in INLINE]
        article = next((e for e in boxes if e.tag in ("article", "main")), None)
        heads = any(e.tag in ("h1", "h2", "h3", "h4", "h5", "h6") for e in boxes[-1:])
        numbers, tags = tuple(e.number for e in boxes), tuple(e.tag for e in boxes)
        return Block(numbers, tags, tuple(e for e in self.stack if e.apart or e.header), article and article.number, heads, bool(article) and article.tag == "main")

    def _judge(self, element: Element, attrs: dict) -> None:
        names = set()
        for key in ("class", "id"):
            for name in (attrs.get(key) or "").split():
                parts = [part.lower() for part in NAME_PART.findall(name)]
                names |= set(itertools.takewhile(lambda part: part not in LAYOUT_PARTS, parts))
        role = (attrs.get("role") or "").lower()
        if element.tag not in ("html", "body", "article", "main") or role in APART_ROLES:
            element.apart = element.tag in APART or role in APART_ROLES or bool(names & APART_NAMES)
            element.header = element.tag == "header" or bool(names & HEADER_NAMES)
            element.by_name = element.tag not in (APART - {"form"}) | {"header"} and (role not in APART_ROLES or role == "form")
        elif element.tag == "article":  # readers' comments are often articles of their own
            element.apart = bool(names & {"comment", "comments", "reply", "related", "teaser", "promo", "sponsored", "ad"})
            element.by_name = element.apart
        style = (attrs.get("style") or "").replace(" ", "").lower()
        if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
            element.apart, element.by_name = True, False

    def _close(self, tags: tuple[str, ...], walls) -> None:
        """End the nearest open element of ``tags`` unless one of ``walls`` stands before it."""
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag in tags:
                self._cut(at)
                return
            if self.stack[at].tag in walls:
                return

    def _cut(self, at: int) -> None:
        for element in self.stack[at:]:
            self.silent -= element.silent
            self.links -= element.tag == "a"
            if element.tag not in INLINE or element.apart:
                self.open = None
        del self.stack[at:]


def blocks_of(html: str | None) -> list[Block]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    return parser.done


def free_wrappers(blocks: list[Block], words: list[int]) -> None:
    """Take the marks off page wrappers: elements marked by name that hold the main text.

    From the outermost on, an element is a wrapper if ``main`` lies in it, or the page's
    largest article and that has more running words than all text without marks, or most of
    the running words of the page and four times those without marks. The last two also need
    ten times the words of any article without marks, so a long discussion beside the
    article stays apart. Running words are those outside links and elements that are marked
    by more than a name.
    """
    running = [n - min(n, b.linked) if all(e.by_name for e in b.marked) else 0 for b, n in zip(blocks, words)]
    marks, inside, elements = [len(b.marked) for b in blocks], {}, {}
    articles, plain, plain_articles = Counter(), 0, Counter()
    for i, block in enumerate(blocks):
        for e in block.marked:
            if e.by_name:
                elements[e.number] = e
                inside.setdefault(e.number, []).append(i)
        if block.article is not None and all(e.number < block.article for e in block.marked):
            articles[block.article] += running[i]
        if not marks[i]:
            plain += running[i]
            plain_articles[block.article] += running[i]
    largest, total = max(articles.values(), default=0), sum(running)
    for number in sorted(elements):
        mass = sum(running[i] for i in inside[number])
        held = {blocks[i].article for i in inside[number] if (blocks[i].article or 0) > number}
        article = max((articles[a] for a in held), default=0)
        rival = max((n for a, n in plain_articles.items() if a is not None), default=0)
        main = any(running[i] and blocks[i].main and blocks[i].article > number for i in inside[number])
        most = 2 * mass > total and mass > 4 * plain or article == largest and article > plain
        if main or most and mass > 10 * rival:
            elements[number].apart = elements[number].header = False
            for i in inside[number]:
                marks[i] -= 1
                if not marks[i]:
                    plain += running[i]
                    plain_articles[blocks[i].article] += running[i]


#: Elements that lay out a page; others in a block's path are part of a running text.
LAYOUT = frozenset("div section aside center table td form header footer".split())


@dataclass
class Place:
    """Where a block stands among the running words of its page, whatever its names are."""

    words: int
    usual: float  # words of the block in which a running word of the page stands, on average
    share: float  # of the page's running words in the fullest box around the block
    strange: float  # share of the main box's words that are not in the block's own layout box
    article: bool  # inside the largest article
    outside: bool  # outside an article that has most running words


def places_of(blocks: list[Block], words: list[int]) -> list[Place]:
    """The place of every block.

    The main box is the deepest element of several blocks that holds ``MAIN`` of the page's
    running words: those outside links and outside elements of a kind that is no text; words
    in elements that are none by their names count for ``DOUBT``. A block inside it has its share; another has that of the largest box around it that does
    not hold the main box. A layout element inside the main box with few of its words, such
    as an advert between two paragraphs, is strange there.
    """
    counts = [0 if b.apart_by_kind else DOUBT if b.apart or b.header else 1 for b in blocks]
    running = [count * (n - min(n, b.linked)) for count, b, n in zip(counts, blocks, words)]
    total = max(1, sum(running))
    usual = sum(n * n for n in running) / total
    inside: dict[int, float] = {}
    several: Counter = Counter()
    articles: Counter = Counter()
    for block, n, size in zip(blocks, running, words):
        for number in block.path:
            inside[number] = inside.get(number, 0) + n
            several[number] += 1
        if block.article is not None and not block.apart:
            articles[block.article] += size
    largest = max(articles, key=lambda a: (articles[a], -a), default=None)
    full = [b for b in blocks if any(several[e] > 1 and inside[e] >= MAIN * total for e in b.path)]
    main = max((e for b in full for e in b.path if several[e] > 1 and inside[e] >= MAIN * total), default=None)
    out = []
    for block, n, size in zip(blocks, running, words):
        strange = 0.0
        if main is None or main in block.path:
            share = 1.0 if main is None else inside[main] / total
            below = block.path[block.path.index(main) + 1 :] if main is not None else ()
            tags = block.tags[len(block.path) - len(below) :]
            boxes = [inside[e] for e, tag in zip(below, tags) if tag in LAYOUT]
            if boxes:
                strange = 1 - boxes[0] / max(1, inside[main])
        else:
            share = max([inside[e] for e in block.path if several[e] > 1 and several[e] < len(blocks) and not _holds(e, main, blocks)], default=n) / total
        in_article = block.article is not None and block.article == largest
        outside = largest is not None and not in_article and 2 * inside.get(largest, 0) > total
        out.append(Place(size, usual, share, strange, in_article, outside))
    return out


def _holds(element: int, other: int, blocks: list[Block]) -> bool:
    """Whether ``element`` stands above ``other``; numbers rise from the outside in."""
    return element < other and any(element in b.path and other in b.path for b in blocks)
