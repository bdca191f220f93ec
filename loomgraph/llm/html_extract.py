"""Main text of HTML pages by classified text blocks.

A page becomes a flat list of text blocks. Each block is described by its word count and its link
density and by those of its neighbours. A decision tree, grown here from a small labelled table, says
which blocks are content; it splits on these numbers first, and only where they leave a region of
blocks mixed does it ask what encloses a block. The blocks' texts, joined, are the page's main text.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

# Element names of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not text of the page.
SILENT_TAGS = frozenset("script style noscript template svg math iframe object canvas audio video textarea select head title button noframes".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe noframes template".split())
BOILER_TAGS = frozenset("nav header footer aside form menu dialog search".split())
CONTENT_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a class, id or role that mark what is not the article.
BOILER_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs sidebar side rail widget header masthead topbar footer foot bottom copyright legal disclaimer cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login search form share sharing social related "
    "recommended recommendations comment comments disqus reply replies responses discussion toolbar pagination pager tags "
    "contentinfo complementary".split()
)
#: Of these, such as articles' own parts have too: they don't settle what a block is.
SOFT_WORDS = frozenset("header masthead search form discussion top bottom side tags".split())
#: Elements whose end tag may be left out: one ends where the next of its kind begins.
LOOSE_TAGS = frozenset("p li dd dt tr td th option".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_WHITE = re.compile(r"\s+")


@dataclass
class Block:
    text: str = ""
    words: int = 0
    link_words: int = 0
    boiler: int = 0  # depth of enclosing elements that hold no article text
    soft: int = 0  # depth of those that may hold some
    content: int = 0  # stands in an article or main element
    heading: int = 0

    @property
    def link_density(self) -> float:
        return self.link_words / self.words if self.words else 0.0


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _marks(attributes: dict[str, str]) -> tuple[bool, bool]:
    """Whether class, id and role mark what is not the article, and whether what may not be."""
    words = {p.lower() for name in ("class", "id", "role") for p in _PARTS.findall(attributes.get(name, ""))} & BOILER_WORDS
    return bool(words - SOFT_WORDS), bool(words & SOFT_WORDS)


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(_NOT_SHOWN.search(attributes.get("style", "")))


@dataclass
class _Open:
    tag: str
    boiler: bool = False
    soft: bool = False
    content: bool = False
    silent: bool = False


def text_blocks(page: str) -> list[Block]:
    """The page's text blocks in order: runs of text between block elements, white space collapsed,
    character references decoded. Unclosed and stray tags are taken as they come: what is hidden or
    silent ends with its element, at the latest where an element around it ends."""
    blocks: list[Block] = []
    stack: list[_Open] = []
    boiler = soft = content = silent = links = heading = 0
    parts: list[tuple[str, bool]] = []

    def close() -> None:
        nonlocal parts
        if parts:
            text = _WHITE.sub(" ", "".join(p for p, _ in parts)).strip()
            if text:
                linked = sum(len(p.split()) for p, link in parts if link)
                n = len(text.split())
                blocks.append(Block(text, n, min(n, linked), boiler, soft, int(content > 0), heading))
            parts = []

    def pop() -> str:
        nonlocal boiler, soft, content, silent, links, heading
        x = stack.pop()
        boiler -= x.boiler
        soft -= x.soft
        content -= x.content
        silent -= x.silent
        links -= x.tag == "a"
        heading = 0 if x.tag in HEADINGS else heading
        return x.tag

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        raw = page[at : m.start() if m else n]
        if raw and not silent:
            parts.append((html_entities.unescape(raw), links > 0))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                close()
            if any(x.tag == tag for x in stack):
                while pop() != tag:
                    pass
            continue
        if tag in BLOCK_TAGS:
            close()
        if tag in VOID_TAGS or m[3].rstrip().endswith("/") and tag in ("path", "use", "g"):
            continue
        if tag in RAW_TAGS:  # up to its end tag there are no elements
            e = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = e.end() if e else n
            continue
        if tag in LOOSE_TAGS and stack and stack[-1].tag == tag:
            pop()
        if tag == "body" and any(x.tag == "head" for x in stack):
            while pop() != "head":
                pass
        attributes = _attributes(m[3])
        strong, mild = (False, False) if tag in CONTENT_TAGS or tag in ("body", "html") else _marks(attributes)
        x = _Open(tag, strong or tag in BOILER_TAGS and not (tag == "header" and content), mild, tag in CONTENT_TAGS, tag in SILENT_TAGS or _hidden(attributes))
        if not content and mild and tag != "body":  # around the article, not in it, a soft mark is enough
            x.boiler, x.soft = True, False
        stack.append(x)
        boiler += x.boiler
        soft += x.soft
        content += x.content
        silent += x.silent
        links += tag == "a"
        if tag in HEADINGS:
            heading = 1
    close()
    return blocks


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "boiler", "soft", "content", "heading", "page_has_content")
#: The first of them describe texts, the others what encloses them.
TEXT_FEATURES = 6


def features(blocks: list[Block]) -> list[tuple[float, ...]]:
    has = float(any(b.content for b in blocks))
    out = []
    for k, b in enumerate(blocks):
        p = blocks[k - 1] if k else Block()
        q = blocks[k + 1] if k + 1 < len(blocks) else Block()
        out.append((b.words, b.link_density, p.words, p.link_density, q.words, q.link_density, b.boiler, b.soft, b.content, b.heading, has))
    return out


# Fixed values, the labelled table: (values of FEATURES..., is content).
LABELLED = (
    # pages with an article element: paragraphs, short and long, headings and lists in it
    (140, 0.0, 9, 0.0, 85, 0.0, 0, 0, 1, 0, 1, 1),
    (85, 0.02, 140, 0.0, 60, 0.0, 0, 0, 1, 0, 1, 1),
    (60, 0.0, 85, 0.0, 2, 0.0, 0, 0, 1, 0, 1, 1),
    (2, 0.0, 60, 0.0, 45, 0.0, 0, 0, 1, 0, 1, 1),
    (1, 0.0, 2, 0.0, 12, 0.0, 0, 0, 1, 0, 1, 1),
    (12, 0.0, 1, 0.0, 9, 0.0, 0, 0, 1, 0, 1, 1),
    (9, 0.0, 8, 0.0, 140, 0.0, 0, 0, 1, 1, 1, 1),
    (4, 0.0, 30, 0.0, 30, 0.0, 0, 0, 1, 1, 1, 1),
    (7, 0.4, 30, 0.0, 30, 0.1, 0, 0, 1, 0, 1, 1),
    (3, 1.0, 30, 0.1, 30, 0.0, 0, 0, 1, 0, 1, 1),
    (30, 0.1, 12, 0.0, 0, 0.0, 0, 0, 1, 0, 1, 1),
    (25, 0.0, 12, 0.0, 9, 0.6, 0, 0, 1, 0, 1, 1),
    (30, 1.0, 20, 1.0, 20, 1.0, 0, 0, 1, 0, 1, 1),
    (10, 0.0, 5, 1.0, 5, 1.0, 0, 0, 1, 0, 1, 1),
    (6, 0.0, 40, 0.0, 10, 1.0, 0, 0, 1, 0, 1, 1),
    (6, 1.0, 6, 1.0, 95, 0.0, 0, 0, 1, 0, 1, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 1, 0, 1, 1),
    (3, 1.0, 0, 0.0, 4, 0.0, 0, 0, 1, 0, 1, 1),
    (4, 1.0, 40, 0.0, 60, 0.0, 0, 0, 1, 0, 1, 1),
    (45, 0.0, 70, 0.0, 3, 1.0, 0, 0, 1, 0, 1, 1),
    (80, 0.0, 30, 0.0, 5, 0.9, 0, 0, 1, 0, 1, 1),
    (15, 0.0, 55, 0.0, 2, 1.0, 0, 0, 1, 0, 1, 1),
    (8, 0.0, 3, 1.0, 60, 0.0, 0, 0, 1, 0, 1, 1),
    (35, 0.0, 2, 1.0, 2, 1.0, 0, 0, 1, 0, 1, 1),
    # in an article: adverts, share bars, related links, reader comments, forms
    (8, 0.0, 60, 0.0, 45, 0.0, 1, 0, 1, 0, 1, 0),
    (14, 0.5, 60, 0.0, 45, 0.0, 1, 0, 1, 0, 1, 0),
    (35, 0.0, 60, 0.0, 40, 0.0, 1, 0, 1, 0, 1, 0),
    (70, 0.0, 35, 0.0, 60, 0.0, 2, 0, 1, 0, 1, 0),
    (2, 1.0, 45, 0.0, 2, 1.0, 1, 0, 1, 0, 1, 0),
    (5, 0.0, 60, 0.0, 4, 1.0, 2, 0, 1, 1, 1, 0),
    (28, 0.0, 3, 1.0, 40, 0.0, 1, 0, 1, 0, 1, 0),
    (20, 0.0, 50, 0.0, 3, 1.0, 1, 0, 1, 0, 1, 0),
    (50, 0.0, 2, 1.0, 3, 1.0, 1, 0, 1, 0, 1, 0),
    # outside the article: menus, adverts, notices, side texts, footers
    (1, 1.0, 0, 0.0, 1, 1.0, 2, 0, 0, 0, 1, 0),
    (2, 1.0, 1, 1.0, 2, 1.0, 1, 0, 0, 0, 1, 0),
    (8, 0.0, 1, 1.0, 9, 0.0, 1, 0, 0, 0, 1, 0),
    (22, 0.0, 1, 1.0, 9, 0.0, 1, 0, 0, 0, 1, 0),
    (60, 0.0, 8, 1.0, 12, 0.0, 1, 0, 0, 0, 1, 0),
    (45, 0.1, 60, 0.0, 9, 0.0, 0, 0, 0, 0, 1, 0),
    (90, 0.0, 30, 0.0, 40, 0.0, 0, 0, 0, 0, 1, 0),
    (9, 0.0, 2, 1.0, 60, 0.0, 0, 0, 0, 1, 1, 0),
    (12, 0.0, 30, 0.0, 0, 0.0, 1, 0, 0, 0, 1, 0),
    (7, 0.3, 30, 0.0, 0, 0.0, 0, 0, 0, 0, 1, 0),
    (4, 1.0, 30, 0.0, 4, 1.0, 0, 0, 0, 0, 1, 0),
    (30, 0.0, 40, 0.0, 3, 1.0, 0, 0, 0, 0, 1, 0),
    (14, 0.0, 2, 1.0, 30, 0.0, 0, 0, 0, 0, 1, 0),
    (25, 0.0, 4, 1.0, 5, 1.0, 0, 0, 0, 0, 1, 0),
    # pages without one: what encloses a block first, then its density and its neighbours'
    (120, 0.0, 8, 0.0, 70, 0.0, 0, 0, 0, 0, 0, 1),
    (70, 0.05, 120, 0.0, 30, 0.0, 0, 0, 0, 0, 0, 1),
    (30, 0.0, 70, 0.0, 20, 0.1, 0, 0, 0, 0, 0, 1),
    (20, 0.1, 30, 0.0, 5, 0.0, 0, 0, 0, 0, 0, 1),
    (5, 0.0, 45, 0.0, 60, 0.0, 0, 0, 0, 0, 0, 1),
    (3, 0.0, 60, 0.0, 25, 0.0, 0, 0, 0, 0, 0, 1),
    (8, 0.0, 2, 1.0, 120, 0.0, 0, 0, 0, 1, 0, 1),
    (6, 0.0, 40, 0.0, 55, 0.0, 0, 0, 0, 1, 0, 1),
    (14, 0.2, 25, 0.0, 40, 0.0, 0, 0, 0, 0, 0, 1),
    (60, 0.0, 40, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1),
    (40, 0.0, 30, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 1),
    (2, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1),
    (25, 0.0, 0, 0.0, 1, 0.0, 0, 0, 0, 0, 0, 1),
    (2, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 0),
    (1, 1.0, 2, 1.0, 1, 1.0, 0, 0, 0, 0, 0, 0),
    (3, 1.0, 1, 1.0, 8, 0.0, 0, 0, 0, 0, 0, 0),
    (5, 0.8, 60, 0.0, 6, 0.9, 0, 0, 0, 0, 0, 0),
    (18, 0.7, 60, 0.0, 12, 0.8, 0, 0, 0, 0, 0, 0),
    (25, 0.9, 10, 0.5, 30, 0.0, 0, 0, 0, 0, 0, 0),
    (6, 0.0, 4, 1.0, 4, 1.0, 0, 0, 0, 0, 0, 0),
    (40, 0.0, 60, 0.0, 35, 0.0, 1, 0, 0, 0, 0, 0),
    (9, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 0, 0, 0),
    (22, 0.0, 1, 1.0, 60, 0.0, 1, 0, 0, 0, 0, 0),
    (80, 0.0, 20, 0.0, 90, 0.0, 2, 0, 0, 0, 0, 0),
    (4, 0.0, 60, 0.0, 3, 1.0, 1, 0, 0, 1, 0, 0),
    # softly marked parts of an article: its own header, a discussion, results that it shows; short ones are page furniture
    (60, 0.0, 40, 0.0, 50, 0.0, 0, 1, 1, 0, 1, 1),
    (35, 0.1, 60, 0.0, 20, 0.0, 0, 1, 1, 0, 1, 1),
    (22, 0.0, 30, 0.0, 60, 0.0, 0, 2, 1, 0, 1, 1),
    (16, 0.0, 9, 0.0, 30, 0.0, 0, 1, 1, 0, 1, 1),
    (9, 0.0, 2, 1.0, 70, 0.0, 0, 1, 1, 1, 1, 1),
    (5, 0.0, 30, 0.0, 60, 0.0, 0, 1, 1, 1, 1, 1),
    (3, 0.0, 60, 0.0, 4, 1.0, 0, 1, 1, 0, 1, 0),
    (6, 0.0, 30, 0.0, 30, 0.0, 0, 1, 1, 0, 1, 0),
    (2, 1.0, 60, 0.0, 2, 1.0, 0, 1, 1, 0, 1, 0),
    (12, 0.9, 45, 0.0, 9, 0.8, 0, 1, 1, 0, 1, 0),
    (8, 0.6, 60, 0.0, 30, 0.0, 0, 1, 1, 0, 1, 0),
    (1, 1.0, 40, 0.0, 0, 0.0, 0, 1, 1, 0, 1, 0),
    (3, 1.0, 20, 0.0, 30, 0.0, 0, 1, 1, 0, 1, 0),
    # blocks of whole pages with menus, an advert before the article, and a footer after it
    (1, 1.0, 1, 1.0, 6, 0.0, 1, 0, 0, 0, 1, 0),
    (6, 0.0, 1, 1.0, 12, 0.0, 1, 0, 0, 0, 1, 0),
    (12, 0.0, 6, 0.0, 35, 0.0, 0, 0, 1, 1, 1, 1),
    (12, 0.0, 1, 1.0, 40, 0.0, 0, 0, 1, 1, 1, 1),
    (110, 0.0, 55, 0.0, 9, 0.0, 0, 0, 1, 0, 1, 1),
    (20, 0.0, 110, 0.0, 9, 0.0, 0, 0, 1, 0, 1, 1),
    (9, 0.0, 110, 0.0, 0, 0.0, 1, 0, 0, 0, 1, 0),
    (10, 0.0, 20, 0.0, 0, 0.0, 1, 0, 0, 0, 1, 0),
    (18, 0.0, 90, 0.0, 0, 0.0, 0, 0, 1, 0, 1, 1),
)


# Fixed values: (words, link density) of a block, of the one before and of the one after it.
PROFILES = (
    (90, 0.0, 60, 0.0, 70, 0.0),
    (12, 0.0, 60, 0.0, 70, 0.0),
    (30, 0.1, 9, 0.0, 3, 1.0),
    (10, 0.0, 2, 1.0, 60, 0.0),
    (40, 0.0, 70, 0.0, 0, 0.0),
    (25, 0.0, 5, 1.0, 4, 1.0),
    (3, 1.0, 4, 1.0, 3, 1.0),
    (5, 0.9, 70, 0.0, 3, 1.0),
    (4, 1.0, 60, 0.0, 50, 0.0),
    (25, 0.8, 5, 1.0, 80, 0.0),
    (9, 0.6, 30, 0.0, 0, 0.0),
    (3, 1.0, 0, 0.0, 5, 0.0),
)
# What encloses a block on a page with an article (boiler, soft, content, heading), is content.
ENCLOSURES = ((0, 0, 1, 0, 1), (0, 0, 1, 1, 1), (1, 0, 1, 0, 0), (1, 0, 1, 1, 0), (1, 0, 0, 0, 0), (0, 0, 0, 0, 0), (0, 0, 0, 1, 0))
#: Whatever the texts are, these settle it; so each kind of text is labelled in each of them.
SETTLED = tuple((*p, *e[:4], 1, e[4]) for p in PROFILES for e in ENCLOSURES)


@dataclass
class Node:
    feature: int = -1  # a leaf
    limit: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None
    content: bool = False


#: How much purer (as impure rows) a split on texts must be to be preferred to one on what encloses them.
MARGIN = 3.0


def _best_split(rows, among: range, least: int):
    """(impurity, feature, limit) of the best split by Gini impurity; the first one wins."""
    best = None
    for f in among:
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            limit = (a + b) / 2
            low = [r[-1] for r in rows if r[f] <= limit]
            high = [r[-1] for r in rows if r[f] > limit]
            if min(len(low), len(high)) < least:
                continue
            impurity = sum(2 * sum(x) * (len(x) - sum(x)) / len(x) for x in (low, high))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, limit)
    return best


def grow(rows, depth: int = 10, on_texts: int = 2, least: int = 6) -> Node:
    """A decision tree. The first ``on_texts`` levels split on word counts and link densities, leaving
    ``least`` rows on each side; below, mixed regions are split on any feature, enclosing ones first."""
    yes = sum(r[-1] for r in rows)
    if not depth or yes in (0, len(rows)) or len(rows) < 2:
        return Node(content=2 * yes > len(rows))
    best = _best_split(rows, range(TEXT_FEATURES), least) if on_texts else None
    if best is None:
        on_texts = 0
        around, all_ = _best_split(rows, range(TEXT_FEATURES, len(FEATURES)), 1), _best_split(rows, range(len(FEATURES)), 1)
        best = around if around and around[0] < all_[0] + MARGIN else all_
    if best is None:
        return Node(content=2 * yes > len(rows))
    _, f, limit = best
    low, high = [r for r in rows if r[f] <= limit], [r for r in rows if r[f] > limit]
    on_texts = max(0, on_texts - 1)
    return Node(f, limit, grow(low, depth - 1, on_texts, least), grow(high, depth - 1, on_texts, least))


@lru_cache(maxsize=4)
def content_tree(rows=LABELLED + SETTLED) -> Node:
    return grow(rows)


def is_content(tree: Node, x: tuple[float, ...]) -> bool:
    while tree.feature >= 0:
        tree = tree.low if x[tree.feature] <= tree.limit else tree.high
    return tree.content


def main_text(page: str | None, tree: Node | None = None) -> str:
    """The main text of a page; empty for a null or empty page, or one without content."""
    blocks = text_blocks(page or "")
    tree = tree or content_tree()
    return "\n\n".join(b.text for b, x in zip(blocks, features(blocks), strict=True) if is_content(tree, x))


def extract_pages(pages: DataFrame, html: str = "html", labelled=LABELLED + SETTLED) -> DataFrame:
    """Adds ``text`` and ``n_chars`` to (page_id, url) of pages(page_id, url, html).

    Null and empty pages give an empty text; repeated rows are extracted each; an empty table gives an
    empty result; other columns are ignored. One page at a time is held parsed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = content_tree(labelled)
        for batch in batches:
            texts = [main_text(page, tree) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return in_arrow(plain, run, "page_id long, url string, text string, n_chars long")
