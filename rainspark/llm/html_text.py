"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. A block is described by its word count and link
density, those of the blocks before and after it, by the kind of the element it stands in, and by whether
the page marks an article at all. A decision tree (Gini impurity, grown here) is trained on the small
labelled table PAGES, whose blocks are marked, and says which blocks are main text.

Cases: null and empty pages give an empty text; unclosed and cut-off tags end where the page ends;
scripts, styles, comments, text areas and frames are dropped whole, closed or not (as browsers do); character
references are decoded, also without a semicolon where HTML allows it; repeated rows and empty tables
are no matter; only page_id, url and html are read, so further columns cannot clash.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rainspark.llm import words

# fixed values: kinds of elements
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SPACED = frozenset("br wbr img input".split())
#: Dropped to the closing tag or else to the end of the page; dropped to the closing tag or else to the parent's close.
RAW = "script|style|textarea|iframe"
DROPPED = frozenset("noscript template select object svg canvas audio video button".split())
MAIN = frozenset("article main".split())
APART = frozenset("nav header footer aside form menu dialog head title fieldset search".split())
APART_NAMES = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies footer form header login menu modal nav "
    "navbar navigation newsletter notice pagination popup promo promoted related respond reply replies disqus share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar widget".split()
)
#: Words that may follow a name above in a class: comment-list, sidebar-left, ad-slot. Other words make it another thing: ad-free.
PART_WORDS = frozenset(
    "area bar block body bottom box center column container content group holder inner item items left link links list main meta outer panel posts right row section slot "
    "text title top unit wrap wrapper zone".split()
)
#: Words of a class that tells the state of a page or wrapper: has-sidebar, comments-open.
STATE_WORDS = frozenset("has with without no open closed".split())
MAIN_NAMES = frozenset("article content entry main post story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])(?:[^>]*)>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
MARKED = re.compile(r"\bdata-main\b")


@dataclass
class Block:
    #: 1 inside an article, 0 neither, -1 inside an element apart (the innermost that says so decides)
    place: int
    heading: bool
    label: bool = False
    text: list[str] = field(default_factory=list)
    words: int = 0
    linked: int = 0

    def joined(self) -> str:
        return " ".join(html.unescape("".join(self.text)).split())


@dataclass
class Element:
    name: str
    place: int
    heading: bool
    label: bool
    soft: bool = False


def sets_apart(parts: list[str]) -> bool:
    """Whether a class, id or role, given as its words, names something apart from the article.

    It does if its last word is such a name (top-menu, site-footer) or all words after the name are parts of a page
    (comment-list, ad-slot-2); an article's header belongs to it.
    """
    parts = [w for w in parts if w and not w.isdigit()]
    if STATE_WORDS & set(parts) or len(parts) > 1 and parts[-1] == "header" and parts[-2] in MAIN_NAMES:
        return False
    while parts and parts[-1] in PART_WORDS and parts[-1] not in APART_NAMES:
        parts = parts[:-1]
    return bool(parts) and parts[-1] in APART_NAMES


def place_of(name: str, attributes: str, inside: int, soft: bool = False) -> tuple[int, bool]:
    """What an element says about its blocks, and whether it is apart only as a wrapper may be.

    An article or main inside an element apart is an article again, unless its own names say otherwise (a
    comment); an element named as content is only inside a form.
    """
    names, apart = set(), False
    for m in NAMES.finditer(attributes):
        for one in (m[1] or m[2] or m[3] or "").lower().split():
            parts = re.split(r"[^a-z0-9]+", one)
            names.update(parts)
            apart = apart or sets_apart(parts)
    if name in ("html", "body"):
        apart = False
    if name in MAIN and (inside >= 0 or not apart or names & MAIN_NAMES):
        return 1, False
    if inside < 0:
        return (1, False) if soft and names & MAIN_NAMES and not apart and name not in APART else (-1, soft and not apart and name not in APART)
    if apart and not (inside > 0 and name in HEADINGS):
        return -1, False
    if name in APART and not (inside > 0 and name == "header"):
        return -1, name == "form"
    return (1 if inside > 0 or names & MAIN_NAMES else 0), False


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    open_: list[Element] = []
    links, at = 0, 0
    found: list[Block] = []
    block = Block(0, False)
    # the dropped element that is open: name, parent, number of elements around it, how often it is open
    drop: tuple[str, Element | None, int] | None = None
    nested = 0

    def add(text: str) -> None:
        if text and drop is None:
            block.text.append(text)
            if n := len(text.split()):
                block.words += n
                block.linked += n if links else 0

    def cut() -> None:
        nonlocal block
        if block.words:
            found.append(block)
        top = open_[-1] if open_ else Element("", 0, False, False)
        block = Block(top.place, top.heading, top.label)

    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if m[1]:
            add(" ")
        if not m[3]:
            continue
        name, closes = m[3].lower(), bool(m[2])
        if name in DROPPED:
            empty = name == "svg" and m[4].rstrip().endswith("/")
            if drop is None and not closes and not empty:
                add(" ")
                drop, nested = (name, open_[-1] if open_ else None, len(open_)), 1
            elif drop is not None and name == drop[0] and not empty:
                nested += -1 if closes else name in ("svg", "object", "template")
                if not nested:
                    inner = len(open_) > drop[2]
                    del open_[drop[2] :]
                    drop = None
                    if inner:
                        cut()
            continue
        if name in SPACED:
            add(" ")
        if drop is not None and name == "a":
            continue
        if name == "a":
            links = max(0, links - 1) if closes else links + 1
        elif name in BLOCKS:
            links = 0
            if closes:
                for i in range(len(open_) - 1, -1, -1):
                    if open_[i].name == name:
                        del open_[i:]
                        break
            elif name not in VOID:
                # a paragraph, heading or item ends where the next block of its kind begins
                kept = drop is not None and drop[0] not in ("button", "select") and bool(open_) and open_[-1] is drop[1]
                if kept:
                    pass
                elif open_ and open_[-1].name in HEADINGS | {"p"} or open_ and open_[-1].name == name and name in ("li", "dd", "dt", "option", "tr", "td", "th"):
                    open_.pop()
                top = open_[-1] if open_ else Element("", 0, False, False)
                place, soft = place_of(name, m[4], top.place, top.soft)
                open_.append(Element(name, place, name in HEADINGS, top.label or bool(MARKED.search(m[4])), soft))
            if drop is not None and drop[1] is not None and not any(e is drop[1] for e in open_):
                drop = None
            cut()
    add(page[at:])
    cut()
    return found


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "place", "heading", "place_before", "place_after", "marked")


def describe(blocks: list[Block]) -> np.ndarray:
    own = np.array([[b.words, b.linked / b.words] for b in blocks], dtype=np.float64).reshape(-1, 2)
    place = np.array([b.place for b in blocks], dtype=np.float64)
    edge = np.zeros((1, 2))
    before, after = np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])
    kind = np.array([b.heading for b in blocks], dtype=np.float64)
    marked = np.full(len(blocks), float((place > 0).any()))
    return np.column_stack([own, before, after, place, kind, np.concatenate([[0], place[:-1]]), np.concatenate([place[1:], [0]]), marked])


@dataclass
class Tree:
    """Nodes as rows: feature (-1: a leaf), cut, index of the child at or below the cut, above it, and share of main text."""

    nodes: np.ndarray

    @staticmethod
    def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 2) -> Tree:
        nodes: list[list[float]] = []

        def gini(a: np.ndarray) -> float:
            return 2 * a.mean() * (1 - a.mean()) * len(a) if len(a) else 0.0

        def split(rows: np.ndarray, level: int) -> int:
            me = len(nodes)
            nodes.append([-1, 0, me, me, y[rows].mean()])
            best = (gini(y[rows]) - 1e-9, -1, 0.0)
            for f in range(x.shape[1]) if level < depth else ():
                values = np.unique(x[rows, f])
                for cut in (values[:-1] + values[1:]) / 2:
                    low = x[rows, f] <= cut
                    if min(low.sum(), (~low).sum()) >= least:
                        best = min(best, (gini(y[rows][low]) + gini(y[rows][~low]), f, float(cut)))
            if best[1] >= 0:
                low = x[rows, best[1]] <= best[2]
                nodes[me][:2] = best[1:]
                nodes[me][2] = split(rows[low], level + 1)
                nodes[me][3] = split(rows[~low], level + 1)
            return me

        split(np.arange(len(y)), 0)
        return Tree(np.array(nodes))

    def main(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while len(x) and (self.nodes[at, 0] >= 0).any():
            f = np.maximum(self.nodes[at, 0], 0).astype(np.int64)
            at = np.where(x[np.arange(len(x)), f] <= self.nodes[at, 1], self.nodes[at, 2], self.nodes[at, 3]).astype(np.int64)
        return self.nodes[at, 4] > 0.5


# The labelled table: blocks of an element marked data-main are main text, all others are not. Each body stands in each frame.
def _say(n: int) -> str:
    """The first n words of a short report, told again if it ends."""
    told = (
        "The river rose after three days of rain and the town closed both bridges before noon while crews carried sand to the lower streets and neighbours "
        "brought what they could up to the church on the hill where tea was made until the water fell late on the second night"
    ).split()
    return " ".join(told[i % len(told)] for i in range(n))


def _row(shape: str, mark: str = "") -> str:
    """Blocks from `tag:words` or `tag:words:linked`, the last words of a block being links."""
    made = []
    for part in shape.split():
        tag, n, linked = (*part.split(":"), "0")[:3]
        text, link = _say(int(n) - int(linked)), _say(int(linked))
        made.append(f"<{tag}{mark}>{text}{f' <a href=/x>{link}</a>' if link else ''}</{tag}>")
    return "".join(made)


#: Bodies of pages that mark no article, and of articles.
PLAIN = (
    "h1:3 p:40 p:35", "p:12 p:15 p:9 p:22", "h2:4 p:18 p:3 p:20", "p:60 h3:2 p:50 p:5 p:45", "p:30 li:6 li:8 li:5 p:25", "p:25:3 p:40:5 p:30", "div:80", "p:8 p:10 p:7 p:11",
    "h1:6 p:2 p:30 p:26", "blockquote:15 p:20 pre:10", "h1:5 p:23 p:14 h2:3 p:19 p:21", "p:17:4 p:6 p:16",
)
ARTICLES = (
    "h1:3 p:40 p:3 p:35", "p:3 p:1", "h2:1 p:23 blockquote:3 li:1 li:3", "h1:1 p:23 p:4:3 td:1 td:2", "p:120 p:2", "h1:4 h2:2 p:8 li:3:3 li:2:2 p:9", "p:30:30 p:14", "h1:2 p:18 h2:2 p:1",
)
_LINKS, _HEADLINES = "".join(_row("li:1:1 li:3:3 li:2:2")), "".join(_row("li:7:7 li:9:9 li:12:12 li:6:6"))
#: Each with a place for the body.
FRAMES = (
    "<title>Flood</title>{}",
    f"<nav><ul>{_LINKS}</ul></nav>{{}}<footer>{_row('p:40')}&copy; 2020 The Paper</footer>",
    f"<ul>{_LINKS}</ul><div>{{}}</div><div><a href=/x>Privacy</a> <a href=/y>Terms of use</a></div><div>All rights reserved</div>",
    f"{_row('p:6')}<ul>{_LINKS}</ul>{{}}<p><a href=/z>Imprint</a></p>{_row('p:11')}<p><a href=/y>Terms</a></p>{_row('p:9')}",
    f"{_row('div:13')}<ul>{_LINKS}</ul>{_row('div:5')}<ul>{_HEADLINES}</ul>{{}}<ul>{_HEADLINES}</ul>{_row('div:16 div:8:8 div:4')}",
    f"<div class=top-menu>{_row('p:23')}</div><div class=ad>{_row('p:60 p:45')}</div>{{}}<aside>{_row('h3:2 p:30')}</aside><section class=comments>{_row('h3:2 p:20 p:1 p:35')}</section>",
    f"<h1>The Paper</h1><ul>{_LINKS}</ul>{{}}<h3>Most read</h3><ul>{_HEADLINES}</ul><p>Mail to us</p>",
    f"{{}}<h4>Most read</h4><ul>{_LINKS}</ul><p>Read also:</p><ul>{_LINKS}</ul>",
    f"<p><a href=/>Home</a> <a href=/n>News</a></p>{{}}<p>Page 1</p><p><a href=/2>Next page</a></p><form>{_row('p:14')}</form>",
)
#: What holds an article, and what stands in it that is not of it.
HOLDERS = (
    "<article data-main>{}</article>", "<main data-main>{}</main>", "<div class=content data-main>{}</div>", "<div id=post-12 data-main>{}</div>",
    "<article><div data-main>{}</div><div class=share><a href=/f>Share</a></div>" + f"<div class=comment-list>{_row('p:21 p:1')}</div></article>",
    "<article><div class=advert>" + _row("p:23") + "</div><div data-main>{}</div></article>" + _row("p:34"),
)
PAGES = tuple(frame.format(_row(body, " data-main")) for frame in FRAMES for body in PLAIN) + tuple(
    frame.format(HOLDERS[(i + j) % len(HOLDERS)].format(_row(body))) for i, frame in enumerate(FRAMES) for j, body in enumerate(ARTICLES)
) + tuple(_row("h1:4", " data-main") + HOLDERS[0].format(_row(body)) for body in ARTICLES[:4])


@functools.cache
def trained() -> Tree:
    blocks = [blocks_of(p) for p in PAGES]
    return Tree.grow(np.concatenate([describe(b) for b in blocks]), np.array([b.label for page in blocks for b in page], dtype=np.float64))


def main_text(page: str, tree: Tree) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    return "\n".join(filter(None, (b.joined() for b, main in zip(blocks, tree.main(describe(blocks))) if main)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages(page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trained()
        for part in words.slices(batches, "html"):
            texts = [main_text(p or "", tree) for p in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", "html").mapInArrow(run, f"{kinds}, text string, n_chars long")
