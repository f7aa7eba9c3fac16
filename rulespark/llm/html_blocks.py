"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at block-level tags into flat blocks of text. A block's features
are its number of words and its link density, those of its neighbours, and what
it stands in: an article, a list, a heading, or a container that is never main
text (menu, header, footer, sidebar, notice, advert, form, comments). A decision
tree says which blocks are main text. It is grown (Gini impurity) on the small
table of labelled blocks in ``LABELLED``, at every call and on the driver; the
table is fixed and has some dozens of rows.

Scripts, styles, comments and markup are no text. Character references are
decoded, white space inside a block becomes one blank, blocks are trimmed and
joined by a line feed in page order. Null and empty pages, and pages without
main text, give the empty text; markup that is cut off or never closed is read
as far as it goes. Pages are read whole; rows stay as they are, repeated or not.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.llm.shared import slices, text_or_empty

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|math|object|select|textarea|button)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*+)(?P<rest>(?>[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>?"
    r"|<[!?/][^>]*>?",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
SPLIT_NAME = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: closed by the next block, or never
LOOSE = frozenset("p li dt dd td th tr option h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTSIDE = frozenset("nav header footer aside form dialog menu head figcaption".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar aside widget cookie cookies consent notice notices alert gdpr popup modal"
    " subscribe newsletter signup login share sharing social related recommended comments comment respond disqus replies reply form search pagination pager toolbar masthead copyright complementary contentinfo".split()
)
INSIDE_WORDS = frozenset("article post content entry main story body".split())


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    article: bool
    outside: bool
    heading: bool
    listed: bool


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in its order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []
    article = outside = listed = False
    heading = link = False
    parts: list[str] = []
    linked = 0
    in_title = False

    def end() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = SPACES.sub(" ", html.unescape(raw) if "&" in raw else raw).strip()
            if text:
                out.append(Block(text, text.count(" ") + 1, linked, article, outside, heading, listed))
        parts.clear()
        linked = 0

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at and not in_title:
            piece = page[at : m.start()]
            parts.append(piece)
            if link:
                linked += len(piece.split())
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        closing = bool(m["close"])
        if name in INLINE:
            if name == "a":
                link = not closing
            elif name == "br":
                parts.append(" ")
            continue
        end()
        link = False
        if name == "title":
            in_title = not closing
            continue
        if name in HEADINGS:
            heading = not closing
            continue
        heading = False
        if name in VOID or name in LOOSE and name != "li":
            continue
        if name == "li":
            listed = not closing or any(x[0] in ("ul", "ol") for x in stack)
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    _, article, outside, listed = stack[i]
                    del stack[i:]
                    break
            continue
        if m["rest"].endswith("/"):
            continue
        stack.append((name, article, outside, listed))
        marks = set()
        for _, x, y, z in ATTRIBUTE.findall(m["rest"]):
            marks.update(SPLIT_NAME.findall((x or y or z).lower()))
        if name in ("article", "main") or marks & INSIDE_WORDS and not marks & OUTSIDE_WORDS:
            article = True
        if name in OUTSIDE and not (name == "header" and article) or marks & OUTSIDE_WORDS and name not in ("body", "html", "article", "main"):
            outside = True
        listed = listed or name in ("ul", "ol")
    if at < len(page) and not in_title:
        parts.append(page[at:])
    end()
    return out


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "in article", "outside", "heading", "listed")


def features(page: list[Block]) -> np.ndarray:
    n = len(page)
    own = np.array([(b.words, b.linked / b.words, b.article, b.outside, b.heading, b.listed) for b in page], np.float64).reshape(n, 6)
    out = np.zeros((n, len(FEATURES)))
    out[:, 0:2] = own[:, 0:2]
    out[1:, 2:4] = own[:-1, 0:2]
    out[:-1, 4:6] = own[1:, 0:2]
    out[:, 6:] = own[:, 2:]
    return out


_LONG = "One sentence of running text follows another here, with commas, and it takes its time before it ends. "
#: (page, whether each of its blocks is main text)
LABELLED: list[tuple[str, str]] = [
    (f"<body><nav><ul><li><a href=/>Home</a><li><a href=/n>News of the day</a></ul></nav><div class=ad>Buy this now, it is a very good thing to have for all.</div><article><h1>A title</h1><p>{_LONG}</p><p>Short one.</p><p>{_LONG * 3}</p></article><footer>&copy; all rights reserved by the owner of this site, as ever</footer></body>", "00011110"),
    (f"<div id=header>The Daily Page, a paper for all</div><div class='main content'><h2>Head</h2><p>{_LONG}</p><ul><li>first point</li><li>second point of the list</li></ul><p>{_LONG}</p></div><div class=sidebar><p>{_LONG}</p><a href=x>more of this</a></div>", "01111100"),
    (f"<table><tr><td><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></td><td><p>{_LONG * 2}</p><p>{_LONG}</p><p>{_LONG}</p></td></tr></table><p><a href=c>Contact</a> <a href=i>Imprint</a></p>", "01110"),
    (f"<article><header><h1>Another title of a text</h1></header><p>{_LONG}</p><blockquote>Quoted words.</blockquote><aside>{_LONG}</aside><p>Be.</p><div class=comments><h3>Comments</h3><p>{_LONG}</p><p>I agree.</p></div></article>", "11101000"),
    (f"<div class=cookie-notice><p>{_LONG}</p></div><main><p>{_LONG}</p><form><p>Your name and address, please</p><label>Mail</label></form><p>{_LONG}</p></main><footer><p>{_LONG}</p></footer>", "010010"),
    (f"<body><div><p>{_LONG}</p><p>{_LONG}</p></div><div><a href=1>Read on: the next story is here</a></div><div><a href=2>And one more story for you</a></div></body>", "1100"),
    (f"<div>Menu</div><div><a href=q>a link</a></div><div><a href=q>one more link</a></div><div>{_LONG * 4}</div><div>{_LONG * 2}</div><div>Terms</div>", "000110"),
    ("<article><p>Yes.</p></article>", "1"),
    ("<article><h1>Only a title</h1></article><div class='related posts'><a href=1>Other text</a></div>", "10"),
    (f"<article><p>See <a href=1>the whole long list of places and names that we have put together here</a>.</p><p>{_LONG}</p><ul><li><a href=a>Point</a></li></ul></article>", "111"),
]


class Tree(NamedTuple):
    """Nodes as arrays; feature -1 is a leaf."""

    feature: np.ndarray
    bar: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return self.share[at] >= 0.5
            i = at[inner]
            at[inner] = np.where(x[inner, f[inner]] <= self.bar[i], self.low[i], self.high[i])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> Tree:
    """A binary tree with the splits of least Gini impurity; ties go to the
    earlier feature and the lower bar."""
    nodes: list[list] = []

    def node(rows: np.ndarray, left: int) -> int:
        at, own = len(nodes), y[rows]
        nodes.append([-1, 0.0, 0, 0, float(own.mean()) if len(own) else 0.0])
        if not left or not len(rows) or own.min() == own.max():
            return at
        best = (np.inf, 0, 0.0)
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for bar in ((values[1:] + values[:-1]) / 2).tolist():
                side = x[rows, f] <= bar
                cost = sum(s.sum() * own[s].mean() * (1 - own[s].mean()) for s in (side, ~side))
                if cost < best[0] - 1e-12:
                    best = (cost, f, bar)
        if best[0] < np.inf:
            side = x[rows, best[1]] <= best[2]
            nodes[at][:4] = best[1], best[2], node(rows[side], left - 1), node(rows[~side], left - 1)
        return at

    node(np.arange(len(x)), depth)
    feature, bar, low, high, share = zip(*nodes)
    return Tree(np.array(feature), np.array(bar), np.array(low), np.array(high), np.array(share))


def trained(table: list[tuple[str, str]] | None = None) -> Tree:
    rows, labels = [], []
    for page, marks in LABELLED if table is None else table:
        found = blocks(page)
        if len(found) != len(marks):
            raise ValueError(f"{len(found)} blocks have {len(marks)} labels: {page[:60]}")
        rows.append(features(found))
        labels += [int(m) for m in marks]
    return grow(np.concatenate(rows), np.array(labels))


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, tree.predict(features(found))) if keep)


def _extracted(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x, tree) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text_or_empty(page).alias("html"))
    return rows.mapInArrow(_extracted(trained()), "page_id long, url string, text string, n_chars long")
