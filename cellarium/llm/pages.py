"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text nodes, each with its path of tags from the root. For every
path, text length and punctuation are aggregated over its nodes and divided by their number; the
ratios are smoothed along the page, fused by their product and held against a threshold. Every node
that passes is in the article. The content's container (what is marked as article or main, else the
innermost container of all selected text) only adds to them: its nodes stay whatever their ratio, so
that headings and short paragraphs do. Nodes under tags or names of page furniture (menus, adverts,
forms, comments and so on) take no part; but a name alone does not drop an element with most of the
page's text, nor all there is.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?][^>]*>?", re.S
)
_NAMES = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
#: Text of these is not parsed as markup.
_RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "noembed", "noframes", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_FURNITURE = {
    "head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "canvas", "object",
    "video", "audio", "map", "fieldset", "input", "label",
} | _RAW
_FURNITURE_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "adbox", "adsense", "sponsor", "sponsored", "promo", "promotion",
    "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "nav",
    "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "foot",
    "comment", "comments", "disqus", "respond", "reply", "replies", "share", "sharing", "social", "related",
    "recommended", "newsletter", "subscribe", "subscription", "login", "signup", "search", "toolbar", "pagination",
    "pager", "widget", "masthead", "contentinfo", "complementary", "copyright",
}
#: Before a furniture word these tell of an element's state or layout, not of what it is.
_ABOUT = {"has", "have", "is", "no", "not", "with", "without", "show", "hide", "enable", "disable"}
_BLOCK = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption",
    "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | _FURNITURE
#: An opening tag of the key ends an open one of the value that is nearer than the bound.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "option": ({"option"}, {"select"})}
_MAIN = {"article", "main"}
#: What can be the content's container.
_BOX = {"article", "body", "center", "div", "html", "main", "section", "td"}
_STOPS = re.compile(r"[.,;:!?¡¿、。，！？…]")
SPREAD = 1.0
THRESHOLD = 0.5


class Node:
    __slots__ = ("path", "boxes", "text", "block", "named")

    def __init__(self, path: str, boxes: tuple[int, ...], text: str, block: int, named: tuple[int, ...] = ()):
        self.path, self.boxes, self.text, self.block, self.named = path, boxes, text, block, named


def _named(attrs: str, main: bool) -> bool:
    """Whether a whole token of class, id or role, or its last part, names page furniture."""
    for m in _NAMES.finditer(attrs):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            parts = _PARTS.findall(token)
            if parts and (parts[-1] in _FURNITURE_NAMES or (parts[-1] == "header" and not main)) and _ABOUT.isdisjoint(parts[:-1]):
                return True
    return False


def _unnamed(nodes: list[Node]) -> list[Node]:
    """Nodes that stand in no element named as furniture, unless that has most of the page's text.

    An element apart from what the page marks as the article is dropped by its name all the same.
    """
    weights: dict[int, int] = defaultdict(int)
    total = 0
    near: set[int] = set()  # named elements in or around an article
    apart = False  # an article stands in no named element
    for n in nodes:
        size = len(n.text.strip())
        total += size
        main = not _MAIN.isdisjoint(n.path.split("/"))
        apart |= main and not n.named
        for b in n.named:
            weights[b] += size
            if main:
                near.add(b)
    left = [n for n in nodes if all(weights[b] * 2 > total and (b in near or not apart) for b in n.named)]
    return left if any(n.text.strip() for n in left) else nodes


def nodes_of(page: str) -> list[Node]:
    """Text nodes outside page furniture, in page order; ``block`` counts the blocks they stand in."""
    stack: list[tuple[str, int, bool, bool]] = []  # tag, number of the element, furniture, named so
    out: list[Node] = []
    block = number = at = 0
    out_of = 0  # open furniture elements
    end = len(page)

    def text(s: str) -> None:
        if s and not out_of:
            if s.isspace():
                if out and out[-1].block == block:
                    out[-1].text += " "
                return
            path, boxes = "/".join(x[0] for x in stack), tuple(x[1] for x in stack)
            out.append(Node(path, boxes, html.unescape(s), block, tuple(x[1] for x in stack if x[3])))

    def pop() -> None:
        nonlocal out_of, block
        tag, _, off, _ = stack.pop()
        out_of -= off
        block += tag in _BLOCK

    while at < end:
        m = _MARKUP.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end() if m.end() > m.start() else m.start() + 1
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "br":
                text(" ")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    while len(stack) > i:
                        pop()
                    break
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br" and out and out[-1].block == block:
                out[-1].text += " "
            continue
        if tag in _BLOCK:
            for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[i][0] == "p":
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in _BLOCK:
                    break
            block += 1
        if tag in _CLOSES:
            ends, bound = _CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in bound:
                    break
        if tag in _VOID:
            continue
        main = any(x[0] in _MAIN for x in stack)
        off = tag in _FURNITURE or (tag == "header" and not main)
        named = False
        if not off and tag not in ("html", "body", "article", "main"):
            off = bool(_HIDDEN.search(m[3]))
            named = not off and _named(m[3], main)
        number += 1
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
            at = close.end() if close else end
            block += tag not in ("script", "style", "template", "noscript")
            continue
        if m[3].rstrip().endswith("/") and tag in ("svg", "path", "use"):
            continue
        stack.append((tag, number, off, named))
        out_of += off
    return _unnamed(out)


def _smooth(x: np.ndarray) -> np.ndarray:
    reach = min(len(x) - 1, int(3 * SPREAD))
    if reach < 1:
        return x
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SPREAD) ** 2)
    total = np.convolve(np.ones(len(x)), kernel)[reach : reach + len(x)]
    return np.convolve(x, kernel)[reach : reach + len(x)] / total


def select(nodes: list[Node]) -> list[Node]:
    """The article's nodes."""
    if not nodes:
        return []
    sums: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    sizes = []
    for n in nodes:
        own = sums[n.path]
        sizes.append(len(n.text.strip()))
        own[0] += sizes[-1]
        own[1] += len(_STOPS.findall(n.text))
        own[2] += 1
    length = _smooth(np.array([sums[n.path][0] / sums[n.path][2] for n in nodes]))
    stops = _smooth(np.array([sums[n.path][1] / sums[n.path][2] for n in nodes]))
    fused = length * (1 + stops)
    keep = fused >= THRESHOLD * fused.std()
    if not keep.any():
        keep[:] = True
    weights: dict[int, int] = defaultdict(int)
    total = 0
    tags: dict[int, str] = {}
    for n, k, size in zip(nodes, keep, sizes):
        tags.update(zip(n.boxes, n.path.split("/")))
        if k:
            total += size
            for b in n.boxes:
                weights[b] += size
    # what is marked as the article, if it holds half of the selected text; else the innermost
    # container that holds all of it
    marked = [b for b, t in tags.items() if t in _MAIN and weights[b] * 2 >= total]
    if marked:
        box = max(b for b in marked if weights[b] == weights[min(marked)])
    else:
        box = max((b for b, t in tags.items() if t in _BOX and weights[b] == total), default=0)
    return [n for n, k in zip(nodes, keep) if k or box in n.boxes]


def main_text(page: str | None) -> str:
    """Blocks of the article, white space as single spaces, joined by empty lines."""
    blocks: list[list[str]] = []
    last = -1
    for n in select(nodes_of(page or "")):
        if n.block != last:
            blocks.append([])
            last = n.block
        blocks[-1].append(n.text)
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(b for b in joined if b)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row: the main text of the whole html.

    Null or empty html gives an empty text, and so does a page of furniture alone. Nulls in other
    columns stay; repeated rows give repeated rows; other columns are left behind.
    """
    tune(pages.sparkSession)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html"))
    return rows.mapInArrow(_extracted, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
