"""HTML extraction: flat text blocks, classified by a decision tree.

The page is cut into blocks at block-level tags. A block is described by its
word count and link density and by those of two neighbours on each side. A
decision tree, grown by Gini gain on the small labelled table below, says
which blocks are main text. Where these numbers leave labelled blocks mixed,
and only there, the tree may also ask what encloses the block: an element whose
name, class or id marks main text, or one that marks page furniture (the
innermost marked one counts). Numbers alone cannot tell a long reader comment,
sidebar or notice from the article; the README has figures with and without.

Text of scripts, styles, forms and the head is never a block. Character
references are decoded, white space inside a block becomes one space, kept
blocks are joined by one space. Pages that end in the middle of a tag are read
as far as they go. Reading takes time in proportion to the page: every
character is passed once, and a quote or tag that never ends is looked for once.

Defined results: a null or empty page, or one without main text, gives an
empty text. Repeated pages are read one by one. An empty table gives an empty
result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import bounded_batches

NAME = re.compile(r"/?[A-Za-z][A-Za-z0-9:-]*")
#: What a tag's attributes may hold up to the next quote or the tag's end.
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SILENT = {"script", "style", "noscript", "template", "head", "title", "form", "svg", "select", "textarea", "button", "iframe", "object", "canvas"}
RAW = {n: re.compile(rf"</{n}\b", re.I) for n in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Elements that end where the next one of their kind begins.
SAME = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MAIN, FURNITURE = {"article", "main"}, {"nav", "header", "footer", "aside", "menu", "dialog"}
MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article|post|story|entry|main|content|body)(?:$|[\s_-])", re.I)
FURNITURE_WORDS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|comments?|replies|respond|sidebar|related|recommend\w*|share|social|nav\w*|menu|breadcrumbs?|footer|header|masthead|widget|login|search|legal|copyright)(?:$|[\s_-])", re.I)
WHITE = re.compile(r"\s+")

#: Pages as blocks in order: words, link density, enclosure (1 main, -1 furniture, 0 none), 1 if main text.
PAGES = [
    # Navigation, an advert, an article, a footer.
    [(1, 1, -1, 0), (1, 1, -1, 0), (1, 1, -1, 0), (9, 0, -1, 0), (8, 0, 1, 1), (62, 0, 1, 1), (95, 0, 1, 1), (4, 0, 1, 1), (120, 0, 1, 1), (16, 0, -1, 0)],
    [(1, 1, -1, 0), (2, 1, -1, 0), (1, 1, -1, 0), (7, 0, -1, 0), (12, 0, 1, 1), (3, 0, 1, 1), (41, 0, 1, 1), (9, 0, 1, 1), (2, 0, 1, 1), (12, 0, -1, 0)],
    [(2, 1, -1, 0), (1, 1, -1, 0), (1, 1, -1, 0), (15, 0, -1, 0), (3, 0, 1, 1), (7, 0, 1, 1), (20, 0, -1, 0)],
    [(1, 1, -1, 0), (1, 1, -1, 0), (3, 1, -1, 0), (5, 0, -1, 0), (6, 0, 1, 1), (70, 0.05, 1, 1), (33, 0, 1, 1), (18, 0, 1, 1)],
    # Paragraphs of a word or two, and a page that ends in its article.
    [(1, 1, -1, 0), (2, 1, -1, 0), (8, 0, -1, 0), (6, 0, 1, 1), (14, 0, 1, 1), (1, 0, 1, 1), (50, 0, 1, 1), (1, 0, 1, 1), (13, 0, 1, 1), (1, 0, 1, 1), (1, 0, 1, 1), (15, 0, 1, 1), (1, 0, 1, 1), (14, 0, -1, 0)],
    [(1, 1, -1, 0), (3, 1, -1, 0), (11, 0, -1, 0), (4, 0, 1, 1), (2, 0, 1, 1), (19, 0, 1, 1), (1, 0, 1, 1), (28, 0, 1, 1), (2, 0, 1, 1), (17, 0, 1, 1)],
    [(1, 1, -1, 0), (1, 1, -1, 0), (13, 0, -1, 0), (9, 0, 1, 1), (1, 0, 1, 1), (18, 0, 1, 1)],
    [(1, 1, -1, 0), (1, 1, -1, 0), (9, 0, -1, 0), (60, 0, 1, 1), (80, 0, 1, 1), (35, 0, 1, 1), (13, 0, -1, 0)],
    # Without marks: title and paragraphs between lists of links.
    [(2, 1, 0, 0), (1, 1, 0, 0), (3, 1, 0, 0), (7, 0, 0, 1), (45, 0, 0, 1), (80, 0.02, 0, 1), (22, 0, 0, 1), (66, 0.1, 0, 1), (3, 1, 0, 0), (2, 1, 0, 0), (6, 0.3, 0, 0)],
    [(4, 0.9, 0, 0), (3, 1, 0, 0), (2, 1, 0, 0), (9, 0, 0, 1), (130, 0, 0, 1), (5, 0, 0, 1), (55, 0.1, 0, 1), (4, 1, 0, 0), (12, 0.6, 0, 0), (3, 1, 0, 0)],
    [(12, 0, 0, 1)],
    [(6, 0, 0, 1), (40, 0, 0, 1), (35, 0, 0, 1)],
    # A notice first, reader comments and a sidebar after the article.
    [(22, 0.1, -1, 0), (1, 1, -1, 0), (2, 1, -1, 0), (9, 0, 1, 1), (75, 0, 1, 1), (64, 0, 1, 1), (2, 0, -1, 0), (30, 0, -1, 0), (3, 0, -1, 0), (52, 0, -1, 0), (4, 0.5, -1, 0), (60, 0, -1, 0), (25, 0, -1, 0), (9, 0.2, -1, 0)],
    [(35, 0, -1, 0), (2, 1, -1, 0), (11, 0, 1, 1), (30, 0.2, 1, 1), (88, 0, 1, 1), (14, 0.4, 1, 1), (47, 0, 1, 1), (5, 0, -1, 0), (80, 0, -1, 0), (44, 0, -1, 0), (3, 1, -1, 0), (3, 1, -1, 0), (18, 0, -1, 0)],
    # Links inside the article: a list of them is none of its text, a paragraph that is one link is.
    [(1, 1, -1, 0), (6, 0, 1, 1), (58, 0, 1, 1), (4, 1, 1, 1), (90, 0, 1, 1), (3, 1, 1, 0), (4, 1, 1, 0), (3, 1, 1, 0), (2, 1, 1, 0), (14, 0, -1, 0)],
    [(2, 1, -1, 0), (3, 1, -1, 0), (10, 0, 1, 1), (12, 0.6, 1, 1), (60, 0, 1, 1), (2, 0, 1, 1), (3, 0, 1, 1), (2, 0, 1, 1), (50, 0, 1, 1), (3, 1, 1, 0), (2, 1, 1, 0), (8, 0, -1, 0)],
]
#: How many features of a block are numbers; the enclosure follows.
NUMBERS = 10


def features(rows: list[tuple[int, float, int]]) -> list[tuple]:
    """Of every block (words, link density, enclosure): the first two of it and of two neighbours on each side, then the last."""
    nothing = [(0, 0.0)] * 2
    wide = nothing + [r[:2] for r in rows] + nothing
    return [(*wide[k + 2], *wide[k + 1], *wide[k + 3], *wide[k], *wide[k + 4], rows[k][2]) for k in range(len(rows))]


@dataclass
class Node:
    share: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def split(x: np.ndarray, y: np.ndarray, tried: range, least: int) -> tuple[int, float] | None:
    """The feature and cut of highest Gini gain with `least` rows on either side; ties go to the first. Cuts lie between values."""
    best, found = 1e-9, None
    whole = y.mean() * (1 - y.mean())
    for f in tried:
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            a, b = y[x[:, f] < cut], y[x[:, f] >= cut]
            gain = whole - (len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())) / len(y)
            if min(len(a), len(b)) >= least and gain > best + 1e-12:
                best, found = gain, (f, float(cut))
    return found


def grow(x: np.ndarray, y: np.ndarray, depth: int = 4, least: int = 4, marks: bool = True) -> Node:
    """A binary tree: `depth` levels by numbers with `least` rows a leaf; mixed leaves go on by the enclosure."""
    node = Node(float(y.mean()))
    if 0 < y.mean() < 1:
        found = split(x, y, range(NUMBERS), least) if depth else None
        if found is None and marks:
            found, depth = split(x, y, range(NUMBERS, x.shape[1]), 1), 0
        if found:
            node.feature, node.cut = found
            low = x[:, node.feature] < node.cut
            node.low, node.high = (grow(x[part], y[part], max(depth - 1, 0), least, marks) for part in (low, ~low))
    return node


@lru_cache(maxsize=2)
def tree(marks: bool = True) -> Node:
    x = np.array([f for page in PAGES for f in features([r[:3] for r in page])], float)
    return grow(x, np.array([r[3] for page in PAGES for r in page], float), marks=marks)


def main_text(node: Node, row: tuple) -> bool:
    while node.feature >= 0:
        node = node.low if row[node.feature] < node.cut else node.high
    return node.share >= 0.5


def marks(name: str, attributes: str) -> int:
    """1 if an element marks main text, -1 if it marks furniture, else 0."""
    if name in FURNITURE:
        return -1
    if attributes and name not in ("html", "body"):
        said = " ".join(next(g for g in m if g or g == "") if any(m) else "" for m in ATTRIBUTE.findall(attributes))
        if said and FURNITURE_WORDS.search(said):
            return -1
        if said and MAIN_WORDS.search(said):
            return 1
    return 1 if name in MAIN else 0


def tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, name (with / if it closes; empty for comments and declarations) and attributes of all markup.

    The caller may send a place from where to go on.
    """
    at, ends = 0, {">": True, '"': True, "'": True, "-->": True}

    def find(what: str, start: int) -> int:
        """Where it is next, or -1; what is not there any more is not looked for again."""
        k = page.find(what, start) if ends[what] else -1
        ends[what] = k >= 0
        return k

    while (start := page.find("<", at)) >= 0:
        at, name, attributes = start + 1, "", ""
        if page.startswith("!--", at):
            k = find("-->", at + 3)
            at = k + 3 if k >= 0 else len(page)
        elif page[at : at + 1] in ("!", "?"):
            k = find(">", at)
            at = k + 1 if k >= 0 else len(page)
        elif m := NAME.match(page, at):
            name, at = m[0].lower(), m.end()
            begin = at
            while True:
                at = PLAIN.match(page, at).end()
                if at >= len(page) or page[at] == ">":
                    break
                k = find(page[at], at + 1)
                at = k + 1 if k >= 0 else at + 1  # a quote that never ends is a character
            attributes, at = page[begin:at], min(at + 1, len(page))
        else:
            continue  # a mere character
        go_on = yield start, at, name, attributes
        at = go_on or at


def blocks(page: str | None) -> list[tuple[str, int, float, int]]:
    """Text, words, link density and enclosure of every block with text, in page order."""
    out: list[tuple[str, int, float, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int]] = []  # open block elements, each with the mark that holds inside it
    opened: Counter[str] = Counter()  # how often a name is on the stack
    silent, link, at = "", False, 0
    page = page or ""

    def flush() -> None:
        nonlocal parts, linked
        text = WHITE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            n = text.count(" ") + 1
            in_links = len(html.unescape("".join(linked)).split()) if linked else 0
            out.append((text, n, min(1.0, in_links / n), stack[-1][1] if stack else 0))
        parts, linked = [], []

    def after(name: str, at: int) -> int:
        """Where the content of an element that holds no markup ends."""
        m = RAW[name].search(page, at)
        k = page.find(">", m.end()) if m else -1
        return k + 1 if k >= 0 else len(page)

    def pop() -> str:
        name, _ = stack.pop()
        opened[name] -= 1
        return name

    markup, go_on = tags(page), None
    while True:
        try:
            start, end, name, attributes = markup.send(go_on)
        except StopIteration:
            break
        go_on = None
        if not silent and at < start:
            parts.append(page[at:start])
            if link:
                linked += [page[at:start], " "]
        at = end
        closing, name = name[:1] == "/", name.lstrip("/")
        if not name:
            continue
        if silent:
            if name in RAW and not closing:
                at = go_on = after(name, at)
            elif closing and name == silent or silent == "head" and name == "body":
                silent = ""
            if silent or closing or name != "body":
                continue
        if name in INLINE:
            if name == "a":
                link = not closing
            continue
        flush()
        if not closing and name in SILENT:
            if name in RAW:
                at = go_on = after(name, at)
            elif not attributes.endswith("/"):
                silent = name
        elif closing:
            while opened[name] and pop() != name:
                pass
        elif name not in VOID and not attributes.endswith("/"):
            if name in SAME and stack and stack[-1][0] == name:
                pop()
            stack.append((name, marks(name, attributes) or (stack[-1][1] if stack else 0)))
            opened[name] += 1
    if not silent:
        parts.append(page[at:])
        flush()
    return out


def extract(page: str | None, by_marks: bool = True) -> str:
    """The main text of one page; by_marks=False: by numbers alone."""
    found, node = blocks(page), tree(by_marks)
    return " ".join(b[0] for b, row in zip(found, features([b[1:] for b in found])) if main_text(node, row))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
