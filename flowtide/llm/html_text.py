"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks.  A block has its word count, its
link density, both for its neighbours, and marks for where it stands (main
element, frame parts such as menus or comments, heading).  A decision tree
grown on ``LABELLED``, a small table of described blocks, decides which blocks
are article text.  Blocks are kept whole and in page order.

A frame mark belongs to the element that carries it.  A main element ends the
marks of all its wrappers; an article outside of it ends those of forms and of
wrappers whose names do not hold articles themselves.  An inline frame part
(a share link, an advert inside a paragraph) is a block of its own.  A name on a
paragraph, list item or heading that says little (``social``, ``notice``) is half
a mark: words, links and neighbours decide.  Parsing takes time linear in the page.

Defined results: a null or empty page, and a page without article text, gives
an empty string; character references are decoded; white space in a block
becomes one space; repeated rows each keep their row; an empty table gives none.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from flowtide.llm.common import map_rows, pick

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head title script style noscript template svg math iframe object canvas textarea select button audio video".split())
FRAME_TAGS = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "search"))
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FRAME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disclaimer "
    "discussion disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted "
    "recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# A name with such a word says what is missing or how the page is laid out.
NO_MARK = frozenset("has have no non not with without free less".split())
# Frame parts that hold articles of their own (teasers, comments), even without a main element.
HARD_TAGS = frozenset(("nav", "footer", "aside", "dialog", "menu"))
HARD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising comment comments commentlist discussion disqus promo promoted recommended related replies reply "
    "respond sidebar sponsor sponsored widget".split())
# Names that article text carries too.
SOFT_NAMES = frozenset("banner byline disclaimer footer header login menu modal nav notice notices popup respond share sharing skip social".split())
TEXT_TAGS = frozenset(("p", "li", "blockquote", "dd", "pre", *HEADINGS))

FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "in_main", "in_frame", "heading", "page_has_main")
# Labelled blocks: the features in this order, then 1 for article text.
LABELLED = [
    # article text inside a main element, long, short, and one word
    (80, 0.0, 60, 0.0, 70, 0.0, 1, 0, 0, 1, 1), (25, 0.1, 10, 0.0, 40, 0.0, 1, 0, 0, 1, 1), (3, 0.0, 90, 0.0, 80, 0.0, 1, 0, 0, 1, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1, 1), (2, 0.0, 1, 0.0, 3, 0.0, 1, 0, 0, 1, 1), (12, 0.6, 50, 0.0, 60, 0.1, 1, 0, 0, 1, 1), (1, 1.0, 30, 0.0, 30, 0.0, 1, 0, 0, 1, 1),
    (400, 0.0, 8, 0.0, 6, 0.0, 1, 0, 0, 1, 1), (7, 0.0, 12, 0.0, 12, 1.0, 1, 0, 0, 1, 1), (5, 0.0, 1, 1.0, 30, 0.0, 1, 0, 0, 1, 1),
    # headings of the article
    (9, 0.0, 12, 0.0, 60, 0.0, 1, 0, 1, 1, 1), (1, 0.0, 0, 0.0, 40, 0.0, 1, 0, 1, 1, 1), (6, 0.0, 70, 0.0, 80, 0.0, 1, 0, 1, 1, 1),
    # frame parts inside a main element: shares, comments, adverts, forms
    (4, 1.0, 60, 0.0, 5, 1.0, 1, 1, 0, 1, 0), (35, 0.0, 60, 0.0, 40, 0.0, 1, 1, 0, 1, 0), (12, 0.0, 30, 0.0, 8, 0.5, 1, 1, 0, 1, 0), (90, 0.0, 5, 0.0, 70, 0.0, 1, 1, 0, 1, 0),
    (3, 0.0, 40, 0.0, 30, 0.0, 1, 1, 1, 1, 0), (1, 0.0, 8, 0.0, 9, 0.0, 1, 1, 0, 1, 0),
    # frame parts outside of it: menus, footers, notices, long adverts
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 1, 0), (2, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 1, 0), (8, 0.0, 70, 0.0, 0, 0.0, 0, 1, 0, 1, 0), (60, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0, 1, 0),
    (5, 0.2, 80, 0.0, 3, 1.0, 0, 1, 0, 1, 0), (120, 0.0, 40, 0.0, 50, 0.0, 0, 1, 0, 1, 0), (3, 0.0, 1, 1.0, 20, 0.0, 0, 1, 1, 1, 0),
    # unmarked text outside of an existing main element
    (1, 1.0, 1, 1.0, 30, 0.0, 0, 0, 0, 1, 0), (14, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 1, 0), (70, 0.0, 20, 0.3, 5, 1.0, 0, 0, 0, 1, 0), (4, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1, 1, 0),
    (200, 0.0, 30, 0.0, 40, 0.0, 0, 0, 0, 1, 0),
    # pages without a main element: prose, short lines between prose, headings
    (60, 0.0, 50, 0.0, 70, 0.0, 0, 0, 0, 0, 1), (22, 0.1, 9, 0.0, 40, 0.0, 0, 0, 0, 0, 1), (120, 0.05, 1, 1.0, 4, 0.8, 0, 0, 0, 0, 1), (14, 0.0, 3, 1.0, 35, 0.0, 0, 0, 0, 0, 1),
    (50, 0.0, 45, 0.0, 2, 1.0, 0, 0, 0, 0, 1), (35, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 1), (90, 0.0, 60, 0.0, 1, 1.0, 0, 0, 0, 0, 1),
    (3, 0.0, 60, 0.0, 45, 0.0, 0, 0, 0, 0, 1), (5, 0.0, 30, 0.0, 80, 0.0, 0, 0, 0, 0, 1), (8, 0.0, 40, 0.0, 20, 0.1, 0, 0, 0, 0, 1), (2, 0.0, 24, 0.0, 90, 0.0, 0, 0, 0, 0, 1),
    (7, 0.0, 1, 1.0, 50, 0.0, 0, 0, 1, 0, 1), (4, 0.0, 60, 0.0, 60, 0.0, 0, 0, 1, 0, 1), (9, 0.0, 0, 0.0, 30, 0.0, 0, 0, 1, 0, 1), (15, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    # pages without a main element: menus, short ends, link lists, frame parts
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 40, 0.0, 2, 1.0, 0, 0, 0, 0, 0), (6, 0.9, 3, 1.0, 50, 0.0, 0, 0, 0, 0, 0), (15, 0.8, 10, 0.9, 12, 0.9, 0, 0, 0, 0, 0),
    (40, 0.7, 30, 0.6, 20, 0.8, 0, 0, 0, 0, 0), (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (3, 0.0, 2, 0.0, 4, 0.5, 0, 0, 0, 0, 0), (5, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
    (2, 0.5, 20, 0.0, 3, 1.0, 0, 0, 0, 0, 0), (3, 0.0, 1, 1.0, 1, 1.0, 0, 0, 1, 0, 0), (8, 0.0, 40, 0.0, 3, 1.0, 0, 1, 0, 0, 0), (70, 0.0, 30, 0.0, 40, 0.0, 0, 1, 0, 0, 0),
    (20, 0.0, 1, 1.0, 60, 0.0, 0, 1, 0, 0, 0), (4, 0.0, 5, 0.0, 60, 0.0, 0, 1, 1, 0, 0), (1, 0.0, 0, 0.0, 50, 0.0, 0, 1, 0, 0, 0),
    # equal blocks without marks: between prose they are text, between link lists teasers
    (14, 0.1, 14, 0.0, 14, 0.0, 0, 0, 0, 0, 1), (14, 0.1, 14, 1.0, 14, 1.0, 0, 0, 0, 0, 0), (30, 0.0, 16, 0.0, 16, 0.1, 0, 0, 0, 0, 1), (30, 0.0, 16, 1.0, 16, 1.0, 0, 0, 0, 0, 0),
    (22, 0.0, 25, 0.0, 28, 0.0, 0, 0, 0, 0, 1), (22, 0.0, 25, 1.0, 28, 0.9, 0, 0, 0, 0, 0), (18, 0.0, 40, 0.0, 12, 0.9, 0, 0, 0, 0, 1), (18, 0.0, 12, 0.9, 40, 0.0, 0, 0, 0, 0, 1),
    (20, 0.0, 25, 0.0, 3, 1.0, 0, 0, 0, 0, 1), (15, 0.0, 18, 0.0, 4, 1.0, 0, 0, 0, 0, 1), (28, 0.0, 20, 0.0, 1, 1.0, 0, 0, 0, 0, 1), (20, 0.0, 25, 1.0, 3, 1.0, 0, 0, 0, 0, 0),
    # the same blocks inside a main element are text, and outside of an existing one are not, whatever their neighbours
    (14, 0.1, 14, 1.0, 14, 1.0, 1, 0, 0, 1, 1), (30, 0.0, 16, 1.0, 16, 1.0, 1, 0, 0, 1, 1), (22, 0.0, 25, 1.0, 28, 0.9, 1, 0, 0, 1, 1), (2, 0.0, 4, 1.0, 5, 1.0, 1, 0, 0, 1, 1),
    (4, 0.8, 40, 0.0, 6, 0.9, 1, 0, 0, 1, 1), (60, 0.0, 2, 1.0, 1, 1.0, 1, 0, 0, 1, 1), (1, 0.0, 60, 0.0, 1, 1.0, 1, 0, 0, 1, 1), (9, 0.0, 20, 0.9, 0, 0.0, 1, 0, 0, 1, 1),
    (14, 0.1, 14, 0.0, 14, 0.0, 0, 0, 0, 1, 0), (30, 0.0, 16, 0.0, 16, 0.1, 0, 0, 0, 1, 0), (22, 0.0, 25, 0.0, 28, 0.0, 0, 0, 0, 1, 0), (9, 0.0, 70, 0.0, 30, 0.0, 0, 0, 0, 1, 0),
    # half marks: prose between prose is text, short or linked lines and lines between links are not
    (40, 0.0, 50, 0.0, 60, 0.0, 1, 0.5, 0, 1, 1), (18, 0.1, 30, 0.0, 20, 0.0, 1, 0.5, 0, 1, 1), (70, 0.0, 12, 0.1, 45, 0.0, 0, 0.5, 0, 0, 1), (25, 0.0, 40, 0.0, 9, 0.2, 1, 0.5, 0, 1, 1),
    (3, 0.0, 50, 0.0, 40, 0.0, 1, 0.5, 0, 1, 0), (4, 1.0, 60, 0.0, 40, 0.0, 1, 0.5, 0, 1, 0), (20, 0.6, 60, 0.0, 40, 0.0, 1, 0.5, 0, 1, 0), (6, 0.0, 2, 1.0, 1, 1.0, 1, 0.5, 0, 1, 0),
    (20, 0.0, 2, 1.0, 1, 1.0, 1, 0.5, 0, 1, 0), (16, 0.0, 3, 1.0, 4, 1.0, 0, 0.5, 0, 0, 0), (30, 0.0, 4, 1.0, 2, 1.0, 1, 0.5, 0, 1, 0), (2, 0.0, 1, 0.0, 3, 0.0, 1, 0.5, 0, 1, 0),
]


def frame_mark(tag: str, role: str | None, names: str) -> tuple[float, bool]:
    """(mark, hard) of an element by itself: 0, 0.5 or 1, and whether articles below it stay marked."""
    if tag in FRAME_TAGS or role in FRAME_ROLES:
        return 1.0, tag in HARD_TAGS or role in ("navigation", "contentinfo", "complementary", "dialog", "alertdialog")
    found: set[str] = set()
    if names and tag not in ("html", "body", "article", "main"):
        for name in names.split():
            words = [x.lower() for x in _NAME.findall(name)]
            if NO_MARK.isdisjoint(words):
                found |= FRAME_NAMES.intersection(words)
    if not found:
        return 0.0, False
    return 0.5 if tag in TEXT_TAGS and found <= SOFT_NAMES else 1.0, not HARD_NAMES.isdisjoint(found)


class _Open:
    """Places of open tags on the stack, so that finding one takes constant time."""

    def __init__(self):
        self.places: dict[str, list[int]] = {}

    def last(self, tag: str) -> int:
        held = self.places.get(tag)
        return held[-1] if held else -1


class _Blocks(HTMLParser):
    """Flat blocks of one page: (text, words, linked words, in_main, in_frame, heading)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # tag, silent, main, frame mark, hard mark, link, heading, header
        self.stack: list[tuple] = [("", False, False, 0.0, False, False, False, False)]
        self.open = _Open()
        self.block_at: list[int] = [0]  # stack places of block tags
        self.other_at: list[int] = [0]  # those of block tags other than p
        self.blocks: list[tuple] = []
        self.runs: dict[bool, tuple[list[str], list[str]]] = {False: ([], []), True: ([], [])}
        self.at: dict[bool, tuple] = {}
        self.has_main = False

    def _flush(self):
        for framed, (parts, linked) in self.runs.items():
            if framed in self.at:
                text = " ".join("".join(parts).split())
                self.blocks.append((text, text.count(" ") + 1, len(" ".join(linked).split()), *self.at[framed]))
            parts.clear()
            linked.clear()
        self.at.clear()

    def _pop_to(self, at):
        for i in range(len(self.stack) - 1, at - 1, -1):
            tag = self.stack.pop()[0]
            self.open.places[tag].pop()
            for held in (self.block_at, self.other_at):
                if held[-1] == i:
                    held.pop()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self._flush()
            if (head := self.open.last("head")) > 0 and tag != "html":
                self._pop_to(head)
            if (p := self.open.last("p")) > self.other_at[-1]:
                self._pop_to(p)
            if tag == "li" and (li := self.open.last("li")) > max(self.open.last(x) for x in ("ul", "ol", "menu", "dir")):
                self._pop_to(li)
        elif tag == "br":
            for parts, _ in self.runs.values():
                parts.append(" ")
        if tag in VOID:
            return
        _, silent, main, mark, hard, link, heading, header = self.stack[-1]
        a = {k: v or "" for k, v in attrs}
        own, own_hard = frame_mark(tag, a.get("role"), f"{a.get('class', '')} {a.get('id', '')}".strip())
        whole, part = tag == "main" or a.get("role") == "main", tag == "article" or a.get("role") == "article"
        if whole or (part and not main and not hard):
            mark, hard, header = 0.0, False, False
        if whole or part:
            main = self.has_main = True
        mark, hard = max(mark, own), hard or own_hard
        silent = silent or tag in SILENT or "hidden" in a or bool(_HIDDEN.search(a.get("style", "")))
        at = len(self.stack)
        self.open.places.setdefault(tag, []).append(at)
        if tag in BLOCK_TAGS:
            self.block_at.append(at)
            if tag != "p":
                self.other_at.append(at)
        self.stack.append((tag, silent, main, mark, hard, link or tag == "a", heading or tag in HEADINGS, header or tag == "header"))

    def handle_endtag(self, tag):
        at = self.open.last(tag)
        if tag in BLOCK_TAGS:
            self._flush()
        elif tag not in SILENT and at < self.block_at[-1]:
            return
        if at > 0:
            self._pop_to(at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math"):
            self.handle_endtag(tag)

    def handle_data(self, data):
        _, silent, main, mark, _, link, heading, header = self.stack[-1]
        if silent:
            return
        # A header belongs to the frame; the heading of an article's own header is part of the article.
        mark = 1.0 if header and not (main and heading) else mark
        parts, linked = self.runs[mark == 1.0]
        if not data.isspace():
            # The strongest half mark of a run counts, and its heading if all of it is one.
            before = self.at.get(mark == 1.0)
            self.at[mark == 1.0] = (main, mark, heading) if before is None else (before[0], max(before[1], mark), before[2] and heading)
            if link:
                linked.append(data)
        parts.append(data)


def blocks_of(html: str | None) -> tuple[list[tuple], bool]:
    """(text, words, linked words, in_main, in_frame, heading) of each block, and whether the page has a main element."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return parser.blocks, parser.has_main


def features_of(blocks: list[tuple], has_main: bool) -> np.ndarray:
    n = len(blocks)
    words = np.array([b[1] for b in blocks], dtype=float)
    density = np.array([b[2] for b in blocks], dtype=float) / np.maximum(words, 1)
    x = np.zeros((n, len(FEATURES)))
    x[:, 0], x[:, 1] = words, density
    x[1:, 2], x[1:, 3], x[:-1, 4], x[:-1, 5] = words[:-1], density[:-1], words[1:], density[1:]
    x[:, 6:9] = [[b[3], b[4], b[5]] for b in blocks]
    x[:, 9] = has_main
    return x


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """A binary tree by Gini impurity: (feature, threshold, left, right) or a leaf's class."""
    if depth == 0 or y.min() == y.max():
        return (int(y.mean() >= 0.5),)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        left = np.arange(1, len(y) + 1)
        for i in np.flatnonzero(v[:-1] < v[1:]):
            a, b = ones[i] / left[i], (ones[-1] - ones[i]) / (len(y) - left[i])
            impurity = left[i] * a * (1 - a) + (len(y) - left[i]) * b * (1 - b)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, (v[i] + v[i + 1]) / 2)
    if best is None:
        return (int(y.mean() >= 0.5),)
    _, f, t = best
    low = x[:, f] <= t
    return f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def trained_tree(labelled=None) -> tuple:
    table = np.array(LABELLED if labelled is None else labelled, dtype=float)
    return grow(table[:, :-1], table[:, -1])


def decide(tree: tuple, row: np.ndarray) -> bool:
    while len(tree) > 1:
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return bool(tree[0])


def main_text(html: str | None, tree: tuple) -> str:
    blocks, has_main = blocks_of(html)
    if not blocks:
        return ""
    return " ".join(b[0] for b, row in zip(blocks, features_of(blocks, has_main)) if decide(tree, row))


class _Extract:
    def __init__(self, tree):
        self.tree = tree

    def __call__(self, rows):
        for page_id, url, html in rows:
            text = main_text(html, self.tree)
            yield page_id, url, text, len(text)


def extract(pages: DataFrame, labelled=None) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    return map_rows(pick(pages, "page_id", "url", "html"), "page_id long, url string, text string, n_chars long", _Extract(trained_tree(labelled)))
