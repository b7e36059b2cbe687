"""Main text of web pages from streaming parser events.

The standard library's parser turns a page into lines, one per block of text,
each with its characters, tags and linked characters.  Elements that hold no
article (menus, headers, footers, sidebars, forms, adverts, notices, comments,
scripts, styles) are passed over as they stream by.  The text-to-tag ratio of the
lines is smoothed with a Gaussian and split into two clusters; the innermost
container that holds nearly all text of the upper cluster, widened to the
article or main element around it, is the content region.  Every line of the
region is kept, except low-ratio lines that are links throughout.

Defined cases: null, empty and tag-only pages give the empty text; text without
tags is one block; unclosed elements end with their parent; unclosed menus and
page headers end where an article begins; character references are decoded;
runs of white space inside a block become one space, a line break counting as
white space; rows are handled one by one, so repeated rows repeat their result.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SIGMA, SHARE = 1.0, 0.9
# Element kinds of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
                   "search section summary table tbody td tfoot th thead title tr ul".split())
_CONTAINER = frozenset("article body center div html main section table tbody td".split())
_DROPPED = frozenset("aside button canvas datalist dialog embed footer form head header iframe input label map menu nav "
                     "noscript object option search select script style svg template textarea title video audio".split())
_KINDS = frozenset("ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs "
                   "comment comments consent cookie cookies disclaimer footer gdpr login masthead menu modal nav navbar "
                   "navigation newsletter notice notification overlay pagination pager popup promo promotion recommended "
                   "related replies responses share sharing sidebar signup social sponsor sponsored subscribe subscription "
                   "toolbar widget widgets".split())
_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation note search status "
                   "toolbar".split())
# Parts of class names that say where or how a thing stands, not what it is; and words that negate or attach one.
_FRAME = frozenset("area bar bars block body bottom box col column container content group head inner item items layer left "
                   "links list main outer panel pane posts right section slot thread title top unit wrap wrapper zone".split())
_APART = frozenset("has hide no not off on show with without".split())
_PART = re.compile(r"[a-z]+")


def _names_a_kind(name: str) -> bool:
    """Whether a class or id names something that is no article: its last part, frames aside, is such a kind.

    ``cookie-notice`` is a notice and ``related-posts`` are related ones; ``related-work`` is
    work, and ``with-sidebar`` or ``no-comments`` speak of something else.
    """
    parts = _PART.findall(name)
    if any(p in _APART for p in parts[:-1]):
        return False
    while len(parts) > 1 and parts[-1] in _FRAME:
        parts.pop()
    return bool(parts) and parts[-1] in _KINDS


class Line:
    __slots__ = ("text", "tags", "linked", "container")

    def __init__(self, text: str, tags: int, linked: int, container: int):
        self.text, self.tags, self.linked, self.container = text, tags, linked, container


class LineParser(HTMLParser):
    """Lines of a page, with the innermost container each lies in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.containers: list[tuple[str, int]] = [("root", 0)]       # tag, parent: numbers grow inwards
        self.open: list[tuple[str, bool, int]] = []                  # tag, passed over, innermost container
        self.count: dict[str, int] = {}                              # open elements by tag
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def _dropped(self, tag: str, attrs) -> bool:
        if tag in ("html", "body", "main"):
            return False
        if tag == "header" and any(self.count.get(t) for t in ("article", "main", "section")):
            return False                                  # an article's own heading
        values = {k: (v or "").lower() for k, v in attrs}
        if "hidden" in values or values.get("aria-hidden") == "true" or values.get("role") in _ROLES:
            return True
        names = [*values.get("class", "").split(), values.get("id", "")]
        return tag in _DROPPED or any(map(_names_a_kind, names))

    def _flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.open[-1][2] if self.open else 0))
        self.parts, self.tags, self.linked = [], 0, 0

    def _pop_to(self, size: int):
        for tag, _, _ in self.open[size:]:
            self.count[tag] -= 1
        del self.open[size:]

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._flush()
            self._imply_ends(tag)
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in _VOID:
            return
        over = bool(self.open) and self.open[-1][1]
        if over and tag in ("article", "main"):
            first = next(i for i, o in enumerate(self.open) if o[1])
            if self.open[first][0] in ("nav", "header", "form", "head", "menu"):
                self._pop_to(first)
                over = False
        over = over or self._dropped(tag, attrs)
        container = self.open[-1][2] if self.open else 0
        if tag in _CONTAINER and not over:
            self.containers.append((tag, container))
            container = len(self.containers) - 1
        self.count[tag] = self.count.get(tag, 0) + 1
        self.open.append((tag, over, container))

    def _imply_ends(self, tag: str):
        """A block ends an open paragraph; an item ends the item before it."""
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == "p" or (name == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                self._pop_to(i)
                return
            if name in _CONTAINER or name in ("ul", "ol", "dl", "nav", "aside", "header", "footer", "form"):
                return
            if not self.count.get("p") and not self.count.get(tag):
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag in ("svg", "iframe", "object"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self._flush()
        self.tags += 1
        if not self.count.get(tag):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._pop_to(i)
                return
            if self.open[i][0] in _CONTAINER and tag not in _BLOCK:
                return                                    # a stray inline end does not close containers

    def handle_data(self, data):
        if self.open and self.open[-1][1]:
            return
        self.parts.append(data)
        if self.count.get("a"):
            self.linked += len(data.strip())

    def finish(self, page: str) -> list[Line]:
        self.feed(page)
        self.close()
        self._flush()
        return self.lines


def smoothed_ratios(lines: list[Line], sigma: float = SIGMA) -> np.ndarray:
    ratio = np.array([(len(x.text) - x.linked) / max(1, x.tags) for x in lines], float)
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]
    return np.convolve(ratio, kernel)[reach : reach + len(ratio)] / weight


def threshold(values: np.ndarray) -> float:
    """Boundary of two clusters of one-dimensional values (2-means from the extremes)."""
    cut = (values.min() + values.max()) / 2
    for _ in range(50):
        low, high = values[values < cut], values[values >= cut]
        if not len(low) or not len(high):
            break
        new = (low.mean() + high.mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def main_text(page: str | None) -> str:
    if not page:
        return ""
    parser = LineParser()
    lines = parser.finish(page)
    if not lines:
        return ""
    ratio = smoothed_ratios(lines)
    cut = threshold(ratio)
    mass = [0] * len(parser.containers)                  # text of the upper cluster inside each container
    for x, r in zip(lines, ratio):
        if r >= cut:
            mass[x.container] += len(x.text)
    parents = [parent for _, parent in parser.containers]
    for c in range(len(mass) - 1, 0, -1):
        mass[parents[c]] += mass[c]
    region = max(c for c, m in enumerate(mass) if m >= SHARE * mass[0])     # numbers grow inwards
    around, c = [], region
    while c:
        around.append(c)
        c = parents[c]
    region = next((c for c in reversed(around) if parser.containers[c][0] in ("article", "main")), region)
    inside = [False] * len(mass)
    for c in range(len(mass)):
        inside[c] = c == region or (c > 0 and inside[parents[c]])
    return "\n".join(x.text for x, r in zip(lines, ratio)
                     if inside[x.container] and not (r < cut and x.linked >= len(x.text.replace(" ", ""))))


@F.arrow_udf(T.StringType())
def main_text_column(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p) for p in pages.to_pylist()], pa.string())


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``row`` (the input row as a struct) and its main ``text``."""
    common.prepare(pages.sparkSession)
    return pages.select(F.struct("*").alias("row"), main_text_column(F.col(html_col)).alias("text"))
