"""Main text of HTML pages by text-to-tag ratios.

The standard library's streaming parser gives start tags, end tags and text.
Blocks of text are the lines: each has a text-to-tag ratio, the ratios are
smoothed with a Gaussian in page order, and the lines above a threshold form
the content cluster. The cluster selects a region, not single lines: the
article or main elements that hold lines of it, or else the element that holds
most of its text. All of that region is kept, however short a line is, but for
parts that say by element, role or class name that they are something else:
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments. An article's own header stays.

Defined results: null or empty html, and a page without text, give an empty
text; a tag or comment cut off by the page's end is markup, a reference cut off
is text unless HTML reads it without its semicolon; white space is Python's,
the no-break space included; repeated rows are extracted one by one; pages of
any length are read whole, one at a time if long; columns other than those asked
for are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .common import slices

# HTML's elements without an end tag, those that stand inside a line, and those that aren't content.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_DROPPED = frozenset("applet aside audio button canvas datalist dialog fieldset footer form frameset head iframe map menu nav noframes noscript object script select style svg template textarea video".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class names and ids.
_WORDS = frozenset(
    """ad ads advert advertisement advertisements adverts advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus
    footer masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related replies respond share sharing
    sidebar social sponsor sponsored subscribe toolbar widget""".split()
)
_TALK = frozenset("comment comments discussion disqus replies respond".split())
_HEADINGS = frozenset({"header"})
_REGIONS = frozenset({"article", "main"})
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_CUT_OFF = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?\Z")

#: Lines on either side that a line's ratio is smoothed over, in standard deviations of the Gaussian, and that deviation.
SIGMA, REACH = 1.0, 3
#: A line is content if its smoothed ratio is at least this share of the ratios' standard deviation above zero.
THRESHOLD = 1.0
#: Of the text of the content cluster, what an element must hold to stand for its parent; of a line's text, what links may hold.
SHARE, LINKED = 0.9, 0.5


@dataclass
class Line:
    path: tuple[int, ...]
    region: int
    text: str
    tags: int
    linked: int


@dataclass
class _Open:
    tag: str
    number: int
    dropped: bool
    strict: bool
    region: int


@dataclass
class _Buffer:
    parts: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0


class PageLines(HTMLParser):
    """Lines of a page, in order, without those inside dropped elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open = [_Open("", 0, False, False, 0)]
        self.count, self.in_link, self.line = 0, False, _Buffer()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Any <![...> is skipped, known or not."""
        return self.rawdata.find(">", i) + 1 or -1

    def flush(self) -> None:
        top, text = self.open[-1], " ".join("".join(self.line.parts).split())
        if text and not top.dropped:
            self.lines.append(Line(tuple(e.number for e in self.open), top.region, text, self.line.tags, self.line.linked))
        self.line = _Buffer()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _INLINE:
            self.line.tags += 1
            self.in_link = self.in_link and tag != "a" or tag == "a"
        elif tag == "br":
            self.line.tags += 1
            self.line.parts.append(" ")
        elif tag == "wbr" or tag == "img":
            self.line.tags += 1
        else:
            self.flush()
            if tag == "body" or tag not in _VOID | _DROPPED | {"html", "title"}:
                self._close("head")  # whose end tag may be left out
            if tag in ("html", "body") and any(e.tag == tag for e in self.open):
                return
            if self.open[-1].tag == "p":
                self.open.pop()
            elif self.open[-1].tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self.open.pop()
            self.line.tags += 1
            if tag not in _VOID:
                self._push(tag, {k: v or "" for k, v in reversed(attrs)})

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        top = self.open[-1]
        self.count += 1
        words = set(_WORD.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
        named = tag not in ("html", "body") and bool(words & (_WORDS if top.region else _WORDS | _HEADINGS))
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style", "")))
        strict = top.strict or tag in _DROPPED or tag == "header" and not top.region or hidden or attrs.get("role", "").lower() in _ROLES or bool(words & _TALK)
        # A class name of a wrapper ("with-sidebar") says nothing of an article inside it.
        dropped = strict or (tag not in _REGIONS and (top.dropped or named)) or (tag in _REGIONS and bool(top.region) and top.dropped)
        self.open.append(_Open(tag, self.count, dropped, strict, top.region or (self.count if tag in _REGIONS and not dropped else 0)))

    def _close(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                self.in_link = False
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in _INLINE:
            self.line.tags += 1
            self.in_link = self.in_link and tag != "a"
        elif tag not in _VOID and tag not in ("html", "body"):  # what follows these two still belongs to the page
            self.flush()
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.open[-1].dropped:
            self.line.parts.append(data)
            self.line.linked += len(data.strip()) if self.in_link else 0


def page_lines(html: str) -> list[Line]:
    begin = html.rfind("<!--")
    if begin >= 0 and html.find("-->", begin) < 0:
        html = html[:begin]
    parser = PageLines()
    parser.feed(_CUT_OFF.sub("", html))
    parser.close()
    parser.flush()
    return parser.lines


def content_cluster(lines: list[Line]) -> np.ndarray:
    """Which lines have a smoothed text-to-tag ratio above the threshold."""
    ratio = np.array([(len(x.text) - min(x.linked, len(x.text))) / max(1, x.tags) for x in lines])
    reach = round(SIGMA * REACH)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    smooth = np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid")
    return smooth >= min(THRESHOLD * smooth.std(), smooth.max())


def main_lines(html: str) -> list[str]:
    """The lines of the page's content regions, in order."""
    lines = page_lines(html)
    if not lines:
        return []
    content = content_cluster(lines)
    regions = {x.region for x in lines if x.region}
    if regions:
        chosen = {x.region for x, c in zip(lines, content, strict=True) if c} & regions or regions
        return [x.text for x in lines if x.region in chosen]
    # Without such elements: down from the page to the smallest element that holds nearly all of the cluster's text.
    depth, inside = 1, [(x, c) for x, c in zip(lines, content, strict=True)]
    while True:
        weight: dict[int, int] = {}
        for x, c in inside:
            if c and len(x.path) > depth:
                weight[x.path[depth]] = weight.get(x.path[depth], 0) + len(x.text)
        most = max(weight, key=weight.__getitem__, default=None)
        if most is None or weight[most] < SHARE * sum(len(x.text) for x, c in inside if c) or not any(len(x.path) > depth + 1 and x.path[depth] == most for x, _ in inside):
            break
        inside = [(x, c) for x, c in inside if len(x.path) > depth and x.path[depth] == most]
        depth += 1
    return [x.text for x, c in inside if x.linked <= LINKED * len(x.text)]


def extract_pages(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url"), *, with_lines: bool = False) -> DataFrame:
    """keep's columns, text and n_chars of every page; with_lines adds the text's lines, each as it stands in the page."""
    own = [pages.schema[c] for c in keep]
    schema = StructType(own).add("text", "string").add("n_chars", "long")
    schema = schema.add("lines", ArrayType(StringType())) if with_lines else schema

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(keep)):
            found = [main_lines(html or "") for html in batch.column(len(keep)).to_pylist()]
            texts = [" ".join(lines) for lines in found]
            arrays = [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(found, pa.list_(pa.string()))] * with_lines, names=schema.names)

    return pages.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{column}`").cast("string")).mapInArrow(extracted, schema)
