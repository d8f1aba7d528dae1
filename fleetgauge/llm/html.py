"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; every block of text becomes a line with its
characters and tags.  Ratios along the page are smoothed with a Gaussian and split in two
clusters.  A container (div, section, cell, body) is content if it holds lines of the upper
cluster; inside ``article`` and ``main`` elements that hold some, all is.  All blocks of content
containers are the main text, short ones too, without page furniture.

Furniture are some elements (``nav``, ``footer``, scripts), and blocks that class words, forms or
a comment heading mark.  A mark stands back where the block holds most of the upper cluster.
Comments are known by their word and by their place after article text, not by their size.
Words of notices and links only lower the ratio of a line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fleetgauge.llm.storage import free

SIGMA = 1.0
# Elements that end a line of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split())
# Elements whose content is never article text.
FURNITURE = frozenset(
    "head title style script noscript template nav menu aside footer button select option textarea input iframe "
    "object svg canvas audio video dialog".split())
CONTAINERS = frozenset("body article main section div td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("style script noscript template svg iframe object canvas textarea".split())
# Words of class, id and role values that mark a block as furniture, whatever stands beside them.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners promo promotion sponsor sponsored sponsors sidebar "
    "sidebars nav navbar navigation menu menus topbar breadcrumb breadcrumbs pager pagination masthead footer footnav copyright "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe signup searchbox contentinfo complementary".split())
# Words that do so alone or beside words without a meaning of their own, and not for paragraphs.
WEAK = frozenset(
    "header side aside toolbar notice notices alert subscription login form search share sharing social related recommended "
    "recommendations widget widgets".split())
COMMENTS = frozenset("comment comments commentlist commentaries disqus replies reply respond responses".split())
PLAIN = frozenset(
    "area articles bar block bottom box button buttons card container content entry footer inner left links list main module news "
    "outer page panel post posts primary right secondary section site stories title top user view wrap wrapper".split())
# Before such a word a mark says what a page has, not what a block is.
QUALIFIERS = frozenset("has no not with without is hide show open closed".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HEADERS = frozenset(("header", "masthead"))
# Elements that hold articles: class words say how they look, not what they are.
_HOLDERS = frozenset("html body main article".split())
# Wording of notices, and headings of reader comments.
_NOTICE = re.compile(
    r"\bcookies?\b|\u00a9|\(c\) ?[0-9]{4}|\bcopyright\b|all rights reserved|privacy policy|terms of (?:use|service)|"
    r"\bnewsletter\b|subscribe (?:to|now)|sign up (?:to|for)|\badvertisement\b|\bsponsored\b", re.I)
# Every wording holds one of these, which are found faster.
_NOTICE_PARTS = ("cookie", "\u00a9", "(c)", "copyright", "reserved", "policy", "terms of", "newsletter", "subscribe", "sign up", "advertisement", "sponsored")
_COMMENT_HEADING = re.compile(
    r"(?:[0-9]+ )?(?:reader |user )?(?:comments?|kommentare?|commentaires?|comentarios)(?: ?\([0-9]+\))?:?|(?:leave|post|add) a (?:reply|comment):?", re.I)
NOTICE_SHARE = 0.1        # what wording of notices, links and labels leave of a line's ratio on the log scale
FULL_RATIO = 80.0         # characters a tag from which a line is as dense as text can be
ONE_CLUSTER = 0.55        # centres nearer to each other than this ratio are one cluster


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attrs)


def _mark_words(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[set[str], bool]:
    """Furniture words of the attributes, and whether one stands alone as a class, id or role."""
    found, alone = set(), False
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for token in value.lower().split():
                parts = {p for p in _SPLIT.split(token) if p and not p.isdigit()}
                if not QUALIFIERS.isdisjoint(parts):
                    continue
                mine = parts & COMMENTS
                if tag not in _HOLDERS:
                    mine |= parts & STRONG
                    if tag != "p" and parts & WEAK and parts <= WEAK | STRONG | PLAIN | COMMENTS:
                        mine |= parts & WEAK
                elif tag != "article":
                    mine = set()
                found |= mine
                alone = alone or bool(mine) and token in mine
    return found, alone


class Open(NamedTuple):
    tag: str
    container: int
    hard: bool                           # inside an element that is furniture by its tag
    mark: int                            # innermost element marked by words, -1 for none
    outside: tuple[bool, int] | None     # hard and mark of headings in a header


class Line(NamedTuple):
    text: str
    tags: int
    container: int
    hard: bool
    mark: int
    links: int                           # characters inside links
    labels: int                          # characters inside labels of form fields
    heading: str
    title: tuple[bool, int] | None       # hard and mark if this heading of a page header is the title


class Mark(NamedTuple):
    parent: int
    comments: bool
    alone: bool
    line: int                            # first line inside
    container: int                       # container around the marked element


class LineParser(HTMLParser):
    """Lines of a page, containers as (parent, tag), and marked elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents, self.kinds = [-1], ["page"]
        self.named = [0]  # innermost article or main element around a container and itself, 0 for none
        self.marks: list[Mark] = []
        self.open: list[Open] = []
        self.text: list[str] = []
        self.tags = self.links = self.anchors = self.labels = self.fields = 0

    def _state(self) -> Open:
        return self.open[-1] if self.open else Open("", 0, False, -1, None)

    def _end_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text.clear()
            if text:
                at = self._state()
                heading = at.tag if at.tag in _HEADINGS else ""
                if at.tag not in RAW:
                    title = at.outside if heading == "h1" and not self._in_article() else None
                    self.lines.append(Line(text, self.tags, at.container, at.hard, at.mark, self.links, self.labels, heading, title))
        self.tags = self.links = self.labels = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._end_line()
            self._close_implied(tag)
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if tag == "a":
            self.anchors += 1
        elif tag == "label":
            self.fields += 1
        hard = tag in FURNITURE or tag == "header" or bool(attrs) and _hidden(attrs)
        words, alone = _mark_words(tag, attrs) if attrs and tag not in _HEADINGS else (set(), False)
        if tag not in BLOCKS and not hard and not (alone and not STRONG.isdisjoint(words)):
            return  # inline markup changes nothing, unless one strong word is all its name
        if tag in ("form", "fieldset"):
            words = words | {tag}
        if tag not in BLOCKS:
            self._end_line()
        at = self._state()
        container, mark, outside = at.container, at.mark, at.outside
        if tag == "header" or words and words <= _HEADERS:
            # A header keeps the headings of its article.
            outside = outside or (at.hard, at.mark)
        elif hard or words:
            outside = None
        if words:
            self.marks.append(Mark(mark, not COMMENTS.isdisjoint(words), alone, len(self.lines), container))
            mark = len(self.marks) - 1
        hard = hard or at.hard
        if tag in _HEADINGS and outside and not words and self._in_article():
            hard, mark = outside
        if tag in CONTAINERS:
            self.parents.append(container)
            self.kinds.append(tag)
            self.named.append(len(self.named) if tag in ("article", "main") else self.named[container])
            container = len(self.kinds) - 1
        self.open.append(Open(tag, container, hard, mark, outside))

    def _in_article(self) -> bool:
        return self.named[self._state().container] > 0

    def _close_implied(self, tag: str) -> None:
        if not self.open:
            return
        last = self.open[-1].tag
        if last == "p" or last == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option") or last in ("dt", "dd") and tag in ("dt", "dd"):
            self.open.pop()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
        elif tag == "a":
            self.anchors = max(self.anchors - 1, 0)
        elif tag == "label":
            self.fields = max(self.fields - 1, 0)
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag == tag:
                if tag not in BLOCKS:
                    self._end_line()
                del self.open[at:]
                break
            # An end tag cannot reach across the container it stands in.
            if self.open[at].tag in ("article", "body") and tag not in ("html", "body"):
                break

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.anchors:
            self.links += len(data.strip())
        if self.fields:
            self.labels += len(data.strip())

    def finish(self) -> None:
        self.close()
        self._end_line()


def _smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    spread = np.convolve(values, kernel)[reach:reach + len(values)]
    return spread / np.convolve(np.ones(len(values)), kernel)[reach:reach + len(values)]


def _upper_cluster(values: np.ndarray) -> np.ndarray:
    """True for values nearer to the upper of two cluster centres (one cluster: all)."""
    lo, hi = float(values.min()), float(values.max())
    if hi <= lo:
        return np.ones(len(values), bool)
    for _ in range(50):
        upper = values > (lo + hi) / 2
        low, high = float(values[~upper].mean()), float(values[upper].mean())
        if (low, high) == (lo, hi):
            break
        lo, hi = low, high
    return values > (lo + hi) / 2 if lo < ONE_CLUSTER * hi else np.ones(len(values), bool)


def core_lines(lines: list[Line]) -> np.ndarray:
    """Whether each line is in the upper cluster of the smoothed ratios.

    Furniture elements take no part, and lines of notices or links are core only where nothing else is.
    """
    core = np.zeros(len(lines), bool)
    at = np.array([n for n, line in enumerate(lines) if not line.hard], np.int64)
    if len(at):
        lowered = np.array([_lowered(lines[n]) for n in at])
        ratio = np.array([min(len(lines[n].text) / max(lines[n].tags, 1), FULL_RATIO) for n in at])
        upper = _upper_cluster(_smooth(np.log1p(ratio) * np.where(lowered, NOTICE_SHARE, 1.0), SIGMA))
        core[at] = upper & ~lowered if (upper & ~lowered).any() else upper
    return core


def _lowered(line: Line) -> bool:
    if line.links * 2 > len(line.text) or line.labels * 2 > len(line.text):
        return True
    low = line.text.lower()
    return any(part in low for part in _NOTICE_PARTS) and _NOTICE.search(low) is not None


def _up(sums: list[int], parents: list[int]) -> list[int]:
    """Sums with those of everything inside; parents come first."""
    for at in range(len(sums) - 1, -1, -1):
        if parents[at] >= 0:
            sums[parents[at]] += sums[at]
    return sums


def _furniture_marks(parser: LineParser, core: np.ndarray) -> list[bool]:
    """Whether each marked element is furniture.

    Comments are if text of the core stands before them, any other one unless it holds more
    than half of the core that is no comment; one marked by a word alone also beside other core.
    """
    lines, marks = parser.lines, parser.marks
    parents = [m.parent for m in marks]
    furniture = [False] * len(marks)
    text_at = 0  # first line of core text outside comments, as far as the page was read
    for n, mark in enumerate(marks):
        while text_at < mark.line and not (core[text_at] and (lines[text_at].mark < 0 or not furniture[lines[text_at].mark])):
            text_at += 1
        if mark.parent >= 0 and furniture[mark.parent]:
            furniture[n] = True
        elif mark.comments:
            furniture[n] = text_at < mark.line
    direct, all_core, named_core = [0] * len(marks), 0, 0
    held = [0] * len(marks)
    for line, chosen in zip(lines, core):
        if chosen and not line.hard and (line.mark < 0 or not furniture[line.mark]):
            named = len(line.text) if parser.named[line.container] else 0
            all_core += len(line.text)
            named_core += named
            if line.mark >= 0:
                direct[line.mark] += len(line.text)
                held[line.mark] += named
    total, held = _up(direct, parents), _up(held, parents)
    for n, mark in enumerate(marks):
        if mark.parent >= 0 and furniture[mark.parent]:
            furniture[n] = True
        elif not mark.comments and not furniture[n]:
            furniture[n] = total[n] * 2 <= all_core or mark.alone and total[n] < all_core and (named_core > 0 and not held[n])
    return furniture


def _content(parser: LineParser, kept: list[bool], core: np.ndarray) -> tuple[list[bool], list[bool]]:
    """Whether each container is content, and whether it lies in an article that is content as a whole."""
    parents, kinds = parser.parents, parser.kinds
    weight, some = [0] * len(kinds), [0] * len(kinds)
    for line, k, chosen in zip(parser.lines, kept, core):
        some[line.container] += k
        weight[line.container] += len(line.text) if k and chosen else 0
    all_core = sum(weight)
    weight, some = _up(weight, parents), _up(some, parents)
    named = [n for n, kind in enumerate(kinds) if kind in ("article", "main") and some[n]]
    named = {n for n in named if weight[n]} or set(named)
    outer = {n for n in named if parser.named[parents[n]] not in named}
    inside_core = sum(weight[n] for n in outer)
    # A main element with articles of its own is judged by its containers.
    split = {parser.named[parents[n]] for n in named}
    whole = [n in named and not (kinds[n] == "main" and n in split) for n in range(len(kinds))]
    within = [n in outer for n in range(len(kinds))]
    for n in range(1, len(kinds)):
        whole[n] = whole[n] or whole[parents[n]]
        within[n] = within[n] or within[parents[n]]
    anywhere = not named or all_core - inside_core > 2 * inside_core
    return [whole[n] or weight[n] > 0 and (anywhere or within[n]) for n in range(len(kinds))], whole


def _after_comment_headings(parser: LineParser, kept: list[bool], core: np.ndarray) -> None:
    """Takes out what follows a heading of comments in its container, once there was core text."""
    lines, parents = parser.lines, parser.parents
    closed, seen = set(), False
    for n, line in enumerate(lines):
        at = line.container
        while at >= 0 and at not in closed:
            at = parents[at]
        if at >= 0:
            kept[n] = False
        elif kept[n] and seen and line.heading and _COMMENT_HEADING.fullmatch(line.text):
            closed.add(line.container)
            kept[n] = False
        seen = seen or kept[n] and bool(core[n])


def main_text(html: str) -> str:
    """Main text of a page: blocks in page order joined by a line end; empty where there is none."""
    if not html or html.isspace():
        return ""
    parser = LineParser()
    parser.feed(html)
    parser.finish()
    lines = parser.lines
    if all(line.hard for line in lines):
        return ""
    core = core_lines(lines)
    furniture = _furniture_marks(parser, core)
    good = lambda hard, mark: not hard and (mark < 0 or not furniture[mark])
    kept = [good(line.hard, line.mark) for line in lines]
    if not any(kept):
        kept = [not line.hard for line in lines]
    _after_comment_headings(parser, kept, core)
    if not any(k and c for k, c in zip(kept, core)):
        core = np.array(kept)
    content, whole = _content(parser, kept, core)
    named = bool({"article", "main"} & set(parser.kinds))
    chosen = []
    for line, k in zip(lines, kept):
        loose = parser.kinds[line.container] in ("page", "body", "main") and not whole[line.container]
        chosen.append(k and content[line.container] and not (loose and _lowered(line) and not line.heading) and line.labels < len(line.text))
    # Headings beside content: one right before it, and the page's title if there is no other.
    for n in range(len(lines) - 2, -1, -1):
        if kept[n] and lines[n].heading and not named:
            chosen[n] = chosen[n] or chosen[n + 1]
    if True in chosen and not any(c and line.heading == "h1" for c, line in zip(chosen, lines)):
        first = chosen.index(True)
        for n, line in enumerate(lines[:first]):
            if line.heading == "h1" and (kept[n] or not named and line.title is not None and good(*line.title)):
                chosen[n] = True
    return "\n".join(line.text for line, c in zip(lines, chosen) if c)


def extract_main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Every row of ``pages`` with the main text of its ``html`` in ``out`` (empty for null, blank or furniture only).

    Other columns pass through, except one already named ``out``; each page is worked on alone
    and whole, so repeated rows give equal texts.
    """
    source = pages.drop(out) if out != html else pages.withColumnRenamed(html, free(pages, "html_source")[0])
    column = html if out != html else source.columns[pages.columns.index(html)]
    kept = [c for c in source.columns if c != column or out != html]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(value.as_py() or "") for value in batch.column(column)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], texts], names=[*kept, out])

    schema = T.StructType([*[source.schema[c] for c in kept], T.StructField(out, T.StringType())])
    return source.mapInArrow(extract, schema)
