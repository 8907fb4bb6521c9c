"""Main text of HTML pages by the distribution of text over line blocks.

1. *Strip markup.*  One scan of the page, linear in its length, turns it into
   lines, one for each block element; character references are decoded, white
   space in a line is one space.  Elements that never hold an article (menus,
   page headers and footers, sidebars, notices, adverts, forms, scripts, styles,
   reader comments), known by tag, role or class and id, give no lines.  A class
   counts if all its words say so (``cookie-notice``, not ``related-work``, nor
   ``ad-hoc``), or one that leaves no doubt (``paywall``); a wrapper that is only named like one
   does not hide the article in it.
2. *Sum over windows.*  A line weighs its characters outside links; a window of
   ``WINDOW`` lines weighs their sum.  Where the page marks an article or main
   element, lines in it weigh all their characters and others nothing.
3. *Surge and dive.*  Text surges at a window of ``SURGE`` characters, or of an
   eighth of the page's heaviest window where that is less, and dives at the first
   window without any.  Surges that lead to less than ``SHARE`` of the heaviest
   region are not the article (a line of copyright, a card of another article).
4. *Keep.*  Marked elements with a surge that counts are kept whole, and nothing
   between them is.  Without a mark all lines from the first surge to the last
   dive are kept, whatever they weigh, and on both sides what lies in the element
   round the surge's or dive's line: short lines, links between them, and links
   at its ends where they are paragraphs of that element and it is not the page's
   body.  Headings right before the surge belong to it.

Nulls and edges: a null, empty or markup-only page gives the empty text; an
unclosed element ends with its parent; a page cut off anywhere is read as far
as it goes; unknown references stay as they are; equal rows are read each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import buffers, slices

WINDOW, SURGE, SHARE = 3, 80, 0.1

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: Blocks that are one line, or one entry, of the block round them.
UNITS = frozenset("address blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary tr".split())
#: Cells of one table row are parts of one line.
CELLS = frozenset(("td", "th"))
DROPPED = frozenset("head nav header footer aside form button select dialog menu search svg canvas audio video applet".split()) | RAW
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CLOSES_P = BLOCKS - frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head", "title", "option", "optgroup"))
#: Elements that an end tag, or the next element of the kind, doesn't look beyond.
P_FENCES, LI_FENCES = ("button", "table", "td", "th", "article", "body"), ("ul", "ol", "menu")
#: Words of class and id values that mark what is not the article, in any company.
CERTAIN = frozenset(
    "adbox advert advertisement advertising adverts breadcrumb breadcrumbs captcha disqus gdpr masthead navbar navigation newsletter pagination paywall sponsored".split()
)
#: Words that do so beside each other and beside words of place and shape.
LIKELY = CERTAIN | frozenset(
    "ad ads alert banner comment comments consent cookie cookies copyright disclaimer footer header legal menu modal nav notice notification pager popup promo "
    "promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor subscribe subscription toc toolbar tracking widget".split()
)
PLAIN = frozenset(
    "area articles bar block bottom box button buttons column container content count desktop fixed form global google group icon icons inline inner item items label left link "
    "links list main message mobile native nav outer overlay page panel placement policy post posts primary rail rectangle right secondary section site slot sticky thread "
    "top unit wrap wrapper zone".split()
)
#: Words beside "header" that make it the article's own.
OWN = frozenset("article content entry post story".split())
#: Words of elements whose own article elements are not the article.
OTHERS = frozenset("ad ads advert advertisement adverts comment comments disqus footer nav promo recommended related replies reply respond sidebar sponsored".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

#: A comment, a declaration, or a tag with its attributes; no part is ever read twice.
TAG = re.compile(
    r"<!--(?:>|->|(?:(?!--!?>).)*+(?:--!?>|\Z))|<!\[CDATA\[(?:(?!\]\]>).)*+(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)(?:>|\Z)|</[^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+(?=[\s/>]|\Z)""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: How sure it is that an element is not the article.
KEPT, NAMED, SURE = 0, 1, 2


def doubt(tag: str, attributes: str) -> int:
    """Whether an element's own markup says that it is not the article: not at all, by the name of a wrapper, or for sure."""
    found = KEPT
    if not attributes or tag in ("html", "body"):
        return found
    article = tag in ("article", "main")
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            for token in value.split():
                words = {w for w in SPLIT.split(CAMEL.sub(" ", token).lower()) if w and not w.isdigit()}
                if article and words.isdisjoint(("comment", "comments")):
                    continue
                certain = not words.isdisjoint(CERTAIN)
                if certain or not words.isdisjoint(LIKELY) and words <= LIKELY | PLAIN and not ("header" in words and not words.isdisjoint(OWN)):
                    found = max(found, NAMED if words.isdisjoint(OTHERS) else SURE)
        elif name == "role":
            if not article and not ROLES.isdisjoint(value.lower().split()):
                return SURE
        elif not article and (name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return SURE
    return found


class Line(NamedTuple):
    text: str
    free: int  #: characters outside links
    article: int  #: number of the marked article that holds it, or 0
    heading: bool
    round: int  #: number of the block round it


class Lines:
    """The lines of a page, and of each block the lines inside (first, last + 1) and whether it is the body."""

    def __init__(self, page: str):
        self.out: list[Line] = []
        self.parts: list[str] = []
        self.link_chars = 0
        self.stack: list[tuple[str, int, int]] = []  # tag, how surely dropped from here, number of the article from here
        self.places: dict[str, list[int]] = {}  # where in the stack each tag is open
        self.blocks: list[int] = []  # where in the stack blocks are open
        self.open: list[int] = [0]  # numbers of the open blocks, the page's own first
        self.spans: list[list] = [[0, 0, True]]
        self.articles = 0
        self.heading = False
        self._read(page)
        self.spans[0][1] = len(self.out)

    def _end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                # the block round a paragraph, but a section that has text of its own is the one round that
                inner = bool(self.blocks) and self.stack[self.blocks[-1]][0] in UNITS
                self.out.append(Line(text, max(0, len(text) - self.link_chars), self.stack[-1][2] if self.stack else 0, self.heading, self.open[-1 - inner]))
            self.parts, self.link_chars = [], 0

    def _pop(self, depth: int) -> None:
        if self.blocks and self.blocks[-1] >= depth:
            self._end_line()
        while len(self.stack) > depth:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
                self.spans[self.open.pop()][1] = len(self.out)

    def _text(self, raw: str) -> None:
        if raw and not (self.stack and self.stack[-1][1]):
            text = unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.places.get("a"):
                self.link_chars += len(text.strip())

    def _read(self, page: str) -> None:
        at = 0
        while at < len(page):
            m = TAG.search(page, at)
            if not m:
                break
            self._text(page[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self._close(tag)
            else:
                self._open(tag, m[3] or "")
                if tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                    at = end.start() if end else len(page)
        self._text(page[at:])
        self._pop(0)
        self._end_line()

    def _last(self, tags: tuple[str, ...]) -> int:
        """The innermost place of any of these, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br" or tag in CELLS:
            self.parts.append(" ")
        if tag in VOID:
            if tag == "hr":
                self._end_line()
            return
        if tag in CLOSES_P and (p := self._last(("p",))) > self._last(P_FENCES):
            self._pop(p)
        if tag == "li" and (i := self._last(("li",))) > self._last(LI_FENCES):
            self._pop(i)
        for same in (("dt", "dd"), ("tr",), ("td", "th"), ("option",)):
            if tag in same and self.stack and self.stack[-1][0] in same:
                self._pop(len(self.stack) - 1)
        if tag in BLOCKS and tag not in CELLS:
            self._end_line()
        self.heading = tag in HEADINGS if tag in BLOCKS else self.heading
        dropped, article = self.stack[-1][1:] if self.stack else (KEPT, 0)
        own = doubt(tag, attributes)
        if tag in ("article", "main") and own == KEPT and dropped == NAMED:
            dropped = KEPT  # the name was that of a wrapper round the article
        if tag in DROPPED and not (tag == "header" and article):
            own = SURE
        dropped = max(dropped, own)
        if not article and not dropped and tag in ("article", "main"):
            self.articles += 1
            article = self.articles
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
            self.open.append(len(self.spans))
            self.spans.append([len(self.out), 0, tag in ("html", "body")])
        self.stack.append((tag, dropped, article))

    def _close(self, tag: str) -> None:
        if tag in CELLS:
            self.parts.append(" ")
        at = self._last((tag,))
        # an inline end tag does not end blocks around it
        if at >= 0 and (tag in BLOCKS or not self.blocks or at > self.blocks[-1]):
            self._pop(at)
        if tag in BLOCKS:
            self.heading = False


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by an empty line."""
    read = Lines(page or "")
    lines = read.out
    if any(x.article for x in lines):
        weights, owner = [], []  # windows don't reach from one element into another
        for x in lines:
            if x.article:
                gap = WINDOW if owner and owner[-1] != x.article else 0
                weights += [0] * gap + [len(x.text)]
                owner += [x.article] * (gap + 1)
        chosen = {owner[a] for a, _ in regions(weights)}
        return "\n\n".join(x.text for x in lines if x.article in chosen)
    found = regions([x.free for x in lines])
    if not found:
        return ""
    first, last = found[0][0], found[-1][1]
    first, last = widened(lines, read.spans, first, -1), widened(lines, read.spans, last, 1)
    while first > 0 and lines[first - 1].heading:
        first -= 1
    return "\n\n".join(x.text for x in lines[first : last + 1])


def widened(lines: list[Line], spans: list[list], at: int, step: int) -> int:
    """From a surge's first or a dive's last line to the outermost line of the block round it that belongs to the article."""
    block = lines[at].round
    start, end, body = spans[block]
    best = k = at
    while start <= k + step < end:
        k += step
        if lines[k].free or lines[k].heading or not body and lines[k].round == block:
            best = k
    return best


def regions(weights: list[int]) -> list[tuple[int, int]]:
    """First and last line of each region from a surge to its dive that counts."""
    n = len(weights)
    upto = [0]
    for w in weights:
        upto.append(upto[-1] + w)
    sums = [upto[min(i + WINDOW, n)] - upto[i] for i in range(n)]
    need = min(SURGE, max(sums, default=0) / 8)
    found, i = [], 0
    while i < n:
        if not weights[i] or sums[i] < need:
            i += 1
            continue
        j = i
        while j < n and sums[j] > 0:
            j += 1
        last = j - 1
        while not weights[last]:
            last -= 1
        found.append((i, last, upto[last + 1] - upto[i]))
        i = j
    least = SHARE * max((w for _, _, w in found), default=0)
    return [(a, b) for a, b, w in found if w >= least]


def extract(df: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """The columns ``keep`` and ``text``, the main text of each row."""
    source = df.select(*keep, F.col(html).cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(buffers(batch.column("_html"))[1]):
                part = batch.slice(i, j - i)
                texts = [main_text(h) for h in part.column("_html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return source.mapInArrow(run, source.select(*keep, F.lit("").alias("text")).schema)
