"""Elements of web pages by ordered selectors: one linear scan of a page, rows out.

A selector is a chain of compounds (``main #content``, ``a.footnote``,
``meta[property="og:title"]``, ``div[class*="panel"]``), each an element below
the one before.  ``elements`` takes the first selector of a list that any
element of the page satisfies; that selector's first element is the container,
and a row comes back for each wanted element inside, in page order.

The tree: an end tag closes the innermost open element of its name, with all
that is open inside, and is ignored where none is; a paragraph also ends at the
next block and an element ends with its parent.  Wanted elements of one name
don't nest: the next ends the one before.  Every step costs time by the length
of what it reads, or by what it closes for good, so a page of nothing but
unclosed tags takes time by its length.

Text: strings inside the element, references decoded (as HTML does, or with
``closed`` only those that end with their semicolon), white space collapsed, without scripts, styles and whatever lies in a dropped element inside it (wanted
elements there give no rows; those of a dropped element outside do).

Nulls and edges: a null or empty page has a header row without a selector and
nothing else; an unfinished tag, comment or script goes to the end of the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without markup inside, and those of them whose text is not of the page.
RAW = frozenset(("script", "style", "title", "textarea"))
SILENT = frozenset(("script", "style"))
BLOCKS = frozenset(
    "address article aside blockquote body center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: No part of a tag is read twice, whatever quotes are missing.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
STEP = re.compile(r"""([#.])([\w-]+)|\[([\w:-]+)(\*?=)"([^"]*)"\]|([\w-]+)""")
#: Names are at most 31 characters long.
CLOSED = re.compile(r"&(?:#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|[a-zA-Z][a-zA-Z0-9]{0,31});")
#: Characters of text in one batch of rows, or those of one page.
SLICE = 1 << 19


def unescape_closed(text: str) -> str:
    """References with their semicolon decoded; ``&amp`` without one stays as it is written."""
    return CLOSED.sub(lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


def parsed(selector: str) -> list[tuple[str | None, list[tuple[str, str, str]]]]:
    """Compounds of a selector: the element's name, and conditions (attribute, kind, value)."""
    steps = []
    for compound in re.findall(r"""(?:[^\s\["]|\[[^\]]*\])+""", selector):
        tag, rules = None, []
        for mark, name, attribute, kind, value, plain in STEP.findall(compound):
            if plain:
                tag = plain.lower()
            elif mark:
                rules.append(("id" if mark == "#" else "class", "=" if mark == "#" else "~=", name))
            else:
                rules.append((attribute, kind, value))
        steps.append((tag, rules))
    return steps


def fits(step: tuple, tag: str, attributes: dict[str, str]) -> bool:
    name, rules = step
    if name is not None and name != tag:
        return False
    for attribute, kind, value in rules:
        own = attributes.get(attribute)
        if own is None or not (own == value if kind == "=" else value in own if kind == "*=" else value in own.split()):
            return False
    return True


class Scan:
    """One pass over a page.  ``found`` has [tag, depth, first and last+1 string, attributes, scope] of each wanted element."""

    def __init__(self, page: str, within: Sequence, wanted: Sequence, dropped: Sequence, scope: Sequence, headings: Sequence, closed: bool = False):
        self.decode = unescape_closed if closed else unescape
        self.groups = (within, wanted, dropped, scope, headings)
        self.selectors = [s for g in self.groups for s in g]
        self.first: list[list[int] | None] = [None] * len(within)  # of each container the elements inside
        self.found: list[list] = []
        self.strings: list[str] = []
        self.open: list[tuple] = []  # tag, how far each selector's chain has come, what ends with the element
        self.places: dict[str, list[int]] = {}
        self.named: dict[str, int] = {}  # wanted elements that are open, by tag
        self.skipped = 0  # dropped elements that are open
        self.scopes: list[tuple[int, int | None]] = []  # (parent, heading) of each
        self.scope = -1
        self._read(page)
        self._close(0)

    def _read(self, page: str) -> None:
        at = 0
        for m in iter(lambda: TOKEN.search(page, at), None):
            self._text(page[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if tag and m[1]:
                if self.places.get(tag):
                    self._close(self.places[tag][-1])
            elif tag:
                self._begin(tag, m[3])
                if tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                    stop = end.start() if end else len(page)
                    if tag not in SILENT:
                        self._text(page[at:stop])
                    at = stop
        self._text(page[at:])

    def _text(self, raw: str) -> None:
        if raw and not self.skipped and not raw.isspace():
            self.strings.append(self.decode(raw) if "&" in raw else raw)

    def _begin(self, tag: str, written: str) -> None:
        if tag in BLOCKS and self.places.get("p"):
            self._close(self.places["p"][-1])
        attributes = {}
        for name, *values in ATTRIBUTE.findall(written) if written else ():
            attributes.setdefault(name.lower(), unescape(next(filter(None, values), "")))
        before = self.open[-1][1] if self.open else (0,) * len(self.selectors)
        after, hits, k = None, [], 0
        for g, group in enumerate(self.groups):
            for n, steps in enumerate(group):
                done = before[k]
                if fits(steps[done], tag, attributes):
                    if done == len(steps) - 1:
                        hits.append((g, n))
                    else:
                        after = after or list(before)
                        after[k] += 1
                k += 1
        ends = self._hit(tag, attributes, hits) if hits else []
        if tag in VOID:
            self._end(ends)
            return
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, tuple(after) if after else before, ends))

    def _hit(self, tag: str, attributes: dict[str, str], hits: list[tuple[int, int]]) -> list[tuple]:
        ends = []
        kinds = {g for g, _ in hits}
        if 3 in kinds:
            ends.append(("scope", self.scope))
            self.scopes.append([self.scope, None])
            self.scope = len(self.scopes) - 1
        if 2 in kinds and self.named:  # outside wanted elements there is nothing to drop from
            self.skipped += 1
            ends.append(("skip",))
        elif (1 in kinds or 4 in kinds) and not self.skipped:
            if tag in self.named:
                self.found[self.named.pop(tag)][3] = len(self.strings)
            row = len(self.found)
            self.found.append([tag, len(self.open), len(self.strings), None, attributes, self.scope, 1 in kinds])
            self.named[tag] = row
            ends.append(("row", row))
            s = self.scope if 4 in kinds else -1
            while s >= 0 and self.scopes[s][1] is None:  # outer scopes without a heading of their own have this one too
                self.scopes[s][1] = row
                s = self.scopes[s][0]
        for g, n in hits:
            if g == 0 and self.first[n] is None:
                self.first[n] = [len(self.found), None]
                ends.append(("container", n))
        return ends

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, _, ends = self.open.pop()
            self.places[tag].pop()
            self._end(ends)

    def _end(self, ends: list[tuple]) -> None:
        for kind, *what in ends:
            if kind == "skip":
                self.skipped -= 1
            elif kind == "scope":
                self.scope = what[0]
            elif kind == "container":
                self.first[what[0]][1] = len(self.found)
            elif self.found[what[0]][3] is None:
                self.found[what[0]][3] = len(self.strings)
                self.named.pop(self.found[what[0]][0], None)

    def text(self, row: int) -> str:
        """Strings of an element, or the content of a meta element."""
        tag, _, start, end, attributes, *_ = self.found[row]
        return " ".join((attributes.get("content", "") if tag == "meta" else " ".join(self.strings[start:end])).split())


ROWS = "pos int, selector string, tag string, depth int, text string, href string, heading string"


def elements(pages: DataFrame, keep: Sequence[str], within: Sequence[str], wanted: Sequence[str], dropped: Sequence[str] = (), scope: Sequence[str] = (), headings: Sequence[str] = (), html: str = "html", closed: bool = False) -> DataFrame:
    """The columns ``keep`` with pos, selector, tag, depth, text, href and heading.

    Row 0 of a page is its header (selector only: which of ``within`` held);
    the others are the wanted elements of the container, empty ones included.
    ``heading`` is the text of the first of ``headings`` in the innermost
    element round it that satisfies ``scope``.  An empty ``within`` takes pages whole.  With ``closed`` a
    reference without its semicolon is text.
    """
    source = pages.select(*keep, F.col(html).cast("string").alias("_html"))
    groups = [[parsed(s) for s in g] for g in (within, wanted, dropped, scope, headings)]
    names = [f.split()[0] for f in ROWS.split(", ")]
    types = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def of(page: str) -> list[tuple]:
        scan = Scan(page, *groups, closed)
        best = next((n for n, held in enumerate(scan.first) if held), None)
        start, end = scan.first[best] if best is not None else (0, 0 if within else len(scan.found))
        out, texts = [(0, within[best] if best is not None else None, None, None, None, None, None)], {}
        rows = [r for r in range(start, end) if scan.found[r][6]]
        for pos, r in enumerate(rows, 1):
            tag, depth, *_, attributes, s, _ = scan.found[r]
            h = scan.scopes[s][1] if s >= 0 else None
            if h is not None and h not in texts:
                texts[h] = scan.text(h)
            out.append((pos, out[0][1], tag, depth, scan.text(r), attributes.get("href"), texts.get(h)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, size = [], [], 0
            for k, page in enumerate(batch.column("_html")):
                new = of(page.as_py() or "")
                rows += new
                at += [k] * len(new)
                size += sum(len(r[4] or "") + len(r[6] or "") for r in new)
                if size > SLICE or k == batch.num_rows - 1:
                    own = [batch.column(c).take(pa.array(at)) for c in keep]
                    yield pa.RecordBatch.from_arrays(own + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [*keep, *names])
                    rows, at, size = [], [], 0

    return source.mapInArrow(run, StructType(source.select(*keep).schema.fields + StructType.fromDDL(ROWS).fields))
