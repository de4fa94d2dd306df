"""Layout-aware rendering of web pages to text.

A scanner yields tags and text; a builder makes a tree, supplying the tags that HTML lets authors
leave out; the renderer walks the tree (without recursion) and writes what a reader would
see: blocks on lines of their own with blank lines between paragraphs, list markers
and indents, and table cells padded to aligned columns.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.worker import fresh

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("textarea title".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe noembed noframes audio video canvas object datalist map param source track defs desc metadata annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
BLOCKS = SPACED | frozenset(
    "address article aside body center details dialog dd dir div dt fieldset figcaption footer form header hgroup html legend li main menu nav optgroup option section summary caption thead tbody tfoot tr td th".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dt dd".split()
)
# An open element named left is ended by the start of one named right, up to a boundary.
IMPLIED_END = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir", "table", "td", "th"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table", "td", "th"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table", "td", "th"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "tr": (frozenset({"tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "thead": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "body": (frozenset({"head"}), frozenset()),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
P_SCOPE = frozenset("html table td th caption button object template".split())

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_TAG_STOP = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_HIDING = re.compile(r"display\s*:\s*none|(?:^|;)\s*opacity\s*:\s*0(?:\.0*)?\s*(?:;|$)", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*([a-z]+)", re.I)
_NUMBER = re.compile(r"-?[0-9]{1,9}")
#: Cells of longer lines don't widen their column, and no cell is padded beyond twice this.
WIDEST = 120
#: Items and cells nested deeper are plain blocks, so that indents don't add up.
DEEPEST = 64


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes = tag, attributes or {}
        self.children: list[Node | str] = []


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return out


class TreeBuilder:
    """Open elements as a stack, with the places of each name in it, so that nothing is searched for."""

    def __init__(self) -> None:
        self.root = Node("#root")
        self.stack = [self.root]
        self.open: dict[str, list[int]] = {}

    def text(self, data: str) -> None:
        if data:
            if self.stack[-1].tag == "head" and not data.isspace():
                self._pop()
            self.stack[-1].children.append(unescape(data) if "&" in data else data)

    def raw_text(self, data: str) -> None:
        if data:
            self.stack[-1].children.append(data)

    def _pop(self) -> Node:
        node = self.stack.pop()
        self.open[node.tag].pop()
        return node

    def _innermost(self, names: Iterable[str]) -> int:
        """Place of the innermost open element of these names, 0 if there is none."""
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=0)

    def _end(self, names: frozenset[str], bounds: frozenset[str]) -> None:
        """Closes the outermost open element of `names` above the nearest of `bounds`, with all inside it."""
        floor, at = self._innermost(bounds - names), 0
        for name in names:
            places = self.open.get(name, ())
            k = bisect_right(places, floor)
            if k < len(places) and (not at or places[k] < at):
                at = places[k]
        while at and len(self.stack) > at:
            self._pop()

    def start(self, tag: str, source: str) -> None:
        if tag in CLOSES_P and self.open.get("p"):
            self._end(frozenset({"p"}), P_SCOPE)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self._pop()
        if tag in IMPLIED_END:
            self._end(*IMPLIED_END[tag])
        if tag in ("td", "th") and self.open.get("table") and self.stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self.start("tr", "")
        if self.open.get("head") and self.stack[-1].tag == "head" and tag not in UNSEEN:
            self._pop()
        node = Node(tag, _attributes(source) if source.strip(" /\t\n\r\f") else None)
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.open.setdefault(tag, []).append(len(self.stack))
            self.stack.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif tag == "p" and not self.open.get("p"):
            self.start("p", "")
            self._pop()
        elif self.open.get(tag):
            at = self.open[tag][-1]
            if tag not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "body", "html") and self._innermost(("td", "th", "caption")) > at:
                return
            while len(self.stack) > at:
                self._pop()


class _Scanner:
    """Where markup ends, in time linear in the page: what was once searched for in vain isn't searched for again."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.quoting = True

    def tag_end(self, at: int) -> int:
        """The place of the `>` that ends a tag whose name ends at `at`, -1 if there is none. Quoted values may hold `>`."""
        if at > self.last:
            return -1
        start = at
        while self.quoting:
            m = _TAG_STOP.search(self.html, at)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            at = self.html.find(m[0][-1], m.end()) + 1
            if not at:
                break
        self.quoting = False  # a quote is never closed, so from here on quotes mean nothing
        return self.html.find(">", start)


def parse(html: str) -> Node:
    """The tree of a page; never fails, whatever the markup. A `<` that begins no tag, or one without `>`, is text."""
    builder, scanner, at, done, size = TreeBuilder(), _Scanner(html), 0, 0, len(html)

    def past(mark: str, start: int) -> int:
        found = html.find(mark, start)
        return size if found < 0 else found + len(mark)

    while (at := html.find("<", at)) >= 0:
        m = _TAG.match(html, at)
        if m is None and html[at + 1 : at + 2] not in ("!", "?"):
            at += 1
            continue
        stop = scanner.tag_end(m.end()) if m else 0
        if stop < 0:
            break
        builder.text(html[done:at])
        if m is None:
            if html.startswith("<!--", at):
                done = past("-->", at + 4)
            elif html.startswith("<![CDATA[", at):
                done = past("]]>", at + 9)
                builder.raw_text(html[at + 9 : done].removesuffix("]]>"))
            else:
                done = past(">", at)
            at = done
            continue
        tag, at = m[1].lower(), stop + 1
        if m[0][1] == "/":
            builder.end(tag)
        else:
            builder.start(tag, html[m.end() : stop])
            if tag in RAW or tag in ESCAPABLE:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                (builder.text if tag in ESCAPABLE else builder.raw_text)(html[at : close.start() if close else size])
                builder.end(tag)
                at = close.end() if close else size
        done = at
    builder.text(html[done:])
    return builder.root


def visible(node: Node) -> bool:
    """Whether an element is rendered, its `visibility` apart."""
    a = node.attributes
    if node.tag in UNSEEN or (node.tag == "dialog" and "open" not in a):
        return False
    if not a:
        return True
    return not ("hidden" in a or a.get("aria-hidden", "").lower() == "true" or (node.tag == "input" and a.get("type", "").lower() == "hidden") or ("style" in a and _HIDING.search(a["style"])))


def _number(node: Node, name: str, otherwise: int) -> int:
    text = node.attributes.get(name, "").strip()
    return int(text) if _NUMBER.fullmatch(text) else otherwise


class _Page:
    """Lines being written. A pending break is kept until text comes, so breaks never add up."""

    def __init__(self, depth: int = 0) -> None:
        self.depth = depth  # pages around this one: list items, definitions, tables and cells are pages of their own
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = True  # the line so far ends with a space or is empty
        self.gap = 0

    def inline(self, data: str) -> None:
        data = _BLANKS.sub(" ", data)
        if self.blank:
            data = data.lstrip(" ")
        if data:
            self._settle()
            self.line.append(data)
            self.blank = data.endswith(" ")

    def preformatted(self, data: str) -> None:
        first, *rest = data.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self._settle()
            self.line.append(first)
            self.blank = False
        for part in rest:
            self._settle()
            self.newline()
            self.line.append(part)
            self.blank = False

    def _settle(self) -> None:
        if self.gap:
            if self.lines:
                self.lines.extend([""] * (self.gap - 1))
            self.gap = 0

    def newline(self) -> None:
        self.lines.append("".join(self.line).rstrip())
        self.line.clear()
        self.blank = True

    def block(self, gap: int) -> None:
        """The end of a block: what follows starts a line, after gap - 1 blank lines."""
        if self.line:
            self.newline()
        if self.lines:
            self.gap = max(self.gap, gap)

    def put(self, lines: list[str], gap: int) -> None:
        self.block(gap)
        if lines:
            self._settle()
            self.lines.extend(lines)
            self.block(gap)

    def done(self) -> list[str]:
        if self.line:
            self.newline()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines


def _span(node: Node, name: str) -> int:
    n = _number(node, name, 1)
    return min(n, 1000) if n > 0 else 1


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Table rows of (lines, columns, rows spanned) cells as lines, columns padded to equal width and set apart by ` | `.

    A cell that spans rows keeps its columns free in the rows below. Lines over WIDEST are written whole
    but widen no column, so that one long cell doesn't pad all others.
    """
    placed: list[list[tuple[int, int, list[str]]]] = []
    widths: list[int] = []
    below: dict[int, int] = {}  # columns taken by cells of rows above, and for how many rows more
    for row in rows:
        at, cells, taken = 0, [], dict(below)
        for lines, span, deep in row:
            while taken.get(at):
                cells.append((at, 1, []))
                at += 1
            widths.extend([0] * (at + span - len(widths)))
            if span == 1:
                widths[at] = max([widths[at], *(n for n in map(len, lines) if n <= WIDEST)])
            cells.append((at, span, lines))
            if deep > 1:
                below.update((c, max(deep, below.get(c, 0))) for c in range(at, at + span))
            at += span
        placed.append(cells)
        below = {c: n - 1 for c, n in below.items() if n > 1}
    out = []
    for cells in placed:
        for k in range(max([1, *(len(lines) for _, _, lines in cells)])):
            parts = []
            for at, span, lines in cells:
                room = sum(widths[at : at + span]) + 3 * (span - 1)
                parts.append((lines[k] if k < len(lines) else "").ljust(min(room, 2 * WIDEST)))
            out.append(" | ".join(parts).rstrip())
    return out


def render(root: Node) -> str:
    """The visible text of a tree."""
    page, tables, lists, pre, muted = _Page(), [], [], 0, False
    # work items: a node or text to write, a function that ends an element, or the visibility to go back to
    work: list = [root]
    while work:
        item = work.pop()
        if isinstance(item, str):
            if not muted:
                page.preformatted(item) if pre else page.inline(item)
            continue
        if isinstance(item, bool):
            muted = item
            continue
        if not isinstance(item, Node):
            page, pre = item(page, pre)
            continue
        node, tag = item, item.tag
        if tag != "#root" and not visible(node):
            continue
        if "style" in node.attributes and (said := _VISIBILITY.findall(node.attributes["style"])) and said[-1].lower() in ("visible", "hidden", "collapse"):
            # `visibility` is inherited, and a descendant may turn it back
            work.append(muted)
            muted = said[-1].lower() != "visible"
        if tag == "br":
            page._settle()
            page.newline()
            continue
        if tag in VOID:
            if tag == "hr":
                page.block(2)
            continue
        nested = page.depth < DEEPEST
        if tag == "table" and nested:
            tables.append([])
            outer, page, kept, pre = page, _Page(page.depth + 1), pre, 0

            def end(inner: _Page, _: int, outer=outer, kept=kept) -> tuple[_Page, int]:
                rows = tables.pop()
                outer.put(inner.done(), 2)
                outer.put(aligned(rows), 2)
                outer.block(2)
                return outer, kept

            work.append(end)
        elif tag == "tr" and tables and nested:
            tables[-1].append([])
        elif tag in ("td", "th") and tables and nested:
            if not tables[-1]:
                tables[-1].append([])
            row, outer, page, kept, pre = tables[-1][-1], page, _Page(page.depth + 1), pre, 0

            def end(inner: _Page, _: int, outer=outer, kept=kept, row=row, span=_span(node, "colspan"), deep=_span(node, "rowspan")) -> tuple[_Page, int]:
                row.append((inner.done(), span, deep))
                return outer, kept

            work.append(end)
        elif tag == "li" and nested:
            kind = lists[-1] if lists else None
            if kind and kind[0] == "ol":
                kind[1] = _number(node, "value", kind[1] + 1)
                mark = f"{kind[1]}. "
            else:
                mark = "- "
            outer, page, kept, pre = page, _Page(page.depth + 1), pre, 0

            def end(inner: _Page, _: int, outer=outer, kept=kept, mark=mark) -> tuple[_Page, int]:
                lines = inner.done()
                outer.put([(mark if k == 0 else " " * len(mark) if x else "") + x for k, x in enumerate(lines)], 1)
                return outer, kept

            work.append(end)
        elif tag in ("ul", "ol", "menu", "dir"):
            page.block(1 if lists else 2)
            lists.append(["ol" if tag == "ol" else "ul", _number(node, "start", 1) - 1])

            def end(inner: _Page, kept: int, gap=2 if len(lists) == 1 else 1) -> tuple[_Page, int]:
                lists.pop()
                inner.block(gap)
                return inner, kept

            work.append(end)
        elif tag == "dd" and nested:
            outer, page, kept, pre = page, _Page(page.depth + 1), pre, 0

            def end(inner: _Page, _: int, outer=outer, kept=kept) -> tuple[_Page, int]:
                outer.put(["    " + x if x else "" for x in inner.done()], 1)
                return outer, kept

            work.append(end)
        elif tag == "pre":
            page.block(2)
            pre += 1

            def end(inner: _Page, kept: int) -> tuple[_Page, int]:
                inner.block(2)
                return inner, kept - 1

            work.append(end)
        elif tag in BLOCKS:
            gap = 2 if tag in SPACED else 1
            page.block(gap)

            def end(inner: _Page, kept: int, gap=gap) -> tuple[_Page, int]:
                inner.block(gap)
                return inner, kept

            work.append(end)
        work.extend(reversed(node.children))
    return "\n".join(page.done())


def page_text(html: str | None) -> str:
    """The visible text of a page; empty for null."""
    return render(parse(html)) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per input row: id, columns of `keep`, text.

    Null or empty html: empty text. Broken markup renders as far as it can be read. Null and
    repeated ids: kept as they are. Empty table: empty result. Other columns don't matter.
    """
    picked = pages.select(id_col, *keep, F.col(html_col).alias("_html"))
    n = 1 + len(keep)
    names = [f.name for f in picked.schema.fields[:n]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:n]) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [page_text(x.as_py()) for x in part.column(n)]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(n)], pa.array(texts, pa.string())], [*names, "text"])

    return picked.mapInArrow(fresh(run), schema)
