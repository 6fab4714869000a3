"""Layout-aware text of HTML pages.

A tree builder puts tags into a tree, closing what HTML lets authors leave open (paragraphs, list items,
table cells and rows, options) and ignoring end tags without a start. The renderer leaves out what a
reader doesn't see and lays out the rest: blocks on lines of their own with an empty line between
paragraphs, list items with bullets or numbers and indents, tables with aligned columns, preformatted
text as it stands, and white space elsewhere as one blank.

Elements may be nested to any depth; builder and renderer keep stacks of their own. What ``visibility``
hides comes back in children that it shows. A cell over several rows keeps its column free in the rows
below, up to the end of its group of rows. Style sheets are not read, only ``style`` attributes: a class
that a sheet hides stays visible.

Defined cases: null or empty markup renders as the empty text; broken markup renders as far as it can
be read, and never fails; a quote that is never closed is a character of its tag, which ends at the next
``>``; rows are rendered one by one, so repeated rows repeat; an empty table gives no rows; a column that
has the result's name is replaced, others stay.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import shipped

#: Fixed values of HTML: the most columns and rows that a cell may span.
MOST_COLUMNS, MOST_ROWS = 1_000, 65_534
#: Layout only, no text is lost: the deepest indent, the widest column that others align with, and the nested
#: tables that are laid out in columns. Without these, blanks alone could outgrow memory.
MOST_INDENT, MOST_WIDTH, MOST_TABLES = 200, 200, 20

# Fixed values of HTML: kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object svg math audio video canvas datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset".split())
# A start tag closes these open elements, up to the nearest of the second set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
P_SCOPE = frozenset(["td", "th", "caption", "button", "table", "html", "body"])
END_SCOPE = frozenset(["table", "td", "th", "caption", "html"])
# End tags that also close elements outside the cell they stand in.
ACROSS = frozenset(["table", "tr", "tbody", "thead", "tfoot", "body", "html"])

TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:--!?>|\Z)|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
UNSEEN_STYLE = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        if not self.attrs:
            return {}
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(self.attrs)}


class Open:
    """The open elements, and at which depths those of each tag stand."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.depths: dict[str, list[int]] = defaultdict(list)

    def last(self, tags: frozenset[str]) -> int:
        """Depth of the innermost element of these tags, 0 if there is none."""
        return max((self.depths[tag][-1] for tag in tags if self.depths[tag]), default=0)

    def push(self, node: Node) -> None:
        self.depths[node.tag].append(len(self.stack))
        self.stack.append(node)

    def cut(self, depth: int) -> None:
        """Closes the element at this depth and all inside it."""
        while len(self.stack) > depth:
            self.depths[self.stack.pop().tag].pop()

    def close_up_to(self, tags: frozenset[str], scope: frozenset[str]) -> None:
        """Closes the outermost element of ``tags`` inside the innermost one of ``scope``."""
        limit = self.last(scope)
        inside = []
        for tag in tags:
            depths = self.depths[tag]
            k = bisect_right(depths, limit)
            inside += depths[k : k + 1]
        if inside:
            self.cut(min(inside))


def tree(markup: str) -> Node:
    """Children are nodes and texts."""
    root = Node("html")
    opened = Open(root)
    stack, one = opened.stack, frozenset
    ends: dict[str, re.Pattern] = {}
    at, size = 0, len(markup)
    while at < size:
        found = TOKEN.search(markup, at)
        text = markup[at : found.start() if found else size]
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)
        if not found:
            break
        at = max(found.end(), found.start() + 1)
        if not found["tag"]:
            continue
        tag = found["tag"].lower()
        if found["close"]:
            depth = opened.last(one([tag]))
            if tag == "br" or (tag == "p" and not depth):
                stack[-1].children.append(Node(tag))
            elif depth and (tag in ACROSS or opened.last(END_SCOPE) <= depth):
                opened.cut(depth)
            continue
        if tag == "html":
            continue
        if tag in CLOSES:
            opened.close_up_to(*CLOSES[tag])
        if tag in BLOCK and tag not in ("body", "option", "optgroup"):
            if opened.depths["head"]:
                opened.close_up_to(one(["head"]), one(["html"]))
            opened.close_up_to(one(["p"]), P_SCOPE)
        node = Node(tag, found["attrs"])
        stack[-1].children.append(node)
        if tag in VOID or (found["attrs"].endswith("/") and tag in ("svg", "math", "path")):
            continue
        if tag in RAW:
            if tag not in ends:
                ends[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I)
            end = ends[tag].search(markup, at)
            inner = markup[at : end.start() if end else size]
            node.children.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
            at = end.end() if end else size
            continue
        opened.push(node)
    return root


def seen(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    if not node.attrs:
        return True
    attributes = node.attributes()
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return False
    if node.tag == "input":
        return False
    if node.tag == "dialog" and "open" not in attributes:
        return False
    return not UNSEEN_STYLE.search(attributes.get("style", ""))


def muted(node: Node, outside: bool) -> bool:
    """Whether ``visibility`` hides what stands directly in the element; it is inherited."""
    found = VISIBILITY.findall(node.attributes().get("style", "")) if node.attrs else []
    return found[-1].lower() != "visible" if found else outside


def width(text: str) -> int:
    """Columns of a text: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines in the making: ``gap`` empty lines are due before the next one."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.blank = True
        self.indent = 0
        self.mark = ""
        self.muted = False
        self.tables = 0

    def put(self, text: str) -> None:
        """Inline text; white space is one blank."""
        if self.muted:
            return
        pieces = BLANKS.split(text)
        for i, piece in enumerate(pieces):
            if i and not self.blank:
                self.line.append(" ")
                self.blank = True
            if piece:
                self.line.append(piece)
                self.blank = False

    def end_line(self) -> None:
        text = "".join(self.line).rstrip(" ")
        self.line, self.blank = [], True
        if text:
            self.raw(text)

    def raw(self, text: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines.append((" " * (self.indent - len(self.mark)) + self.mark + text).rstrip(" "))
        self.mark = ""

    def space(self, lines: int) -> None:
        self.end_line()
        self.gap = max(self.gap, lines)


#: A step of the renderer: yields the steps inside it, and gets what they return.
Step = Generator["Step", object, object]


def _run(step: Step) -> object:
    """Runs a step and those inside it on a stack of its own, so that depth has no limit."""
    steps, value = [step], None
    while steps:
        try:
            inner = steps[-1].send(value)
        except StopIteration as done:
            steps.pop()
            value = done.value
        else:
            steps.append(inner)
            value = None
    return value


def rendered(markup: str | None) -> str:
    if not markup:
        return ""
    page = Page()
    _run(_children(tree(markup), page, 0))
    page.end_line()
    return "\n".join(page.lines)


def _children(node: Node, page: Page, depth: int) -> Step:
    outside = page.muted
    page.muted = muted(node, outside)
    for child in node.children:
        if isinstance(child, str):
            page.put(child)
        elif seen(child):
            yield _element(child, page, depth)
    page.muted = outside


def _element(node: Node, page: Page, depth: int) -> Step:
    tag = node.tag
    silent = muted(node, page.muted)
    if tag == "br":
        if page.line:
            page.end_line()
        elif not silent:
            page.gap = max(page.gap, 1)
    elif tag == "img":
        if not silent:
            page.put(node.attributes().get("alt", ""))
    elif tag == "hr":
        page.space(0)
        if not silent:
            page.raw("---")
    elif tag == "pre":
        page.space(1)
        parts: list[str] = []
        yield _plain(node, parts, page.muted)
        for line in "".join(parts).strip("\n").split("\n"):
            page.raw(line)
        page.space(1)
    elif tag == "table":
        page.space(1)
        if page.tables < MOST_TABLES:
            for line in (yield _table(node, page)):
                page.raw(line)
        else:
            yield _children(node, page, depth)
        page.space(1)
    elif tag in ("ul", "ol", "menu", "dir"):
        yield _list(node, page, depth)
    elif tag in BLOCK:
        gap = 1 if tag in SPACED else 0
        page.space(gap)
        kept = page.indent
        if tag in ("blockquote", "dd"):
            page.indent = min(kept + 2, MOST_INDENT)
        yield _children(node, page, depth)
        page.space(gap)
        page.indent = kept
    elif tag in ("tr", "caption"):
        page.end_line()
        yield _children(node, page, depth)
        page.end_line()
    else:
        yield _children(node, page, depth)
        if tag in ("td", "th"):
            page.put(" ")


def _list(node: Node, page: Page, depth: int) -> Step:
    page.space(0 if depth else 1)
    kept, number, outside = page.indent, 1, page.muted
    page.muted = muted(node, outside)
    if node.tag == "ol":
        start = node.attributes().get("start", "1").strip()
        number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, str):
            page.put(child)
        elif child.tag == "li" and seen(child):
            page.end_line()
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            page.mark, page.indent = "" if muted(child, page.muted) else mark, max(len(mark), min(kept + len(mark), MOST_INDENT))
            yield _children(child, page, depth + 1)
            page.end_line()
            page.mark, page.indent = "", kept
        elif seen(child):
            yield _element(child, page, depth)
    page.muted = outside
    page.space(0 if depth else 1)


def _plain(node: Node, parts: list[str], outside: bool) -> Step:
    silent = muted(node, outside)
    for child in node.children:
        if isinstance(child, str):
            parts.append("" if silent else child)
        elif child.tag == "br":
            parts.append("\n")
        elif seen(child):
            yield _plain(child, parts, silent)


def _rows(node: Node, outside: bool) -> Iterator[tuple[Node, int, bool]]:
    """Rows and captions of a table, the group of each, and whether what is around it is hidden."""
    silent = muted(node, outside)
    for group, part in enumerate(node.children):
        if isinstance(part, str) or not seen(part):
            continue
        grouped = part.tag in ("thead", "tbody", "tfoot")
        within = muted(part, silent) if grouped else silent
        for child in part.children if grouped else [part]:
            if isinstance(child, str) or not seen(child) or child.tag in ("colgroup", "col"):
                continue
            if child.tag in ("tr", "caption"):
                yield child, group if grouped else -1, within
                continue
            alone = Node("tr" if child.tag in ("td", "th") else "caption")
            alone.children.append(child)
            yield alone, group if grouped else -1, within


def _cell(node: Node, outside: bool, tables: int) -> Step:
    page = Page()
    page.muted, page.tables = outside, tables
    yield _children(node, page, 0)
    page.end_line()
    return page.lines or [""]


def _span(node: Node, name: str, most: int) -> int:
    value = node.attributes().get(name, "1").strip() if node.attrs else "1"
    if not re.fullmatch(r"[0-9]{1,9}", value):
        return 1
    # No rows named means all that are left of the group.
    return min(int(value), most) or (most if name == "rowspan" else 1)


def _table(node: Node, page: Page) -> Step:
    """Columns start at the same place in every row; cells over several columns or rows take their room."""
    outside, tables = page.muted, page.tables + 1
    out = [] if muted(node, outside) else [BLANKS.sub(" ", c).strip() for c in node.children if isinstance(c, str) and c.strip()]
    # Captions are lists of lines, rows lists of (lines, first column, columns).
    grid: list[list[tuple[list[str], int, int]] | list[str]] = []
    held: list[tuple[int, int, int]] = []  # columns that cells of rows above hold: first, end, rows left
    last_group = None
    for row, group, around in _rows(node, outside):
        if row.tag == "caption":
            grid.append((yield _cell(row, around, tables)))
            continue
        if group != last_group:
            held, last_group = [], group
        silent, column, taken, below = muted(row, around), 0, 0, []
        cells: list[tuple[list[str], int, int]] = []
        for child in row.children:
            if isinstance(child, str):
                if silent or not child.strip():
                    continue
                lines, columns, rows = [BLANKS.sub(" ", child).strip()], 1, 1
            elif seen(child):
                lines = yield _cell(child, silent, tables)
                columns, rows = _span(child, "colspan", MOST_COLUMNS), _span(child, "rowspan", MOST_ROWS)
            else:
                continue
            while taken < len(held) and held[taken][0] <= column:
                column = max(column, held[taken][1])
                taken += 1
            cells.append((lines, column, columns))
            if rows > 1:
                below.append((column, column + columns, rows))
            column += columns
        held = sorted((first, end, rows - 1) for first, end, rows in held + below if rows > 1)
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for cell in cells:
            if not isinstance(cell, str):
                lines, column, columns = cell
                own = max(map(width, lines)) if columns == 1 else 0
                widths[column] = max(widths.get(column, 0), min(own, MOST_WIDTH))
    # Columns in which no cell begins have no room.
    starts = sorted(widths)
    edges = list(accumulate((widths[c] + 2 for c in starts), initial=0))
    for cells in grid:
        if not cells or isinstance(cells[0], str):
            out += [line for line in cells if line]
            continue
        for k in range(max(len(lines) for lines, _, _ in cells)):
            text, wide = [], 0
            for lines, column, _ in cells:
                if k < len(lines) and lines[k]:
                    room = max(2 if text else 0, edges[bisect_left(starts, column)] - wide)
                    text += [" " * room, lines[k]]
                    wide += room + width(lines[k])
            if text:
                out.append("".join(text).rstrip(" "))
    return out


def page_texts(df: DataFrame, markup: str = "html", result: str = "text") -> DataFrame:
    """The rows with the rendered text instead of the markup; a column with the result's name is replaced."""
    kept = df.drop(result) if result != markup else df
    schema = kept.select(*[c for c in kept.columns if c != markup], F.col(markup).cast("string").alias(result)).schema
    place = kept.columns.index(markup)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([rendered(value.as_py()) for value in batch.column(place)], pa.string())
            columns = [c for i, c in enumerate(batch.columns) if i != place]
            yield pa.RecordBatch.from_arrays([*columns, texts], names=schema.names)

    return shipped(kept).mapInArrow(run, schema)
