"""Layout-aware text of web pages.

A tree builder closes elements that HTML leaves open (paragraphs, list items, table parts, options) and drops what is not
shown; a renderer walks the tree and keeps block spacing, list markers with their nesting, preformatted text, and tables
whose cells are aligned in columns.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import columnar as c

#: Fixed values of HTML: elements without content, with raw content, never shown, and shown as blocks (with or without a margin).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas datalist".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset menu xmp".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary caption".split())
#: Never drawn inside of svg and math; elements there that stand apart from their neighbours.
NOT_DRAWN = frozenset("desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml mphantom".split())
APART = frozenset("text foreignobject mtr mtd".split())
GROUPS = frozenset("thead tbody tfoot".split())
#: Elements that leave a head open; all others, and words, end it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title script style template noscript noframes".split())
#: An opening tag closes the nearest open element of the second set, unless one of the third stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
}
#: Blocks that end an open paragraph; elements that an end tag does not reach across.
ENDS_P = BLOCK - {"body", "html", "option", "optgroup", "caption", "legend", "dt", "dd"} | {"dt", "dd"}
SCOPE = frozenset("table td th caption button body html".split())
FORMATTING = frozenset("a b i em strong u s small big font code tt nobr strike span abbr cite q sub sup mark label".split())

_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_QUOTED = re.compile(r"\([^()]*\)|\"[^\"]*\"|'[^']*'")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
#: Elements nested deeper than this lay out as part of the one above; what hides them still does.
_LAID_OUT = 512
_NOSCRIPT = re.compile(r"<(?:(/noscript)|/head|body)(?=[\s/>])", re.I)
#: Tables that would take more characters with their padding are not aligned; their text is whole.
_MOST_PADDED = 1 << 24
_SPACES = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    name: str
    attributes: str = ""
    children: list[Node | str] = field(default_factory=list)
    shown: bool = True
    apart: bool = False
    blank: bool = False

    def attribute(self, name: str) -> str | None:
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(next((x for x in m.group(2, 3, 4) if x is not None), ""))
        return None


def _seen(name: str, attributes: str, drawn: bool, blank: bool) -> tuple[bool, bool]:
    """Whether the element is rendered at all, and whether its own text is invisible, given that of the element around it."""
    if name in HIDDEN or drawn and name in NOT_DRAWN:
        return False, blank
    low = attributes.lower()
    if "hidden" not in low and "none" not in low and "collapse" not in low and "visib" not in low:
        return not (blank and name in VOID), blank
    node = Node(name, attributes)
    if node.attribute("hidden") is not None or (name == "input" and (node.attribute("type") or "").lower() == "hidden"):
        return False, blank
    style = {"display": node.attribute("display") or "", "visibility": node.attribute("visibility") or ""} if drawn else {}
    style |= {k.lower(): x.lower() for k, x in _STYLE.findall(_QUOTED.sub("", node.attribute("style") or ""))}
    if style.get("display") == "none":
        return False, blank
    blank = {"hidden": True, "collapse": True, "visible": False}.get(style.get("visibility", ""), blank)
    return not (blank and name in VOID), blank


class Tags:
    """Finds the tokens of a page one after another; looking for the ends of all its tags takes time in proportion to the page.

    Where a tag ends depends only on the next quote or > outside of quotes, so what was found from one of these places holds
    for every tag that comes to it, and the last place found holds for all tags before it.
    """

    _place, _stop = re.compile("[>\"']"), re.compile(r"[\s/>]")
    _simple = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]{0,20})(\s[^>\"']{0,100})?>")

    def __init__(self, source: str) -> None:
        self.source = source
        self.last = source.rfind(">") + 1  # no tag ends behind the last >
        self.known: dict[int, int] = {}
        self.ahead = {self._place: (0, -1), self._stop: (0, -1)}

    def _next(self, what: re.Pattern, at: int) -> int:
        low, high = self.ahead[what]
        if not low <= at <= high:
            m = what.search(self.source, at, self.last)
            high = m.start() if m else self.last
            self.ahead[what] = (at, high)
        return high

    def _end(self, at: int) -> int:
        """Behind the > of a tag whose attributes begin at ``at``, -1 if a quote stays open."""
        way, at = [], self._next(self._place, at)
        while (found := self.known.get(at)) is None:
            way.append(at)
            if at >= self.last:
                found = -1
                break
            if self.source[at] == ">":
                found = at + 1
                break
            close = self.source.find(self.source[at], at + 1, self.last)
            if close < 0:
                found = -1
                break
            m = self._place.search(self.source, close + 1, self.last)
            at = m.start() if m else self.last
        for x in way:
            self.known[x] = found
        return found

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start, end, slash, name and attributes of the next token from ``at``; no name for comments and declarations."""
        source, last = self.source, self.last
        while 0 <= (at := source.find("<", at, last)):
            if m := self._simple.match(source, at, last):  # most tags have no quotes
                return at, m.end(), m[1], m[2], m[3] or ""
            mark = source[at + 1 : at + 2]
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4, last)
                return at, end + 3 if end >= 0 else len(source), "", "", ""
            if mark in ("!", "?") and mark:
                return at, source.find(">", at, last) + 1, "", "", ""
            name = at + 2 if mark == "/" else at + 1
            letter = source[name : name + 1]
            if letter.isascii() and letter.isalpha():
                stop = self._next(self._stop, name + 1)
                end = self._end(stop)
                if end >= 0:
                    return at, end, source[at + 1 : name], source[name:stop], source[stop : end - 1]
            at += 1
        return None


def build_tree(source: str) -> Node:
    """Elements of a page under one root, with implied end tags (also of a head); unknown end tags are ignored."""
    root = Node("#root")
    open_ = [root]
    place: dict[str, list[int]] = defaultdict(list)  # where elements of a name are open, so that none is searched for
    tags, at = Tags(source), 0

    def down(node: Node) -> None:
        place[node.name].append(len(open_))
        open_.append(node)

    def cut(k: int) -> None:
        for node in open_[k:]:
            place[node.name].pop()
        del open_[k:]

    def end_head() -> None:
        """Closes a head, and a noscript in it, whose end tag is left out; what is deeper (a template) keeps its content."""
        if open_[-1].name == "head":
            cut(len(open_) - 1)
        elif open_[-1].name == "noscript" and open_[-2].name == "head":
            cut(len(open_) - 2)

    def text(part: str) -> None:
        if part:
            if open_[-1].name in ("head", "noscript") and not part.isspace():
                end_head()
            if not open_[-1].blank:
                open_[-1].children.append(html.unescape(part) if "&" in part else part)

    def close(names: set | frozenset, barrier: set | frozenset) -> None:
        top = lambda among: max((place[x][-1] for x in among if place.get(x)), default=0)
        k = top(names)
        if k and k >= top(barrier):
            cut(k)

    while token := tags.after(at):
        begin, end, slash, name, attributes = token
        text(source[at:begin])
        at = end
        if not name:
            continue
        name = name.lower()
        if slash:
            if name == "p" and not place["p"]:
                open_[-1].children.append(Node("p"))
            elif name == "br":
                open_[-1].children.append(Node("br"))
            else:
                close({name}, {"table"} if name not in ("table", "body", "html") and name not in CLOSES else set())
            continue
        if name not in IN_HEAD:
            end_head()
        if name in ENDS_P:
            close({"p"}, SCOPE)
        if name in CLOSES:
            close(*CLOSES[name])
        elif len(name) == 2 and name[0] == "h" and name[1].isdigit() and open_[-1].name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            cut(len(open_) - 1)
        closed = attributes.endswith("/")
        drawn = bool(place["svg"] or place["math"])
        if name in ("td", "th") and open_[-1].name in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr")
            open_[-1].children.append(row)
            down(row)
        shown, blank = _seen(name, attributes, drawn, open_[-1].blank)
        node = Node(name, attributes, shown=shown, apart=drawn and name in APART, blank=blank)
        if len(open_) <= _LAID_OUT:
            open_[-1].children.append(node)
        elif shown and name not in RAW and name not in VOID:
            node.children = open_[-1].children  # its text stands in the element above
        elif shown:
            open_[-1].children.append(node)
        if name in VOID or closed and (drawn or name not in BLOCK and name not in FORMATTING and name not in RAW and name not in CLOSES):
            continue
        if name == "form" and (open_[-1].name in GROUPS or open_[-1].name in ("table", "tr")):
            continue  # what follows belongs to the table
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
            body = source[at : stop.start() if stop else len(source)]
            if node.shown and not node.blank and body:
                node.children.append(html.unescape(body))
            at = stop.end() if stop else len(source)
            continue
        if name == "noscript" and open_[-1].name == "head" and (stop := _NOSCRIPT.search(source, at)) and stop[1]:
            at = stop.start()  # not shown where scripts run, whatever stands in it
            continue
        down(node)
    text(source[at:].partition("<!--")[0])
    return root


class Page:
    """Lines under construction. Spacing between blocks is the larger of what they ask for; blank lines never pile up."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.marker = ""
        self.indent = ""

    def word_space(self) -> None:
        self.space = bool(self.line)

    def add(self, text: str) -> None:
        if not self.line:
            if self.gap and self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.line.append(self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent)
            self.marker = ""
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(text)

    def inline(self, text: str) -> None:
        if text[0] in " \t\n\r\f":
            self.word_space()
        body = _SPACES.sub(" ", text).strip(" ")
        if body:
            self.add(body)
            if text[-1] in " \t\n\r\f":
                self.word_space()

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
            self.gap = 1
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end_line()
        if self.lines:
            self.gap = max(self.gap, 2 if spaced else 1)

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


def _fill(node: Node, page: Page, pre: bool, depth: int) -> None:
    ordinal = 0
    if node.name == "ol":
        start = node.attribute("start") or "1"
        ordinal = int(start) - 1 if re.fullmatch(r"-?\d{1,9}", start) else 0
    for child in node.children:
        if isinstance(child, str):
            if pre:
                for k, line in enumerate(child.split("\n")):
                    if k:
                        page.end_line() if page.line else page.lines.append("")
                        page.gap = 0
                    if line:
                        page.add(line)
            elif child:
                page.inline(child)
            continue
        if not child.shown:
            continue
        name = child.name
        if name == "br":
            if page.line:
                page.end_line()
            elif page.lines:
                page.gap = max(page.gap, 2)
        elif name == "table":
            page.block(True)
            _table(child, page, depth + 1)
            page.block(True)
        elif name == "li":
            page.block(False)
            value = child.attribute("value") or ""
            before, ordinal = page.indent, int(value) if re.fullmatch(r"-?\d{1,9}", value) else ordinal + 1
            mark = f"{ordinal}. " if node.name == "ol" else "- "
            page.indent, page.marker = before + " " * len(mark), mark
            _fill(child, page, pre, depth + 1)
            page.end_line()
            page.indent, page.marker = before, ""
        elif name in BLOCK:
            nested = name in ("ul", "ol", "menu", "dir") and page.indent
            page.block(name in SPACED and not nested)
            before = page.indent
            if name in ("blockquote", "dd"):
                page.indent += "  "
            _fill(child, page, pre or name in ("pre", "xmp"), depth + 1)
            page.indent = before
            page.block(name in SPACED and not nested)
        elif name in ("td", "th", "tr", "tbody", "thead", "tfoot"):
            page.block(False)
            _fill(child, page, pre, depth + 1)
            page.block(False)
        elif name in ("img", "input", "wbr", "hr"):
            page.word_space() if name != "wbr" else None
        else:
            if child.apart:
                page.word_space()
            _fill(child, page, pre or name == "textarea", depth + 1)
            if child.apart:
                page.word_space()


def _loose(node: Node) -> Iterator[Node | str]:
    """What is no row, also in row groups. A browser moves it out of the table, so that a hidden group does not hide it."""
    for child in node.children:
        if isinstance(child, Node) and (child.name in GROUPS or child.name == "colgroup"):
            yield from _loose(child)
        elif isinstance(child, str) or child.name != "tr":
            yield child


def _groups(node: Node) -> Iterator[list[Node]]:
    """Rows of each row group; rows next to each other directly in the table are a group."""
    own: list[Node] = []
    for child in node.children:
        if isinstance(child, Node) and child.name in GROUPS:
            yield own
            own = []
            if child.shown:
                yield [x for x in child.children if isinstance(x, Node) and x.shown and x.name == "tr"]
        elif isinstance(child, Node) and child.shown and child.name == "tr":
            own.append(child)
    yield own


def _span(cell: Node, name: str, other: int) -> int:
    span = (cell.attribute(name) or "").strip() if name in cell.attributes.lower() else ""
    return int(span) if re.fullmatch(r"[0-9]{1,9}", span) else other


def _table(node: Node, page: Page, depth: int) -> None:
    """Text that stands outside of rows comes first; cells of a column have equal width and columns are two spaces apart.

    A cell's text stands in the first of its rows; in the others its columns stay empty. Rows are aligned unless that takes
    more than 16 M characters.
    """
    _fill(Node("div", children=list(_loose(node))), page, False, depth)
    page.end_line()
    grid: list[list[tuple[list[str], int]]] = []
    for rows in _groups(node):
        held: dict[int, int] = {}  # column -> first row of the group in which it is free again
        for at_row, row in enumerate(rows):
            cells, at = [], 0
            stray = [x for x in row.children if isinstance(x, str) and x.strip() or isinstance(x, Node) and x.shown and x.name not in ("td", "th", "form")]
            for cell in ([Node("td", children=stray)] if stray else []) + [x for x in row.children if isinstance(x, Node) and x.shown and x.name in ("td", "th")]:
                inner = Page()
                _fill(cell, inner, False, depth)
                free = at
                while held.get(free, 0) > at_row:
                    free += 1
                if free > at:
                    cells.append(([""], free - at))
                span = min(_span(cell, "colspan", 1) or 1, 1000)
                end = min(at_row + (_span(cell, "rowspan", 1) or len(rows)), len(rows))
                if end > at_row + 1:
                    held |= {x: max(held.get(x, 0), end) for x in range(free, free + span)}
                cells.append((inner.text().split("\n"), span))
                at = free + span
            if any(any(lines) for lines, _ in cells):
                grid.append(cells)
    width: list[int] = []
    for cells in grid:
        at = 0
        for lines, span in cells:
            width += [0] * (at + span - len(width))
            if span == 1:
                width[at] = max(width[at], *map(len, lines))
            at += span
    if (sum(width) + 2 * len(width)) * len(grid) > _MOST_PADDED:
        grid, width = [[(lines, 1) for lines, _ in cells if any(lines)] for cells in grid], [0] * len(width)
    for cells in grid:
        for k in range(max(len(lines) for lines, _ in cells)):
            out, at = [], 0
            for lines, span in cells:
                room = sum(width[at : at + span]) + 2 * (span - 1)
                out.append((lines[k] if k < len(lines) else "").ljust(room))
                at += span
            line = "  ".join(out).rstrip(" ")
            if line:
                page.add(line)
                page.end_line()


def visible_text(source: str | None) -> str:
    """All text that a page shows, also in svg, math and outside of table rows; None and pages without visible text give the empty string.

    As where scripts run: no noscript. Not followed: style sheets, and what an svg only refers to (defs, symbols).
    """
    page = Page()
    _fill(build_tree(source or ""), page, False, 0)
    return page.text()


def html_text(pages: DataFrame, *, page_id: str = "page_id", source: str = "html") -> DataFrame:
    """page_id, text (never null), n_lines, for each row; nothing is shuffled."""
    schema = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.slices(batches, "_x"):
            text = [visible_text(x) for x in batch.column("_x").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(text, pa.string()), pa.array([x.count("\n") + 1 if x else 0 for x in text], pa.int64())], schema=schema)

    return pages.select(F.col(page_id).cast("bigint").alias("_id"), F.col(source).cast("string").alias("_x")).mapInArrow(run, "page_id long, text string, n_lines long")
