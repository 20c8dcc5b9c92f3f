"""Html as a tree of open elements: tags may be unclosed, nested wrongly or cut off, and every text keeps its place.

A plain helper for what runs inside tasks; it takes time in proportion to the html. Elements whose end tags may be left out are
closed as browsers do: a paragraph by the next block, list items, rows and cells by the next one of their own table or list.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from html import unescape
from html.entities import html5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup. References are decoded in title and textarea alone.
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
#: Elements that stand on lines of their own.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot"
    " th thead title tr ul".split()
)
#: What ends an open paragraph.
_ENDS_P = BLOCK - frozenset("body caption dd dt head html legend option tbody td tfoot th thead title tr".split()) | {"dd", "dt"}
#: Tags that end others by their start, what they end, and within what.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "caption", "colgroup"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)), "thead": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)), "a": (("a",), ("table", "td", "th")),
}
#: Elements across which nothing is closed by what stands inside.
_WALLS = ("td", "th", "caption", "table", "button", "object", "template")
_TABLE_PARTS = frozenset("tr tbody thead tfoot td th".split())
_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"  # a comment
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"  # a tag whose quotes are closed
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)>"  # and one whose quotes aren't
    r"|<[!?/][^>]*>",  # declarations and the like
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def closed_references(text: str) -> str:
    """The text with its references decoded that a semicolon ends; one that is cut off, as at a title's end, stays as it is written."""
    return _REFERENCE.sub(lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


class Node:
    """An element: its tag in lower case, its attributes as written, the element around it and what it holds (texts and elements)."""

    __slots__ = ("tag", "written", "parent", "parts")

    def __init__(self, tag: str, written: str = "", parent: Node | None = None):
        self.tag, self.written, self.parent, self.parts = tag, written, parent, []

    def attributes(self) -> dict[str, str]:
        """Names in lower case; of repeated ones the first counts."""
        out: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(self.written):
            out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        return out

    def walk(self) -> Iterator[tuple[Node | str, bool]]:
        """Every element when it is entered (True) and left (False), and every text (True), in page order."""
        stack: list = [(self, True)]
        while stack:
            part, entering = stack.pop()
            yield part, entering
            if entering and isinstance(part, Node):
                stack.append((part, False))
                stack.extend((x, True) for x in reversed(part.parts))

    def text(self, keep=lambda node: True) -> str:
        """Its text, with one space for white space and between blocks; elements that keep refuses are left out."""
        said, skipped = [], None
        for part, entering in self.walk():
            if skipped is not None:
                skipped = None if part is skipped and not entering else skipped
            elif isinstance(part, str):
                said.append(part)
            elif entering and part is not self and not keep(part):
                skipped = part
                said.append(" " if part.tag in BLOCK else "")
            elif part.tag in BLOCK or part.tag == "br":
                said.append(" ")
        return " ".join("".join(said).split())


class _Open:
    """The stack of open elements, with the depths at which each tag is open."""

    def __init__(self):
        self.stack = [Node("#page")]
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]

    def deepest(self, tags: tuple[str, ...]) -> int:
        found, depths = 0, self.depths
        for t in tags:
            open_there = depths.get(t)
            if open_there and open_there[-1] > found:
                found = open_there[-1]
        return found

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            gone = self.stack.pop()
            self.depths[gone.tag].pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()

    def start(self, tag: str) -> None:
        """Close what a start tag closes."""
        closes_p = tag in _ENDS_P and self.depths.get("p")
        if not closes_p and tag not in _ENDS:
            return
        wall = self.deepest(_WALLS)
        if closes_p and (p := self.deepest(("p",))) > wall:
            self.pop_to(p)
        if tag in _ENDS:
            closed, within = _ENDS[tag]
            own = max(self.deepest(within), 0 if tag in _TABLE_PARTS else wall, self.blocks[-1] if tag == "a" else 0)
            above = [d[i] for t in closed if (d := self.depths.get(t)) and (i := bisect_right(d, own)) < len(d)]
            if above:
                self.pop_to(min(above))
            elif tag == "tr" and (cells := self.deepest(("td", "th"))) > own:
                self.pop_to(cells)

    def end(self, tag: str) -> None:
        """Close the element of an end tag; one that isn't open, or only beyond a table or block that it can't close, is ignored."""
        at = self.deepest((tag,))
        if not at or tag not in BLOCK and self.blocks[-1] > at or tag not in _WALLS and tag not in _TABLE_PARTS and tag not in ("html", "body") and self.deepest(_WALLS) > at:
            return
        if tag in _TABLE_PARTS and self.deepest(("table",)) > at:
            return
        self.pop_to(at)


def parse(html: str | None, decode: Callable[[str], str] = unescape) -> Node:
    """The page as a tree under a root of its own; decode reads the references of its texts, by default as browsers do, who don't ask for a semicolon."""
    html = html or ""
    held = _Open()
    at, size = 0, html.rfind(">") + 1
    root = held.stack[0]

    def say(text: str) -> None:
        if text:
            held.stack[-1].parts.append(decode(text) if "&" in text else text)

    while m := _TAG.search(html, at, size):
        say(html[at : m.start()])
        at = m.end()
        closing, tag, written = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag == "br":
                held.stack[-1].parts.append(Node("br", "", held.stack[-1]))
            else:
                held.end(tag)
            continue
        held.start(tag)
        node = Node(tag, written, held.stack[-1])
        held.stack[-1].parts.append(node)
        if tag in RAW:
            over = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            inside = html[at : over.start() if over else len(html)]
            node.parts.append(decode(inside) if tag in ("title", "textarea") else inside)
            at = over.start() if over else len(html)
            if over:
                at = html.find(">", at) + 1 or len(html)
            if at >= size:
                break
        elif tag not in VOID:
            held.push(node)
    # behind the last tag there may be the start of another, which is none
    rest = html[at:]
    cut = re.search(r"<[A-Za-z/!?]", rest)
    say(rest[: cut.start()] if cut else rest)
    return root


#: Columns that one cell may span, as browsers have it.
MOST_COLUMNS = 1000
_SILENT = frozenset(("script", "style", "noscript", "template"))


def _cell_text(cell: Node) -> str:
    """A cell's own text; what stands in a table inside it belongs to that table."""
    return cell.text(lambda x: x.tag != "table" and x.tag not in _SILENT)


def _span(cell: Node, name: str) -> int:
    written = cell.attributes().get(name, "").strip() if cell.written else ""
    return (int(written) if len(written) < 9 else 10**9) if written.isascii() and written.isdigit() else 1


def _rows(table: Node) -> list[tuple[bool, list[Node]]]:
    """Cells of each row of a table, and whether the row stands in its head; rows of tables inside are theirs."""
    out: list[tuple[bool, list[Node]]] = []
    stack = [(x, False) for x in reversed(table.parts) if isinstance(x, Node)]
    while stack:
        node, head = stack.pop()
        if node.tag == "tr":
            out.append((head, [x for x in node.parts if isinstance(x, Node) and x.tag in ("td", "th")]))
        elif node.tag != "table":
            stack.extend((x, head or node.tag == "thead") for x in reversed(node.parts) if isinstance(x, Node))
    return out


def _grid(table: Node) -> tuple[list[list[str]], int]:
    """Texts by row and column, with a cell's text wherever it spans, and how many rows at the start are headers."""
    rows = _rows(table)
    grid: list[list[str]] = []
    open_cells: dict[int, tuple[str, int]] = {}  # by column: text, rows that it still spans
    headers, body = 0, False
    for i, (head, cells) in enumerate(rows):
        line: list[str] = []

        def carried(line: list[str] = line) -> None:
            while len(line) in open_cells:
                text, left = open_cells.pop(len(line))
                if left > 1:
                    open_cells[len(line)] = (text, left - 1)
                line.append(text)

        below: dict[int, tuple[str, int]] = {}
        for cell in cells:
            carried()
            text, down = _cell_text(cell), _span(cell, "rowspan") or len(rows) - i
            for _ in range(max(1, min(_span(cell, "colspan"), MOST_COLUMNS))):
                if min(down, len(rows) - i) > 1:
                    below[len(line)] = (text, min(down, len(rows) - i) - 1)
                line.append(text)
        carried()
        for column in sorted(open_cells):  # cells from above beyond the row's own
            text, left = open_cells.pop(column)
            line += [""] * (column - len(line)) + [text]
            if left > 1:
                below[column] = (text, left - 1)
        open_cells.update(below)
        heads = head or bool(cells) and all(c.tag == "th" for c in cells)
        body = body or not heads
        headers += not body
        grid.append(line)
    return grid, headers


def tables(root: Node) -> list[dict]:
    """index, header, rows of each table of a page in page order, those inside others too.

    Rows without any text go. The rows of a table's head, or rows of th cells at its start, are the header: a column's distinct texts from top to
    bottom. Without any, or where all of them are digits, the first other row is. Rows are as long as the header.
    """
    out = []
    for part, entering in root.walk():
        if not entering or not isinstance(part, Node) or part.tag != "table":
            continue
        grid, n = _grid(part)
        width = max(map(len, grid), default=0)
        grid = [r + [""] * (width - len(r)) for r in grid]
        header = [" ".join(dict.fromkeys(x for x in column if x)) for column in zip(*grid[:n], strict=True)] if n else []
        rows = [r for r in grid[n:] if any(r)]
        if rows and all(not h or h.isdigit() for h in header):
            header, rows = rows[0], rows[1:]
        out.append({"index": len(out), "header": header, "rows": rows})
    return out


def sections(root: Node, levels: tuple[str, ...] = ("h1", "h2", "h3", "h4", "h5")) -> list[dict]:
    """title and body of each heading of a page: the text that follows it up to the next, wherever in the tree that stands."""
    out: list[dict] = []
    said: list[str] = []
    title: Node | None = None
    silent: Node | None = None
    for part, entering in root.walk():
        if silent is not None:
            silent = None if part is silent and not entering else silent
        elif isinstance(part, str):
            said.append(part)
        elif part.tag in _SILENT:
            silent = part if entering else None
        elif part.tag in levels and title is None and entering:
            if out:
                out[-1]["body"] = " ".join("".join(said).split())
            said, title = [], part
        elif part is title:
            out.append({"title": " ".join("".join(said).split()), "body": ""})
            said, title = [], None
        elif part.tag in BLOCK or part.tag == "br":
            said.append(" ")
    if out:
        out[-1]["body"] = " ".join("".join(said).split())
    return out
