"""Layout-aware rendering of HTML to text.

A tree builder reads the markup with the implied tags of HTML: a new list item, paragraph, cell or row ends the one that
is open, cells open rows, block elements end paragraphs, stray end tags are ignored. What stands in a table but in no cell
or caption goes before the table, and a table begun there ends the one around it. The renderer walks the tree and
emits all visible text: blocks on lines of their own, paragraphs and headings set off by an empty line, list items with
markers and indentation, preformatted text as it is, and tables with their cells padded to common column widths.

Not visible: head, scripts, styles, templates, elements with ``hidden``, ``display: none``, ``visibility: hidden`` or
hidden inputs, closed dialogs and comments. Null and empty pages give an empty text. Both walks are loops, so depth of
nesting is no limit. A very wide table takes time by its cells. A cell of more than 200 characters does not widen its
column, and no padding is wider than 200 blanks, in tables of any size. Repeated rows each get a result; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of the HTML standard by their part in parsing and layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
UNSEEN = frozenset(
    "area audio base canvas col colgroup datalist embed head iframe link math meta noembed noframes noscript object "
    "param script source style svg template title track video".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul xmp".split())
BLOCK = SPACED | frozenset(
    "address article aside body caption center dd details dialog dir div dt fieldset figcaption footer form header "
    "hgroup hr html legend li main menu nav optgroup option search section summary".split()
)
LISTS = frozenset("ul ol menu dir".split())
CELLS = frozenset(("td", "th"))
ROW_GROUPS = frozenset("thead tbody tfoot".split())
#: Elements that hold only the parts of a table, and these parts.
TABLE_FRAME = ROW_GROUPS | {"table", "tr"}
TABLE_PARTS = ROW_GROUPS | CELLS | {"caption", "col", "colgroup", "tr"}
#: For an opening tag: the open elements that it ends, and the ones that keep it from looking further up.
ENDS: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset(("li",)), LISTS),
    **{x: (frozenset(("dt", "dd")), frozenset(("dl",))) for x in ("dt", "dd")},
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    **{x: (CELLS, frozenset(("tr", "table"))) for x in CELLS},
    "tr": (CELLS | {"tr"}, ROW_GROUPS | {"table"}),
    **{x: (CELLS | {"tr", "caption", "colgroup"} | ROW_GROUPS, frozenset(("table",))) for x in ROW_GROUPS},
}
ENDS_PARAGRAPH = BLOCK - {"body", "caption", "html", "legend", "optgroup", "option"}
PARAGRAPH = frozenset(("p",))
PARAGRAPH_WALL = frozenset("button caption html object table td template th".split())

#: Widest column that cells are padded to, and widest padding before or behind a cell.
WIDEST = 200

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<end>>?)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
CONCEALED = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.IGNORECASE)
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def attributes_of(rest: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), unescape(next((x for x in values if x), "")))
    return found


def tree(html: str) -> Node:
    """The element tree; text children are strings with entities resolved."""
    root = Node("#root")
    open_nodes = [root]
    counts: dict[str, int] = {}

    def put(child: Node | str) -> None:
        """Into the innermost open element, or before the table that has no place for it."""
        part = child.tag in TABLE_PARTS if isinstance(child, Node) else not child.strip(" \t\n\r\f")
        if open_nodes[-1].tag == "colgroup" and not part:
            cut(len(open_nodes) - 1)
        if not part and open_nodes[-1].tag in TABLE_FRAME and counts.get("table"):
            depth = len(open_nodes) - 1
            while open_nodes[depth].tag != "table":
                depth -= 1
            # The open table is the last child of its parent.
            open_nodes[depth - 1].children.insert(-1, child)
        else:
            open_nodes[-1].children.append(child)

    def clear(tag: str) -> None:
        """Before a part of a table or a table: ends what stands in a table's frame without being a part of it."""
        for depth in range(len(open_nodes) - 1 if counts.get("table") else 0, 0, -1):
            if open_nodes[depth].tag in CELLS or open_nodes[depth].tag == "caption":
                break
            if open_nodes[depth].tag in TABLE_FRAME:
                if tag != "table":
                    cut(depth + 1)
                    break
                if open_nodes[depth].tag == "table":
                    cut(depth)
                    break

    def add(node: Node) -> None:
        put(node)
        open_nodes.append(node)
        counts[node.tag] = counts.get(node.tag, 0) + 1

    def cut(depth: int) -> None:
        for node in open_nodes[depth:]:
            counts[node.tag] -= 1
        del open_nodes[depth:]

    def close(names: frozenset, walls: frozenset) -> None:
        """Ends the named elements that are open below the nearest wall."""
        if not any(counts.get(name) for name in names):
            return
        depth = len(open_nodes) - 1
        found = 0
        while depth and open_nodes[depth].tag not in walls:
            if open_nodes[depth].tag in names:
                found = depth
                if len(names) == 1:
                    break
            depth -= 1
        if found:
            cut(found)

    at = 0
    while at < len(html):
        found = TOKEN.search(html, at)
        if not found:
            put(unescape(html[at:]))
            break
        if found.start() > at:
            put(unescape(html[at : found.start()]))
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if found["close"]:
            if tag == "p" and not counts.get("p"):
                put(Node("p"))
            elif tag == "br":
                put(Node("br"))
            elif counts.get(tag):
                for depth in range(len(open_nodes) - 1, 0, -1):
                    if open_nodes[depth].tag == tag:
                        cut(depth)
                        break
                    if open_nodes[depth].tag in CELLS and tag not in ("table", "tr", *ROW_GROUPS):
                        break
            continue
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in ENDS_PARAGRAPH:
            close(PARAGRAPH, PARAGRAPH_WALL)
        if tag in TABLE_PARTS or tag == "table":
            clear(tag)
        if tag in CELLS and open_nodes[-1].tag != "tr":
            add(Node("tr"))
        rest = found["rest"]
        node = Node(tag, attributes_of(rest) if rest.strip(" \t\r\n/") else None)
        if tag in VOID:
            put(node)
        elif tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
            text = html[at : stop.start()] if stop else html[at:]
            if tag in ("textarea", "xmp"):
                node.children.append(unescape(text) if tag == "textarea" else text)
            put(node)
            at = stop.end() if stop else len(html)
        elif rest.endswith("/") and tag in ("svg", "math", "path"):
            put(node)
        else:
            add(node)
    return root


def visible(node: Node) -> bool:
    given = node.attributes
    return not (
        node.tag in UNSEEN
        or given
        and (
            "hidden" in given
            or CONCEALED.search(given.get("style", ""))
            or node.tag == "input" and given.get("type", "").lower() == "hidden"
        )
        or node.tag == "dialog" and "open" not in given
    )


class Flow:
    """Text laid out in lines. Gaps between blocks collapse to the widest asked for."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line = ""
        self.space = False
        self.gap = 0
        self.marker = ""
        self.indents: list[str] = []

    def begin(self) -> None:
        if not self.line:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            indent = "".join(self.indents)
            self.line = indent[: len(indent) - len(self.marker)] + self.marker if self.marker else indent
            self.marker, self.gap, self.space = "", 0, False
            self.fresh = True

    def say(self, text: str) -> None:
        """Inline text; runs of white space are one space, none at a line's beginning or end."""
        words = SPACES.sub(" ", text)
        if not words.strip(" "):
            self.space = self.space or bool(words and self.line)
            return
        self.begin()
        if (self.space or words[0] == " ") and not self.fresh:
            self.line += " "
        self.line += words.strip(" ")
        self.space, self.fresh = words[-1] == " ", False

    def exact(self, text: str) -> None:
        """Preformatted text."""
        for k, part in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if k:
                self.end(keep=True)
            if part:
                self.begin()
                self.line += part
                self.fresh = False

    def end(self, gap: int = 0, keep: bool = False) -> None:
        """Ends the line; ``gap``: 1 for a new line, 2 for an empty one between. ``keep``: an empty line counts."""
        if self.line:
            self.lines.append(self.line.rstrip(" ") if not keep else self.line)
            self.line = ""
        elif keep:
            self.lines.append("")
        self.space = False
        self.gap = max(self.gap, gap)

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


class Table:
    """Cells by row, with the columns they span.

    A cell goes to the first free columns behind the cell before it; columns that a cell above spans are not free. A row
    costs its cells and the spans that reach into it, of at most 1000 rows each.
    """

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, str]]] = []
        self.above: list[tuple[int, int, int]] = []  # columns begin to stop, taken up to a row: by column
        self.added: list[tuple[int, int, int]] = []
        self.passed = self.next = 0
        self.caption = ""

    def row(self) -> None:
        self.rows.append([])
        if self.added or any(last < len(self.rows) for *_, last in self.above):
            self.above = sorted(x for x in self.above + self.added if x[2] >= len(self.rows))
            self.added = []
        self.passed = self.next = 0

    def cell(self, text: str, across: int, down: int) -> None:
        if not self.rows:
            self.row()
        at = self.next
        while self.passed < len(self.above) and self.above[self.passed][0] < at + across:
            at = max(at, self.above[self.passed][1])
            self.passed += 1
        self.next = at + across
        self.rows[-1].append((at, self.next, SPACES.sub(" ", text).strip()))
        if down > 1:
            self.added.append((at, self.next, len(self.rows) + down - 1))

    def lines(self) -> list[str]:
        """Cells padded to common column widths, two blanks apart.

        A cell longer than ``WIDEST`` does not widen its column, and no padding is wider than that: a cell's place depends on
        the columns before it alone, and the output is linear in the page.
        """
        widths: dict[int, int] = {}
        for row in self.rows:
            for at, stop, text in row:
                if stop == at + 1 and 0 < len(text) <= WIDEST:
                    widths[at] = max(widths.get(at, 0), len(text))
        columns = sorted(widths)
        sums = [0, *accumulate(widths[k] for k in columns)]
        place = lambda column: 2 * column + sums[bisect_left(columns, column)]
        out = []
        for row in self.rows:
            line, column = [], 0
            for at, stop, text in row:
                if text:
                    line.append(" " * min(place(at) - place(column), WIDEST))
                    line.append(text + " " * min(max(place(stop) - place(at) - 2 - len(text), 0), WIDEST) + "  ")
                    column = stop
            out.append("".join(line).rstrip())
        return [line for line in out if line]


def number(text: str | None, default: int, most: int = 1 << 30) -> int:
    found = re.match(r"\s*(-?\d{1,9})", text or "")
    return max(-most, min(int(found[1]), most)) if found else default


def render(html: str | None) -> str:
    """The visible text of a page."""
    flows, tables = [Flow()], []
    lists: list[list] = []
    exact = 0
    stack: list[tuple[Node | str, bool]] = [(tree(html or ""), False)]
    while stack:
        node, leaving = stack.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if exact:
                flow.exact(node)
            elif not tables or len(flows) > len(tables):
                flow.say(node)
            continue
        tag = node.tag
        if not leaving:
            if not visible(node):
                continue
            stack.append((node, True))
            stack.extend((child, False) for child in reversed(node.children))
            if tag == "br":
                flow.end(gap=0, keep=not flow.line and bool(flow.lines))
            elif tag == "table":
                flow.end(2)
                tables.append(Table())
            elif tag in CELLS or tag == "caption":
                if tables:
                    flows.append(Flow())
            elif tag == "tr":
                if tables:
                    tables[-1].row()
            elif tag in BLOCK:
                flow.end(2 if tag in SPACED and not (tag in LISTS and lists) else 1)
                if tag in LISTS:
                    step = -1 if "reversed" in node.attributes else 1
                    items = sum(isinstance(x, Node) and x.tag == "li" for x in node.children)
                    lists.append([tag, number(node.attributes.get("start"), items if step < 0 else 1), step])
                    flow.indents.append("")
                elif tag == "li":
                    kind = lists[-1] if lists else ["ul", 1, 1]
                    mark = "- "
                    if kind[0] == "ol":
                        kind[1] = number(node.attributes.get("value"), kind[1])
                        mark, kind[1] = f"{kind[1]}. ", kind[1] + kind[2]
                    flow.indents.append(" " * len(mark))
                    flow.marker = mark
                elif tag in ("dd", "blockquote"):
                    flow.indents.append("  ")
                elif tag in ("pre", "xmp"):
                    exact += 1
                elif tag == "hr":
                    flow.say("---")
                    flow.end(1)
            elif tag == "input" and node.attributes.get("type", "").lower() in ("button", "submit", "reset"):
                flow.say(node.attributes.get("value", ""))
            elif tag == "textarea":
                exact += 1
            continue
        if tag == "table":
            made = tables.pop()
            flow.end(2)
            for line in [*([made.caption] if made.caption else []), *made.lines()]:
                flow.begin()
                flow.line += line
                flow.end(1)
            flow.end(2)
        elif tag in CELLS or tag == "caption":
            if tables and len(flows) > 1:
                text = flows.pop().text()
                if tag == "caption":
                    tables[-1].caption = SPACES.sub(" ", text)
                else:
                    span = (number(node.attributes.get(x), 1, 1000) for x in ("colspan", "rowspan"))
                    tables[-1].cell(text, *(max(1, x) for x in span))
        elif tag in BLOCK:
            flow.end(2 if tag in SPACED and not (tag in LISTS and len(lists) > 1) else 1)
            if tag in LISTS and lists:
                lists.pop()
                flow.indents.pop()
            elif tag in ("li", "dd", "blockquote") and flow.indents:
                if flow.marker:
                    flow.begin()
                    flow.end(1)
                flow.indents.pop()
            elif tag in ("pre", "xmp"):
                exact -= 1
        elif tag == "textarea":
            exact -= 1
    return flows[0].text()


def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [render(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])


def extracted(pages: DataFrame) -> DataFrame:
    """``(page_id, text)`` for every row of ``pages(page_id, html)``."""
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(text_rows, f"page_id {kind}, text string")
