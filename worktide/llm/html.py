"""HTML extraction by layout: all visible text, as a browser would set it.

A tree is built with the usual implied end tags (a new `p`, `li`, `td` ... closes the one
before). Elements that are never shown, or taken out by attribute or inline style, are left
out with all they hold; of closed `details` only the summary is shown. `visibility` is
inherited, so a visible child of a hidden parent shows. The rest is laid out: white space
collapses as in a browser, blocks start lines, paragraphs, headings, lists and tables stand
apart by an empty line, list items are marked and indented, and the cells of a table stand
in the grid that `rowspan` and `colspan` give, padded by the width of their characters.
Every option of a `select` is a line, text areas keep their lines, of drawings the `text`
elements are shown, and of formulas all but annotations.

Scale: a page is one row's work and no row moves. Nesting is walked with a stack of its
own, so that depth is bounded by memory alone.

Defined cases: null or empty pages give an empty text. Broken markup is closed at the end
of the page. Very long and deeply nested pages are laid out whole. Spans are read as HTML
has it: `colspan` ends at 1,000, `rowspan` at 65,534, and 0 reaches to the table's end.
Numbers that are none count as absent. Table rows without visible text take no line.
Repeated rows each come back.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktide.llm.frames import map_rows, named

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title meta link datalist iframe object audio video "
                   "canvas input map annotation annotation-xml".split())
UNDRAWN = frozenset("desc defs metadata symbol".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset".split())
BLOCK = APART | frozenset("html body div section article aside header footer nav main address li dt dd form "
                          "details summary figcaption caption legend center dialog tr".split())
CLOSED_BY = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "thead": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset({"html"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
}
LINED = BLOCK | {"option", "optgroup", "textarea"}
SPACED = frozenset("mfrac mtd mtr mroot".split())
SPACE = re.compile(r"[ \t\n\r\f]+")
WHOLE = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]+)")
WIDEST, TALLEST = 1_000, 65_534


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def style(self, name: str) -> str:
        """Value of an inline property; of several the last one counts, or the last important one."""
        value, rank = "", False
        for part in (self.attrs.get("style") or "").split(";"):
            of, _, given = part.partition(":")
            if of.strip().lower() == name:
                given, _, important = given.strip().lower().partition("!")
                if bool(important) >= rank:
                    value, rank = given.strip(), bool(important)
        return value

    def shown(self) -> bool:
        if self.tag in UNSEEN or "hidden" in self.attrs:
            return False
        if "style" in self.attrs and (self.style("display") == "none" or self.style("content-visibility") == "hidden"):
            return False
        return not (self.tag == "dialog" and "open" not in self.attrs)

    def visible(self, inherited: bool) -> bool:
        value = self.style("visibility") if "style" in self.attrs else ""
        return {"visible": True, "initial": True, "hidden": False, "collapse": False}.get(value, inherited)

    def whole(self, name: str) -> int | None:
        """Value of an attribute as HTML reads whole numbers; absurdly long ones end at a thousand million."""
        found = WHOLE.match(self.attrs.get(name) or "")
        if not found:
            return None
        sign, digits = (-1 if found[1][0] == "-" else 1), found[1].lstrip("+-0") or "0"
        return sign * (int(digits) if len(digits) < 10 else 10**9)

    def parts(self) -> list:
        """Children that can show: of closed details the first summary, and no first break of kept text."""
        if self.tag == "details" and "open" not in self.attrs:
            return [c for c in self.children if isinstance(c, Node) and c.tag == "summary"][:1]
        if self.tag in ("pre", "textarea") and self.children and isinstance(self.children[0], str):
            return [self.children[0].removeprefix("\n"), *self.children[1:]]
        if self.tag in ("mfrac", "mroot"):
            return [x for c in self.children for x in (c, " ")]
        return self.children


class Builder(HTMLParser):
    """Tree of a page; text is a str among the children."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.count = Counter()  # of the open tags, so that no stack is searched in vain

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSED_BY:
            self._close(*CLOSED_BY[tag])
        elif tag in BLOCK:
            # A block closes a paragraph, so none is open around another block.
            self._close(frozenset({"p"}), BLOCK - {"p"})
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def _cut(self, at: int) -> None:
        self.count.subtract(node.tag for node in self.open[at:])
        del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        if self.count[tag] <= 0:
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self._cut(at)
                return
            if self.open[at].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return  # an end tag without its start leaves the cell open

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def _close(self, closed: frozenset, within: frozenset) -> None:
        last = None
        if not any(self.count[tag] > 0 for tag in closed):
            return
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at].tag
            if tag in within:
                break
            if tag in closed:
                last = at
        if last is not None:
            self._cut(last)


class Flow:
    """Lines of one block of text, or of one table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.words: list[str] = []
        self.indent = ""
        self.mark = ""

    def text(self, data: str, keep: bool) -> None:
        if keep:
            first, *rest = data.split("\n")
            self.words.append(first)
            for line in rest:
                self.end(keep=True)
                self.words.append(line)
        elif data:
            self.words.append(SPACE.sub(" ", data))

    def end(self, keep: bool = False) -> None:
        line = "".join(self.words)
        if not keep:
            line = re.sub(" +", " ", line).strip(" ")
        self.words = []
        if line or keep:
            self.lines.append((self.indent + self.mark + line).rstrip() if not keep else self.indent + line)
            self.mark = " " * len(self.mark)

    def line(self) -> None:
        self.end(keep=False)

    def gap(self) -> None:
        self.line()
        if self.lines and self.lines[-1]:
            self.lines.append("")

    def done(self) -> str:
        self.line()
        return "\n".join(self.lines).strip("\n")


def render(root: Node) -> str:
    flows, tables = [Flow()], []
    lists: list[list] = []
    keep = 0
    # `seen` is inherited visibility; `drawn` is None outside drawings, and then whether text is drawn.
    stack: list[tuple] = [(root, True, True, None)]
    while stack:
        node, entering, seen, drawn = stack.pop()
        if isinstance(node, str):
            if seen and drawn is not False:
                flows[-1].text(node, keep > 0)
            continue
        tag = node.tag
        if entering:
            if not node.shown() or (drawn is not None and tag in UNDRAWN):
                continue
            seen = node.visible(seen)
            if tag == "svg":
                drawn = False
            elif drawn is not None:
                drawn = None if tag == "foreignobject" else drawn or tag == "text"
            if tag == "br":
                flows[-1].words or flows[-1].lines.append("")
                flows[-1].line()
                continue
            stack.append((node, False, seen, drawn))
            stack.extend((child, True, seen, drawn) for child in reversed(node.parts()))
            if tag == "table":
                flows[-1].gap()
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                flows.append(Flow())
            elif tag in ("ul", "ol"):
                flow = flows[-1]
                flow.line() if lists else flow.gap()
                start = node.whole("start")
                # Items of an inner list stand under the text of the item around it.
                inner = flow.indent + " " * len(flow.mark)
                lists.append([tag, 1 if start is None else start, inner, flow.indent, len(flow.mark)])
                flow.indent, flow.mark = inner, ""
            elif tag == "li":
                flow = flows[-1]
                flow.line()
                kind = lists[-1] if lists else ["ul", 1, flow.indent]
                value = node.whole("value")
                kind[1] = kind[1] if value is None else value
                flow.indent, flow.mark = kind[2], "- " if kind[0] == "ul" else f"{kind[1]}. "
                kind[1] += 1
            elif tag in APART:
                flows[-1].gap() if not flows[-1].mark.strip() else flows[-1].line()
            elif tag in LINED:
                flows[-1].line()
            elif tag in SPACED or (tag == "text" and drawn):
                flows[-1].text(" ", False)
            keep += tag in ("pre", "textarea")
            continue
        if tag in ("pre", "textarea"):
            keep -= 1
            flows[-1].words and flows[-1].end(keep=True)
        if tag in ("td", "th") and tables:
            cell = flows.pop().done()
            tables[-1] or tables[-1].append([])
            wide, tall = node.whole("colspan") or 1, node.whole("rowspan")
            tall = 1 if tall is None or tall < 0 else tall
            tables[-1][-1].append((cell, min(wide, WIDEST) if wide > 0 else 1, min(tall or TALLEST, TALLEST)))
        elif tag == "table" and tables:
            flows[-1].line()
            flows[-1].lines += [flows[-1].indent + x for x in aligned(tables.pop())]
            flows[-1].gap()
        elif tag in ("ul", "ol") and lists:
            flows[-1].line()
            *_, indent, mark = lists.pop()
            flows[-1].indent, flows[-1].mark = indent, " " * mark
            lists or flows[-1].gap()
        elif tag == "li":
            flows[-1].line()
            flows[-1].mark = ""
        elif tag in APART:
            flows[-1].gap()
        elif tag in LINED:
            flows[-1].line()
        elif tag in SPACED or (tag == "text" and drawn):
            flows[-1].text(" ", False)
    return flows[0].done()


def width(text: str) -> int:
    """Columns of a text: wide characters take two, marks on others none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def placed(rows: list[list[tuple[str, int, int]]]) -> list[tuple[dict[int, str], int]]:
    """Rows as ({column: text}, columns in use): a cell takes the first column free of those reaching down from above."""
    out: list[tuple[dict[int, str], int]] = []
    above: list[tuple[int, int, int]] = []  # (first column, column behind, row behind) in order of columns
    for number, row in enumerate(rows):
        above = [span for span in above if span[2] > number]
        at, next_span, cells, down = 0, 0, {}, []
        for cell, wide, tall in row:
            while next_span < len(above) and above[next_span][0] <= at:
                at = max(at, above[next_span][1])
                next_span += 1
            cells[at] = cell
            if tall > 1:
                down.append((at, at + wide, number + tall))
            at += wide
        out.append((cells, max([at, *[span[1] for span in above]])))
        above = sorted(above + down)
    return out


def aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table whose columns are padded; a cell of several lines takes as many.

    Columns in which no cell begins have no width of their own and are left out.
    """
    grid = [({at: cell.split("\n") for at, cell in row.items()}, end) for row, end in placed(rows)]
    widths: dict[int, int] = {}
    for row, _ in grid:
        for at, cell in row.items():
            widths[at] = max(widths.get(at, 0), *map(width, cell))
    columns = sorted(widths)
    lines = []
    for row, end in grid:
        if not any(part for cell in row.values() for part in cell):
            continue
        used = columns[: bisect_left(columns, end)]
        for number in range(max(map(len, row.values()))):
            texts = [row[at][number] if at in row and number < len(row[at]) else "" for at in used]
            lines.append(" | ".join(t + " " * (widths[at] - width(t)) for t, at in zip(texts, used, strict=True)).rstrip())
    return lines


def visible_text(html: str | None) -> str:
    if not html:
        return ""
    builder = Builder()
    builder.feed(html)
    builder.close()
    return render(builder.root)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) for each input row."""
    rows = named(pages, row=id_col, html=html_col)
    kind = dict(rows.dtypes)["row"]

    def run(batches):
        for batch in batches:
            yield {"row": batch["row"], "text": [visible_text(h) for h in batch["html"]]}

    return map_rows(rows, run, f"row {kind}, text string").select(F.col("row").alias(id_col), "text")
