"""HTML extraction by layout-aware rendering.

A tree builder with implied tags (an open paragraph, list item, cell or row ends where the next begins; table parts appear
where they are missing; void elements never open; unclosed elements end with their parents) gives a tree, and a renderer
emits all visible text of it: block elements stand on lines of their own with a blank line around paragraphs and headings,
list items have bullets or numbers and indent, table cells are aligned in columns (spanning columns and rows as they say, wide
characters as two), preformatted text keeps its white space. Scripts, styles, templates, closed dialogs, what a closed details
element folds, and elements hidden by attribute, inline style or a plain rule of the page's style sheets (element, class and id
selectors; rules with combinators, pseudo-classes or attribute selectors don't count, and !important makes no difference) are
left out; visibility is inherited and can be taken back, display can't. Text in drawings and formulas is text.

Nesting has no limit: tree and renderer keep their own stacks. Work and output are in proportion to the page: indents grow to
MAX_INDENT only, tables within a cell flow, and where padding would exceed a table's own text, its columns are cut to the
widest width that doesn't, wider cells running over.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Generator, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches

# Element names by role, as the HTML standard has them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style template head title meta link noscript iframe object video audio canvas datalist noembed noframes param source track desc metadata defs symbol clippath annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main menu nav option optgroup search section summary tr caption thead tbody tfoot td th".split())
#: Elements whose end tag, where they are styled, ends what stands open within them; that of other inline elements counts only
#: outside inner blocks.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
DRAWN = ("svg", "math")
#: What an opening tag ends, if it is open with nothing of `keeps` above it.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "table"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["tbody", "thead", "tfoot", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: Elements that end an open paragraph and those that shelter it.
ENDS_P = SPACED | frozenset("address article aside center details dialog dir div dd dt footer form header hgroup li main menu nav search section summary".split())
TABLE_PARTS = frozenset("table tr tbody thead tfoot td th colgroup".split())
LISTS = frozenset("ul ol menu dir".split())
SHELTERS_P = frozenset("table td th caption button object applet marquee".split())
NAME = re.compile(r"[A-Za-z][^\s/>]*+")
#: What follows the name up to the closing bracket; possessive, so that nothing is read twice.
REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
DISPLAY = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([a-zA-Z-]+)")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
SELECTOR = re.compile(r"([A-Za-z][A-Za-z0-9]*)?((?:[.#][\w-]+)*)")
SPACES = re.compile(r"[ \t\n\r\f]+")
LINES = re.compile(r"\n{3,}")


#: Indents of lists and quotations grow to this many columns, and no further in deeper ones.
MAX_INDENT = 40
#: Columns of padding that the tables of a page may have beyond their own size.
SPARE_PADDING = 4096
#: Largest spans, as the HTML standard has them.
MAX_COLUMNS, MAX_ROWS = 1000, 65534


class Node:
    """An element: its name, its children (elements or text) and what its attributes say about rendering.

    show has display and visibility as far as they are given; marks are the selector parts of its class and id.
    """

    __slots__ = ("children", "closed", "columns", "marks", "name", "rows", "show", "start", "value")

    def __init__(self, name: str) -> None:
        self.name, self.start, self.columns, self.rows, self.closed = name, 1, 1, 1, False
        self.value: int | None = None
        self.children: list[Node | str] = []
        self.show: dict[str, str] = {}
        self.marks: tuple[str, ...] = ()


class _Open:
    """The open elements, and for each name where in the stack its elements are."""

    def __init__(self, root: Node) -> None:
        self.stack, self.places = [root], {}
        self.blocks = [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        if node.name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, names: Iterable[str]) -> int:
        """The place of the innermost open element of these names; 0 if there is none."""
        return max((places[-1] for n in names if (places := self.places.get(n))), default=0)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop().name].pop()
        while self.blocks[-1] >= place > 0:
            self.blocks.pop()

    def close(self, names: frozenset[str], keeps: frozenset[str]) -> None:
        """End all elements of these names within the innermost of keeps."""
        barrier = self.last(keeps)
        while (place := self.last(names)) > barrier:
            self.cut(place)


def _number(value: str, low: int, high: int, other: int) -> int:
    return min(max(int(value), low), high) if value.lstrip("-").isdecimal() and len(value) < 10 else other


def _element(name: str, rest: str) -> Node:
    """A new element with its attributes (the first of a name counts)."""
    node, seen = Node(name), set()
    found = ATTRIBUTE.findall(rest) if rest and not rest.isspace() else []
    for key, *values in found:
        key, value = key.lower(), values[0] or values[1] or values[2]
        if key in seen:
            continue
        seen.add(key)
        if key == "style":
            node.show |= {k: v.lower() for k, v in DISPLAY.findall(value.lower())}
        elif key == "class":
            node.marks += tuple(f".{c}" for c in value.split())
        elif key == "id":
            node.marks += (f"#{value.strip()}",)
        elif key == "start":
            node.start = _number(value, -(10**9), 10**9, 1)
        elif key == "value" and name == "li":
            node.value = int(value) if re.fullmatch(r"-?[0-9]{1,9}", value) else None
        elif key == "colspan":
            node.columns = _number(value, 1, MAX_COLUMNS, 1)
        elif key == "rowspan":
            node.rows = _number(value, 0, MAX_ROWS, 1) or MAX_ROWS
    if "hidden" in seen or (name == "dialog" and "open" not in seen):
        node.show.setdefault("display", "none")
    node.closed = name == "details" and "open" not in seen
    return node


def sheet_rules(css: str) -> dict[tuple[str, frozenset[str]], dict[str, str]]:
    """display and visibility by (element or empty, class and id parts) of a style sheet's plain rules; blocks of at-rules are skipped."""
    css, rules, at = COMMENT.sub(" ", css), {}, 0
    while (opening := css.find("{", at)) >= 0:
        selectors = css[at:opening].rpartition(";")[2].strip()
        end = css.find("}", opening)
        if selectors.startswith("@"):
            depth, end = 1, opening + 1
            for brace in re.finditer("[{}]", css[opening + 1 :]):
                depth += 1 if brace.group() == "{" else -1
                end = opening + 1 + brace.start()
                if not depth:
                    break
            at = end + 1
            if depth:
                break
            continue
        if end < 0:
            break
        found = {k: v.lower() for k, v in DISPLAY.findall(css[opening + 1 : end].lower())}
        for selector in selectors.split(",") if found else ():
            plain = SELECTOR.fullmatch(selector.strip())
            if plain and plain.group():
                parts = frozenset(re.findall(r"[.#][\w-]+", plain.group(2)))
                rules.setdefault(((plain.group(1) or "").lower(), parts), {}).update(found)
        at = end + 1
    return rules


def _apply(rules: dict[tuple[str, frozenset[str]], dict[str, str]], root: Node) -> None:
    """Give every element what the rules that fit it say, unless its own style says otherwise; ids before classes before names."""
    by_part: dict[str, list] = {}
    for (name, parts), found in rules.items():
        weight = (sum(p[0] == "#" for p in parts), sum(p[0] == "." for p in parts), bool(name))
        by_part.setdefault(max(parts) if parts else name, []).append((weight, name, parts, found))
    todo = [root]
    while todo:
        node = todo.pop()
        todo += [c for c in node.children if isinstance(c, Node)]
        own = set(node.marks)
        fits = [(w, f) for key in (node.name, *own) for w, name, parts, f in by_part.get(key, ()) if name in ("", node.name) and parts <= own]
        if fits:
            styled: dict[str, str] = {}
            for _, found in sorted(fits, key=lambda x: x[0]):
                styled |= found
            node.show = styled | node.show


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("html")
    opened = _Open(root)
    stack, close = opened.stack, opened.close
    sheets: list[str] = []

    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0 or mark + 1 == size:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        ending = page[mark + 1] == "/"
        name_found = NAME.match(page, mark + 1 + ending)
        markup = name_found or page[mark + 1] in "!?/"
        if mark > at or not markup:
            stack[-1].children.append(html.unescape(page[at : mark if markup else mark + 1]))
        if not markup:
            at = mark + 1
            continue
        if not name_found:
            comment = page.startswith("<!--", mark)
            end = page.find("-->" if comment else ">", mark + 4 if comment else mark + 1)
            at = size if end < 0 else end + (3 if comment else 1)
            continue
        found = REST.match(page, name_found.end())
        if found:
            rest, at = found.group(1), found.end()
        else:
            end = page.find(">", name_found.end())
            rest, at = "", size if end < 0 else end + 1
            if end < 0:
                break
        name = name_found.group()
        name = name.lower()
        if ending:
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif name == "p" and not opened.last(("p",)):
                stack[-1].children.append(Node("p"))
            else:
                place = opened.last((name,))
                inner = name not in BLOCK and opened.blocks[-1] > place and not (name in FORMATTING and (stack[place].show or stack[place].marks))
                if place and not inner and (name in TABLE_PARTS or place >= opened.last(("table", "td", "th"))):
                    opened.cut(place)
            continue
        if name == "html":
            continue
        node = _element(name, rest)
        if name in ENDS_P:
            close(frozenset(["p"]), SHELTERS_P)
        if name in ENDS:
            close(*ENDS[name])
        if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            stack[-1].children.append(row)
            opened.push(row)
        if stack[-1].name == "head" and name not in UNSEEN and name not in ("base", "bgsound"):
            opened.cut(len(stack) - 1)
        stack[-1].children.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            inside = page[at : end.start() if end else size]
            node.children.append(html.unescape(inside) if name in ("textarea", "title") else inside)
            if name == "style":
                sheets.append(inside)
            at = end.end() if end else size
        elif name not in VOID and not (rest.endswith("/") and opened.last(DRAWN)):
            opened.push(node)
    rules: dict = {}
    for css in sheets:
        for key, found in sheet_rules(css).items():
            rules.setdefault(key, {}).update(found)
    if rules:
        _apply(rules, root)
    return root


class _Lines:
    """Text under construction: finished lines, the blank line owed before the next, an open line, indent and marks before it."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.open: list[str] = []
        self.gap = 0
        self.indent, self.base = "", ""
        self.marks: list[str] = []
        self.spare = SPARE_PADDING
        self.fresh = False

    def text(self, text: str) -> None:
        if text and text[0] == " " and (not self.open or self.open[-1][-1] in " \n"):
            text = text[1:]
        if text:
            self.open.append(text)

    def put(self, line: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        if line:
            line = (self.base + "".join(self.marks) if self.marks else self.indent) + line
            self.marks.clear()
        self.lines.append(line)

    def end(self, gap: int = 0) -> None:
        line = "".join(self.open).rstrip(" ")
        self.open = []
        if line:
            self.put(line)
        self.gap = max(self.gap, gap)

    def mark(self, mark: str) -> None:
        """The next line begins with a mark; the ones after it are indented by its length."""
        if not self.marks:
            self.base = self.indent
        self.marks.append(mark)
        self.deepen(len(mark))

    def deepen(self, columns: int) -> None:
        if len(self.indent) < MAX_INDENT:
            self.indent += " " * columns


_Steps = Generator["_Steps", None, None]


def _run(steps: _Steps) -> None:
    """Run generators that yield what they call, without the interpreter's stack."""
    stack = [steps]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def _gone(node: Node) -> bool:
    return node.name in UNSEEN or node.show.get("display") == "none"


def _seen(node: Node, seen: bool) -> bool:
    """Whether an element's own text is visible: its visibility, if given, or what it inherits."""
    value = node.show.get("visibility")
    return seen if value not in ("visible", "hidden", "collapse") else value == "visible"


def _width(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in text)


def _cell(node: Node, seen: bool, texts: list[str]) -> _Steps:
    """Append an element's visible text, on one line, to texts."""
    out = _Lines()
    yield _into(node, out, False, seen, True)
    out.end()
    texts.append(" ".join(" ".join(out.lines).split()))


def _table(table: Node, out: _Lines, seen: bool) -> _Steps:
    """Captions and strays, then the rows with their cells in columns."""
    rows, todo = [], [(c, seen) for c in reversed(table.children)]
    while todo:
        child, visible = todo.pop()
        if isinstance(child, str) or (child.name not in TABLE_PARTS and not _gone(child)):
            stray = Node("div")
            stray.children.append(child)
            yield _into(stray, out, False, visible, False)
            out.end()
        elif _gone(child):
            continue
        elif child.name == "tr":
            visible = _seen(child, visible)
            cells: list[tuple[str, int, int]] = []
            for cell in child.children:
                if isinstance(cell, Node) and not _gone(cell):
                    texts: list[str] = []
                    wrapped = cell
                    if cell.name not in ("td", "th"):
                        wrapped = Node("div")
                        wrapped.children.append(cell)
                    yield _cell(wrapped, _seen(cell, visible), texts)
                    cells.append((texts[0], cell.columns, cell.rows))
            rows.append(cells)
        else:
            todo += [(c, _seen(child, visible)) for c in reversed(child.children)]
    for line in _aligned(_grid(rows), out):
        out.put(line)


def _grid(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, int, str]]]:
    """(column, columns, text) of the cells with text, row by row; cells that span rows push later rows' cells aside."""
    placed, hanging = [], []
    for cells in rows:
        at, line, new, busy = 0, [], [], iter(hanging)
        taken = next(busy, None)
        for text, columns, down in cells:
            while taken is not None and at >= taken[0]:
                at = max(at, taken[1])
                taken = next(busy, None)
            if text:
                line.append((at, columns, text))
            if down > 1:
                new.append((at, at + columns, down))
            at += columns
        merged: list[tuple[int, int, int]] = []
        for start, end, left in sorted([*hanging, *new]):
            if left > 1 and merged and merged[-1][1] == start and merged[-1][2] == left - 1:
                merged[-1] = (merged[-1][0], end, left - 1)
            elif left > 1:
                merged.append((start, end, left - 1))
        hanging = merged
        placed.append(line)
    return [line for line in placed if line]


def _aligned(rows: list[list[tuple[int, int, str]]], out: _Lines) -> list[str]:
    """The lines of a table. Columns are as wide as their widest cell, or as the widest width that keeps padding in bounds."""
    widths: dict[int, int] = {}
    sizes = [[_width(text) for _, _, text in row] for row in rows]
    for row, own in zip(rows, sizes, strict=True):
        for (at, columns, _), width in zip(row, own, strict=True):
            if columns == 1:
                widths[at] = max(widths.get(at, 0), width)
            else:
                widths.setdefault(at, 0)
    columns = sorted(widths)
    allowed = sum(map(sum, sizes)) + 4 * sum(map(len, sizes))

    def gaps(limit: int) -> tuple[list[list[int]], int]:
        """The spaces before each cell, and how many of them are beyond two."""
        offsets, total, beyond, found = [0], 0, 0, []
        for c in columns:
            total += min(widths[c], limit) + 2
            offsets.append(total)
        for row, own in zip(rows, sizes, strict=True):
            at, spaces = 0, []
            for (column, _, _), width in zip(row, own, strict=True):
                pad = max(offsets[bisect_left(columns, column)] - at, 2 if at else 0)
                spaces.append(pad)
                beyond += max(0, pad - 2)
                at += pad + width
            found.append(spaces)
        return found, beyond

    low, high = -1, max(widths.values(), default=0)
    spaces, beyond = gaps(high)
    if beyond > allowed + out.spare:
        while high - low > 1:
            middle = (low + high) // 2
            if gaps(middle)[1] > allowed + out.spare:
                high = middle
            else:
                low = middle
        spaces, beyond = gaps(low) if low >= 0 else ([[2 * (k > 0) for k in range(len(row))] for row in rows], 0)
    out.spare -= max(0, beyond - allowed)
    return ["".join(" " * pad + text for pad, (_, _, text) in zip(own, row, strict=True)) for own, row in zip(spaces, rows, strict=True)]


def _into(node: Node, out: _Lines, pre: bool, seen: bool, flat: bool) -> _Steps:
    """Add an element's visible content to out; flat is within a table cell, where tables flow."""
    number, folded = node.start, node.closed
    for child in node.children:
        if isinstance(child, str):
            if not seen or folded:
                continue
            if not pre:
                out.text(SPACES.sub(" ", child))
                continue
            for k, line in enumerate(child.split("\n")):
                if k:
                    whole = "".join(out.open).rstrip()
                    out.open = []
                    if whole or not out.fresh:
                        out.put(whole)
                        out.fresh = False
                if line:
                    out.open.append(line)
            continue
        name = child.name
        if _gone(child) or (folded and name != "summary"):
            continue
        if folded:
            folded = None
        visible = _seen(child, seen)
        if name == "br":
            if out.open:
                out.end()
            elif out.lines:
                out.gap = max(out.gap, 1)
        elif name == "hr":
            out.end(1)
            if visible:
                out.put("---")
            out.gap = 1
        elif name == "table" and not flat:
            out.end(1)
            yield _table(child, out, visible)
            out.end(1)
        elif name in ("td", "th", "text"):
            out.text(" ")
            yield _into(child, out, pre, visible, flat)
            out.text(" ")
        elif name in LISTS:
            gap = 0 if node.name == "li" else 1
            out.end(gap)
            yield _into(child, out, pre, visible, flat)
            out.end(gap)
        elif name in ("li", "blockquote", "dd"):
            alone = name == "blockquote" or (name == "li" and node.name not in LISTS and node.name != "li")
            out.end(int(alone))
            indent, waiting = out.indent, len(out.marks)
            if name == "li":
                number = number if child.value is None else child.value
                out.mark(f"{number}. " if node.name == "ol" else "- ")
                number += 1
            else:
                if not out.marks:
                    out.deepen(2)
            yield _into(child, out, pre, visible, flat)
            out.end(int(alone))
            out.indent = indent
            del out.marks[waiting:]
        elif name == "pre":
            out.end(1)
            out.fresh = True
            yield _into(child, out, True, visible, flat)
            out.end(1)
        elif name in BLOCK:
            gap = 1 if name in SPACED else 0
            out.end(gap)
            yield _into(child, out, pre, visible, flat)
            out.end(gap)
        else:
            yield _into(child, out, pre, visible, flat)
        if folded is None:
            return


def text_of(page: str) -> str:
    """The visible text of a page."""
    out = _Lines()
    _run(_into(parse(page), out, False, True, False))
    out.end()
    return LINES.sub("\n\n", "\n".join(out.lines)).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row; null html gives null text, html without visible text an empty one; repeated rows repeat.

    A null page_id or url is kept. Other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if p is None else text_of(p) for p in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), run, "page_id long, url string, text string")
