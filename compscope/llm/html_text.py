"""Visible text of HTML pages with its layout: a small tree builder and a block renderer.

The builder turns tags into a tree, closing elements whose end tags may be left out and ignoring
end tags that match nothing. The renderer walks the tree without recursion: what a browser would
not show is skipped, white space collapses, blocks start on lines of their own with the vertical
spacing of their kind, lists get their markers and indentation, and table cells are aligned in
columns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, give_back

# Element kinds of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
UNSEEN = set(
    "area audio base canvas datalist embed head iframe link meta noembed noframes noscript object param "
    "rp script source style template title track video".split()
)
# Drawings show what stands in text elements, but nothing of these; formulas hide their annotations.
UNDRAWN = set("title desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient".split())
UNSET = {"annotation", "annotation-xml", "mphantom"}
# The parts of these stand apart from each other.
APART = set("mfrac msub msup msubsup munder mover munderover mroot mtr mtable mmultiscripts".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table ul caption".split()
)
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure fieldset hr menu dir".split())
LISTS = {"ul", "ol", "menu", "dir"}
TABLE_PARTS = {"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup", "col"}
# An open element is closed by these start tags, unless a wall lies between.
CLOSED_BY = {
    "p": BLOCK - {"body", "html", "legend", "caption", "option", "optgroup", "summary"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "optgroup": {"optgroup"}, "td": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "tr": {"tr", "tbody", "thead", "tfoot"},
    "thead": {"tbody", "tfoot", "thead"}, "tbody": {"tbody", "tfoot", "thead"},
    "tfoot": {"tbody", "thead", "tfoot"}, "caption": TABLE_PARTS - {"caption"},
    "colgroup": TABLE_PARTS - {"col", "colgroup"}, "head": {"body"}, "rt": {"rt", "rp"}, "rp": {"rt", "rp"},
}
CLOSES: dict[str, list[str]] = {}
for _open, _starts in CLOSED_BY.items():
    for _start in _starts:
        CLOSES.setdefault(_start, []).append(_open)
WALLS = {"table", "button", "template", "object"}
HEAD_ONLY = {"meta", "link", "base", "title", "style", "script", "noscript", "template", "head", "html"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL,
)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|content-visibility\s*:\s*hidden)", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
UNQUOTED_SLASH = re.compile(r"=[^\s\"'=]*/\Z")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE) for t in RAW}
SPACES = re.compile(r"[ \t\n\r\f]+")
# Rules of the page's own style elements with plain selectors: a tag, a class, an id, or a tag with one.
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
SELECTOR = re.compile(r"[a-z][a-z0-9]*|(?:[a-z][a-z0-9]*)?[.#][\w-]+", re.I)
DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
BUTTONS = {"submit", "button", "reset"}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs = tag, attrs or {}
        self.children: list[Node | str] = []


class Open:
    """The stack of open elements, with their number by tag so that most searches are skipped."""

    def __init__(self, root: Node) -> None:
        self.stack, self.number = [root], Counter()

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.number[node.tag] += 1

    def cut(self, i: int) -> None:
        self.number.subtract(n.tag for n in self.stack[i:])
        del self.stack[i:]

    def imply_ends(self, name: str) -> None:
        """Close the open elements that the start tag ``name`` ends."""
        closes = [t for t in CLOSES.get(name, ()) if self.number[t] > 0]
        if not closes:
            return
        walls = WALLS | (set() if name in TABLE_PARTS else {"td", "th", "caption"})
        walls |= LISTS if name == "li" else {"dl"} if name in ("dt", "dd") else set()
        i = len(self.stack) - 1
        while i > 0:
            tag = self.stack[i].tag
            if tag in closes:
                self.cut(i)
            elif tag in walls:
                return
            i -= 1

    def close(self, name: str) -> None:
        """Handle an end tag; one that matches nothing within its table cell is ignored."""
        if self.number[name] <= 0:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag == name:
                self.cut(i)
                return
            if tag in ("table", "td", "th") and name not in TABLE_PARTS and name != "table":
                return


def build_tree(html: str) -> Node:
    """The element tree of a page. ``html``, ``head`` and ``body`` tags may be missing: content
    goes where it stands; their start tags never nest."""
    root = Node("html")
    opened = Open(root)
    stack = opened.stack
    at = 0
    while at < len(html):
        m = TOKEN.match(html, at)
        at = m.end()
        name = m.group("name")
        if name is None:
            text = m.group("text")
            if text is not None:
                if stack[-1].tag == "head" and text.strip():
                    opened.cut(len(stack) - 1)  # text ends an open head
                stack[-1].children.append(unescape(text) if "&" in text else text)
            elif m.group().startswith("<![CDATA["):
                stack[-1].children.append(m.group()[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m.group("end"):
            if name == "br" or (name == "p" and not opened.number["p"]):
                stack[-1].children.append(Node(name))
            else:
                opened.close(name)
            continue
        if name == "html" or (name == "body" and opened.number["body"]):
            continue
        if stack[-1].tag == "head" and name not in HEAD_ONLY:
            opened.cut(len(stack) - 1)  # the body has begun
        opened.imply_ends(name)
        rest = m.group("rest")
        attrs = {}
        if rest and not rest.isspace():
            for a in ATTR.finditer(rest):
                value = a.group(2) or a.group(3) or a.group(4) or ""
                attrs.setdefault(a.group(1).lower(), unescape(value) if "&" in value else value)
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW and not (rest.endswith("/") and opened.number["svg"] > 0):
            end = RAW_END[name].search(html, at)
            body = html[at : end.start()] if end else html[at:]
            node.children.append(unescape(body) if name in ("textarea", "title") else body)
            at = end.end() if end else len(html)
        elif not (
            rest.endswith("/") and (opened.number["svg"] > 0 or opened.number["math"] > 0 or name in ("svg", "math"))
            and not UNQUOTED_SLASH.search(rest)
        ):
            opened.push(node)
    return root


def page_rules(root: Node) -> dict[str, bool]:
    """Whether the page's own style rules hide what a plain selector names; the last rule counts. Rules
    inside others (of media queries) and other selectors are not applied."""
    rules: dict[str, bool] = {}
    waiting: list[Node] = [root]
    while waiting:
        node = waiting.pop()
        if node.tag == "style":
            css = COMMENT.sub("", "".join(c for c in node.children if isinstance(c, str)))
            parts, depth, names = re.split(r"([{}])", css), 0, ""
            for k, part in enumerate(parts):
                if part in ("{", "}"):
                    depth = max(0, depth + (1 if part == "{" else -1))
                elif depth == 0:
                    names = part
                elif depth == 1 and parts[k - 1] == "{" and parts[k + 1 : k + 2] != ["{"]:
                    found = DISPLAY.search(part)
                    for name in names.split(",") if found else ():
                        if SELECTOR.fullmatch(name.strip()):
                            tag = re.match(r"[A-Za-z0-9]*", name.strip()).group()
                            rules[tag.lower() + name.strip()[len(tag) :]] = found.group(1).lower() == "none"
        else:
            waiting += [c for c in reversed(node.children) if isinstance(c, Node)]
    return rules


def ruled_out(node: Node, rules: dict[str, bool]) -> bool:
    """Whether the most special of the page's rules for an element hides it."""
    marks = [f".{c}" for c in node.attrs.get("class", "").split()]
    if "id" in node.attrs:
        marks.append(f"#{node.attrs['id']}")
    out = rules.get(node.tag, False)
    for mark in marks:
        out = rules.get(node.tag + mark, rules.get(mark, out))
    return out


def hidden(node: Node, rules: dict[str, bool] | None = None) -> bool:
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or (node.tag == "dialog" and "open" not in a):
        return True
    if node.tag == "input" and a.get("type", "").lower() == "hidden":
        return True
    style = a.get("style")
    if style and HIDING.search(style):
        return True
    return bool(rules) and ruled_out(node, rules) and not (style and DISPLAY.search(style))


def visible(node: Node, inherited: bool) -> bool:
    """Whether the text of an element shows: what its parent passes on unless its style says more."""
    style = node.attrs.get("style")
    for m in VISIBILITY.finditer(style) if style else ():
        value = m.group(1).lower()
        if value in ("hidden", "collapse", "visible", "initial"):
            inherited = value in ("visible", "initial")
    return inherited


def mode_of(node: Node, mode: str) -> str | None:
    """What kind of content the children of ``node`` are, from the kind that it is itself: "" for
    a page, "svg" for a drawing, "text" in a drawing's text, "math" for a formula, "apart" for parts
    of a formula that do not run on. None where nothing of it shows."""
    tag = node.tag
    if tag == "svg" or tag == "math":
        return tag
    if mode in ("svg", "text"):
        if tag in UNDRAWN:
            return None
        return "" if tag == "foreignobject" else "text" if tag == "text" else mode
    if mode in ("math", "apart"):
        return None if tag in UNSET else "apart" if tag in APART else "math"
    return mode


class Lines:
    """Text lines under construction: collapsed white space, pending spacing and prefixes."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank = 0  # blank lines owed before the next text
        self.space = False
        self.indent = ""
        self.marker = ""

    def text(self, s: str, keep: bool) -> None:
        if keep:
            for k, line in enumerate(s.replace("\r\n", "\n").split("\n")):
                if k:
                    self.newline(True)
                if line:
                    self.put(line)
            return
        words = SPACES.sub(" ", s)
        if words == " " or not words:
            self.space |= bool(words) and bool(self.parts)
            return
        lead = words[0] == " " or self.space
        if lead and self.parts and not self.parts[-1].endswith(" "):
            self.put(" ")
        self.space = words[-1] == " "
        self.put(words.strip(" "))

    def put(self, s: str) -> None:
        if not self.parts:
            if self.lines:
                self.lines += [""] * self.blank
            self.blank = 0
            # The first line of an item has the marker, later ones are indented by its width.
            head = self.indent[: len(self.indent) - len(self.marker)] + self.marker
            self.marker = ""
            if head:
                self.parts.append(head)
        self.parts.append(s)

    def newline(self, forced: bool = False) -> None:
        if self.parts:
            self.lines.append("".join(self.parts).rstrip())
            self.parts = []
        elif forced:
            self.lines += [""] * (bool(self.lines))
        self.space = False

    def block(self, spaced: bool) -> None:
        self.newline()
        if spaced and not self.marker:
            self.blank = 1

    def put_block(self, block: list) -> None:
        """Lines of an inner table as they are, behind this place's indentation."""
        self.newline()
        if self.lines:
            self.lines += [""] * self.blank
        self.blank = 0
        head = self.indent[: len(self.indent) - len(self.marker)] + self.marker
        self.marker = ""
        self.lines.append(Block(head, self.indent, block))

    def rows(self) -> list:
        """The lines without empty ones at the ends; blocks of inner tables are not opened."""
        self.newline()
        first, last = 0, len(self.lines)
        while first < last and self.lines[first] == "":
            first += 1
        while last > first and self.lines[last - 1] == "":
            last -= 1
        return self.lines[first:last]


class Block:
    """Lines that stand together: the prefix of the first one, that of the others, and the lines, of
    which some may be blocks again. So an inner table is indented once, however deep it lies."""

    __slots__ = ("first", "rest", "lines")

    def __init__(self, first: str, rest: str, lines: list) -> None:
        self.first, self.rest, self.lines = first, rest, lines


def flat(lines: list) -> list[str]:
    """All lines with the prefixes of the blocks around them."""
    out: list[str] = []
    stack = [[iter(lines), "", ""]]  # what is left, the prefix of the next line, and of those after it
    while stack:
        top = stack[-1]
        line = next(top[0], None)
        if line is None:
            stack.pop()
        elif isinstance(line, Block):
            stack.append([iter(line.lines), top[1] + line.first, top[2] + line.rest])
            top[1] = top[2]
        else:
            out.append((top[1] + line).rstrip() if line else "")
            top[1] = top[2]
    return out


def render(root: Node) -> str:
    """All visible text of a tree. Tables are rendered bottom up: an inner table is text in its
    cell by the time its row is laid out."""
    out = Lines()
    rules = page_rules(root)
    # A frame is an iterator over children and what to do when it ends.
    # A frame is followed by whether its text shows and by the kind of its content.
    stack: list[tuple[Iterator, object]] = [(iter(root.children), None)]
    states: list[tuple[bool, str]] = [(True, "")]
    pre = 0
    lists: list[list] = []
    tables: list[dict] = []
    while stack:
        children, finish = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            states.pop()
            if finish is not None:
                out, pre = finish(out, pre)
            continue
        seen, mode = states[-1]
        if isinstance(child, str):
            if seen and mode != "svg":
                out.text(child, pre > 0)
            continue
        tag = child.tag
        if hidden(child, rules):
            continue
        inner = mode_of(child, mode)
        if inner is None:
            continue
        seen, frames = visible(child, seen), len(stack)
        if mode == "apart" or (inner == "text" and mode == "svg"):
            out.text(" ", False)
        if tag == "br":
            if seen:
                out.newline(True)
        elif tag == "hr" and not seen:
            continue
        elif tag == "hr":
            out.block(True)
            out.put("-" * 3)
            out.block(True)
        elif tag == "wbr":
            continue
        elif tag == "input":
            label = child.attrs.get("value", "")
            if seen and label and child.attrs.get("type", "").lower() in BUTTONS:
                out.text(f" {label} ", False)
        elif tag == "table":
            tables.append({"rows": [], "caption": [], "outer": out})
            stack.append((iter(child.children), _end_table(tables)))
            out = Lines()  # what stands between cells comes before the table
        elif tag == "tr" and tables:
            tables[-1]["rows"].append([])
            stack.append((iter(child.children), None))
        elif tag in ("td", "th", "caption") and tables:
            stack.append((iter(child.children), _end_cell(tables[-1], child, out)))
            out = Lines()
        elif tag in BLOCK or tag == "textarea":
            spaced = tag in SPACED and not (tag in LISTS and lists)
            out.block(spaced)
            undo = (out.indent, len(lists))
            if tag in LISTS:
                start = child.attrs.get("start", "1")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                out.marker = "- "
                if lists and lists[-1][0]:
                    value = child.attrs.get("value", "")
                    number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else lists[-1][1]
                    lists[-1][1] = number + 1
                    out.marker = f"{number}. "
                out.indent += " " * len(out.marker)
            elif tag in ("blockquote", "dd"):
                out.indent += "    "
            label = child.attrs.get("label", "") if tag in ("option", "optgroup") else ""
            if label and seen:
                out.text(label, False)
                out.newline()
            if tag in ("pre", "textarea"):
                pre += 1
                if child.children and isinstance(child.children[0], str):
                    child.children[0] = child.children[0].removeprefix("\n")
            children = [] if label and tag == "option" else child.children
            if tag == "details" and "open" not in child.attrs:  # closed: the summary alone
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            stack.append((iter(children), _end_block(tag, spaced, undo, lists)))
        elif inner == "text" and mode == "svg":
            stack.append((iter(child.children), _apart))
        elif tag == "q" and seen:
            out.text('"', False)
            stack.append((iter(child.children), _quote))
        else:
            stack.append((iter(child.children), None))
        states += [(seen, inner)] * (len(stack) - frames)
    return "\n".join(flat(out.rows()))


def _apart(out: Lines, pre: int) -> tuple[Lines, int]:
    out.text(" ", False)
    return out, pre


def _quote(out: Lines, pre: int) -> tuple[Lines, int]:
    out.put('"')
    return out, pre


def _end_block(tag: str, spaced: bool, undo: tuple, lists: list):
    def finish(out: Lines, pre: int) -> tuple[Lines, int]:
        out.block(spaced)
        out.indent, out.marker = undo[0], ""
        del lists[undo[1] :]
        return out, pre - (tag in ("pre", "textarea"))

    return finish


def _span(node: Node, name: str, most: int) -> int:
    n = node.attrs.get(name, "1")
    return min(most, max(1, int(n))) if re.fullmatch(r"\d{1,6}", n) else 1


def _end_cell(table: dict, node: Node, outer: Lines):
    def finish(inner: Lines, pre: int) -> tuple[Lines, int]:
        lines = inner.rows()
        if node.tag == "caption":
            table["caption"] = lines
        else:
            if not table["rows"]:
                table["rows"].append([])
            table["rows"][-1].append(Cell(lines, _span(node, "colspan", 1_000), _span(node, "rowspan", 65_534)))
        return outer, pre

    return finish


def _end_table(tables: list[dict]):
    def finish(between: Lines, pre: int) -> tuple[Lines, int]:
        table = tables.pop()
        out: Lines = table["outer"]
        for part, spaced in ((between.rows(), True), (table["caption"], False), (lay_out(table["rows"]), True)):
            if part:
                out.block(spaced)
                out.put_block(part)
        out.block(True)
        return out, pre

    return finish


class Cell:
    """A table cell: its lines and how many columns and rows it takes."""

    __slots__ = ("lines", "wide", "high", "row", "col")

    def __init__(self, lines: list, wide: int = 1, high: int = 1) -> None:
        self.lines, self.wide, self.high = lines, wide, high
        self.row = self.col = 0


def grid(rows: list[list[Cell]]) -> int:
    """Give every cell its row and first column: the next column that no cell from above takes.
    Returns the number of columns."""
    taken: dict[int, int] = {}  # the first row in which a column is free again
    columns = 0
    for r, row in enumerate(rows):
        col = 0
        for cell in row:
            cell.high = min(cell.high, len(rows) - r)
            while taken.get(col, 0) > r:
                col += 1
            cell.row, cell.col = r, col
            for c in range(col, col + cell.wide):
                taken[c] = max(taken.get(c, 0), r + cell.high)
            col += cell.wide
            columns = max(columns, col)
    return columns


def align(rows: list[list[tuple[str, int]]]) -> str:
    """Rows of (text, columns spanned) as text, see ``lay_out``."""
    return "\n".join(flat(lay_out([[Cell(text.split("\n") if text else [], span) for text, span in row] for row in rows])))


def lay_out(rows: list[list[Cell]]) -> list:
    """The lines of a table. Columns are as wide as their widest cell, two blanks apart; what a cell over
    several columns lacks is spread over them evenly. A row is as high as its highest cell; what a
    cell over several rows lacks goes to its last row. Rows without text are left out."""
    columns = grid(rows)
    cells = [c for row in rows for c in row if c.lines]
    if columns <= 1 and all(c.high == 1 for c in cells):
        return [line for c in cells for line in c.lines]  # nothing to align: blocks stay closed
    for c in cells:
        c.lines = flat(c.lines)
    width, height = [0] * columns, [0] * len(rows)
    for c in sorted(cells, key=lambda c: c.wide):
        lack = max(map(len, c.lines)) - sum(width[c.col : c.col + c.wide]) - 2 * (c.wide - 1)
        for k in range(c.wide if lack > 0 else 0):
            width[c.col + k] += lack // c.wide + (k < lack % c.wide)
    for c in sorted(cells, key=lambda c: c.high):
        lack = len(c.lines) - sum(height[c.row : c.row + c.high])
        height[c.row + c.high - 1] += max(0, lack)
    place = [0]
    for w in width:
        place.append(place[-1] + w + 2)
    top = [0]
    for h in height:
        top.append(top[-1] + h)
    parts: list[list[tuple[int, str]]] = [[] for _ in range(top[-1])]
    for c in cells:
        for k, line in enumerate(c.lines):
            parts[top[c.row] + k].append((place[c.col], line))
    lines = []
    for found in parts:
        line = ""
        for at, text in sorted(found, key=lambda p: p[0]):
            line = line.ljust(at) + text
        lines.append(line.rstrip())
    return lines


def visible_text(html: str) -> str:
    return render(build_tree(html))


def extract_text(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Per row ``<key>, text, n_chars, n_lines``: all visible text of a page with its layout.

    Of drawings their text elements show, of formulas all but their annotations, and forms give their
    options, the labels of buttons and the content of text areas; of closed details the summary shows.
    What ``visibility`` hides may hold visible parts. Of the page's own styles the rules with plain
    selectors (tag, class, id) that set ``display`` are applied.
    A null page is empty: the empty text, 0 characters, 0 lines. Unfinished tags and comments end
    with the page. Rows are kept one to one, whatever their key; an empty table gives no rows;
    other columns are not read. One pass without a shuffle; nesting depth is not limited.
    """
    bounded_batches(df.sparkSession)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([visible_text(p) for p in pages], dtype=object)
        give_back()

    out = df.select(df[key], text_of(F.coalesce(df[html].cast("string"), F.lit(""))).alias("text"))
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return out.select(key, "text", F.length("text").cast("bigint").alias("n_chars"), lines.alias("n_lines"))
