"""Visible text of web pages: a tree builder with implied tags, visibility rules, and a layout of blocks, lists and tables."""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

TAG = re.compile(r"</?([A-Za-z][^\s/>]*)")
#: The end of a tag or its next attribute. A quote counts only where a value begins, and only if it is closed.
ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|(=?[^\s/>=]+|=)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)|["']|(?=>)))?)""")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.IGNORECASE)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas svg math datalist select".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table ul".split())
SPACED = frozenset("article aside blockquote dl figure h1 h2 h3 h4 h5 h6 nav ol p pre section table ul".split())
#: A start tag closes the nearest open element of its first set, unless one of the second set stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
CLOSES_P = BLOCKS - {"html", "body", "dd", "dt", "li"}
SCOPE = frozenset({"table", "td", "th", "caption", "button", "html"})
#: Elements nested deeper are hung under the last allowed one, as browsers do.
DEPTH = 200
#: A table column is always padded up to this width; further only where that costs little.
WIDEST = 120


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


def attributes(source: str, at: int) -> tuple[dict, int]:
    """Attributes from ``at`` on, and where their tag ends; -1 if it never does. Of equal names the first counts."""
    found: dict = {}
    while m := ATTRIBUTE.match(source, at):
        at = m.end()
        if m[1]:
            return found, at
        found.setdefault(m[2].lower(), html.unescape(m[3] or m[4] or m[5] or ""))
    return found, -1


def tokens(source: str):
    """``(kind, text or tag, attributes, end)`` in one pass: text, start, end, and raw after a start tag of ``RAW``. What looks
    like a tag but never ends is text, and nothing after it can be a tag."""
    begin = at = 0
    while (low := source.find("<", at)) >= 0:
        tag = None
        if source.startswith("<!--", low):
            end = source.find("-->", low + 2)
            end = end + 3 if end >= 0 else len(source)
        elif source.startswith(("<!", "<?"), low):
            end = source.find(">", low) + 1
        elif tag := TAG.match(source, low):
            attrs, end = attributes(source, tag.end())
        else:
            at = low + 1
            continue
        if end <= 0:
            break
        yield "text", source[begin:low], None, low
        begin = at = end
        if tag:
            name = tag[1].lower()
            yield "end" if source[low + 1] == "/" else "start", name, attrs, end
            if name in RAW and source[low + 1] != "/":
                close = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(source, end)
                yield "raw", source[end : close.start() if close else len(source)], None, end
                begin = at = close.end() if close else len(source)
    yield "text", source[begin:], None, len(source)


def build_tree(source: str) -> Node:
    root = Node("html")
    stack = [root]
    raw = root

    def add_text(text):
        if text:
            stack[-1].kids.append(html.unescape(text))

    def close(tags, barrier):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in barrier:
                return

    for kind, text, attrs, at in tokens(source):
        if kind == "text":
            add_text(text)
            continue
        if kind == "raw":
            raw.kids.append(text if raw.tag in ("script", "style") else html.unescape(text))
            continue
        tag = text
        if kind == "end":
            if tag == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].kids.append(Node("p"))
            elif tag not in ("html", "body"):
                close({tag}, {"table"} if tag in ("p", "div", "li", "span") else set())
            continue
        if tag == "html":
            root.attrs.update(attrs)
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
            if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr")
                stack[-1].kids.append(row)
                stack.append(row)
        if stack[-1].tag == "head" and (tag in BLOCKS or tag in ("a", "b", "i", "span", "br", "img")):
            close({"head"}, set())
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in VOID or source[at - 2] == "/" and tag in ("svg", "path"):
            continue
        if tag in RAW:
            raw = node
        elif len(stack) < DEPTH:
            stack.append(node)
    return root


def is_visible(node: Node) -> bool:
    if node.tag in UNSEEN or "hidden" in node.attrs or (node.tag == "input" and node.attrs.get("type", "").lower() == "hidden"):
        return False
    return not HIDING.search(node.attrs.get("style", ""))


class Page:
    """Lines under construction. Runs of white space collapse to one blank, blocks start on lines of their own."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = self.blank = False

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.split("\n")
            self.parts.append(first)
            for line in rest:
                self.line()
                self.parts.append(line)
            return
        words = s.split()
        if not words:
            self.blank = self.blank or bool(s and self.parts)
            return
        if self.parts and (self.blank or s[0].isspace()) and not self.parts[-1].endswith(" "):
            self.parts.append(" ")
        self.parts.append(" ".join(words))
        self.blank = s[-1].isspace()

    def line(self) -> None:
        joined = "".join(self.parts).rstrip()
        if self.gap and joined and self.lines:
            self.lines.append("")
        if joined:
            self.gap = False
            self.lines.append(joined)
        elif self.parts and self.lines:
            self.lines.append("")
        self.parts, self.blank = [], False

    def block(self, spaced: bool) -> None:
        if self.parts:
            self.line()
        self.gap = self.gap or spaced

    def indented(self, lines: list[str], first: str, rest: str) -> None:
        for i, text in enumerate(lines or [""]):
            self.parts = [(first if i == 0 else rest) + text]
            self.line()


def _span(node: Node, name: str) -> int:
    """As written; 1 where it is no number, 0 for a cell that goes on to the table's last row."""
    value = node.attrs.get(name, "1").strip()
    if not (value.isascii() and value.isdigit()):
        return 1
    return int(value) if len(value) < 18 else 10**18


def _rows(node: Node):
    for kid in node.kids:
        if isinstance(kid, Node) and is_visible(kid):
            if kid.tag == "tr":
                yield kid
            elif kid.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(kid)


def render_table(node: Node, page: Page) -> None:
    for kid in node.kids:
        if (isinstance(kid, Node) and is_visible(kid) and kid.tag not in ("tr", "thead", "tbody", "tfoot", "colgroup", "col")) or (isinstance(kid, str) and kid.strip()):
            own = Page()
            render([kid], own)
            own.block(False)
            page.indented(own.lines, "", "")
    grid: list[list[tuple[int, list[str]]]] = []
    held: list[tuple[int, int, float]] = []
    for number, row in enumerate(_rows(node)):
        # Columns that cells of earlier rows still hold: (first, behind the last, row in which they are free again).
        held = [h for h in held if h[2] > number]
        cells, taken, at, passed = [], [], 0, 0
        for cell in row.kids:
            if isinstance(cell, Node) and not is_visible(cell) or isinstance(cell, str) and not cell.strip():
                continue
            while passed < len(held) and held[passed][0] <= at:
                at, passed = max(at, held[passed][1]), passed + 1
            own = Page()
            render(cell.kids if isinstance(cell, Node) and cell.tag in ("td", "th") else [cell], own)
            own.block(False)
            across, down = (max(1, _span(cell, "colspan")), _span(cell, "rowspan")) if isinstance(cell, Node) else (1, 1)
            cells.append((at, own.lines))
            if down != 1:
                free = number + down if down else math.inf
                if taken and taken[-1][1:] == (at, free):
                    taken[-1] = (taken[-1][0], at + across, free)
                else:
                    taken.append((at, at + across, free))
            at += across
        held = sorted(held + taken)
        grid.append(cells)
    _write_rows(grid, page)


def _widths(grid: list[list[tuple[int, list[str]]]], place: dict[int, int]) -> list[int]:
    """A column's width: its widest line, if that is at most ``WIDEST`` or the padding it asks for is no longer than the table's own text."""
    width, padded, sizes = [0] * len(place), [0] * len(place), [0] * len(place)
    for cells in grid:
        for i, (c, lines) in enumerate(cells):
            k = place[c]
            width[k] = max(width[k], max(map(len, lines), default=0))
            if i + 1 < len(cells):
                padded[k] += max(1, len(lines))
            sizes[k] += sum(map(len, lines))
    return [w if w <= WIDEST or w * padded[k] <= 2 * sum(sizes) else WIDEST for k, w in enumerate(width)]


def _write_rows(grid: list[list[tuple[int, list[str]]]], page: Page) -> None:
    """Cells by row, each with its column. Columns in which no cell begins take no room."""
    place = {c: k for k, c in enumerate(sorted({c for cells in grid for c, _ in cells}))}
    width = _widths(grid, place)
    left = [0]
    for w in width:
        left.append(left[-1] + w + 2)
    for cells in grid:
        rest, i = [(place[c], lines) for c, lines in cells], 0
        while rest := [c for c in rest if i < len(c[1])]:
            shown, behind = [], 0
            for k, lines in rest:
                shown += [" " * (left[k] - left[behind]), lines[i], " " * (width[k] - len(lines[i]) + 2)]
                behind = k + 1
            page.parts = ["".join(shown).rstrip()]
            page.line()
            i += 1


def render(kids: list, page: Page, pre: bool = False) -> None:
    for kid in kids:
        if isinstance(kid, str):
            page.text(kid, pre)
            continue
        if not is_visible(kid):
            continue
        tag = kid.tag
        if tag == "br":
            page.parts.append("")
            page.line()
            continue
        if tag == "img":
            page.text(kid.attrs.get("alt", ""), False)
            continue
        spaced, block = tag in SPACED, tag in BLOCKS
        if block:
            page.block(spaced)
        if tag == "table":
            render_table(kid, page)
        elif tag in ("ul", "ol", "menu", "dir"):
            number = int(kid.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", kid.attrs.get("start", "")) else 1
            for item in kid.kids:
                if isinstance(item, Node) and item.tag == "li":
                    if not is_visible(item):
                        continue
                    own = Page()
                    render(item.kids, own, pre)
                    own.block(False)
                    mark = f"{number}. " if tag == "ol" else "- "
                    number += 1
                    page.indented(own.lines, mark, " " * len(mark))
                else:
                    render([item], page, pre)
        elif tag in ("blockquote", "dd"):
            own = Page()
            render(kid.kids, own, pre)
            own.block(False)
            if own.lines:
                page.indented(own.lines, "  ", "  ")
        else:
            render(kid.kids, page, pre or tag in ("pre", "textarea"))
            if tag in ("td", "th"):
                page.text(" ", False)
        if block:
            page.block(spaced)
    return


def visible_text(source: str | None) -> str:
    """All visible text, blocks apart, list items marked, table cells aligned. Null and empty pages give an empty text."""
    if not source:
        return ""
    page = Page()
    render([build_tree(source)], page)
    page.block(False)
    return "\n".join(page.lines).strip("\n")


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(page_id, text)``, one row for each row of ``pages``."""
    prepare(pages.sparkSession)

    @F.pandas_udf("string")
    def seen(sources: pd.Series) -> pd.Series:
        return sources.map(visible_text)

    return pages.select(F.col(id_col).alias("page_id"), seen(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))
