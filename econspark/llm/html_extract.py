"""Layout-aware text of web pages.

A page becomes a stream of opened and closed elements, with end tags implied as browsers imply them (a new paragraph ends the old one,
a new cell the cell before, an outer end tag everything inside). The renderer follows that stream with a stack of text flows: blocks
stand on lines of their own, paragraphs and headings between blank lines, list items behind marks with hanging indents, table cells in
aligned columns. What a browser does not show (scripts, styles, hidden elements, comments, descriptions and definitions of drawings, annotations of formulas) is left out; everything else comes out once.
Nothing is recursive, so depth is no limit.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from ._shared import append_struct, send_by_value

send_by_value(__name__)

# Classes of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style head title template noscript iframe noembed noframes object audio video canvas datalist area param source track meta link base".split())
#: Not shown inside these; the rest of formulas and drawings is inline text.
UNSEEN_IN = {
    "svg": frozenset("title desc defs metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split()),
    "math": frozenset({"annotation", "annotation-xml"}),
}
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote figure table hr menu fieldset".split())
BLOCK = SPACED | frozenset("html body address article aside center details dialog dd div dt figcaption footer form header hgroup legend li main nav optgroup option search section select summary tr caption thead tbody tfoot td th".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends these open elements, looked for down to the listed limits.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: An end tag does not reach beyond these, unless it is their own or a table's part's.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
FOREIGN = frozenset({"svg", "math"})
#: Labels and matrix cells stand apart.
PARTED = frozenset({("svg", "text"), ("math", "mtd")})
BARRIER = frozenset("table td th caption html template".split())
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SLASH_IN_VALUE = re.compile(r"=\s*[^\s\"'=]+/\Z")
_BLANKS = re.compile(r"[ \t\n\f\r]+")


def attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, attributes), ("close", tag, "") and ("text", "", text), properly nested."""
    opened: list[str] = []
    foreign = 0

    def close_to(index: int) -> Iterator[tuple[str, str, str]]:
        nonlocal foreign
        while len(opened) > index:
            foreign -= opened[-1] in FOREIGN
            yield "close", opened.pop(), ""

    def text(value: str) -> Iterator[tuple[str, str, str]]:
        if opened and opened[-1] == "head" and value.strip(" \t\n\f\r"):
            yield from close_to(len(opened) - 1)
        yield "text", "", value

    def implied(tag: str) -> Iterator[tuple[str, str, str]]:
        if opened and opened[-1] == "head" and tag not in IN_HEAD:
            yield from close_to(len(opened) - 1)
        names, limits = IMPLIED.get(tag, ((), ()))
        if tag in ENDS_PARAGRAPH:
            yield from close_last({"p"}, BARRIER)
        if tag in HEADINGS and opened and opened[-1] in HEADINGS:
            yield from close_to(len(opened) - 1)
        if names:
            yield from close_last(names, limits)

    def close_last(names, limits) -> Iterator[tuple[str, str, str]]:
        at = None
        for i in range(len(opened) - 1, -1, -1):
            if opened[i] in names:
                at = i
            elif opened[i] in limits:
                break
            elif at is not None:
                break
        if at is not None:
            yield from close_to(at)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            yield from text(page[at:])
            break
        if m.start() > at:
            yield from text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                yield from text(m[0][9:-3])
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(opened) - 1, -1, -1):
                if opened[i] == tag or tag in HEADINGS and opened[i] in HEADINGS:
                    yield from close_to(i)
                    break
                if opened[i] in BARRIER and tag not in TABLE_PARTS:
                    break
            else:
                if tag == "p":  # an end tag alone is an empty paragraph
                    yield from (("open", "p", ""), ("close", "p", ""))
                elif tag == "br":
                    yield from (("open", "br", ""), ("close", "br", ""))
            continue
        yield from implied(tag)
        yield "open", tag, m[3]
        if tag in VOID or (foreign or tag in FOREIGN) and m[3].endswith("/") and not _SLASH_IN_VALUE.search(m[3]):
            yield "close", tag, ""
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if at < (end.start() if end else n):
                yield "text", "", page[at : end.start() if end else n]
            at = end.end() if end else n
            yield "close", tag, ""
        else:
            opened.append(tag)
            foreign += tag in FOREIGN
    yield from close_to(0)


class Flow:
    """Lines of text with block breaks, indents and collapsed blanks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line = ""
        self.blank_lines = 0
        self.indent = 0
        self.mark = ""
        self.pre = 0

    def text(self, text: str) -> None:
        if self.pre:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self.line += first
            for part in rest:
                self._end(True)
                self.line = part
            return
        text = _BLANKS.sub(" ", text)
        if not self.line or self.line.endswith(" "):
            text = text.removeprefix(" ")
        self.line += text

    def _end(self, even_empty: bool = False) -> None:
        line = self.line.rstrip(" ") if not self.pre else self.line.rstrip()
        if line or even_empty or self.mark and self.line:
            if self.blank_lines and self.lines and (line or self.mark):
                self.lines.append("")
            self.blank_lines = 0 if line else self.blank_lines
            self.lines.append((" " * max(0, self.indent - len(self.mark)) + self.mark + line).rstrip())
            self.mark = ""
        self.line = ""

    def new_line(self) -> None:
        """A forced break."""
        self._end(True)

    def block(self, spaced: bool) -> None:
        self._end()
        if spaced and self.lines:
            self.blank_lines = 1

    def put(self, lines: list[str]) -> None:
        """Finished lines as a block."""
        self._end()
        for line in lines:
            self.line = line
            held, self.pre = self.pre, 1
            self._end(True)
            self.pre = held

    def result(self) -> list[str]:
        self._end()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.caption: list[str] = []

    def render(self) -> list[str]:
        """Cells padded to their columns, two blanks between; a cell that spans columns is as wide as it needs. Where padding would
        outgrow the text by far, a column is as wide as its widest cell that keeps it within bounds, and wider cells overflow."""
        widths: dict[int, int] = {}
        whole = 0
        for row in self.rows:
            at = 0
            for span, lines in row:
                w = max(map(len, lines), default=0)
                whole += sum(map(len, lines)) + 2
                if span == 1:
                    widths[at] = max(widths.get(at, 0), w)
                at += span
        cells = sum(len(row) * max((len(lines) for _, lines in row), default=0) for row in self.rows)
        if max(widths.values(), default=0) * cells > 4 * whole + 10_000:
            widths = self._bounded(widths)
        out = list(self.caption)
        for row in self.rows:
            for i in range(max((len(lines) for _, lines in row), default=0)):
                parts, at = [], 0
                for span, lines in row:
                    cell = lines[i] if i < len(lines) else ""
                    room = sum(widths.get(at + k, 0) for k in range(span)) + 2 * (span - 1)
                    parts.append(cell.ljust(room))
                    at += span
                out.append("  ".join(parts).rstrip())
        return out


    def _bounded(self, widths: dict[int, int]) -> dict[int, int]:
        """Widths under which a column's padding is at most eight times its text and a share of 10 000."""
        own: dict[int, list[int]] = {at: [] for at in widths}
        text, padded = dict.fromkeys(widths, 0), dict.fromkeys(widths, 0)
        for row in self.rows:
            at, height = 0, max((len(lines) for _, lines in row), default=0)
            for span, lines in row:
                if span == 1:
                    own[at].append(max(map(len, lines), default=0))
                    text[at] += sum(map(len, lines)) + 2 * len(lines)
                for k in range(at, at + span):
                    if k in padded:
                        padded[k] += height
                at += span
        room = {at: (8 * text[at] + 10_000 // len(widths)) // max(1, padded[at]) for at in widths}
        return {at: max((w for w in own[at] if w <= room[at]), default=0) for at in widths}


def render(page: str) -> tuple[str, str]:
    """Title and visible text."""
    flows, tables, lists = [Flow()], [], []
    opened: list[tuple[str, bool]] = []
    unseen, title, in_title = 0, [], 0
    foreign: list[str] = []
    for kind, tag, value in events(page):
        flow = flows[-1]
        if kind == "text":
            if in_title:
                title.append(html.unescape(value))
            elif not unseen and not (tables and opened and opened[-1][0] in ("table", "tr", "thead", "tbody", "tfoot") and not value.strip()):
                flow.text(html.unescape(value))
            continue
        if kind == "open":
            given = attributes(value) if value.strip() else {}
            hides = tag in UNSEEN or bool(foreign) and tag in UNSEEN_IN[foreign[-1]] or "hidden" in given or tag == "dialog" and "open" not in given or bool(_HIDDEN_STYLE.search(given.get("style", ""))) or tag == "input" and given.get("type", "").lower() == "hidden"
            opened.append((tag, hides))
            unseen += hides
            if tag == "title" and unseen <= 2 and not title and "svg" not in foreign:
                in_title = 1
            if tag in FOREIGN:
                foreign.append(tag)
            if unseen:
                continue
            if foreign and (foreign[-1], tag) in PARTED:
                flow.text(" ")
            elif tag == "br":
                flow.new_line()
            elif tag == "img" and given.get("alt"):
                flow.text(given["alt"])
            elif tag == "input" and given.get("type", "text").lower() in ("submit", "button", "reset", "text") and given.get("value"):
                flow.text(f" {given['value']} ")
            elif tag == "table":
                flow.block(True)
                tables.append(Table())
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif tag in ("td", "th", "caption") and tables:
                span = given.get("colspan", "1")
                if tag != "caption" and not tables[-1].rows:
                    tables[-1].rows.append([])
                flows.append(Flow())
                lists.append(None)
                flows[-1].span = min(1000, int(span)) if span.isdigit() and span.isascii() and len(span) < 5 and int(span) else 1
            elif tag in BLOCK:
                flow.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and any(x is not None for x in lists[-1:])))
                if tag in ("ul", "ol", "menu"):
                    start = given.get("start", "1")
                    lists.append([tag == "ol", int(start) - 1 if re.fullmatch(r"-?\d{1,9}", start, re.A) else 0])
                    flow.indent += 3 if tag == "ol" else 2
                elif tag == "li":
                    own = lists[-1] if lists and lists[-1] is not None else None
                    if own:
                        own[1] += 1
                    flow.mark = f"{own[1]}. " if own and own[0] else "- "
                elif tag in ("dd", "blockquote"):
                    flow.indent += 2
                elif tag == "pre":
                    flow.pre += 1
            continue
        _, hid = opened.pop()
        unseen -= hid
        if tag == "title":
            in_title = 0
        if tag in FOREIGN:
            foreign.pop()
        if unseen or hid:
            continue
        if foreign and (foreign[-1], tag) in PARTED:
            flow.text(" ")
            continue
        if tag == "table" and tables:
            lines = tables.pop().render()
            flow.put(lines)
            flow.block(True)
        elif tag in ("td", "th", "caption") and tables and len(flows) > 1:
            lines, span = flows.pop().result(), flow.span
            while lists and lists.pop() is not None:
                pass
            if tag == "caption":
                tables[-1].caption += lines
            else:
                tables[-1].rows[-1].append((span, lines))
        elif tag in BLOCK:
            if tag == "pre":
                flow._end()
                flow.pre -= 1
            flow.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and len([x for x in lists if x is not None]) > 1))
            if tag in ("ul", "ol", "menu") and lists and lists[-1] is not None:
                flow.indent -= 3 if lists.pop()[0] else 2
            elif tag == "li":
                flow.mark = ""
            elif tag in ("dd", "blockquote"):
                flow.indent -= 2
    return _BLANKS.sub(" ", "".join(title)).strip(), "\n".join(flows[0].result())


def extract_text(pages: DataFrame, page: str = "html", into: str = "rendered") -> DataFrame:
    """``pages`` with a struct of ``title`` and ``text``. A null page gives nulls, an empty one empty strings; repeated rows are
    rendered alike; a column named ``into`` is replaced. One pass, no shuffle."""

    def judge() -> Callable:
        return lambda data: (None, None) if data is None else render(data.decode())

    return append_struct(pages, into, "title string, text string", judge, page)
