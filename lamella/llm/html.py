"""Layout-aware rendering of HTML to text.

A tokenizer and a tree builder with implied end tags make a tree of any input;
a renderer then emits all visible text: hidden elements are left out, blocks
stand on lines of their own with the spacing of their kind, list items are
marked and indented, preformatted text is kept, and table cells are aligned.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import partial
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen frame basefont bgsound command".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
UNSEEN = frozenset("script style head template noscript noembed noframes iframe audio video canvas datalist input link meta title param source track area map desc metadata defs symbol clippath mask annotation annotation-xml".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table text ul tr td th thead tbody tfoot caption colgroup".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset menu dir hr details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - frozenset("body html li dd dt td th tr thead tbody tfoot caption colgroup option optgroup legend summary figcaption".split())
#: An element's start tag ends open elements of these names, up to the nearest of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption", "colgroup"}, {"table"}),
    "a": ({"a"}, {"table", "td", "th", "div", "p", "li"}),
}
#: An end tag does not reach over these to an element further out.
SCOPE = frozenset("table td th caption html body ul ol dl".split())
HEAD_ONLY = frozenset("head title meta link base style script noscript template".split())
DEPTH = 256
#: Cells that would start further right follow the one before by two blanks, so that a page of many columns stays in proportion.
ALIGNED = 1_000

_token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</[^A-Za-z>][^>]*>|([^<]+|<)", re.S)
_attribute = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
_space = re.compile(r"[ \t\n\r\f​]+")
_hidden = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|content-visibility\s*:\s*hidden|opacity\s*:\s*0(?:\.0*)?(?=\s*(?:;|$|!))|font-size\s*:\s*0(?:px|em|rem|pt|%)?(?=\s*(?:;|$|!)))", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _attribute.finditer(raw):
        value = m[2] or ""
        if value[:1] in "\"'":
            value = value[1:-1]
        out.setdefault(m[1].lower(), unescape(value))
    return out


def parse(html: str) -> Node:
    """The tree of any string: end tags may be missing, stray or out of order."""
    root = Node("#root")
    stack = [root]
    at, n = 0, len(html)

    def close(names, stop) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return close(names, stop)
            if stack[i].tag in stop:
                return None
        return None

    while at < n:
        m = _token.match(html, at)
        at = m.end()
        if m[5] is not None or m[1] is not None:
            text = m[5] if m[5] is not None else m[1]
            if stack[-1].tag == "head" and text.strip():
                del stack[-1]
            stack[-1].children.append(unescape(text) if m[5] is not None else text)
            continue
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].children.append(Node("p"))
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag or (tag in HEADINGS and stack[i].tag in HEADINGS):
                        del stack[i:]
                        break
                    if stack[i].tag in SCOPE and tag not in SCOPE and tag not in BLOCKS:
                        break
                    if stack[i].tag == "table" and tag not in ("html", "body", "div", "section", "article", "main"):
                        break
            continue
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button", "li", "caption", "object"})
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            del stack[-1]
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            del stack[-1]
        attrs = m[4].strip()
        node = Node(tag, attributes(attrs) if attrs and attrs != "/" else None)
        stack[-1].children.append(node)
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            body = html[at : end.start()] if end else html[at:]
            if tag in ("textarea", "title", "xmp", "plaintext"):
                node.children.append(unescape(body) if tag in ("textarea", "title") else body)
            at = end.end() if end else n
            continue
        # Beyond DEPTH elements are closed at once and their text stays with the last that is open, but for hidden ones.
        if len(stack) < DEPTH or len(stack) > DEPTH or not visible(node):
            stack.append(node)
    return root


def visible(node: Node) -> bool:
    """False for elements that a browser does not show: by kind, attribute or inline style.

    A dialog is shown if it is open, and what is in an object if it has no data of its own.
    """
    if node.tag in UNSEEN:
        return False
    a = node.attrs
    if node.tag == "dialog" and "open" not in a or node.tag == "object" and "data" in a:
        return False
    if not a:
        return True
    if "hidden" in a:
        return False
    return not _hidden.search(a.get("style", ""))


def width(text: str) -> int:
    """Columns of a text in a fixed-width font."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Renderer:
    """Gathers lines; knows the open line, the blank lines due, and the indent."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False
        self.space = False
        self.indent = ""
        self.mark = ""

    def text(self, raw: str) -> None:
        words = _space.sub(" ", raw)
        if not words:
            return
        if words[0] == " ":
            self.space = True
            words = words[1:]
        if not words:
            return
        tail = words[-1] == " "
        if self.space and self.line:
            self.line.append(" ")
        self.line.append(words[:-1] if tail else words)
        self.space = tail

    def end_line(self, keep_empty: bool = False) -> None:
        text = "".join(self.line).strip(" ")
        self.line, self.space = [], False
        if text or keep_empty:
            self._emit(text)

    def _emit(self, text: str) -> None:
        if self.blank and self.lines and self.lines[-1] != "":
            self.lines.append("")
        self.blank = False
        head, self.mark = self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent, ""
        self.lines.append((head + text).rstrip())

    def verbatim(self, text: str) -> None:
        self.end_line()
        for line in text.strip("\n").expandtabs(8).split("\n"):
            self._emit(line)

    def indented(self, mark: str, of: Callable[[], None]) -> None:
        """What `of` emits, its first line behind the mark and behind those of outer items that wait for a line."""
        held = self.indent, self.mark
        self.indent, self.mark = held[0] + " " * len(mark), held[1] + mark if mark.strip() or held[1] else ""
        of()
        self.end_line()
        self.indent, self.mark = held[0], held[1] if self.mark else ""

    def gap(self) -> None:
        self.end_line()
        self.blank = True

    def result(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def render(node: Node) -> str:
    out = Renderer()
    _render(node, out, [])
    return out.result()


def _render(node: Node, out: Renderer, lists: list) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
            continue
        tag = child.tag
        if tag == "br":
            out.end_line(keep_empty=not out.line and bool(out.lines) and not out.blank)
            continue
        if tag == "img":
            if alt := child.attrs.get("alt", "").strip():
                if visible(child):
                    out.text(alt)
            continue
        if not visible(child):
            continue
        if tag == "hr":
            out.gap()
        elif tag in ("pre", "textarea", "xmp", "plaintext", "listing"):
            out.gap()
            out.verbatim(_plain(child))
            out.gap()
        elif tag == "table":
            out.gap()
            _table(child, out)
            out.gap()
        elif tag in ("ul", "ol", "menu", "dir"):
            (out.end_line if lists else out.gap)()
            start = child.attrs.get("start", "1")
            lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            _render(child, out, lists)
            lists.pop()
            (out.end_line if lists else out.gap)()
        elif tag == "li":
            out.end_line()
            kind = lists[-1] if lists else [False, 1]
            value = child.attrs.get("value", "")
            if kind[0] and re.fullmatch(r"-?\d{1,9}", value):
                kind[1] = int(value)
            mark = f"{kind[1]}. " if kind[0] else "- "
            kind[1] += 1
            out.indented(mark, partial(_render, child, out, lists))
        elif tag in ("dd", "blockquote"):
            (out.gap if tag == "blockquote" else out.end_line)()
            out.indented("  ", partial(_render, child, out, lists))
            if tag == "blockquote":
                out.gap()
        elif tag == "select":
            several = "multiple" in child.attrs or child.attrs.get("size", "1") not in ("", "0", "1")
            for label in _options(child, several):
                if several:
                    out.end_line()
                out.text(label)
        elif tag == "q":
            out.text("“")
            _render(child, out, lists)
            out.text("”")
        elif tag in SPACED:
            out.gap()
            _render(child, out, lists)
            out.gap()
        elif tag in BLOCKS:
            out.end_line()
            _render(child, out, lists)
            out.end_line()
        else:
            _render(child, out, lists)


def _options(select: Node, several: bool) -> list[str]:
    """Labels of a select's options that are shown: all of a list box, else the one that is selected, or the first."""
    found: list[tuple[bool, str]] = []

    def gather(node: Node) -> None:
        for c in node.children:
            if isinstance(c, str) or not visible(c):
                continue
            if c.tag == "option":
                found.append(("selected" in c.attrs, c.attrs.get("label") or _space.sub(" ", _plain(c)).strip()))
            elif c.tag == "optgroup":
                if several and c.attrs.get("label"):
                    found.append((False, c.attrs["label"]))
                gather(c)

    gather(select)
    if several or not found:
        return [t for _, t in found]
    return [next((t for chosen, t in reversed(found) if chosen), found[0][1])]


def _plain(node: Node) -> str:
    return "".join(c if isinstance(c, str) else "\n" if c.tag == "br" else _plain(c) if visible(c) else "" for c in node.children)


def _rows(node: Node, captions: list):
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                captions.append(child)
        elif not visible(child):
            continue
        elif child.tag == "tr":
            yield [c for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and visible(c)]
            captions.extend(c if isinstance(c, str) else render(c) for c in child.children if (c.strip() if isinstance(c, str) else c.tag not in ("td", "th") and visible(c)))
        elif child.tag in ("thead", "tbody", "tfoot"):
            yield from _rows(child, captions)
        elif child.tag in ("td", "th"):
            yield [child]
        elif child.tag not in ("colgroup", "col"):
            captions.append(render(child))


def _table(node: Node, out: Renderer) -> None:
    """Cells of a column start at the same place, up to ALIGNED; a cell of several lines takes several lines."""
    captions: list[str] = []
    rows = list(_rows(node, captions))
    for c in captions:
        if text := _space.sub(" ", c).strip():
            out._emit(text)
    grid: list[dict[int, tuple[list[str], int, str]]] = []
    # (first column, column behind, rows left) of cells that reach into rows below, by column.
    spans: list[tuple[int, int, int]] = []
    for cells in rows:
        line: dict[int, tuple[list[str], int, str]] = {}
        column = met = 0
        new = [(a, b, left - 1) for a, b, left in spans if left > 1]
        for cell in cells:
            while met < len(spans) and spans[met][0] <= column:
                column = max(column, spans[met][1])
                met += 1
            across, down = _span(cell, "colspan"), _span(cell, "rowspan")
            line[column] = (render(cell).split("\n"), across, cell.attrs.get("align", "").lower())
            if down > 1:
                new.append((column, column + across, down - 1))
            column += across
        spans = sorted(new)
        grid.append(line)
    widths: dict[int, int] = {}
    for line in grid:
        for column, (text, across, _) in line.items():
            if across == 1:
                widths[column] = max(widths.get(column, 0), *map(width, text))
    # Only columns in which a cell starts take room.
    starts: dict[int, int] = {}
    place = 0
    for column in sorted({c for line in grid for c in line}):
        starts[column] = min(place, ALIGNED)
        place += widths.get(column, 0) + 2
    for line in grid:
        open_cells = [(c, *line[c]) for c in sorted(line)]
        part = 0
        while open_cells:
            out_line: list[str] = []
            at = 0
            for column, pieces, across, align in open_cells:
                piece = pieces[part]
                if not piece:
                    continue
                lead = widths[column] - width(piece) if align == "right" and across == 1 else 0
                pad = max(starts[column] - at, 2 if out_line else 0) + min(lead, ALIGNED)
                out_line += [" " * pad, piece]
                at += pad + width(piece)
            if text := "".join(out_line).rstrip():
                out._emit(text)
            part += 1
            open_cells = [x for x in open_cells if len(x[1]) > part]


def _span(cell: Node, name: str) -> int:
    value = cell.attrs.get(name, "1")
    return max(1, min(1000, int(value))) if re.fullmatch(r"\d{1,9}", value) else 1


def extract(html: str | None) -> str | None:
    """All visible text of a page; null for null."""
    return None if html is None else render(parse(html))


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all but html_col) and text_col, a row for each row of pages.

    Null pages give null, empty ones an empty text; any input gives a text. A
    kept column named text_col is replaced. No shuffle; a page at a time is in
    memory.
    """
    kept = [c for c in (keep or [c for c in pages.columns if c != html_col]) if c != text_col]
    small_batches(pages.sparkSession)
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(pages.select(*kept).schema)] + [T.StructField("text", T.StringType())])

    def scan(batches):
        for batch in batches:
            text = pa.array((extract(x.as_py()) for x in batch.column(len(kept))), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], text], names=schema.names)

    rows = pages.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], F.col(html_col).alias("html"))
    return rows.mapInArrow(scan, schema).toDF(*kept, text_col)
