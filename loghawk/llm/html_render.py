"""HTML extraction by layout: a tree with implied tags, visibility rules, and a text renderer.

The tree builder closes what the next tag implies closed (paragraphs before blocks,
list items, table parts, options), opens what a table row or cell implies, drops
end tags without a start, and keeps the bodies of raw-text elements out of the tree.

The renderer emits all visible text. Hidden are scripts, styles, the head, templates
and other unrendered elements, the ``hidden`` attribute, ``display:none``,
``visibility:hidden``, the body of a closed ``details`` and the parts of an ``svg`` that are
only referred to; its ``text`` elements are lines. White space collapses, but in ``pre``
and ``xmp``. Blocks start on a new line; paragraphs, headings, lists, tables and quotes
stand between blank lines. List items get a bullet or their number and are indented
by depth; table cells are padded to their column's width.

Edge cases: null or empty HTML gives empty text; unclosed tags end with the document;
text without any tag is itself; nesting may be arbitrarily deep (no recursion);
repeated rows are rendered each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style title template iframe noembed noframes noscript meta link base "
                   "datalist object audio video canvas".split())
#: Within svg.
SVG_UNSEEN = frozenset("defs symbol clippath mask marker pattern lineargradient radialgradient filter desc "
                       "metadata".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre "
                  "search section summary table ul caption tr tbody thead tfoot td th text xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre xmp table figure hr".split())
ENDS_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
#: start tag -> (open elements it closes, elements that stop the search)
IMPLIED_END = {
    "li": (("li",), LISTS), "dt": (("dt", "dd"), {"dl"}), "dd": (("dt", "dd"), {"dl"}),
    "option": (("option",), {"select", "datalist"}), "optgroup": (("option", "optgroup"), {"select"}),
    "tr": (("tr", "caption", "colgroup"), {"table", "thead", "tbody", "tfoot"}),
    "td": (("td", "th"), {"tr", "table"}), "th": (("td", "th"), {"tr", "table"}),
    "tbody": (("tbody", "thead", "tfoot", "caption", "colgroup"), {"table"}),
    "thead": (("tbody", "thead", "tfoot", "caption", "colgroup"), {"table"}),
    "tfoot": (("tbody", "thead", "tfoot", "caption", "colgroup"), {"table"}),
    "body": (("head",), {"html"}),
}
SCOPE = frozenset("table td th caption html button".split())

#: A quote opens a value only directly after "="; elsewhere it is part of a name or of an unquoted value.
_VALUE = r"[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:\"([^\"]*+)\"|'([^']*+)'|([^ \t\n\r\f>\"'][^ \t\n\r\f>]*+)|(?=>|\Z))"
_NAME = r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+"
_ATTRS = re.sub(r"\((?!\?)", "(?:", rf"(?:[ \t\n\r\f/]++|{_NAME}(?:{_VALUE})?+)*+")
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^ \t\n\r\f/>]*+)({_ATTRS})>", re.S)
_ATTR = re.compile(rf"({_NAME})(?:{_VALUE})?+")
_UNSEEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def _closes_itself(raw: str) -> bool:
    """A slash ends the tag and isn't part of an unquoted value."""
    last = None
    for last in _ATTR.finditer(raw):
        pass
    return raw.endswith("/") and (last is None or last.end() < len(raw))


class TreeBuilder:
    """Open elements as a stack; children are nodes or strings."""

    def __init__(self):
        self.root = Node("#root")
        self.open = [self.root]

    def text(self, raw: str) -> None:
        if raw:
            self.open[-1].children.append(entities.unescape(raw) if "&" in raw else raw)

    def _close_through(self, tags, stop) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in stop:
                return

    def start(self, tag: str, raw: str) -> None:
        if tag in ENDS_P:
            self._close_through(("p",), SCOPE)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag in IMPLIED_END:
            closes, stop = IMPLIED_END[tag]
            for _ in closes:  # a cell, then its row, then its section
                self._close_through(closes, stop)
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.start("tr", "")
        if tag == "tr" and self.open[-1].tag == "table":
            self.start("tbody", "")
        node = Node(tag, _attributes(raw) if "=" in raw or raw.strip(" \t\n\r\f/") else None)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
            return
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self.start("p", "")
        # An inline end tag closes no block around it, no other end tag a table around it.
        outermost = tag in ("table", "html", "body")
        self._close_through((tag,), () if outermost else {"table"} if tag in BLOCK else BLOCK)


def parse(source: str) -> Node:
    build, at, n = TreeBuilder(), 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            build.text(source[at:])
            break
        build.text(source[at:m.start()])
        at = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):
            build.end(tag)
            continue
        build.start(tag, m.group(3))
        if (tag in SVG_UNSEEN or m.group(3).endswith("/")) and any(x.tag == "svg" for x in build.open):
            if tag in SVG_UNSEEN:
                build.open[-1].attrs["hidden"] = ""
            if _closes_itself(m.group(3)) and build.open[-1].tag == tag:
                build.open.pop()
                continue
        if tag in RAW:
            last = _RAW_END[tag].search(source, at)
            if tag == "textarea":
                build.text(source[at:last.start() if last else n])
            elif tag == "xmp":  # as in pre, but without entities
                body = source[at:last.start() if last else n].removeprefix("\n")
                build.open[-1].children += [body] if body else []
            at = last.end() if last else n
            if build.open[-1].tag == tag:
                build.open.pop()
        elif tag == "pre" and source.startswith("\n", at):
            at += 1  # the first line break of preformatted text isn't part of it
    return build.root


class _Lines:
    """Lines under construction: collapsed inline text, block breaks, indentation."""

    def __init__(self):
        self.lines: list[str] = []
        self.now = ""
        self.gap = False       # a space is due before the next text
        self.blank = False     # a blank line is due before the next line
        self.indent: list[str] = []
        self.marker = ""       # bullet or number of an item without text yet

    def _begin(self) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        lead = "".join(self.indent)
        if self.marker:
            lead = lead[:len(lead) - len(self.indent[-1])] + self.marker if self.indent else self.marker
            self.marker = ""
        self.now = lead
        self.gap = False

    def text(self, raw: str) -> None:
        if raw[0] in " \t\n\r\f":
            self.gap = True
        words = _SPACE.sub(" ", raw).strip(" ")
        if not words:
            return
        if not self.now:
            self._begin()
            self.now += words
        else:
            self.now += " " + words if self.gap else words
        self.gap = raw[-1] in " \t\n\r\f"

    def verbatim(self, raw: str) -> None:
        for k, line in enumerate(raw.split("\n")):
            if k:
                self.end_line(True)
            if line:
                if not self.now:
                    self._begin()
                self.now += line

    def end_line(self, even_empty: bool = False) -> None:
        if self.now:
            self.lines.append(self.now.rstrip(" "))
        elif even_empty and self.lines:
            self.lines.append("")
        self.now, self.gap = "", False

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.blank = self.blank or spaced

    def add(self, lines: list[str]) -> None:
        for line in lines:
            if not self.now:
                self._begin()
            self.now += line
            self.end_line(True)


def _unseen(node: Node) -> bool:
    if node.tag in UNSEEN or "hidden" in node.attrs:
        return True
    if node.tag == "input" or node.tag == "dialog" and "open" not in node.attrs:
        return True
    return "style" in node.attrs and bool(_UNSEEN_STYLE.search(node.attrs["style"]))


def _number(text: str | None, default: int) -> int:
    try:
        return int(text)
    except (TypeError, ValueError):
        return default


class _Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int]]] = []
        self.caption: list[str] = []

    def layout(self) -> list[str]:
        """Cells padded to their column; a cell over several columns is padded to all of them."""
        width: dict[int, int] = {}
        for row in self.rows:
            at = 0
            for lines, span in row:
                if span == 1:
                    width[at] = max(width.get(at, 0), max(map(len, lines), default=0))
                at += span
        out = list(self.caption)
        for row in self.rows:
            height = max((len(lines) for lines, _ in row), default=0)
            for k in range(height):
                at, cells = 0, []
                for lines, span in row:
                    room = sum(width.get(c, 0) for c in range(at, at + span)) + 3 * (span - 1)
                    cells.append((lines[k] if k < len(lines) else "").ljust(room))
                    at += span
                line = " | ".join(cells).rstrip(" ")
                if line.strip(" |"):
                    out.append(line)
        return out


def render(root: Node) -> str:
    """Visible text of a tree, laid out in lines."""
    top = _Lines()
    out, tables, cells, lists, pre = top, [], [], [], 0
    stack: list[tuple] = [(root, False)]
    while stack:
        node, leaving = stack.pop()
        if isinstance(node, str):
            (out.verbatim if pre else out.text)(node)
            continue
        tag = node.tag
        if not leaving:
            if _unseen(node):
                continue
            if tag == "br":
                out.end_line(True)
                continue
            if tag in BLOCK:
                out.block(tag in SPACED and not (tag in LISTS and lists))
            if tag == "hr":
                continue
            if tag in ("pre", "xmp"):
                pre += 1
            elif tag in LISTS:
                lists.append([tag, _number(node.attrs.get("start"), 1)])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    number = _number(node.attrs.get("value"), lists[-1][1])
                    lists[-1][1] = number + 1
                    mark = f"{number}. "
                out.indent.append(" " * len(mark))
                out.marker = mark
            elif tag == "dd" or tag == "blockquote":
                out.indent.append("  " if tag == "dd" else "> ")
            elif tag == "table":
                tables.append(_Table())
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif tag in ("td", "th", "caption") and tables:
                if tag != "caption" and not tables[-1].rows:
                    tables[-1].rows.append([])
                cells.append((out, lists, pre))
                out, lists, pre = _Lines(), [], 0
            stack.append((node, True))
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
            stack.extend((c, False) for c in reversed(children))
            continue
        if tag in ("pre", "xmp"):
            pre -= 1
        elif tag in LISTS:
            lists.pop()
        elif tag in ("li", "dd", "blockquote"):
            out.end_line()
            out.indent.pop()
            out.marker = ""
        elif tag in ("td", "th", "caption") and tables:
            out.end_line()
            lines = out.lines
            out, lists, pre = cells.pop()
            if tag == "caption":
                tables[-1].caption += lines
            else:
                tables[-1].rows[-1].append((lines, min(1000, max(1, _number(node.attrs.get("colspan"), 1)))))
        elif tag == "table":
            out.add(tables.pop().layout())
        if tag in BLOCK:
            out.block(tag in SPACED and not (tag in LISTS and lists))
        elif tag in ("select", "button"):
            out.gap = True
    top.end_line()
    while top.lines and not top.lines[-1]:
        top.lines.pop()
    return "\n".join(top.lines)


def render_html(source: str | None) -> str:
    return render(parse(source)) if source else ""


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: its visible text, with the numbers of characters, words and lines."""
    def run(batches):
        for batch in batches:
            step = 256
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                texts = [render_html(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([len(t.split()) for t in texts], pa.int64()),
                     pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
                    names=["page_id", "text", "n_chars", "n_words", "n_lines"])

    return (pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))
            .mapInArrow(run, "page_id long, text string, n_chars long, n_words long, n_lines long"))
