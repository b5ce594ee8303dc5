"""Visible text of HTML by layout-aware rendering."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import small_batches

# Fixed values of the HTML standard: element groups that steer tree building and rendering.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style head title meta link template noscript iframe noembed noframes object video audio canvas datalist map area base param source track dialog desc metadata defs symbol annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
SPACED = frozenset("p blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol ul pre table fieldset menu dir".split())
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "legend", "li", "dd", "dt"}
TABLE_PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
#: An open element of these is ended by the start of one of those, looking outward as far as the barrier.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, set()),
}

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(/?)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|content-visibility\s*:\s*hidden)\b", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")
#: Inputs that show their value.
SHOWN_INPUTS = frozenset("text search url tel email number submit button reset".split())
#: Elements open at once; deeper ones are rendered in the deepest, as browsers do.
DEEPEST = 512


@dataclass(slots=True)
class Node:
    name: str
    attributes: dict[str, str]
    children: list = field(default_factory=list)


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        value = value[1:-1] if value[:1] in ("'", '"') else value
        out.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return out


def build_tree(source: str) -> Node:
    """Tree of a page. Missing end tags are implied, end tags without a start are ignored, comments and declarations dropped."""
    root = Node("#root", {})
    stack = [root]
    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            stack[-1].children.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(source[at : m.start()]))
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name == "p" and not any(x.name == "p" for x in stack):
                stack[-1].children.append(Node("p", {}))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if stack[k].name in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break  # an end tag inside a cell does not reach out of it
            continue
        if not m[2]:
            continue
        name = m[2].lower()
        if name in CLOSES_P:
            _end(stack, {"p"}, {"td", "th", "table", "li", "button"})
        if name in IMPLIED_END:
            _end(stack, *IMPLIED_END[name])
        if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
            stack.append(_child(stack, "tr", {}))
        node = _child(stack, name, _attributes(m[3]) if m[3] else {})
        if name in VOID or m[4]:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*[^>]*(?:>|\Z)", re.I).search(source, at)
            node.children.append(source[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        if len(stack) < DEEPEST:
            stack.append(node)
    return root


def _child(stack: list[Node], name: str, attributes: dict[str, str]) -> Node:
    node = Node(name, attributes)
    stack[-1].children.append(node)
    return node


def _end(stack: list[Node], names: set[str], barrier: set[str]) -> None:
    """Ends the outermost open element of names that lies inside the barrier."""
    found = 0
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].name in barrier:
            break
        if stack[k].name in names:
            found = k
    if found:
        del stack[found:]


def _visible(node: Node) -> bool:
    a = node.attributes
    if node.name in UNSEEN or "hidden" in a:
        return node.name == "dialog" and "open" in a and "hidden" not in a
    return not ("style" in a and _HIDDEN.search(a["style"]))


class _Page:
    """Lines of text with what must stand between them: a blank line, a line end, or a space."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.gap = 0  # line ends owed before the next text
        self.space = False

    def text(self, s: str) -> None:
        if not s:
            return
        if self.gap and self.out:
            self.out.append("\n" * self.gap)
        elif self.space and self.out and not self.out[-1].endswith((" ", "\n")):
            self.out.append(" ")
        self.gap, self.space = 0, False
        self.out.append(s)

    def flow(self, s: str) -> None:
        plain = _SPACES.sub(" ", s)
        if plain.startswith(" "):
            self.space = True
        core = plain.strip(" ")
        if core:
            self.text(core)
            self.space = plain.endswith(" ")

    def line(self, ends: int) -> None:
        self.gap = max(self.gap, ends)
        self.space = False

    def value(self) -> str:
        return "\n".join(x.rstrip(" ") for x in "".join(self.out).split("\n")).strip("\n")


def _width(s: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _table(node: Node, depth: int) -> str:
    """Rows of a table with cells padded to the width of their column; a cell over several columns takes their places."""
    caption: list[str] = []
    rows: list[list[tuple[list[str], int]]] = []
    carried: dict[int, int] = {}  # columns taken by cells of the rows above, and for how many rows more

    def walk(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                if c.strip():
                    caption.append(_SPACES.sub(" ", c).strip())
            elif not _visible(c):
                continue
            elif c.name == "tr":
                row: list[tuple[list[str], int]] = []
                at = 0
                for cell in c.children:
                    if isinstance(cell, str) or cell.name not in ("td", "th"):
                        inner = render(cell, depth + 1) if isinstance(cell, Node) and _visible(cell) else cell.strip() if isinstance(cell, str) else ""
                        if inner:
                            caption.append(inner)
                        continue
                    if not _visible(cell):
                        continue
                    while carried.get(at, 0):
                        carried[at] -= 1
                        row.append(([""], 1))
                        at += 1
                    wide = _span(cell.attributes.get("colspan"))
                    row.append((render(cell, depth + 1).split("\n"), wide))
                    for k in range(at, at + wide):
                        carried[k] = _span(cell.attributes.get("rowspan")) - 1
                    at += wide
                if any(any(x) for x, _ in row):
                    rows.append(row)
            elif c.name == "caption":
                caption.append(render(c, depth + 1))
            else:
                walk(c)

    walk(node)
    columns = max((sum(w for _, w in r) for r in rows), default=0)
    widths = [0] * columns
    for row in rows:
        at = 0
        for lines, wide in row:
            if wide == 1:
                widths[at] = max([widths[at], *map(_width, lines)])
            at += wide
    out = [x for x in caption if x]
    for row in rows:
        for k in range(max(len(x) for x, _ in row)):
            at, parts = 0, []
            for lines, wide in row:
                s = lines[k] if k < len(lines) else ""
                room = sum(widths[at : at + wide]) + 2 * (wide - 1)
                parts.append(s + " " * (room - _width(s)))
                at += wide
            out.append("  ".join(parts).rstrip(" "))
    return "\n".join(out)


def _span(value: str | None) -> int:
    return max(1, min(1000, int(value))) if value and value.strip().isdecimal() else 1


def render(node: Node, depth: int = 0) -> str:
    """All visible text below node. Blocks stand on lines of their own, paragraphs and headings between blank lines.

    As a browser shows them: the text of drawings and formulas, the chosen option of a drop-down and all options of a
    list box, what a text area, a text field or a button holds. Content that only stands in for media is not shown.
    Tables nested more than eight deep are rendered row by row, without padded cells.
    """
    page = _Page()
    _walk(node, page, depth, False, [])
    return page.value()


def _walk(node: Node, page: _Page, depth: int, pre: bool, lists: list[list]) -> None:
    for c in node.children:
        if isinstance(c, str):
            if pre:
                page.text(c.replace("\r\n", "\n"))
            else:
                page.flow(c)
            continue
        name = c.name
        if not _visible(c):
            continue
        if name == "br":
            page.line(page.gap + 1 if page.gap else 1)
        elif name == "hr":
            page.line(2)
        elif name == "img":
            page.flow(c.attributes.get("alt", ""))
        elif name == "input":
            if c.attributes.get("type", "text").strip().lower() in SHOWN_INPUTS and c.attributes.get("value", "").strip():
                page.space = True
                page.flow(c.attributes["value"])
                page.space = True
        elif name == "textarea":
            page.space = True
            page.text(html.unescape("".join(x for x in c.children if isinstance(x, str))).replace("\r\n", "\n").strip("\n"))
            page.space = True
        elif name == "select" and not ("multiple" in c.attributes or _span(c.attributes.get("size")) > 1):
            page.space = True
            options = [x for x in _options(c) if _visible(x)]
            if options:
                chosen = next((x for x in reversed(options) if "selected" in x.attributes), options[0])
                page.flow(" ".join(render(chosen, depth).split()))
            page.space = True
        elif name == "text":  # of a drawing
            page.space = True
            _walk(c, page, depth, pre, lists)
            page.space = True
        elif name == "table" and depth < 8:
            page.line(2)
            page.text(_table(c, depth))
            page.line(2)
        elif name in ("ul", "ol", "menu", "dir"):
            page.line(1 if lists else 2)
            start = c.attributes.get("start", "1")
            _walk(c, page, depth, pre, [*lists, [name, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1]])
            page.line(1 if lists else 2)
        elif name == "li":
            page.line(1)
            mark = "- "
            if lists and lists[-1][0] == "ol":
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            inner = _Page()
            _walk(c, inner, depth, pre, lists)
            body = inner.value()
            if body:
                page.text("  " * max(len(lists) - 1, 0) + mark + body)
            page.line(1)
        elif name == "dd":
            page.line(1)
            inner = _Page()
            _walk(c, inner, depth, pre, lists)
            if body := inner.value():
                page.text("\n".join("  " + x if x else x for x in body.split("\n")))
            page.line(1)
        elif name == "q":
            page.text('"')
            _walk(c, page, depth, pre, lists)
            page.space = False
            page.text('"')
        elif name in BLOCK:
            ends = 2 if name in SPACED else 1
            page.line(ends)
            _walk(c, page, depth, pre or name == "pre", lists)
            page.line(ends)
        elif name in ("td", "th"):
            page.space = True
            _walk(c, page, depth, pre, lists)
            page.space = True
        elif name in ("tr", "thead", "tbody", "tfoot", "caption"):
            page.line(1)
            _walk(c, page, depth, pre, lists)
            page.line(1)
        else:
            _walk(c, page, depth, pre, lists)


def _options(node: Node) -> Iterator[Node]:
    for c in node.children:
        if isinstance(c, Node):
            if c.name == "option":
                yield c
            else:
                yield from _options(c)


def visible_text(source: str | None) -> str:
    """Text of one page; null and empty pages have none."""
    return render(build_tree(source)) if source else ""


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            texts = pa.array([visible_text(x) for x in part.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("id"), texts], names=["id", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Rows (id, text), one for each row of pages, in one pass without a shuffle.

    Null and empty pages give an empty text; broken markup gives what a lenient tree holds. Repeated rows are
    rendered each. Other columns are not read. An empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{html_col}`").alias("html"))
    return rows.mapInArrow(_rendered, "id long, text string").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
