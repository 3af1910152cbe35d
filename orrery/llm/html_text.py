"""Visible text of web pages: a forgiving tree builder and a layout-aware renderer."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from itertools import accumulate
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame

from orrery.llm.common import as_bytes, text_slices

# Fixed values of HTML: how elements are built and shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object datalist audio video canvas progress meter rp".split())
#: Parts of drawings and formulas that aren't drawn themselves.
HIDDEN_IN = {"svg": frozenset("desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter".split()), "math": frozenset(["annotation", "annotation-xml"])}
#: Kinds of input fields whose value is shown, and those that show a placeholder where it is empty.
SHOWN_VALUE = frozenset("text search email url tel number date time month week datetime-local submit reset button".split())
SHOWN_PLACEHOLDER = frozenset("text search email url tel number password".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table textarea ul xmp caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr menu dir".split())
CLOSES_P = BLOCK - frozenset("body html caption legend optgroup option textarea".split())
#: Start tag -> open elements that it ends, and the elements at which the search for them stops.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
#: An end tag doesn't reach beyond these.
SCOPE = {"td", "th", "table", "caption", "html", "template"}
ROW_GROUPS = {"thead", "tbody", "tfoot"}
CELLS = {"td", "th"}
#: Parts of drawings and formulas whose content is HTML again.
HTML_AGAIN = {"foreignobject", "desc", "title", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"}
CDATA = "<![CDATA["
#: Elements nested deeper than this become siblings, as in browsers; it bounds every search.
DEPTH = 512

#: An attribute as browsers read it: a quote opens a value only behind `=`, elsewhere it is a character like any other.
VALUE = r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+"
TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:-->|--!>|\Z))|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>\x00]*)(?P<attrs>(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:{VALUE})?+)?+)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"'][^\s>]*+))?+)?+")
STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes = name, attributes
        self.children: list[Node | str] = []


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if text:
        for key, a, b, c in ATTRIBUTE.findall(text):
            found.setdefault(key.lower(), unescape(a or b or c))
    return found


class Builder:
    """Builds a tree from tags in any order: what is left open is closed, what was left out is
    put in (rows and groups of tables, lists' ends, paragraphs' ends), stray end tags vanish."""

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.open = [self.root]

    def close(self, names: Iterable[str], stop: Iterable[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in names:
                del self.open[i:]
                return
            if self.open[i].name in stop:
                return

    def push(self, name: str, attrs: dict[str, str], keep: bool = True) -> None:
        node = Node(name, attrs)
        self.open[-1].children.append(node)
        if keep and len(self.open) < DEPTH:
            self.open.append(node)

    def start(self, name: str, attrs: dict[str, str], closed: bool) -> None:
        if name in ("html", "body"):
            for k, v in attrs.items():
                self.root.attributes.setdefault(k, v)
            if name == "body":
                self.close({"head"}, set())
            return
        if name in BLOCK:
            self.close({"head"}, {"body", "svg", "template"})
        if name in CLOSES_P:
            self.close({"p"}, SCOPE | {"button", "object"})
        if name in IMPLIED_END:
            names, stop = IMPLIED_END[name]
            while any(n.name in names for n in self.within(stop)):
                self.close(names, stop)
        top = self.open[-1].name
        if name in ROW_GROUPS | {"tr"} | CELLS and top == "table" and name not in ROW_GROUPS:
            self.push("tbody", {})
        if name in CELLS and self.open[-1].name in ROW_GROUPS:
            self.push("tr", {})
        self.push(name, attrs, name not in VOID and not (closed and name in {"svg", "path"}))

    def within(self, stop: set[str]) -> Iterator[Node]:
        for node in reversed(self.open[1:]):
            if node.name in stop:
                return
            yield node

    def end(self, name: str) -> None:
        if name == "br":
            self.push("br", {}, keep=False)
            return
        if name == "p" and not any(n.name == "p" for n in self.within(SCOPE)):
            self.push("p", {}, keep=False)
            return
        self.close({name}, SCOPE - {name} if name not in ("table", "tr", *ROW_GROUPS) else {"table"} - {name})

    def foreign(self) -> bool:
        """Whether what comes next is part of a drawing or formula."""
        found = next((n.name for n in reversed(self.open) if n.name in HTML_AGAIN or n.name in HIDDEN_IN), "")
        return found in HIDDEN_IN

    def text(self, text: str) -> None:
        self.open[-1].children.append(text)


def tree(html: str) -> Node:
    build, at, n = Builder(), 0, len(html)
    while at < n:
        found = TOKEN.search(html, at)
        if not found:
            build.text(unescape(html[at:]))
            break
        if found.start() > at:
            build.text(unescape(html[at : found.start()]))
        if html.startswith(CDATA, found.start()) and build.foreign():
            close = html.find("]]>", found.start())
            build.text(html[found.start() + len(CDATA) : close if close >= 0 else n])
            at = close + 3 if close >= 0 else n
            continue
        at = found.end()
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if found["end"]:
            build.end(name)
            continue
        raw = found["attrs"]
        build.start(name, attributes(raw), raw.endswith("/"))
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            inner = html[at : close.start() if close else n]
            build.text(unescape(inner) if name in ("title", "textarea") else inner)
            build.end(name)
            at = close.end() if close else n
        elif name == "plaintext":
            build.text(html[at:])
            break
    return build.root


def styled(text: str) -> dict[str, str]:
    """What a style attribute says last, or as important, of display and visibility."""
    out: dict[str, tuple[bool, str]] = {}
    for key, value, important in STYLE.findall(text):
        if important or not out.get(key.lower(), (False,))[0]:
            out[key.lower()] = bool(important), value.lower()
    return {k: v for k, (_, v) in out.items()}


def gone(node: Node, parent: Node | None, inside: str, style: dict[str, str]) -> bool:
    """Whether an element isn't there for the reader, with all that it holds."""
    a = node.attributes
    if node.name in HIDDEN or node.name in HIDDEN_IN.get(inside, ()):
        return True
    if "display" in style:
        if style["display"] == "none":
            return True
    elif "hidden" in a and a["hidden"].lower() != "until-found":
        return True
    if node.name == "dialog" and "open" not in a:
        return True
    return parent is not None and parent.name == "details" and "open" not in parent.attributes and node.name != "summary"


def field_text(node: Node) -> str:
    """What an input field shows."""
    kind = node.attributes.get("type", "").strip().lower() or "text"
    value = node.attributes.get("value", "") if kind in SHOWN_VALUE else ""
    return value or (node.attributes.get("placeholder", "") if kind in SHOWN_PLACEHOLDER and not node.attributes.get("value") else "")


def width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(2 if east_asian_width(c) in "WF" else 1 for c in text)


#: Values of Roman numerals, from the greatest.
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def numbered(value: int, kind: str) -> str:
    """A list item's number in letters (a, A), Roman numerals (i, I) or digits; numbers that a kind
    can't write are digits."""
    if kind in ("a", "A") and value > 0:
        out = ""
        while value:
            value, letter = divmod(value - 1, 26)
            out = chr(97 + letter) + out
        return out if kind == "a" else out.upper()
    if kind in ("i", "I") and 0 < value < 4000:
        out = ""
        for size, letters in ROMAN:
            out += letters * (value // size)
            value %= size
        return out if kind == "i" else out.upper()
    return str(value)


class Canvas:
    """Lines of a block under construction. White space collapses across inline elements; `gap`
    is the number of line ends owed before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.blank = False
        self.indent = ""
        self.marker = ""

    def words(self, text: str) -> None:
        if not text:
            return
        flat = SPACE.sub(" ", text)
        if flat == " ":
            self.blank = bool(self.line)
            return
        if (flat[0] == " " or self.blank) and self.line:
            self.line.append(" ")
        self.settle()
        self.blank = flat[-1] == " "
        self.line.append(flat.strip(" "))

    def settle(self) -> None:
        if not self.line:
            if self.gap > 1 and self.lines and self.lines[-1] != "":
                self.lines.append("")
            self.gap = 0
            self.line.append(self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent)
            self.marker = ""

    def end_line(self, gap: int = 1) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.blank = False
        self.gap = max(self.gap, gap)

    def forced(self) -> None:
        if self.line:
            self.end_line()
        elif self.lines:
            self.lines.append("")

    def plain(self, lines: list[str]) -> None:
        for text in lines:
            self.settle()
            self.line.append(text)
            self.lines.append("".join(self.line).rstrip())
            self.line = []

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        first = next((i for i, x in enumerate(self.lines) if x), len(self.lines))
        return self.lines[first:]


class Grid:
    """Cells of a table under construction, placed by row and column spans."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.busy: dict[int, int] = {}  # column -> first row in which it is free again
        self.next = 0
        self.caption: list[str] = []

    def row(self) -> None:
        self.rows.append([])
        self.next = 0

    def cell(self, node: Node, lines: list[str]) -> None:
        def span(key: str, most: int) -> int:
            v = node.attributes.get(key, "1").strip()
            return max(1, min(most, int(v))) if v.isascii() and v.isdigit() and len(v) < 10 else 1

        if not self.rows:
            self.row()
        r, c = len(self.rows) - 1, self.next
        while self.busy.get(c, 0) > r:
            c += 1
        across, down = span("colspan", 1000), span("rowspan", 65534)
        for j in range(across):
            self.busy[c + j] = r + down
        self.next = c + across
        self.rows[-1].append((c, across, lines))

    def lines(self) -> list[str]:
        """Columns as wide as their widest one-column cell, two spaces apart; a cell over several
        columns widens the last of them where it needs to."""
        cells = [x for row in self.rows for x in row if x[2]]
        n = max((c + s for c, s, _ in cells), default=0)
        wide = [0] * n
        for c, s, text in sorted(cells, key=lambda x: x[1]):
            need = max(map(width, text)) - sum(wide[c : c + s]) - 2 * (s - 1)
            if need > 0:
                wide[c + s - 1] += need
        begin = [0, *accumulate(w + 2 * (w > 0) for w in wide)]
        out = list(self.caption)
        for row in self.rows:
            for k in range(max((len(t) for _, _, t in row), default=0)):
                line, used = [], 0
                for c, _, text in row:
                    if k < len(text) and text[k]:
                        line.append(" " * (begin[c] - used) + text[k])
                        used = begin[c] + width(text[k])
                out.append("".join(line))
        return out


def render(root: Node) -> str:
    """The tree's visible text. Walks with a stack of its own, however deep the nesting."""
    canvases = [Canvas()]
    grids: list[Grid] = []
    lists: list[tuple[list[int], int, str] | None] = []  # next number, step and kind of numbers
    indents: list[str] = []
    pre = 0
    # With each node: its parent, whether its text is visible, and the drawing or formula it is in.
    stack: list[tuple[str, Node | str, Node | None, bool, str]] = [("enter", root, None, True, "")]
    while stack:
        step, node, parent, shown, inside = stack.pop()
        canvas = canvases[-1]
        if isinstance(node, str):
            if not shown:
                continue
            if parent is not None and parent.name == "details" and "open" not in parent.attributes:
                continue
            if grids and parent is not None and parent.name in {"table", "tr", *ROW_GROUPS}:
                if not node.strip():
                    continue
            if pre:
                parts = node.replace("\r\n", "\n").split("\n")
                for i, part in enumerate(parts):
                    if i:
                        canvas.settle() if not canvas.line else None
                        canvas.end_line(0)
                    if part:
                        canvas.settle()
                        canvas.line.append(part)
            else:
                canvas.words(node)
            continue
        name = node.name
        if step == "enter":
            style = styled(node.attributes["style"]) if "style" in node.attributes else {}
            if gone(node, parent, inside, style):
                continue
            # A visible part of a hidden whole is seen: visibility is inherited, but can be set anew.
            if "visibility" in style and style["visibility"] not in ("inherit", "unset"):
                shown = style["visibility"] not in ("hidden", "collapse")
            inside = name if name in HIDDEN_IN else "" if name in ("foreignobject", "annotation-xml") else inside
            if name == "br":
                canvas.forced()
                continue
            if name == "wbr":
                continue
            if name in BLOCK or (name == "text" and inside == "svg"):
                canvas.end_line(2 if name in SPACED and not (name in ("ul", "ol", "menu", "dir") and lists) else 1)
            if name == "hr" or name == "img":
                continue
            if name == "input":
                if shown and (value := field_text(node)):
                    canvas.words(f" {value} ")
                continue
            if name in ("optgroup", "option") and shown and (value := node.attributes.get("label", "")):
                canvas.words(value)
                canvas.end_line()
                if name == "option":
                    continue
            if name in ("ul", "menu", "dir"):
                lists.append(None)
            elif name == "ol":
                back = "reversed" in node.attributes
                start = node.attributes.get("start", "").strip()
                items = sum(isinstance(c, Node) and c.name == "li" for c in node.children)
                first = int(start) if re.fullmatch(r"[-+]?\d{1,9}", start) else items if back else 1
                lists.append(([first], -1 if back else 1, node.attributes.get("type", "").strip()))
            elif name == "li":
                mark = "- "
                if lists and lists[-1]:
                    count, by, kind = lists[-1]
                    value = node.attributes.get("value", "").strip()
                    if re.fullmatch(r"[-+]?\d{1,9}", value):
                        count[0] = int(value)
                    mark = f"{numbered(count[0], node.attributes.get('type', kind).strip())}. "
                    count[0] += by
                indents.append(canvas.indent)
                canvas.indent += " " * len(mark)
                canvas.marker = mark
            elif name in ("dd", "blockquote"):
                indents.append(canvas.indent)
                canvas.indent += "  "
            elif name in ("pre", "listing", "xmp", "textarea"):
                pre += 1
                if node.children and isinstance(node.children[0], str) and node.children[0].startswith("\n"):
                    node.children[0] = node.children[0][1:]
            elif name == "table":
                grids.append(Grid())
            elif name == "tr" and grids:
                grids[-1].row()
            elif (name in CELLS or name == "caption") and grids:
                canvases.append(Canvas())
            elif name == "q" and shown:
                canvas.words('"')
            stack.append(("leave", node, parent, shown, inside))
            stack.extend(("enter", child, node, shown, inside) for child in reversed(node.children))
            continue
        if name in ("ul", "menu", "dir", "ol"):
            lists.pop()
        elif name == "li":
            canvas.end_line()
            canvas.marker = ""
            canvas.indent = indents.pop()
        elif name in ("dd", "blockquote"):
            canvas.end_line()
            canvas.indent = indents.pop()
        elif name in ("pre", "listing", "xmp", "textarea"):
            pre -= 1
        elif name in CELLS and grids:
            canvases.pop()
            grids[-1].cell(node, canvas.done())
        elif name == "caption" and grids:
            canvases.pop()
            grids[-1].caption += canvas.done()
        elif name == "table":
            canvas.end_line(2)
            lines = grids.pop().lines()
            canvas.plain([x for x in lines if x])
        elif name == "q" and shown:
            canvas.line.append('"') if canvas.line else canvas.words('"')
        if name in BLOCK or (name == "text" and inside == "svg"):
            canvas.end_line(2 if name in SPACED and not (name in ("ul", "ol", "menu", "dir") and lists) else 1)
    return "\n".join(canvases[0].done()).replace("\xa0", " ")


def visible_text(html: str | None) -> str | None:
    """All visible text of a page; of a null page null, of an empty one the empty text."""
    return None if html is None else render(tree(html.replace("\x00", "")))


def extract(pages: DataFrame) -> DataFrame:
    """`pages(page_id, html, ...)` -> `(page_id, text)`, one row per input row: the visible text
    with a line per block, blank lines around paragraphs, headings, lists and tables, list
    markers with indents, and table cells in aligned columns; also what drawings, formulas, options
    and input fields show. Text is left out that the page's elements or style attributes hide, not
    what style sheets or scripts would. Null html gives a null text; html
    of any form and depth gives some text. Other columns aren't read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, column="html"):
            texts = [x if x is None else visible_text(x.decode()) for x in as_bytes(batch.column("html"))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, text string")
