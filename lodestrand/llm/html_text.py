"""HTML extraction: a tree with implied tags, visibility rules, and a rendering that keeps blocks, lists and tables apart."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready, tidy

#: Fixed lists of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title meta link datalist object iframe audio video canvas svg math map param source track".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr caption ul".split())
#: Blocks that an empty line parts from their neighbours.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol menu dl table figure form fieldset article section".split())
#: A start tag of one of the elements ends the open ones that it implies the end of, up to a boundary.
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
SCOPES = frozenset("table td th caption html object template".split())

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
WHITE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []


class Open:
    """The open elements, and for each name where they stand, so that no tag walks all that are open."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, names) -> int:
        """The place of the innermost open element of these names; 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def close(self, names, limits) -> bool:
        """Ends the innermost element of these names and all in it, unless one of limits is further in."""
        at = self.last(names)
        if not at or at < self.last(limits):
            return False
        for node in reversed(self.stack[at:]):
            self.places[node.name].pop()
        del self.stack[at:]
        return True


def tree(page: str) -> Node:
    """The elements of a page. Text nodes are strings; end tags that close nothing are ignored, open elements end with the page."""
    root = Node("html", {})
    open_ = Open(root)
    stack, at = open_.stack, 0
    text = lambda s: s and stack[-1].children.append(html.unescape(s) if "&" in s else s)

    while (m := MARKUP.search(page, at)) is not None:
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "p" and not open_.last(("p",)):
                stack[-1].children.append(Node("p", {}))
            elif name == "br":
                stack[-1].children.append(Node("br", {}))
            else:
                open_.close((name,), SCOPES - {name} if name in SCOPES else SCOPES)
            continue
        attributes = {}
        for a in ATTRIBUTE.finditer(m[3] or ""):
            attributes.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
        if name in ("html", "body"):
            stack[0].attributes = attributes | stack[0].attributes
            continue
        if name in ENDS_P:
            open_.close(("p",), SCOPES)
        if name in IMPLIED:
            ended, limits = IMPLIED[name]
            while open_.close(ended, limits):
                pass
        if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
            stack[-1].children.append(row := Node("tr", {}))
            open_.push(row)
        node = Node(name, attributes)
        stack[-1].children.append(node)
        if name in VOID or (m[3] or "").endswith("/") and name in ("path", "circle"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            inner = page[at : end.start()] if end else page[at:]
            node.children.append(html.unescape(inner) if name in ("textarea", "title") else inner)
            at = len(page) if end is None else (page.find(">", end.end()) + 1 or len(page))
            continue
        open_.push(node)
    text(page[at:])
    return root


def hiding_rules(root: Node) -> set[str]:
    """Simple selectors (tag, .class, #id, tag.class) that the page's style sheets hide."""
    found, todo = set(), [root]
    while todo:
        n = todo.pop()
        if n.name == "style":
            for selectors, body in RULE.findall(re.sub(r"/\*.*?\*/", "", "".join(n.children), flags=re.S)):
                if NOT_SHOWN.search(body):
                    found.update(s.strip() for s in selectors.split(",") if re.fullmatch(r"[\w-]*[.#]?[\w-]+", s.strip()))
        todo += (c for c in n.children if isinstance(c, Node))
    return found


def shown(n: Node, rules: set[str]) -> bool:
    a = n.attributes
    if n.name in HIDDEN or "hidden" in a or n.name == "input" and a.get("type", "").lower() == "hidden" or NOT_SHOWN.search(a.get("style", "")):
        return False
    if rules:
        names = ["", n.name]
        marks = ["." + c for c in a.get("class", "").split()] + (["#" + a["id"]] if a.get("id") else [])
        return not (n.name in rules or any(p + m in rules for p in names for m in marks))
    return True


def width(s: str) -> int:
    """Columns of a terminal: wide characters take two, combining ones none."""
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Page:
    """Lines of text as blocks put them. gap: empty lines due before the next line."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.fresh = False
        self.gap = 0

    def say(self, s: str, pre: bool = False) -> None:
        if pre:
            parts = s.replace("\r\n", "\n").split("\n")
            for i, part in enumerate(parts):
                if i:
                    self.end(True)
                if part:
                    self.line.append(part)
            return
        words = WHITE.sub(" ", s)
        if words[:1] == " ":
            self.space, words = True, words[1:]
        if not words:
            return
        if self.space and self.line and self.line[-1][-1:] != " ":
            self.line.append(" ")
        self.space = words[-1] == " "
        self.line.append(words.rstrip(" ") if self.space else words)

    def end(self, always: bool = False) -> None:
        made = "".join(self.line).rstrip()
        self.line, self.space = [], False
        if made or always and self.lines and not self.gap:
            if self.lines and made:
                self.lines += [""] * self.gap
            self.gap = 0 if made else self.gap
            self.lines.append(made)

    def block(self, gap: int) -> None:
        self.end()
        if self.lines:
            self.gap = max(self.gap, gap)


def render(page: str) -> str:
    """All visible text of a page.

    White space collapses but in pre. Blocks begin lines; paragraphs, headings, lists and tables stand apart by an empty
    line. List items have a mark or number, nested ones are set in. Table cells are padded to their columns' widths, two
    spaces apart; cells of several lines go line by line; nested tables are rendered within their cell.
    """
    root = tree(page)
    rules = hiding_rules(root) if "<style" in page.lower() else set()
    return "\n".join(_lines(root.children, rules, 0)).strip("\n")


DEPTH = 200


def _lines(children: list, rules: set[str], depth: int) -> list[str]:
    out = Page()
    # what is still to do, last first: a node or text to render, or a call
    todo: list = [(c, False) for c in reversed(children)]
    while todo:
        item, pre = todo.pop()
        if callable(item):
            item()
            continue
        if isinstance(item, str):
            out.say(item, pre)
            continue
        name = item.name
        if not shown(item, rules):
            continue
        if name == "br":
            out.end(True)
        elif name == "hr":
            out.block(1)
        elif name == "input":
            if item.attributes.get("type", "text").lower() not in ("checkbox", "radio", "password", "file", "range", "color", "image"):
                out.say(" " + item.attributes.get("value", "") + " ")
        elif name == "table" and depth < DEPTH:
            out.block(1)
            for line in _table(item, rules, depth + 1):
                out.line = [line]
                out.end()
            out.block(1)
        elif name in ("ul", "ol", "menu") and depth < DEPTH:
            out.block(1)
            number = int(item.attributes["start"]) if name == "ol" and re.fullmatch(r"-?\d{1,9}", item.attributes.get("start", "")) else 1
            for c in item.children:
                own = isinstance(c, Node) and c.name == "li"
                if isinstance(c, Node) and not shown(c, rules):
                    continue
                inner = [x for x in _lines(c.children if own else [c], rules, depth + 1) if x]
                mark = (f"{number}. " if name == "ol" else "- ") if own else "  "
                number += own
                for i, line in enumerate(inner):
                    out.line = [(mark if not i else " " * len(mark)) + line]
                    out.end()
            out.block(1)
        elif name == "details" and "open" not in item.attributes:
            todo += [(c, pre) for c in reversed(item.children) if isinstance(c, Node) and c.name == "summary"]
        else:
            if name in BLOCK:
                gap = 1 if name in SPACED else 0
                out.block(gap)
                todo.append(((lambda gap=gap: out.block(gap)), False))
            elif name in ("q",):
                out.say('"')
                todo.append(((lambda: out.line.append('"')), False))
            todo += [(c, pre or name in ("pre", "textarea", "xmp")) for c in reversed(item.children)]
    out.end()
    return out.lines


def _table(table: Node, rules: set[str], depth: int) -> list[str]:
    before, rows = [], []
    todo = list(reversed(table.children))
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            if n.strip():
                before += _lines([n], rules, depth)
        elif not shown(n, rules):
            continue
        elif n.name in ("tbody", "thead", "tfoot"):
            todo += reversed(n.children)
        elif n.name == "tr":
            cells = []
            for c in n.children:
                if isinstance(c, Node) and c.name in ("td", "th"):
                    span = c.attributes.get("colspan", "1")
                    inner = [x for x in _lines(c.children, rules, depth) if x] if shown(c, rules) else None
                    if inner is not None:
                        cells.append((inner, min(int(span), 1000) if re.fullmatch(r"[1-9]\d{0,3}", span) else 1))
                elif isinstance(c, Node) or c.strip():
                    before += _lines([c], rules, depth)
            rows.append(cells)
        else:
            before += _lines([n] if n.name != "caption" else n.children, rules, depth)
    widths: dict[int, int] = {}
    for cells in rows:
        at = 0
        for lines, span in cells:
            if span == 1:
                widths[at] = max(widths.get(at, 0), *(width(x) for x in lines), 0) if lines else widths.get(at, 0)
            at += span
    out = [x for x in before if x]
    for cells in rows:
        for i in range(max((len(lines) for lines, _ in cells), default=0)):
            line, at = "", 0
            for lines, span in cells:
                part = lines[i] if i < len(lines) else ""
                room = sum(widths.get(k, 0) for k in range(at, at + span)) + 2 * (span - 1)
                line += part + " " * (max(0, room - width(part)) + 2)
                at += span
            out.append(line.rstrip())
    return out


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            text = [None if p is None else render(p) for p in part.column("html").to_pylist()]
            yield pa.record_batch([part.column("row"), pa.array(text, pa.string())], names=["row", "text"])


def extract_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(row, text) per row of pages(html, ...): the columns `keep`, and the page's visible text.

    A null page has a null text, an empty or invisible one an empty text; pages are dealt with one by one, so repeated
    rows and empty tables are nothing special; columns that aren't kept aren't read. Broken markup never fails: see `tree`.
    """
    ready(pages.sparkSession)
    rows = pages.select(F.struct(*(pages[c] for c in keep)).alias("row"), pages["html"].cast("string").alias("html"))
    return rows.mapInArrow(tidy(_rendered), T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
