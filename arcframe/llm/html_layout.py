"""Layout-aware text of web pages.

A tokenizer and tree builder read the markup as browsers do where it matters for text: implied end tags,
raw-text elements, void elements. Visibility rules drop what isn't shown. What is left is laid out in
lines: collapsed white space, blank lines where blocks have margins, list markers and indentation, and
table cells in aligned columns.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# Names and roles of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE_RAW = frozenset("textarea title".split())
NEVER_SHOWN = frozenset("head script style template title iframe noembed noframes datalist audio video canvas object map rp colgroup".split())
#: Blocks, with the blank lines that their margins make.
BLOCKS = dict.fromkeys("address article aside body center details dialog dd div dt fieldset footer form header hgroup html legend li main nav optgroup option search section summary caption tr thead tbody tfoot menu".split(), 0)
BLOCKS |= dict.fromkeys("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul listing xmp plaintext".split(), 1)
CLOSES_P = frozenset(BLOCKS) - frozenset("body caption html legend option optgroup tbody td tfoot th thead tr".split())
#: What an opening tag closes first, and the elements beyond which it doesn't look for them.
IMPLIED_END = {
    "li": ({"li"}, {"ol", "ul", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
#: Elements that an end tag of something inside doesn't reach through.
SCOPES = frozenset("table td th caption template html".split())
LIST = frozenset(("ul", "ol", "menu"))

#: The depth at which browsers put elements beside each other, and the largest spans of a cell.
DEEPEST, MOST_COLUMNS, MOST_ROWS = 512, 1000, 65534
#: A table is aligned with so many blanks for each of its characters, and so many more, at most. Its widest columns
#: are padded less where it takes more than that, so that the text is bounded by the page.
BLANKS, MORE_BLANKS = 16, 20_000

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
TAG_END = re.compile(r"[\s/]*>")
SPACE = re.compile(r"[ \t\n\f\r]+")
HIDING = re.compile(r"(?:^|[;{\s])(display|visibility|white-space|content-visibility)\s*:\s*([a-z-]+)", re.I)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
SELECTOR = re.compile(r"([a-z][a-z0-9]*|\*)?((?:[.#][\w-]+)*)\Z", re.I)


@dataclass(slots=True)
class Node:
    """An element: its name, attributes and children, which are elements and texts."""

    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


def tokens(html: str) -> Iterator[tuple]:
    """("text", s), ("open", name, attributes), ("close", name), in order. Each character is looked at a bounded number of times."""
    at, n = 0, len(html)
    while at < n:
        less = html.find("<", at)
        if less < 0:
            yield "text", html[at:]
            return
        if less > at:
            yield "text", html[at:less]
        follows = html[less + 1 : less + 2]
        if follows == "!":
            if html.startswith("<!--", less):
                if html.startswith((">", "->"), less + 4):
                    end = html.find(">", less)
                    at = end + 1
                    continue
                end = html.find("-->", less + 4)
                at = n if end < 0 else end + 3
            elif html.startswith("<![CDATA[", less):
                end = html.find("]]>", less)
                yield "text", html[less + 9 : n if end < 0 else end].replace("&", "&amp;")
                at = n if end < 0 else end + 3
            else:
                end = html.find(">", less)
                at = n if end < 0 else end + 1
            continue
        closing = follows == "/"
        m = NAME.match(html, less + 1 + closing)
        if m is None:
            if follows == "?" or closing and less + 2 < n:  # bogus comments
                end = html.find(">", less)
                at = n if end < 0 else end + 1
            else:
                yield "text", "&lt;"
                at = less + 1
            continue
        name, at, attributes = m[0].lower(), m.end(), {}
        while not (end := TAG_END.match(html, at)):
            m = ATTRIBUTE.match(html, at)
            if m is None or m.end() == at or (m[2] is None and m[3] is None and m[4] is None and html[m.end() : m.end() + 1] == "="):
                # no such attribute can be read: an open quote swallows the rest, other signs are skipped
                rest = SPACE.match(html, html.find("=", at) + 1) if m is not None and m.end() > at else None
                quote = html[(rest.end() if rest else html.find("=", at) + 1) :][:1] if m is not None and m.end() > at else ""
                if quote and quote in "\"'" or at >= n or m is None and html.find(">", at) < 0:
                    return
                at = (m.end() if m is not None else at) + 1
                continue
            attributes.setdefault(m[1].lower(), unescape(next((v for v in m.group(2, 3, 4) if v is not None), "")))
            at = m.end()
            if at >= n:
                return
        at = end.end()
        if closing:
            yield "close", name
            continue
        yield "open", name, attributes
        if name == "plaintext":
            yield "text", html[at:].replace("&", "&amp;")
            return
        if name in RAW or name in ESCAPABLE_RAW:
            m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            end = m.start() if m else n
            yield "text", html[at:end] if name in ESCAPABLE_RAW else html[at:end].replace("&", "&amp;")
            yield "close", name
            end = html.find(">", end)
            at = n if end < 0 else end + 1


def build(html: str) -> Node:
    """The tree of a page, with the ends of elements that tags imply."""
    root = Node("html")
    stack, names = [root], ["html"]

    def close(name: str, scopes: frozenset | set) -> bool:
        for i in range(len(names) - 1, 0, -1):
            if names[i] == name:
                del stack[i:], names[i:]
                return True
            if names[i] in scopes:
                return False
        return False

    for token in tokens(html):
        kind = token[0]
        if kind == "text":
            stack[-1].children.append(unescape(token[1]) if "&" in token[1] else token[1])
        elif kind == "open":
            name, attributes = token[1], token[2]
            if name == "html":
                root.attributes = attributes | root.attributes
                continue
            if name == "body" or (name not in ("head", "meta", "link", "base", "title", "style", "script", "noscript", "template") and len(names) > 1 and names[1] == "head" and names[-1] == "head"):
                close("head", set())
            if name in IMPLIED_END:
                ends, until = IMPLIED_END[name]
                for i in range(len(names) - 1, 0, -1):
                    if names[i] in ends:
                        del stack[i:], names[i:]
                        if name not in ("tr", "thead", "tbody", "tfoot"):
                            break
                    elif names[i] in until or (names[i] in SCOPES and name in ("li", "dt", "dd")):
                        break
            if name in CLOSES_P:
                close("p", SCOPES | {"button"})
            if name in ("a", "button", "nobr") and name in names:
                close(name, SCOPES)
            if name[0] == "h" and name in ("h1", "h2", "h3", "h4", "h5", "h6") and names[-1] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                del stack[-1:], names[-1:]
            node = Node("img" if name == "image" else name, attributes)
            stack[-1].children.append(node)
            if name not in VOID and len(stack) < DEEPEST:
                stack.append(node)
                names.append(name)
        else:
            name = token[1]
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif name == "p" and not close("p", SCOPES | {"button"}):
                stack[-1].children.append(Node("p"))
            elif name not in ("html", "body", "p"):
                close(name, {"table"} if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else SCOPES if name != "table" else frozenset())
    return root


# --- visibility ------------------------------------------------------------------------------------------


def declared(css: str) -> dict[str, str]:
    return {k.lower(): v.lower() for k, v in HIDING.findall(css)}


def sheet_rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a style sheet, in one pass. What is in blocks of @-rules, such as those for
    print, doesn't count, nor do rules nested in others."""
    start, depth, skipped, selectors, body, end = 0, 0, False, "", 0, -1
    css = COMMENT.sub("", css)
    for m in re.finditer("[{};]", css):
        sign, at = m[0], m.start()
        if sign == "{":
            if depth == 0:
                selectors = css[start:at].strip()
                skipped, body, end = selectors.startswith("@"), at + 1, -1
            elif depth == 1 and end < 0:
                end = start  # declarations end where the first nested rule begins
            depth += 1
        elif sign == "}" and depth:
            depth -= 1
            if depth == 0 and not skipped:
                yield selectors, css[body : at if end < 0 else end]
        start = at + 1


def rules(root: Node) -> list[tuple[str, set[str], dict[str, str]]]:
    """(element or '', classes and ids, what is declared) of the simple selectors in the page's style sheets that bear on visibility."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
        if node.name != "style":
            continue
        for selectors, body in sheet_rules("".join(c for c in node.children if isinstance(c, str))):
            if said := declared(body):
                for s in selectors.split(","):
                    if m := SELECTOR.match(s.strip()):
                        found.append(((m[1] or "*").lower().replace("*", ""), set(re.findall(r"[.#][\w-]+", m[2])), said))
    return found


class Style:
    """What the attributes and style sheets say of an element."""

    def __init__(self, root: Node) -> None:
        # what the same selector says later of the same property holds in any case
        last = {(name, frozenset(needed), said): i for i, (name, needed, what) in enumerate(rules(root)) if name or needed for said in what.items()}
        final: dict[tuple, tuple[int, str]] = {}
        for (name, needed, (key, value)), i in sorted(last.items(), key=lambda x: x[1]):
            final[name, needed, key] = i, value
        self.rules = sorted(((i, name, needed, key, value) for (name, needed, key), (i, value) in final.items()), key=lambda r: r[0])
        uses = Counter(mark for _, _, needed, _, _ in self.rules for mark in needed)
        #: The rules' numbers, by the rarest class or id that they need, else by their element.
        self.by: dict[str, list[int]] = {}
        for n, (_, name, needed, _, _) in enumerate(self.rules):
            self.by.setdefault(min(needed, key=lambda mark: (uses[mark], mark)) if needed else name, []).append(n)

    def of(self, node: Node) -> dict[str, str]:
        attributes = node.attributes
        said: dict[str, str] = {}
        if self.rules:
            marks = {"." + c for c in attributes.get("class", "").split()} | ({"#" + attributes["id"]} if "id" in attributes else set())
            for i in sorted(i for mark in (*marks, node.name) for i in self.by.get(mark, ())):
                _, name, needed, key, value = self.rules[i]
                if name in ("", node.name) and needed <= marks:
                    said[key] = value
        if "hidden" in attributes and attributes["hidden"].lower() != "until-found":
            said.setdefault("display", "none")
        return said | declared(attributes["style"]) if "style" in attributes else said


# --- layout ------------------------------------------------------------------------------------------------


class Lines:
    """Collects inline text into lines, and keeps the blank lines that margins ask for."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = True  # a collapsed blank at the end, or the start of a line
        self.margin = 0

    def text(self, s: str) -> None:
        """Text with its white space collapsed across elements."""
        s = SPACE.sub(" ", s)
        if self.space:
            s = s.lstrip(" ")
        if s:
            self._margin()
            self.parts.append(s)
            self.space = s.endswith(" ")

    def pre(self, s: str) -> None:
        first, *rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self._margin()
            self.parts.append(first)
            self.space = False
        for line in rest:
            self.newline()
            if line:
                self.parts.append(line)
                self.space = False

    def _margin(self) -> None:
        if self.margin and self.lines and not self.parts:
            self.lines += [""] * self.margin
        self.margin = 0

    def newline(self) -> None:
        self._margin()
        self.lines.append("".join(self.parts).rstrip(" "))
        self.parts, self.space = [], True

    def edge(self, margin: int = 0) -> None:
        """The edge of a block: ends the line, and margins that meet collapse into the largest."""
        if "".join(self.parts).strip(" "):
            self.newline()
        self.parts, self.space = [], True
        self.margin = max(self.margin, margin)

    def block(self, lines: list[str], margin: int = 0) -> None:
        self.edge(margin)
        if lines:
            self._margin()
            self.lines += lines
        self.margin = max(self.margin, margin)

    def done(self) -> list[str]:
        self.edge()
        while self.lines and not self.lines[0].strip():
            self.lines.pop(0)
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        return self.lines


ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


def marker(n: int, kind: str) -> str:
    """An ordered list's marker for n: 1, a, A, i or I."""
    if kind in ("a", "A") and n > 0:
        s = ""
        while n:
            n, r = divmod(n - 1, 26)
            s = chr(97 + r) + s
    elif kind in ("i", "I") and 0 < n < 4000:
        s = ""
        for value, sign in ROMAN:
            s += sign * (n // value)
            n %= value
    else:
        return f"{n}. "
    return (s.upper() if kind.isupper() else s) + ". "


def _int(text: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?[0-9]{1,9})", text or "")
    return int(m[1]) if m else default


class Renderer:
    """Lays out a tree."""

    def __init__(self, root: Node) -> None:
        self.style = Style(root)
        self.tables = self.items = self.depth = 0
        self.root = root

    def lines(self) -> list[str]:
        out = Lines()
        self.children(self.root, out, False, True)
        return [line.replace("\xa0", " ").rstrip() for line in out.done()]

    def children(self, node: Node, out: Lines, pre: bool, shown: bool) -> None:
        for child in node.children:
            if isinstance(child, str):
                if shown:
                    out.pre(child) if pre else out.text(child)
            else:
                self.element(child, out, pre, shown)

    def element(self, node: Node, out: Lines, pre: bool, shown: bool) -> None:
        name = node.name
        if name in NEVER_SHOWN:
            return
        said = self.style.of(node) if node.attributes or self.style.rules else {}
        if said.get("display") == "none" or said.get("content-visibility") == "hidden":
            return
        if name == "dialog" and "open" not in node.attributes:
            return
        if "visibility" in said:
            shown = said["visibility"] not in ("hidden", "collapse")
        if "white-space" in said:
            pre = said["white-space"].startswith("pre") and said["white-space"] != "pre-line"
        if name == "br":
            if shown:
                out.newline()
        elif name == "hr":
            out.edge(1)
        elif name == "input":
            if shown and node.attributes.get("type", "text").lower() in ("text", "submit", "reset", "button", "search", "email", "url", "tel", "number"):
                out.text(node.attributes.get("value", ""))
        elif name in ("textarea", "pre", "listing", "xmp", "plaintext"):
            if node.children and isinstance(node.children[0], str) and node.children[0].startswith("\n"):
                node.children[0] = node.children[0][1:]
            out.edge(BLOCKS.get(name, 0))
            self.children(node, out, True, shown)
            out.edge(BLOCKS.get(name, 0))
        elif name == "table":
            inner = self.table(node, pre, shown)
            out.block(inner, 1)
        elif name in LIST:
            self.listing(node, out, pre, shown)
        elif name in ("blockquote", "dd", "figure"):
            inner = Lines()
            self.children(node, inner, pre, shown)
            out.block(["  " + line if line else "" for line in inner.done()], BLOCKS[name])
        elif name == "details" and "open" not in node.attributes:
            out.edge()
            for child in node.children:
                if isinstance(child, Node) and child.name == "summary":
                    self.element(child, out, pre, shown)
                    break
            out.edge()
        elif name == "li":  # outside of any list
            self.item(node, out, "* ", pre, shown)
        elif name in ("td", "th"):  # outside of any table
            self.children(node, out, pre, shown)
            out.text(" ")
        elif name in BLOCKS and said.get("display", "block") not in ("inline", "inline-block") or said.get("display") == "block":
            out.edge(BLOCKS.get(name, 0))
            self.children(node, out, pre, shown)
            out.edge(BLOCKS.get(name, 0))
        else:
            self.children(node, out, pre, shown)

    def item(self, node: Node, out: Lines, mark: str, pre: bool, shown: bool) -> None:
        inner = Lines()
        self.children(node, inner, pre, shown)
        lines = inner.done()
        if lines:
            self.items += 1
            blank = " " * len(mark)
            out.block([(blank if i else mark) + line if line else "" for i, line in enumerate(lines)])

    def listing(self, node: Node, out: Lines, pre: bool, shown: bool) -> None:
        entries = [c for c in node.children if isinstance(c, Node) and c.name == "li"]
        backwards = node.name == "ol" and "reversed" in node.attributes
        n = _int(node.attributes.get("start"), len(entries) if backwards else 1)
        inner, margin = Lines(), 0 if self.depth else 1  # lists in lists have no margins
        self.depth += 1
        for child in node.children:
            if isinstance(child, str):
                if shown:
                    inner.text(child)
            elif child.name == "li":
                said = self.style.of(child)
                if said.get("display") == "none":
                    continue
                n = _int(child.attributes.get("value"), n)
                mark = marker(n, child.attributes.get("type", node.attributes.get("type", "1"))) if node.name == "ol" else "* "
                visible = said["visibility"] not in ("hidden", "collapse") if "visibility" in said else shown
                self.item(child, inner, mark, pre, visible)
                n += -1 if backwards else 1
            else:
                self.element(child, inner, pre, shown)
        self.depth -= 1
        out.block(inner.done(), margin)

    def table(self, node: Node, pre: bool, shown: bool) -> list[str]:
        """Lines of a table: its caption, then rows whose cells start in the same columns."""
        captions, rows, loose = [], [], Lines()

        def walk(part: Node, visible: bool) -> None:
            for child in part.children:
                if isinstance(child, str):
                    if visible and child.strip():
                        loose.text(child)
                    continue
                said = self.style.of(child)
                if said.get("display") == "none":
                    continue
                seen = said["visibility"] not in ("hidden", "collapse") if "visibility" in said else visible
                if child.name == "caption":
                    inner = Lines()
                    self.children(child, inner, pre, seen)
                    captions.extend(inner.done())
                elif child.name == "tr":
                    rows.append((child, seen))
                elif child.name in ("thead", "tbody", "tfoot"):
                    walk(child, seen)
                elif child.name in ("td", "th"):
                    if not rows or rows[-1][0].name != "":
                        rows.append((Node(""), visible))
                    rows[-1][0].children.append(child)
                else:
                    self.element(child, loose, pre, visible)

        walk(node, shown)
        self.tables += 1
        held: list[tuple[int, int, int]] = []  # columns from, to that cells from rows above still cover, until which row
        grid: list[list[tuple[int, int, list[str]]]] = []
        for number, (row, visible) in enumerate(rows):
            column, line, over, fresh = 0, [], 0, []
            held = [h for h in held if h[2] > number]
            for cell in row.children:
                if isinstance(cell, str):
                    if visible and cell.strip():
                        loose.text(cell)
                    continue
                if cell.name not in ("td", "th"):
                    self.element(cell, loose, pre, visible)
                    continue
                said = self.style.of(cell)
                if said.get("display") == "none":
                    continue
                seen = said["visibility"] not in ("hidden", "collapse") if "visibility" in said else visible
                while over < len(held) and held[over][0] <= column:
                    column = max(column, held[over][1])
                    over += 1
                wide = min(max(_int(cell.attributes.get("colspan"), 1), 1), MOST_COLUMNS)
                high = min(max(_int(cell.attributes.get("rowspan"), 1), 0), MOST_ROWS) or len(rows)
                inner = Lines()
                self.children(cell, inner, pre, seen)
                line.append((column, wide, inner.done()))
                if high > 1:
                    until = min(number + high, len(rows))
                    if fresh and fresh[-1][1] == column and fresh[-1][2] == until:
                        fresh[-1] = (fresh[-1][0], column + wide, until)
                    else:
                        fresh.append((column, column + wide, until))
                column += wide
            held = _joined(held, fresh)
            grid.append(line)
        starts = sorted({c for line in grid for c, _, lines in line if lines})
        widths = dict.fromkeys(starts, 0)
        letters = 0
        for line in grid:
            for c, wide, lines in line:
                if lines:
                    letters += sum(map(len, lines))
                    after = bisect_right(starts, c)
                    if wide == 1 or after == len(starts) or starts[after] >= c + wide:
                        widths[c] = max(widths[c], max(map(len, lines)))
        widest = max(widths.values(), default=0)
        while True:
            place, at = {}, 0
            for c in starts:
                place[c] = at
                at += min(widths[c], widest) + 2
            # each line reaches to the last of its cells
            blanks = sum(max((place[c] for c, _, lines in line if lines), default=0) * max((len(lines) for _, _, lines in line), default=0) for line in grid)
            if blanks <= BLANKS * letters + MORE_BLANKS or not widest:
                break
            widest //= 2
        out = captions + loose.done()
        for line in grid:
            cells = [(place[c], lines) for c, _, lines in line if lines]
            for i in range(max((len(lines) for _, lines in cells), default=0)):
                s = ""
                for at, lines in cells:
                    if i < len(lines) and lines[i]:
                        s = s.ljust(at)
                        s += ("  " if s and not s.endswith(" ") else "") + lines[i]
                out.append(s.rstrip())
        return out


def _joined(held: list[tuple[int, int, int]], fresh: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Both lists in the order of columns, neighbours that end in the same row as one."""
    out: list[tuple[int, int, int]] = []
    for h in sorted([*held, *fresh]) if fresh else held:
        if out and out[-1][1] == h[0] and out[-1][2] == h[2]:
            out[-1] = (out[-1][0], h[1], h[2])
        else:
            out.append(h)
    return out


def render(html: str) -> tuple[str, int, int]:
    """Visible text of a page, its tables and its list items."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEEPEST))  # a few calls for each level of the tree
    renderer = Renderer(build(html))
    return "\n".join(renderer.lines()), renderer.tables, renderer.items


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Visible text of each whole page, laid out in lines.

    Returns id_col, text, n_lines, n_tables, n_items (list items), one row for each input row; one map, no
    shuffle. A null page gives a null text and zeros, an empty one an empty text. Markup that is broken off
    or nested too deep is read as far as it goes. Null and repeated ids pass through, an empty table gives
    no rows, other columns are left out.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            found = [(None, 0, 0) if (html := value.as_py()) is None else render(html) for value in batch.column(1)]
            texts = [t for t, _, _ in found]
            yield {"id": batch.column(0), "text": texts, "n_lines": [t.count("\n") + 1 if t else 0 for t in texts], "n_tables": [n for _, n, _ in found], "n_items": [n for _, _, n in found]}

        return each

    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    return map_batches(rows, make, f"id {kind}, text string, n_lines long, n_tables long, n_items long").withColumnRenamed("id", id_col)
