"""HTML to text as a page would look: a tree with implied tags, visibility, layout.

``parse`` builds a tree by the rules that browsers follow for unclosed and
misplaced tags; ``render`` lays out what is visible: white space collapses but
in preformatted text, blocks stand apart, lists are indented and numbered, and
the cells of a table's columns are aligned.  Hidden are what stands in the
head, in scripts, styles, templates and the like, elements with ``hidden`` or
an inline style that hides them, and elements that a page's own style sheet
hides by a plain tag, class or id selector on a screen of usual size; rules of
such selectors override one another by importance, specificity and order.
Longer selectors are not read.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from .common import carried, column, restored, text_chunks, with_fields

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section "
    "summary table ul".split()
)
SPACED = frozenset("blockquote dir dl figure h1 h2 h3 h4 h5 h6 listing menu ol p pre table ul".split())
UNSEEN = frozenset(
    "applet area audio base canvas datalist embed frame head iframe link meta noembed noframes noscript object param "
    "script style svg template title track video".split()
)
CLOSES_P = BLOCK - frozenset("body dd dt html legend li optgroup option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("applet caption html marquee object table td template th".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: Elements that a formatting element's end tag doesn't close, and those that formatting doesn't reach into.
SPECIAL = BLOCK | frozenset("applet button caption marquee object select tbody td template tfoot th thead tr".split())
MARKERS = frozenset("applet caption marquee object td template th".split())

#: Elements nested deeper than this are laid beside one another, as browsers do.
MAX_DEPTH = 512
#: Range of a list item's number; most columns and rows of a cell.
INT32 = -(1 << 31), (1 << 31) - 1
MOST_ACROSS, MOST_DOWN = 1000, 65534
_WS = r" \t\n\f\r"
#: One attribute: a quote opens a value only right after the sign of equality.
_ATTR_TEXT = (
    rf"[^{_WS}/>][^{_WS}/>=]*+"
    rf"(?:[{_WS}]*+=[{_WS}]*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^{_WS}>\"'][^{_WS}>]*+)?)?"
)
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]+(?:>|\Z)|</>"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][^{_WS}/>]*+)(?P<attrs>(?:[{_WS}/]++|{_ATTR_TEXT})*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(
    rf"([^{_WS}/>][^{_WS}/>=]*+)(?:[{_WS}]*+=[{_WS}]*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^{_WS}>\"'][^{_WS}>]*+))?)?", re.S
)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_INTEGER = re.compile(rf"[{_WS}]*([+-]?[0-9]+)")
_DECLARED = re.compile(r"\s*(display|visibility)\s*:\s*([\w -]+?)\s*(!\s*important\s*)?", re.I)
_QUOTED = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
#: The screen that media queries are held against, in pixels, and the features it has.
SCREEN = {"width": 1280.0, "height": 800.0, "device-width": 1280.0, "device-height": 800.0}
TRAITS = {"orientation": "landscape", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "scripting": "enabled"}
_UNITS = {"": 1.0, "px": 1.0, "em": 16.0, "rem": 16.0, "pt": 4 / 3, "in": 96.0, "cm": 96 / 2.54, "mm": 9.6 / 2.54}
_SIMPLE = re.compile(r"[a-z][a-z0-9]*|[.#][\w-]+", re.I)
#: Where text does not stand, so that formatting does not go on there.
_NO_TEXT = frozenset("head table tbody thead tfoot tr colgroup select".split())
_CUT = {
    # an opening tag, the open elements that it closes, and those that stop the search
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "depth")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0

    def path(self) -> Iterator[Node]:
        """The node and what holds it, from within."""
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent

    def add(self, child: Node) -> Node:
        self.children.append(child)
        child.parent, child.depth = self, self.depth + 1
        return child


class _Formatting:
    """Formatting elements that go on where a block cuts them off, each with the marker element that bounds it."""

    def __init__(self) -> None:
        self.live: list[tuple[Node, Node | None]] = []

    def bound(self, at: Node) -> Node | None:
        """The innermost marker around ``at``; entries of one that is closed go."""
        marker = next((n for n in at.path() if n.tag in MARKERS), None)
        while self.live and self.live[-1][1] is not marker and self.live[-1][1] is not None:
            if marker is not None and any(n is self.live[-1][1] for n in marker.path()):
                break
            self.live.pop()
        return marker

    def add(self, node: Node, at: Node) -> None:
        marker = self.bound(at)
        alike = [x for x in self.live if x[1] is marker and x[0].tag == node.tag and x[0].attrs == node.attrs]
        if len(alike) >= 3:  # no more of the same go on
            self.live.remove(alike[0])
        self.live.append((node, marker))

    def drop(self, node: Node) -> None:
        self.live = [x for x in self.live if x[0] is not node]

    def resume(self, at: Node) -> Node:
        """Open again, within ``at``, what is live but closed; returns the innermost."""
        marker = self.bound(at)
        within: set[int] | None = None
        first = len(self.live)
        while first and self.live[first - 1][1] is marker:
            if within is None:
                within = {id(n) for n in at.path()}
            if id(self.live[first - 1][0]) in within:
                break
            first -= 1
        for k in range(first, len(self.live)):
            if at.depth + 1 >= MAX_DEPTH:
                break
            old = self.live[k][0]
            at = at.add(Node(old.tag, old.attrs, at))
            self.live[k] = (at, marker)
        return at

    def end(self, tag: str, at: Node) -> Node:
        """The end tag of a formatting element: blocks opened in it stay open, without it."""
        for _ in range(8):
            chain = []
            for node in at.path():
                if node.tag == tag or node.tag in SCOPES:
                    break
                chain.append(node)
            if node.tag != tag:
                return at
            cut = next((i for i in range(len(chain) - 1, -1, -1) if chain[i].tag in SPECIAL), None)
            if cut is None:
                self.drop(node)
                return node.parent
            block, between = chain[cut], chain[cut + 1 :]
            block.parent.children.pop()  # what is open is the last of its parent
            last = block
            for old in between:  # formatting between goes on around the block
                if any(x[0] is old for x in self.live):
                    new = Node(old.tag, old.attrs, None)
                    self.live = [(new if x is old else x, m) for x, m in self.live]
                    new.add(last)
                    last = new
            node.parent.add(last)
            inner = Node(tag, node.attrs, block)
            inner.children, block.children = block.children, [inner]
            for child in inner.children:
                if isinstance(child, Node):
                    child.parent = inner
            self.live = [(inner if x is node else x, m) for x, m in self.live]
            if at is block:
                at = inner
        return at


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        value = next((g for g in m.groups()[1:] if g is not None), "")
        out.setdefault(m[1].lower(), html.unescape(value))
    return out


def parse(text: str) -> tuple[Node, str]:
    """(root of the tree, the style sheets of the page)."""
    text = text.replace("\0", "")
    root = Node("html", {}, None)
    at, sheets, pos = root, [], 0
    formatting = _Formatting()

    def close(tags: frozenset[str], stops: frozenset[str]) -> bool:
        """Close the innermost open element of ``tags``, unless one of ``stops`` is within."""
        nonlocal at
        node = at
        while node is not root:
            if node.tag in tags:
                at = node.parent
                return True
            if node.tag in stops:
                return False
            node = node.parent
        return False

    def words(data: str) -> None:
        nonlocal at
        if data:
            if formatting.live and at.tag not in _NO_TEXT:
                at = formatting.resume(at)
            at.children.append(html.unescape(data))

    while pos < len(text):
        lt = text.find("<", pos)
        if lt < 0:
            words(text[pos:])
            break
        m = _TOKEN.match(text, lt)
        if not m:  # a bare < is text
            nxt = text.find("<", lt + 1)
            nxt = len(text) if nxt < 0 else nxt
            words(text[pos:nxt])
            pos = nxt
            continue
        words(text[pos:lt])
        pos = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            if tag in FORMATTING:
                at = formatting.end(tag, at)
            elif tag in HEADINGS:
                close(HEADINGS, SCOPES)
            elif tag == "br":
                at.children.append(Node("br", {}, at))
            elif tag == "p":
                if not close(frozenset(["p"]), SCOPES):
                    at.children.append(Node("p", {}, at))
            elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
                close(frozenset([tag]), frozenset(["table"]))
            elif tag == "li":
                close(frozenset(["li"]), SCOPES | {"ul", "ol"})
            elif tag not in ("html", "body", "head"):
                close(frozenset([tag]), frozenset() if tag == "table" else SCOPES)
            elif tag == "head":
                close(frozenset(["head"]), frozenset())
            continue
        attrs = _attributes(m["attrs"]) if m["attrs"] else {}
        if tag in ("html", "body"):
            close(frozenset(["head"]), frozenset())
            if tag == "body" and at is root:
                at = Node("body", attrs, at)
                root.children.append(at)
            continue
        if tag in ("head",) and at is not root:
            continue
        if at.tag == "head" and tag not in UNSEEN:
            at = at.parent
        if tag in CLOSES_P:
            close(frozenset(["p"]), SCOPES | {"button"})
        if tag in HEADINGS and at.tag in HEADINGS:
            at = at.parent
        if tag in _CUT:
            close(*_CUT[tag])
            if tag in ("li", "dt", "dd"):
                close(frozenset(["p"]), SCOPES | {"button", "ul", "ol", "dl", "div"})
        if tag == "a":
            at = formatting.end("a", at)
            marker = formatting.bound(at)
            formatting.live = [x for x in formatting.live if x[0].tag != "a" or x[1] is not marker]
        if formatting.live and tag not in SPECIAL and tag not in UNSEEN and tag not in VOID and at.tag not in _NO_TEXT:
            at = formatting.resume(at)
        if tag in ("tr", "td", "th") and at.tag == "table":
            at = _open("tbody", at)
        if tag in ("td", "th") and at.tag in ("tbody", "thead", "tfoot"):
            at = _open("tr", at)
        node = Node(tag, attrs, at)
        at.children.append(node)
        if tag in VOID or tag == "image":
            continue
        if tag in RAW or tag in RCDATA:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(text, pos)
            inner = text[pos : end.start() if end else len(text)]
            pos = end.end() if end else len(text)
            if tag == "style":
                if on_screen(attrs.get("media", "")):
                    sheets.append(inner)
            elif tag in RCDATA:
                node.children.append(html.unescape(inner))
            elif tag == "xmp":
                node.children.append(inner)
            continue
        if node.depth < MAX_DEPTH:
            if tag in FORMATTING:
                formatting.add(node, at)
            at = node
    return root, "\n".join(sheets)


def _open(tag: str, parent: Node) -> Node:
    node = Node(tag, {}, parent)
    parent.children.append(node)
    return node


def _length(text: str) -> float | None:
    m = re.fullmatch(r"([+-]?(?:\d+\.?\d*|\.\d+))([a-z]*)", text.strip())
    return float(m[1]) * _UNITS[m[2]] if m and m[2] in _UNITS else None


def _feature(text: str) -> bool | None:
    """Whether the screen has a media feature; null if it is not known."""
    name, colon, value = (x.strip() for x in text.partition(":"))
    if colon:
        bound, _, size = name.partition("-")
        if bound in ("min", "max") and size in SCREEN:
            limit = _length(value)
            return None if limit is None else SCREEN[size] >= limit if bound == "min" else SCREEN[size] <= limit
        if name in SCREEN:
            return _length(value) == SCREEN[name]
        return TRAITS[name] == value if name in TRAITS else None
    parts = [x.strip() for x in re.split(r"(<=|>=|<|>|=)", text)]
    if len(parts) == 1:
        return True if parts[0] in SCREEN else TRAITS[parts[0]] not in ("none", "no-preference") if parts[0] in TRAITS else None
    values = [SCREEN[x] if x in SCREEN else _length(x) for x in parts[::2]]
    if None in values:
        return None
    how = {"<=": float.__le__, ">=": float.__ge__, "<": float.__lt__, ">": float.__gt__, "=": float.__eq__}
    return all(how[o](x, y) for x, o, y in zip(values, parts[1::2], values[1:]))


def on_screen(queries: str) -> bool:
    """Whether a list of media queries holds for a screen of usual size; a query that is not understood does not."""
    if not queries.strip():
        return True
    for query in queries.lower().split(","):
        m = re.fullmatch(r"\s*(not\s+|only\s+)?([a-z-]+)?\s*((?:(?:\band\b)?\s*\([^()]*\)\s*)*)", query)
        if not m or not (m[2] or m[3].strip()):
            continue
        held = [m[2] in (None, "all", "screen"), *map(_feature, re.findall(r"\(([^()]*)\)", m[3]))]
        if None not in held and all(held) != bool(m[1] and m[1].startswith("not")):
            return True
    return False


def _declared(text: str, rank: int, order: int) -> dict[str, tuple[bool, int, int, bool]]:
    """What declarations say of display and visibility: (important, rank, order, hides), the one that wins."""
    out: dict[str, tuple[bool, int, int, bool]] = {}
    for part in text.split(";"):
        if m := _DECLARED.fullmatch(part):
            name, value = m[1].lower(), m[2].lower()
            said = (bool(m[3]), rank, order, value == "none" if name == "display" else value in ("hidden", "collapse"))
            if name not in out or said[:3] >= out[name][:3]:
                out[name] = said
    return out


def hidden_by(sheets: str) -> dict[str, dict[str, tuple[bool, int, int, bool]]]:
    """Plain selectors (tag, .class, #id) with what a style sheet says of their display and visibility; none if it hides nothing."""
    sheets = _QUOTED.sub("''", re.sub(r"/\*.*?(?:\*/|\Z)|<!--|-->", " ", sheets, flags=re.S))
    out: dict[str, dict[str, tuple[bool, int, int, bool]]] = {}
    # open blocks: a group of rules, a rule (its selectors and declarations) or one to skip
    open_: list[tuple[str, str, list[str]]] = []
    pos = order = 0

    def end() -> None:
        nonlocal order
        kind, selectors, body = open_.pop()
        if kind != "rule":
            return
        order += 1
        for s in map(str.strip, selectors.split(",")):
            if _SIMPLE.fullmatch(s):
                have = out.setdefault(s if s[0] in ".#" else s.lower(), {})
                for name, said in _declared(";".join(body), {".": 1, "#": 2}.get(s[0], 0), order).items():
                    have[name] = max(have.get(name, said), said)

    for m in re.finditer(r"[{};]", sheets):
        part, pos = sheets[pos : m.start()].strip(), m.end()
        kind = open_[-1][0] if open_ else "group"
        if m[0] == "{":
            name, _, rest = part.partition(" ") if "(" not in part.partition(" ")[0] else (part[: part.index("(")], "", part[part.index("(") :])
            if kind != "group":
                made = "skip"
            elif not part.startswith("@"):
                made = "rule"
            elif name.lower() == "@media":
                made = "group" if on_screen(rest) else "skip"
            elif name.lower() == "@supports":
                made = "skip" if rest.strip().lower().startswith("not") else "group"
            else:
                made = "group" if name.lower() == "@layer" else "skip"
            open_.append((made, part, []))
        elif kind == "rule":
            open_[-1][2].append(part)
        if m[0] == "}" and open_:
            end()
    if open_ and open_[-1][0] == "rule":
        open_[-1][2].append(sheets[pos:])
    while open_:
        end()
    return out if any(said[3] for have in out.values() for said in have.values()) else {}


def fate(node: Node, hidden: dict[str, dict[str, tuple[bool, int, int, bool]]] | None = None) -> tuple[bool, bool | None]:
    """(whether an element is laid out, whether its own text shows; null: as that around it)."""
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False, None
    said = [_declared(a["style"], 3, 0)] if "style" in a else []
    if hidden:
        said += [hidden[s] for s in (node.tag, "#" + a.get("id", ""), *("." + c for c in a.get("class", "").split())) if s in hidden]
    hides = {name: max(x[name] for x in said if name in x)[3] for name in ("display", "visibility") if any(name in x for x in said)}
    laid = not hides.get("display") and not (node.tag == "dialog" and "open" not in a)
    return laid, not hides["visibility"] if "visibility" in hides else None


def width(line: str) -> int:
    """Columns that a line takes: wide characters two, combining marks none."""
    if line.isascii():
        return len(line)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


class _Flow:
    """Lines of one box; ``gap`` is the number of line ends due before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.run: list[str] = []
        self.gap, self.space = 0, False

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *more = data.replace("\r\n", "\n").expandtabs().split("\n")
            self._put(first, False)
            for line in more:
                self.line()
                self._put(line, False)
            return
        data = _SPACE.sub(" ", data)
        if data.startswith(" "):
            self.space = True
        body = data.strip(" ")
        if body:
            self._put(body, self.space)
            self.space = data.endswith(" ")

    def _put(self, body: str, space: bool) -> None:
        if not body:
            return
        if self.gap:
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
        if space and self.run:
            self.run.append(" ")
        self.run.append(body)
        self.space = False

    def line(self) -> None:
        """End the line, even an empty one."""
        if self.gap and not self.run:
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
        self.lines.append("".join(self.run).rstrip())
        self.run, self.space = [], False

    def block(self, gap: int) -> None:
        """End the line if there is one; ``gap`` line ends are due."""
        if self.run:
            self.lines.append("".join(self.run).rstrip())
            self.run, self.gap = [], 0
        self.space = False
        self.gap = max(self.gap, gap)

    def box(self, lines: list[str]) -> None:
        """Lines laid out already."""
        if lines:
            if self.gap and self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.lines += lines

    def done(self) -> list[str]:
        self.block(0)
        lines = self.lines
        while lines and not lines[0].strip():
            lines = lines[1:]
        while lines and not lines[-1].strip():
            lines = lines[:-1]
        return lines


def _number(text: str | None, default: int, low: int, high: int) -> int:
    m = _INTEGER.match(text or "")
    return min(high, max(low, int(m[1][:20]))) if m else default


class _Painter:
    def __init__(self, hidden: dict[str, dict[str, tuple[bool, int, int, bool]]]) -> None:
        self.hidden, self.show = hidden, True

    def enter(self, node: Node) -> bool | None:
        """Null if an element is not laid out; else whether text showed so far, to be put back behind the element."""
        laid, shows = fate(node, self.hidden)
        before = self.show
        if laid and shows is not None:
            self.show = shows
        return before if laid else None

    def text(self, data: str, flow: _Flow, pre: bool) -> None:
        if self.show:
            flow.text(data, pre)

    def lines(self, node: Node, pre: bool = False) -> list[str]:
        flow = _Flow()
        self.children(node, flow, pre)
        return flow.done()

    def children(self, node: Node, flow: _Flow, pre: bool) -> None:
        for child in node.children:
            if isinstance(child, str):
                self.text(child, flow, pre)
            elif (before := self.enter(child)) is not None:
                self.element(child, flow, pre)
                self.show = before

    def element(self, node: Node, flow: _Flow, pre: bool) -> None:
        tag = node.tag
        if tag == "br":
            flow.line()
        elif tag == "hr":
            flow.block(1)
            flow.box(["---"] if self.show else [])
            flow.gap = 1
        elif tag == "table":
            self.framed(self.table(node), flow)
        elif tag in ("ul", "ol", "menu", "dir"):
            self.framed(self.items(node, pre), flow, 1 if _within(node, ("li",)) else 2)
        elif tag == "blockquote":
            self.framed(["  " + x if x else x for x in self.lines(node, pre)], flow)
        elif tag == "dd":
            self.framed(["  " + x if x else x for x in self.lines(node, pre)], flow, 1)
        elif tag in BLOCK or tag in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption"):
            gap = 2 if tag in SPACED else 1
            flow.block(gap)
            inner = pre or tag in ("pre", "listing", "xmp") or "white-space:pre" in node.attrs.get("style", "").replace(" ", "").lower()
            if inner and not pre and node.children and isinstance(node.children[0], str):
                node.children[0] = node.children[0].removeprefix("\n")
            self.children(node, flow, inner)
            flow.block(gap)
        elif tag == "q":
            self.text('"', flow, pre)
            self.children(node, flow, pre)
            self.text('"', flow, pre)
        elif tag == "input":
            if node.attrs.get("type", "text").lower() in ("submit", "reset", "button", "text") and node.attrs.get("value"):
                self.text(node.attrs["value"], flow, pre)
        else:
            self.children(node, flow, pre or tag in ("textarea", "xmp"))

    def framed(self, lines: list[str], flow: _Flow, gap: int = 2) -> None:
        flow.block(gap)
        flow.box(lines)
        if lines:
            flow.gap = gap

    def items(self, node: Node, pre: bool) -> list[str]:
        """A list: items behind bullets or numbers, other children as they are, indented."""
        out, ordered = [], node.tag == "ol"
        step = -1 if "reversed" in node.attrs else 1
        count = sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
        n = _number(node.attrs.get("start"), count if step < 0 else 1, *INT32)
        flow = _Flow()

        def loose() -> None:
            nonlocal flow
            out.extend("  " + x if x else x for x in flow.done())
            flow = _Flow()

        for child in node.children:
            if isinstance(child, str):
                self.text(child, flow, pre)
                continue
            if child.tag == "li":
                loose()
                n = _number(child.attrs.get("value"), n, *INT32)
                mark = f"{n}. " if ordered else "- "
                n += step
            if (before := self.enter(child)) is None:
                continue
            if child.tag == "li":
                lines = self.lines(child, pre)
                out += [(mark if i == 0 else " " * len(mark)) + x if x or i == 0 else x for i, x in enumerate(lines)]
            else:
                self.element(child, flow, pre)
            self.show = before
        loose()
        return out

    def table(self, node: Node) -> list[str]:
        """Captions and other text first, then the rows, their columns aligned."""
        before, rows, foot, outside = _Flow(), [], [], self.show
        todo = [(c, node.tag, outside) for c in reversed(node.children)]
        while todo:
            child, inside, self.show = todo.pop()
            if isinstance(child, str):
                self.text(child, before, False)
            elif self.enter(child) is None:
                continue
            elif child.tag == "tr":
                (foot if inside == "tfoot" else rows).append((child, self.show))
            elif child.tag in ("tbody", "thead", "tfoot"):
                todo += [(c, child.tag, self.show) for c in reversed(child.children)]
            elif child.tag not in ("col", "colgroup"):
                self.element(child, before, False)
                before.block(1)
        grid: list[dict[int, list[str]]] = []
        wide: dict[int, int] = {}
        spans: list[tuple[int, int, int, int]] = []
        taken: dict[int, int] = {}  # of a column, the first row that no cell above reaches
        for r, (row, shows) in enumerate(rows + foot):
            cells: dict[int, list[str]] = {}
            loose, col = _Flow(), 0
            for child in row.children:
                self.show = shows
                if isinstance(child, str):
                    self.text(child, loose, False)
                elif self.enter(child) is None:
                    continue
                elif child.tag not in ("td", "th"):
                    self.element(child, loose, False)
                else:
                    while taken.get(col, 0) > r:
                        col += 1
                    lines = self.lines(child)
                    across, down = _number(child.attrs.get("colspan"), 1, 1, MOST_ACROSS), _number(child.attrs.get("rowspan"), 1, 1, MOST_DOWN)
                    cells[col] = lines
                    need = max([0, *map(width, lines)])
                    if across == 1:
                        wide[col] = max(wide.get(col, 0), need)
                    else:
                        spans.append((across, col, need, r))
                    if down > 1:
                        taken.update((col + j, max(taken.get(col + j, 0), r + down)) for j in range(across))
                    col += across
            before.box(loose.done())
            grid.append(cells)
        self.show = outside
        for across, col, need, _ in sorted(spans):
            have = sum(wide.get(col + j, 0) for j in range(across)) + 2 * (across - 1)
            if need > have:
                wide[col + across - 1] = wide.get(col + across - 1, 0) + need - have
        columns = sorted({*wide, *(c for row in grid for c in row)})
        start, at = {}, 0
        for c in columns:
            start[c] = at
            at += wide.get(c, 0) + 2
        out = before.done()
        for cells in grid:
            for k in range(max([0, *map(len, cells.values())])):
                line = ""
                for c in sorted(cells):
                    if k < len(cells[c]) and cells[c][k]:
                        line += " " * (start[c] - width(line)) + cells[c][k]
                out.append(line.rstrip())
        return out


def _within(node: Node, tags: tuple[str, ...]) -> bool:
    return node.parent is not None and node.parent.tag in tags


def render(text: str | None) -> str:
    """All visible text of a page; null is empty."""
    if not text:
        return ""
    root, sheets = parse(text)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * MAX_DEPTH))
    lines = _Painter(hidden_by(sheets)).lines(root)
    return "\n".join(x.rstrip() for x in lines)


def title(root: Node) -> str:
    todo: list[Node] = [root]
    while todo:
        node = todo.pop()
        if node.tag == "title":
            return _SPACE.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip()
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return ""


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without ``html_col``, with ``text_col`` and ``n_lines``.

    Rows: a null or empty page has an empty text and no line; anything else is
    a page, however broken; all rows and other columns stay, but a column that
    bears a new name is replaced.
    """
    names, cols = carried(pages, html_col, text_col, "n_lines")
    plain = pages.select(*cols, column(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "html"):
            texts = [render(x) for x in batch.column("html").to_pylist()]
            lines = [x.count("\n") + 1 if x else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(lines, pa.int64())], names=[*batch.schema.names[:-1], "text", "n"])

    out = plain.mapInArrow(run, with_fields(plain.drop("html"), StructField("text", StringType()), StructField("n", LongType())))
    return out.select(*restored(names), F.col("text").alias(text_col), F.col("n").alias("n_lines"))
