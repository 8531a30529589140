"""Layout-aware text of web pages (operator 8).

A tokeniser and a tree builder with implied tags (optional end tags, missing html, head, body and table parts, void elements, raw-text
elements, stray end tags, what does not belong in a table put before it) give a tree; style rules and attributes decide what is
visible; a renderer writes all visible text as a text browser would: blocks on lines of their own, a blank line where a block has
margins, list markers and indents by nesting, tables with their cells aligned in columns, pre-formatted text as it stands.

Cases: null or empty html gives the empty text; unclosed tags, comments, quotes and raw text end with the page; nesting of any depth,
of tables too, is walked without recursion and without looking through all open elements; cells stand in the columns that column and row
spans leave them; what is written is indented by MOST_INDENT columns at most; what one may type into a form field (textarea, input) is
not the page's text and not written; repeated rows alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession

from . import common as C

MOST_INDENT = 80
#: Element classes of the HTML standard (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link base datalist iframe noembed noframes object video audio canvas map textarea".split())
#: What SVG defines or says without showing it.
SVG_UNSEEN = frozenset("desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter".split())
MARGINS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr menu dir".split())
BLOCKS = MARGINS | frozenset("html body div article section nav aside header footer main address center form li dt dd details summary figcaption dialog hgroup legend search option optgroup tr thead tbody tfoot caption td th".split())
HEAD_ONLY = frozenset("title meta link base style script".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dt dd summary".split())
#: Which open elements a start tag ends, and where the search for them stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    **{k: ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}) for k in ("thead", "tbody", "tfoot", "caption", "colgroup")},
    "h1": ({"h1", "h2", "h3", "h4", "h5", "h6"}, BLOCKS - {"h1", "h2", "h3", "h4", "h5", "h6"}),
}
CLOSES = {k: (frozenset(a), frozenset(b)) for k, (a, b) in CLOSES.items()} | {k: (frozenset(CLOSES["h1"][0]), CLOSES["h1"][1]) for k in ("h2", "h3", "h4", "h5", "h6")}
#: What a table, its sections and rows hold themselves; all else in them goes before the table, as in browsers.
TABULAR = frozenset("table thead tbody tfoot tr".split())
IN_TABLE = frozenset("caption colgroup col thead tbody tfoot tr td th style script template".split())
#: An end tag does not reach beyond these.
SCOPE = frozenset("table td th caption html template".split())
TABLE_END = frozenset("body table".split())
SCOPE_END = SCOPE | TABLE_END
#: Cells hide the table around them; these end tags pass cells.
CELLS = frozenset("td th caption template".split())
TABLE_TAGS = frozenset("table tr td th thead tbody tfoot caption".split())
_P, _P_STOPS = frozenset({"p"}), SCOPE | {"button"}

_TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<odd>[!?][^>]*(?:>|\Z))|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|/(?P<bogus>[^a-zA-Z>][^>]*)?(?:>|\Z))""", re.S)
_LOOSE = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)(?:>|\Z)")
_ATTR = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_CSS = re.compile(r"""[^{};"']+|"(?:[^"\\]|\\.)*(?:"|\Z)|'(?:[^'\\]|\\.)*(?:'|\Z)|.""", re.S)
#: The screen that media queries are asked for: lengths in CSS pixels, and words (fixed values).
VIEW = {"width": 1280.0, "height": 800.0, "device-width": 1280.0, "device-height": 800.0, "aspect-ratio": 1.6, "device-aspect-ratio": 1.6, "resolution": 1.0, "device-pixel-ratio": 1.0, "color": 8.0, "color-index": 0.0, "monochrome": 0.0, "grid": 0.0}
VIEW_WORDS = {
    "orientation": "landscape", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "prefers-contrast": "no-preference",
    "prefers-reduced-transparency": "no-preference", "prefers-reduced-data": "no-preference", "forced-colors": "none", "inverted-colors": "none", "scripting": "enabled", "display-mode": "browser", "update": "fast",
    "color-gamut": "srgb", "dynamic-range": "standard", "overflow-block": "scroll", "overflow-inline": "scroll",
}
UNITS = {"px": 1, "em": 16, "rem": 16, "ch": 8, "pt": 4 / 3, "pc": 16, "in": 96, "cm": 96 / 2.54, "mm": 96 / 25.4, "dppx": 1, "x": 1, "dpi": 1 / 96, "dpcm": 2.54 / 96, "": 1}
_SELECTOR = re.compile(r"^([a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)$")


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


class Open:
    """The open elements from the root on; for each the nearest one, itself included, that end tags of some kinds do not pass; and where
    the elements of each tag stand."""

    def __init__(self, root: Node):
        self.nodes: list[Node] = []
        self.block: list[int] = []
        self.scope: list[int] = []
        self.table: list[int] = []
        self.where: dict[str, list[int]] = {}
        self.push(root)

    def push(self, node: Node) -> None:
        k, tag = len(self.nodes), node.tag
        self.nodes.append(node)
        self.where.setdefault(tag, []).append(k)
        for own, tags in ((self.block, BLOCKS), (self.scope, SCOPE_END), (self.table, TABLE_END)):
            own.append(k if tag in tags else own[-1] if own else 0)

    def cut(self, k: int) -> None:
        """Ends the k-th element and all in it."""
        for node in self.nodes[k:]:
            self.where[node.tag].pop()
        for own in (self.nodes, self.block, self.scope, self.table):
            del own[k:]

    def last(self, tags) -> int:
        """The place of the nearest open element among tags; 0 if none but the root."""
        return max((at[-1] for x in tags if (at := self.where.get(x))), default=0)

    def outermost(self, tags, stops) -> int:
        """The place of the outermost open element among tags above the nearest stop; 0 if none."""
        floor, found = self.last(stops - tags), 0
        for x in tags:
            at = self.where.get(x)
            if at and at[-1] > floor:
                k = at[bisect_right(at, floor)]
                found = min(found or k, k)
        return found

    def ended_by(self, tag: str) -> int:
        """The place of the element that an end tag ends; 0 if none."""
        k = self.last((tag,))
        bound = self.table if tag in TABLE_TAGS else self.scope
        if k and bound[-1] <= k and (tag in BLOCKS or tag in ("select", "template") or self.block[-1] <= k):
            return k
        return 0


def tokens(page: str):
    """("text", s), ("start", tag, attrs, self-closing) and ("end", tag)."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:]
            return
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            nxt = page.find("<", lt + 1)
            nxt = n if nxt < 0 else nxt
            yield "text", page[at:nxt]
            at = nxt
            continue
        if lt > at:
            yield "text", page[at:lt]
        at = m.end()
        name = m.groupdict().get("name")
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            yield "end", name
            continue
        raw = m["attrs"] or ""
        attrs: dict[str, str] = {}
        if raw.strip(" /\t\n\r\f"):
            for a in _ATTR.finditer(raw):
                attrs.setdefault(a[1].lower(), _html.unescape(a[2] or a[3] or a[4] or ""))
        yield "start", name, attrs
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            stop = close.start() if close else n
            if stop > at:
                yield "raw", page[at:stop] if name in ("script", "style", "xmp", "iframe", "noembed", "noframes") else _html.unescape(page[at:stop])
            at = stop
            if not close:
                yield "end", name


def parse(page: str) -> Node:
    """The page's tree under a root element html."""
    root = Node("html", {})
    stack = Open(root)
    body: Node | None = None

    def put(kid: Node | str) -> None:
        """Into the open element; before the table, if it is one or a part of one that cannot hold this."""
        top = stack.nodes[-1]
        if top.tag in TABULAR and (isinstance(kid, str) or kid.tag not in IN_TABLE) and (k := stack.last(("table",))):
            kids = stack.nodes[k - 1].kids  # an open table is the last of them
            kids.insert(len(kids) - 1, kid)
        else:
            top.kids.append(kid)

    def add(tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        put(node)
        stack.push(node)

    def need_body() -> None:
        nonlocal body
        if body is None:
            stack.cut(1)
            add("body", {})
            body = stack.nodes[-1]

    def top() -> str:
        return stack.nodes[-1].tag

    for t in tokens(page):
        kind = t[0]
        if kind in ("text", "raw"):
            s = t[1] if kind == "raw" else _html.unescape(t[1]) if "&" in t[1] else t[1]
            if kind == "text" and body is None and top() in ("html", "head"):
                if not s.strip():
                    continue
                need_body()
            if kind == "text" and top() in ("table", "thead", "tbody", "tfoot", "tr", "colgroup") and not s.strip():
                continue
            if kind == "text" and top() == "colgroup":
                stack.cut(len(stack.nodes) - 1)
            if kind == "raw":
                stack.nodes[-1].kids.append(s)
            else:
                put(s)
            continue
        tag = t[1]
        if kind == "end":
            if tag in ("html", "body", "head"):
                if tag == "head" and body is None:
                    stack.cut(1)
                continue
            if tag == "br":
                need_body()
                put(Node("br", {}))
                continue
            if tag == "p" and not stack.outermost(_P, SCOPE):
                need_body()
                put(Node("p", {}))
            elif k := stack.ended_by(tag):
                stack.cut(k)
            continue
        attrs = t[2]
        if tag == "html":
            root.attrs = {**attrs, **root.attrs}
            continue
        if tag == "head":
            if body is None and stack.nodes[-1] is root:
                add("head", attrs)
            continue
        if tag == "body":
            need_body()
            body.attrs = {**attrs, **body.attrs}
            continue
        if body is None:
            if tag in HEAD_ONLY or tag in ("noscript", "template") or top() in ("noscript", "template"):
                if stack.nodes[-1] is root:
                    add("head", {})
            else:
                need_body()
        if tag in ENDS_P and (k := stack.outermost(_P, _P_STOPS)):
            stack.cut(k)
        if tag == "select" and (k := stack.ended_by(tag)):
            stack.cut(k)  # one select in another only ends it
            continue
        if tag in CLOSES and (k := stack.outermost(*CLOSES[tag])):
            stack.cut(k)
        if top() == "colgroup" and tag not in ("col", "template"):
            stack.cut(len(stack.nodes) - 1)
        if (tag in IN_TABLE and tag not in HEAD_ONLY and tag != "template" or tag == "table") and (k := stack.last(TABULAR)) > stack.last(CELLS):
            if tag != "table":
                stack.cut(k + 1)
            elif (k := stack.last(("table",))) > stack.last(CELLS):
                stack.cut(k)  # a table straight in a table ends it
        if tag == "form" and top() in TABULAR:
            continue  # holds nothing there: cells and text go on in the row
        if tag == "tr" and top() == "table":
            add("tbody", {})
        if tag in ("td", "th"):
            if top() == "table":
                add("tbody", {})
            if top() in ("tbody", "thead", "tfoot"):
                add("tr", {})
        add(tag, attrs)
        if tag in VOID:
            stack.cut(len(stack.nodes) - 1)
    return root


def declarations(style: str) -> dict[str, str]:
    out = {}
    for part in style.split(";"):
        k, colon, v = part.partition(":")
        if colon:
            out[k.strip().lower()] = v.replace("!important", "").strip().lower()
    return out


def _length(s: str) -> float | None:
    m = re.fullmatch(r"\s*([+-]?\d*\.?\d+)\s*(?:/\s*(\d*\.?\d+)|([a-z]*))\s*", s)
    if not m or (m[3] or "") not in UNITS:
        return None
    return float(m[1]) / float(m[2] or 1) if not m[2] or float(m[2]) else None


def _feature(s: str) -> bool | None:
    """Whether the view has a media feature; None if it is not known."""
    s = s.strip().replace("-webkit-", "").replace("-moz-", "")
    s = re.sub(r"^(min|max)--?moz-", r"\1-", s)
    if m := re.fullmatch(r"([a-z-]+)\s*:\s*(.+)", s):
        name, bound = m[1], m[2].strip()
        if name in VIEW_WORDS:
            return VIEW_WORDS[name] == bound
        side, name = (name[:3], name[4:]) if name[:4] in ("min-", "max-") else ("", name)
        value = _length(bound)
        if name not in VIEW or value is None:
            return None
        return VIEW[name] >= value if side == "min" else VIEW[name] <= value if side == "max" else VIEW[name] == value
    parts = re.split(r"(<=|>=|<|>|=)", s)
    if len(parts) > 1:
        values = [VIEW.get(x.strip(), _length(x)) for x in parts[::2]]
        if None in values:
            return None
        return all({"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b, "=": a == b}[op] for a, op, b in zip(values, parts[1::2], values[1:], strict=False))
    return bool(VIEW[s]) if s in VIEW else VIEW_WORDS[s] not in ("none", "no-preference") if s in VIEW_WORDS else None


def _split(s: str, word: str) -> list[str]:
    """s cut at a word (or comma) outside parentheses."""
    out, depth, last = [], 0, 0
    for m in re.finditer(rf"[()]|{word}", s):
        if m[0] in "()":
            depth += 1 if m[0] == "(" else -1
        elif depth <= 0:
            out.append(s[last : m.start()])
            last = m.end()
    return [*out, s[last:]]


def _condition(s: str, feature) -> bool | None:
    s = s.strip()
    if s.startswith(("not ", "not(")):
        got = _condition(s[3:], feature)
        return None if got is None else not got
    for word, fold in ((r"\bor\b", any), (r"\band\b", all)):
        if len(parts := _split(s, word)) > 1:
            return fold(_condition(x, feature) for x in parts)
    if s.startswith("(") and s.endswith(")"):
        inner = s[1:-1].strip()
        return _condition(inner, feature) if inner.startswith(("(", "not ", "not(")) else feature(inner)
    return s in ("all", "screen") if re.fullmatch("[a-z-]+", s) else None


def media_holds(query: str) -> bool:
    """Whether a list of media queries holds for a screen of usual size."""
    query = query.lower().strip()
    return not query or any(_condition(re.sub(r"^only\s+", "", q.strip()), _feature) for q in _split(query, ","))


def applies(at_rule: str) -> bool:
    """Whether the rules in an at-rule's block hold. Names of layers are not weighed; containers are taken to be as large as the view."""
    m = re.match(r"@([\w-]+)\s*(.*)", at_rule.strip().lower(), re.S)
    if not m:
        return False
    if m[1] == "media":
        return media_holds(m[2])
    if m[1] == "supports":
        return bool(_condition(m[2], lambda _: True))
    if m[1] == "container":
        return bool(_condition(re.sub(r"^(?!not\b)[\w-]+\s+(?=\(|not)", "", m[2]), _feature))
    return m[1] == "layer"


def style_rules(sheet: str):
    """(selectors, declarations) of the rules that hold for a screen. Rules nested in rules are left out; conditions there are weighed."""
    #: open blocks: selectors or None, whether what is in it holds, its text so far
    blocks: list[tuple[str | None, bool, list[str]]] = [(None, True, [])]
    for m in _CSS.finditer(re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.S)):
        c = m[0]
        own, holds, text = blocks[-1]
        if c == "{":
            # what precedes the block since the last declaration
            k = next((i for i in range(len(text) - 1, -1, -1) if text[i] == ";"), -1)
            head = "".join(text[k + 1 :]).strip()
            del text[k + 1 :]
            if head.startswith("@"):
                blocks.append((own, holds and applies(head), []))
            else:
                blocks.append((head, holds and own is None, []))
        elif c == "}":
            if len(blocks) > 1:
                blocks.pop()
                if holds and own is not None:
                    yield own, "".join(text)
        else:
            text.append(c)
    for own, holds, text in reversed(blocks[1:]):  # left open at the end
        if holds and own is not None:
            yield own, "".join(text)


class Styles:
    """The page's style rules with simple selectors (element, .class, #id and their combinations), later rules first in rank. A rule is
    found by its id, else one of its classes, else its element."""

    def __init__(self, root: Node):
        self.rules: dict[str, list[tuple]] = {}
        todo, n = [root], 0
        while todo:
            node = todo.pop()
            if node.tag == "style":
                sheet = "".join(k for k in node.kids if isinstance(k, str)) if media_holds(node.attrs.get("media", "")) else ""
                for selectors, body in style_rules(sheet):
                    own = declarations(body)
                    for s in selectors.split(","):
                        if (x := _SELECTOR.match(s.strip())) and s.strip():
                            marks = re.findall(r"[.#][\w-]+", x[2])
                            ids = [y for y in marks if y[0] == "#"]
                            classes = frozenset(y[1:] for y in marks if y[0] == ".")
                            tag = (x[1] or "").lower() or None
                            n += 1
                            self.rules.setdefault(ids[0] if ids else f".{min(classes)}" if classes else tag, []).append((n, tag, classes, ids[0][1:] if ids else None, own))
            if node.tag not in ("noscript", "template"):
                todo.extend(k for k in node.kids if isinstance(k, Node))

    def of(self, node: Node) -> dict[str, str]:
        out: dict[str, str] = {}
        if self.rules:
            classes, i = set(node.attrs.get("class", "").split()), node.attrs.get("id")
            met = [r for key in (node.tag, f"#{i}", *(f".{c}" for c in classes)) for r in self.rules.get(key, ())]
            for _, tag, cls, own_id, own in sorted(met, key=lambda r: r[0]):
                if (tag is None or tag == node.tag) and cls <= classes and (own_id is None or own_id == i):
                    out |= own
        if "style" in node.attrs:
            out |= declarations(node.attrs["style"])
        return out


class Writer:
    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.blank = False
        self.indent = 0
        self.marker = ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.split("\n")
            self._put(first, keep=True)
            for x in rest:
                self.newline(force=True)
                self._put(x, keep=True)
            return
        words = s.split()
        if not words:
            self.space = self.space or bool(s)
            return
        if s[0].isspace():
            self.space = True
        self._put(" ".join(words))
        self.space = s[-1].isspace()

    def _put(self, s: str, keep: bool = False) -> None:
        if not s:
            return
        if self.now:
            if self.space and not keep:
                self.now.append(" ")
        else:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.now.append(" " * min(MOST_INDENT, self.indent))
            if self.marker:
                self.now.append(self.marker)
                self.marker = ""
        self.space = False
        self.now.append(s)

    def newline(self, force: bool = False) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        elif force and self.lines:
            self.lines.append("")
        self.space = False

    def block(self, margin: bool) -> None:
        self.newline()
        self.blank = self.blank or margin

    def line(self, s: str) -> None:
        self.newline()
        self._put(s, keep=True)
        self.newline()

    def done(self) -> str:
        self.newline()
        return "\n".join(self.lines).strip("\n")


def laid_out(node: Node, style: dict[str, str]) -> bool:
    """Whether the element takes any place; if not, neither does what is in it."""
    if node.tag in HIDDEN or style.get("display") == "none" or "hidden" in node.attrs and "display" not in style:
        return False
    return not (node.tag == "dialog" and "open" not in node.attrs)


def seen(style: dict[str, str], before: bool) -> bool:
    """Whether the element's own text shows, given whether its parent's does."""
    own = style.get("visibility", "inherit")
    return own == "visible" if own in ("visible", "hidden", "collapse") else before


def shown_options(select: Node) -> list:
    """What a select shows: a list box all its options, a menu the last selected one or else the first that is not disabled."""
    options, todo = [], list(reversed(select.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, Node):
            if k.tag == "option":
                options.append(k)
            else:
                todo.extend(reversed(k.kids))
    if "multiple" in select.attrs or re.fullmatch(r"0*([2-9]|[1-9]\d+)", select.attrs.get("size", "").strip()):
        return select.kids
    best = [k for k in options if "selected" in k.attrs][-1:] or [k for k in options if "disabled" not in k.attrs][:1]
    return [" ", *(best[0].attrs.get("label") and [best[0].attrs["label"]] or best[0].kids), " "] if best else []


def svg_shown(svg: Node, styles: Styles) -> list:
    """The texts of a drawing, apart from each other; what it only defines or describes is not shown."""
    out, todo = [], list(reversed(svg.kids))
    while todo:
        k = todo.pop()
        if not isinstance(k, Node) or k.tag in SVG_UNSEEN or k.attrs.get("display") == "none" or k.attrs.get("visibility") in ("hidden", "collapse") or not laid_out(k, own := styles.of(k)) or not seen(own, True):
            continue
        if k.tag in ("text", "foreignobject"):
            out += [" ", k, " "]
        else:
            todo.extend(reversed(k.kids))
    return out


def placed(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """Cells (text, columns spanned, rows spanned) of one section as (text, first column, end): each in the first columns that cells of the rows
    above have left free."""
    out, held = [], []  # held: (first column, end, rows left)
    for row in rows:
        busy, i, at, cells, new = sorted(held), 0, 0, [], []
        for s, columns, down in row:
            while i < len(busy) and busy[i][0] <= at:
                at = max(at, busy[i][1])
                i += 1
            cells.append((s, at, at + columns))
            if down > 1:
                new.append((at, at + columns, down))
            at += columns
        held = [(a, b, n - 1) for a, b, n in [*held, *new] if n > 1]
        out.append(cells)
    return out


def aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Cells (text, first column, end) in columns of equal width, two spaces apart. Only columns where a cell begins count."""
    edges = sorted({c[1] for row in rows for c in row} | {c[2] for row in rows for c in row})
    number = {x: k for k, x in enumerate(edges)}
    rows = [[(s, number[a], number[b]) for s, a, b in row] for row in rows]
    width = [0] * len(edges)
    for row in rows:
        for s, a, b in row:
            if b == a + 1:
                width[a] = max(width[a], len(s))
    for row in rows:  # what spans several columns widens the last of them
        for s, a, b in row:
            if b > a + 1 and (lack := len(s) - sum(width[a:b]) - 2 * (b - a - 1)) > 0:
                width[b - 1] += lack
    out = []
    for row in rows:
        at, cells = 0, []
        for s, a, b in row:
            if a > at:
                cells.append(" " * (sum(width[at:a]) + 2 * (a - at - 1)))
            cells.append(s.ljust(sum(width[a:b]) + 2 * (b - a - 1)))
            at = b
        out.append("  ".join(cells).rstrip())
    return out


def render(root: Node, styles: Styles) -> str:
    """The text of a tree. Cells are rendered by runs of their own, which wait for each other in a list, not in recursion."""
    runs, got = [_rendering(root, styles, True)], None
    while runs:
        try:
            runs.append(_rendering(*runs[-1].send(got)))
            got = None
        except StopIteration as end:
            runs.pop()
            got = end.value
    return got


def _rendering(root: Node, styles: Styles, shown: bool):
    """A run over one tree: yields what is to be rendered by itself, is sent its text, and returns its own."""
    w = Writer()
    #: (node or text, whether it shows, pre-formatted, the closing step to run)
    todo: list = [(root, shown, False, None)]
    lists: list[list] = []
    while todo:
        node, shown, pre, close = todo.pop()
        if close:
            close()
            continue
        if isinstance(node, str):
            if shown:
                w.text(node, pre)
            continue
        tag = node.tag
        style = styles.of(node)
        if node is not root:
            if not laid_out(node, style):
                continue
            shown = seen(style, shown)
        if tag == "br":
            w.newline(force=shown)
            continue
        if tag == "hr":
            w.block(True)
            if shown:
                w.line("---")
            w.blank = True
            continue
        if tag == "table" and node is not root:
            w.block(True)
            for s in (yield from table_lines(node, styles, shown)):
                w.line(s)
            w.blank = True
            continue
        white = style.get("white-space", "")
        pre = white.startswith("pre") if white else pre or tag in ("pre", "listing", "plaintext", "xmp")
        display = style.get("display", "")
        block = tag in BLOCKS if not display else display not in ("inline", "inline-block", "contents")
        margin = tag in MARGINS and not re.match(r"0(?:\D|$)", style.get("margin", ""))
        kids = node.kids
        if tag == "details" and "open" not in node.attrs:
            kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
        elif tag == "select":
            kids = shown_options(node)
        elif tag == "svg":
            kids = svg_shown(node, styles)
        elif tag == "option" and node.attrs.get("label"):
            kids = [node.attrs["label"]]
        undo = []
        if tag in ("ul", "ol", "menu", "dir"):
            margin = margin and not lists
            start = node.attrs.get("start", "1")
            lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            undo.append(lists.pop)
        if block:
            w.block(margin)
        if tag == "li":
            own = lists[-1] if lists else [False, 1]
            if shown:
                w.marker = f"{own[1]}. " if own[0] else "* "
            own[1] += 1
            more = 2 if len(lists) > 1 else 0
            w.indent += more
            undo.append(lambda more=more: (setattr(w, "indent", w.indent - more), setattr(w, "marker", "")))
        elif tag in ("dd", "blockquote"):
            w.indent += 2
            undo.append(lambda: setattr(w, "indent", w.indent - 2))
        elif tag == "q" and shown:
            w._put('"')
            undo.append(lambda: w._put('"', keep=True))
        if tag == "img" or tag in VOID:
            continue

        def closing(undo=undo, block=block, margin=margin):
            if block:
                w.block(margin)
            for f in reversed(undo):
                f()

        todo.append((None, shown, pre, closing))
        if tag == "pre" and kids and isinstance(kids[0], str):
            kids = [kids[0].removeprefix("\n"), *kids[1:]]
        todo.extend((k, shown, pre, None) for k in reversed(kids))
    return w.done()


def _spanned(cell: Node, name: str, most: int) -> int:
    """How many columns or rows a cell spans (0 rows: all that follow)."""
    s = cell.attrs.get(name, "1").strip()
    if not re.fullmatch(r"\d{1,6}", s):
        return 1
    return most if int(s) == 0 and name == "rowspan" else min(most, max(1, int(s)))


def table_lines(table: Node, styles: Styles, shown: bool):
    """The table's lines: what is no row, then the rows of each section; a generator as _rendering is."""
    head, sections = [], []
    parts = [(table, shown)]
    while parts:
        part, shown = parts.pop(0)
        rows = []
        for k in part.kids:
            if isinstance(k, str) or not laid_out(k, style := styles.of(k)):
                continue
            own = seen(style, shown)
            if k.tag in ("thead", "tbody", "tfoot"):
                parts.append((k, own))
            elif k.tag == "tr":
                row = []
                for c in k.kids:
                    if isinstance(c, Node) and c.tag in ("td", "th") and laid_out(c, style := styles.of(c)):
                        text = yield c, styles, seen(style, own)
                        row.append((" / ".join(x.strip() for x in text.split("\n") if x.strip()), _spanned(c, "colspan", 1000), _spanned(c, "rowspan", 65_534)))
                if row:
                    rows.append(row)
            elif k.tag not in ("colgroup", "col"):
                text = yield k, styles, own
                head += text.split("\n")
        sections += placed(rows)
    return [x for x in head if x] + [x for x in aligned(sections) if x]


def text_of(page: str | None) -> tuple[str, str]:
    """The page's title and its visible text."""
    if not page:
        return "", ""
    root = parse(page.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "�"))
    title, todo = "", [root]
    while todo:
        node = todo.pop()
        if node.tag == "title":
            title = " ".join("".join(k for k in node.kids if isinstance(k, str)).split())
            break
        todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    return title, render(root, Styles(root))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, title and text for each row of pages (page_id, html)."""
    schema = C.schema_of(pages, "page_id", title=C.STR, text=C.STR)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in C.slices(batch):
                got = [text_of(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.string())], names=schema.names)

    return pages.select("page_id", "html").mapInArrow(run, schema)


def op8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op8_html_text": op8_pages}
SQL: dict[str, str] = {}
