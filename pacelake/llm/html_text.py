"""Layout-aware HTML rendering: a tree builder with implied tags, visibility rules, and text with its layout kept.

The page is cut into tags, text and raw text in one pass that never reads a place twice; a tag or comment
that does not end takes the rest of the page, as in browsers. The tree builder closes what a start tag
implies the end of (paragraphs before blocks, list items, table rows and cells, ...), ignores end tags
without a start, and closes all at the end. Not rendered: head matter, scripts, styles, templates, and what
the hidden attribute or display:none hides, inline or by a style sheet's rule for tags, classes and ids on one
element; visibility is inherited and can be given back. Importance, specificity and order decide between
rules. Of at-rules only @media screen or all, and @layer, count. The text of formulas, drawings (text
elements), options and input fields is kept, and an object's content where it names no data. Blocks stand on
lines of their own, with an empty line around paragraphs, headings, lists and tables; list items have a dash
or number and hang; table cells are padded to common column widths, over columns and rows they span; white
space collapses but in pre.

Bounds that keep junk pages linear: list items hang at most HANG levels, tables within more than NESTED others are
plain blocks, and a cell spans at most SPAN columns or rows. No text is lost by them.

Defined results: a null or empty page gives an empty text; whole pages are rendered, whatever their
length, without recursion; repeated rows are rendered each; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes datalist audio video canvas annotation annotation-xml desc defs metadata symbol".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre xmp blockquote figure hr".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header html legend li main menu nav section summary tr caption thead tbody tfoot td th option optgroup".split())
CLOSES_P = BLOCK - frozenset("option optgroup body html legend caption thead tbody tfoot td th tr".split())
#: A start tag ends open elements of the second set, as far as the nearest of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
SCOPE = frozenset("table td th caption button object template".split())

HANG, NESTED, SPAN = 64, 32, 1_000
#: Input types whose value is seen as text.
VALUES = frozenset(["", *"text search email url tel number date time month week datetime-local submit reset button".split()])

#: Possessive throughout: each alternative ends at > or with the page, so no place is tried again.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|(\Z))", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_SIGN = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[{};]", re.S)
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_FOREIGN = ("svg", "math")
_COMPOUND = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+)*)")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "gone", "lines", "shown", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.lines = tag, attrs, [], None
        self.gone, self.shown = False, True


class Stack:
    """Open elements, with the places of each tag, so that the nearest of some tags is found without a walk."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def nearest(self, tags) -> int:
        """Place of the innermost open element of these tags; 0 if none is open."""
        found = 0
        for t in tags:
            known = self.places.get(t)
            if known and known[-1] > found:
                found = known[-1]
        return found

    def cut(self, place: int) -> None:
        for node in self.nodes[place:]:
            self.places[node.tag].pop()
        del self.nodes[place:]


def _on_screen(media: str) -> bool:
    """Whether a media list has screen or all without further conditions."""
    return not media.strip() or any(m.strip().lower() in ("all", "screen", "only all", "only screen") for m in media.split(","))


def _style_rules(sheet: str):
    """Selector list and declarations of each rule that holds on a screen in any case, in order."""
    sheet = _COMMENT.sub(" ", sheet)
    at, inside, selector = 0, [], None  # inside: for each open at-rule, whether its rules hold
    for m in _SIGN.finditer(sheet):
        sign = m[0]
        if sign[0] in "\"'":
            continue
        head = sheet[at : m.start()].strip()
        if sign == "{":
            at = m.end()
            if selector is not None:  # nested rules hold only within their selector
                inside.append(False)
            elif head.startswith("@"):
                name, _, media = head[1:].partition(" ")
                name, more, rest = name.partition("(")
                inside.append((name.lower() == "media" and _on_screen(more + rest + media)) or name.lower() == "layer")
            else:
                selector = (head, len(inside))
        elif sign == "}":
            at = m.end()
            if selector is not None and len(inside) == selector[1]:
                if all(inside):
                    yield selector[0], head
                selector = None
            elif inside:
                inside.pop()
        elif selector is None:
            at = m.end()


class Rules:
    """What style sheets say of display and visibility, by the parts of compound selectors."""

    def __init__(self):
        self.by_key: dict[str, dict[tuple, dict]] = {}
        self.n = 0

    def add(self, sheet: str) -> None:
        for selectors, body in _style_rules(sheet):
            declared = [(name.lower(), _hides(name, value), bool(strong)) for name, value, strong in _DECLARED.findall(body)]
            for selector in selectors.lower().split(",") if declared else ():
                m = _COMPOUND.fullmatch(selector.strip())
                if not m or not m[0]:
                    continue
                parts = re.findall(r"[.#][\w-]+", m[2])
                tag = m[1] if m[1] and m[1] != "*" else ""
                compound = (tag, frozenset(parts))
                key = parts[-1] if parts else tag or "*"
                known = self.by_key.setdefault(key, {}).setdefault(compound, {})
                ids = sum(x[0] == "#" for x in parts)
                for name, hides, strong in declared:
                    self.n += 1
                    rank = (strong, ids, len(parts) - ids, bool(tag), self.n)
                    if name not in known or rank > known[name][0]:
                        known[name] = (rank, hides)

    def of(self, node: Node) -> dict[str, bool]:
        """display and visibility of an element, where something is said of them: whether it is hidden."""
        style = node.attrs.get("style", "")
        if not style and not self.by_key:
            return {}
        own, best = set(), {}
        if node.attrs:
            own = {"." + c for c in node.attrs.get("class", "").lower().split()}
            if "id" in node.attrs:
                own.add("#" + node.attrs["id"].lower())
        if self.by_key:
            for key in (*own, node.tag, "*"):
                for (tag, parts), known in self.by_key.get(key, {}).items():
                    if (not tag or tag == node.tag) and parts <= own:
                        for name, (rank, hides) in known.items():
                            if name not in best or rank > best[name][0]:
                                best[name] = (rank, hides)
        for name, value, strong in _DECLARED.findall(style):
            name, rank = name.lower(), (bool(strong), 1 << 30)
            if name not in best or rank >= best[name][0][:2] or rank[0] > best[name][0][0]:
                best[name] = (rank, _hides(name, value))
        return {name: hides for name, (_, hides) in best.items()}


def _hides(name: str, value: str) -> bool:
    return value.lower() in (("none",) if name.lower() == "display" else ("hidden", "collapse"))


def parse(page: str) -> tuple[Node, list[Node], Rules]:
    """Root, tables in order of their start, and the rules of style sheets."""
    root = Node("#root", {})
    stack, tables, rules = Stack(root), [], Rules()
    at = 0
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack.nodes[-1].children.append(html.unescape(text))
        if m is None or m[4] is not None:
            return root, tables, rules
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            _end(stack, name)
            continue
        attrs: dict[str, str] = {}
        for a in _ATTR.finditer(m[3]) if m[3] else ():  # of repeated attributes the first counts
            attrs.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
        _imply(stack, name)
        node = Node(name, attrs)
        stack.nodes[-1].children.append(node)
        if name == "table" and len(stack.places.get("table", ())) < NESTED:
            tables.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            raw = page[at : close.start() if close else len(page)]
            at = close.end() if close else len(page)
            if name == "style":
                if _on_screen(attrs.get("media", "")):
                    rules.add(raw)
            elif name == "textarea":
                node.children.append(html.unescape(raw))
            elif name == "xmp":
                node.children.append(raw)
        elif name not in VOID and not (m[3].endswith("/") and (name in _FOREIGN or stack.nearest(_FOREIGN))):
            stack.push(node)


def _imply(stack: Stack, name: str) -> None:
    if name in CLOSES_P:
        _close(stack, ("p",), SCOPE)
    if name in IMPLIED:
        _close(stack, *IMPLIED[name])


def _close(stack: Stack, ends, bounds) -> None:
    place = stack.nearest(ends)
    if place and place > stack.nearest([t for t in bounds if t not in ends]):
        stack.cut(place)


_TABLE_PARTS = frozenset("table thead tbody tfoot tr td th body html".split())


def _end(stack: Stack, name: str) -> None:
    if stack.nodes[-1].tag == name and len(stack.nodes) > 1:
        stack.cut(len(stack.nodes) - 1)
        return
    place = stack.nearest((name,))
    if place and (name in _TABLE_PARTS or place > stack.nearest(("table", "td", "th"))):
        stack.cut(place)


def resolve(root: Node, rules: Rules) -> None:
    """Set gone (not rendered at all) and shown (text is seen) of every element."""
    todo = [root]
    while todo:
        x = todo.pop()
        for c in x.children:
            if isinstance(c, str):
                continue
            said = rules.of(c)
            c.gone = c.tag in UNSEEN or said.get("display", "hidden" in c.attrs) or (c.tag == "object" and ("data" in c.attrs or "type" in c.attrs)) or (c.tag == "input" and c.attrs.get("type", "").lower() == "hidden")
            c.shown = not said["visibility"] if "visibility" in said else x.shown
            if not c.gone:
                todo.append(c)


class Flow:
    """Lines of text; blocks ask for line ends and for empty lines between."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.prefix = [("", "")]  # of the first line and of those after it
        self.open = False  # whether the first line of the innermost list item is still to come

    def text(self, s: str, pre: bool) -> None:
        if pre:
            for i, part in enumerate(s.split("\n")):
                if i:
                    self.end(True)
                if part:
                    self.line.append(part)
            return
        s = _SPACE.sub(" ", s)
        if s[:1] == " " and (not self.line or self.line[-1][-1:] == " "):
            s = s[1:]
        if s:
            self.line.append(s)

    def end(self, even_empty: bool = False) -> None:
        s = "".join(self.line).rstrip()
        self.line = []
        if s or even_empty:
            self.put(s)

    def put(self, s: str) -> None:
        if self.gap > 1 and self.lines:
            self.lines.append("")
        self.gap = 0
        first, rest = self.prefix[-1]
        self.lines.append(((first if self.open else rest) + s).rstrip())
        self.open = False

    def block(self, gap: int) -> None:
        self.end()
        self.gap = max(self.gap, gap)


def _drawn(svg: Node) -> list:
    """Text elements of a drawing, and what it embeds, with spaces between."""
    out, todo = [], list(reversed(svg.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str) or x.gone:
            continue
        if x.tag in ("text", "foreignobject"):
            out += [" ", x, " "]
        else:
            todo.extend(reversed(x.children))
    return out


def _number(text: str) -> int | None:
    return int(text) if re.fullmatch(r"-?[0-9]{1,9}", text.strip()) else None


def render(node: Node) -> list[str]:
    flow = Flow()
    lists: list[list] = []  # kind and number of each open list
    shown = [node.shown]  # of each open element
    pre = 0
    todo: list[tuple] = [(c, False) for c in reversed(node.children)]
    while todo:
        x, leave = todo.pop()
        if isinstance(x, str):
            if shown[-1]:
                flow.text(x, pre > 0)
            continue
        tag = x.tag
        inside = len(lists) > (leave and tag in ("ul", "ol", "menu"))  # of a list item
        gap = 2 if tag in SPACED and not (tag in ("ul", "ol", "p") and inside) else 1
        if leave:
            shown.pop()
            if tag in BLOCK:
                flow.block(gap)
            if tag in ("pre", "xmp"):
                pre -= 1
            elif tag in ("ul", "ol", "menu"):
                lists.pop()
            elif tag == "li":
                flow.prefix.pop()
                flow.open = False
            continue
        if x.gone:
            continue
        if tag == "br":
            flow.end(True)
            continue
        if tag == "input" and x.shown and x.attrs.get("type", "").lower() in VALUES and x.attrs.get("value"):
            flow.text(x.attrs["value"], False)
            continue
        if tag in BLOCK:
            flow.block(gap)
        if x.lines is not None:  # a table, rendered before
            for line in x.lines:
                flow.put(line)
            flow.block(2)
            continue
        if tag == "hr":
            if x.shown:
                flow.put("---")
            flow.block(2)
            continue
        if tag in ("pre", "xmp"):
            pre += 1
        elif tag in ("ul", "ol", "menu"):
            first = _number(x.attrs.get("start", ""))
            lists.append([tag, 0 if first is None else first - 1])
        elif tag == "li":
            if lists:
                value = _number(x.attrs.get("value", ""))
                lists[-1][1] = lists[-1][1] + 1 if value is None else value
            mark = f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "
            rest = flow.prefix[-1][1] if len(flow.prefix) <= HANG else flow.prefix[HANG][1]
            flow.prefix.append((rest + mark, rest + " " * len(mark)))
            flow.open = x.shown
        shown.append(x.shown)
        todo.append((x, True))
        todo.extend((c, False) for c in reversed(_drawn(x) if tag == "svg" else x.children))
    flow.end()
    return flow.lines


def _width(s: str) -> int:
    """Columns that a line takes on a screen: wide characters two, combining ones none."""
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _span(cell: Node, name: str) -> int:
    n = _number(cell.attrs.get(name, ""))
    return SPAN if name == "rowspan" and n == 0 else min(max(n or 1, 1), SPAN)


def _table(table: Node) -> list[str]:
    """Rows of aligned cells; a caption, and whatever stands outside cells, goes before."""
    before, rows = Node("#before", {}), []
    before.shown = table.shown
    todo = list(reversed(table.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            before.children.append(x)
        elif x.gone:
            continue
        elif x.tag in ("thead", "tbody", "tfoot"):
            todo.extend(reversed(x.children))
        elif x.tag == "tr":
            cells = [c for c in x.children if isinstance(c, Node) and c.tag in ("td", "th") and not c.gone]
            before.children.extend(c for c in x.children if isinstance(c, str) or (c.tag not in ("td", "th") and not c.gone))
            rows.append(cells)
        elif x.tag in ("td", "th"):
            rows.append([x])
        else:
            before.children.append(x)
    # where each cell starts, beside cells that reach down from rows above
    grid, above = [], []  # above: first column, column after, row after
    for r, cells in enumerate(rows):
        above = sorted(a for a in above if a[2] > r)
        line, col, k, own = [], 0, 0, []
        for c in cells:
            while k < len(above) and above[k][0] <= col:
                col = max(col, above[k][1])
                k += 1
            wide, deep = _span(c, "colspan"), _span(c, "rowspan")
            line.append((col, col + wide, render(c)))
            if deep > 1:
                own.append((col, col + wide, r + deep))
            col += wide
        above += own
        grid.append(line)
    # columns in which no cell starts take no place
    starts = sorted({a for line in grid for a, _, _ in line})
    rank = {a: i for i, a in enumerate(starts)}
    widths, spans = [0] * len(starts), []
    for line in grid:
        for a, b, text in line:
            first, last, need = rank[a], bisect_left(starts, b), max(map(_width, text), default=0)
            if last == first + 1:
                widths[first] = max(widths[first], need)
            else:
                spans.append((first, last, need))
    for first, last, need in spans:
        widths[last - 1] += max(0, need - sum(widths[first:last]) - 2 * (last - first - 1))
    places = [0]
    for w in widths:
        places.append(places[-1] + w + 2)
    out = render(before)
    for line in grid:
        for i in range(max((len(text) for _, _, text in line), default=0)):
            parts, at = [], 0
            for a, _, text in line:
                if i < len(text) and text[i]:
                    parts += [" " * (places[rank[a]] - at), text[i]]
                    at = places[rank[a]] + _width(text[i])
            out.append("".join(parts))
    return out


def page_text(page: str | None) -> str:
    root, tables, rules = parse(page or "")
    resolve(root, rules)
    for t in reversed(tables):  # inner ones first
        t.lines = _table(t)
    return "\n".join(render(root)).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_chars, n_lines of every page."""

    @F.pandas_udf("string")
    def text(col: pd.Series) -> pd.Series:
        return col.map(page_text, na_action=None)

    out = pages.select(F.col(id_col).alias("page_id"), text(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
