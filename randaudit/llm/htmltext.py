"""HTML extraction by layout-aware rendering of whole pages.

A tokenizer and a tree builder with implied tags turn a page into a tree; a renderer walks it under visibility rules and emits
all visible text: blocks on lines of their own, paragraphs, headings, lists and tables set off by a blank line, list items
with markers and indentation, preformatted text as it stands, and table cells padded to the width of their columns.

Not visible: head, script, style, template, noscript, comments, hidden inputs, elements with the `hidden` attribute, with
`display:none` or `visibility:hidden` in their style attribute (a descendant with `visibility:visible` shows again), closed
dialogs and the body of closed details. A style attribute is read by declarations: strings, comments, brackets, escapes and
`!important` count, and values that CSS doesn't know are passed over.

Pages whose tags cross are built by the standard's rules: an end tag doesn't close blocks that opened inside its inline element, and
formatting elements (b, i, a, font and so on) that are still open when their block ends go on in the next text, hidden or not. Of
formatting elements that open inside each other, three of the same tag and the same visibility go on at most.

Time and text grow in proportion to the page, whatever it holds: the tokenizer never looks back, open elements are found by
their tag, the walk has a stack of its own (pages may nest as deeply as they like), indentation ends at MAX_INDENT columns,
and the cells of a table are padded to at most the largest of CELL_WIDTHS at which blanks stay in proportion to text. Beyond MAX_COLUMNS columns,
or in tables inside MAX_TABLES others, cells follow each other unpadded. No text is lost by any of these bounds.

Null pages give a null text, pages without visible text an empty one. A tag that the page's end cuts off is no text, as in
a browser. Repeated pages are rendered each.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right, insort
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from randaudit.llm.common import appended, bounded_batches

#: Fixed values of the HTML standard: elements without content, elements whose text is not shown, and block elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("head script style template noscript noembed noframes title meta link base datalist iframe object video audio canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul caption tr".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr article section".split())
#: Elements whose content is text up to their end tag, and those of them in which character references count.
RAW = frozenset("script style noscript iframe noembed noframes xmp title textarea".split())
REFERENCES = frozenset({"title", "textarea"})
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
#: A start tag on the left closes an open element on the right, up to the nearest element of the scope.
_CLOSES = {
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
}
_SCOPE = frozenset({"table", "td", "th", "caption"})
#: Fixed values of the HTML standard: formatting elements, elements inside which outer formatting isn't reopened, and special
#: elements, which end tags of other ones don't close.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_MARKED = frozenset("applet caption marquee object td template th".split())
_SPECIAL = (BLOCKS - {"dialog", "optgroup", "option", "legend"}) | frozenset(
    "applet area base basefont bgsound br button col colgroup embed frame frameset head iframe img input keygen link listing marquee meta noembed "
    "noframes noscript object param plaintext script select source style tbody template textarea tfoot thead title track wbr xmp td th".split()
)
_FLOWING = frozenset("area br button embed img input keygen marquee object select textarea wbr xmp".split())
_GRID = frozenset("table thead tbody tfoot tr".split())
#: How far an end tag reaches: not out of these elements.
_BOUND = dict.fromkeys(("tr", "td", "th", "thead", "tbody", "tfoot", "caption"), frozenset({"table"})) | {
    "table": frozenset(),
    "li": _SCOPE | {"ul", "ol"},
}
_BREAKS_P = BLOCKS - {"option", "optgroup", "tr", "caption", "html", "body", "legend"}
_HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
_SECTIONS = frozenset({"thead", "tbody", "tfoot"})
_LISTS = frozenset({"ul", "ol", "menu", "dir"})
_UNTYPED = frozenset("hidden checkbox radio image file password range color".split())

#: Bounds of layout, not of text: columns of indentation, aligned columns and nested aligned tables, widths of a padded cell
#: that are tried in turn, and blanks that padding may add for each character of a table (and for any table).
MAX_INDENT, MAX_COLUMNS, MAX_TABLES = 40, 256, 6
CELL_WIDTHS, BLANKS_PER_CHAR, BLANKS_FREE = (120, 60, 30, 15, 0), 4, 4000

_GAP = re.compile(r"[ \t\n\r\f]+")
_TAG = re.compile(r"[a-zA-Z][^ \t\n\f\r/>]*")
_BETWEEN = re.compile(r"[ \t\n\f\r/]*")
_ATTRIBUTE = re.compile(r"(=?[^ \t\n\f\r/>=]*)([ \t\n\f\r]*=[ \t\n\f\r]*)?")
_UNQUOTED = re.compile(r"[^ \t\n\f\r>]*")
_COMMENT_END = re.compile("--!?>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[ \t\n\f\r/>])", re.IGNORECASE) for tag in RAW}
_LONG_NUMBER = re.compile(r"&#(?:([0-9]{8,})|[xX]([0-9a-fA-F]{8,}));?")
_CSS = re.compile(
    r"""(?P<comment>/\*(?:.*?\*/|.*))|(?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<end>;)|\\.|[^/"'()\[\]{};\\]+|.""", re.DOTALL
)
_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})[ \t\n\f]?|(.))", re.DOTALL)
_IMPORTANT = re.compile(r"![ \t\n\f]*important$")
#: Fixed values of CSS: what display and visibility may be.
_VALUES = {
    "display": frozenset(
        "none contents block inline flow flow-root table flex grid ruby list-item inline-block inline-table inline-flex inline-grid table-row-group "
        "table-header-group table-footer-group table-row table-cell table-column-group table-column table-caption ruby-base ruby-text ruby-base-container "
        "ruby-text-container run-in math inherit initial unset revert revert-layer".split()
    ),
    "visibility": frozenset("visible hidden collapse inherit initial unset revert revert-layer".split()),
}
#: The attributes that rendering asks for; others are not kept.
_ASKED = frozenset("hidden style open type value start colspan rowspan".split())


def _characters(text: str) -> str:
    """The text with its character references resolved; numbers beyond Unicode, however long, are the replacement character."""
    if "&" not in text:
        return text

    def number(m: re.Match) -> str:
        digits = (m[1] or m[2]).lstrip("0") or "0"
        return "�" if len(digits) > 7 else f"&#{digits};" if m[1] else f"&#x{digits};"

    return html.unescape(_LONG_NUMBER.sub(number, text))


class Node:
    __slots__ = ("attrs", "children", "listed", "opened", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []  # children: Node or str
        self.opened = self.listed = False  # whether it is an open element, and a formatting element to go on


_NONE: dict[str, str] = {}


class TreeBuilder:
    """Builds a tree and implies the tags that pages leave out. Open elements are found by tag, not by a search.

    An open element is the last child of the open element before it. Where tags cross, elements trade places and the number of
    open elements stays, so nothing behind them moves.
    """

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # places of the open elements of a tag, ascending
        self.special: list[int] = []  # places of the open special elements, ascending
        self.active: list[Node | None] = []  # formatting elements to go on; None where a cell or the like begins
        self.begun = False  # content was seen: no head can follow

    def _cut(self, at: int) -> None:
        while len(self.open) > at:
            node = self.open.pop()
            node.opened = False
            self.places[node.tag].pop()
            if node.tag in _SPECIAL:
                self.special.pop()
            if node.tag in _MARKED:
                while self.active and (entry := self.active.pop()) is not None:
                    entry.listed = False

    def _floor(self, scope: set[str] | frozenset[str]) -> int:
        return max((own[-1] for t in scope if (own := self.places.get(t))), default=0)

    def _close(self, names: set[str] | frozenset[str], scope: set[str] | frozenset[str]) -> None:
        """Close the outermost open element of names that lies inside the nearest element of scope."""
        if any(self.places.get(n) for n in names):
            floor = self._floor(scope)
            inside = [own[k] for n in names if (own := self.places.get(n)) and (k := bisect_right(own, floor)) < len(own)]
            if inside:
                self._cut(min(inside))

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in _SPECIAL:
            self.special.append(len(self.open))
        if tag in _MARKED:
            self.active.append(None)
        self.open.append(node)
        node.opened = True

    def _segment(self) -> list[Node]:
        """The formatting elements since the last cell or the like, the last one first."""
        out = []
        for entry in reversed(self.active):
            if entry is None:
                break
            out.append(entry)
        return out

    def _list(self, node: Node) -> None:
        """A formatting element that goes on from here; the first of three others that are like it doesn't any more."""
        like = [e for e in self._segment() if e.tag == node.tag and _effect(e) == _effect(node)]
        if len(like) >= 3:
            self._unlist(like[-1])
        self.active.append(node)
        node.listed = True

    def _unlist(self, node: Node) -> None:
        node.listed = False
        at = next(k for k in range(len(self.active) - 1, -1, -1) if self.active[k] is node)
        del self.active[at]

    def _relist(self, old: Node, new: Node) -> None:
        at = next(k for k in range(len(self.active) - 1, -1, -1) if self.active[k] is old)
        self.active[at], old.listed, new.listed = new, False, True

    def _go_on(self) -> None:
        """Formatting elements that ended with their block open again."""
        if not self.active or self.active[-1] is None or self.active[-1].opened:
            return
        closed = []
        for entry in self._segment():
            if entry.opened:
                break
            closed.append(entry)
        for entry in reversed(closed):
            self._push(entry.tag, entry.attrs)
            self._relist(entry, self.open[-1])

    def _at(self, node: Node) -> int:
        return next(k for k in reversed(self.places[node.tag]) if self.open[k] is node)

    def _end_formatting(self, tag: str) -> bool:
        """End a formatting element whose inside may have blocks that go on; False if none is to go on."""
        for _ in range(8):
            own = next((e for e in self._segment() if e.tag == tag), None)
            if own is None:
                return False
            if not own.opened:
                self._unlist(own)
                return True
            at = self._at(own)
            if at < self._floor(_SCOPE):
                return True
            k = bisect_right(self.special, at)
            if k == len(self.special):
                self._unlist(own)
                self._cut(at)
                return True
            self._cross(own, at, k)
        return True

    def _cross(self, own: Node, at: int, k: int) -> None:
        """Take the k-th special element, the first inside `own`, out of it; its content so far stays formatted."""
        to = self.special[k]
        block, above = self.open[to], self.open[at - 1]
        self.open[to - 1].children.pop()
        for step, place in enumerate(range(to - 1, at, -1), 1):
            inner = self.open[place]
            if inner.listed and step > 3:
                self._unlist(inner)
            # An element that doesn't go on leaves an open one without effect behind.
            again = Node(inner.tag, inner.attrs) if inner.listed else Node("", _NONE)
            if inner.listed:
                self._relist(inner, again)
            self.open[place] = again
            own_places = self.places[inner.tag]
            del own_places[bisect_right(own_places, place) - 1]
            inner.opened = False
            again.opened = True
        # own, e1 .. em, block become e1 .. em, block, own again: each a place further up.
        again = Node(own.tag, own.attrs)
        again.children, block.children = block.children, [again]
        self._relist(own, again)
        own.opened = False
        own_places = self.places[own.tag]
        del own_places[bisect_right(own_places, at) - 1]
        own_places = self.places[block.tag]
        own_places[bisect_right(own_places, to) - 1] = to - 1
        self.special[k] = to - 1
        moved = [*self.open[at + 1 : to], block, again]
        self.open[at : to + 1] = moved
        for place, node in enumerate(moved, at):
            if node is not block:
                insort(self.places.setdefault(node.tag, []), place)
            node.opened = True
            if node is not again:
                above.children.append(node)
                above = node

    def _end_head(self) -> None:
        self.begun = True
        if self.places.get("head"):
            self._cut(self.places["head"][0])

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html":
            if attrs:
                self.root.attrs = attrs | self.root.attrs
            return
        if tag not in IN_HEAD and (not self.begun or self.open[-1].tag == "head"):
            self._end_head()
        if tag == "head" and (self.begun or self.places.get("head")) or tag == "body" and self.places.get("body"):
            return
        if tag in _BREAKS_P:
            self._close({"p"}, _SCOPE)
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
            if self.places.get("table") and "table" in _CLOSES[tag][1]:
                self._cut(self._floor(_GRID) + 1)
        if tag == "a" and any(e.tag == "a" for e in self._segment()):
            self._end_formatting("a")
        top = self.open[-1].tag
        if tag in ("td", "th") and (top == "table" or top in _SECTIONS):
            self._push("tr", _NONE)
        if tag in _HEADINGS and top in _HEADINGS:
            self._cut(len(self.open) - 1)
        if top not in _GRID and (tag not in _SPECIAL or tag in _FLOWING):
            self._go_on()
        self._push(tag, attrs)
        if tag in FORMATTING:
            self._list(self.open[-1])
        if tag in VOID:
            self._cut(len(self.open) - 1)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):  # what follows them still belongs to the body
            return
        if tag == "br" or tag == "p" and not self.places.get("p"):
            self.start(tag, _NONE)
        if tag in FORMATTING and self._end_formatting(tag):
            return
        own = self.places.get(tag)
        floor = self._floor(_BOUND.get(tag, _SCOPE)) if tag in _SPECIAL else self.special[-1] if self.special else 0
        if own and own[-1] > floor:
            self._cut(own[-1])

    def text(self, data: str) -> None:
        if not data:
            return
        if not self.begun and data.strip():
            self._end_head()
        at = len(self.open)
        stray = self.open[-1].tag in _GRID
        if self.begun and not (stray and not data.strip()):
            self._go_on()
        self.open[-1].children.append(data)
        if stray:  # what goes on for text between cells ends before the next cell
            self._cut(at)


def _attributes(page: str, i: int) -> tuple[dict[str, str], int]:
    """The attributes that rendering asks for (the first of each name) and the place after the tag; -1 if the page ends inside it."""
    attrs = _NONE
    while True:
        i = _BETWEEN.match(page, i).end()
        if i >= len(page):
            return attrs, -1
        if page[i] == ">":
            return attrs, i + 1
        found = _ATTRIBUTE.match(page, i)
        i, value = found.end(), ""
        if found[2]:
            quote = page[i : i + 1]
            if quote in ('"', "'") and quote:
                close = page.find(quote, i + 1)
                if close < 0:
                    return attrs, -1
                value, i = page[i + 1 : close], close + 1
            else:
                bare = _UNQUOTED.match(page, i)
                value, i = bare[0], bare.end()
        name = found[1].lower()
        if name in _ASKED and name not in attrs:
            attrs = attrs or {}
            attrs[name] = _characters(value)


def parse(page: str) -> Node:
    """The tree of a page, in one pass."""
    page = page.replace("\r\n", "\n").replace("\r", "\n") if "\r" in page else page
    built, i, n = TreeBuilder(), 0, len(page)
    while i < n:
        at = page.find("<", i)
        if at < 0:
            built.text(_characters(page[i:]))
            break
        if at > i:
            built.text(_characters(page[i:at]))
        i, after = at, page[at + 1 : at + 2]
        name = _TAG.match(page, at + (2 if after == "/" else 1))
        if name:
            tag = name[0].lower()
            attrs, i = _attributes(page, name.end())
            if i < 0:
                break
            if after == "/":
                built.end(tag)
                continue
            built.start(tag, attrs)
            if tag == "plaintext":
                built.text(page[i:])
                break
            if tag in RAW:
                close = _RAW_END[tag].search(page, i)
                to = close.start() if close else n
                if tag not in UNSEEN:
                    built.text(_characters(page[i:to]) if tag in REFERENCES else page[i:to])
                i = to
        elif after == "!" and page.startswith("--", at + 2):
            if page.startswith((">", "->"), at + 4):
                i = page.index(">", at) + 1
            else:
                close = _COMMENT_END.search(page, at + 4)
                i = close.end() if close else n
        elif after in ("!", "?") and after or after == "/" and at + 2 < n:
            close = page.find(">", at + 2)
            i = close + 1 if close >= 0 else n
        else:
            built.text("<")
            i = at + 1
    return built.root


@lru_cache(256)
def _declared(style: str) -> tuple[str, str]:
    """(display, visibility) that a style attribute sets; empty where it doesn't."""
    found: dict[str, tuple[bool, str]] = {}
    closers: list[str] = []
    parts: list[str] = []

    def declare() -> None:
        name, colon, value = "".join(parts).partition(":")
        parts.clear()
        name, value = _unescaped(name).strip(" \t\n\r\f").lower(), value.strip(" \t\n\r\f").lower()
        if colon and name in _VALUES:
            plain = _IMPORTANT.sub("", value)
            words = _unescaped(plain).split()
            fits = words and _VALUES[name].issuperset(words) and (len(words) == 1 or name == "display" and "none" not in words)
            if fits and (plain != value or not found.get(name, (False, ""))[0]):
                found[name] = (plain != value, words[0])

    for m in _CSS.finditer(style):
        kind = m.lastgroup
        if kind == "end" and not closers:
            declare()
            continue
        if kind == "open":
            closers.append(")]}"["([{".index(m[0])])
        elif kind == "close" and closers and closers[-1] == m[0]:
            closers.pop()
        parts.append(" " if kind == "comment" else m[0])
    declare()
    return tuple(found.get(name, (False, ""))[1] for name in ("display", "visibility"))


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[2] or (chr(c) if 0 < (c := int(m[1], 16)) < 0x110000 else "\ufffd"), text) if "\\" in text else text


def _style(node: Node, name: str) -> str:
    style = node.attrs.get("style")
    return _declared(style)[name == "visibility"] if style else ""


def _effect(node: Node) -> tuple[bool, str]:
    return (_gone(node), _style(node, "visibility")) if node.attrs else (False, "")


def _gone(node: Node) -> bool:
    """Whether the element takes no place at all."""
    a, tag = node.attrs, node.tag
    if tag in UNSEEN or tag == "dialog" and "open" not in a:
        return True
    return bool(a) and ("hidden" in a or tag == "input" and a.get("type", "").lower() in _UNTYPED or _style(node, "display") == "none")


def _shown(node: Node, parent: bool) -> bool:
    visibility = _style(node, "visibility") if node.attrs else ""
    return visibility in ("visible", "initial") or visibility not in ("hidden", "collapse") and parent


def width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Lines:
    """Lines under construction: collapses white space and blank lines, and begins lines with markers and indentation."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False  # white space waits for more text on the line
        self.blank = False  # a blank line waits for more text
        self.frames = [("", "")]  # (what begins the first line, what begins the others, with all outer frames)
        self.live = 0  # so many frames have a line already

    def text(self, data: str) -> None:
        parts = _GAP.split(data)
        for k, part in enumerate(parts):
            if k and self.line:
                self.gap = True
            if part:
                if self.gap:
                    self.line.append(" ")
                self.line.append(part)
                self.gap = False

    def kept(self, data: str) -> None:
        """Text whose line ends and blanks count."""
        first, *rest = data.expandtabs(8).split("\n")
        if first:
            self.line.append(first)
        for line in rest:
            self.raw("".join(self.line).rstrip())
            self.line = [line] if line else []

    def raw(self, line: str) -> None:
        """A line as it stands; an empty one only after others of its frame."""
        begun = self.live == len(self.frames)
        if not line:
            if begun:
                self.lines.append("")
            return
        if self.blank and self.lines and self.lines[-1]:
            self.lines.append("")
        self.blank = False
        if begun:
            start = self.frames[-1][1]
        else:
            start = (self.frames[self.live - 1][1] if self.live else "") + "".join(f for f, _ in self.frames[self.live :])
            self.live = len(self.frames)
        self.lines.append(start + line)

    def end(self) -> None:
        line, self.line, self.gap = "".join(self.line).rstrip(" \t"), [], False
        if line:
            self.raw(line)

    def space(self) -> None:
        self.end()
        self.blank = self.blank or self.live == len(self.frames)

    def line_break(self) -> None:
        if self.line:
            self.end()
        elif not self.blank and self.live == len(self.frames) and self.lines[-1]:
            self.lines.append("")

    def push(self, first: str, others: str) -> None:
        self.end()
        outer = self.frames[-1][1]
        self.frames.append((first, outer + others if len(outer) + len(others) <= MAX_INDENT else outer))

    def pop(self) -> None:
        self.end()
        self.frames.pop()
        if self.live > len(self.frames):
            self.live, self.blank = len(self.frames), False
            while not self.lines[-1]:
                self.lines.pop()

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _span(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "").strip()
    return min(most, max(1, int(value))) if re.fullmatch(r"[0-9]{1,6}", value) else 1


class _Table:
    """Cells by row and column, captions and stray text before them."""

    def __init__(self) -> None:
        self.head: list[str] = []
        self.rows: list[list[tuple[int, int, list[str]]]] = []  # (column, columns covered, lines) of the cells of a row
        self.at = 0
        self.until: dict[int, int] = {}  # the last row that a cell from above covers in a column

    def row(self) -> None:
        self.rows.append([])
        self.at = 0

    def cell(self, node: Node, lines: list[str]) -> None:
        r = len(self.rows) - 1
        while self.at < MAX_COLUMNS and self.until.get(self.at, -1) >= r:
            self.at += 1
        wide, tall = _span(node, "colspan", 1000), _span(node, "rowspan", 65534)
        end = min(self.at + wide, MAX_COLUMNS)
        self.rows[r].append((self.at, max(1, end - self.at), lines))
        if tall > 1:
            self.until |= dict.fromkeys(range(self.at, end), r + tall - 1)
        self.at = max(self.at, end)

    def lines(self) -> list[str]:
        """Rows with cells padded to the width of their columns and parted by two blanks; captions stand above."""
        measured = [[(at, wide, [(line, width(line)) for line in lines]) for at, wide, lines in row] for row in self.rows]
        allowed = BLANKS_FREE + BLANKS_PER_CHAR * sum(w + 1 for row in measured for *_, lines in row for _, w in lines)
        for most in CELL_WIDTHS:
            starts = self._starts(measured, most)
            out, blanks = list(self.head), 0
            for row in measured:
                laid: list[list[str]] = []
                used: list[int] = []
                for at, _, lines in row:
                    for k, (line, w) in enumerate(lines):
                        if k == len(laid):
                            laid.append([])
                            used.append(0)
                        if line:
                            pad = max(starts[at] - used[k], 2 if laid[k] else 0)
                            laid[k] += [" " * pad, line]
                            used[k] += pad + w
                            blanks += pad
                    if blanks > allowed and most:
                        break
                out += ["".join(x) for x in laid]
            if blanks <= allowed or not most:
                return out
        return out

    @staticmethod
    def _starts(measured: list, most: int) -> list[int]:
        """Where each column starts, if no cell counts for more than `most` columns of text."""
        widths = [0] * (MAX_COLUMNS + 1)
        for spanning in (False, True):
            for row in measured:
                for at, wide, lines in row:
                    if (wide > 1) == spanning and at < MAX_COLUMNS:
                        need = min(most, max((w for _, w in lines), default=0))
                        have = sum(widths[at : at + wide]) + 2 * (wide - 1)
                        widths[at + wide - 1] += max(0, need - have)
        starts, place = [], 0
        for w in widths:
            starts.append(place)
            place += w + (2 if w else 0)
        return starts


class _State:
    """What holds inside an element while it is rendered."""

    __slots__ = ("closed", "number", "ordered", "out", "outer", "pre", "role", "shown", "table")

    def __init__(self, out: _Lines, shown: bool, pre: bool):
        self.out, self.shown, self.pre = out, shown, pre
        self.role = ""  # table, section, row, list, or nothing of these
        self.table: _Table | None = None
        self.outer: _Lines | None = None  # set if the element has lines of its own: those around it
        self.closed, self.ordered, self.number = False, False, 1


class _Renderer:
    """Takes elements in document order: enter, text, leave."""

    def __init__(self) -> None:
        self.states = [_State(_Lines(), True, False)]
        self.tables = 0

    def enter(self, node: Node) -> bool:
        """Begin an element; False if nothing of it shows."""
        if _gone(node):
            return False
        tag, parent = node.tag, self.states[-1]
        if parent.closed and tag != "summary":
            return False
        own = _State(parent.out, _shown(node, parent.shown), parent.pre)
        if parent.role in ("table", "section", "row"):
            own.table, own.pre = parent.table, False
            if parent.role != "row" and tag in ("colgroup", "col"):
                return False
            if parent.role != "row" and tag == "tr":
                own.role = "row"
                own.table.row()
            elif parent.role == "table" and tag in _SECTIONS:
                own.role = "section"
            else:
                own.outer, own.out = own.out, _Lines()
        self.states.append(own)
        if not own.role:
            self._begin(node, own, parent)
        return True

    def _begin(self, node: Node, own: _State, parent: _State) -> None:
        tag, out = node.tag, own.out
        if tag == "br":
            out.line_break()
        elif tag == "input":
            if own.shown:
                out.text(f" {node.attrs.get('value', '')} ")
        elif tag == "table":
            out.space()
            self.tables += 1
            if self.tables <= MAX_TABLES:
                own.role, own.table = "table", _Table()
        elif tag in ("td", "th"):
            if own.outer is None and out.line:
                out.line.append(" ")
                out.gap = True
        elif tag in _LISTS:
            out.end() if out.line else out.space()
            start = node.attrs.get("start", "").strip()
            own.role, own.pre, own.ordered = "list", False, tag == "ol"
            own.number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
        elif tag == "li" and parent.role == "list":
            value = node.attrs.get("value", "").strip()
            number = int(value) if re.fullmatch(r"-?[0-9]{1,9}", value) else parent.number
            mark = f"{number}. " if parent.ordered else "- "
            parent.number = number + 1
            out.push(mark, " " * len(mark))
        elif tag == "blockquote":
            out.space()
            out.push("  ", "  ")
            own.pre = False
        elif tag == "dd":
            out.push("    ", "    ")
            own.pre = False
        elif tag == "pre":
            out.space()
            out.push("", "")
            own.pre = True
            if node.children and isinstance(node.children[0], str):
                node.children[0] = node.children[0].removeprefix("\n")
        elif tag == "details" and "open" not in node.attrs:
            out.end()
            own.closed = True
        elif tag in SPACED:
            out.space()
        elif tag in BLOCKS or tag in ("textarea", "select"):
            out.end()
            own.pre = own.pre or tag == "textarea"
        elif tag == "q" and own.shown:
            out.text("“")

    def text(self, data: str) -> None:
        own = self.states[-1]
        if not own.shown or own.closed:
            return
        if own.role in ("table", "section", "row"):
            if data.strip():
                own.table.head.append(_GAP.sub(" ", data).strip())
        elif own.pre:
            own.out.kept(data)
        else:
            own.out.text(data)

    def leave(self, node: Node) -> None:
        own = self.states.pop()
        tag, out, parent = node.tag, own.out, self.states[-1]
        if own.role in ("row", "section"):
            return
        if tag == "table":
            self.tables -= 1
            if own.role:
                for line in own.table.lines():
                    out.raw(line)
            out.space()
        elif tag == "li" and parent.role == "list" or tag == "dd":
            out.pop()
        elif tag in ("blockquote", "pre"):
            out.pop()
            out.space()
        elif tag in SPACED or tag in _LISTS:
            out.space()
        elif tag in BLOCKS or tag in ("textarea", "select"):
            out.end()
        elif tag == "q" and own.shown:
            out.text("”")
        if own.outer is not None:
            lines = out.done()
            if parent.role == "row":
                parent.table.cell(node, lines)
            else:
                parent.table.head += lines


def visible_text(page: str | None) -> str | None:
    """The text that a reader of the page sees."""
    if page is None:
        return None
    root, made = parse(page), _Renderer()
    lines = made.states[0].out
    if not made.enter(root):
        return ""
    walk = [(root, iter(root.children))]
    while walk:
        node, rest = walk[-1]
        for child in rest:
            if isinstance(child, str):
                made.text(child)
            elif made.enter(child):
                walk.append((child, iter(child.children)))
                break
        else:
            walk.pop()
            made.leave(node)
    return "\n".join(lines.done())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page; other columns are left behind, whatever their names."""
    bounded_batches(pages.sparkSession)
    own = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def make() -> Callable:
        return lambda batch: [[visible_text(p) for p in batch.column("html").to_pylist()]]

    return appended(own, make, "text string", drop=("html",))
