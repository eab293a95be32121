"""HTML extraction: visibility against a brute-force rule on random pages, and bounds of time and text."""

import random
import re
import time

import pytest

from randaudit.llm.htmltext import visible_text

TAGS = ["div", "span", "b", "section", "ul", "blockquote", "table", "details open", "p", "pre"]
HIDES = ["", "", "", "", " hidden", " style='display:none'", " style='visibility:hidden'", " style='color:red; VISIBILITY: visible'"]


def random_page(rng, budget):
    """(html, words that show) of a well-formed page, with the rule of visibility applied while it is written."""
    number = iter(range(10**6))
    out, seen = [], []

    def word(gone, shown):
        w = f"w{next(number)}"
        if shown and not gone:
            seen.append(w)
        return f" {w} "

    def element(depth, gone, shown):
        tag = rng.choice(TAGS)
        hide = rng.choice(HIDES)
        gone = gone or hide in HIDES[4:6]
        shown = True if "visible" in hide else False if "visibility" in hide else shown
        inner, close = {"ul": ("<li>", "</li>"), "table": ("<tr><td>", "</td></tr>")}.get(tag, ("", ""))
        out.append(f"<{tag}{hide}>{inner}")
        body(depth + 1, gone, shown, tag == "p")
        out.append(f"{close}</{tag.split()[0]}>")

    def body(depth, gone, shown, only_text=False):
        for _ in range(rng.randint(1, 4)):
            out.append(word(gone, shown))
            if not only_text and depth < budget and rng.random() < 0.8:
                element(depth, gone, shown)

    body(0, False, True)
    return "".join(out), seen


@pytest.mark.parametrize("seed", range(40))
def test_exactly_the_visible_words_show(seed):
    page, seen = random_page(random.Random(seed), 9)
    assert sorted(re.findall(r"w\d+", visible_text(page))) == sorted(seen)


class Element:
    def __init__(self, tag, hide=""):
        self.tag, self.hide, self.children, self.parent = tag, hide, [], None

    def add(self, child):
        if isinstance(child, Element):
            if child.parent:
                child.parent.children.remove(child)
            child.parent = self
        self.children.append(child)


FORMATS, SECTIONS = ("b", "i", "u"), ("div", "section", "p", "root")


class Soup:
    """The standard's tree construction for a few tags, as it is told there: by searches through two lists."""

    def __init__(self):
        self.root = Element("root")
        self.open, self.active = [self.root], []

    def insert(self, tag, hide=""):
        self.open[-1].add(node := Element(tag, hide))
        self.open.append(node)
        return node

    def reconstruct(self):
        k = len(self.active)
        while k and self.active[k - 1] not in self.open:
            k -= 1
        for j in range(k, len(self.active)):
            self.active[j] = self.insert(self.active[j].tag, self.active[j].hide)

    def close_p(self):
        if any(e.tag == "p" for e in self.open):
            while self.open.pop().tag != "p":
                pass

    def start(self, tag, hide):
        if tag in SECTIONS:
            self.close_p()
            self.insert(tag, hide)
            return
        self.reconstruct()
        node = self.insert(tag, hide)
        if tag in FORMATS:
            like = [e for e in self.active if (e.tag, e.hide) == (tag, hide)]
            if len(like) >= 3:
                self.active.remove(like[0])
            self.active.append(node)

    def word(self, w):
        self.reconstruct()
        self.open[-1].add(w)

    def end(self, tag):
        if tag == "p" and not any(e.tag == "p" for e in self.open):
            self.insert("p")
        if tag in SECTIONS:
            if any(e.tag == tag for e in self.open):
                while self.open.pop().tag != tag:
                    pass
        elif tag not in FORMATS or not self.adopt(tag):
            for e in reversed(self.open):
                if e.tag == tag:
                    del self.open[self.open.index(e) :]
                    break
                if e.tag in SECTIONS:
                    break

    def adopt(self, tag):
        for _ in range(8):
            own = next((e for e in reversed(self.active) if e.tag == tag), None)
            if own is None:
                return False
            if own not in self.open:
                self.active.remove(own)
                return True
            at = self.open.index(own)
            block = next((e for e in self.open[at:] if e.tag in SECTIONS), None)
            if block is None:
                del self.open[at:]
                self.active.remove(own)
                return True
            above, mark = self.open[at - 1], own
            last, place, count = block, self.open.index(block), 0
            while True:
                place, count = place - 1, count + 1
                node = self.open[place]
                if node is own:
                    break
                if count > 3 and node in self.active:
                    self.active.remove(node)
                if node not in self.active:
                    del self.open[place]
                    continue
                again = Element(node.tag, node.hide)
                self.active[self.active.index(node)] = self.open[place] = again
                if last is block:
                    mark = again
                again.add(last)
                last = again
            above.add(last)
            again = Element(own.tag, own.hide)
            for child in list(block.children):
                if isinstance(child, Element):
                    again.add(child)
                else:
                    block.children.remove(child)
                    again.children.append(child)
            block.add(again)
            if mark is own:
                self.active[self.active.index(own)] = again
            else:
                self.active.insert(self.active.index(mark) + 1, again)
                self.active.remove(own)
            self.open.remove(own)
            self.open.insert(self.open.index(block) + 1, again)
        return True

    def seen(self):
        out, todo = [], [(self.root, True)]
        while todo:
            node, shown = todo.pop()
            if not isinstance(node, Element):
                out += [node] if shown else []
            elif node.hide not in HIDES[4:6]:
                shown = True if "visible" in node.hide.lower().replace("visibility", "") else False if "visibility" in node.hide else shown
                todo += [(c, shown) for c in node.children]
        return sorted(out)


@pytest.mark.parametrize("seed", range(20))
def test_pages_whose_tags_cross_show_what_the_standard_says(seed):
    rng = random.Random(seed)
    for _ in range(150):
        page, soup = [], Soup()
        for k in range(rng.randint(3, 45)):
            tag = rng.choice(["b", "b", "i", "u", "span", "div", "section", "p"])
            if rng.random() < 0.5:
                hide = rng.choice(HIDES)
                page.append(f"<{tag}{hide}>")
                soup.start(tag, hide)
            else:
                page.append(f"</{tag}>")
                soup.end(tag)
            page.append(f"w{k} ")
            soup.word(f"w{k}")
        assert sorted(re.findall(r"w\d+", visible_text("".join(page)))) == soup.seen(), "".join(page)


@pytest.mark.parametrize("depth", [10, 200, 30_000])
def test_hidden_elements_stay_hidden_at_any_depth(depth):
    page = "<div>" * 60 + "<div hidden>" + "<div>" * depth + "SECRET1" + "</div>" * (depth - 5) + "SECRET2" + "</div>" * 6 + "VISIBLE"
    assert visible_text(page) == "VISIBLE"
    page = "<div>" * depth + "a<i hidden>b</i>" + "</div>" * depth + "c"
    assert visible_text(page) == "a\nc"


LONG = 40_000
HARD = {
    "blocks that cross": "<b>" + "<div>" * LONG + "</b>" * LONG,
    "pairs that cross": "<b><span><div>" * (LONG // 3) + "</b>" * LONG,
    "many inline elements that cross a block": "<b>" + "<span>" * LONG + "<div>" + "</b>x</div>" * 1000,
    "formatting that goes on": "<p><b hidden><i style='visibility:visible'><u>x" * LONG,
    "styles that differ": "".join(f"<p><b style='a:{k}'>x" for k in range(LONG)),
    "a style of brackets": '<p style="' + "([{" * LONG + '">x',
    "a style of comments": "<p style='" + "/*" * LONG + "'>x",
    "tags without an end": "<a <b " * LONG,
    "comments without an end": "<!--" * LONG,
    "open blocks": "<div>x" * LONG,
    "open inline elements": "<b>" * LONG,
    "end tags out of scope": "<b><table><td>" + "<i>" * LONG + "</b>" * LONG,
    "nested lists": "<ul><li>x" * LONG,
    "nested quotes": "<blockquote>x" * LONG,
    "nested tables": "<table><tr><td>x" * LONG,
    "spans of many columns": "<table>" + "<tr><td colspan=1000 rowspan=60000><td colspan=1000>x" * 5000,
    "cells far to the right": "<table><tr>" + "<td>abcdefghij" * 256 + "<tr><td colspan=255><td>x" * 5000,
    "rows under spans": "<table><tr>" + "<td rowspan=65000>x" * 256 + "<tr>" * LONG,
    "one wide cell": "<table><tr><td>" + "w" * 100_000 + "<td>x</tr>" + "<tr><td>a<td>b" * 5000 + "</table>",
    "a quote without an end": '<a href="' + "x " * LONG,
    "a number without an end": "&#" + "9" * LONG + ";",
    "angle brackets": "<" * LONG,
    "attributes": "<a " + "b=c " * LONG + ">x",
    "a style of separators": '<p style="' + "; " * LONG + '">x',
    "raw text without an end": "<script>" * LONG,
}


@pytest.mark.parametrize("name", sorted(HARD))
def test_time_and_text_grow_with_the_page(name):
    start = time.process_time()
    text = visible_text(HARD[name])
    assert time.process_time() - start < 10
    assert len(text) <= 6 * len(HARD[name]) + 5000


def test_wide_cells_do_not_widen_the_table():
    page = "<table><tr><td>" + "w" * 200 + "<td>x</tr><tr><td>a<td>b</table>"
    assert visible_text(page) == "w" * 200 + "  x\n" + "a" + " " * 121 + "b"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<head><title>no</title>shown <b>too</b>", "shown too"),
        ("<html hidden><body>no", ""),
        ("<body>a</body><p>b</html>c", "a\n\nbc"),
        ("a<head>b</head>c", "abc"),
        ("<table><tr><td>a</tr>z<tr><td>b</table>c", "z\na\nb\n\nc"),
        ("cut off <a href='x", "cut off"),
        ("a<!-->b<!--->c<!-- > --!>d</ e>f</>g<?h>i<!j>k", "abcdfgik"),
        ("<textarea>a\n b&lt;<i></textarea>", "a\n b<<i>"),
        ("<p title='>' hidden='x'>no</p><p title=\">\">yes", "yes"),
        ("<div hidden class=a class=b>no</div><div style='x:y' style='display:none'>yes</div>", "yes"),
        ("<ul><li><p>a</p><p>b</p><li><blockquote>c</blockquote></ul>d", "- a\n\n  b\n-   c\n\nd"),
        ("<pre>a\r\n\r\n  b\r\n</pre>", "a\n\n  b"),
        ("&#0000000065;&#x110000;&#99999999999;&notanentity;", "A��¬anentity;"),
        ("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>", "- yes"),
        ("<table><tbody style='visibility:collapse'><tr><td>no</table>", ""),
        ("<b><div hidden>no</b>no</div>yes", "yes"),
        ("<span><div hidden>no</span>no</div>yes", "yes"),
        ("<a><div hidden>no</a>no</div>yes", "yes"),
        ("<p><b style='display:none'>no</p><p>no</b>yes", "yes"),
        ("<b><p>in</b>side</p>", "inside"),
        ("<a hidden>no<a>yes", "yes"),
        ("<p><b hidden>no</p><table>no<tr><td>yes</table>no</b>", "yes"),
        ("<table><b>a<tr><td>b</table>c", "a\nb\n\nc"),
        ("<table><tr><td><b hidden>no</td><td>yes</table>yes", "yes\n\nyes"),
        ("<i style='/*x*/display:none'>no</i>yes", "yes"),
        ("<i style='display:none!important;display:block'>no</i>yes", "yes"),
        ("<i style='display:none;display:block ! important'>yes</i>", "yes"),
        ("<i style='content:\";display:none\"'>yes</i>", "yes"),
        ("<i style='background:url(a;display:none)'>yes</i>", "yes"),
        ("<i style='dis\\70lay:no\\6e e'>no</i>yes", "yes"),
        ("<i style='display:none;display:bogus;display'>no</i>yes", "yes"),
        ("<i style='display:no/**/ne;displa/**/y:none;--display:none;display:none none'>yes</i>", "yes"),
        ("<i style='visibility:hidden'>no<i style='visibility:inherit'>no</i><i style='visibility:initial'>yes</i></i>", "yes"),
    ],
)
def test_rules_of_pages(page, text):
    assert visible_text(page) == text
