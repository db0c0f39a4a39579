"""HTML extraction: a tree builder with implied tags, and a layout of all visible text.

Tags open and close elements on a stack; where HTML implies an end tag (a paragraph
before a block, list items, table cells and rows, options) the builder adds it. What is
not displayed is left out: head content, scripts, styles, templates, and elements that
are hidden by attribute or inline style. The rest is laid out as text: blocks on lines of
their own, paragraphs and headings apart by an empty line, list items marked and
indented, preformatted text as it is, and table cells in aligned columns. A column is padded
to its widest cell, but to 200 characters at most: wider cells stand as they are.

What is open is counted by name and scope, and at most ``DEEPEST`` elements that are laid out as a
whole (items, quotes, tables, cells) stand in one another: what lies deeper loses its indent
or its columns, not its text, and goes line by line into the innermost of them. So a line is
moved a bounded number of times, and an element costs the same at any depth.

Defined results: null html and html without visible text give the empty text; unclosed
and stray tags, comments and quotes end where a browser would end them or at the end of
the page; repeated rows give repeated results; pages of any size and depth are read
whole, without recursion; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
SPACE = re.compile(r"[ \t\n\r\f]+")

# HTML's elements by what the builder and the layout do with them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("head script style template noembed noframes iframe title meta link base object audio video canvas datalist".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure".split())
BLOCK = PARAGRAPH | frozenset(
    "html body article aside section nav header footer main div address center details dialog dd dt fieldset figcaption form hgroup hr legend li menu search summary option optgroup select caption".split()
)
CLOSES_P = BLOCK - {"html", "body", "option", "optgroup", "select", "caption", "legend"}
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table", "thead", "tbody", "tfoot"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
HEAD_ONLY = frozenset("head title meta link base style script noscript template".split())
SCOPE = frozenset({"table", "td", "th", "caption", "html"})
REACHING = frozenset({"table", "tr", "thead", "tbody", "tfoot", "body", "html"})  # end tags that reach out of cells
WIDEST = 200  # a column is padded to at most so many characters
DEEPEST = 24  # elements with a layout of their own inside one another, at most
OWN_BOX = frozenset({"li", "table", "td", "th", "pre", "caption", "blockquote", "dd"})


class Mark(str):
    """An item's mark, in front of its first line."""


class Unmark:
    """The end of an item, whose mark goes if no line took it."""


UNMARK = Unmark()


class Box:
    """Text of a block under construction: pieces, and breaks of strength 1 (line) or 2 (paragraph)."""

    def __init__(self) -> None:
        self.pieces: list = []

    def text(self, x: str) -> None:
        self.pieces.append(x)

    def gap(self, strength: int) -> None:
        if self.pieces and isinstance(self.pieces[-1], int) and self.pieces[-1] > 0:
            self.pieces[-1] = max(self.pieces[-1], strength)
        else:
            self.pieces.append(strength)

    def fixed(self, lines: list[str]) -> None:
        """Lines that are laid out already."""
        self.pieces.append(lines)

    def lines(self) -> list[str]:
        out: list[str] = []
        run: list[str] = []
        marks: list[Mark] = []
        wait = 0

        def put(new: list[str]) -> None:
            nonlocal wait
            if out and wait > 1:
                out.append("")
            if marks:
                new = ["".join(marks) + new[0], *new[1:]]
                marks.clear()
            out.extend(new)
            wait = 0

        for x in [*self.pieces, 1]:
            if isinstance(x, Mark):
                marks.append(x)
                continue
            if x is UNMARK:
                if marks:
                    marks.pop()
                continue
            if isinstance(x, str):
                run.append(x)
                continue
            line = SPACE.sub(" ", "".join(run)).strip(" ")
            run = []
            if line:
                put([line])
            if isinstance(x, int):
                wait = max(wait, abs(x))
            elif any(x):
                put(x)
                wait = 1
        return out


class Element:
    __slots__ = ("box", "hidden", "n", "name", "rows", "span")

    def __init__(self, name: str, hidden: bool = False) -> None:
        self.name, self.hidden = name, hidden
        self.box: Box | None = None  # its own, where the element is laid out as a whole
        self.rows: list | None = None  # of a table
        self.n: int | None = None  # the next number of an ordered list
        self.span = 1


def attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)}


def is_hidden(name: str, attrs: dict[str, str]) -> bool:
    style = SPACE.sub("", attrs.get("style", "").lower())
    return name in UNSEEN or "hidden" in attrs or "display:none" in style or "visibility:hidden" in style or (name == "dialog" and "open" not in attrs)


def aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """The lines of a table whose cells stand in columns as wide as their widest cell."""
    wide: dict[int, int] = {}
    for row in rows:
        at = 0
        for lines, span in row:
            if span == 1:
                wide[at] = min(WIDEST, max([wide.get(at, 0), *map(len, lines)]))
            at += span
    out = []
    for row in rows:
        for k in range(max([len(lines) for lines, _ in row], default=0)):
            line, at = [], 0
            for lines, span in row:
                width = sum(wide.get(c, 0) for c in range(at, at + span)) + 3 * (span - 1)
                line.append((lines[k] if k < len(lines) else "").ljust(width))
                at += span
            out.append(" | ".join(line).rstrip())
    return out


class Builder:
    def __init__(self) -> None:
        self.root = Element("#root")
        self.root.box = Box()
        self.stack = [self.root]
        self.at: dict[str, list[int]] = {}  # where on the stack the elements of each name stand
        self.scopes = [0]  # where those stand that an end tag does not reach across
        self.tables: list[Element] = []
        self.boxes = [self.root.box]
        self.hidden = 0
        self.pre = 0
        self.pre_text: list[str] = []

    def open(self, name: str, rest: str) -> None:
        if name in IMPLIED:
            self.close_until(*IMPLIED[name])
        if name in CLOSES_P:
            self.close_in_scope("p")
        if name not in HEAD_ONLY and self.stack[-1].name == "head":
            self.pop()
        if name in ("td", "th") and self.stack[-1].name in ("table", "thead", "tbody", "tfoot"):
            self.push(Element("tr"))
        attrs = attributes(rest) if rest and not rest.isspace() else {}
        if name == "br":
            self.line_break()
            return
        if name in VOID:
            if name == "hr" and not self.hidden:
                self.boxes[-1].gap(1)
            elif name == "img" and attrs.get("alt") and not self.hidden and not is_hidden(name, attrs):
                self.data(attrs["alt"])
            return
        new = Element(name, is_hidden(name, attrs))
        if name == "ol":
            new.n = int(attrs["start"]) if re.fullmatch(r"-?\d{1,9}", attrs.get("start", "")) else 1
        if name in ("td", "th") and re.fullmatch(r"[1-9]\d{0,2}", attrs.get("colspan", "")):
            new.span = int(attrs["colspan"])
        self.push(new)

    def push(self, e: Element) -> None:
        self.hidden += e.hidden
        if not self.hidden:
            if e.name in BLOCK:
                self.boxes[-1].gap(self.strength(e.name))
            if e.name in OWN_BOX and len(self.boxes) <= DEEPEST:
                e.box = Box()
                self.boxes.append(e.box)
            elif e.name in ("td", "th"):
                self.boxes[-1].gap(1)
            elif e.name == "li":
                self.boxes[-1].pieces.append(Mark(self.mark()))
            if e.name == "table":
                e.rows = [] if e.box is not None else ()  # too deep for columns
                self.tables.append(e)
            if e.name == "tr" and (t := self.table()) is not None and t.rows != ():
                t.rows.append([])
            if e.name == "pre":
                self.pre += 1
                self.pre_text = [] if self.pre == 1 else self.pre_text
        self.at.setdefault(e.name, []).append(len(self.stack))
        if e.name in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(e)

    def strength(self, name: str) -> int:
        """Of the break around a block: lists inside items stand close."""
        return 2 if name in PARAGRAPH and not (name in ("ul", "ol", "menu") and self.at.get("li")) else 1

    def table(self) -> Element | None:
        return self.tables[-1] if self.tables else None

    def last(self, names: Iterable[str]) -> int:
        """Where the innermost of the names stands on the stack, -1 if none is open."""
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=-1)

    def pop(self) -> None:
        e = self.stack.pop()
        self.at[e.name].pop()
        if e.name in SCOPE:
            self.scopes.pop()
        if e.rows is not None:
            self.tables.pop()
        if self.hidden:
            self.hidden -= e.hidden
            return
        if e.box is not None:
            self.boxes.pop()
            out = self.boxes[-1]
            if e.name == "pre":
                self.pre -= 1
                lines = "".join(self.pre_text).strip("\n").split("\n") if self.pre == 0 else []
                out.fixed([x.rstrip() for x in lines])
            else:
                lines = e.box.lines()
                if e.name in ("td", "th"):
                    t = self.table()
                    if t is None:
                        out.fixed(lines)
                    else:
                        if not t.rows:
                            t.rows.append([])
                        t.rows[-1].append((lines, e.span))
                elif e.name == "table":
                    # text in a table but in no cell stands before it
                    out.fixed(lines)
                    out.gap(1)
                    out.fixed(aligned([r for r in e.rows if r]))
                elif e.name == "li":
                    mark = self.mark()
                    if lines:
                        out.fixed([mark + lines[0], *[(" " * len(mark) + x) if x else x for x in lines[1:]]])
                elif e.name in ("blockquote", "dd"):
                    out.fixed(["  " + x if x else x for x in lines])
                else:
                    out.fixed(lines)
        elif e.name == "pre":
            self.pre -= 1
            if self.pre == 0:
                self.boxes[-1].fixed([x.rstrip() for x in "".join(self.pre_text).strip("\n").split("\n")])
        elif e.name in ("td", "th"):
            self.boxes[-1].gap(1)
        elif e.name == "li":
            self.boxes[-1].gap(1)
            self.boxes[-1].pieces.append(UNMARK)
        if e.name in BLOCK:
            self.boxes[-1].gap(self.strength(e.name))

    def mark(self) -> str:
        """Of the next item of the innermost list."""
        at = self.last(("ul", "ol", "menu"))
        owner = self.stack[at] if at > 0 else None
        if owner is None or owner.n is None:
            return "- "
        owner.n += 1
        return f"{owner.n - 1}. "

    def close(self, name: str) -> None:
        if name == "br":
            self.line_break()
            return
        if name == "p" and not self.in_scope("p"):
            if not self.hidden:
                self.boxes[-1].gap(2)
            return
        at = self.last((name,))
        # a stray end tag inside a cell closes nothing outside
        if at > 0 and (name in REACHING or at >= self.scopes[-1]):
            while len(self.stack) > at:
                self.pop()

    def in_scope(self, name: str) -> bool:
        return self.last((name,)) >= max(self.scopes[-1], 1)

    def close_in_scope(self, name: str) -> None:
        if self.in_scope(name):
            while self.pop_name() != name:
                pass

    def pop_name(self) -> str:
        name = self.stack[-1].name
        self.pop()
        return name

    def close_until(self, ended: set[str], limits: set[str]) -> None:
        """Close up to the outermost of ``ended`` that no element of ``limits`` stands above."""
        limit = max(self.last(limits), 0)
        at = None
        for x in ended:
            places = self.at.get(x) or []
            k = bisect_right(places, limit)
            if k < len(places):
                at = places[k] if at is None else min(at, places[k])
        while at is not None and len(self.stack) > at:
            self.pop()

    def line_break(self) -> None:
        if self.hidden:
            return
        if self.pre:
            self.pre_text.append("\n")
        else:
            self.boxes[-1].pieces.append(-1)

    def data(self, text: str) -> None:
        if self.hidden or not text:
            return
        if self.pre:
            self.pre_text.append(text)
        elif self.stack[-1].name in ("table", "tbody", "thead", "tfoot", "tr") and not text.strip():
            return
        else:
            self.boxes[-1].text(text)


def extract(page: str | None) -> str:
    """The visible text of a page, laid out."""
    page = (page or "").replace("\r\n", "\n").replace("\r", "\n")
    b, at = Builder(), 0
    low = None
    while (m := TOKEN.search(page, at)) is not None:
        if m.start() > at:
            b.data(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            if m[0].startswith("<![CDATA["):
                b.data(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            b.close(name)
            continue
        b.open(name, m["rest"] if m["name"] else m["rest2"])
        if name in RAW:
            low = page.lower() if low is None else low
            low = low if len(low) == len(page) else page
            end = at
            while (end := low.find("</" + name, end)) >= 0 and low[end + len(name) + 2 : end + len(name) + 3] not in ("", ">", "/", " ", "\t", "\n", "\f"):
                end += 1  # a longer name
            end = len(page) if end < 0 else end
            b.data(html.unescape(page[at:end]) if name in ("textarea", "title") else page[at:end])
            at = end
    b.data(html.unescape(page[at:]))
    while len(b.stack) > 1:
        b.pop()
    return "\n".join(b.root.box.lines())


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "text": [extract(x) for x in pdf[html_col]]})

    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {dict(pages.dtypes)[id_col]}, text string")


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
