"""Pages as trees: one array of elements for each page, in document order, made in Arrow batches.

An element knows its parent, its next sibling and its last descendant by their
places in the array, and its text by a range of the page's text.  So what a
page's reader asks (a child, the sibling behind, everything below) is a lookup
or a slice in a Column expression, without a join or a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions import texts

ELEMENT = "struct<at:int,tag:string,classes:string,id:string,href:string,src:string,label:string,parent:int,next:int,last:int,begin:int,end:int>"
_ELEMENT = pa.struct([(n, pa.string() if t == "string" else pa.int32()) for n, t in (x.split(":") for x in ELEMENT[7:-1].split(","))])

#: Fixed values of the HTML standard: elements without content, and which open elements a start tag ends, up to which outer ones.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CELLS, _ROWS = frozenset(("td", "th")), frozenset(("tr", "td", "th"))
_BLOCKS = "address article blockquote dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split()
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol"))), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (_CELLS, frozenset(("tr", "table"))), "th": (_CELLS, frozenset(("tr", "table"))), "tr": (_ROWS, frozenset(("table",))), "option": (frozenset(("option",)), frozenset(("select",))),
    "tbody": (_ROWS | {"thead", "tbody"}, frozenset(("table",))), "tfoot": (_ROWS | {"thead", "tbody"}, frozenset(("table",))),
}
_P = (frozenset(("p",)), frozenset(("td", "th", "div", "li", "dd", "dt", "table", "section", "article", "form", "blockquote")))
_ENDED = {tag: [*([ENDS[tag]] if tag in ENDS else []), *([_P] if tag in _BLOCKS else [])] for tag in {*ENDS, *_BLOCKS}}


_TAG = re.compile(r"""<(?:(/)|)([A-Za-z][A-Za-z0-9]*)((?:\s+[A-Za-z_][-\w]*(?:="[^"]*"|='[^']*')?(?=[\s/>]))*)\s*/?>""", re.A)
_ATTRIBUTE = re.compile(r"""([A-Za-z_][-\w]*)(?:=("[^"]*"|'[^']*'))?""", re.A)
#: Elements whose content is not markup.
_RAW = frozenset("script style textarea title iframe noembed noframes noscript plaintext xmp svg math".split())


def _plain_tags(page: str) -> list[re.Match] | None:
    """The tags of a page that has no others and nothing that is not markup, else None."""
    found = list(_TAG.finditer(page))
    return None if len(found) != page.count("<") or not _RAW.isdisjoint([m[2].lower() for m in found]) else found


#: An element without attributes, its fields in their order.
_BARE = dict.fromkeys(f.name for f in _ELEMENT)


class Tree(HTMLParser):
    """Elements of one page, with a stack of the open ones.  Elements whose id is in ``hidden`` are left out with all they hold."""

    def __init__(self, page: str, hidden: frozenset[str] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.open: list[int] = []
        self.names: list[str] = []
        self.before: dict[int, int] = {}
        self.parts: list[str] = []
        self.length, self.hidden, self.muted = 0, hidden, 0
        self.plain = self._plain(page)
        if not self.plain:
            self.feed(page)
            self.close()
        self._end(0)

    def _plain(self, page: str) -> bool:
        """Reads a page all of whose tags have quoted attributes or none, and no comments or scripts; False without reading others."""
        found = _plain_tags(page)
        if found is None:
            return False
        at = 0
        for m in found:
            if m.start() > at:
                data = page[at : m.start()]
                self.handle_data(unescape(data) if "&" in data else data)
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                self.handle_endtag(tag)
            else:
                pairs = _ATTRIBUTE.findall(m[3]) if m[3] else ()
                self.handle_starttag(tag, [(name.lower(), unescape(value[1:-1]) if value else None) for name, value in pairs])
        if at < len(page):
            self.handle_data(unescape(page[at:]))
        return True

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = dict(attrs)
        if self.muted:
            self.muted += tag not in VOID
            return
        if named.get("id") in self.hidden:
            self.muted = int(tag not in VOID)
            return
        for ended, outer in _ENDED.get(tag, ()):
            for depth in range(len(self.open) - 1, -1, -1):
                name = self.names[depth]
                if name in outer:
                    break
                if name in ended:
                    self._end(depth)
        at, parent = len(self.elements), self.open[-1] if self.open else -1
        if parent in self.before:
            self.elements[self.before[parent]]["next"] = at
        self.before[parent] = at
        e = _BARE | {"at": at, "tag": tag, "parent": parent, "last": at, "begin": self.length, "end": self.length}
        if named:
            e["classes"], e["id"], e["href"], e["src"], e["label"] = named.get("class"), named.get("id"), named.get("href"), named.get("src") or named.get("data"), named.get("alt") or named.get("title")
        self.elements.append(e)
        if tag not in VOID:
            self.open.append(at)
            self.names.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.muted:
            self.muted -= tag not in VOID
            return
        for depth in range(len(self.open) - 1, -1, -1):
            if self.names[depth] == tag:
                self._end(depth)
                return

    def handle_data(self, data: str) -> None:
        if not self.muted:
            self.parts.append(data)
            self.length += len(data)

    def _end(self, depth: int) -> None:
        """Ends the open elements from ``depth`` on."""
        last = len(self.elements) - 1
        for at in self.open[depth:]:
            e = self.elements[at]
            e["last"], e["end"] = last, self.length
        del self.open[depth:], self.names[depth:]


def plain(page: str) -> tuple[str, frozenset[str]]:
    return page, frozenset()


_LITERAL = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"
_SUM = rf"(?:{_LITERAL}|\d++|tooltip|[\s+]++)++"
_STEP = re.compile(rf"tooltip\s*(\+?)=\s*({_SUM});|\$\(\"tr_\d+\"\)\.update\(({_SUM})\)", re.S)
_TERM = re.compile(rf"({_LITERAL})|(\d+)|tooltip", re.S)
_ACTION, _WORD, _QUOTED = re.compile(r"action\((?=([^)]*)\))"), re.compile(r"\w"), re.compile(r'"([^"]+)"')
_ESCAPED = re.compile(r"\\(.)", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _script(page: str) -> tuple[str, list[str], frozenset[str]]:
    """The title, the rows that a script writes as sums of literals, and the ids that it hides."""

    def read(literal: str) -> str:
        if "\\" not in literal:
            return literal
        if literal.count("\\") == literal.count('\\"'):
            return literal.replace('\\"', '"')
        return _ESCAPED.sub(lambda e: _ESCAPES.get(e[1], e[1]), literal)

    def value(terms: str) -> str:
        return "".join([read(literal[1:-1]) if literal else number or tooltip for literal, number in _TERM.findall(terms)])

    tooltip, rows = "", []
    for step in _STEP.finditer(page):
        if step[3] is not None:
            rows.append(f"<tr>{value(step[3])}</tr>")
        else:
            tooltip = (tooltip if step[1] else "") + value(step[2])
    # a pattern that begins with letters is looked for faster than one that begins with the border of a word
    hidden, end = set(), 0
    for m in _ACTION.finditer(page):
        if m.start() >= end and not (m.start() and _WORD.match(page[m.start() - 1])):
            hidden.update(_QUOTED.findall(m[1]))
            end = m.end(1) + 1
    title = re.search(r"(?is)<title\b.*?</title>", page)
    return title[0] if title else "", rows, frozenset(hidden)


def scripted(page: str) -> tuple[str, frozenset[str]]:
    """A page whose rows a script writes as sums of literals, as the title and a table, and the ids that the script hides."""
    title, rows, hidden = _script(page)
    return f"{title}<table>{''.join(rows)}</table>", hidden


def parsed(pages: DataFrame, prepare: Callable[[str], tuple[str, frozenset[str]]] = plain, column: str = "payload") -> DataFrame:
    """``pages`` with ``nodes`` (the elements) and ``words`` (the text) instead of ``column``; null pages have none."""
    kept = [c for c in pages.columns if c != column]

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for i in range(0, len(batch), 16):
                some = batch.slice(i, 16)
                trees = [Tree(*prepare(page or "")) for page in some.column(len(kept)).to_pylist()]
                made = [pa.array([t.elements for t in trees], pa.list_(_ELEMENT)), pa.array(["".join(t.parts) for t in trees], pa.string())]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(kept)], *made], names=[*kept, "nodes", "words"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)
    return pages.select(*kept, F.col(column).cast("string").alias(column)).mapInArrow(run, f"{kinds}{', ' if kinds else ''}nodes array<{ELEMENT}>, words string")


#: What a part's page tells of an element around it: its ``mark`` and number among those of that mark, how many parts came
#: before this one inside it, and the tag and text of the sibling before it.
AROUND = "struct<tag:string,mark:string,nth:int,place:int,before:string,label:string>"
_AROUND = pa.struct([(n, pa.string() if t == "string" else pa.int32()) for n, t in (x.split(":") for x in AROUND[7:-1].split(","))])
_PLACES = ("at", "parent", "next", "last")


def _own(tree: Tree, at: int, words: str, beside: bool) -> tuple[list[dict], str]:
    """The element and what is below it (with ``beside`` its next sibling too) as a tree and text of their own."""
    top, after = tree.elements[at], tree.elements[at]["next"]
    outer = tree.elements[after] if beside and after is not None else top
    kept = [e | {k: None if e[k] is None or e[k] > outer["last"] else max(e[k] - at, -1) for k in _PLACES} | {"begin": e["begin"] - top["begin"], "end": e["end"] - top["begin"]} for e in tree.elements[at : outer["last"] + 1]]
    if outer is not top:
        kept[outer["at"] - at] |= {"parent": -1, "next": None}
    return kept, words[top["begin"] : outer["end"]]


def _structs(lists: list[list[dict]], kind: pa.StructType) -> pa.Array:
    """Lists of structs, made column by column."""
    flat, ends = [x for one in lists for x in one], [0, *accumulate(map(len, lists))]
    fields = [pa.array([x[f.name] for x in flat], f.type) for f in kind]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind)))


def _walk(tree: Tree, words: str, tags: tuple[str, ...], mark: Callable[[dict], str | None]) -> Iterator[tuple[dict, list[dict], int]]:
    """(element, what is told of those around it, number) of the elements with one of the tags."""
    elements = tree.elements
    around: dict[int, dict] = {-1: None}
    numbers: dict[str, int] = {}
    sibling: dict[int, int] = {}
    position = 0
    for e in elements:
        at, parent = e["at"], e["parent"]
        if e["tag"] in tags:
            chain, up = [], parent
            while up >= 0:
                chain.append(dict(around[up]))
                around[up]["place"] += 1
                up = elements[up]["parent"]
            yield e, chain[::-1], position
            position += 1
        last = elements[sibling[parent]] if parent in sibling else None
        sibling[parent] = at
        if e["last"] > at:
            name = mark(e)
            if name is not None:
                numbers[name] = numbers.get(name, -1) + 1
            around[at] = {"tag": e["tag"], "mark": name, "nth": numbers.get(name), "place": 0, "before": last and last["tag"], "label": words[last["begin"] : last["end"]] if last and e["tag"] == "dd" else None}


def parts(
    pages: DataFrame, tags: tuple[str, ...], mark: Callable[[dict], str | None] = lambda e: None, prepare: Callable[[str], tuple[str, frozenset[str]]] = plain,
    beside: bool = False, head: str = "title", column: str = "payload",
) -> DataFrame:
    """A row for each element with one of the tags, in order, whose ``nodes`` and ``words`` are its own: what is asked of it costs by its size, not its page's.

    Instead of ``column`` there are ``position``, ``around`` (the elements
    around it, outermost first) and ``head``, the text of the page's first
    element with that tag.  The element is the first of its nodes.
    """
    kept = [c for c in pages.columns if c != column]

    def split(page: str) -> Iterator[tuple]:
        tree = Tree(*prepare(page))
        words = "".join(tree.parts)
        first = next((e for e in tree.elements if e["tag"] == head), None)
        title = first and words[first["begin"] : first["end"]]
        for e, chain, position in _walk(tree, words, tags, mark):
            yield position, chain, title, *_own(tree, e["at"], words, beside)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for i in range(0, len(batch), 4):
                some = batch.slice(i, 4)
                made = [list(split(page or "")) for page in some.column(len(kept)).to_pylist()]
                rows = [row for page in made for row in page]
                of_page = pa.array([n for n, page in enumerate(made) for _ in page], pa.int32())
                plain_ = [pa.array([row[n] for row in rows], kind) for n, kind in ((0, pa.int32()), (2, pa.string()), (4, pa.string()))]
                columns = [plain_[0], _structs([row[1] for row in rows], _AROUND), plain_[1], _structs([row[3] for row in rows], _ELEMENT), plain_[2]]
                yield pa.RecordBatch.from_arrays([*(c.take(of_page) for c in some.columns[: len(kept)]), *columns], names=[*kept, "position", "around", "head", "nodes", "words"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)
    return pages.select(*kept, F.col(column).cast("string").alias(column)).mapInArrow(run, f"{kinds}{', ' if kinds else ''}position int, around array<{AROUND}>, head string, nodes array<{ELEMENT}>, words string")


# --- rows of tables that are read without a tree


_NAME, _VALUE = r"[A-Za-z_][-\w]*+", r"""(?:="[^"<]*"|='[^'<]*')"""
_ANY = rf"(?:\s++{_NAME}{_VALUE}?+(?=[\s/>]))*+\s*+"
#: Attributes without an id, by which an element that holds others may be marked or hidden.
_NO_ID = rf"(?:\s++(?!(?i:id)[\s=/>]){_NAME}{_VALUE}?+(?=[\s/>]))*+\s*+"
_PHRASE = "b|i|em|strong|span|u|font|small|big|sub|sup|code|center"


def _leaf(name: str, tags: str) -> str:
    return rf"<(?P<{name}>{tags}){_ANY}>[^<]*+</(?P={name})>"


_BREAK = rf"<br{_ANY}/?>"
_CONTENT = rf"""(?:[^<]++|{_BREAK}|{_leaf("x", f"a|div|{_PHRASE}")}|<a{_NO_ID}>(?:[^<]++|{_BREAK}|{_leaf("y", _PHRASE)})*+</a>|<(?P<w>div|{_PHRASE}){_NO_ID}>(?:[^<]++|{_BREAK}|{_leaf("z", f"a|{_PHRASE}")})*+</(?P=w)>)*+"""
_ROW = rf"<tr{_NO_ID}>\s*+(?:<td{_NO_ID}>{_CONTENT}</td>\s*+)*+</tr>"
#: A row whose tags are written out and in pairs, so it is the same tree wherever it stands, and what parts of it are.
PLAIN_ROW = re.compile(_ROW, re.A)
_CELL = re.compile(rf"<td{_NO_ID}>([^<]*+(?:<(?!/td>)[^<]*+)*+)</td>", re.A)
_LINK = re.compile(rf"<a({_ANY})>([^<]*+(?:<(?!/a>)[^<]*+)*+)</a>", re.A)
_BLOCK = re.compile(rf"<div({_ANY})>([^<]*+(?:<(?!/div>)[^<]*+)*+)</div>", re.A)
_WITH_ID = re.compile(rf"<(?P<x>a|div|{_PHRASE})(?=[^<]*[iI][dD])({_ANY})>[^<]*+</(?P=x)>", re.A)
_TITLE = re.compile(rf"<title{_ANY}>[^<]*+</title>", re.A)
_ANY_TAG = re.compile(rf"</?[a-z0-9]++{_ANY}/?>", re.A)


def _attributes(written: str) -> dict[str, str | None]:
    return {name.lower(): unescape(value[1:-1]) if value else None for name, value in _ATTRIBUTE.findall(written)}


def _told(html: str) -> str:
    """The text of markup as a tree has it, piece by piece."""
    if "<" not in html:
        return unescape(html) if "&" in html else html
    if "&" not in html:
        return _ANY_TAG.sub("", html)
    return "".join(map(unescape, _ANY_TAG.split(html)))


class PlainRow:
    """A row that PLAIN_ROW matches, without hidden elements."""

    def __init__(self, html: str):
        self.html = html

    def cells(self, own: bool = False) -> list[str]:
        return [c if "<" not in c and "&" not in c else _told(c) for c in _CELL.findall(self.html)]

    def links(self) -> Iterator[tuple[dict[str, str | None], str]]:
        """(attributes, text) of the anchors."""
        return ((_attributes(m[1]), _told(m[2])) for m in _LINK.finditer(self.html))

    def blocks(self) -> Iterator[tuple[dict[str, str | None], str]]:
        """(attributes, text) of the blocks."""
        return ((_attributes(m[1]), _told(m[2])) for m in _BLOCK.finditer(self.html))

    def links_of(self, cell: int) -> Iterator[tuple[dict[str, str | None], str]]:
        """(attributes, text) of the anchors of a cell."""
        return PlainRow(_CELL.findall(self.html)[cell]).links()

    def tree(self) -> TreeRow:
        tree = Tree(f"<table>{self.html}</table>")
        return TreeRow(tree, 1, "".join(tree.parts))


class TreeRow:
    """A row, or another element, as one of a tree."""

    def __init__(self, tree: Tree, at: int, words: str):
        self.whole, self.top, self.words = tree, tree.elements[at], words
        self.below = tree.elements[at + 1 : self.top["last"] + 1]

    def text(self, e: dict | None = None) -> str:
        e = self.top if e is None else e
        return self.words[e["begin"] : e["end"]]

    def following(self, *tags: str) -> TreeRow | None:
        """The next sibling if it has one of the tags."""
        after = self.top["next"]
        return TreeRow(self.whole, after, self.words) if after is not None and self.whole.elements[after]["tag"] in tags else None

    def inside(self, e: dict) -> TreeRow:
        return TreeRow(self.whole, e["at"], self.words)

    def tagged(self, tag: str) -> list[dict]:
        return [e for e in self.below if e["tag"] == tag]

    def cells(self, own: bool = False) -> list[str]:
        """Texts of the cells, with ``own`` of those that are not in a table inside the row."""
        return [self.text(e) for e in self.tagged("td") if not own or e["parent"] == self.top["at"]]

    def links(self) -> Iterator[tuple[dict[str, str | None], str]]:
        return (({"id": e["id"], "href": e["href"]}, self.text(e)) for e in self.tagged("a"))

    def blocks(self) -> Iterator[tuple[dict[str, str | None], str]]:
        return (({"id": e["id"], "class": e["classes"]}, self.text(e)) for e in self.tagged("div"))

    def links_of(self, cell: int) -> Iterator[tuple[dict[str, str | None], str]]:
        return self.inside(self.tagged("td")[cell]).links()

    def tree(self) -> TreeRow:
        return self


def table_rows(page: str, mark: Callable[[dict], str | None] = lambda e: None) -> Iterator[tuple[int, list[tuple], PlainRow | TreeRow]]:
    """(position, marks and their numbers around it, outermost first, row) of every ``tr``, in order; ``mark`` is not asked of what is in plain rows.

    Runs of plain rows are one empty row to the tree, so it grows with what
    else a page holds.  On a page that has comments, scripts, tags which are
    not plain or tables in rows, all rows are read by the tree.
    """
    runs: list[list[str]] = []
    outside: list[str] = []
    at = 0
    if "\x01" not in page:
        for m in PLAIN_ROW.finditer(page):
            between = page[at : m.start()]
            if runs and not between.strip(" \t\r\n"):
                runs[-1].append(m[0])
            else:
                runs.append([m[0]])
                outside.append(f"{between}<tr id='\x01{len(runs) - 1}'></tr>")
            at = m.end()
    tree = Tree("".join([*outside, page[at:]]))
    if runs and not (tree.plain and _apart(tree.elements)):
        runs, tree = [], Tree(page)
    words, position = "".join(tree.parts), 0
    for e, chain, _ in _walk(tree, words, ("tr",), mark):
        marks, name = [(x["mark"], x["nth"]) for x in chain if x["mark"] is not None], e["id"]
        rows = runs[int(name[1:])] if runs and name is not None and name.startswith("\x01") else None
        for row in [TreeRow(tree, e["at"], words)] if rows is None else map(PlainRow, rows):
            yield position, marks, row
            position += 1


def _apart(elements: list[dict]) -> bool:
    """Whether no row is inside another."""
    inside = [False] * len(elements)
    for e in elements:
        up = e["parent"]
        inside[e["at"]] = up >= 0 and (inside[up] or elements[up]["tag"] == "tr")
        if inside[e["at"]] and e["tag"] == "tr":
            return False
    return True


def _shown(row: str, hidden: frozenset[str]) -> str:
    """A plain row without the elements that are hidden: of those with an id it has only such as hold no others."""
    return _WITH_ID.sub(lambda m: "" if "id" in m[2].lower() and _attributes(m[2]).get("id") in hidden else m[0], row) if hidden else row


def script_rows(page: str) -> tuple[str | None, list[PlainRow | TreeRow]]:
    """The text of the title and the rows of a page that is ``scripted``; as ``table_rows``, the tree holds those that are not plain."""
    title, rows, hidden = _script(page)
    plain_ = [PLAIN_ROW.fullmatch(row) is not None for row in rows]
    if "\x01" in page or title and not _TITLE.fullmatch(title) or any(not p and _plain_tags(r) is None for p, r in zip(plain_, rows, strict=True)):
        plain_ = [False] * len(rows)
    # rows that are plain and side by side are one empty row to the tree
    firsts = [n for n, p in enumerate(plain_) if p and not (n and plain_[n - 1])]
    tree = None
    if firsts:
        marked = {n: f"<tr id='\x01{n}'></tr>" for n in firsts}
        tree = Tree(f"{title}<table>{''.join(marked.get(n, '') if p else r for n, (p, r) in enumerate(zip(plain_, rows, strict=True)))}</table>", hidden)
        if not _apart(tree.elements):
            tree, firsts = None, []
    tree = tree or Tree(f"{title}<table>{''.join(rows)}</table>", hidden)
    words = "".join(tree.parts)
    head = next((words[e["begin"] : e["end"]] for e in tree.elements if e["tag"] == "title"), None)
    found: list[PlainRow | TreeRow] = []
    for e in tree.elements:
        if e["tag"] == "tr":
            n = int(e["id"][1:]) if firsts and e["id"] is not None and e["id"].startswith("\x01") else None
            if n is None:
                found.append(TreeRow(tree, e["at"], words))
            while n is not None and n < len(rows) and plain_[n]:
                found.append(PlainRow(_shown(rows[n], hidden)))
                n += 1
    return head, found


def elements(page: str, tag: str, mark: Callable[[dict], str | None]) -> Iterator[tuple[int, list[dict], TreeRow]]:
    """(position, what is told of the elements around it, element) of every element with the tag, in order."""
    tree = Tree(page)
    words = "".join(tree.parts)
    return ((position, chain, TreeRow(tree, e["at"], words)) for e, chain, position in _walk(tree, words, (tag,), mark))


_NO_PAGE = re.compile(r"(mailto|tel|javascript):", re.A | re.I)


def files(found: Iterator[tuple[dict[str, str | None], str]], origin: str) -> tuple[list[tuple[str, str]] | None, list[tuple[str, str]] | None]:
    """What ``links`` gives for anchors, if all have a text and an address from the root; else None and the clean (text, address) of each for ``named``."""
    told = [(texts.clean(text), texts.clean(a["href"]), a["href"]) for a, text in found if a.get("href")]
    told = [(name, href) for name, href, written in told if href and not _NO_PAGE.match(written.strip(" "))]
    urls = [texts.rooted(origin, href) for _, href in told]
    if not all(urls) or not all(name for name, _ in told):
        return None, told
    first: dict[str, str] = {}
    for (name, _), url in zip(told, urls, strict=True):
        first.setdefault(url, name)
    return [(name, url) for url, name in first.items()], None


def records(pages: DataFrame, read: Callable[..., Iterator[tuple]], kinds: dict[str, str], column: str = "payload") -> DataFrame:
    """A row for each tuple that ``read`` gives for a page and the values of its other columns, which stay beside it."""
    kept = [c for c in pages.columns if c != column]
    arrow_kinds = [_ARROW[k] for k in kinds.values()]

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            of_page: list[int] = []
            rows: list[tuple] = []

            def made(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), arrow_kinds, strict=True)]
                index = pa.array(of_page, pa.int32())
                return pa.RecordBatch.from_arrays([*(c.take(index) for c in batch.columns[: len(kept)]), *columns], names=[*kept, *kinds])

            for n in range(len(batch)):
                *values, page = (c[n].as_py() for c in batch.columns)
                for row in read(page or "", *values):
                    rows.append(row)
                    of_page.append(n)
                    if len(rows) == 4096:
                        yield made()
                        of_page, rows = [], []
            if rows:
                yield made()

    types = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), *(f"`{n}` {k}" for n, k in kinds.items())])
    return pages.select(*kept, F.col(column).cast("string").alias(column)).mapInArrow(run, types)


LINKS, FILES = "array<struct<name:string,href:string>>", "array<struct<filename:string,url:string>>"
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), LINKS: pa.list_(pa.struct([("name", pa.string()), ("href", pa.string())])), FILES: pa.list_(pa.struct([("filename", pa.string()), ("url", pa.string())]))}


def inside(name: str, nth: int | None = None) -> Column:
    """Whether a part is inside an element with the mark, the given one of its page if a number is given."""
    return F.exists("around", lambda x: (x["mark"] == name) & (F.lit(True) if nth is None else x["nth"] == nth))


# --- what a reader asks of a page; ``nodes`` and ``words`` are its columns


def node(at: Column) -> Column:
    return F.get("nodes", at)


def below(element: Column) -> Column:
    """All descendants, in order."""
    return F.when(element.isNotNull(), F.slice("nodes", element["at"] + 2, element["last"] - element["at"])).otherwise(F.array().cast(f"array<{ELEMENT}>"))


def tagged(elements: Column, *tags: str) -> Column:
    return F.filter(elements, lambda e: e["tag"].isin(*tags))


def children(element: Column, *tags: str) -> Column:
    return F.filter(below(element), lambda e: (e["parent"] == element["at"]) & e["tag"].isin(*tags))


def following(element: Column, *tags: str) -> Column:
    """The next sibling if it has one of the tags, else null."""
    found = node(element["next"])
    return F.when(found["tag"].isin(*tags), found)


def has_class(element: Column, name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(element["classes"], F.lit("")), r"\s+"), name)


def text(element: Column) -> Column:
    """The text of an element and all below, cleaned; "" without one."""
    return F.coalesce(fn.clean(F.substr(F.col("words"), element["begin"] + 1, element["end"] - element["begin"])), F.lit(""))


def links(element: Column, base: str | Column) -> Column:
    """(filename, url) of the anchors below: not of mail, telephone or scripts, once an address; unnamed ones by the end of the path."""
    base = F.lit(base) if isinstance(base, str) else base
    found = F.filter(tagged(below(element), "a"), lambda a: (fn.clean(F.coalesce(a["href"], F.lit(""))) != "") & ~F.rlike(F.trim(a["href"]), F.lit("(?i)^(mailto|tel|javascript):")))
    return named(F.transform(found, lambda a: F.struct(text(a).alias("name"), fn.clean(a["href"]).alias("href"))), base)


def named(found: Column, base: Column) -> Column:
    """(filename, url) of (name, href) pairs."""
    named = F.transform(found, lambda a: F.struct(a["name"].alias("filename"), fn.absolute(base, a["href"]).alias("url")))
    named = F.transform(F.filter(named, lambda x: x["url"].isNotNull()), lambda x: F.struct(F.coalesce(F.nullif(x["filename"], F.lit("")), F.try_url_decode(F.substring_index(x["url"], "/", -1))).alias("filename"), x["url"].alias("url")))
    return once(named)


def once(pairs: Column) -> Column:
    """(filename, url) pairs with the first of each address."""
    urls = F.transform(pairs, lambda x: x["url"])
    return F.filter(pairs, lambda x, i: F.array_position(urls, x["url"]) == i + 1)
