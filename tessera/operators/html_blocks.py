"""HTML to rows: the element stream, key-value and list detection, tables and navigation lists, and chunks from them."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.operators import chunking as C
from tessera.operators import tables as B

_HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_KEPT = _HEADS | {"p", "div", "ul", "ol", "li", "section", "article"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BREAKS_P = _HEADS | {"p", "div", "ul", "ol", "section", "article", "table", "nav", "header", "footer", "form", "pre", "blockquote", "aside", "main", "dl"}


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "depth", "span", "order", "last", "listed")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []
        self.depth = parent.depth + 1 if parent else 0

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order, without recursion."""
        stack = [x for x in reversed(self.items) if isinstance(x, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.items) if isinstance(x, Node))

    def text(self) -> str:
        """Stripped text fragments joined without a separator."""
        out, stack = [], list(reversed(self.items))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                if x.tag not in ("script", "style"):
                    stack.extend(reversed(x.items))
            elif s := x.strip():
                out.append(s)
        return "".join(out)

    def children(self, tag: str) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node) and x.tag == tag]

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").lower().split()


class _Builder(HTMLParser):
    """Open elements are a path, and of each tag the depths at which it is open: closing needs no climb."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.path, self.open = [self.root], defaultdict(list)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _BREAKS_P:
            self._close({"p"}, {"table", "td", "th", "li"})
        if tag == "li":
            self._close({"li"}, {"ul", "ol"})
        if tag in ("td", "th"):
            self._close({"td", "th"}, {"tr", "table"})
        if tag == "tr":
            self._close({"tr"}, {"table"})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.path[-1])
        self.path[-1].items.append(node)
        if tag not in _VOID:
            self.path.append(node)
            self.open[tag].append(node.depth)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._close({tag}, set())

    def handle_data(self, data: str) -> None:
        self.path[-1].items.append(data)

    def _close(self, tags: set[str], scope: set[str]) -> None:
        """Closes the innermost of ``tags``, unless one of ``scope`` is open within it."""
        deepest = lambda names: max((self.open[t][-1] for t in names if self.open[t]), default=0)
        depth = deepest(tags)
        if depth and depth > deepest(scope):
            while self.path[-1].depth >= depth:
                self.open[self.path.pop().tag].pop()


def dom(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


class Page:
    """A page's elements in document order. The stripped text fragments of the page are one string, of which each element has
    a span, and its descendants are a run of the order: one walk finds what each element holds and whether a list holds it."""

    def __init__(self, page: str) -> None:
        self.root = dom(page)
        self.nodes: list[Node] = []
        pieces: list[str] = []
        at, stack = 0, [(self.root, iter(self.root.items))]
        self._enter(self.root, 0, False)
        while stack:
            node, items = stack[-1]
            for x in items:
                if isinstance(x, Node):
                    self._enter(x, at, node.listed or node.tag in ("ul", "ol"))
                    stack.append((x, iter(x.items if x.tag not in ("script", "style") else [i for i in x.items if isinstance(i, Node)])))
                    break
                if piece := x.strip():
                    pieces.append(piece)
                    at += len(piece)
            else:
                node.span, node.last = (node.span[0], at), len(self.nodes) - 1
                stack.pop()
        self.whole = "".join(pieces)
        places = lambda *tags: [n.order for n in self.nodes if n.tag in tags]
        self.terms, self.spans = places("dt", "dd"), places("span")

    def _enter(self, node: Node, at: int, listed: bool) -> None:
        node.span, node.order, node.listed = (at, at), len(self.nodes), listed
        self.nodes.append(node)

    def text(self, node: Node) -> str:
        """Stripped text fragments joined without a separator."""
        return self.whole[node.span[0] : node.span[1]]

    def inside(self, node: Node, places: list[int]) -> tuple[int, int]:
        """The run of ``places`` that are descendants of the node."""
        return bisect_right(places, node.order), bisect_right(places, node.last)


def _is_pair(text: str) -> bool:
    """Exactly one colon, hyphen or equals sign, with something on both sides of it."""
    for sign in ":-=":
        first = text.find(sign)
        if 0 < first < len(text) - 1 and text.find(sign, first + 1) < 0:
            return True
    return False


def is_key_value(page: Page, node: Node, text: str) -> bool:
    """By the line patterns, a definition list, a label and a value span, or class names."""
    if _is_pair(text):
        return True
    first, end = page.inside(node, page.terms)
    if first < end:
        return True
    first, end = page.inside(node, page.spans)
    if end - first == 2:
        label, value = (page.nodes[k] for k in page.spans[first:end])
        if any("label" in c for c in label.classes) and any("value" in c for c in value.classes):
            return True
    return any(name in c for c in node.classes for name in ("metric", "kv", "key-value"))


def elements(html: str, max_level: int = 3) -> list[tuple[str, int | None, str]]:
    """(kind, level, text) in document order; text of nested containers comes with each of them."""
    out: list[tuple[str, int | None, str]] = []
    page = Page(html)
    for node in page.nodes:
        if node.tag not in _KEPT or (node.tag not in ("ul", "ol") and node.listed):
            continue
        text = page.text(node)
        if not text:
            continue
        if node.tag in _HEADS:
            if (level := int(node.tag[1])) <= max_level:
                out.append(("heading", level, text))
        elif node.tag in ("ul", "ol"):
            if listed := "\n".join(f"• {t}" for x in node.children("li") if (t := page.text(x))):
                out.append(("list", None, listed))
        elif node.tag != "li":
            out.append(("kv" if is_key_value(page, node, text) else "text", None, text))
    return out


def clean_blocks(html: str) -> list[tuple[str, int | None, str]]:
    """Content tags only: without navigation, headers, footers, forms and scripts; ordered lists are numbered."""
    ignored = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "iframe", "button", "svg"}
    out: list[tuple[str, int | None, str]] = []
    page = Page(html)
    stack = [page.root]
    while stack:
        node = stack.pop()
        if node.tag in ignored:
            continue
        if node.tag in _HEADS:
            out.append(("heading", int(node.tag[1]), page.text(node)))
        elif node.tag in ("ul", "ol"):
            items = [page.text(x) for x in node.children("li")]
            out.append(("list", None, "\n".join(f"{i}. {t}" if node.tag == "ol" else f"• {t}" for i, t in enumerate(filter(None, items), 1))))
        elif node.tag in ("p", "blockquote", "pre"):
            out.append(("text", None, page.text(node)))
        else:
            stack.extend(x for x in reversed(node.items) if isinstance(x, Node))
    return [x for x in out if x[2]]


def _number(text: str) -> bool:
    try:
        float(text.strip().translate({ord(c): None for c in "$,%()"}).strip())
    except ValueError:
        return False
    return True


def tables(page: str) -> list[tuple[int, int, int, str, bool, bool]]:
    """(table, row, col, text, column_header, row_header); spans aren't filled. Headers are th, or words in the first
    row or column."""
    return _tables(dom(page))


def _tables(root: Node) -> list[tuple[int, int, int, str, bool, bool]]:
    out = []
    for t, table in enumerate(x for x in root.walk() if x.tag == "table"):
        rows = [x for x in table.walk() if x.tag == "tr"]
        for r, row in enumerate(rows):
            for c, cell in enumerate(x for x in row.items if isinstance(x, Node) and x.tag in ("td", "th")):
                text = " ".join(cell.text().split())
                head = cell.tag == "th"
                words = bool(text) and not _number(text)
                out.append((t, r, c, text, head and r == 0 or r == 0 and words, c == 0 and r > 0 and (head or words)))
    return out


def table_titles(page: str) -> list[tuple[int, str]]:
    """(table, title): its caption if that is under 100 characters, else the last heading under the nearest of three
    ancestors that has one, else contents by its class names; tables without any are left out."""
    return _titles(dom(page))


def _titles(root: Node) -> list[tuple[int, str]]:
    out = []
    for t, table in enumerate(x for x in root.walk() if x.tag == "table"):
        caption = next((x.text() for x in table.walk() if x.tag == "caption"), "")
        title, up = caption if 0 < len(caption) < 100 else "", table.parent
        for _ in range(3):
            if title or up is None:
                break
            heading = next((h for x in reversed([x for x in up.walk() if x.tag in _HEADS]) if (h := x.text())), "")
            title, up = heading and f"Table: {heading}", up.parent
        if not title and any(hint in " ".join(table.classes) for hint in P.CONTENTS_CLASSES):
            title = "Table of Contents"
        if title:
            out.append((t, title))
    return out


def table_rows(page: str) -> list[tuple[int, int, list[str], bool, str | None]]:
    """(table, row, cells, header, title) of the rows that have cells, of a page that is parsed once; a header's cells all are."""
    root = dom(page)
    titles, cells = dict(_titles(root)), defaultdict(list)
    for t, r, _, text, column_header, _ in _tables(root):
        cells[t, r].append((text, column_header))
    return [(t, r, [x for x, _ in row], all(h for _, h in row), titles.get(t)) for (t, r), row in cells.items()]


def _contents(nodes: list[Node]) -> Iterator[Node]:
    """The first element at each of the places where a page lists its contents, in the places' order."""
    for tag, name in P.CONTENTS_PLACES:
        for node in nodes:
            if tag == "nav ul":
                up = node.parent if node.tag == "ul" else None
                while up is not None and up.tag != "nav":
                    up = up.parent
                found = up is not None
            else:
                found = (tag is None or node.tag == tag) and name in node.classes
            if found:
                yield node
                break


def nav_links(page: str) -> list[tuple[int, str, str, int]]:
    """(ord, title, target, level) of the first list of contents with a title: its links, else its items."""
    for root in _contents(list(dom(page).walk())):
        inside, out = list(root.walk()), []
        for item in [x for x in inside if x.tag == "a"] or [x for x in inside if x.tag in ("li", "div")]:
            depth, up = 0, item.parent
            while up is not None:
                depth += up.tag in ("ul", "ol")
                up = None if up is root else up.parent
            hint = next((int(m[1]) for c in item.classes if (m := re.fullmatch(r"level-(\d)", c))), None)
            if title := item.text():
                out.append((len(out), title, item.attrs.get("href", ""), depth or hint or 1))
        if out:
            return out
    return []


def _rows(pages: DataFrame, find, schema: str, html: str, id_col: str) -> DataFrame:
    """One row for each tuple that ``find`` makes of a page; ids stay strings or become longs."""
    kept = "string" if dict(pages.dtypes)[id_col] == "string" else "long"
    schema = schema.replace("doc_id long", f"doc_id {kept}")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
        kinds = [known[f.split()[1]] for f in schema.split(", ")]
        for batch in batches:
            rows, held = [], 0
            for doc_id, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [(doc_id, *x) for x in find(page.as_py() or "")]
                rows += found
                held += sum(len(v) if isinstance(v, str) else sum(map(len, v)) for x in found for v in x if isinstance(v, (str, list)))
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return pages.select(F.col(id_col).cast(kept).alias("doc_id"), F.col(html).cast("string")).mapInArrow(run, schema)


def element_stream(pages: DataFrame, max_level: int = 3, clean: bool = False, html: str = "html", id_col: str = "page_id") -> DataFrame:
    """(doc_id, ord, kind, level, text)."""
    find = (lambda p: [(k, *x) for k, x in enumerate(clean_blocks(p))]) if clean else (lambda p: [(k, *x) for k, x in enumerate(elements(p, max_level))])
    return _rows(pages, find, "doc_id long, ord int, kind string, level int, text string", html, id_col)


def html_tables(pages: DataFrame, html: str = "html", id_col: str = "page_id") -> DataFrame:
    return _rows(pages, tables, "doc_id long, table_no int, row int, col int, text string, column_header boolean, row_header boolean", html, id_col)


def html_table_titles(pages: DataFrame, html: str = "html", id_col: str = "page_id") -> DataFrame:
    return _rows(pages, table_titles, "doc_id long, table_no int, label string", html, id_col)


def html_table_chunks(pages: DataFrame, html: str = "html", id_col: str = "page_id") -> DataFrame:
    """Chunks of the tables of pages, as :func:`tessera.operators.tables.table_chunks` makes them."""
    table_id = F.concat(F.lit("html_table_"), F.col("table_no").cast("string")).alias("table_id")
    rows = _rows(pages, table_rows, "doc_id long, table_no int, row int, cells array<string>, header boolean, label string", html, id_col)
    return B.titled_chunks(rows.select("doc_id", table_id, "row", "cells", F.lit(False).alias("section"), "header", "label"))


def html_toc(pages: DataFrame, html: str = "html", id_col: str = "page_id") -> DataFrame:
    return _rows(pages, nav_links, "doc_id long, ord int, title string, target string, level int", html, id_col)


def chunk_html(pages: DataFrame, html: str = "html", id_col: str = "page_id", clean: bool = False) -> DataFrame:
    """Chunks of pages, as :func:`tessera.operators.chunking.chunk_markdown` makes them of text."""
    units = element_stream(pages, html=html, id_col=id_col, clean=clean)
    out = C.number(C.merge_short(C.paragraphs(C.with_lineage(units))))
    return out.withColumn("headings_path", C.T.headings_path(F.col("h1"), F.col("h2"), F.col("h3")))
