"""HTML extraction (1): a tree-structured graphical model over the DOM.

Nodes are block elements and the runs of text in them; each is content or not. A node's potential comes from its tag,
its class, id and role words and, for text, its length, links and punctuation; an edge's potential couples parent and
child by the child's kind. Sum-product messages, once up and once down the tree, give the marginal of every node, and
runs whose marginal is over one half are the text. The weights are fitted by maximum likelihood on labelled pages
(:mod:`tessera.llm.html_pages`), where the same messages give the expected counts.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_of

#: Fixed values of HTML: elements without content, without text for readers, and those that part blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template svg math iframe object canvas audio video textarea select title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup legend li main menu nav ol p pre section summary table caption thead tbody tfoot tr td th ul button label option optgroup".split()
)
#: A start tag of the first kind ends an open element of the second, up to the nearest of the third.
_ENDS_P = BLOCK - {"button", "label", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
_SCOPE = {"table", "td", "th", "caption", "button", "html"}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+|[^>]*)>|<[!?][^>]*>|</?[a-zA-Z!?][^>]*\Z""", re.S)
#: An attribute from the left: its name, and its value by kind of quotes.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?|["'=]""")
_WORD = re.compile(r"[a-z]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Tree:
    """Nodes in page order. ``text`` is None for elements; ``linked`` counts a run's characters inside links."""

    def __init__(self) -> None:
        self.parent, self.tag, self.names, self.text, self.linked = [-1], ["html"], [()], [None], [0]

    def add(self, parent: int, tag: str, names: tuple[str, ...] = (), text: str | None = None, linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


def parse(page: str) -> Tree:
    """The blocks of a page and their text: entities decoded, white space as one space, inline elements dissolved."""
    tree, at = Tree(), 0
    opened: list[tuple[str, int, bool]] = [("html", 0, False)]  # tag, its block node, whether it hides its content
    where: dict[str, list[int]] = {"html": [0]}  # the depths at which a tag is open
    blocks = [0]  # the depths of open blocks
    run: list[str] = []
    in_link = linked = hidden = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                tree.add(opened[-1][1], "#text", (), text, linked)
            run.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if not hidden and raw:
            text = entities.unescape(raw) if "&" in raw else raw
            run.append(text)
            if in_link:
                linked += len(text)

    def pop(depth: int) -> None:
        nonlocal in_link, hidden
        if blocks[-1] >= depth:
            flush()
        for tag, _, hides in opened[depth:]:
            in_link -= tag == "a"
            hidden -= hides
            where[tag].pop()
        del opened[depth:]
        while blocks[-1] >= depth:
            blocks.pop()

    def last(tags: Iterable[str]) -> int:
        """The depth of the innermost open element of these tags; 0 if there is none inside the page."""
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    def end(tags: Iterable[str], scope: Iterable[str]) -> None:
        if (depth := last(tags)) > last(scope):
            pop(depth)

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if (depth := last((tag,))) > (0 if tag in BLOCK or tag == "a" or tag in HIDDEN else blocks[-1]):
                pop(depth)
            continue
        if tag in ("br", "hr"):
            if tag == "hr":
                flush()
            else:
                say(" ")
            continue
        if tag in VOID:
            continue
        if tag in ("html", "body"):
            if tag == "body":
                end({"head"}, {"html"})
            continue
        if tag in _ENDS_P:
            end({"p"}, _SCOPE)
        if tag in _ENDS:
            end(*_ENDS[tag])
        found, hides = [], tag in HIDDEN
        for name, a, b, c in _ATTRIBUTE.findall(m[3]):
            value, name = a or b or c, name.lower()
            if name in ("class", "id", "role"):
                found += _WORD.findall(value.lower())
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _INVISIBLE.search(value)):
                hides = True
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        node = opened[-1][1]
        if tag in BLOCK:
            flush()
            node = tree.add(node, tag, tuple(dict.fromkeys(found)))
            blocks.append(len(opened))
        where.setdefault(tag, []).append(len(opened))
        opened.append((tag, node, hides))
        hidden += hides
        in_link += tag == "a"
    flush()
    return tree


def features(tree: Tree, node: int) -> list[str]:
    """Names of the features of a node that its potential sums."""
    text = tree.text[node]
    if text is None:
        return ["t:" + tree.tag[node], *["c:" + x for x in tree.names[node]]]
    words, dense = text.count(" ") + 1, tree.linked[node] / len(text)
    size = "1" if words < 3 else "3" if words < 8 else "8" if words < 20 else "20" if words < 50 else "50"
    link = "none" if not dense else "some" if dense < 0.5 else "most"
    return ["x:" + size, "l:" + link, "e:" + ("stop" if text[-1] in ".!?:\"'”»…)" else "open"), "p:" + tree.tag[tree.parent[node]], *(["y:right"] if "©" in text else [])]


def _kind(tag: str) -> str:
    return tag if tag in ("#text", "p", "div", "section", "ul", "ol", "li", "aside", "form", "nav", "footer", "header") else "h" if re.fullmatch("h[1-6]", tag) else "other"


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


class Model:
    """Weights of features (towards content) and of edges (by the child's kind, parent's and child's label)."""

    def __init__(self, unary: dict[str, float], edges: dict[tuple[str, int, int], float]) -> None:
        self.unary, self.edges = unary, edges
        self._tables: dict[str, tuple[float, float, float, float]] = {}

    def table(self, tag: str) -> tuple[float, float, float, float]:
        found = self._tables.get(tag)
        if found is None:
            k = _kind(tag)
            found = self._tables[tag] = tuple(self.edges.get((k, b, a), 0.0) for b in (0, 1) for a in (0, 1))
        return found

    def beliefs(self, tree: Tree) -> tuple[list[float], list[float], list[float]]:
        """Of each node: the log odds of content, what came up from below and itself, and what its parent knows without it."""
        weight = self.unary.get
        up = [sum(weight(f, 0.0) for f in features(tree, k)) for k in range(len(tree.tag))]
        message = [0.0] * len(up)
        for k in range(len(up) - 1, 0, -1):
            e00, e01, e10, e11 = self.table(tree.tag[k])
            message[k] = _log_sum(e11 + up[k], e10) - _log_sum(e01 + up[k], e00)
            up[tree.parent[k]] += message[k]
        full, rest = list(up), [0.0] * len(up)
        for k in range(1, len(up)):
            e00, e01, e10, e11 = self.table(tree.tag[k])
            rest[k] = full[tree.parent[k]] - message[k]
            full[k] = up[k] + _log_sum(e11 + rest[k], e01) - _log_sum(e10 + rest[k], e00)
        return full, up, rest

    def text(self, page: str | None) -> str:
        """The runs more likely content than not, in page order."""
        tree = parse(page or "")
        full, _, _ = self.beliefs(tree)
        return "\n\n".join(t for t, odds in zip(tree.text, full, strict=True) if t is not None and odds > 0)


def labels_of(tree: Tree, content: set[str]) -> list[int]:
    """Labels of a training page: runs by their text, elements by whether most of their characters are content."""
    inside, total = [0] * len(tree.tag), [0] * len(tree.tag)
    for k in range(len(tree.tag) - 1, -1, -1):
        if tree.text[k] is not None:
            total[k] = len(tree.text[k])
            inside[k] = total[k] if tree.text[k] in content else 0
        if k:
            inside[tree.parent[k]] += inside[k]
            total[tree.parent[k]] += total[k]
    return [int(2 * a > b) for a, b in zip(inside, total, strict=True)]


def train(pages: list[tuple[str, list[str]]], epochs: int = 16, rate: float = 0.5, shrink: float = 0.002) -> Model:
    """Maximum likelihood by adaptive gradient steps, page by page: observed less expected counts."""
    known = [(tree, labels_of(tree, set(blocks))) for tree, blocks in ((parse(p), b) for p, b in pages)]
    model, squares = Model({}, {}), {}

    def move(weights: dict, key, gradient: float) -> None:
        gradient -= shrink * weights.get(key, 0.0)
        squares[key] = squares.get(key, 1e-6) + gradient * gradient
        weights[key] = weights.get(key, 0.0) + rate * gradient / math.sqrt(squares[key])

    for _ in range(epochs):
        for tree, labels in known:
            model._tables = {}
            full, up, rest = model.beliefs(tree)
            unary, edges = {}, {}
            for k, label in enumerate(labels):
                miss = label - 1 / (1 + math.exp(-max(min(full[k], 500), -500)))
                for f in features(tree, k):
                    unary[f] = unary.get(f, 0.0) + miss
                if k:
                    e = model.table(tree.tag[k])
                    scores = [e[2 * b + a] + a * up[k] + b * rest[k] for b in (0, 1) for a in (0, 1)]
                    top = max(scores)
                    mass = [math.exp(s - top) for s in scores]
                    seen = 2 * labels[tree.parent[k]] + label
                    for j in range(4):
                        key = (_kind(tree.tag[k]), j // 2, j % 2)
                        edges[key] = edges.get(key, 0.0) + (j == seen) - mass[j] / sum(mass)
            for weights, gradients in ((model.unary, unary), (model.edges, edges)):
                for key, gradient in gradients.items():
                    move(weights, key, gradient)
    model._tables = {}
    return model


@functools.cache
def trained() -> Model:
    """The model of the labelled pages; fitted once a process."""
    from tessera.llm.html_pages import labelled_pages

    return train(labelled_pages())


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url", model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row. Null pages count as empty and have the empty text; ids and urls may
    be null or repeated; columns other than these three aren't looked at."""
    fitted = model or trained()
    unary, edges = fitted.unary, fitted.edges

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(unary, edges)
        for batch in batches:
            texts, at, held = [], 0, 0
            for k, page in enumerate(batch.column(2)):
                texts.append(model.text(page.as_py()))
                held += len(texts[-1])
                if held > 4_000_000 or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                    at, held, texts = k + 1, 0, []

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
