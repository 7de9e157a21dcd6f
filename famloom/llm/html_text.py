"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element and each text of a page is a node that is main text or not.  A node's
potential comes from its tag, the stems of its class, id and role, and the length, link
share and place of the text below it; each edge between parent and child has a potential
by the child's kind.  Sum-product messages go up the tree and down again, by levels over
all pages of a batch at once, and give each text's marginal.  The weights are fitted by
conditional likelihood on labelled pages (``FIT_PAGES`` drawn ones, or the caller's own).

Text blocks whose marginal is above one half are joined in page order.  Menus, forms,
buttons, scripts, styles and what is not shown never count as main text.  White space is
what ``str.split`` parts at, no-break spaces included.

Defined cases.  Null or empty html, or html without text, gives an empty text.  Each row
gives one row, repeated and null ids and urls included; other columns are not read.
Unclosed and crossing tags are mended as browsers do for the common cases; a tag that is
cut off at the end of the page is dropped.  A page is one unit of work: its nodes take
some 1 KB each, and its text a few times its size.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from famloom.llm.common import release_memory, slices
from famloom.llm.labelled_pages import labelled_pages

#: Labelled pages that the model is fitted on when the caller brings none.
FIT_PAGES = 300

# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
_NEVER = frozenset(
    "head script style textarea title noscript iframe noembed noframes template svg math object canvas select option"
    " button form nav menu dialog datalist audio video".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1"
    " h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
#: An opening tag ends these open ones, up to one of the fences.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
    "body": (("head",), ()),
}
_MARKUP = re.compile(
    r"<(?:!--(.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)"
    r"|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|(\Z)))",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"(?<![\w-])(class|id|role|itemprop|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I
)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Letters of a class or id word that count.
STEM = 5

TEXT = "#text"
_SENTENCE = re.compile(r"[.!?](?:\s|$)")


@functools.lru_cache(maxsize=4096)
def _stems(value: str) -> tuple[str, ...]:
    return tuple(sorted({"~" + p.lower()[:STEM] for p in _PARTS.findall(value[:200])}))


@dataclass
class Tree:
    """Nodes in page order; node 0 is the page.  ``breaks``: a block edge stands before the text."""

    parent: list[int]
    tag: list[str]
    stems: list[tuple[str, ...]]
    text: list[str]
    breaks: list[bool]
    label: list[int]
    never: list[bool]


def parse(page: str) -> Tree:
    """The page's tree; raw elements keep no text."""
    tree = Tree([-1], ["#page"], [()], [""], [False], [-1], [False])
    stack = [0]
    edge = False
    at = 0

    def add_text(raw: str) -> None:
        nonlocal edge
        if not raw:
            return
        here = stack[-1]
        tree.parent.append(here)
        tree.tag.append(TEXT)
        tree.stems.append(())
        tree.text.append(html.unescape(raw) if "&" in raw else raw)
        tree.breaks.append(edge)
        tree.label.append(tree.label[here])
        tree.never.append(tree.never[here])
        edge = False

    def pop_to(place: int) -> None:
        del stack[place:]

    def last(names: Sequence[str], fences: Sequence[str]) -> int | None:
        for place in range(len(stack) - 1, 0, -1):
            tag = tree.tag[stack[place]]
            if tag in names:
                return place
            if tag in fences:
                return None
        return None

    while True:
        found = _MARKUP.search(page, at)
        if found is None:
            add_text(page[at:])
            break
        add_text(page[at : found.start()])
        at = found.end()
        name = found[3]
        if name is None or found[5] is not None:  # a comment or declaration, or cut off at the end
            continue
        name = name.lower()
        if name not in _INLINE:
            edge = True
        if found[2]:  # an end tag
            place = last((name,), ("table",) if name != "table" else ())
            if place is not None:
                pop_to(place)
            continue
        if name in _CLOSES_P:
            place = last(("p",), ("button", "table", "td", "th", "object", "caption"))
            if place is not None:
                pop_to(place)
        if name in _ENDS:
            closed, fences = _ENDS[name]
            while (place := last(closed, fences)) is not None:
                pop_to(place)
        if name == "br":
            tree_text = tree.text
            if tree.tag[-1] == TEXT:
                tree_text[-1] += "\n"
            continue
        here = stack[-1]
        label, stems = tree.label[here], ()
        if "=" in found[4]:
            words: set[str] = set()
            for key, *values in _ATTRIBUTE.findall(found[4]):
                value = values[0] or values[1] or values[2]
                if key.lower() == "data-y":
                    label = int(value)
                else:
                    words.update(_stems(value))
            stems = tuple(sorted(words))
        node = len(tree.parent)
        tree.parent.append(here)
        tree.tag.append(name)
        tree.stems.append(stems)
        tree.text.append("")
        tree.breaks.append(False)
        tree.label.append(label)
        tree.never.append(tree.never[here] or name in _NEVER)
        if name in _RAW:
            end = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in _VOID:
            stack.append(node)
    return tree


def main_text(tree: Tree, main: Sequence[bool]) -> str:
    """Texts marked in ``main``, white space collapsed, block edges as one space."""
    parts = []
    edge = False
    for text, breaks, tag, chosen in zip(tree.text, tree.breaks, tree.tag, main):
        if tag != TEXT:
            continue
        edge = edge or breaks
        if chosen:
            parts.append(" " + text if edge else text)
            edge = False
    return " ".join("".join(parts).split())


@dataclass
class Forest:
    """Trees of many pages as arrays; features as (node, name) pairs."""

    parent: np.ndarray
    depth_groups: list[np.ndarray]
    kind: np.ndarray
    never: np.ndarray
    rows: np.ndarray
    columns: np.ndarray


def _binned(values: np.ndarray, edges: Sequence[float]) -> np.ndarray:
    return np.searchsorted(np.asarray(edges), values, side="right")


#: Names of the numeric features and the bounds of their bins.
_BINS: dict[str, Sequence[float]] = {
    "chars": (1, 10, 30, 80, 160, 320, 800, 2500),
    "share": (0.01, 0.03, 0.1, 0.25, 0.5, 0.75, 0.9),
    "links": (0.01, 0.2, 0.5, 0.9),
    "sentences": (1, 2, 4, 10),
    "before": (0.001, 0.1, 0.3, 0.6, 0.9, 0.999),
    "paragraphs": (1, 2, 4, 8),
    "texts": (1, 2, 4, 10),
}


def forest(trees: Sequence[Tree], names: dict[str, int], learn: bool = False) -> Forest:
    """Join trees; ``names`` maps a feature to its column and grows only when learning."""
    sizes = [len(t.parent) for t in trees]
    starts = np.cumsum([0, *sizes])
    parent = np.concatenate([np.asarray(t.parent) + s for t, s in zip(trees, starts)])
    count = int(starts[-1])
    roots = starts[:-1]
    parent[roots] = roots
    tags = [tag for t in trees for tag in t.tag]
    texts = [text for t in trees for text in t.text]
    never = np.array([n for t in trees for n in t.never], bool)
    is_text = np.array([tag == TEXT for tag in tags])
    chars = np.array([len(" ".join(x.split())) if x else 0 for x in texts], np.float64)
    chars[never] = 0
    depth = np.zeros(count, np.int64)
    linked = np.zeros(count, bool)
    for i in range(count):  # parents come first
        up = parent[i]
        if up != i:
            depth[i] = depth[up] + 1
            linked[i] = linked[up]
        if tags[i] == "a":
            linked[i] = True
    order = np.argsort(depth, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if count else []
    below = {
        "chars": chars.copy(),
        "linked": np.where(linked, chars, 0.0),
        "sentences": np.array([len(_SENTENCE.findall(x)) if x else 0 for x in texts], np.float64),
        "paragraphs": np.array([float(tag == "p") for tag in tags]),
        "texts": (is_text & (chars > 0)).astype(np.float64),
    }
    for group in reversed(groups[1:]):
        for sums in below.values():
            _add_up(sums, parent[group], sums[group])
    page = np.repeat(np.arange(len(trees)), sizes)
    total = np.maximum(below["chars"][roots], 1)[page]
    running = np.cumsum(chars) - chars
    before = running - np.repeat(running[roots], sizes)
    values = {
        "chars": below["chars"],
        "share": below["chars"] / total,
        "links": below["linked"] / np.maximum(below["chars"], 1),
        "sentences": below["sentences"],
        "before": before / total,
        "paragraphs": below["paragraphs"],
        "texts": below["texts"],
    }
    rows, columns = [np.arange(count)], []

    def column(name: str) -> int:
        if learn:
            return names.setdefault(name, len(names))
        return names.get(name, -1)

    columns.append(np.array([column("<" + tag) for tag in tags], np.int64))
    rows.append(np.arange(count))
    columns.append(np.array([column(f"{tags[up]}>{tag}") for up, tag in zip(parent.tolist(), tags)], np.int64))
    stems = [(i, s) for t, start in zip(trees, starts) for i, own in enumerate(t.stems, int(start)) for s in own]
    rows.append(np.array([i for i, _ in stems], np.int64))
    columns.append(np.array([column(s) for _, s in stems], np.int64))
    for name, edges in _BINS.items():
        place = _binned(values[name], edges)
        for kind, mine in (("text", is_text), ("element", ~is_text)):
            codes = np.array([column(f"{kind} {name} {b}") for b in range(len(edges) + 1)])
            rows.append(np.flatnonzero(mine))
            columns.append(codes[place[mine]])
    signs = np.flatnonzero(np.array(["©" in x for x in texts], bool))
    rows += [signs, parent[signs]]
    columns += [np.full(len(signs), column("©")), np.full(len(signs), column("©"))]
    all_rows, all_columns = np.concatenate(rows), np.concatenate(columns)
    known = all_columns >= 0
    kind = np.where(is_text, 0, np.where([tag in _INLINE for tag in tags], 1, np.where([bool(s) for t in trees for s in t.stems], 2, 3)))
    return Forest(parent, groups, kind, never, all_rows[known], all_columns[known])


def _add_up(sums: np.ndarray, parents: np.ndarray, values: np.ndarray) -> None:
    """Add children's values to their parents'; siblings of one depth stand together."""
    heads = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
    sums[parents[heads]] += np.add.reduceat(values, heads, axis=0)


def marginals(woods: Forest, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chance of main text of each node, joint chances [node, parent's label, own label]).

    ``edges[kind, parent's label, own label]`` are log potentials.
    """
    count = len(woods.parent)
    unary = np.bincount(woods.rows, weights=weights[woods.columns], minlength=count)
    unary[woods.never] = -60.0
    inside = np.zeros((count, 2))
    inside[:, 1] = unary
    up = np.zeros((count, 2))
    for group in reversed(woods.depth_groups[1:]):
        own, table = inside[group], edges[woods.kind[group]]
        up[group] = np.logaddexp(table[:, :, 0] + own[:, :1], table[:, :, 1] + own[:, 1:])
        up[group] -= up[group].max(axis=1, keepdims=True)
        _add_up(inside, woods.parent[group], up[group])
    belief = inside.copy()
    joint = np.zeros((count, 2, 2))
    for group in woods.depth_groups[1:]:
        table = edges[woods.kind[group]]
        rest = belief[woods.parent[group]] - up[group]  # the parent without this child
        both = rest[:, :, None] + table + inside[group][:, None, :]
        both -= both.max(axis=(1, 2), keepdims=True)
        belief[group] = np.logaddexp(both[:, 0], both[:, 1])
        chance = np.exp(both)
        joint[group] = chance / chance.sum(axis=(1, 2), keepdims=True)
    belief -= belief.max(axis=1, keepdims=True, initial=-np.inf)
    chance = np.exp(belief)
    return chance[:, 1] / chance.sum(axis=1), joint


@dataclass(frozen=True)
class Model:
    names: dict[str, int]
    weights: np.ndarray
    edges: np.ndarray


def fit(pages: Sequence[str], steps: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Model:
    """Weights of greatest conditional likelihood of the pages' ``data-y`` labels (Adam steps)."""
    trees = [parse(p) for p in pages]
    names: dict[str, int] = {}
    woods = forest(trees, names, learn=True)
    labels = np.array([max(0, y) for t in trees for y in t.label])
    labels[woods.never] = 0
    labels[[0, *np.cumsum([len(t.parent) for t in trees])[:-1]]] = 0
    children = np.flatnonzero(woods.parent != np.arange(len(labels)))
    seen = np.zeros((4, 2, 2))
    np.add.at(seen, (woods.kind[children], labels[woods.parent[children]], labels[children]), 1)
    scale = 1 / len(pages)
    free = ~woods.never
    wanted = np.bincount(woods.columns, weights=(labels * free)[woods.rows], minlength=len(names))
    point = np.zeros(len(names) + 16)
    first, second = np.zeros_like(point), np.zeros_like(point)
    kinds = woods.kind[children]
    for step in range(1, steps + 1):
        weights, edges = point[: len(names)], point[len(names) :].reshape(4, 2, 2)
        chance, joint = marginals(woods, weights, edges)
        expected = np.bincount(woods.columns, weights=(chance * free)[woods.rows], minlength=len(names))
        pairs = np.stack([joint[children[kinds == kind]].sum(axis=0) for kind in range(4)])
        slope = np.r_[wanted - expected, (seen - pairs).ravel()] * scale - ridge * point
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        point = point + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(names, point[: len(names)], point[len(names) :].reshape(4, 2, 2))


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    """Fitted on ``FIT_PAGES`` drawn pages."""
    return fit(labelled_pages(FIT_PAGES))


def main_texts(pages: Sequence[str], model: Model) -> list[str]:
    """Main text of each page."""
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    chance, _ = marginals(forest(trees, model.names), model.weights, model.edges)
    out, start = [], 0
    for tree in trees:
        out.append(main_text(tree, (chance[start : start + len(tree.parent)] > 0.5).tolist()))
        start += len(tree.parent)
    return out


def _extractor(model: Model) -> Callable:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", 1 << 20):
            texts = main_texts(part.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )
            release_memory()

    return extract


def extract_text(
    pages: DataFrame, key: str = "page_id", url: str = "url", content: str = "html", model: Model | None = None
) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of ``pages``."""
    chosen = pages.select(
        F.col(key).cast("bigint").alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(content), F.lit("")).alias("html"),
    )
    return chosen.mapInArrow(
        _extractor(model or default_model()), "page_id bigint, url string, text string, n_chars bigint"
    )
