"""Main text of web pages by a tree-structured graphical model.

The nodes are the page's block elements and runs of text; each is in one of two
states, with or without main text. A node's own features and a parent-child
potential of each edge make a conditional random field on the tree, so that
messages passed once upward and once downward give exact marginals. The
weights are fitted by the gradient of the log-likelihood, which is the
difference of observed and expected features, on labelled pages made from
templates (TRAINING_PAGES). A run is taken if its marginal is at least THRESHOLD.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolith.llm.html_dom import Page, read
from kinolith.llm.html_pages import MARK, pages
from kinolith.llm.shared import add_columns, by_bytes, free_names

TRAINING_PAGES = 600
STEPS, RATE, PENALTY = 120, 0.15, 2e-4
THRESHOLD = 0.5
#: Features that fewer training nodes have get no weight.
LEAST_SEEN = 3
#: Bytes of pages whose trees are worked on together.
GROUP_BYTES = 4 << 20

_END = (".", "!", "?", "…", "。", ":", ";", '"', "”", "»")


def _bin(n: float) -> int:
    return int(np.log2(n + 1) * 1.5)


def node_features(page: Page) -> list[list[str]]:
    """Features of each node: its form, the words of its class, id and role, how much text and how many links it holds."""
    many = len(page.parent)
    chars, links, runs, ends = ([0] * many for _ in range(4))
    for i in range(many - 1, -1, -1):
        if i in page.texts:
            text = page.texts[i]
            chars[i], links[i], runs[i], ends[i] = len(text), page.link[i], 1, text.endswith(_END)
        above = page.parent[i]
        if above >= 0:
            chars[above] += chars[i]
            links[above] += links[i]
            runs[above] += runs[i]
            ends[above] += ends[i]
    found = []
    for i in range(many):
        tag, above = page.tag[i], page.parent[i]
        density = min(4, int(5 * links[i] / max(1, chars[i])))
        if i in page.texts:
            text = page.texts[i]
            holder = page.tag[above] if above >= 0 else "top"
            own = ["run", f"run in {holder}", f"run links {density}", f"run length {min(_bin(len(text.split())), 11)}", f"run end {ends[i]}"]
            own.append(f"run size {density > 2} {_bin(text.count(' ') + 1) // 3} {ends[i]}")
            if "©" in text or "copyright" in text[:200].lower():
                own.append("run copyright")
        else:
            own = [f"tag {tag}", f"links {density}", f"{tag} links {density > 2}", f"runs {min(_bin(runs[i]), 9)}", f"ends {int(4 * ends[i] / max(1, runs[i]))}", f"text {min(_bin(chars[i]) // 2, 10)}"]
            own += [f"mark {m}" for m in page.marks[i]]
            own.append("marked" if page.marks[i] else "plain")
        found.append(own)
    return found


def edge_features(page: Page) -> list[list[str]]:
    """Features of the edge to each node's parent; none at the top."""
    return [[] if (p := page.parent[i]) < 0 else ["edge", f"from {page.tag[p]}", f"to {page.tag[i]}", f"{page.tag[p]} {page.tag[i]}"] for i in range(len(page.parent))]


class Forest:
    """Trees of several pages as arrays: parents, levels and the known features of nodes and edges."""

    def __init__(self, trees: Sequence[Page], nodes: dict[str, int], edges: dict[str, int]):
        self.sizes = [len(t.parent) for t in trees]
        starts = np.cumsum([0, *self.sizes])
        parent, level, own, tie = [], [], ([], []), ([], [])
        for tree, start in zip(trees, starts, strict=False):
            depth: list[int] = []
            for i, (p, node, edge) in enumerate(zip(tree.parent, node_features(tree), edge_features(tree), strict=True)):
                parent.append(p + start if p >= 0 else -1)
                depth.append(depth[p] + 1 if p >= 0 else 0)
                for names, known, (at, what) in ((node, nodes, own), (edge, edges, tie)):
                    for name in names:
                        if name in known:
                            at.append(start + i)
                            what.append(known[name])
            level += depth
        self.parent, level = np.array(parent, np.int64), np.array(level, np.int64)
        self.own, self.tie = (tuple(np.array(x, np.int64) for x in pair) for pair in (own, tie))
        order = np.argsort(level, kind="stable")
        cuts = np.cumsum(np.bincount(level)) if len(level) else []
        self.levels = np.split(order, cuts[:-1]) if len(level) else []

    def potentials(self, weights: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each node, and log potentials of its edge by (state of the parent, own state)."""
        many = len(self.parent)
        own = np.bincount(self.own[0], weights[self.own[1]], many)
        edge = np.stack([np.bincount(self.tie[0], ties[self.tie[1], k], many) for k in range(4)], axis=1)
        return own, edge.reshape(many, 2, 2)

    def marginals(self, own: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each node's marginal, and the joint distribution of each edge's two states.

        Messages are log ratios. Upward, a node tells its parent what its whole
        subtree says; downward, the parent what all the rest of the page says.
        """
        below, up = own.copy(), np.zeros(len(own))
        for nodes in reversed(self.levels[1:]):
            b, e = below[nodes], edge[nodes]
            up[nodes] = np.logaddexp(e[:, 1, 0], e[:, 1, 1] + b) - np.logaddexp(e[:, 0, 0], e[:, 0, 1] + b)
            np.add.at(below, self.parent[nodes], up[nodes])
        whole, joint = below.copy(), np.zeros((len(own), 2, 2))
        for nodes in self.levels[1:]:
            above, b, e = whole[self.parent[nodes]] - up[nodes], below[nodes], edge[nodes]
            whole[nodes] = b + np.logaddexp(e[:, 0, 1], e[:, 1, 1] + above) - np.logaddexp(e[:, 0, 0], e[:, 1, 0] + above)
            logs = e + above[:, None, None] * np.array([[0, 0], [1, 1]]) + b[:, None, None] * np.array([[0, 1], [0, 1]])
            logs = np.exp(logs - logs.max(axis=(1, 2), keepdims=True))
            joint[nodes] = logs / logs.sum(axis=(1, 2), keepdims=True)
        return whole, joint


class Model:
    """Weights of a field; bounded by the features of the training pages."""

    def __init__(self, nodes: dict[str, int], edges: dict[str, int]):
        self.nodes, self.edges = nodes, edges
        self.weights, self.ties = np.zeros(len(nodes)), np.zeros((len(edges), 4))

    def marginals(self, trees: Sequence[Page]) -> list[np.ndarray]:
        """The probability of main text at each node of each tree."""
        forest = Forest(trees, self.nodes, self.edges)
        odds, _ = forest.marginals(*forest.potentials(self.weights, self.ties))
        return np.split(1 / (1 + np.exp(-np.clip(odds, -500, 500))), np.cumsum(forest.sizes)[:-1])

    def extract(self, texts: Sequence[str], threshold: float = THRESHOLD) -> list[str]:
        """Main text of each page: its runs of at least that marginal, in page order, with two line ends between."""
        trees = [read(t) for t in texts]
        return [
            "\n\n".join(text for i, text in sorted(tree.texts.items()) if chance[i] >= threshold)
            for tree, chance in zip(trees, self.marginals(trees), strict=True)
        ]


def labelled(page: str) -> tuple[Page, np.ndarray]:
    """The tree of a marked page, and for each node whether it holds main text; the marks are taken out."""
    tree = read(page)
    state = np.zeros(len(tree.parent), bool)
    for i, text in tree.texts.items():
        state[i] = MARK in text
        tree.texts[i] = text.replace(MARK, "")
    for i in range(len(state) - 1, 0, -1):
        if state[i] and tree.parent[i] >= 0:
            state[tree.parent[i]] = True
    return tree, state


def fit(marked: Sequence[str]) -> Model:
    """A field fitted to labelled pages: gradient steps of Adam's kind on the penalised log-likelihood."""
    known = [labelled(p) for p in marked]
    trees, states = [t for t, _ in known], np.concatenate([s for _, s in known])
    counts: tuple[dict[str, int], dict[str, int]] = ({}, {})
    for tree in trees:
        for seen, features in zip(counts, (node_features(tree), edge_features(tree)), strict=True):
            for name in (n for names in features for n in names):
                seen[name] = seen.get(name, 0) + 1
    model = Model(*({n: i for i, n in enumerate(sorted(n for n, c in seen.items() if c >= LEAST_SEEN))} for seen in counts))
    forest = Forest(trees, model.nodes, model.edges)
    inner = np.flatnonzero(forest.parent >= 0)
    observed = np.zeros((len(states), 4))
    observed[inner, 2 * states[forest.parent[inner]] + states[inner]] = 1
    # weights and ties are stepped together
    size, many = len(model.weights), len(known)
    values = np.zeros(size + model.ties.size)
    mean, square = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, STEPS + 1):
        own, edge = forest.potentials(values[:size], values[size:].reshape(-1, 4))
        odds, joint = forest.marginals(own, edge)
        off = states - 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        tied = observed - joint.reshape(-1, 4)
        slope = np.concatenate(
            [
                np.bincount(forest.own[1], off[forest.own[0]], size),
                np.stack([np.bincount(forest.tie[1], tied[forest.tie[0], k], len(model.ties)) for k in range(4)], axis=1).ravel(),
            ]
        )
        slope = slope / many - PENALTY * values
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        values += RATE * (1 - step / (STEPS + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    model.weights, model.ties = values[:size], values[size:].reshape(-1, 4)
    return model


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    """Fitted to TRAINING_PAGES drawn pages, once a driver."""
    return fit(list(pages(TRAINING_PAGES)))


_MODELS: dict[str, Model] = {}


def extract(pages: DataFrame, model: Model | None = None, column: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of pages with text, the main text, and n_chars, its code points; columns of those names are replaced.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
    markup and comments of readers are left out. Blocks come in page order with
    two line ends between them, white space inside a block is one space. A null
    or empty page, or one without main text, has an empty text. Malformed and
    truncated pages are read as far as they go, very long ones whole, with
    memory for themselves only; rows are neither joined nor grouped, so repeated
    rows get equal texts and an empty table gives no rows. Equal marginals
    cannot matter, as each run is decided by itself.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())  # bounded by the training pages
    name_of_model = uuid.uuid4().hex
    (source,) = free_names(pages, "page_source")
    rows = pages.withColumn(source, F.coalesce(F.col(column).cast("string"), F.lit("")))

    def answer(batch):
        import pyarrow as pa

        if name_of_model not in _MODELS:  # a worker keeps its model for later tasks
            _MODELS.clear()
            _MODELS[name_of_model] = shared.value
        texts = batch.column(batch.schema.get_field_index(source)).to_pylist()
        found: list[str] = []
        for group in by_bytes(((t,) for t in texts), GROUP_BYTES, lambda t: len(t[0])):
            found += _MODELS[name_of_model].extract([t for (t,) in group], threshold)
        return [pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())]

    return add_columns(rows, [("text", "string"), ("n_chars", "long")], answer).drop(source)
