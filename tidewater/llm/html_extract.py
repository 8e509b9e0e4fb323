"""Main text of HTML pages by a tree-structured graphical model.

Every node of a page's block tree is a variable: 1 if it belongs to the main text. A node's own features (what kind of
element it is, what its names hint at, how much text it holds, how much of that is linked) make up its potential for 1;
the potential of a parent and a child depends on both labels and on what the two are, so an advert or a thread of
comments may leave the main text and an article may enter it, while most children go with their parents. Sum-product
messages go up and down the tree once, which gives every node's exact marginal; leaves with a marginal of a half or
more are the text. The weights are those that maximise the likelihood of labelled pages, whose gradient needs the same
marginals.

All pages of a batch are one forest, and messages are passed for all nodes of a depth at a time. A page is judged on its
own, so pages need no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import dom
from tidewater.llm.common import map_batches, read_table
from tidewater.llm.html_pages import PAGES, SEED, labelled_pages

ROUNDS, RATE, DECAY = 300, 0.2, 3e-5  # of the fit: steps of Adam, their size, and the weight of the squared weights
N_GROUPS, N_HINTS = len(dom.GROUPS), len(dom.HINTS)
N_NUMBERS = 8
N_OWN, N_EDGE = 1 + N_GROUPS + N_HINTS + N_NUMBERS, 1 + 2 * (N_GROUPS + N_HINTS)  # an edge knows both its ends


@dataclass
class Forest:
    """Nodes of many pages by depth: levels are places where a depth begins; up is the place of the parent, -1 for first nodes."""

    own: np.ndarray
    edge: np.ndarray
    up: np.ndarray
    levels: np.ndarray
    order: np.ndarray
    labels: np.ndarray


def forest(trees: list[dom.Tree]) -> Forest:
    sizes = np.array([len(t.parent) for t in trees], np.int64)
    first = np.cumsum(sizes) - sizes
    cat = lambda name: np.array([x for t in trees for x in getattr(t, name)], np.int64)
    parent, depth, group, hints, labels, linked = (cat(n) for n in ("parent", "depth", "group", "hints", "label", "linked"))
    page = np.repeat(np.arange(len(trees)), sizes)
    parent = np.where(parent >= 0, parent + first[page], -1)
    texts = [x for t in trees for x in t.text]
    chars = np.array([len(x) for x in texts], np.float64)
    words = np.array([x.count(" ") + 1 if x else 0 for x in texts], np.float64)
    stops = np.array([sum(map(x.count, ".!?,;")) for x in texts], np.float64)
    sums = np.stack([chars, words, stops, linked, (chars > 0)], axis=1)
    order = np.argsort(depth, kind="stable")
    levels = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if len(depth) else np.zeros(1, np.int64)
    for a, b in zip(levels[-2:0:-1], levels[:0:-1], strict=False):  # what lies in a node, from the deepest on
        np.add.at(sums, parent[order[a:b]], sums[order[a:b]])
    whole = sums[first][page]
    c, w, s, k, leaves = sums.T
    some = np.maximum(c, 1)
    numbers = np.stack([np.log1p(c) / 8, np.log1p(w) / 6, k / some, (k >= 0.9 * c) & (c > 0), s / np.maximum(w, 1), (s > 0), np.log1p(leaves) / 4, c / np.maximum(whole[:, 0], 1)], axis=1)
    kinds = np.zeros((len(parent), N_GROUPS))
    kinds[np.arange(len(parent)), group] = 1
    bits = (hints[:, None] >> np.arange(N_HINTS)) & 1
    one = np.ones((len(parent), 1))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    up = parent[order]
    what = np.hstack([kinds, bits])
    own, edge = np.hstack([one, what, numbers])[order], np.hstack([one, what, what[np.maximum(parent, 0)]])[order]
    return Forest(own, edge, np.where(up >= 0, place[up], -1), levels, order, labels[order])


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    top = np.maximum(a, b)
    return top + np.log(np.exp(a - top) + np.exp(b - top))


def marginals(f: Forest, own: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(node), P(parent, child) of every node and the logarithm of the sum over all labellings.

    own (nodes, 2) and edge (nodes, 2, 2: parent's label, child's label) are logarithms of potentials.
    """
    inward = own.copy()  # own potential and all messages from below
    message = np.zeros_like(own)
    spans = [slice(a, b) for a, b in zip(f.levels[:-1], f.levels[1:], strict=True)]
    for at in spans[:0:-1]:
        both = edge[at] + inward[at][:, None, :]
        message[at] = _log_sum(both[:, :, 0], both[:, :, 1])
        np.add.at(inward, f.up[at], message[at])
    outward = np.zeros_like(own)  # messages from above
    total = 0.0
    if spans:
        total = float(_log_sum(inward[spans[0], 0], inward[spans[0], 1]).sum())
    for at in spans[1:]:
        up = f.up[at]
        rest = outward[up] + inward[up] - message[at]
        both = edge[at] + rest[:, :, None]
        outward[at] = _log_sum(both[:, 0, :], both[:, 1, :])
        outward[at] -= outward[at].max(axis=1, keepdims=True)
    node = outward + inward
    node = np.exp(node - _log_sum(node[:, 0], node[:, 1])[:, None])
    pair = np.zeros_like(edge)
    for at in spans[1:]:
        up = f.up[at]
        both = edge[at] + (outward[up] + inward[up] - message[at])[:, :, None] + inward[at][:, None, :]
        both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
        pair[at] = both / both.sum(axis=(1, 2), keepdims=True)
    return node, pair, total


@dataclass
class Model:
    """Weights of a node's potential for 1, and of each pair of labels of parent and child."""

    own: np.ndarray
    edge: np.ndarray

    def potentials(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        score = f.own @ self.own
        return np.stack([np.zeros_like(score), score], axis=1), (f.edge @ self.edge.reshape(N_EDGE, 4)).reshape(-1, 2, 2)

    def content(self, trees: list[dom.Tree]) -> np.ndarray:
        """The marginal of label 1 of all nodes, in the order of the trees."""
        f = forest(trees)
        out = np.empty(len(f.up))
        out[f.order] = marginals(f, *self.potentials(f))[0][:, 1]
        return out


def fit(pages: list[str], rounds: int = ROUNDS) -> Model:
    """Maximises the likelihood of the labels in pages, a bounded number of them, by Adam over the exact gradient."""
    f = forest([dom.parse(p) for p in pages])
    if not len(f.up):
        return Model(np.zeros(N_OWN), np.zeros((N_EDGE, 2, 2)))
    y, child = f.labels, np.flatnonzero(f.up >= 0)
    told_own = f.own[y == 1].sum(axis=0)
    told_edge = np.zeros((N_EDGE, 2, 2))
    for p in (0, 1):
        for c in (0, 1):
            told_edge[:, p, c] = f.edge[child[(y[f.up[child]] == p) & (y[child] == c)]].sum(axis=0)
    ends = np.ascontiguousarray(f.edge[child].T)
    model = Model(np.zeros(N_OWN), np.zeros((N_EDGE, 2, 2)))
    state = [np.zeros(N_OWN), np.zeros(N_OWN), np.zeros((N_EDGE, 2, 2)), np.zeros((N_EDGE, 2, 2))]
    for t in range(1, rounds + 1):
        node, pair, _ = marginals(f, *model.potentials(f))
        steps = (told_own - f.own.T @ node[:, 1]) / len(pages) - DECAY * model.own, (told_edge - (ends @ pair[child].reshape(-1, 4)).reshape(N_EDGE, 2, 2)) / len(pages) - DECAY * model.edge
        for k, (g, w) in enumerate(zip(steps, (model.own, model.edge), strict=True)):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return model


@cache
def trained(pages: int = PAGES, seed: int = SEED) -> Model:
    """The model fitted on that many labelled pages."""
    return fit(labelled_pages(pages, seed))


def main_texts(pages: list[str], model: Model, least: float = 0.5) -> list[str]:
    trees = [dom.parse(p) for p in pages]
    marks = iter(model.content(trees) >= least)
    return ["\n\n".join(text for text, mark in zip(t.text, marks, strict=False) if text and mark) for t in trees]


def extract_text(pages: DataFrame, html: str, model: Model, least: float = 0.5) -> DataFrame:
    """The main text of every row, in the column text beside the row's own columns, which lose their html.

    Blocks are joined by an empty line; within a block white space is one space. Defined cases: a null page is an empty
    one, without text; pages without main text have an empty text; unclosed, misplaced and unknown markup is read as
    browsers do; repeated rows have repeated results; no rows give no rows. A column text of the table is replaced.
    """
    kept = [c for c in pages.columns if c not in (html, "text")]
    out = pages.select(F.coalesce(F.col(html).cast("string"), F.lit("")).alias("_html"), *kept)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(batch.column(0).to_pylist(), model, least)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*kept, "text"])

    return map_batches(out, task, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[1:]) + ", text string" if kept else "text string")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages, "html", trained()).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
