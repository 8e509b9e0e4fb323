"""Histogram gradient-boosted trees in numpy, fitted on a bounded sample and flattened into arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: node i has the children 2i + 1 and 2i + 2; a row goes right above the cut."""

    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes)
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: float = 4.0) -> Trees:
    """Logistic loss, second-order gains over histograms of quantile bins. No rows give a constant one half."""
    y = y.astype(float)
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    inner, leaves, width = (1 << depth) - 1, 1 << depth, x.shape[1]
    model = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(e, col, "left") for e, col in zip(edges, x.T, strict=True)], axis=1)
    features, cuts, values = [], [], []
    margin = np.full(len(y), base)
    column = np.arange(width) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            keys = ((node - first)[:, None] * (width * bins) + column + binned).ravel()
            shape = (n, width, bins)
            g = np.bincount(keys, np.repeat(grad, width), n * width * bins).reshape(shape).cumsum(axis=2)
            h = np.bincount(keys, np.repeat(hess, width), n * width * bins).reshape(shape).cumsum(axis=2)
            gt, ht = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(h < least / 4) | (ht - h < least / 4)] = 0
            flat = gain.reshape(n, -1)
            best = flat.argmax(axis=1)
            for k in np.flatnonzero(flat[np.arange(n), best] > 1e-6):
                f, b = divmod(int(best[k]), bins)
                if b < len(edges[f]):
                    feature[first + k], at[first + k], cut[first + k] = f, b, edges[f][b]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > at[node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        value = -rate * g / (h + l2)
        margin += value[leaf]
        features.append(feature), cuts.append(cut), values.append(value)
    return Trees(np.stack(features), np.stack(cuts), np.stack(values), base)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (score, share) of the non-decreasing least-squares fit, for np.interp."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
    for s, v in zip(score[order], y[order].astype(float), strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray, **options) -> np.ndarray:
    """Probability of every row by trees that were fitted on the other folds."""
    out = np.full(len(y), 0.5)
    for k in np.unique(fold):
        own = fold == k
        out[own] = fit(x[~own], y[~own], **options).probability(x[own])
    return out
