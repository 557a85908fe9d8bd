"""Gradient-boosted oblivious trees for yes/no labels, in numpy.

Each level of a tree asks one question of all its nodes, so a prediction is a few comparisons and one look-up
for each tree, on all rows at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """``feature`` and ``threshold``: (trees, depth); ``leaves``: (trees, 2 ** depth); ``base``: the log-odds that all start from."""

    feature: np.ndarray
    threshold: np.ndarray
    leaves: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        columns = np.ascontiguousarray(x.T)
        for features, thresholds, leaves in zip(self.feature, self.threshold, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for f, t in zip(features, thresholds, strict=True):
                at = at << 1 | (columns[f] > t)
            out += leaves[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 2.0) -> Trees:
    """By Newton steps on the logistic loss; splits between quantiles. The same rows give the same trees."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, curvature = y - p, p * (1 - p)
        at, own_f, own_t = np.zeros(n, np.int64), [], []
        for level in range(depth):
            best = (-1.0, 0, 0.0)
            for f in range(width):
                size = len(edges[f]) + 1
                if size == 1:
                    continue
                cell = at * size + binned[f]
                g = np.bincount(cell, gradient, (1 << level) * size).reshape(-1, size)
                h = np.bincount(cell, curvature, (1 << level) * size).reshape(-1, size)
                left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
                right_g, right_h = g.sum(axis=1, keepdims=True) - left_g, h.sum(axis=1, keepdims=True) - left_h
                gain = (left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge)).sum(axis=0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, float(edges[f][k]))
            _, f, t = best
            own_f.append(f)
            own_t.append(t)
            at = at << 1 | (x[:, f] > t)
        g, h = np.bincount(at, gradient, 1 << depth), np.bincount(at, curvature, 1 << depth)
        value = rate * g / (h + ridge)
        score += value[at]
        features.append(own_f)
        thresholds.append(own_t)
        leaves.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)
