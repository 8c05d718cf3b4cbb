"""Histogram gradient-boosted trees for a yes/no target, and isotonic calibration.

Fitting works on a bounded sample of labelled rows that has been brought to the driver; the
fitted trees are a few small arrays that go to the tasks. Every tree is a complete binary
tree of a fixed depth, so all of them lie in arrays of one shape and rows walk down together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class Trees:
    """Flattened trees: row t holds tree t, node i has the children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # (trees, inner nodes)
    limit: np.ndarray  # values above go right
    value: np.ndarray  # (trees, leaves)
    start: float
    depth: int

    def margin(self, rows: np.ndarray) -> np.ndarray:
        n = np.arange(len(rows))
        out = np.full(len(rows), self.start)
        first_leaf = (1 << self.depth) - 1
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[n, feature[node]] > limit[node])
            out += value[node - first_leaf]
        return out

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(rows))


def fit(rows: np.ndarray, target: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, ridge: float = 2.0, least: float = 1.0) -> Trees:
    """Trees for log loss: gradients are summed per node, feature and bin, best gains split.

    ``least`` is the smallest sum of second derivatives a child may have. Without rows, or with
    one class only, the result is the smoothed base rate.
    """
    n, n_features = rows.shape
    rate_of_ones = (target.sum() + 0.5) / (n + 1.0)
    start = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if n == 0 or target.min() == target.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start, depth)
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(n_features)]
    binned = np.stack([np.searchsorted(cuts[f], rows[:, f], side="left") for f in range(n_features)], axis=1)
    margin = np.full(n, start)
    features, limits, values = [], [], []
    for _ in range(rounds):
        p = sigmoid(margin)
        grad, hess = p - target, p * (1 - p)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            base, width = (1 << level) - 1, 1 << level
            at = node - base
            best_gain = np.full(width, 1e-6)
            for f in range(n_features):
                if not len(cuts[f]):
                    continue
                cell = at * BINS + binned[:, f]
                g = np.bincount(cell, grad, width * BINS).reshape(width, BINS).cumsum(axis=1)
                h = np.bincount(cell, hess, width * BINS).reshape(width, BINS).cumsum(axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                gain[(h < least) | (all_h - h < least)] = 0
                gain = gain[:, : len(cuts[f])]
                where = gain.argmax(axis=1)
                top = gain[np.arange(width), where]
                better = top > best_gain
                best_gain[better] = top[better]
                feature[base : base + width][better] = f
                limit[base : base + width][better] = cuts[f][where[better]]
            node = 2 * node + 1 + (rows[np.arange(n), feature[node]] > limit[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + ridge)
        margin += value[leaf]
        features.append(feature)
        limits.append(limit)
        values.append(value)
    return Trees(np.array(features), np.array(limits), np.array(values), start, depth)


@dataclass
class Isotonic:
    """A step-free rising curve through pooled (score, rate) points."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        return np.interp(scores, self.x, self.y) if len(self.x) else scores


def fit_isotonic(scores: np.ndarray, target: np.ndarray) -> Isotonic:
    """Pool adjacent violators; rates stay half a row of all away from 0 and 1."""
    if not len(scores) or target.min() == target.max():
        return Isotonic(np.empty(0), np.empty(0))
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []  # sum of targets, rows, sum of scores
    for s, t in zip(scores[order], target[order], strict=True):
        pools.append([float(t), 1.0, float(s)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    x = np.array([p[2] / p[1] for p in pools])
    rates = np.array([p[0] / p[1] for p in pools])
    return Isotonic(x, np.clip(rates, 0.5 / len(scores), 1 - 0.5 / len(scores)))
