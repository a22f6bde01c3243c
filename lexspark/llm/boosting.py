"""Gradient-boosted trees for binary labels in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, trees of fixed depth over quantile bins; leaves carry Newton steps."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 16, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        quantiles = np.quantile(x, np.linspace(0, 1, self.bins + 1)[1:-1], axis=0)
        cuts = [np.unique(quantiles[:, f]) for f in range(x.shape[1])]
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, cuts, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self.rate * self._values(tree, x)
        return self

    def _grow(self, x, cuts, g, h):
        inner = (1 << self.depth) - 1
        feature, at, leaf = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(inner + 1)
        node = np.zeros(len(x), int)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = 1e-9
            gs, hs = g[rows].sum(), h[rows].sum()
            for f, c in enumerate(cuts):
                if len(rows) < 2 or not len(c):
                    continue
                b = np.searchsorted(c, x[rows, f], side="left")
                gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                i = int(gain.argmax())
                if gain[i] > best:
                    best, feature[k], at[k] = gain[i], f, c[i]
            node[rows] = 2 * k + 1 + (x[rows, feature[k]] > at[k])
        for k in range(inner + 1):
            rows = node == inner + k
            leaf[k] = g[rows].sum() / (h[rows].sum() + self.ridge)
        return feature, at, leaf

    def _values(self, tree, x):
        feature, at, leaf = tree
        node = np.zeros(len(x), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > at[node])
        return leaf[node - len(feature)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self.rate * self._values(tree, x)
        return 1 / (1 + np.exp(-score))
