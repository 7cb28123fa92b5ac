"""Small gradient-boosted trees in numpy: logistic loss, histogram splits, fixed depth."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Binary classifier; features are small floats, cut into at most ``bins`` bins by quantiles.

    Trees are complete binary trees of ``depth`` levels kept as arrays, so a batch walks a tree with
    ``depth`` vector steps. Ties between splits go to the lower feature and the lower cut.
    """

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        if len(y) == 0 or y.min() == y.max():
            self.base = 6.0 if len(y) and y.max() > 0 else -6.0
            return self
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins)[:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._tree(binned, cuts, y - p, p * (1 - p))
            self.nodes.append(tree)
            score += self._walk(x, tree)
        return self

    def _tree(self, binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> tuple:
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        at = np.zeros(len(grad), dtype=np.int64)
        width = self.bins + 1
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-9)
            for f, c in enumerate(cuts):
                key = (at - first) * width + binned[:, f]
                g = np.bincount(key, grad, count * width).reshape(count, width)
                h = np.bincount(key, hess, count * width).reshape(count, width)
                gl, hl = g.cumsum(1)[:, : len(c)], h.cumsum(1)[:, : len(c)]
                ga, ha = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gain = gl**2 / (hl + self.least) + (ga - gl) ** 2 / (ha - hl + self.least) - ga**2 / (ha + self.least)
                top = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(count), top] > best):
                    best[k] = gain[k, top[k]]
                    feature[first + k], cut[first + k] = f, c[top[k]]
            low = np.stack([binned[:, f] for f in range(len(cuts))], axis=1)[np.arange(len(at)), feature[at]]
            edge = np.array([np.searchsorted(cuts[feature[n]], cut[n]) if np.isfinite(cut[n]) else width for n in range(inner)])
            at = 2 * at + 1 + (low > edge[at])
        leaf = at - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        return feature, cut, self.rate * g / (h + self.least)

    def _walk(self, x: np.ndarray, tree: tuple) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
        return value[at - len(feature)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of class 1."""
        total = np.full(len(x), self.base)
        for tree in self.nodes:
            total += self._walk(x, tree)
        return 1 / (1 + np.exp(-total))
