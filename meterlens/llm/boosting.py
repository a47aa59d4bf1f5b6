"""Gradient-boosted trees for two classes on few columns: binned features, full trees of a fixed depth, logistic loss."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 1.0, least: int = 5) -> None:
        self.n, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.base = float(np.log(p / (1 - p)))
        if not len(y) or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
        z = np.full(len(y), self.base)
        for _ in range(self.n):
            q = 1 / (1 + np.exp(-z))
            g, h = q - y, np.maximum(q * (1 - q), 1e-6)
            node, inner = np.zeros(len(y), np.int64), (1 << self.depth) - 1
            column, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for at in range(inner):
                own = np.flatnonzero(node == at)
                best = (1e-6, 0, np.inf, None)
                if len(own) >= 2 * self.least:
                    gs, hs = g[own].sum(), h[own].sum()
                    for f, e in enumerate(edges):
                        b = binned[own, f]
                        gl, hl, nl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[own], h[own], None))
                        gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                        gain[(nl < self.least) | (len(own) - nl < self.least)] = 0
                        if len(gain) and gain.max() > best[0]:
                            k = int(gain.argmax())
                            best = (float(gain[k]), f, float(e[k]), binned[own, f] > k)
                column[at], cut[at] = best[1], best[2]
                node[own] = 2 * at + 1 + (best[3] if best[3] is not None else 0)
            leaf = node - inner
            value = -self.rate * np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + self.l2)
            z += value[leaf]
            self.trees.append((column, cut, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for column, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, column[node]] > cut[node])
            z += value[node - len(column)]
        return 1 / (1 + np.exp(-z))
