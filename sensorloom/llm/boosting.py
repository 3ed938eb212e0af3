"""Gradient-boosted trees for two classes, on binned features."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Trees of a fixed depth as arrays: a node's feature and threshold, a leaf's value."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 2.0, least: int = 15):
        self.n, self.depth, self.rate, self.ridge, self.least = trees, depth, rate, ridge, least
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x = np.asarray(x, np.float32)
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        edges = [np.unique((e[:-1] + e[1:]) / 2) if len(e) > 1 else e for e in edges]
        bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-score))
            score += self._grow(bins, edges, p - y, p * (1 - p))
        return self

    def _grow(self, bins: np.ndarray, edges: list, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
        rows, width = bins.shape
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        node = np.zeros(rows, np.int64)  # place within the level
        for level in range(self.depth):
            size, start = 1 << level, (1 << level) - 1
            cells = size * BINS
            best, which, where = np.full(size, 1e-6), np.zeros(size, np.int64), np.full(size, -1)
            for f in range(width):
                if not len(edges[f]):
                    continue
                at = node * BINS + bins[:, f]
                g, h, c = (np.bincount(at, v, cells).reshape(size, BINS).cumsum(axis=1) for v in (grad, hess, None))
                gl, hl, cl = g[:, :-1], h[:, :-1], c[:, :-1]
                gr, hr, cr = g[:, -1:] - gl, h[:, -1:] - hl, c[:, -1:] - cl
                gain = gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - g[:, -1:] ** 2 / (h[:, -1:] + self.ridge)
                gain[(cl < self.least) | (cr < self.least)] = 0
                j = gain.argmax(axis=1)
                value = gain[np.arange(size), j]
                won = value > best
                best[won], which[won], where[won] = value[won], f, j[won]
            for k in range(size):
                if where[k] >= 0 and where[k] < len(edges[which[k]]):
                    feature[start + k], cut[start + k] = which[k], edges[which[k]][where[k]]
            split = np.where((where >= 0), where, BINS)
            node = 2 * node + (bins[np.arange(rows), which[node]] > split[node])
        leaves = 1 << self.depth
        value = -np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + self.ridge) * self.rate
        self.trees.append((feature, cut, value))
        return value[node]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float32)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - ((1 << self.depth) - 1)]
        return out
