"""Gradient-boosted trees on dense features and isotonic calibration, in numpy.

Fitting takes arrays of bounded size on the driver; the fitted model is a few kilobytes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Logistic loss, second-order leaf values, trees of `depth` levels over quantile bins."""

    trees: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 64
    penalty: float = 1.0
    least: float = 2.0
    edges: list[np.ndarray] = field(default_factory=list)
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """x: rows by features; y: 0 or 1."""
        n, width = x.shape
        self.edges = [np.unique(np.quantile(np.unique(x[:, f]), np.linspace(0, 1, self.bins)))[:-1] for f in range(width)]
        binned, size = self._binned(x), self.bins + 1
        flat = binned + np.arange(width) * size
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        margin = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            inner = (1 << self.depth) - 1
            feature, cut = np.zeros(inner, np.int64), np.full(inner, size, np.int64)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                key = ((at - first)[:, None] * (width * size) + flat).ravel()
                gs = np.bincount(key, np.repeat(g, width), count * width * size).reshape(count, width, size).cumsum(2)
                hs = np.bincount(key, np.repeat(h, width), count * width * size).reshape(count, width, size).cumsum(2)
                gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
                gain = gs**2 / (hs + self.penalty) + (gt - gs) ** 2 / (ht - hs + self.penalty) - gt**2 / (ht + self.penalty)
                gain[(hs < self.least) | (ht - hs < self.least)] = -1
                best = gain.reshape(count, -1).argmax(1)
                good = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
                feature[first : first + count] = np.where(good, best // size, 0)
                cut[first : first + count] = np.where(good, best % size, size)
                at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > cut[at])
            leaf = at - inner
            value = -self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.penalty)
            self.nodes.append((feature, cut, value))
            margin += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1."""
        binned, out, rows = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
            out += value[at - len(feature)]
        return out


@dataclass
class Isotonic:
    """Nondecreasing fit by pooling adjacent violators; linear between the pools' means."""

    x: np.ndarray
    y: np.ndarray

    @staticmethod
    def fit(score: np.ndarray, label: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        xs, ys = score[order].astype(float), label[order].astype(float)
        pools: list[list[float]] = []
        for x, y in zip(xs, ys, strict=True):
            pools.append([y, 1.0, x])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                top = pools.pop()
                last = pools[-1]
                last[2] = (last[2] * last[1] + top[2] * top[1]) / (last[1] + top[1])
                last[0] += top[0]
                last[1] += top[1]
        return Isotonic(np.array([p[2] for p in pools]), np.array([p[0] / p[1] for p in pools]))

    def apply(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y) if len(self.x) else np.zeros(len(score))
