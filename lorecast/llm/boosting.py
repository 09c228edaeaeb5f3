"""Gradient boosted trees for a few dozen features, fitted on a bounded sample and carried to the tasks as arrays."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of one depth on binned features; logistic loss. Scores are log odds, ``probability`` applies the calibration."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, smooth: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.smooth = trees, depth, rate, bins, smooth
        self.base, self.slope, self.shift = 0.0, 1.0, 0.0
        self.features: list[np.ndarray] = []  # per tree: the split feature of each inner node, by level
        self.limits: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) if n else np.array([]) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if n else np.zeros((0, m), int)
        p = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(n, self.base)
        width = self.bins + 1
        for _ in range(self.trees if n else 0):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = y - prob, prob * (1 - prob)
            node = np.zeros(n, int)
            split_f, split_v = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                count, first = 2**level, 2**level - 1
                best = np.full(count, 1e-6)
                for j in range(m):
                    cell = node * width + binned[:, j]
                    g = np.bincount(cell, grad, count * width).reshape(count, width).cumsum(1)
                    h = np.bincount(cell, hess, count * width).reshape(count, width).cumsum(1)
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + self.smooth) + (gt - g) ** 2 / (ht - h + self.smooth) - gt**2 / (ht + self.smooth)
                    at = gain[:, : len(edges[j])]
                    if at.shape[1]:
                        k = at.argmax(1)
                        v = at[np.arange(count), k]
                        better = v > best
                        best[better] = v[better]
                        split_f[first : first + count][better] = j
                        split_v[first : first + count][better] = edges[j][k[better]]
                f, v = split_f[first + node], split_v[first + node]
                node = 2 * node + (x[np.arange(n), f] > v)
            leaf_g, leaf_h = np.bincount(node, grad, 2**self.depth), np.bincount(node, hess, 2**self.depth)
            leaf = self.rate * leaf_g / (leaf_h + self.smooth)
            score += leaf[node]
            self.features.append(split_f)
            self.limits.append(split_v)
            self.leaves.append(leaf)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, v, leaf in zip(self.features, self.limits, self.leaves):
            node = np.zeros(len(x), int)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, f[at]] > v[at])
            out += leaf[node]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Platt scaling on rows that were held out; a sample without both classes leaves the scores as they are."""
        if len(y) < 20 or y.min() == y.max():
            return self
        s = self.score(x)
        a, b = 1.0, 0.0
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * s + b)))
            w = p * (1 - p) + 1e-9
            g = np.array([((p - target) * s).sum(), (p - target).sum()])
            h = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-6:
                break
        if np.isfinite(a) and np.isfinite(b) and a > 0:
            self.slope, self.shift = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.score(x) + self.shift)))
