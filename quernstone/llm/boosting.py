"""Gradient-boosted trees for a yes-or-no answer, on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class Boosting:
    """Trees of a fixed depth as arrays: a feature and a bin for each inner node, a value for each leaf."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 4.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosting:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])).astype(np.float32) for j in range(x.shape[1])]
        binned = self._bin(x)
        n, width = x.shape[1], self.bins
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.feature = np.zeros((self.trees, 2**self.depth - 1), np.int32)
        self.split = np.zeros((self.trees, 2**self.depth - 1), np.uint8)
        self.value = np.zeros((self.trees, 2**self.depth), np.float32)
        raw = np.full(len(y), self.base)
        for t in range(self.trees):
            p = 0.5 * np.tanh(0.5 * raw) + 0.5
            g, h = p - y, p * (1 - p)
            at = np.zeros(len(y), np.int64)  # place within the level
            for level in range(self.depth):
                wide = 2**level
                gain = np.full((wide, n, width), -np.inf)
                for j in range(n):
                    key = at * width + binned[:, j]
                    gs = np.bincount(key, g, wide * width).reshape(wide, width).cumsum(1)
                    hs = np.bincount(key, h, wide * width).reshape(wide, width).cumsum(1)
                    gr, hr = gs[:, -1:] - gs, hs[:, -1:] - hs
                    ok = (hs > self.least * 0.05) & (hr > self.least * 0.05)
                    gain[:, j] = np.where(ok, gs**2 / (hs + self.ridge) + gr**2 / (hr + self.ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge), -np.inf)
                best = gain.reshape(wide, -1).argmax(1)
                good = np.isfinite(gain.reshape(wide, -1)[np.arange(wide), best])
                feature, split = np.where(good, best // width, 0), np.where(good, best % width, 255)
                inner = slice(wide - 1, 2 * wide - 1)
                self.feature[t, inner], self.split[t, inner] = feature, split
                at = 2 * at + (binned[np.arange(len(y)), feature[at]] > split[at])
            sums, weights = np.bincount(at, g, 2**self.depth), np.bincount(at, h, 2**self.depth)
            self.value[t] = -self.rate * sums / (weights + self.ridge)
            raw += self.value[t][at]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        binned, rows = self._bin(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, split, value in zip(self.feature, self.split, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = at + 2**level - 1
                at = 2 * at + (binned[rows, feature[node]] > split[node])
            out += value[at]
        return out
