"""Small gradient-boosted trees on a bounded table of dense features, with isotonic calibration."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trees:
    """Logistic boosting of complete binary trees over quantile bins (second-order leaf values)."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 2.0, least: int = 8):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
        margin = np.full(n, self.base)
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            prob = _sigmoid(margin)
            grad, hess = prob - y, prob * (1 - prob)
            feature, threshold, leaf = np.zeros(inner, np.int32), np.full(inner, np.inf), np.zeros(inner + 1)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, wide = 2**level - 1, 2**level
                best, where, cut_at = np.full(wide, 1e-6), np.zeros(wide, np.int64), np.full(wide, self.bins)
                for f in range(width):
                    if not len(cuts[f]):
                        continue
                    key, size = node * self.bins + binned[f], wide * self.bins
                    g = np.bincount(key, grad, size).reshape(wide, -1).cumsum(1)
                    h = np.bincount(key, hess, size).reshape(wide, -1).cumsum(1)
                    c = np.bincount(key, minlength=size).reshape(wide, -1).cumsum(1)
                    gain = g**2 / (h + self.ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + self.ridge) - g[:, -1:] ** 2 / (h[:, -1:] + self.ridge)
                    gain[(c < self.least) | (c[:, -1:] - c < self.least)] = 0
                    gain[:, len(cuts[f]) :] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(wide), at]
                    better = top > best
                    best[better], where[better], cut_at[better] = top[better], f, at[better]
                for k in range(wide):
                    if cut_at[k] < self.bins:
                        feature[first + k], threshold[first + k] = where[k], cuts[where[k]][cut_at[k]]
                node = node * 2 + (x[np.arange(n), feature[first + node]] > threshold[first + node])
            g, h = np.bincount(node, grad, inner + 1), np.bincount(node, hess, inner + 1)
            leaf = -self.rate * g / (h + self.ridge)
            margin += leaf[node]
            self.trees.append((feature, threshold, leaf))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (x[rows, feature[at]] > threshold[at])
            out += leaf[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (block centres, block means), each mean drawn to the middle by ``weight`` rows."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([s, v, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2] + a[2]]
    b = np.array(blocks)
    means = np.maximum.accumulate((b[:, 1] + weight * y.mean()) / (b[:, 2] + weight))
    return b[:, 0] / b[:, 2], means


class Calibrated:
    """Trees whose margins of held-out folds fix an isotonic map to probabilities."""

    def __init__(self, **trees):
        self.args = trees

    def fit(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray, held: list[np.ndarray] | None = None) -> Calibrated:
        """``fold`` numbers each row's fold; ``held[k]`` has the features of all rows as learned without fold k, ``x`` by default."""
        self.model = None
        self.prior = float(y.mean()) if len(y) else 0.0
        if len(y) >= 20 and 0 < y.sum() < len(y):
            out = np.full(len(y), np.nan)
            for k in np.unique(fold):
                rest = fold != k
                if rest.any() and 0 < y[rest].sum() < rest.sum():
                    z = x if held is None else held[k]
                    out[~rest] = Trees(**self.args).fit(z[rest], y[rest]).margin(z[~rest])
            self.model = Trees(**self.args).fit(x, y)
            told = ~np.isnan(out)
            self.at, self.value = isotonic(out[told], y[told]) if told.any() else (np.zeros(1), np.array([self.prior]))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.model is None:
            return np.full(len(x), self.prior)
        m = self.model.margin(x)
        # between blocks the map is linear; a trace of the margin keeps the order inside one
        return np.clip(0.999 * np.interp(m, self.at, self.value) + 0.001 * _sigmoid(m), 0, 1)
