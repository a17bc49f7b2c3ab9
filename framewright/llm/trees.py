"""Gradient-boosted trees on binned features and isotonic calibration, for bounded samples; numpy only."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of complete trees. Node i of a tree has children 2i+1 and 2i+2; leaves hold log-odds."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 2.0, least: int = 4) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, d = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # bin > i: value > edges[i]
        p = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        margin, offsets = np.full(n, self.base), np.arange(d) * self.bins
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-margin))
            g, h = y - prob, prob * (1 - prob)
            node = np.zeros(n, np.int64)
            inner, leaves = (1 << self.depth) - 1, 1 << self.depth
            feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(self.depth):
                width, first = 1 << level, (1 << level) - 1
                key = ((node[:, None] * d * self.bins) + offsets[None] + binned).ravel()
                sums = [np.bincount(key, np.repeat(v, d), width * d * self.bins).reshape(width, d, self.bins).cumsum(2) for v in (g, h, np.ones(n))]
                (gl, hl, nl), (gt, ht, nt) = sums, [s[:, :, -1:] for s in sums]
                gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                gain[(nl < self.least) | (nt - nl < self.least)] = 0
                for j, e in enumerate(edges):
                    gain[:, j, len(e) :] = 0
                best = gain.reshape(width, -1).argmax(1)
                for k in range(width):
                    j, cut = divmod(int(best[k]), self.bins)
                    if gain[k, j, cut] > 1e-9:
                        feature[first + k], threshold[first + k] = j, edges[j][cut]
                node = node * 2 + (x[np.arange(n), feature[first + node]] > threshold[first + node])
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.l2)
            self.trees.append((feature, threshold, value))
            margin += value[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = node * 2 + (x[rows, feature[at]] > threshold[at])
            out += value[node]
        return out


class Isotonic:
    """Monotone calibration by pooling adjacent violators, linear between the pools' centres."""

    def fit(self, s: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(s, kind="stable")
        pools: list[list[float]] = []  # weight, sum of y, sum of s
        for a, b in zip(s[order].tolist(), y[order].tolist(), strict=True):
            pools.append([1.0, b, a])
            while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
                last = pools.pop()
                pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
        self.at = np.array([p[2] / p[0] for p in pools])
        self.to = np.array([p[1] / p[0] for p in pools])
        return self

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return np.interp(s, self.at, self.to).clip(0, 1)
