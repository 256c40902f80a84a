"""Gradient boosted trees of depth two for small numeric tables, with isotonic calibration."""

from __future__ import annotations

import numpy as np


def _best_split(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, penalty: float = 1.0):
    """(gain, feature, limit) of the split x[:, feature] <= limit with the largest gain."""
    total_g, total_w = gradient.sum(), weight.sum()
    base = total_g**2 / (total_w + penalty)
    best = (0.0, 0, np.inf)
    for feature in range(x.shape[1]):
        order = np.argsort(x[:, feature], kind="stable")
        values = x[order, feature]
        g, w = np.cumsum(gradient[order])[:-1], np.cumsum(weight[order])[:-1]
        gain = g**2 / (w + penalty) + (total_g - g) ** 2 / (total_w - w + penalty) - base
        gain[values[1:] == values[:-1]] = -1
        if len(gain) and gain.max() > best[0] + 1e-12:
            at = int(gain.argmax())
            best = (float(gain[at]), feature, float((values[at] + values[at + 1]) / 2))
    return best


class BoostedTrees:
    """Logistic loss, Newton leaves. A tree is a root split and one split on either side."""

    def __init__(self, rounds: int = 40, rate: float = 0.3):
        self.rounds, self.rate = rounds, rate
        self.trees: list[tuple] = []
        self.start = 0.0
        self.steps = (np.array([0.0]), np.array([0.5]))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            gradient, weight = y - p, p * (1 - p)
            gain, feature, limit = _best_split(x, gradient, weight)
            if gain <= 0:
                break
            tree = [feature, limit]
            for side in (x[:, feature] <= limit, x[:, feature] > limit):
                _, f, at = _best_split(x[side], gradient[side], weight[side])
                leaves = []
                for leaf in (x[side, f] <= at, x[side, f] > at):
                    g, w = gradient[side][leaf].sum(), weight[side][leaf].sum()
                    leaves.append(float(self.rate * g / (w + 1.0)))
                tree += [f, at, *leaves]
            self.trees.append(tuple(tree))
            margin += self._one(tree, x)
        return self

    @staticmethod
    def _one(tree, x: np.ndarray) -> np.ndarray:
        feature, limit, f0, at0, a, b, f1, at1, c, d = tree
        left = np.where(x[:, f0] <= at0, a, b)
        right = np.where(x[:, f1] <= at1, c, d)
        return np.where(x[:, feature] <= limit, left, right)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for tree in self.trees:
            total += self._one(tree, x)
        return total

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Isotonic regression of held-out labels on margins, by pooling neighbours that are out of order."""
        margin = self.margin(x)
        order = np.argsort(margin, kind="stable")
        pools: list[list[float]] = []  # sum, count, first margin
        for m, label in zip(margin[order], y[order], strict=True):
            if pools and pools[-1][2] == m:
                pools[-1][0] += label
                pools[-1][1] += 1
            else:
                pools.append([float(label), 1.0, float(m)])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                total, count, _ = pools.pop()
                pools[-1][0] += total
                pools[-1][1] += count
        self.steps = (np.array([p[2] for p in pools]), np.array([p[0] / p[1] for p in pools]))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        at = np.searchsorted(self.steps[0], self.margin(x), side="right") - 1
        return self.steps[1][np.maximum(at, 0)]
