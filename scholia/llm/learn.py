"""Small learners in numpy: boosted trees, isotonic calibration, linear hinge loss.

They are fitted on the driver on bounded samples and travel to executors in
closures; their sizes are set by parameters, never by the data.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Isotonic:
    """Least-squares non-decreasing fit by pooling adjacent violators, linear between block means."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        if not len(x):
            self.x, self.y = np.array([0.0]), np.array([0.5])
            return self
        order = np.argsort(x, kind="stable")
        blocks: list[list[float]] = []  # sum of x, sum of y, rows
        for a, b in zip(x[order], y[order], strict=True):
            blocks.append([a, b, 1.0])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
        table = np.array(blocks)
        self.x, self.y = table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)


class BoostedTrees:
    """Gradient-boosted trees of fixed depth over binned dense features, for log loss."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, smooth: float = 1.0, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.smooth, self.least = trees, depth, rate, bins, smooth, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        self.base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))) if n else 0.0
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not n:
            return self
        cuts = [np.unique(np.quantile(np.unique(x[:, j]), np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for j in range(width)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)
        f = np.full(n, self.base)
        for _ in range(self.trees):
            p = sigmoid(f)
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            nodes = 2**self.depth - 1
            feature, cut, leaf = np.full(nodes, -1), np.zeros(nodes), np.zeros(2 * nodes + 1)
            at = np.zeros(n, dtype=np.int64)
            for node in range(nodes):
                rows = np.flatnonzero(at == node)
                best = self._split(binned[rows], grad[rows], hess[rows]) if len(rows) > 1 else None
                go = np.zeros(len(rows), dtype=np.int64)
                if best is not None:
                    j, b = best
                    feature[node], cut[node] = j, cuts[j][b]
                    go = (binned[rows, j] > b).astype(np.int64)
                at[rows] = 2 * node + 1 + go
            for node in range(nodes, 2 * nodes + 1):
                rows = at == node
                leaf[node] = self.rate * grad[rows].sum() / (hess[rows].sum() + self.smooth)
            self.model.append((feature, cut, leaf))
            f += leaf[at]
        return self

    def _split(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, int] | None:
        g, h = grad.sum(), hess.sum()
        found, gain = None, 1e-6
        for j in range(binned.shape[1]):
            left_g = np.cumsum(np.bincount(binned[:, j], weights=grad, minlength=self.bins + 1))[: self.bins - 1]
            left_h = np.cumsum(np.bincount(binned[:, j], weights=hess, minlength=self.bins + 1))[: self.bins - 1]
            value = left_g**2 / (left_h + self.smooth) + (g - left_g) ** 2 / (h - left_h + self.smooth) - g**2 / (h + self.smooth)
            value[(left_h < self.least) | (h - left_h < self.least)] = -1
            b = int(np.argmax(value))
            if value[b] > gain:
                found, gain = (j, b), float(value[b])
        return found

    def decision(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.model:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                j = feature[at]
                at = 2 * at + 1 + ((j >= 0) & (x[rows, np.maximum(j, 0)] > cut[at]))
            out += leaf[at]
        return out


def hinge_dual(indices: np.ndarray, starts: np.ndarray, values: np.ndarray, scales: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear hinge-loss model by dual coordinate descent.

    Rows are sparse: row i has the distinct features indices[starts[i]:starts[i + 1]],
    each with its value times the row's scale; y is -1 or 1. Each step solves one
    dual variable exactly within [0, c].
    """
    weights, bias = np.zeros(len(values)), 0.0
    alpha = np.zeros(len(y))
    squares = values * values
    norm = np.array([float(squares[indices[a:b]].sum()) for a, b in zip(starts[:-1], starts[1:], strict=True)]) * scales * scales + 1.0
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            own = indices[starts[i] : starts[i + 1]]
            v = values[own] * scales[i]
            gradient = y[i] * (float(weights[own] @ v) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                weights[own] += step * v
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights, bias
