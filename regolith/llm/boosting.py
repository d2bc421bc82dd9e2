"""Gradient-boosted trees in numpy, with monotonic constraints, as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from regolith.llm.linear import sigmoid


@dataclass
class Forest:
    """Trees as node arrays: a node's feature (-1: leaf), threshold (values up to it go left), children and value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row: all rows go down all trees together, a level each step."""
        node = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        while (inner := self.feature[node] >= 0).any():
            below = np.where(x[rows, np.maximum(self.feature[node], 0)] <= self.threshold[node], self.left[node], self.right[node])
            node = np.where(inner, below, node)
        return sigmoid(self.base + self.value[node].sum(1))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 2.0, ridge: float = 1.0) -> Forest:
    """Trees on the logistic loss. monotone: by feature 1 where the score must not fall as it grows, -1 where it must not rise;
    a split that breaks this is not made, and the children's values are bounded by the middle between them."""
    monotone = monotone or {}
    n, width = x.shape
    shares = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, f], shares, method="lower")) if n else np.zeros(0) for f in range(width)]
    binned = np.column_stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)])
    rate_of_one = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of_one / (1 - rate_of_one)))
    total = np.full(n, base)
    nodes: list[list[float]] = []
    roots = []

    def leaf_value(g, h):
        return -g / (h + ridge)

    def grow(rows: np.ndarray, grad: np.ndarray, curve: np.ndarray, level: int, low: float, high: float) -> int:
        here = len(nodes)
        g, h = grad[rows].sum(), curve[rows].sum()
        nodes.append([-1, 0.0, here, here, rate * float(np.clip(leaf_value(g, h), low, high))])
        best = (1e-6, -1, 0, 0.0, 0.0)
        for f in range(width if level and len(rows) else 0):
            size = len(edges[f]) + 1
            gl = np.cumsum(np.bincount(binned[rows, f], grad[rows], size))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], curve[rows], size))[:-1]
            vl, vr = np.clip(leaf_value(gl, hl), low, high), np.clip(leaf_value(g - gl, h - hl), low, high)
            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
            gain[(hl < least) | (h - hl < least)] = -1
            if f in monotone:
                gain[(vr - vl) * monotone[f] < 0] = -1
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = float(gain[k]), f, k, float(vl[k]), float(vr[k])
        _, f, k, vl, vr = best
        if f >= 0:
            goes = binned[rows, f] <= k
            middle, side = (vl + vr) / 2, monotone.get(f, 0)
            bounds = {0: (low, high, low, high), 1: (low, middle, middle, high), -1: (middle, high, low, middle)}[side]
            left = grow(rows[goes], grad, curve, level - 1, *bounds[:2])
            right = grow(rows[~goes], grad, curve, level - 1, *bounds[2:])
            nodes[here][:4] = [f, float(edges[f][k]), left, right]
        return here

    def forest() -> Forest:
        flat = np.array(nodes, float).reshape(-1, 5)
        return Forest(flat[:, 0].astype(np.int32), flat[:, 1], flat[:, 2].astype(np.int32), flat[:, 3].astype(np.int32), flat[:, 4], np.array(roots, np.int32), base)

    for _ in range(trees if n else 0):
        p = sigmoid(total)
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-6), depth, -np.inf, np.inf))
        node = np.full(n, roots[-1])
        flat = np.array(nodes, float)
        for _ in range(depth):
            f = flat[node, 0].astype(int)
            below = np.where(x[np.arange(n), np.maximum(f, 0)] <= flat[node, 1], flat[node, 2], flat[node, 3]).astype(int)
            node = np.where(f >= 0, below, node)
        total += flat[node, 4]
    return forest()
