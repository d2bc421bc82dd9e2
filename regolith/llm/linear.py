"""Linear models fitted in numpy on bounded samples, and hashed features of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
#: For n-grams of bytes all signs and digits of ASCII are one blank.
_LETTERS = np.full(256, 32, np.uint32)
_LETTERS[97:123] = _LOWER[97:123]
_LETTERS[65:91] = _LOWER[65:91]
_LETTERS[128:] = np.arange(128, 256)


#: Bytes that n-grams are counted from at a time.
PIECE = 1 << 18


def ngram_rows(data: np.ndarray, places: np.ndarray, bits: int, orders: tuple[int, ...] = (1, 2, 3), rows: int = 256) -> Iterator[np.ndarray]:
    """Matrices of at most `rows` texts by 2**bits hashed n-grams of bytes: square roots of their counts, at length 1."""
    n = len(places) - 1
    for first in range(0, n, rows):
        last = min(n, first + rows)
        cut = places[first : last + 1]
        counts = np.zeros((last - first) << bits, np.float64)
        for a in range(int(cut[0]), int(cut[-1]), PIECE):
            b = min(int(cut[-1]), a + PIECE)
            own = _LETTERS[data[a : min(int(cut[-1]), b + max(orders) - 1)]]
            at = np.arange(a, b)
            text = np.searchsorted(cut, at, "right") - 1
            ends = cut[text + 1]
            for order in orders:
                gram = np.zeros(b - a, np.uint32)
                for k in range(order):
                    part = own[k : k + b - a]
                    gram[: len(part)] |= part << np.uint32(8 * k)
                inside = at + order <= ends
                hashed = (gram * np.uint32(2654435761) + np.uint32(order * 0x1EBCA6B)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)
                counts += np.bincount((text[inside] << bits) + hashed[inside].astype(np.int64), minlength=len(counts))
        out = np.sqrt(counts.astype(np.float32)).reshape(last - first, 1 << bits)
        length = np.sqrt((out * out).sum(1, keepdims=True))
        yield out / np.where(length == 0, 1, length)


def squared_hinge(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 120) -> np.ndarray:
    """A linear SVM with squared hinge loss on rows of length 1, y of -1 and 1, both classes with the same weight; the last
    coefficient is the bias. Accelerated gradient steps, which the loss's curvature bounds."""
    side = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    ahead, t = w.copy(), 1.0
    rate = 1 / (2 * 2 + ridge)
    for _ in range(steps):
        short = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1])) * y * side
        grad = np.append(-2 * (x.T @ short), -2 * short.sum()) + ridge * np.append(ahead[:-1], 0)
        new = (ahead - rate * grad).astype(np.float32)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (before - 1) / t * (new - w)
        w = new
    return w


def logistic(x: np.ndarray, p: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Logistic regression on soft labels p by Newton steps, halved while they do not lower the loss; the last coefficient is
    the bias. For few columns."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x.shape[1])
    penalty = np.diag(np.append(np.full(x.shape[1] - 1, ridge * max(1, weight.sum())), 1e-6))

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - p * z) + w @ penalty @ w / 2)

    for _ in range(steps):
        q = sigmoid(x @ w)
        curve = (x * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + penalty
        step = np.linalg.solve(curve, x.T @ (weight * (p - q)) - penalty @ w)
        before = loss(w)
        for _ in range(20):
            if loss(w + step) <= before:
                break
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
