"""Logistic regression on bounded training sets, dense and sparse, and folds by hash."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Dense:
    """Ridge-penalised logistic regression by Newton steps, on standardised columns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 20):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.scale[self.scale < 1e-6] = np.inf  # constant columns say nothing
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = sigmoid(z @ w)
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step / max(1.0, np.abs(step).max() / 5)
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def logits(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]


class Rows:
    """Sparse rows of ones: the places of a row's features, one row after another."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.length = np.array([len(r) for r in rows], np.int64)
        self.at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        self.start = np.cumsum(self.length) - self.length

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.r_[0.0, np.cumsum(w[self.at])]
        return sums[self.start + self.length] - sums[self.start]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, np.repeat(r, self.length), self.width)

    def take(self, rows: np.ndarray) -> Rows:
        return Rows([self.at[self.start[i] : self.start[i] + self.length[i]] for i in rows], self.width)


def telling(x: Rows, y: np.ndarray, least: float = 4.0) -> np.ndarray:
    """Features whose count among the positives is at least ``least`` deviations from chance."""
    p, n = y.mean() if len(y) else 0.0, x.back(np.ones(x.n))
    z = (x.back(y) - n * p) / np.sqrt(n * p * (1 - p) + 1)
    return np.abs(z) >= least


def fit_sparse(x: Rows, more: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 150, rate: float = 0.3):
    """``(weights of ones, weights of the dense columns, intercept)`` by AdaGrad over the whole set.

    Only telling features get weights, so that rare words of long documents don't add up to noise.
    """
    keep = telling(x, y)
    number = np.cumsum(keep) - 1
    kept = keep[x.at]
    owner = np.repeat(np.arange(x.n), x.length)[kept]
    at, width = number[x.at[kept]], int(keep.sum())
    w, v, b = np.zeros(width), np.zeros(more.shape[1]), 0.0
    gw, gv, gb = np.full(width, 1e-3), np.full(more.shape[1], 1e-3), 1e-3
    for _ in range(steps):
        r = (sigmoid(np.bincount(owner, w[at], x.n) + more @ v + b) - y) / np.sqrt(x.n)
        dw, dv, db = np.bincount(at, r[owner], width) + ridge * w, more.T @ r + ridge * v, r.sum()
        gw, gv, gb = gw + dw * dw, gv + dv * dv, gb + db * db
        w, v, b = w - rate * dw / np.sqrt(gw), v - rate * dv / np.sqrt(gv), b - rate * db / np.sqrt(gb)
    out = np.zeros(x.width)
    out[keep] = w
    return out, v, b


def folds(n: int, k: int) -> np.ndarray:
    """A fold for each of n rows, in an order that is already random."""
    return np.arange(n) % k
