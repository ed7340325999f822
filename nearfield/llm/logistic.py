"""Small logistic fits on the driver, over bounded samples. Inputs hold no NaN; without rows or without both classes fit_logistic gives None, and callers do not fit."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray | None:
    """Intercept and weights by Newton steps on standardised columns, given back for the columns as they are. None without both classes."""
    if not len(y) or y.min() == y.max():
        return None
    middle, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-12)
    a = np.c_[np.ones(len(x)), (x - middle) / spread]
    w, penalty = np.zeros(a.shape[1]), ridge * np.r_[0.0, np.ones(x.shape[1])]
    for _ in range(steps):
        p = sigmoid(a @ w)
        gradient = a.T @ (p - y) + penalty * w
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty + 1e-9), gradient)
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w[0] - (w[1:] * middle / spread).sum(), w[1:] / spread]


def fit_lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic intercept and L1-penalised weights by accelerated proximal gradient, for mean log loss."""
    n = len(y)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    b, w = float(np.log(share / (1 - share))), np.zeros(x.shape[1])
    v = np.ones(x.shape[1]) / np.sqrt(max(1, x.shape[1]))
    for _ in range(20):  # the largest curvature
        v = x.T @ (x @ v)
        v /= max(1e-12, np.linalg.norm(v))
    rate = 1 / (0.25 * (np.linalg.norm(x @ v) ** 2 / n + 1) + 1e-9)
    bw, ww, t = b, w.copy(), 1.0
    for _ in range(steps):
        r = (sigmoid(x @ ww + bw) - y) / n
        nb = bw - rate * r.sum()
        nw = ww - rate * (x.T @ r)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        bw, ww = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return b, w
