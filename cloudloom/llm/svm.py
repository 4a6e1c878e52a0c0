"""Linear support vector machines fitted by dual coordinate descent on sparse rows."""

from __future__ import annotations

import numpy as np


def fit(first: np.ndarray, index: np.ndarray, value: np.ndarray, label: np.ndarray, size: int, cost: float = 1.0, rounds: int = 20, seed: int = 7, balance: bool = True) -> np.ndarray:
    """Weights (size + 1, the last for the bias) of the hinge-loss model for labels -1 and 1.

    Row i has ``index[first[i]:first[i + 1]]`` with ``value``; each row also has a constant 1. ``balance`` scales the
    cost so that both classes weigh the same. Equal input gives equal weights.
    """
    n = len(label)
    w = np.zeros(size + 1)
    alpha = np.zeros(n)
    norm = np.array([value[first[i] : first[i + 1]] @ value[first[i] : first[i + 1]] for i in range(n)]) + 1.0
    top = np.full(n, float(cost))
    if balance:
        for side in (-1, 1):
            some = label == side
            if some.any():
                top[some] *= n / (2.0 * some.sum())
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(n):
            at, x = index[first[i] : first[i + 1]], value[first[i] : first[i + 1]]
            y = label[i]
            slope = y * (w[at] @ x + w[size]) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), top[i])
            step = (new - alpha[i]) * y
            if step:
                w[at] += step * x
                w[size] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def squash(margin: np.ndarray | float, slope: float = 1.0, shift: float = 0.0) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(slope * np.asarray(margin, float) + shift, -60, 60)))


def sigmoid_of(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that turns margins into chances of label 1 (labels -1 and 1)."""
    up, down = (label > 0).sum(), (label < 0).sum()
    target = np.where(label > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = squash(margin, a, b)
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        q = p * (1 - p)
        h = np.array([[(q * margin * margin).sum() + 1e-6, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-7:
            break
    return float(a), float(b)
