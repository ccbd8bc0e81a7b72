"""Linear models fitted on the driver over a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np


class Rows:
    """A sparse 0/1 matrix: the feature numbers of each row, in one array with offsets."""

    def __init__(self, rows: list[list[int]], width: int):
        self.at = np.cumsum([0, *map(len, rows)])
        self.flat = np.fromiter((x for r in rows for x in r), np.int64, int(self.at[-1]))
        self.row = np.repeat(np.arange(len(rows)), np.diff(self.at))
        self.n, self.width = len(rows), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.flat], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, r[self.row], self.width)

    def take(self, which: np.ndarray) -> Rows:
        return Rows([self.flat[self.at[i] : self.at[i + 1]].tolist() for i in which], self.width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(rows: Rows, dense: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the sparse features, of the dense ones, and the bias: ridge logistic regression by L-BFGS.

    With one class only, the weights are 0 and the bias is that of the smoothed share of ones.
    """
    n, d, k = rows.n, rows.width, dense.shape[1]
    share = (y.sum() + 0.5) / (n + 1.0)
    x = np.zeros(d + k + 1)
    x[-1] = np.log(share / (1 - share)) if n else -35.0
    if not n or y.min() == y.max():
        return x[:d], x[d : d + k], float(x[-1])

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = rows.dot(x[:d]) + dense @ x[d : d + k] + x[-1]
        gap = sigmoid(z) - y
        loss = np.logaddexp(0, z).sum() - (y * z).sum() + ridge / 2 * (x[:-1] @ x[:-1])
        return loss, np.concatenate([rows.back(gap) + ridge * x[:d], dense.T @ gap + ridge * x[d : d + k], [gap.sum()]])

    f, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q = g.copy()
        alphas = []
        for s, t, rho in reversed(past):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * t
        if past:
            q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])
        for (s, t, rho), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - rho * (t @ q))
        step, slope = 1.0 if past else 1.0 / max(1.0, np.abs(g).sum()), -(g @ q)
        while True:
            new = x - step * q
            f2, g2 = value(new)
            if f2 <= f + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, t = new - x, g2 - g
        if s @ t > 1e-12:
            past = [*past[-9:], (s, t, 1 / (s @ t))]
        done = f - f2 <= 1e-7 * max(1.0, abs(f))
        x, f, g = new, f2, g2
        if done:
            break
    return x[:d], x[d : d + k], float(x[-1])


def hinge(rows: Rows, scale: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 30, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised hinge-loss (L1) model over ``scale``-weighted indicators.

    Dual coordinate descent: one dual variable a row, kept in [0, cost]; each step is the exact
    minimum along its coordinate, in a new (seeded) order every round. The bias is a constant
    feature of value 1. ``y`` is +1 or -1.
    """
    w, bias, alpha = np.zeros(rows.width), 0.0, np.zeros(rows.n)
    squares = np.bincount(rows.row, scale[rows.flat] ** 2, rows.n) + 1.0
    random = np.random.default_rng(7)
    # work on u = w / scale: w . x = sum of scale^2 * u over the row's features
    u, square = np.zeros(rows.width), scale**2
    for _ in range(rounds):
        most = 0.0
        for i in random.permutation(rows.n):
            f = rows.flat[rows.at[i] : rows.at[i + 1]]
            grad = y[i] * (square[f] @ u[f] + bias) - 1
            aim = min(max(alpha[i] - grad / squares[i], 0.0), cost)
            step = (aim - alpha[i]) * y[i]
            if step:
                u[f] += step
                bias += step
                most = max(most, abs(aim - alpha[i]))
                alpha[i] = aim
        if most < tolerance:
            break
    w = u * scale
    return w, bias


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a * margin + b))), with smoothed targets, by Newton steps."""
    ones = float((y > 0).sum())
    zeros = len(y) - ones
    t = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(a * margin + b)
        g = np.array([((p - t) * margin).sum() + 1e-6 * a, (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)
