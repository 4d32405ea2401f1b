"""Small dense classifiers, fitted on the driver from bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton's method for ridge logistic regression; the last coefficient is the intercept."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(z @ w)
        g = z.T @ (weight * (p - y)) + penalty * w
        h = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0, steps: int = 50) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton's method on the active rows; y is -1 or 1."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.ones(z.shape[1])
    penalty[-1] = 1e-3
    for _ in range(steps):
        slack = 1 - y * (z @ w)
        on = slack > 0
        a = z[on] * (cost * weight[on])[:, None]
        g = penalty * w - a.T @ (y[on] * slack[on])
        step = np.linalg.solve(np.diag(penalty) + a.T @ z[on], g)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]
