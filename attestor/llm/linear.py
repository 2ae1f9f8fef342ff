"""A small ridge-penalised logistic fit on the driver, for bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit_logistic(x: np.ndarray, target: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Coefficients, the intercept first and not penalised; targets may be probabilities. Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([1e-6, *[penalty] * x.shape[1]])
    beta = np.zeros(design.shape[1])
    for _ in range(steps):
        p = sigmoid(design @ beta)
        w = np.maximum(p * (1 - p), 1e-6)
        gradient = design.T @ (p - target) + ridge @ beta
        move = np.linalg.solve(design.T @ (design * w[:, None]) + ridge, gradient)
        size = np.abs(move).max()
        beta -= move if size < 5 else move * (5 / size)
        if size < 1e-7:
            break
    return beta
