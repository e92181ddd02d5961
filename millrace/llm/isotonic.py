"""Isotonic calibration by pooling adjacent violators over weighted points."""

from __future__ import annotations

import numpy as np


def fit(scores: np.ndarray, positives: np.ndarray, counts: np.ndarray, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of a rising curve; prior: pseudo-rows at the base rate in each pool."""
    base = positives.sum() / max(counts.sum(), 1e-9)
    at, where = np.unique(scores, return_inverse=True)  # equal scores are one point
    positives, counts = np.bincount(where, positives), np.bincount(where, counts)
    pools: list[list[float]] = []  # weighted score, positives, rows
    for s, p, n in zip(at, positives, counts, strict=True):
        pools.append([s * n, p, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    x = np.array([s / n for s, _, n in pools])
    y = np.array([(p + prior * base) / (n + prior) for _, p, n in pools])
    return x, np.maximum.accumulate(y)


def apply(knots: tuple[np.ndarray, np.ndarray], scores: np.ndarray) -> np.ndarray:
    return np.clip(np.interp(scores, *knots), 0.0, 1.0)
