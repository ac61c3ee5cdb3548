"""PageRank of small dense and of sparse weighted graphs."""

from __future__ import annotations

import numpy as np


def pagerank(weights: np.ndarray, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100) -> np.ndarray:
    """Scores that sum to 1; nodes without edges spread their score evenly. ``weights[i, j]`` leads from i to j."""
    n = len(weights)
    if n == 0:
        return np.zeros(0)
    out = weights.sum(axis=1)
    step = np.divide(weights, out[:, None], out=np.zeros_like(weights, dtype=float), where=out[:, None] > 0)
    score = np.full(n, 1.0 / n)
    for _ in range(rounds):
        now = damping * (score @ step + score[out == 0].sum() / n) + (1 - damping) / n
        if np.abs(now - score).sum() < n * tolerance:
            return now
        score = now
    return score


def pagerank_of_edges(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100) -> np.ndarray:
    """``pagerank`` of ``n`` nodes by their directed edges (places of the ends) of positive weight, in memory linear in both."""
    if n == 0:
        return np.zeros(0)
    out = np.bincount(src, weight, n)
    step = weight / out[src]
    score = np.full(n, 1.0 / n)
    for _ in range(rounds):
        now = damping * (np.bincount(dst, score[src] * step, n) + score[out == 0].sum() / n) + (1 - damping) / n
        if np.abs(now - score).sum() < n * tolerance:
            return now
        score = now
    return score
