"""Agglomerative clustering with Ward's linkage on Euclidean distances."""

from __future__ import annotations

import numpy as np


def ward_labels(x: np.ndarray, threshold: float) -> np.ndarray:
    """A label (from 0, by first member) for each row; clusters merge while the cheapest merge is below ``threshold``.

    Merge heights follow the usual convention: that of two single points is their distance. Merges are found along chains
    of nearest neighbours, whose ends are each other's nearest; Ward's heights never sink, so these are the merges that
    always taking the cheapest would make, and those below the threshold can be kept after all are known. Only centres and
    sizes of clusters are held, one row of distances at a time.
    """
    n = len(x)
    if n < 2:
        return np.zeros(n, dtype=int)
    centre, size = np.array(x, dtype=float), np.ones(n)
    norm = (centre**2).sum(axis=1)
    alive, merges, chain = np.ones(n, dtype=bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            square = np.maximum(norm + norm[a] - 2 * (centre @ centre[a]), 0.0)
            close = np.flatnonzero(square <= 1e-9 * (norm[a] + 1))  # too near for the difference of norms
            square[close] = ((centre[close] - centre[a]) ** 2).sum(axis=1)
            height = square * (2 * size * size[a] / (size + size[a]))
            height[~alive] = np.inf
            height[a] = np.inf
            b = int(np.argmin(height))
            if len(chain) > 1 and height[chain[-2]] <= height[b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        chain = chain[:-2]
        first, second = min(a, b), max(a, b)
        merges.append((float(np.sqrt(height[b])), first, second))
        centre[first] = (centre[first] * size[first] + centre[second] * size[second]) / (size[first] + size[second])
        norm[first] = (centre[first] ** 2).sum()
        size[first] += size[second]
        alive[second] = False
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for height_of, a, b in merges:
        if height_of < threshold:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]
