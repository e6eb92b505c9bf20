"""Algebra on the driver, on objects of k by k by k at most (k: latent states)."""

from __future__ import annotations

import numpy as np


def best_matching(cost: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, as many as the shorter side has: shortest augmenting paths with potentials."""
    c = np.asarray(cost, float)
    if not c.size:
        return []
    if c.shape[0] > c.shape[1]:
        return sorted((a, b) for b, a in best_matching(c.T.tolist()))
    n, m = c.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, via, done = c[row] - u[row] - v, np.full(m, -1), np.zeros(m, bool)
        at = -1
        while True:
            open_ = np.where(done, np.inf, dist)
            at = int(open_.argmin())
            done[at] = True
            if owner[at] < 0:
                break
            r = owner[at]
            through = dist[at] + c[r] - u[r] - v
            better = ~done & (through < dist)
            dist[better], via[better] = through[better], at
        far = dist[at]
        for j in np.flatnonzero(done):
            if j != at:
                u[owner[j]] += far - dist[j]
                v[j] += dist[j] - far
        u[row] += far
        while at >= 0:
            before = via[at]
            owner[at] = row if before < 0 else owner[before]
            at = before
    return sorted((int(r), j) for j, r in enumerate(owner) if r >= 0)


def whitener(m2: np.ndarray, k: int) -> np.ndarray:
    """W with W' m2 W = I on the k leading directions of a symmetric matrix."""
    values, vectors = np.linalg.eigh((m2 + m2.T) / 2)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    if values[-1] <= 1e-12 * max(values[0], 1e-300):
        raise ValueError(f"the moment has rank below {k}: eigenvalues {values}")
    return vectors / np.sqrt(values)


def power_method(t: np.ndarray, restarts: int = 20, steps: int = 100, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (rows) of a symmetric orthogonal tensor, by power steps and deflation."""
    rng, k = np.random.default_rng(seed), t.shape[0]
    values, vectors, t = [], [], t.copy()
    for _ in range(k):
        best, value = None, -np.inf
        for x in rng.standard_normal((restarts, k)):
            x /= np.linalg.norm(x)
            for _ in range(steps):
                y = np.einsum("abc,b,c->a", t, x, x)
                n = np.linalg.norm(y)
                if n < 1e-300:
                    break
                x = y / n
            s = float(np.einsum("abc,a,b,c->", t, x, x, x))
            if s > value:
                best, value = x, s
        values.append(value)
        vectors.append(best)
        t -= value * np.einsum("a,b,c->abc", best, best, best)
    return np.array(values), np.array(vectors)


def to_simplex(x: np.ndarray, smoothing: float = 0.0, axis: int = 0) -> np.ndarray:
    """Clipped at 0, smoothed and normalised along the axis; a vector that is mostly negative is turned first."""
    sign = np.where(2 * (x > 0).sum(axis=axis, keepdims=True) < x.shape[axis], -1.0, 1.0)
    x = np.clip(x * sign, 0, None) + smoothing
    total = x.sum(axis=axis, keepdims=True)
    return np.where(total > 0, x / np.where(total > 0, total, 1), 1 / x.shape[axis])


def soft_threshold(m: np.ndarray, by: float) -> np.ndarray:
    """The matrix with its singular values lowered by `by`, at least 0."""
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    return (u * np.clip(s - by, 0, None)) @ vt
