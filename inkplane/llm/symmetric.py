"""Leading eigenpairs of a symmetric matrix: Householder, Sturm counts, inverse iteration.

The matrix is as wide as the vectors are, whatever their number, so this runs on the driver.
"""

from __future__ import annotations

import numpy as np

#: Eigenvalues nearer than this share of the matrix's norm form a cluster.
CLUSTER = 1e-3
ROUNDS = 6


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and reflectors of ``a`` made tridiagonal by Householder reflections."""
    a, n = a.copy(), len(a)
    reflectors: list[np.ndarray | None] = []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        if not x[1:].any():
            reflectors.append(None)
            continue
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        v /= np.linalg.norm(v)
        column = x - 2 * v * (v @ x)
        u = a[k + 1 :, k + 1 :] @ v
        q = 2 * (u - (v @ u) * v)
        a[k + 1 :, k + 1 :] -= np.outer(v, q) + np.outer(q, v)
        a[k + 1 :, k] = a[k, k + 1 :] = column
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues are smaller than each of ``x``: negative terms of the Sturm sequence."""
    tiny = np.finfo(float).tiny * max(1.0, float((e * e).max(initial=0)) / np.finfo(float).eps)
    count = np.zeros(len(x), np.int64)
    q = np.ones(len(x))
    for i in range(len(d)):
        q = d[i] - x - (e[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection to the last bits."""
    n, reach = len(d), np.zeros(len(d))
    reach[:-1] += np.abs(e)
    reach[1:] += np.abs(e)
    low, high = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    pad = 1e-14 * max(abs(low[0]), abs(high[0]), 1e-300)
    low, high, rank = low - pad, high + pad, n - np.arange(k)
    while True:
        middle = (low + high) / 2
        live = (middle > low) & (middle < high)
        if not live.any():
            return middle
        many = below(d, e, middle) >= rank  # the wanted one is among those below
        high, low = np.where(live & many, middle, high), np.where(live & ~many, middle, low)


def _solve(d: np.ndarray, e: np.ndarray, shift: np.ndarray, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift[j]) x[:, j] = b[:, j] for every j, by elimination with pivoting."""
    n, m = b.shape
    x = b.copy()
    upper = np.zeros((3, n, m))
    p, q = d[0] - shift, np.full(m, e[0] if n > 1 else 0.0)  # the row at hand: diagonal and right neighbour
    for i in range(n - 1):
        below_, right, far = e[i], d[i + 1] - shift, np.full(m, e[i + 1] if i + 2 < n else 0.0)
        swap = np.abs(p) < abs(below_)
        top, low = np.where(swap, below_, p), np.where(swap, p, below_)
        top = np.where(np.abs(top) < tiny, np.where(top < 0, -tiny, tiny), top)
        f = low / top
        upper[0, i], upper[1, i], upper[2, i] = top, np.where(swap, right, q), np.where(swap, far, 0.0)
        p, q = np.where(swap, q, right) - f * upper[1, i], np.where(swap, 0.0, far) - f * upper[2, i]
        first, second = np.where(swap, x[i + 1], x[i]), np.where(swap, x[i], x[i + 1])
        x[i], x[i + 1] = first, second - f * first
    upper[0, n - 1] = np.where(np.abs(p) < tiny, np.where(p < 0, -tiny, tiny), p)
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            x[i] -= upper[1, i] * x[i + 1]
        if i + 2 < n:
            x[i] -= upper[2, i] * x[i + 2]
        x[i] /= upper[0, i]
        big = np.abs(x[i:]).max(axis=0)
        big[big < 1e200] = 1.0
        x /= big
    return x


def _orthogonal(x: np.ndarray, clusters: list[np.ndarray]) -> np.ndarray:
    x = x / np.abs(x).max(axis=0)
    for of in clusters:
        for j in of:
            for _ in range(2):  # twice is enough
                for i in of[of < j]:
                    x[:, j] -= (x[:, i] @ x[:, j]) * x[:, i]
            x[:, j] /= np.linalg.norm(x[:, j])
    return x


def eigenpairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of ``a``, falling, and their unit eigenvectors as columns."""
    n = len(a)
    k = min(k, n)
    size = float(np.abs(a).max(initial=0))
    if not k or not size:
        return np.zeros(k), np.eye(n)[:, :k]
    d, e, reflectors = tridiagonal(a / size)
    values = leading(d, e, k)
    norm = max(float(np.abs(d).max()), float(np.abs(e).max(initial=0)))
    cluster = np.concatenate([[0], np.cumsum(-np.diff(values) > CLUSTER * norm)])
    clusters = [np.flatnonzero(cluster == c) for c in range(int(cluster[-1]) + 1)]
    x = _orthogonal(np.random.default_rng(0).standard_normal((n, k)), clusters)
    for _ in range(ROUNDS):
        x = _orthogonal(_solve(d, e, values, x, np.finfo(float).eps * norm), clusters)
    for j in range(len(reflectors) - 1, -1, -1):
        v = reflectors[j]
        if v is not None:
            x[j + 1 :] -= 2 * np.outer(v, v @ x[j + 1 :])
    return values * size, x
