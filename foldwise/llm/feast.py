"""The greatest eigenvalues of a symmetric matrix by contour integration (FEAST).

The matrix is a covariance over Spark's rows, small and dense; what is here runs on it
alone.  Inertia counts (signs of the pivots of V - s I) tell how many eigenvalues lie
above s.  By bisection they give the interval that holds the wanted ones, cut into
intervals of a few eigenvalues each whose ends lie in gaps.  In each interval, a
quadrature of the resolvent (z I - V)^-1 Y over a circle through its ends projects Y
onto the interval's eigenvectors; Rayleigh-Ritz on the projection gives pairs, and the
step is repeated with these until their residuals are as small as rounding lets them.
The number of pairs in the interval has to be its inertia count: none is missed.
"""

from __future__ import annotations

import numpy as np

#: nodes of the Gauss-Legendre rule on the upper half circle
NODES = 12
#: eigenvalues of an interval, if its ends can be put between them
INTERVAL = 8
#: columns of the subspace, times the interval's count, and besides
ROOM, SPARE = 1.5, 4
MOST_STEPS = 40
#: residual of a pair that ends the steps, that is good enough where rounding ends them, and the
#: least gap at an interval's end, to the matrix's norm
RESIDUAL, ACCEPTED, GAP = 5e-16, 1e-12, 1e-10


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a tridiagonal matrix with the eigenvalues of ``v``
    (Householder reflections), whose shifted pivots take a step a row."""
    a, d = v.copy(), len(v)
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = x @ x
        if size > 0:
            p = a[k + 1:, k + 1:] @ x * (2 / size)
            p -= x * (x @ p / size)
            a[k + 1:, k + 1:] -= np.outer(x, p) + np.outer(p, x)
            a[k + 1:, k] -= x * (2 * (x @ a[k + 1:, k]) / size)
    return np.diag(a).copy(), np.diag(a, -1) ** 2


def above(t: tuple[np.ndarray, np.ndarray], s: float) -> int:
    """Eigenvalues above ``s``: positive pivots of the shifted tridiagonal matrix (its inertia)."""
    positive, pivot = 0, 1.0
    tiny = np.finfo(float).tiny
    for d, e in zip(t[0].tolist(), [0.0, *t[1].tolist()]):
        pivot = d - s - e / pivot
        if abs(pivot) < tiny:
            pivot = -tiny
        positive += pivot > 0
    return positive


def bisect(t, low: float, high: float, n: int, width: float) -> tuple[float, float]:
    """(low, high) within ``width``, with more than ``n`` eigenvalues above low and at most n above high."""
    while high - low > width:
        s = (low + high) / 2
        low, high = (s, high) if above(t, s) > n else (low, s)
        if s in (low, high) and high - low <= np.spacing(abs(s)) * 2:
            break
    return low, high


def intervals(v: np.ndarray, k: int, least: float) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues) from the top down, that together hold the ``k`` greatest
    eigenvalues and those equal to the last, as far as these are above ``least``."""
    t, norm = tridiagonal(v), np.abs(v).sum(axis=1).max()
    fine, all_above = GAP * norm, above(t, least)
    _, top = bisect(t, least, norm * (1 + 1e-6), 0, 1e-3 * norm)
    found, out = 0, []
    while found < min(k, all_above):
        want = min(found + INTERVAL, k, all_above)
        # the want-th eigenvalue, those equal to it, and the gap below them
        at, _ = bisect(t, least, top, want - 1, fine)
        n, below = above(t, max(least, at - fine)), least
        if n < all_above:
            below, _ = bisect(t, least, at - fine, n, fine)
        cut = (at + below) / 2
        n = above(t, cut)
        out.append((cut, top, n - found))
        top, found = cut, n
    return out


def contour(v: np.ndarray, y: np.ndarray, low: float, high: float) -> np.ndarray:
    """Quadrature of the resolvent on ``y`` over the circle through ``low`` and ``high``."""
    centre, radius = (low + high) / 2, (high - low) / 2
    x, w = np.polynomial.legendre.leggauss(NODES)
    q = np.zeros(y.shape)
    for node, weight in zip(x, w):
        turn = np.exp(1j * np.pi / 2 * (1 - node))  # the lower half is the conjugate of the upper
        solved = np.linalg.solve((centre + radius * turn) * np.eye(len(v)) - v, y.astype(complex))
        q += weight / 2 * (radius * turn * solved).real
    return q


def project(v: np.ndarray, low: float, high: float, n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` eigenpairs in (low, high]."""
    norm, d = max(np.abs(v).sum(axis=1).max(), np.finfo(float).tiny), len(v)
    size = min(d, int(n * ROOM) + SPARE)
    y = np.random.default_rng(seed).standard_normal((d, size))
    best, before, stalled = None, np.inf, 0
    for _ in range(MOST_STEPS):
        q, _ = np.linalg.qr(contour(v, y, low, high))
        e, u = np.linalg.eigh(q.T @ v @ q)  # Rayleigh-Ritz
        x = q @ u
        inside = np.flatnonzero((e > low) & (e <= high))
        if len(inside) == n:
            worst = np.abs(v @ x[:, inside] - x[:, inside] * e[inside]).max() / norm
            if worst < before:
                best, before, stalled = (e[inside], x[:, inside]), worst, 0
            else:
                stalled += 1
            if worst <= RESIDUAL or stalled >= 2 and before <= ACCEPTED:
                break
        y = x
    if before > ACCEPTED:
        raise ArithmeticError(f"{n} eigenvalues counted in ({low}, {high}], but not found")
    return best


def greatest(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of the ``k`` greatest eigenvalues
    of ``v`` that are above rounding (its size times 10^-12), fewer if there are fewer."""
    d, trace = len(v), float(np.trace(v))
    least = 1e-12 * max(trace, 0.0)
    if not d or trace <= 0:
        return np.empty(0), np.empty((d, 0))
    parts = [project(v, low, high, n) for low, high, n in intervals(v, min(k, d), least)]
    if not parts:
        return np.empty(0), np.empty((d, 0))
    # one Rayleigh-Ritz over all intervals makes the components orthogonal to the last digit
    q, _ = np.linalg.qr(np.concatenate([x for _, x in parts], axis=1))
    e, u = np.linalg.eigh(q.T @ v @ q)
    order = np.argsort(-e, kind="stable")[:k]
    return e[order], (q @ u)[:, order]
