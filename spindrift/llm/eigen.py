"""Eigenvalues and eigenvectors of a symmetric matrix: Householder's tridiagonal form, then Cuppen's divide and conquer.

A tridiagonal matrix is torn in the middle into two halves and a matrix of rank one.  The halves' solutions turn the rest into
D + rho z z' with D diagonal; its eigenvalues are the roots of the secular equation 1 + rho sum z_i^2 / (d_i - x) = 0, one
between each two neighbouring d, and each is held as its distance from the nearer d.  Entries of z that are 0 within rounding,
and equal d, are deflated first.  The vectors come from the z that has exactly the found roots (Gu and Eisenstat 1995), so that
they are orthogonal however close the roots are.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q): a = q T q'."""
    a = np.array(a, float)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if not np.any(x[1:]):
            continue
        x[0] += np.copysign(size, x[0])
        v = x / np.linalg.norm(x)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots for ascending d, rho > 0 and z without zeros: the index of the nearest d below or above, and the distance from it.
    Found by halving between neighbours until the two ends are neighbouring numbers."""
    n, z2 = len(d), z * z
    top = rho * z2.sum()
    gap = np.append(np.diff(d), top)
    apart = d[:, None] - d[None, :]  # d_j - d_i, by origin i
    value = lambda origin, x: 1 + rho * (z2[:, None] / (apart[:, origin] - x)).sum(axis=0)
    origin = np.arange(n)
    right = value(origin, gap / 2) < 0
    right[-1] = False
    origin = origin + right
    low, high = np.where(right, -gap / 2, 0), np.where(right, 0, gap / 2)
    if value(np.array([n - 1]), gap[-1:] / 2)[0] < 0:
        low[-1], high[-1] = gap[-1] / 2, gap[-1]
    while True:
        middle = low + (high - low) / 2
        open_ = (middle != low) & (middle != high)
        if not open_.any():
            break
        below = value(origin, np.where(middle == 0, np.finfo(float).tiny, middle)) < 0
        low, high = np.where(open_ & below, middle, low), np.where(open_ & ~below, middle, high)
    return origin, np.where(low == 0, high, np.where(high == 0, low, middle))


def _rank_one(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and vectors of diag(d) + rho z z', rho > 0."""
    n = len(d)
    order = np.argsort(d, kind="stable")
    d, z = d[order].copy(), z[order].copy()
    q = np.eye(n)[:, order]
    tiny = 8 * EPS * max(np.abs(d).max(), rho * (z @ z))
    last = -1
    for i in range(n):  # equal d: a rotation moves the weight of one to the next
        if rho * abs(z[i]) * np.linalg.norm(z) <= tiny:
            z[i] = 0
            continue
        if last >= 0:
            r = np.hypot(z[last], z[i])
            c, s = z[i] / r, z[last] / r
            if abs((d[i] - d[last]) * c * s) <= tiny:
                d[last], d[i] = d[last] * c * c + d[i] * s * s, d[last] * s * s + d[i] * c * c
                z[last], z[i] = 0, r
                q[:, [last, i]] = np.stack([c * q[:, last] - s * q[:, i], s * q[:, last] + c * q[:, i]], axis=1)
        last = i
    live = np.flatnonzero(z)
    values, vectors = d.copy(), np.eye(n)
    if len(live):
        pole, weight = d[live], z[live]
        again = np.argsort(pole, kind="stable")
        live, pole, weight = live[again], pole[again], weight[again]
        origin, distance = secular_roots(pole, weight, rho)
        from_pole = (pole[origin] - pole[:, None]) + distance  # root_j - d_i
        k = len(live)
        ratio = from_pole.copy()
        apart = pole[None, :] - pole[:, None]  # d_j - d_i
        upper = np.triu(np.ones((k, k), bool), 0)
        # Roots j < i are set against d_j, roots j >= i but the last against d_(j+1), the last against rho.
        against = np.where(upper, np.roll(apart, -1, axis=1), apart)
        against[:, -1] = rho
        exact = np.copysign(np.sqrt(np.abs(np.prod(ratio / against, axis=1))), weight)
        inner = exact[:, None] / -from_pole
        inner /= np.linalg.norm(inner, axis=0)
        values[live] = pole[origin] + distance
        vectors[np.ix_(live, live)] = inner
    vectors = q @ vectors
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def divide(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and vectors of the tridiagonal matrix with diagonal d and off-diagonal e."""
    n = len(d)
    if n == 1:
        return d.copy(), np.eye(1)
    m = n // 2
    rho, sign = abs(e[m - 1]), np.copysign(1.0, e[m - 1])
    left, right = d[:m].copy(), d[m:].copy()
    left[-1] -= rho
    right[0] -= rho
    (v1, q1), (v2, q2) = divide(left, e[: m - 1]), divide(right, e[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    values = np.concatenate([v1, v2])
    if rho == 0:
        order = np.argsort(values, kind="stable")
        return values[order], q[:, order]
    values, inner = _rank_one(values, np.concatenate([q1[-1], sign * q2[0]]), rho)
    return values, q @ inner


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and unit eigenvectors as columns, of a symmetric matrix."""
    scale = np.abs(a).max()
    if scale == 0:
        return np.zeros(len(a)), np.eye(len(a))
    d, e, q = tridiagonal(a / scale)
    values, vectors = divide(d, e)
    return values * scale, q @ vectors
