"""Singular values and right singular vectors of a small square matrix by its bidiagonal form.

Householder reflections make the matrix bidiagonal; differential quotient-difference sweeps with shifts (dqds) find the
singular values to high relative accuracy; each vector comes from the twisted factorisation of the shifted tridiagonal
matrix at the twist where the residual is smallest. Vectors of singular values that almost agree are made orthogonal
to each other. The side of the matrix is the number of columns of the data, never its number of rows.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
CLOSE = 1e-6  # singular values whose squares differ by less, relatively, share their vectors' space


def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and upper diagonal of ``Q^T a P`` and the reflections whose product is ``P``."""
    a = np.array(a, float)
    n = len(a)
    right = []
    for k in range(n):
        for rows in (True, False):
            if not rows and k >= n - 1:
                continue
            v = (a[k:, k] if rows else a[k, k + 1 :]).copy()
            size = np.abs(v).max()
            if size > 0:
                v /= size  # else squares of small entries vanish
                v[0] += np.copysign(np.linalg.norm(v), v[0])
                v /= np.linalg.norm(v)
            if rows:
                a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
            else:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
                right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def reflected(right: list[np.ndarray], z: np.ndarray) -> np.ndarray:
    """``P z`` for the columns of ``z``."""
    z = z.copy()
    for k in reversed(range(len(right))):
        v = right[k]
        z[k + 1 :] -= 2 * np.outer(v, v @ z[k + 1 :])
    return z


def _sweep(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One shifted dqds transform; the last number is the smallest of its pivots, negative if the shift was too large."""
    n = len(q)
    q2, e2 = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        q2[i] = d + e[i]
        if q2[i] <= 0 or d < 0:
            return q2, e2, min(least, -EPS)
        ratio = q[i + 1] / q2[i]
        e2[i] = e[i] * ratio
        d = d * ratio - shift
        least = min(least, d)
    q2[-1] = d
    return q2, e2, least


def _trailing(q: np.ndarray, e: np.ndarray) -> float:
    """The smaller eigenvalue of the last two rows, a guess at the smallest of all."""
    if len(q) == 1:
        return q[0]
    mean, product = (q[-2] + q[-1] + e[-1]) / 2, q[-2] * q[-1]
    return product / (mean + np.sqrt(max(mean * mean - product, 0.0))) if mean > 0 else 0.0


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, largest first."""
    out: list[float] = []
    work = [(np.asarray(diagonal, float) ** 2, np.asarray(upper, float) ** 2, 0.0)]
    while work:
        q, e, sigma = work.pop()
        fails = 0
        while len(q):
            n = len(q)
            if n == 1:
                out.append(sigma + q[0])
                break
            small = np.flatnonzero(e <= EPS * EPS * (sigma + np.minimum(q[:-1], q[1:])))
            if len(small):
                cut = small[-1] + 1
                work.append((q[:cut], e[: cut - 1], sigma))
                q, e, fails = q[cut:], e[cut:], 0
                continue
            if q[0] * 1.5 < q[-1]:  # the large end belongs on top
                q, e = q[::-1].copy(), e[::-1].copy()
            shift = 0.0 if fails > 3 or (q == 0).any() else _trailing(q, e) * (1 - 1e-3 if fails == 0 else 0.25**fails)
            q2, e2, least = _sweep(q, e, shift)
            if least < 0 and shift > 0:
                fails += 1
                continue
            q, e, sigma, fails = q2, e2, sigma + shift, 0
    return np.sort(np.maximum(out, 0.0))[::-1]


def twisted(diagonal: np.ndarray, upper: np.ndarray, value: float) -> np.ndarray:
    """The unit vector of ``B^T B`` at the eigenvalue ``value``, from its twisted factorisation.

    ``B^T B - value = N D N^T`` with ``N`` lower bidiagonal above the twist and upper bidiagonal below it.
    """
    n = len(diagonal)
    if n == 1:
        return np.ones(1)
    tiny = max(EPS * EPS * value, np.finfo(float).tiny)
    guard = lambda x: x if abs(x) > tiny else np.copysign(tiny, x)
    q, e = diagonal**2, upper**2
    side = diagonal[:-1] * upper  # beside the diagonal of B^T B
    # downwards: pivots are s_i + q_i, with s_1 = -value and s_{i+1} = e_i s_i / (s_i + q_i) - value
    s, down = np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n):
        down[i] = guard(s[i] + q[i])
        if i + 1 < n:
            s[i + 1] = e[i] * (s[i] / down[i]) - value
    # upwards: pivots are p_{i+1} + e_i, with p_n = q_n - value and p_i = q_i p_{i+1} / (p_{i+1} + e_i) - value
    p, up = np.empty(n), np.empty(n)
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        up[i + 1] = guard(p[i + 1] + e[i])
        p[i] = q[i] * (p[i + 1] / up[i + 1]) - value
    gamma = s + p + value
    k = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -side[i] / down[i] * z[i + 1]
    for i in range(k + 1, n):
        z[i] = -side[i - 1] / up[i] * z[i - 1]
    z /= np.abs(z).max()
    return z / np.linalg.norm(z)


def _blocks(diagonal: np.ndarray, upper: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows that no entry above the diagonal ties together."""
    size = max(np.abs(diagonal).max(), np.abs(upper).max() if len(upper) else 0.0)
    cuts = np.flatnonzero(np.abs(upper) <= EPS * EPS * size) + 1
    ends = [0, *cuts.tolist(), len(diagonal)]
    return list(zip(ends, ends[1:]))


def right_singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of a square matrix, largest first, and the right singular vectors as columns."""
    n = len(r)
    scale = np.abs(r).max() if n else 0.0
    if scale == 0:
        return np.zeros(n), np.eye(n)
    diagonal, upper, right = bidiagonal(r / scale)
    values, vectors = [], np.zeros((n, n))
    at = 0
    for a, b in _blocks(diagonal, upper):
        d, u = diagonal[a:b], upper[a : b - 1]
        for value in dqds(d, u):
            values.append(value)
            vectors[a:b, at] = twisted(d, u, value)
            at += 1
    order = np.argsort(-np.array(values), kind="stable")
    values, vectors = np.array(values)[order], vectors[:, order]
    _separate(diagonal, upper, values, vectors)
    return values * scale * scale, reflected(right, vectors)


def _separate(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> None:
    """Within each run of close values the vectors span the run's space; an orthogonal set of it replaces them."""
    n, a = len(values), 0
    t = np.diag(diagonal**2) + np.diag(np.concatenate([[0.0], upper**2]))
    t += np.diag(diagonal[:-1] * upper, 1) + np.diag(diagonal[:-1] * upper, -1)
    for b in range(1, n + 1):
        if b < n and values[b - 1] - values[b] <= CLOSE * max(values[0] * EPS / CLOSE, values[b - 1]):
            continue
        if b - a > 1:
            span, rng = vectors[:, a:b], np.random.default_rng(0)
            near = t - (values[a:b].mean() + 4 * EPS * values[0]) * np.eye(n)
            for _ in range(4):  # a vector found twice leaves room, which block inverse iteration fills from the run's space
                span = span - vectors[:, :a] @ (vectors[:, :a].T @ span)
                q, tri = np.linalg.qr(span)
                lost = np.abs(np.diag(tri)) < 1e-3
                q[:, lost] = rng.standard_normal((n, lost.sum()))
                q -= vectors[:, :a] @ (vectors[:, :a].T @ q)
                span = np.linalg.solve(near, q)
                span /= np.linalg.norm(span, axis=0)
            span -= vectors[:, :a] @ (vectors[:, :a].T @ span)
            q, _ = np.linalg.qr(span)
            vectors[:, a:b] = q @ np.linalg.eigh(q.T @ t @ q)[1][:, ::-1]
        a = b
