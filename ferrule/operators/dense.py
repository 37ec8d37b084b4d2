"""Dense kernels on blocks: triangular inverses and solves, LL' and LDL' without pivoting, all by halves, so that products do the work."""

from __future__ import annotations

import numpy as np

BASE = 32


def triangular_solve(l: np.ndarray, b: np.ndarray, transposed: bool = False) -> np.ndarray:
    """x of L x = b, or of L' x = b, for a lower triangle L."""
    n = len(l)
    if n <= BASE:
        return np.linalg.solve(l.T if transposed else l, b)
    h = n // 2
    if transposed:
        low = triangular_solve(l[h:, h:], b[h:], True)
        return np.concatenate([triangular_solve(l[:h, :h], b[:h] - l[h:, :h].T @ low, True), low])
    top = triangular_solve(l[:h, :h], b[:h])
    return np.concatenate([top, triangular_solve(l[h:, h:], b[h:] - l[h:, :h] @ top)])


def triangular_inverse(l: np.ndarray) -> np.ndarray:
    n = len(l)
    if n <= BASE:
        return np.tril(np.linalg.inv(l))
    h, out = n // 2, np.zeros_like(l)
    out[:h, :h], out[h:, h:] = triangular_inverse(l[:h, :h]), triangular_inverse(l[h:, h:])
    out[h:, :h] = -out[h:, h:] @ (l[h:, :h] @ out[:h, :h])
    return out


def cholesky(a: np.ndarray, column: np.ndarray) -> np.ndarray:
    """L of L L' = a; ``column`` names the columns in errors."""
    try:
        return np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        low = next((k for k in range(1, len(a) + 1) if np.linalg.eigvalsh(a[:k, :k]).min() <= 0), len(a))
        raise ValueError(f"not positive definite at column {column[low - 1]}") from None


def ldl(a: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit lower triangle and diagonal of L D L' = a; no pivoting."""
    n = len(a)
    if n > BASE:
        h = n // 2
        l1, d1 = ldl(a[:h, :h], column[:h])
        w = triangular_solve(l1, a[h:, :h].T).T
        l2, d2 = ldl(a[h:, h:] - (w / d1) @ w.T, column[h:])
        return np.block([[l1, np.zeros((h, n - h))], [w / d1, l2]]), np.concatenate([d1, d2])
    a = a.copy()
    for k in range(n):
        if a[k, k] == 0 or not np.isfinite(a[k, k]):
            raise ValueError(f"zero pivot at column {column[k]}")
        a[k + 1 :, k] /= a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k + 1 :, k]) * a[k, k]
    return np.tril(a, -1) + np.eye(n), a.diagonal().copy()
