"""Small dense linear algebra on numpy arrays."""

from __future__ import annotations

import numpy as np


def cholesky_lower(a: np.ndarray) -> np.ndarray | None:
    """Lower Cholesky factor, or None if ``a`` is not positive definite."""
    try:
        return np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        return None


def solve_lower(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(low, b)


def solve_upper_t(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve L' x = b."""
    return np.linalg.solve(low.T, b)


def logdet(low: np.ndarray) -> float:
    return 2.0 * float(np.log(np.diag(low)).sum())


def mahalanobis_sq(low: np.ndarray, delta: np.ndarray) -> float:
    z = solve_lower(low, delta)
    return float(z @ z)


def inverse(low: np.ndarray) -> np.ndarray:
    return solve_upper_t(low, solve_lower(low, np.eye(len(low))))


def symmetric_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and eigenvectors as columns."""
    values, vectors = np.linalg.eigh(a)
    return values[::-1], vectors[:, ::-1]


def regularised(a: np.ndarray, ridge: float = 1e-6, tries: int = 10) -> np.ndarray:
    """Cholesky factor of ``a`` plus the least ridge, times ten each, that makes it positive definite; else of I."""
    d = len(a)
    scale = max(float(np.trace(a)) / d, 1e-12)
    for t in range(tries):
        low = cholesky_lower(a + np.eye(d) * scale * (0 if t == 0 else ridge * 10 ** (t - 1)))
        if low is not None:
            return low
    return np.eye(d)
