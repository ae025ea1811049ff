"""Scalar statistics: incomplete gamma, chi-square quantiles, seeded random numbers."""

from __future__ import annotations

import math

import numpy as np


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x < 0 or a <= 0:
        raise ValueError("gamma_p needs a > 0 and x >= 0")
    if x == 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * front)
    # upper function by its continued fraction, evaluated backwards from a fixed depth
    tail = 0.0
    for i in range(300, 0, -1):
        tail = i * (i - a) / (x + 2 * i + 1 - a - tail)
    return max(0.0, 1.0 - front / (x + 1 - a - tail))


def chi2_quantile(d: int, p: float) -> float:
    """The value that a chi-square variable of ``d`` degrees of freedom stays below with probability ``p``."""
    if not 0 < p < 1:
        raise ValueError("p must be inside (0, 1)")
    low, high = 0.0, float(d)
    while gamma_p(d / 2, high / 2) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if gamma_p(d / 2, mid / 2) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def rng(seed: int) -> np.random.Generator:
    return np.random.default_rng(seed)
