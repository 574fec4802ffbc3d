"""Quantile of Student's t, needed once per query on the driver."""

from __future__ import annotations

from math import exp, inf, lgamma, log
from statistics import NormalDist


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def _upper_tail(t: float, df: float) -> float:
    """P(T > t) for t >= 0."""
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x >= 1.0:
        return 0.5
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1.0 - x))
    if x < (a + 1.0) / (a + b + 2.0):
        return 0.5 * front * _beta_fraction(a, b, x) / a
    return 0.5 * (1.0 - front * _beta_fraction(b, a, 1.0 - x) / b)


def t_quantile(level: float, df: float) -> float:
    """Two-sided critical value, for example level 0.95."""
    tail = (1.0 - level) / 2.0
    if df == inf:
        return NormalDist().inv_cdf(1.0 - tail)
    low, high = 0.0, 1.0
    while _upper_tail(high, df) > tail:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if _upper_tail(middle, df) > tail:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0
