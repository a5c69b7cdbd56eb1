"""Tail probabilities of t, F, chi-square and normal for a handful of scalars per call.

Spark computes the statistics; only the final lookup of a p-value happens here.
"""

from __future__ import annotations

import math

_TINY = 1e-300
_STOP = 1e-15


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, modified Lentz evaluation."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    value = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + term / c
            c = c if abs(c) > _TINY else _TINY
            step = c * d
            value *= step
        if abs(step - 1.0) < _STOP:
            break
    return value


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * _STOP:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * front)
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    value = d
    for i in range(1, 10_000):
        coef = -i * (i - a)
        b += 2.0
        d = coef * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + coef / c
        c = c if abs(c) > _TINY else _TINY
        step = c * d
        value *= step
        if abs(step - 1.0) < _STOP:
            break
    return front * value


def t_two_sided(t: float, dof: float) -> float:
    if math.isnan(t) or dof <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return beta_cdf(dof / 2.0, 0.5, dof / (dof + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    if math.isnan(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if math.isinf(f):
        return 0.0
    return beta_cdf(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_sf(x: float, dof: float) -> float:
    if math.isnan(x) or dof <= 0:
        return float("nan")
    return gamma_sf(dof / 2.0, x / 2.0)
