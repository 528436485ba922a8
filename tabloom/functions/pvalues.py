"""Tail probabilities of a handful of test statistics (scalars on the driver)."""

from __future__ import annotations

import math
from statistics import NormalDist


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: a series for small x, a continued fraction otherwise."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1 - a
    cc, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / ((an * d + b) or 1e-300)
        cc = (b + an / cc) or 1e-300
        step = d * cc
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return scale * h


def chi2_tail(x: float, df: float) -> float:
    return _upper_gamma(df / 2, x / 2)


def _beta_fraction(x: float, a: float, b: float) -> float:
    cc, d = 1.0, 1.0 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                          -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1 + numerator * d) or 1e-300)
            cc = (1 + numerator / cc) or 1e-300
            step = d * cc
            h *= step
        if abs(step - 1) < 1e-16:
            break
    return h


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(x, a, b) / a
    return 1 - front * _beta_fraction(1 - x, b, a) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / (df + t * t), df / 2, 0.5)


def f_tail(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def ks_tail(statistic: float, n: int, m: int) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    x = statistic * math.sqrt(n * m / (n + m))
    if x < 1e-3:
        return 1.0
    if x < 1.18:
        total = sum(math.exp(-((2 * k - 1) ** 2) * math.pi ** 2 / (8 * x * x)) for k in range(1, 30))
        return min(1.0, max(0.0, 1 - math.sqrt(2 * math.pi) / x * total))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 30))))
