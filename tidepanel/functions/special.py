"""Tail probabilities by continued fractions and series; no table beyond the two published ones."""

from __future__ import annotations

import math

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's method for the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    if f <= 0:
        return 1.0
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return betainc(df / 2, 0.5, df / (df + t * t))


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of chi-squared: the series below the mean, the continued fraction above it."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


# MacKinnon's response surface for one series with a constant, and the level-stationarity table.
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_SPLIT, ADF_MAX, ADF_MIN = -1.61, 2.74, -18.83
KPSS_CRITICAL = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def adf_pvalue(tau: float) -> float:
    if tau > ADF_MAX:
        return 1.0
    if tau < ADF_MIN:
        return 0.0
    return normal_cdf(sum(c * tau**i for i, c in enumerate(ADF_SMALL if tau <= ADF_SPLIT else ADF_LARGE)))


def kpss_pvalue(eta: float) -> float:
    """Linear between the table's points, held at its ends."""
    if eta <= KPSS_CRITICAL[0][0]:
        return KPSS_CRITICAL[0][1]
    for (x0, p0), (x1, p1) in zip(KPSS_CRITICAL, KPSS_CRITICAL[1:], strict=False):
        if eta <= x1:
            return p0 + (p1 - p0) * (eta - x0) / (x1 - x0)
    return KPSS_CRITICAL[-1][1]


def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.atleast_1d(x)])


def t_sf2_many(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """t_sf2 of whole columns: the continued fraction of the incomplete beta function, a step for all rows at a time."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    a, b, x = df / 2, np.full(df.shape, 0.5), df / (df + t * t)
    swap = x >= (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    uniq, inverse = np.unique(df, return_inverse=True)
    front_gamma = (log_gamma(uniq / 2 + 0.5) - log_gamma(uniq / 2) - math.lgamma(0.5))[inverse].reshape(df.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(front_gamma + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    kept = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(x), 1 / kept(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        moved = 0.0
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / kept(1 + step * d)
            c = kept(1 + step / c)
            h *= d * c
            moved = np.abs(d * c - 1)
        if np.max(moved, initial=0.0) < 1e-16:
            break
    out = front * h
    out = np.where(x <= 0, 0.0, out)
    return np.where(swap, 1 - out, out)
