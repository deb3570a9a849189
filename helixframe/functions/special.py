"""Special functions in numpy, for the few columns Spark has no function for."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def _each(f, x) -> np.ndarray:
    """f of each number. (An ``np.vectorize`` object would keep a ufunc that can't be pickled once it was called.)"""
    x = np.asarray(x, float)
    return np.fromiter((f(v) for v in x.ravel().tolist()), float, x.size).reshape(x.shape)


def lgamma(x) -> np.ndarray:
    return _each(math.lgamma, x)


def normal_cdf(x):
    return 0.5 * _each(math.erfc, -np.asarray(x, float) / math.sqrt(2))


def digamma(x: float) -> float:
    """By recurrence up to 10 and the asymptotic series."""
    total = 0.0
    while x < 10:
        total -= 1 / x
        x += 1
    y = 1 / (x * x)
    return total + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: float, parity: bool = False) -> float:
    """By recurrence up to 5 and the asymptotic series; parity: its last terms with exponents 4, 6, 7 for 5, 7, 9."""
    total = 0.0
    while x < 5:
        total += 1 / (x * x)
        x += 1
    a, b, c = (4, 6, 7) if parity else (5, 7, 9)
    return total + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**a) + 1 / (42 * x**b) - 1 / (30 * x**c)


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, h = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / (c or tiny)
        h *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (h - 1)


def gamma_inc_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        total, term, n = 1 / a, 1 / a, a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / (c or 1e-300)
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def poisson_cdf(rate: np.ndarray, k: np.ndarray) -> np.ndarray:
    """P(X <= k) for each rate above 0 and whole k: the terms of the shorter side, from k away, until they no longer count."""
    rate, k = (np.asarray(x, float) for x in (rate, k))
    shape, rate, k = rate.shape, rate.ravel(), k.ravel()
    below, some = k < rate, np.flatnonzero(k >= 0)
    # below the rate terms fall from k down, above it from k + 1 up
    at = np.where(below, k, k + 1)[some]
    term = np.exp(at * np.log(rate[some]) - rate[some] - lgamma(at + 1))
    total, own, down, r = term.copy(), np.arange(len(some)), below[some], rate[some]
    while len(own):
        term = term * np.where(down, at / r, r / (at + 1))
        at = np.where(down, at - 1, at + 1)
        total[own] += term
        go = term > 1e-17 * total[own]
        own, term, at, down, r = own[go], term[go], at[go], down[go], r[go]
    out = np.zeros(len(rate))
    out[some] = np.where(below[some], total, 1 - total).clip(0, 1)
    return out.reshape(shape)


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_inc(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    if not f > 0 or d1 <= 0 or d2 <= 0:
        return float("nan") if d1 <= 0 or d2 <= 0 or math.isnan(f) else 1.0
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf(x: float, df: float) -> float:
    return gamma_inc_upper(df / 2, x / 2)


def normal_tail(z: np.ndarray) -> np.ndarray:
    """P(Z > |z|); beyond 6 by the Mills ratio, as erfc would lose nothing until 37 this only matters there."""
    a = np.abs(np.asarray(z, float))
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        mills = np.exp(-0.5 * a * a) / math.sqrt(2 * math.pi) * (1 / a - 1 / a**3 + 3 / a**5 - 15 / a**7)
    return np.where(a > 37, mills, 0.5 * _each(math.erfc, a / math.sqrt(2)))


ALTERNATIVES = ("twosided", "greater", "less")


def z_pvalue(z: np.ndarray, alternative: str = "twosided") -> np.ndarray:
    alternative = alternative.lower()
    if alternative not in ALTERNATIVES:
        raise ValueError(f"unknown alternative {alternative!r}")
    z = np.asarray(z, float)
    tail = normal_tail(z)
    if alternative == "twosided":
        return np.minimum(2 * tail, 1)
    up = np.where(z > 0, tail, 1 - tail)
    return up if alternative == "greater" else np.where(z > 0, 1 - tail, tail)


def hypergeom_sf(q: int, m: int, n: int, k: int) -> float:
    """P(X > q) for k draws from m marked and n others; 1 for q = 0."""
    if q == 0:
        return 1.0
    lo, hi = max(q + 1, k - n), min(k, m)
    if lo > hi:
        return 0.0
    x = np.arange(lo, hi + 1)
    choose = lambda a, b: lgamma(a + 1.0) - lgamma(b + 1.0) - lgamma(a - b + 1.0)
    terms = choose(np.full(len(x), m), x) + choose(np.full(len(x), n), k - x) - choose(np.array([m + n]), np.array([k]))
    top = terms.max()
    return float(min(1.0, math.exp(top) * np.exp(terms - top).sum()))


def z_pvalue_col(z: Column, alternative: str = "twosided") -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(z_pvalue(x.to_numpy(float), alternative))

    return run(z)


def hypergeom_col(q: Column, m: Column, n: Column, k: Column) -> Column:
    @F.pandas_udf("double")
    def run(q: pd.Series, m: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([hypergeom_sf(*map(int, x)) for x in zip(q, m, n, k, strict=True)], dtype=float)

    return run(q, m, n, k)


def chi2_sf_col(x: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([chi2_sf(float(a), float(b)) for a, b in zip(x, df, strict=True)], dtype=float)

    return run(x, df)


def f_sf_col(f: Column, d1: Column, d2: Column) -> Column:
    @F.pandas_udf("double")
    def run(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return pd.Series([f_sf(*map(float, x)) for x in zip(f, d1, d2, strict=True)], dtype=float)

    return run(f, d1, d2)
