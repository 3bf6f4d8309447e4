"""Distribution functions in numpy, and as Arrow-batched columns."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz), all elements at once."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (z > 0) & (z < 1)
    safe = np.where(inside, z, 0.5)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(safe) + q * np.log1p(-safe)) / p
    tiny = 1e-300
    c, d = np.ones_like(safe), 1 / np.where(np.abs(1 - (p + q) * safe / (p + 1)) < tiny, tiny, 1 - (p + q) * safe / (p + 1))
    h = d.copy()
    for m in range(1, 400):
        for top in (m * (q - m) * safe / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * safe / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    value = np.where(inside, front * h, np.where(z <= 0, 0.0, 1.0))
    return np.where(swap, 1 - value, value)


def gammaincc(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    safe = np.maximum(x, 1e-300)
    front = np.exp(a * np.log(safe) - safe - _lgamma(a))
    term, total, n = 1 / a, 1 / a, a.copy()
    for _ in range(1000):
        n = n + 1
        term = term * safe / n
        total = total + term
        if np.all(np.abs(term) <= 1e-16 * np.abs(total)):
            break
    b, c = safe + 1 - a, np.full_like(safe, 1e300)
    d = 1 / np.where(np.abs(b) < 1e-300, 1e-300, b)
    h = d.copy()
    for i in range(1, 1000):
        k = -i * (i - a)
        b = b + 2
        d = 1 / np.where(np.abs(k * d + b) < 1e-300, 1e-300, k * d + b)
        c = b + k / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    return np.where(x <= 0, 1.0, np.where(x < a + 1, 1 - front * total, front * h))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2, 0.5, df / (df + t * t))


def chi2_sf(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    return gammaincc(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def norm_two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2))


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided p of U without ties: twice the part of all orders whose U is at least the larger of U and n1 n2 - U, 1 at most.

    The orders of each U are the coefficients of a Gaussian binomial, in whole numbers: times (1 - q^(n+i)), over (1 - q^i).
    """
    m, n = sorted((int(n1), int(n2)))
    orders = [1] + [0] * (m * n)
    for i in range(1, m + 1):
        for j in range(m * n, n + i - 1, -1):
            orders[j] -= orders[j - n - i]
        for j in range(i, m * n + 1):
            orders[j] += orders[j - i]
    far = max(u, n1 * n2 - u)
    return min(1.0, 2 * sum(orders[math.ceil(far - 1e-9) :]) / sum(orders))


def beta_ppf(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The quantile by bisection on ``betainc``, all elements at once."""
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    lo, hi = np.zeros(a.shape), np.ones(a.shape)
    for _ in range(60):
        mid = (lo + hi) / 2
        low = betainc(a, b, mid) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def _column(f, *series: pd.Series) -> pd.Series:
    out = np.full(len(series[0]), np.nan)
    ok = np.logical_and.reduce([s.notna().to_numpy() for s in series])
    if ok.any():
        out[ok] = f(*(s.to_numpy(float)[ok] for s in series))
    return pd.Series(out).where(ok, None)


def t_p(t, df):
    """Two-sided p of Student's t as a column; null where either is."""

    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return _column(t_two_sided, a, b)

    return f(t, df)


def chi2_p(x, df):
    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return _column(chi2_sf, a, b)

    return f(x, df)


def norm_p(z):
    @F.pandas_udf("double")
    def f(a: pd.Series) -> pd.Series:
        return _column(norm_two_sided, a)

    return f(z)


def mann_whitney_p(u, n1, n2, tied, z):
    """Two-sided p as a column: exact if one side has at most 8 values and none are tied, else the normal score's."""

    @F.pandas_udf("double")
    def f(u: pd.Series, n1: pd.Series, n2: pd.Series, tied: pd.Series, z: pd.Series) -> pd.Series:
        out = _column(norm_two_sided, z).astype(float).to_numpy(copy=True)
        for i in np.flatnonzero((np.minimum(n1, n2) <= 8) & (tied == 0)):
            out[i] = mann_whitney_exact(float(u[i]), int(n1[i]), int(n2[i]))
        return pd.Series(np.where(np.isnan(out), 1.0, out))

    return f(u, n1, n2, tied, z)


def hypergeometric_p(a: int, b: int, c: int, d: int, greater: bool, piece: int = 1 << 16) -> float:
    """Fisher's p of one table. The counts that the margins allow are gone through in pieces, so memory does not grow with them."""
    r, s, n = a + b, a + c, a + b + c + d
    log_factorial = lambda x: _lgamma(np.asarray(x, float) + 1)
    whole = math.lgamma(r + 1) + math.lgamma(n - r + 1) + math.lgamma(s + 1) + math.lgamma(n - s + 1) - math.lgamma(n + 1)
    chance = lambda k: np.exp(whole - log_factorial(k) - log_factorial(r - k) - log_factorial(s - k) - log_factorial(n - r - s + k))
    own, total = float(chance(np.array([a]))[0]), 0.0
    for at in range(a if greater else max(0, r + s - n), min(r, s) + 1, piece):
        p = chance(np.arange(at, min(at + piece, min(r, s) + 1)))
        total += float(p.sum() if greater else p[p <= own * (1 + 1e-7)].sum())
    return min(1.0, total)


def fisher_p(a: Column, b: Column, c: Column, d: Column, greater: bool) -> Column:
    """Fisher's p of the tables a b over c d; null for a null count. Equal tables of a batch are computed once."""

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}
        out = []
        for row in zip(a, b, c, d):
            if any(pd.isna(v) for v in row):
                out.append(None)
                continue
            key = tuple(int(v) for v in row)
            if key not in known:
                known[key] = hypergeometric_p(*key, greater)
            out.append(known[key])
        return pd.Series(out, dtype="float64")

    return p(a, b, c, d)
