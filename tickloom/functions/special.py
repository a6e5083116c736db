"""Special functions on numpy arrays, and p-value columns made of them."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erf = np.vectorize(math.erf, otypes=[float])


def norm_cdf(x) -> np.ndarray:
    return 0.5 * (1 + _erf(np.asarray(x, float) / math.sqrt(2)))


def norm_ppf(p) -> np.ndarray:
    inv = NormalDist().inv_cdf
    return np.array([inv(v) if 0 < v < 1 else (-np.inf if v == 0 else np.inf if v == 1 else np.nan) for v in np.atleast_1d(np.asarray(p, float))])


def gamma_p(a, x) -> np.ndarray:
    """Regularised lower incomplete gamma: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    front = np.exp(np.where(x > 0, a * np.log(np.maximum(x, 1e-300)), 0) - x - _lgamma(a))
    term = total = 1 / a
    for k in range(1, 400):
        term = term * x / (a + k)
        total = total + term
    series = front * total
    b = x + 1 - a
    c, d = np.full_like(b, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d.copy()
    for k in range(1, 400):
        n = -k * (k - a)
        b = b + 2
        d = 1 / _nonzero(n * d + b)
        c = _nonzero(b + n / c)
        h = h * d * c
    return np.where(x <= 0, 0.0, np.where(x < a + 1, series, 1 - front * h))


def _nonzero(v: np.ndarray) -> np.ndarray:
    return np.where(np.abs(v) < 1e-300, 1e-300, v)


def beta_i(a, b, x) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, on the side where that converges fast."""
    a, b, x = (v.astype(float) for v in np.broadcast_arrays(np.asarray(a), np.asarray(b), np.asarray(x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inside = (y > 0) & (y < 1)
    z = np.where(inside, y, 0.5)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    c = np.ones_like(z)
    d = 1 / _nonzero(1 - (p + q) * z / (p + 1))
    h = d.copy()
    for k in range(1, 300):
        for n in (k * (q - k) * z / ((p + 2 * k - 1) * (p + 2 * k)), -(p + k) * (p + q + k) * z / ((p + 2 * k) * (p + 2 * k + 1))):
            d = 1 / _nonzero(1 + n * d)
            c = _nonzero(1 + n / c)
            h = h * c * d
    out = np.where(inside, front * h, np.where(y <= 0, 0.0, 1.0))
    return np.where(flip, 1 - out, out)


def t_cdf(x, df) -> np.ndarray:
    x = np.asarray(x, float)
    tail = 0.5 * beta_i(np.asarray(df, float) / 2, 0.5, df / (df + x**2))
    return np.where(x > 0, 1 - tail, tail)


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(chi-squared with df degrees of freedom > x)."""
    return pd.Series(1 - gamma_p(df.astype(float).values / 2, x.astype(float).values / 2)).where(x.notna().values)


@F.pandas_udf(T.DoubleType())
def f_sf(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """P(F with d1 and d2 degrees of freedom > x)."""
    v, a, b = (s.astype(float).values for s in (x, d1, d2))
    return pd.Series(beta_i(b / 2, a / 2, b / (b + a * np.maximum(v, 0)))).where(x.notna().values)


@F.pandas_udf(T.DoubleType())
def t_two_sided(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(|t with df degrees of freedom| > |x|)."""
    return pd.Series(2 * (1 - t_cdf(np.abs(x.astype(float).values), df.astype(float).values))).where(x.notna().values)


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return pd.Series(norm_cdf(x.astype(float).values)).where(x.notna().values)


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return pd.Series(norm_ppf(p.astype(float).values)).where(p.notna().values)
