"""Distributions of unit variance on numpy arrays, and columns made of them.

Families: normal, t (nu), ged (nu), skewt (nu, lam; Hansen's) and laplace, all
of mean 0 and variance 1.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .special import gamma_p, norm_cdf, norm_ppf, t_cdf

FAMILIES = ("normal", "t", "ged", "skewt", "laplace")


def hansen(nu: float, lam: float) -> tuple[float, float, float]:
    """The constants a, b, c of the skewed t."""
    c = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi * (nu - 2))
    a = 4 * lam * c * (nu - 2) / (nu - 1)
    return a, math.sqrt(1 + 3 * lam**2 - a**2), c


def ged_scale(nu: float) -> float:
    return math.exp(0.5 * (-2 / nu * math.log(2) + math.lgamma(1 / nu) - math.lgamma(3 / nu)))


def bisected(f, p: np.ndarray, lo: float, hi: float, rounds: int = 80) -> np.ndarray:
    """x with f(x) = p for a growing f; the bounds widen until they hold every p."""
    p = np.asarray(p, float)
    a, b = np.full(p.shape, lo), np.full(p.shape, hi)
    for _ in range(60):
        low, high = f(a) > p, f(b) < p
        if not (low | high).any():
            break
        a, b = np.where(low, a * 2, a), np.where(high, b * 2, b)
    for _ in range(rounds):
        m = (a + b) / 2
        up = f(m) < p
        a, b = np.where(up, m, a), np.where(up, b, m)
    return (a + b) / 2


def cdf(x, family: str = "normal", nu: float = 8.0, lam: float = 0.0) -> np.ndarray:
    x = np.asarray(x, float)
    if family == "normal":
        return norm_cdf(x)
    if family == "laplace":
        tail = 0.5 * np.exp(-math.sqrt(2) * np.abs(x))
        return np.where(x < 0, tail, 1 - tail)
    if family == "ged":
        half = 0.5 * gamma_p(1 / nu, 0.5 * (np.abs(x) / ged_scale(nu)) ** nu)
        return np.where(x < 0, 0.5 - half, 0.5 + half)
    wide = math.sqrt(nu / (nu - 2))
    if family == "t":
        return t_cdf(x * wide, nu)
    if family == "skewt":
        a, b, _ = hansen(nu, lam)
        y = b * x + a
        left = (1 - lam) * t_cdf(wide * y / (1 - lam), nu)
        right = (1 - lam) / 2 + (1 + lam) * (t_cdf(wide * y / (1 + lam), nu) - 0.5)
        return np.where(y < 0, left, right)
    raise ValueError(f"unknown family {family}")


def ppf(p, family: str = "normal", nu: float = 8.0, lam: float = 0.0) -> np.ndarray:
    """Quantiles; 0 and 1 give infinities, other numbers outside them NaN."""
    p = np.atleast_1d(np.asarray(p, float))
    if family == "normal":
        return norm_ppf(p)
    inside = (p > 0) & (p < 1)
    q = np.where(inside, p, 0.5)
    if family == "laplace":
        x = np.where(q < 0.5, np.log(2 * q), -np.log(2 * (1 - q))) / math.sqrt(2)
    elif family in ("t", "ged", "skewt"):
        x = bisected(lambda v: cdf(v, family, nu, lam), q, -8.0, 8.0)
    else:
        raise ValueError(f"unknown family {family}")
    return np.where(inside, x, np.where(p == 0, -np.inf, np.where(p == 1, np.inf, np.nan)))


def log_constant(family: str, nu: float, lam: float = 0.0) -> float:
    """What a log density has at its own shape, whatever x is."""
    if family == "t":
        return math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
    if family == "ged":
        return math.log(nu) - math.log(ged_scale(nu)) - (1 + 1 / nu) * math.log(2) - math.lgamma(1 / nu)
    if family == "skewt":
        _, b, c = hansen(nu, lam)
        return math.log(b * c)
    return -0.5 * math.log(2 * math.pi) if family == "normal" else -0.5 * math.log(2)


def log_pdf(x, family: str = "normal", nu: float = 8.0, lam: float = 0.0) -> np.ndarray:
    x = np.asarray(x, float)
    const = log_constant(family, nu, lam)
    if family == "normal":
        return const - 0.5 * x * x
    if family == "laplace":
        return const - math.sqrt(2) * np.abs(x)
    if family == "t":
        return const - (nu + 1) / 2 * np.log1p(x * x / (nu - 2))
    if family == "ged":
        return const - 0.5 * (np.abs(x) / ged_scale(nu)) ** nu
    a, b, _ = hansen(nu, lam)
    y = b * x + a
    y = y / np.where(y < 0, 1 - lam, 1 + lam)
    return const - (nu + 1) / 2 * np.log1p(y * y / (nu - 2))


def mean_abs(family: str = "normal", nu: float = 8.0, lam: float = 0.0) -> float:
    """E|z| of a family: in closed form, for the skewed t from its own distribution function."""
    if family == "normal":
        return math.sqrt(2 / math.pi)
    if family == "laplace":
        return 1 / math.sqrt(2)
    if family == "t":
        return 2 * math.sqrt(nu - 2) * math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / (math.sqrt(math.pi) * (nu - 1))
    if family == "ged":
        return math.exp(math.lgamma(2 / nu) - 0.5 * (math.lgamma(1 / nu) + math.lgamma(3 / nu)))
    u = np.linspace(-12, 12, 48_001)  # E|z| = integral of P(|z| > x), the t's heavy tail added in closed form
    f = np.exp(log_pdf(u, family, nu, lam))
    body = np.trapezoid(np.abs(u) * f, u)
    tail = 12 * (cdf(np.array([-12.0]), family, nu, lam)[0] + 1 - cdf(np.array([12.0]), family, nu, lam)[0]) * nu / (nu - 1)
    return float(body + tail)


def cdf_column(x: Column | str, family: str = "normal", nu: float = 8.0, lam: float = 0.0) -> Column:
    """The probability integral transform of a column."""

    @F.pandas_udf(T.DoubleType())
    def transform(v: pd.Series) -> pd.Series:
        return pd.Series(cdf(v.astype(float).values, family, nu, lam)).where(v.notna().values)

    return transform(x)


def quantile_column(p: Column | str, family: str = "normal", nu: float = 8.0, lam: float = 0.0) -> Column:
    @F.pandas_udf(T.DoubleType())
    def transform(v: pd.Series) -> pd.Series:
        return pd.Series(ppf(v.astype(float).values, family, nu, lam)).where(v.notna().values)

    return transform(p)


def asymmetric_laplace(x: Column, mean: float = 0.0, scale: float = 1.0, kappa: float = 1.0) -> dict[str, Column]:
    """pdf, cdf and logpdf columns of an asymmetric Laplace: rate kappa / scale above the mean, 1 / (kappa scale) below."""
    d = (x - mean) / scale
    up, down = kappa, 1 / kappa
    log = -math.log(scale * (up + down)) - F.when(d >= 0, d * up).otherwise(-d * down)
    below = up / (up + down)  # mass under the mean: kappa^2 / (1 + kappa^2)
    return {"pdf": F.exp(log), "logpdf": log, "cdf": F.when(d >= 0, 1 - (1 - below) * F.exp(-d * up)).otherwise(below * F.exp(d * down))}


def asymmetric_laplace_quantile(p: Column, mean: float = 0.0, scale: float = 1.0, kappa: float = 1.0) -> Column:
    below = kappa**2 / (1 + kappa**2)
    return mean + scale * F.when(p < below, F.log(p / below) * kappa).otherwise(-F.log((1 - p) / (1 - below)) / kappa)


def normal_mixture(x: Column, weight: float, means: tuple[float, float], stds: tuple[float, float]) -> dict[str, Column]:
    """pdf and cdf columns of a mixture of two normals; ``weight`` is the first one's."""
    shares = (weight, 1 - weight)
    part = [w * F.exp(-0.5 * ((x - m) / s) ** 2) / (s * math.sqrt(2 * math.pi)) for w, m, s in zip(shares, means, stds, strict=True)]
    up = [w * cdf_column((x - m) / s) for w, m, s in zip(shares, means, stds, strict=True)]
    return {"pdf": part[0] + part[1], "cdf": up[0] + up[1]}
