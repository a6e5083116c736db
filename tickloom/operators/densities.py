"""Log densities, likelihoods, fits and goodness of fit of return distributions."""

from __future__ import annotations

import math
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import cdf_column, ged_scale, hansen, log_constant, ppf, quantile_column
from .series import ordered


def log_pdf(x: Column, family: str = "normal", mean=0.0, std=1.0, nu: float = 8.0, lam: float = 0.0) -> Column:
    """Log density of a normal, Student's t, GED, skewed t or Laplace variable of the given mean and standard deviation."""
    mean, std = (v if isinstance(v, Column) else F.lit(v) for v in (mean, std))
    z = (x - mean) / std
    if family == "normal":
        core = -0.5 * (math.log(2 * math.pi) + z * z)
    elif family == "t":
        core = log_constant("t", nu) - (nu + 1) / 2 * F.log1p(z * z / (nu - 2))
    elif family == "ged":
        core = log_constant("ged", nu) - 0.5 * F.pow(F.abs(z) / ged_scale(nu), F.lit(nu))
    elif family == "skewt":
        a, b, _ = hansen(nu, lam)
        y = (b * z + a) / F.when(b * z + a < 0, 1 - lam).otherwise(1 + lam)
        core = log_constant("skewt", nu, lam) - (nu + 1) / 2 * F.log1p(y * y / (nu - 2))
    elif family == "laplace":
        core = -0.5 * math.log(2) - math.sqrt(2) * F.abs(z)
    else:
        raise ValueError(f"unknown family {family}")
    return core - F.log(std)


def _moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with a value, beside their group's ``_mean`` and ``_std``; groups without spread are left out."""
    moments = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    return df.where(F.col(value).isNotNull()).join(moments.where("_std > 0"), keys)


def compare_families(df: DataFrame, keys: list[str], value: str, families: dict[str, tuple[str, float]]) -> DataFrame:
    """(keys, model, loglik, n, aic, bic): moment fits of each named (family, nu), all scored in one pass after the moments.

    Mean and standard deviation are each group's own and count as two parameters.
    """
    rows = _moments(df, keys, value)
    sums = {m: F.sum(log_pdf(F.col(value), f, F.col("_mean"), F.col("_std"), nu)) for m, (f, nu) in families.items()}
    wide = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[s.alias(m) for m, s in sums.items()])
    long = wide.unpivot([*keys, "n"], list(families), "model", "loglik")
    return long.select(*keys, "model", "loglik", "n", (4 - 2 * F.col("loglik")).alias("aic"), (2 * F.log("n") - 2 * F.col("loglik")).alias("bic"))


#: Where a fit's shapes are looked for: nu by its logarithm, lam as it is, the scale as a factor of the group's deviation.
BOUNDS = {"nu": (2.05, 200.0), "nu_ged": (0.4, 12.0), "lam": (-0.95, 0.95), "scale": (0.6, 1.6)}


def fit_family(df: DataFrame, keys: list[str], value: str, family: str, points: int = 5, rounds: int = 8) -> DataFrame:
    """(keys, family, mean, std, nu, lam, loglik, n, aic, bic): the likeliest scale and shapes of each group around its mean.

    Every round scores a small grid of candidates of each group in one pass
    over the distributed rows, then narrows the grid around the best, so what
    moves is a row of sums for each group. The mean is the group's own.
    """
    rows = _moments(df, keys, value).select(*keys, "_mean", "_std", ((F.col(value) - F.col("_mean")) / F.col("_std")).alias("_z"))
    names = {"normal": [], "laplace": ["scale"], "t": ["nu", "scale"], "ged": ["nu", "scale"], "skewt": ["nu", "lam", "scale"]}[family]
    points = points if len(names) < 3 else 3
    limits = {c: BOUNDS["nu_ged" if (c, family) == ("nu", "ged") else c] for c in names}
    log = {c: c == "nu" for c in names}
    spread = [k / (points - 1) * 2 - 1 for k in range(points)] if names else [0.0]
    grid = list(product(*[spread for _ in names])) or [()]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    groups = rows.select(*keys, "_mean", "_std").groupBy(*keys).agg(F.first("_mean").alias("_mean"), F.first("_std").alias("_std"), F.count("*").alias("_n"))
    middle = {c: (math.sqrt(a * b) if log[c] else (a + b) / 2) for c, (a, b) in limits.items()}
    best = groups.select(*keys, *[F.lit(v).alias(f"_{c}") for c, v in middle.items()], F.lit(None).cast("double").alias("_ll"))

    def constants(width: float):
        def run(frames):
            for pdf in frames:
                out = []
                for r in pdf.to_dict("records"):
                    cells = []
                    for step in grid:
                        at = {"nu": 8.0, "lam": 0.0, "scale": 1.0}
                        for c, u in zip(names, step):
                            (a, b), m = limits[c], r[f"_{c}"]
                            x = m * (b / a) ** (u * width / 2) if log[c] else m + u * width * (b - a) / 2
                            at[c] = min(max(x, a), b)
                        shift, stretch, _ = hansen(at["nu"], at["lam"]) if family == "skewt" else (0.0, 1.0, 0.0)
                        root = ged_scale(at["nu"]) if family == "ged" else 1.0
                        cells.append({**at, "c": log_constant(family, at["nu"], at["lam"]) - math.log(at["scale"]), "a": shift, "b": stretch, "g": root})
                    out.append({**{k: r[k] for k in keys}, "cells": cells})
                yield pd.DataFrame(out, columns=[*keys, "cells"])

        return run

    def term(z: Column, p: Column) -> Column:
        x = z / p["scale"]
        if family == "normal":
            return p["c"] - 0.5 * x * x
        if family == "laplace":
            return p["c"] - math.sqrt(2) * F.abs(x)
        if family == "ged":
            return p["c"] - 0.5 * F.pow(F.abs(x) / p["g"], p["nu"])
        y = p["b"] * x + p["a"]
        y = y / F.when(y < 0, 1 - p["lam"]).otherwise(1 + p["lam"])
        return p["c"] - (p["nu"] + 1) / 2 * F.log1p(y * y / (p["nu"] - 2))

    width = 1.0
    for _ in range(rounds if names else 1):
        cells = best.mapInPandas(constants(width), f"{kinds}, cells array<struct<nu:double,lam:double,scale:double,c:double,a:double,b:double,g:double>>")
        tried = rows.join(cells, keys).select(*keys, "_z", F.posexplode("cells").alias("_k", "_p"))
        sums = tried.groupBy(*keys, "_k", "_p").agg(F.sum(term(F.col("_z"), F.col("_p"))).alias("_v"))
        top = sums.where(~F.isnan("_v")).groupBy(*keys).agg(F.max(F.struct("_v", (-F.col("_k")).alias("k"), "_p")).alias("_t"))
        best = top.select(*keys, *[F.col(f"_t._p.{c}").alias(f"_{c}") for c in names], F.col("_t._v").alias("_ll"))
        width *= 0.55
    out = best.join(groups, keys)
    has = lambda c: F.col(f"_{c}") if c in names else F.lit(None).cast("double")
    k = len(names) + (1 if "scale" in names else 2)
    std = F.col("_std") * F.col("_scale") if "scale" in names else F.col("_std")
    ll = F.col("_ll") - F.col("_n") * F.log("_std")
    return out.select(*keys, F.lit(family).alias("family"), F.col("_mean").alias("mean"), std.alias("std"), has("nu").alias("nu"), has("lam").alias("lam"), ll.alias("loglik"), F.col("_n").alias("n"), (2 * k - 2 * ll).alias("aic"), (k * F.log("_n") - 2 * ll).alias("bic"))


def kolmogorov_smirnov(df: DataFrame, keys: list[str], value: str, family: str = "normal", nu: float = 8.0, lam: float = 0.0) -> DataFrame:
    """(keys, statistic, p_value, n): the largest distance of a group's standardised values from a family, on either side of each step; p is exp(-2 n d^2)."""
    rows = _moments(df, keys, value).withColumn("_z", (F.col(value) - F.col("_mean")) / F.col("_std"))
    w = Window.partitionBy(*keys)
    rows = rows.withColumns({"_i": F.rank().over(w.orderBy("_z")), "_j": F.count("*").over(w.orderBy("_z").rangeBetween(Window.unboundedPreceding, 0)), "_n": F.count("*").over(w), "_f": cdf_column("_z", family, nu, lam)})
    side = F.greatest(F.col("_j") / F.col("_n") - F.col("_f"), F.col("_f") - (F.col("_i") - 1) / F.col("_n"))
    out = rows.groupBy(*keys).agg(F.max(side).alias("statistic"), F.count("*").alias("n"))
    return out.select(*keys, "statistic", F.exp(-2 * F.col("n") * F.col("statistic") ** 2).alias("p_value"), "n")


def lilliefors(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, statistic, n, crit_10, crit_5, crit_1): distance from the normal with estimated moments, beside tabulated large-sample limits."""
    out = kolmogorov_smirnov(df, keys, value)
    return out.select(*keys, "statistic", "n", *[(F.lit(c) / F.sqrt("n")).alias(f"crit_{p}") for p, c in ((10, 0.805), (5, 0.886), (1, 1.031))])  # fixed values of the published table


def quantile_table(fits: DataFrame, keys: list[str], probabilities: list[float], family: str) -> DataFrame:
    """(keys, p, quantile) of fitted parameters (mean, std, nu, lam) at each probability."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fits.select(*keys).schema)

    def run(frames):
        for pdf in frames:
            parts = []
            for r in pdf.to_dict("records"):
                shape = {k: r[k] for k in ("nu", "lam") if pd.notna(r[k])}
                parts.append(pd.DataFrame({**{k: [r[k]] * len(probabilities) for k in keys}, "p": probabilities, "quantile": r["mean"] + r["std"] * ppf(probabilities, family, **shape)}))
            if parts:
                yield pd.concat(parts)

    return fits.select(*keys, "mean", "std", "nu", "lam").mapInPandas(run, f"{kinds}, p double, quantile double")


def qq(df: DataFrame, keys: list[str], value: str, family: str = "normal", nu: float = 8.0, lam: float = 0.0) -> DataFrame:
    """Rows (keys, value, position, theoretical): plotting positions (i - 1/2) / n and the family's quantiles, by the group's mean and deviation."""
    rows = _moments(df, keys, value)
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("position", (F.row_number().over(w.orderBy(value)) - 0.5) / F.count("*").over(w))
    return rows.select(*keys, value, "position", (F.col("_mean") + F.col("_std") * quantile_column("position", family, nu, lam)).alias("theoretical"))


def qq_fit(table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mse, r2, max_deviation, n) of a ``qq`` table."""
    gap = F.col(value) - F.col("theoretical")
    return table.groupBy(*keys).agg(F.avg(gap * gap).alias("mse"), (F.corr(value, "theoretical") ** 2).alias("r2"), F.max(F.abs(gap)).alias("max_deviation"), F.count("*").alias("n"))


def berkowitz(df: DataFrame, keys: list[str], order: list[str], pit: str) -> DataFrame:
    """(keys, statistic, p_value, n): likelihood ratio of a free AR(1) against standard normal independence of probit transforms."""
    clipped = F.least(F.greatest(F.col(pit), F.lit(1e-10)), F.lit(1 - 1e-10))
    z = df.withColumn("_z", quantile_column(clipped)).withColumn("_l", F.lag("_z").over(ordered(keys, order))).where("_l is not null and _z is not null")
    fit = z.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_sxx("_z", "_l").alias("_sxx"), F.regr_sxy("_z", "_l").alias("_sxy"), F.regr_syy("_z", "_l").alias("_syy"), F.sum(F.col("_z") ** 2).alias("_s0"))
    s2 = (F.col("_syy") - F.col("_sxy") ** 2 / F.nullif(F.col("_sxx"), F.lit(0.0))) / F.col("n")
    stat = F.col("_s0") - F.col("n") * (F.log(s2) + 1)
    return fit.select(*keys, stat.alias("statistic"), "n").withColumn("p_value", F.lit(1.0) - _chi2_3(F.col("statistic")))


def _chi2_3(x: Column) -> Column:
    """The distribution function of chi-squared with three degrees of freedom, by the normal's."""
    root = F.sqrt(F.greatest(x, F.lit(0.0)))
    return 2 * cdf_column(root) - 1 - math.sqrt(2 / math.pi) * root * F.exp(-root * root / 2)

