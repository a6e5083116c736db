"""Statistical tests as aggregates over each series."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi2_sf, f_sf, normal_cdf
from .arma import lag_gram
from .describe import acf
from .regress import by_group, few_groups, gram, inverse, ols, predict, unpack
from .series import lag_table, ordered


def ljung_box(df: DataFrame, keys: list[str], order: list[str], value: str, lags: int, model_df: int = 0) -> DataFrame:
    """(keys, statistic, df, p_value, n)."""
    a = acf(df, keys, order, value, lags)
    q = F.sum(F.col("acf") ** 2 / (F.col("n") - F.col("lag"))) * F.first("n") * (F.first("n") + 2)
    out = a.groupBy(*keys).agg(q.alias("statistic"), F.first("n").alias("n")).withColumn("df", F.lit(float(lags - model_df)))
    return out.withColumn("p_value", chi2_sf("statistic", "df"))


def jarque_bera(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, statistic, p_value, skew, kurtosis, n); the p-value of two degrees of freedom is exp(-x / 2)."""
    m = df.withColumn("_c", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    p = m.groupBy(*keys).agg(F.count("_c").alias("n"), *[F.avg(F.col("_c") ** k).alias(f"_m{k}") for k in (2, 3, 4)])
    p = p.withColumns({"skew": F.col("_m3") / F.pow("_m2", F.lit(1.5)), "kurtosis": F.col("_m4") / F.col("_m2") ** 2 - 3})
    p = p.withColumn("statistic", F.col("n") / 6 * (F.col("skew") ** 2 + F.col("kurtosis") ** 2 / 4))
    return p.withColumn("p_value", F.exp(-F.col("statistic") / 2)).drop("_m2", "_m3", "_m4")


def durbin_watson(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    d = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_d", d).groupBy(*keys).agg((F.sum(F.col("_d") ** 2) / F.sum(F.col(value) ** 2)).alias("statistic"))


def _explained(df: DataFrame, y: str, xs: list[str], keys: list[str]) -> DataFrame:
    """(keys, statistic, df, p_value, n): n times the R squared of ``y`` on ``xs`` and a constant, and its chi-squared p-value."""
    fit = ols(df, y, xs, keys).where("term = 'const'")
    out = fit.select(*keys, (F.col("n") * F.col("r2")).alias("statistic"), F.lit(float(len(xs))).alias("df"), "n")
    return out.withColumn("p_value", chi2_sf("statistic", "df"))


def engle_arch(df: DataFrame, keys: list[str], order: list[str], value: str, lags: int = 1) -> DataFrame:
    """ARCH test: squares on their ``lags``; the statistic counts all rows of a series, those without lags too."""
    s = lag_table(df.withColumn("_y", F.col(value) ** 2), keys, order, "_y", lags)
    out = _explained(s, "_y", [f"lag_{k}" for k in range(1, lags + 1)], keys)
    n = F.col("n") + lags
    return out.withColumns({"statistic": F.col("statistic") * n / F.col("n"), "n": n}).withColumn("p_value", chi2_sf("statistic", "df"))


def breusch_pagan(df: DataFrame, keys: list[str], xs: str | list[str], residual: str) -> DataFrame:
    """Squared residuals on the regressors and a constant."""
    return _explained(df.withColumn("_y", F.col(residual) ** 2), "_y", [xs] if isinstance(xs, str) else xs, keys)


def white(df: DataFrame, keys: list[str], xs: list[str], residual: str, cross: bool = True) -> DataFrame:
    """Squared residuals on the regressors, their squares and, with ``cross``, their products."""
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:] if cross or a == b]
    more = {f"_p{k}": F.col(a) * F.col(b) for k, (a, b) in enumerate(pairs)}
    return _explained(df.withColumns(more | {"_y": F.col(residual) ** 2}), "_y", [*xs, *more], keys)


def reset(df: DataFrame, keys: list[str], y: str, xs: list[str], powers: int = 3) -> DataFrame:
    """(keys, statistic, df, df_resid, p_value, n): F test of powers 2 to ``powers`` of the fitted values in a second regression."""
    base = ols(df, y, xs, keys)
    rows = predict(df, base, None, xs, keys)
    # powers of the standardised fit span the same space and keep the cross products sound
    spread = rows.groupBy(*keys).agg(F.avg("fitted").alias("_mean"), F.stddev_pop("fitted").alias("_sd"))
    rows = by_group(rows, spread, keys, few_groups(df, keys))
    z = (F.col("fitted") - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))
    rows = rows.withColumn("_z", z).withColumns({f"_f{k}": F.pow("_z", F.lit(k)) for k in range(2, powers + 1)})
    more = [f"_f{k}" for k in range(2, powers + 1)]
    one = base.where("term = 'const'").select(*keys, F.col("r2").alias("_r0"))
    two = ols(rows, y, [*xs, *more], keys).where("term = 'const'").select(*keys, F.col("r2").alias("_r1"), "n", "df_resid")
    joined = one.join(two, keys) if keys else one.join(F.broadcast(two))
    q = len(more)
    stat = (F.col("_r1") - F.col("_r0")) / q / ((1 - F.col("_r1")) / F.col("df_resid"))
    out = joined.select(*keys, stat.alias("statistic"), F.lit(float(q)).alias("df"), F.col("df_resid").cast("double").alias("df_resid"), "n")
    return out.withColumn("p_value", f_sf("statistic", "df", "df_resid"))


# Response surfaces of the unit-root test's critical values (constant, 1/n, 1/n^2, 1/n^3) by trend and level.
CRITICAL = {
    "n": {1: (-2.56574, -2.2358, -3.627, 0.0), 5: (-1.94100, -0.2686, -3.365, 31.223), 10: (-1.61682, 0.2656, -2.714, 25.364)},
    "c": {1: (-3.43035, -6.5393, -16.786, -79.433), 5: (-2.86154, -2.8903, -4.234, -40.040), 10: (-2.56677, -1.5384, -2.809, 0.0)},
    "ct": {1: (-3.95877, -9.0531, -28.428, -134.155), 5: (-3.41049, -4.3904, -9.036, -45.374), 10: (-3.12705, -2.5856, -3.925, -22.380)},
    "ctt": {1: (-4.37113, -11.5882, -35.819, -334.047), 5: (-3.83239, -5.9057, -12.490, -118.284), 10: (-3.55326, -3.6596, -5.293, -63.559)},
}
# Polynomials of the probit p-value in the statistic, below and above a turning point; least and greatest statistics.
P_VALUES = {
    "n": (-1.04, -19.04, float("inf"), (0.6344, 1.2378, 0.032496), (0.4797, 0.93557, -0.06999, 0.033066)),
    "c": (-1.61, -18.83, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    "ct": (-2.89, -16.18, 0.70, (3.2512, 1.6047, 0.049588), (2.5261, 0.61654, -0.37956, -0.060285)),
    "ctt": (-3.21, -17.17, 0.54, (4.0003, 1.658, 0.048288), (3.0778, 0.49529, -0.41477, -0.059359)),
}


def unit_root(df: DataFrame, keys: list[str], order: list[str], value: str, lags: int = 0, trend: str = "c", choose: bool = False) -> DataFrame:
    """(keys, statistic, p_value, lags, n, crit_1, crit_5, crit_10): augmented Dickey-Fuller test with trend n, c, ct or ctt.

    With ``choose``, the number of lags up to ``lags`` of the least AIC on the
    rows that all of them leave. p-values and limits are the published
    approximations for one series.
    """
    w = ordered(keys, order)
    rows = df.withColumns({"_level": F.lag(value).over(w), "_d": F.col(value) - F.lag(value).over(w), "_t": F.row_number().over(w).cast("double")})
    rows = rows.withColumn("_tt", F.col("_t") ** 2).withColumns({f"_d{k}": F.lag("_d", k).over(w) for k in range(1, lags + 1)}).where(F.col("_t") > lags + 1)
    extra = {"n": [], "c": [], "ct": ["_t"], "ctt": ["_t", "_tt"]}[trend]
    if choose:
        out = _least_aic(rows, keys, extra, lags, trend != "n")
    else:
        xs = ["_level", *extra, *[f"_d{k}" for k in range(1, lags + 1)]]
        out = ols(rows, "_d", xs, keys, constant=trend != "n").where("term = '_level'").select(*keys, F.col("t").alias("statistic"), F.lit(lags).alias("lags"), "n")
    turn, low, high, small, large = P_VALUES[trend]
    x = F.col("statistic")
    poly = lambda c: sum((a * x**k for k, a in enumerate(c)), F.lit(0.0))
    p = F.when(x <= low, 0.0).when(x >= high, 1.0).otherwise(normal_cdf(F.when(x <= turn, poly(small)).otherwise(poly(large))))
    limits = [sum((a / F.col("n") ** k for k, a in enumerate(c)), F.lit(0.0)).alias(f"crit_{level}") for level, c in CRITICAL[trend].items()]
    return out.select(*keys, "statistic", p.alias("p_value"), "lags", "n", *limits)


def _least_aic(rows: DataFrame, keys: list[str], extra: list[str], most: int, constant: bool) -> DataFrame:
    """(keys, statistic, lags, n) of the number of lags with the least AIC, all numbers solved from one matrix of cross products a series."""
    columns = ["_level", *extra, *[f"_d{k}" for k in range(1, most + 1)], "_d"]
    g = lag_gram(rows, columns, keys) if constant else gram(rows, columns[-1], columns[:-1], keys)
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.select(*keys).schema)
    m, lead = len(columns) - 1, int(constant)

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                xx, xy, yy = unpack(np.array(r.cells, float), m)
                tries, n = [], int(r.n)
                for p in range(most + 1):
                    k = 1 + len(extra) + p
                    inv = inverse(xx[:k, :k])
                    b = inv @ xy[:k]
                    rss = max(float(yy - b @ xy[:k]), 1e-300)
                    if n > k + lead:
                        t = b[0] / np.sqrt(max(inv[0, 0], 1e-300) * rss / (n - k - lead))
                        tries.append((n * np.log(rss / n) + 2 * (k + lead), p, t))
                if tries:
                    _, p, t = min(tries)
                    out.append((*[getattr(r, c) for c in keys], t, p, n))
            yield pd.DataFrame(out, columns=[*keys, "statistic", "lags", "n"])

    return g.where("n > 0").mapInPandas(run, f"{kinds}statistic double, lags int, n long")


def bds(df: DataFrame, keys: list[str], order: list[str], value: str, dimension: int = 2, epsilon: float = 0.5, block: int = 512, least: int | None = None) -> DataFrame:
    """(keys, dimension, statistic, p_value, c1, cm, n): nearness of runs of ``dimension`` values against what independence gives.

    With ``least``, all dimensions from that one up come from one pass. Two
    values are near within ``epsilon`` deviations; dimension m looks at the
    rows that m - 1 others follow. A series is cut into blocks by value, and
    only blocks whose ranges come near each other meet, each pair in one task;
    runs are followed from the near pairs, so counts of all dimensions come
    from one comparison, and only counts are shuffled on.
    """
    first, most = least or dimension, dimension
    w, group = ordered(keys, order), Window.partitionBy(*keys)
    lead = [F.lead(value, k).over(w) for k in range(most)]
    rows = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(group), "_eps": F.stddev_samp(value).over(group) * epsilon, "_m": F.array(*lead)})
    rows = rows.where(F.col("_i") + first <= F.col("_n")).withColumn("_b", F.floor((F.row_number().over(group.orderBy(value, *order)) - 1) / block).cast("int"))
    spans = rows.groupBy(*keys, "_b").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.first("_eps").alias("eps"))
    side = lambda c: spans.select(*keys, F.col("_b").alias(c), F.col("lo").alias(f"lo_{c}"), F.col("hi").alias(f"hi_{c}"), F.col("eps").alias(f"eps_{c}"))
    met = side("p").join(side("q"), keys).where("p <= q and lo_q - hi_p < eps_p").select(*keys, "p", "q")  # a row a pair of blocks
    both = met.select(*keys, "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("_b"))
    dealt = both.join(rows.select(*keys, "_b", "_i", "_n", "_eps", "_m"), [*keys, "_b"])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    own = [*keys, "p", "q"]

    def count(key, pdf):
        p, q = key[-2], key[-1]
        a, b = pdf[pdf["_b"] == p], pdf[pdf["_b"] == q]
        eps, n, out = pdf["_eps"].iloc[0], int(pdf["_n"].iloc[0]), []
        x, y = (np.array([[np.nan if v is None else v for v in r] for r in t["_m"]], float) for t in (a, b))
        i, j = a["_i"].to_numpy(), b["_i"].to_numpy()
        one = np.abs(x[:, None, 0] - y[None, :, 0]) < eps
        if p == q:
            one &= i[:, None] < j[None, :]
        u, v = np.nonzero(one)
        run = np.ones(len(u), bool)
        for m in range(1, most + 1):
            if m > 1:
                run &= np.abs(x[u, m - 1] - y[v, m - 1]) < eps
            if m >= first:
                fits = (i[u] + m <= n) & (j[v] + m <= n)
                c = np.bincount(u, fits, len(i)), np.bincount(v, fits, len(j))
                r = np.bincount(u, fits & run, len(i)), np.bincount(v, fits & run, len(j))
                out += [pd.DataFrame({"_i": at, "dimension": m, "c": k, "m": h}) for at, k, h in ((i, c[0], r[0]), (j, c[1], r[1]))]
        out = pd.concat(out).groupby(["_i", "dimension"], as_index=False).sum()
        for name, k in zip(keys, key):
            out[name] = k
        out["n"] = n - out["dimension"] + 1
        return out[[*keys, "dimension", "_i", "c", "m", "n"]].astype({"c": "int64", "m": "int64"})

    counted = dealt.groupBy(*own).applyInPandas(count, f"{kinds}, dimension int, _i long, c long, m long, n long")
    each = counted.where("_i < n").groupBy(*keys, "dimension", "_i").agg(F.sum("c").alias("c"), F.sum("m").alias("m"), F.first("n").alias("n"))
    s = each.groupBy(*keys, "dimension").agg(F.first("n").alias("n"), F.sum("c").alias("_c"), F.sum("m").alias("_m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("_k"))
    n = F.col("n")
    s = s.withColumns({"c1": F.col("_c") / (n * (n - 1)), "cm": F.col("_m") / (n * (n - 1)), "_kk": F.col("_k") / (n * (n - 1) * (n - 2))})

    def spread(m: int):
        c, k = F.col("c1"), F.col("_kk")
        var = k**m + 2 * sum((k ** (m - j) * c ** (2 * j) for j in range(1, m)), F.lit(0.0)) + (m - 1) ** 2 * c ** (2 * m) - m**2 * k * c ** (2 * m - 2)
        return F.sqrt(n) * (F.col("cm") - c**m) / F.sqrt(4 * var)

    stat = F.coalesce(*[F.when(F.col("dimension") == m, spread(m)) for m in range(first, most + 1)])
    out = s.withColumn("statistic", stat)
    return out.select(*keys, "dimension", "statistic", (2 * (1 - normal_cdf(F.abs("statistic")))).alias("p_value"), "c1", "cm", "n")


def residual_summary(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, mean, std, min, max, n, jarque_bera, jarque_bera_p, durbin_watson, white, white_p): residuals of every series in one row.

    The deviation is of the population; White's test is on the position along
    the series, its square and a constant.
    """
    x = F.col(value)
    out = df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n"))
    at = df.withColumn("_t", F.row_number().over(ordered(keys, order)).cast("double"))
    parts = {"jarque_bera": jarque_bera(df, keys, value), "durbin_watson": durbin_watson(df, keys, order, value), "white": white(at, keys, ["_t"], value)}
    for name, t in parts.items():
        p = [F.col("p_value").alias(f"{name}_p")] if name != "durbin_watson" else []
        t = t.select(*keys, F.col("statistic").alias(name), *p)
        out = out.join(t, keys, "left") if keys else out.join(F.broadcast(t))
    return out


def residual_suite(df: DataFrame, keys: list[str], order: list[str], value: str, lags: int = 5) -> DataFrame:
    """(keys, test, statistic, p_value): normality, serial correlation, changing variance and stationarity of a series in one report."""
    parts = {
        "jarque_bera": jarque_bera(df, keys, value), "ljung_box": ljung_box(df, keys, order, value, lags),
        "engle_arch": engle_arch(df, keys, order, value, lags), "unit_root": unit_root(df, keys, order, value, 1),
        "durbin_watson": durbin_watson(df, keys, order, value).withColumn("p_value", F.lit(None).cast("double")),
    }
    return reduce(DataFrame.union, [t.select(*keys, F.lit(name).alias("test"), "statistic", "p_value") for name, t in parts.items()])


def goldfeld_quandt(df: DataFrame, keys: list[str], order: list[str], residual: str, drop: float = 0.2) -> DataFrame:
    """(keys, statistic, n): variance of the last rows by ``order`` over that of the first; the middle is left out from 30 rows on."""
    w = Window.partitionBy(*keys)
    s = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    side = F.floor(F.when(F.col("_n") >= 30, F.col("_n") * (1 - drop) / 2).otherwise(F.col("_n") / 2))
    low, high = F.when(F.col("_i") <= side, F.col(residual)), F.when(F.col("_i") > F.col("_n") - side, F.col(residual))
    return s.groupBy(*keys).agg((F.var_samp(high) / F.var_samp(low)).alias("statistic"), F.count("*").alias("n"))
