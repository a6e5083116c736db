"""ARMA models of many series as regressions on lag tables, and vector autoregressions."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import t_cdf
from .affine import affine_scan, lags
from .regress import centred, inverse, ols, predict, unpack
from .series import ordered, scan


def _lagged(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, int]) -> DataFrame:
    """Rows with ``column_k`` for each lag; all windows share one sort."""
    w = ordered(keys, order)
    return df.withColumns({f"{c}_{k}": F.lag(c, k).over(w) for c, n in columns.items() for k in range(1, n + 1)})


def residual_table(df: DataFrame, keys: list[str], order: list[str], value: str, long_ar: int, exog: list[str] | None = None) -> DataFrame:
    """Rows with ``_y`` and ``_e``, the residual of a long autoregression of the series (null in its first rows)."""
    exog = exog or []
    lags = _lagged(df.withColumn("_y", F.col(value).cast("double")), keys, order, {"_y": long_ar})
    xs = [*[f"_y_{k}" for k in range(1, long_ar + 1)], *exog]
    return predict(lags, ols(lags, "_y", xs, keys), "_y", xs, keys).withColumnRenamed("residual", "_e").drop("fitted", *[f"_y_{k}" for k in range(1, long_ar + 1)])


def fit_arma(df: DataFrame, keys: list[str], order: list[str], value: str, p: int, q: int = 0, long_ar: int | None = None, exog: list[str] | None = None, rows: DataFrame | None = None, skip: int = 0) -> DataFrame:
    """(keys, const, ar, ma, exog, sigma2, n, loglik, aic, bic, hqic, aicc): Hannan-Rissanen estimates of every series.

    Residuals of a long autoregression stand in for the shocks, then one
    regression on lags of both. ``exog`` columns enter both. The likelihood is
    the regression's own; sigma2 divides by n. ``skip`` leaves out the first
    rows of each series, so that orders are compared on the same rows.
    """
    exog = exog or []
    long_ar = long_ar or max(p + q, 2 * max(p, q), 1)
    if rows is None:
        rows = residual_table(df, keys, order, value, long_ar, exog) if q else df.withColumn("_y", F.col(value).cast("double"))
    lags = _lagged(rows, keys, order, {"_y": p} | ({"_e": q} if q else {}))
    if skip:
        lags = lags.withColumn("_pos", F.row_number().over(ordered(keys, order))).where(F.col("_pos") > skip)
    ys, es = [f"_y_{k}" for k in range(1, p + 1)], [f"_e_{k}" for k in range(1, q + 1)]
    fit = ols(lags, "_y", [*ys, *es, *exog], keys)
    coef = lambda names: F.array(*[F.max(F.when(F.col("term") == c, F.col("coef"))) for c in names]).cast("array<double>")
    wide = fit.groupBy(*keys).agg(F.max(F.when(F.col("term") == "const", F.col("coef"))).alias("const"), coef(ys).alias("ar"), coef(es).alias("ma"), coef(exog).alias("exog"), F.first("aic").alias("_aic"), F.first("n").alias("n"))
    k = 1 + p + q + len(exog)
    wide = wide.withColumn("loglik", k - F.col("_aic") / 2)
    wide = wide.withColumn("sigma2", F.exp(-2 * F.col("loglik") / F.col("n") - 1) / (2 * math.pi))
    return wide.select(*keys, "const", "ar", "ma", "exog", "sigma2", "n", "loglik", *[c.alias(m) for m, c in criteria(F.col("loglik"), k, F.col("n")).items()])


def criteria(loglik: Column, k: int | Column, n: Column) -> dict[str, Column]:
    """aic, bic, hqic and aicc of k parameters and n rows."""
    aic = 2 * k - 2 * loglik
    return {"aic": aic, "bic": k * F.log(n) - 2 * loglik, "hqic": 2 * k * F.log(F.log(n)) - 2 * loglik, "aicc": aic + F.lit(2 * k * (k + 1)) / F.nullif(n - k - 1, F.lit(0))}


def lag_gram(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, n, means, cells): one row a key with the cross products of deviations, from which any sub-regression is solved."""
    sums = F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in combinations_with_replacement(columns, 2)])
    return centred(rows, columns, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.first("_means").alias("means"), sums.alias("cells"))


def choose_order(df: DataFrame, keys: list[str], order: list[str], value: str, max_p: int, max_q: int, criterion: str = "aic", exog: list[str] | None = None) -> DataFrame:
    """(keys, p, q, criterion): the orders of the least criterion for each series, all tried on the same rows; the smaller p, then q, among equals.

    The lag table of the highest orders is read once for one matrix of cross
    products a series; every pair of orders is a sub-matrix of it, solved where
    that row is, so the cost in data doesn't grow with the number of orders.
    """
    exog = exog or []
    long_ar = max(max_p + max_q, 1)
    rows = residual_table(df, keys, order, value, long_ar, exog)
    table = _lagged(rows, keys, order, {"_y": max_p} | ({"_e": max_q} if max_q else {}))
    table = table.withColumn("_pos", F.row_number().over(ordered(keys, order))).where(F.col("_pos") > long_ar + max(max_p, max_q))
    ys, es = [f"_y_{k}" for k in range(1, max_p + 1)], [f"_e_{k}" for k in range(1, max_q + 1)]
    columns = [*exog, *ys, *es, "_y"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    m = len(columns) - 1

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                xx, xy, yy = unpack(np.array(r.cells, float), m)
                tries = []
                for p in range(max_p + 1):
                    for q in range(max_q + 1):
                        if p + q:
                            at = [*range(len(exog)), *range(len(exog), len(exog) + p), *range(len(exog) + max_p, len(exog) + max_p + q)]
                            rss = max(float(yy - xy[at] @ inverse(xx[np.ix_(at, at)]) @ xy[at]), 1e-300)
                            k, n = 1 + len(at), int(r.n)
                            like = -n / 2 * (math.log(2 * math.pi * rss / n) + 1)
                            score = {"aic": 2 * k - 2 * like, "bic": k * math.log(n) - 2 * like, "hqic": 2 * k * math.log(math.log(n)) - 2 * like if n > 1 else math.nan}
                            score["aicc"] = score["aic"] + 2 * k * (k + 1) / (n - k - 1) if n > k + 1 else math.nan
                            if not math.isnan(score[criterion]):
                                tries.append((score[criterion], p, q))
                if tries:
                    best = min(tries)
                    out.append((*[getattr(r, c) for c in keys], best[1], best[2], best[0]))
            yield pd.DataFrame(out, columns=[*keys, "p", "q", criterion])

    return lag_gram(table, columns, keys).where("n > 0").mapInPandas(run, f"{kinds}, p int, q int, {criterion} double")


def arma_residuals(df: DataFrame, keys: list[str], order: list[str], value: str, params: DataFrame, exog: list[str] | None = None, chunk: Column | None = None) -> DataFrame:
    """Rows with ``residual`` by a table (keys, const, ar, ma[, exog]) of parameters, from zero shocks; the first rows, short of lags, have 0.

    With one shock or none the residuals are an affine scan, which ``chunk``
    (see ``affine``; values must then not be null) cuts for few very long
    series; with more, one pass in order holds the last values and shocks only.
    A row with a null value keeps the state and gets null.
    """
    exog = exog or []
    joined = df.join(params.select(*keys, F.col("const").alias("_c"), F.col("ar").alias("_ar"), F.col("ma").alias("_ma"), *([F.col("exog").alias("_ex")] if exog else [])), keys)
    p, q = (params.select(F.max(F.array_size(c)).alias("n")).first()["n"] or 0 for c in ("ar", "ma"))
    mean = F.col("_c") + sum((F.col("_ex")[k] * F.col(x) for k, x in enumerate(exog)), F.lit(0.0))
    ar, ma = ([F.coalesce(F.get(c, F.lit(k)), F.lit(0.0)) for k in range(n)] for c, n in (("_ar", p), ("_ma", q)))
    y = F.col(value)
    if q <= 1:
        rows = joined.withColumn("_y", y.cast("double"))
        if chunk is not None:
            rows = lags(rows, keys, order, "_y", p, chunk)
        elif p:
            over = f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY {', '.join(f'`{o}`' for o in order)})"
            rows = rows.withColumns({f"_y_{k}": F.expr(f"lag(_y, {k}) IGNORE NULLS {over}") for k in range(1, p + 1)})
        short = F.col(f"_y_{p}").isNull() if p else F.lit(False)
        push = y - mean - sum((w * F.coalesce(F.col(f"_y_{k}"), F.lit(0.0)) for k, w in enumerate(ar, 1)), F.lit(0.0))
        b = F.when(short, 0.0).otherwise(-ma[0] if q else 0.0)
        return affine_scan(rows, keys, order, {"residual": (b, F.when(y.isNotNull() & short, 0.0).otherwise(push), 0.0)}, chunk=chunk).select(*df.columns, "residual")
    if chunk is not None:
        raise ValueError("only models of one shock or none can be cut into chunks")

    def step(s, y, m, *weights):
        past, shocks = ([], []) if s is None else s
        if len(past) < p:
            e = 0.0
        else:
            e = y - m - sum(w * v for w, v in zip(weights[:p], past)) - sum(w * v for w, v in zip(weights[p:], shocks))
        return ([y, *past][:p], [e, *shocks][:q]), e

    return scan(joined, keys, order, [y, mean, *ar, *ma], step, "residual").select(*df.columns, "residual")


def forecast(residuals: DataFrame, keys: list[str], order: list[str], value: str, params: DataFrame, horizon: int, exog: list[str] | None = None, future: DataFrame | None = None) -> DataFrame:
    """(keys, h, mean, var) from each series' last values and residuals; the variance sums squared psi weights times sigma2.

    With ``exog``, ``future`` (keys, h, exog columns) has the values of those
    columns 1, 2, ... steps ahead; they meet each series' last state in one
    join, and a forecast stops before the first step whose values are missing.
    """
    exog = exog or []
    if exog and future is None:
        raise ValueError("exogenous columns need their future values")
    p, q = (params.select(F.max(F.array_size(c)).alias("n")).first()["n"] or 0 for c in ("ar", "ma"))
    keep = max(p, q, 1)
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    last = residuals.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= keep)
    last = last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", F.col(value).cast("double").alias("y"), F.col("residual").alias("e")))).alias("last"))
    state = params.join(last, keys)
    if exog:
        known = future.where(F.col("h").between(1, horizon)).dropna(subset=exog)
        ahead = known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("h", F.array(*[F.col(x).cast("double") for x in exog]).alias("x")))).alias("_ahead"))
        state = state.join(ahead, keys)
    else:
        state = state.withColumns({"exog": F.array().cast("array<double>"), "_ahead": F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.struct(h.alias("h"), F.array().cast("array<double>").alias("x")))})
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in params.select(*keys).schema)

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                ar, ma, ex = np.asarray(r.ar, float), np.asarray(r.ma, float), np.asarray(r.exog, float)
                ys, es = [x["y"] for x in r.last][::-1], [x["e"] for x in r.last][::-1]
                psi, var = [1.0], 0.0
                for h, step in enumerate(r.ahead, 1):
                    if step["h"] != h:
                        break
                    y = r.const + float(ex @ np.asarray(step["x"], float)) + sum(a * ys[-1 - k] for k, a in enumerate(ar) if k < len(ys)) + sum(m * es[-1 - k] for k, m in enumerate(ma) if k < len(es))
                    ys.append(y)
                    es.append(0.0)
                    var += psi[h - 1] ** 2
                    psi.append((ma[h - 1] if h <= len(ma) else 0.0) + sum(a * psi[h - 1 - k] for k, a in enumerate(ar) if h - 1 - k >= 0))
                    out.append((*[getattr(r, c) for c in keys], h, y, r.sigma2 * var))
            yield pd.DataFrame(out, columns=[*keys, "h", "mean", "var"])

    return state.select(*keys, "const", "ar", "ma", "exog", "sigma2", "last", F.col("_ahead").alias("ahead")).mapInPandas(run, f"{kinds}, h int, mean double, var double")


def roots_outside(weights: Column) -> Column:
    """Whether 1 - w1 z - w2 z^2 ... has all roots outside the unit circle: every reflection coefficient of the step-down is inside (-1, 1)."""

    def down(s, _):
        top = F.element_at(s["w"], -1)
        rest = F.slice(s["w"], 1, F.array_size(s["w"]) - 1)
        lower = F.zip_with(rest, F.reverse(rest), lambda a, b: (a + top * b) / F.nullif(1 - top * top, F.lit(0.0)))
        return F.struct(F.when(F.abs(top) < 1, lower).otherwise(F.array().cast("array<double>")).alias("w"), (s["ok"] & (F.abs(top) < 1)).alias("ok"))

    move = lambda s, x: F.when(F.array_size(s["w"]) > 0, down(s, x)).otherwise(s)
    return F.aggregate(weights, F.struct(weights.cast("array<double>").alias("w"), F.lit(True).alias("ok")), move, lambda s: s["ok"])


def stability(params: DataFrame) -> DataFrame:
    """``params`` (ar, ma) with ``stationary`` and ``invertible``."""
    return params.withColumns({"stationary": roots_outside(F.col("ar")), "invertible": roots_outside(F.transform("ma", lambda v: -v))})


def _var_gram(panel: DataFrame, names: list[str], count: int, key: str, ts: str, value: str, system: str | None) -> DataFrame:
    """(system, n, means, cells) of lags and values of ``names`` at the times that all of them have, in one pass over every system."""
    own = F.col(system) if system else F.lit(0)
    wide = panel.where(F.col(key).isin(names)).groupBy(own.alias("system"), F.col(ts).alias("_ts")).pivot(key, names).agg(F.first(value)).dropna(subset=names)
    wide = wide.select("system", "_ts", F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("_v"))
    w = Window.partitionBy("system").orderBy("_ts")
    late = wide.withColumns({f"_l{j}": F.lag("_v", j).over(w) for j in range(1, count + 1)}).where(F.col(f"_l{count}").isNotNull())
    xs = {f"x{j}_{k}": F.col(f"_l{j}")[k] for j in range(1, count + 1) for k in range(len(names))}
    ys = {f"y{k}": F.col("_v")[k] for k in range(len(names))}
    return lag_gram(late.select("system", *[c.alias(n) for n, c in {**xs, **ys}.items()]), [*xs, *ys], ["system"])


def _var_solved(r, lag_terms: int, k: int):
    """(b, inverse, means, residual products, n) of one system's cross products."""
    g = np.zeros((lag_terms + k, lag_terms + k))
    g[np.triu_indices(lag_terms + k)] = np.array(r.cells, float)
    g = g + np.triu(g, 1).T
    inv = inverse(g[:lag_terms, :lag_terms])
    b = inv @ g[:lag_terms, lag_terms:]
    return b, inv, np.array(r.means, float), g[lag_terms:, lag_terms:] - g[:lag_terms, lag_terms:].T @ b, g[lag_terms:, lag_terms:], int(r.n)


def var_fit(panel: DataFrame, names: list[str], lags: int, key: str = "asset", ts: str = "ts", value: str = "value", system: str | None = None) -> DataFrame:
    """([system,] equation, term, coef, se, t, p, r2, n): vector autoregressions of a fixed list of series on their common times.

    Terms are const and name_k. With ``system``, every value of that column is
    a system of its own; all of them and all equations share one lag table and
    one matrix of cross products a system.
    """
    k, m = len(names), lags * len(names)
    terms = ["const", *[f"{n}_{j}" for j in range(1, lags + 1) for n in names]]
    g = _var_gram(panel, names, lags, key, ts, value, system)
    kind = g.schema["system"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                b, inv, means, left, total, n = _var_solved(r, m, k)
                df_r = n - m - 1
                var = np.r_[1 / n + means[:m] @ inv @ means[:m], np.diag(inv)]
                for e, name in enumerate(names):
                    coef = np.r_[means[m + e] - means[:m] @ b[:, e], b[:, e]]
                    s2 = max(left[e, e], 0.0) / df_r if df_r > 0 else np.nan
                    with np.errstate(divide="ignore", invalid="ignore"):
                        se = np.sqrt(np.maximum(var * s2, 0))
                        t = coef / se
                        r2 = 1 - left[e, e] / total[e, e]
                    yield pd.DataFrame({"system": [r.system] * (m + 1), "equation": name, "term": terms, "coef": coef, "se": se, "t": t, "p": 2 * (1 - t_cdf(np.abs(t), max(df_r, 1))), "r2": r2, "n": n})

    out = g.mapInPandas(run, f"system {kind}, equation string, term string, coef double, se double, t double, p double, r2 double, n long")
    return out.withColumnRenamed("system", system) if system else out.drop("system")


def var_covariance(panel: DataFrame, names: list[str], lags: int, key: str = "asset", ts: str = "ts", value: str = "value", system: str | None = None) -> DataFrame:
    """([system,] i, j, cov) for i <= j in the order of ``names``: covariances of the residuals of ``var_fit``, by its degrees of freedom."""
    k, m = len(names), lags * len(names)
    g = _var_gram(panel, names, lags, key, ts, value, system)
    kind = g.schema["system"].dataType.simpleString()
    i, j = np.triu_indices(k)

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                *_, left, _, n = _var_solved(r, m, k)
                yield pd.DataFrame({"system": r.system, "i": [names[a] for a in i], "j": [names[a] for a in j], "cov": left[i, j] / (n - m - 1) if n > m + 1 else np.nan})

    out = g.mapInPandas(run, f"system {kind}, i string, j string, cov double")
    return out.withColumnRenamed("system", system) if system else out.drop("system")


def var_responses(fit: DataFrame, names: list[str], lags: int, horizon: int, covariance: np.ndarray) -> DataFrame:
    """(response, shock, h, irf, fevd): orthogonalised impulse responses and shares of forecast-error variance up to ``horizon``.

    ``fit`` is a table of ``var_fit``, a row a coefficient; ``covariance`` that
    of its residuals. Shocks are ordered as ``names`` are.
    """
    rows, at, k = fit.collect(), {n: i for i, n in enumerate(names)}, len(names)
    a = np.zeros((lags, k, k))
    for r in rows:
        if r["term"] != "const":
            name, _, j = r["term"].rpartition("_")
            a[int(j) - 1, at[r["equation"]], at[name]] = r["coef"]
    root, phi = np.linalg.cholesky(covariance), [np.eye(k)]
    for h in range(1, horizon + 1):
        phi.append(sum(a[j - 1] @ phi[h - j] for j in range(1, min(h, lags) + 1)))
    irf = np.array([m @ root for m in phi])
    total = np.cumsum(irf**2, axis=0)
    share = total / total.sum(2, keepdims=True)
    out = [(names[i], names[j], h, float(irf[h, i, j]), float(share[h, i, j])) for h in range(horizon + 1) for i in range(k) for j in range(k)]
    return fit.sparkSession.createDataFrame(out, "response string, shock string, h int, irf double, fevd double")
