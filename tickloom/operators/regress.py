"""Regression from one pass of cross products, and principal components."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import beta_i, t_cdf

OLS = "term string, coef double, se double, t double, p double, r2 double, adj_r2 double, f double, f_p double, aic double, bic double, n long, df_resid long"


def gram(df: DataFrame, y: str, xs: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, n, cells array): sums of products of (xs, y), upper triangle by rows; a constant is a column like others."""
    cols = [F.lit(1.0) if c == "const" else F.col(c).cast("double") for c in [*xs, y]]
    ok = df.dropna(subset=[c for c in [*xs, y] if c != "const"])
    sums = [F.sum(a * b) for a, b in combinations_with_replacement(cols, 2)]
    return ok.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.array(*sums).alias("cells"))


#: Tables of up to so many groups are sent to every task.
FEW = 100_000


def few_groups(df: DataFrame, keys: list[str]) -> bool:
    """Whether a table of a row a group is small, found by one small job; without keys it is one row."""
    return not keys or df.select(*keys).distinct().limit(FEW + 1).count() <= FEW


def by_group(rows: DataFrame, table: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """``rows`` with the row of ``table`` for their group; where groups are few they may be large, and no row is moved."""
    table = F.broadcast(table) if few else table
    return rows.join(table, keys) if keys else rows.join(table)


def moments(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, n, means array, cells array) of the rows without nulls in ``columns``: cells are sums of products of deviations, upper triangle by rows.

    One pass, whose running means and co-moments don't cancel and merge by group.
    """
    ok = df.dropna(subset=columns)
    products = [F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")) * F.count("*") for a, b in combinations_with_replacement(columns, 2)]
    return ok.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.avg(F.col(c).cast("double")) for c in columns]).alias("means"), F.array(*products).alias("cells"))


def centred(df: DataFrame, columns: list[str], keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows without nulls in ``columns``, these made deviations from their group's means, which stand in ``_means``; other columns to ``keep`` stay."""
    ok = df.dropna(subset=columns).select(*keys, *keep, *[F.col(c).cast("double").alias(c) for c in columns])
    means = ok.groupBy(*keys).agg(F.array(*[F.avg(c) for c in columns]).alias("_means"))
    rows = by_group(ok, means, keys, few_groups(df, keys))
    return rows.select(*keys, *keep, "_means", *[(F.col(c) - F.col("_means")[k]).alias(c) for k, c in enumerate(columns)])


def inverse(m: np.ndarray) -> np.ndarray:
    """A pseudo-inverse that doesn't depend on the units of rows."""
    scale = np.sqrt(np.maximum(np.diag(m), 1e-300))
    return np.linalg.pinv(m / np.outer(scale, scale), hermitian=True) / np.outer(scale, scale) if len(m) else m


def unpack(cells: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(X'X, X'y, y'y)."""
    g = np.zeros((k + 1, k + 1))
    g[np.triu_indices(k + 1)] = cells
    g = g + np.triu(g, 1).T
    return g[:k, :k], g[:k, k], g[k, k]


def ols(df: DataFrame, y: str, xs: list[str], keys: list[str] | None = None, constant: bool = True) -> DataFrame:
    """Least squares for each group, or the whole table: a row for each term (const first) with errors and fit statistics.

    One pass takes the means and the cross products of deviations from them,
    which don't cancel however large the means are; only those, one row a group,
    meet the small solver, which uses a pseudo-inverse for collinear terms.
    Without a constant, products are of the values and r2 is uncentred.
    """
    keys, terms = keys or [], ["const", *xs] if constant else list(xs)
    columns = [*xs, y]
    if constant:
        g = moments(df, columns, keys)
    else:
        g = gram(df, y, list(xs), keys).select(*keys, "n", F.array(*[F.lit(0.0)] * len(columns)).alias("means"), "cells")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in g.select(*keys).schema), OLS])

    def solve(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                k, n, means = len(terms), int(r.n), np.array(r.means, float)
                if not n:
                    continue
                xx, xy, yy = unpack(np.array(r.cells, float), len(xs))
                inv = inverse(xx)
                b = inv @ xy
                tss = float(yy)
                rss = max(float(yy - b @ xy), 0.0)
                lead = 1 if constant else 0
                df_r = n - k
                s2 = rss / df_r if df_r > 0 else np.nan
                var = np.diag(inv)
                if constant:
                    var = np.r_[1 / n + means[:-1] @ inv @ means[:-1], var]
                    b = np.r_[means[-1] - b @ means[:-1], b]
                se = np.sqrt(np.maximum(var * s2, 0))
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = b / se
                    r2 = 1 - rss / tss if tss > 0 else np.nan
                    f = (tss - rss) / (k - lead) / s2 if k > lead else np.nan
                p = 2 * (1 - t_cdf(np.abs(t), max(df_r, 1)))
                fp = float(beta_i(df_r / 2, (k - lead) / 2, df_r / (df_r + (k - lead) * f))) if k > lead and np.isfinite(f) else np.nan
                like = -n / 2 * (np.log(2 * np.pi * max(rss, 1e-300) / n) + 1)
                yield pd.DataFrame({c: [getattr(r, c)] * k for c in keys} | {"term": terms, "coef": b, "se": se, "t": t, "p": p, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - lead) / df_r if df_r > 0 else np.nan, "f": f, "f_p": fp, "aic": 2 * k - 2 * like, "bic": k * np.log(n) - 2 * like, "n": n, "df_resid": df_r})

    return g.mapInPandas(solve, schema)


def predict(df: DataFrame, coefficients: DataFrame, y: str | None, xs: list[str], keys: list[str] | None = None) -> DataFrame:
    """``fitted`` (and ``residual``) by a table of (keys, term, coef); without a const term it counts as 0."""
    keys = keys or []
    wide = coefficients.groupBy(*keys).pivot("term", ["const", *xs]).agg(F.first("coef"))
    wide = wide.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in ["const", *xs]])
    out = by_group(df, wide, keys, few_groups(df, keys))
    fitted = sum((F.col(c) * F.col(f"_b_{c}") for c in xs), F.coalesce(F.col("_b_const"), F.lit(0.0)))
    out = out.withColumn("fitted", fitted)
    return (out.withColumn("residual", F.col(y) - F.col("fitted")) if y else out).drop(*[f"_b_{c}" for c in ["const", *xs]])


AXES = "component int, eigenvalue double, ratio_total double, ratio_retained double, loadings array<double>, means array<double>, scales array<double>"


def pca(df: DataFrame, columns: list[str], components: int, standardize: bool = False) -> DataFrame:
    """(component, eigenvalue, ratio_total, ratio_retained, loadings, means, scales): principal axes of a columns x columns matrix made in the cluster.

    The largest loading of an axis, by absolute value, is positive. ``means``
    and ``scales`` are what rows are centred and divided by before they meet
    an axis; scales are 1 unless ``standardize``.
    """
    from .describe import covariance

    rows = covariance(df, columns).collect()  # one row a pair of columns
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    at = {c: k for k, c in enumerate(columns)}
    m, scales = np.zeros((len(columns), len(columns))), np.ones(len(columns))
    for r in rows:
        m[at[r["i"]], at[r["j"]]] = m[at[r["j"]], at[r["i"]]] = r["corr" if standardize else "cov"]
        if standardize and r["i"] == r["j"] and r["cov"] > 0:
            scales[at[r["i"]]] = np.sqrt(r["cov"])
    values, vectors = np.linalg.eigh(m)
    out = []
    for k in range(components):
        v = vectors[:, -1 - k]
        v = v * np.sign(v[np.abs(v).argmax()])
        out.append((k + 1, float(values[-1 - k]), float(values[-1 - k] / values.sum()), float(values[-1 - k] / values[-components:].sum()), v.tolist(), [float(means[c]) for c in columns], scales.tolist()))
    return df.sparkSession.createDataFrame(out, AXES)


def project(df: DataFrame, axes: DataFrame, columns: list[str]) -> DataFrame:
    """``pc_1``...: rows, centred and scaled as ``pca`` had them, along its axes, as plain column expressions; ``df`` may be other rows."""
    for r in sorted(axes.collect(), key=lambda r: r["component"]):
        terms = ((F.col(c) - m) * (w / s) for w, c, m, s in zip(r["loadings"], columns, r["means"], r["scales"], strict=True))
        df = df.withColumn(f"pc_{r['component']}", sum(terms, F.lit(0.0)))
    return df


def unproject(df: DataFrame, axes: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` rebuilt from ``pc_1``... and the means and scales of the axes; all components give the rows back."""
    rows = sorted(axes.collect(), key=lambda r: r["component"])
    return df.withColumns({c: sum((F.col(f"pc_{r['component']}") * (r["loadings"][k] * r["scales"][k]) for r in rows), F.lit(rows[0]["means"][k])) for k, c in enumerate(columns)})


def robust_errors(df: DataFrame, y: str, xs: list[str], keys: list[str] | None = None, kind: str = "HC1") -> DataFrame:
    """(keys, term, coef, se): least squares with errors HC0 to HC3, which let the variance differ by row.

    All is done on deviations from the group's means, which don't cancel; the
    constant's error comes from those at the end. The second pass weighs every
    row's cross products by its squared residual; rows with a null are left
    out; a leverage of one gives no HC2 or HC3 error.
    """
    keys, terms = keys or [], ["const", *xs]
    k, columns = len(xs), [*xs, y]
    names = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema), ""])
    cells = moments(df, columns, keys)

    def solve(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if not r.n:
                    continue
                xx, xy, _ = unpack(np.array(r.cells, float), k)
                inv = inverse(xx)
                yield pd.DataFrame({c: [getattr(r, c)] for c in keys} | {"inv": [inv.ravel().tolist()], "b": [(inv @ xy).tolist()], "n": [int(r.n)], "means": [list(r.means)]})

    fit = cells.mapInPandas(solve, names + "inv array<double>, b array<double>, n long, means array<double>").select(*keys, F.struct("inv", "b", "n", "means").alias("_fit"))
    rows = by_group(df.dropna(subset=columns).select(*keys, *columns), fit, keys, few_groups(df, keys))
    rows = rows.withColumns({c: F.col(c).cast("double") - F.col("_fit.means")[j] for j, c in enumerate(columns)})
    x = [F.lit(1.0), *[F.col(c) for c in xs]]
    fitted = sum((F.col("_fit.b")[i] * F.col(c) for i, c in enumerate(xs)), F.lit(0.0))
    lever = sum((F.col("_fit.inv")[i * k + j] * F.col(xs[i]) * F.col(xs[j]) for i in range(k) for j in range(k)), 1 / F.col("_fit.n"))
    room = {"HC0": F.lit(1.0), "HC1": (F.col("_fit.n") - k - 1) / F.col("_fit.n"), "HC2": 1 - lever, "HC3": (1 - lever) ** 2}[kind]
    rows = rows.withColumn("_w", (F.col(y) - fitted) ** 2 / F.nullif(room, F.lit(0.0)))
    meat = F.array(*[F.sum(F.col("_w") * a * b) for a, b in combinations_with_replacement(x, 2)])
    rows = rows.groupBy(*keys).agg(meat.alias("cells"))
    rows = (rows.join(fit, keys) if keys else rows.join(F.broadcast(fit))).select(*keys, "cells", "_fit.*")  # a row a group

    def sandwich(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if r.inv is None:
                    continue
                means, b, m, bread, turn = np.array(r.means, float), np.array(r.b, float), np.zeros((k + 1, k + 1)), np.zeros((k + 1, k + 1)), np.eye(k + 1)
                m[np.triu_indices(k + 1)] = np.array(r.cells, float)
                bread[0, 0], bread[1:, 1:], turn[0, 1:] = 1 / r.n, np.array(r.inv, float).reshape(k, k), -means[:k]
                v = turn @ bread @ (m + np.triu(m, 1).T) @ bread @ turn.T
                yield pd.DataFrame({c: [getattr(r, c)] * (k + 1) for c in keys} | {"term": terms, "coef": np.r_[means[k] - b @ means[:k], b], "se": np.sqrt(np.maximum(np.diag(v), 0))})

    return rows.mapInPandas(sandwich, names + "term string, coef double, se double")


def k_fold(df: DataFrame, y: str, xs: list[str], row_id: str, folds: int = 5) -> DataFrame:
    """(fold, n, mse): each fold's squared error under the line fitted on the others.

    A row's fold is its id modulo ``folds``. Cross products are of deviations
    from the whole table's means, taken in the pass before; a fold's are taken
    from the total's, so the small table of folds is all that is solved.
    """
    terms = ["const", *xs]
    k = len(terms)
    rows = centred(df.withColumn("fold", F.pmod(F.col(row_id), F.lit(folds)).cast("int")), [*xs, y], [], ("fold",))
    cells = gram(rows, y, terms, ["fold"])

    def score(key, pdf):
        parts = np.array(pdf["cells"].tolist(), float)
        out = []
        for fold, n, own in zip(pdf["fold"], pdf["n"], parts, strict=True):
            xx, xy, _ = unpack(parts.sum(0) - own, k)
            b = inverse(xx) @ xy
            xx, xy, yy = unpack(own, k)
            out.append((fold, n, (yy - 2 * b @ xy + b @ xx @ b) / n))
        return pd.DataFrame(out, columns=["fold", "n", "mse"])

    return cells.groupBy().applyInPandas(score, "fold int, n long, mse double")  # as many rows as folds
