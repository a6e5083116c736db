"""Covariance paths of many assets: constant and dynamic correlations, BEKK, and their likelihoods."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import dealt
from .affine import affine_scan
from .align import pairs


def standardized_pairs(path: DataFrame, asset: str = "asset", ts: str = "ts", ret: str = "ret") -> DataFrame:
    """(ts, i, j, zz, sd_i, sd_j) for i <= j at common times: products of returns over their deviations."""
    z = path.select(F.col(asset).alias("asset"), F.col(ts).alias("ts"), (F.col(ret) / F.sqrt("var")).alias("z"), F.sqrt("var").alias("sd"))
    p = pairs(z, "asset", "ts", ("z", "sd"))
    return p.select("ts", "i", "j", (F.col("z_i") * F.col("z_j")).alias("zz"), "sd_i", "sd_j")


def dynamic_paths(zz: DataFrame, weights: list[tuple[float, float]], chunk: Column | None = None) -> DataFrame:
    """``zz`` with ``q`` and its mirror columns: q_0, q_1, ... for every (a, b) of ``weights``, all carried in one affine scan.

    Each pair is a scalar recursion of its own, q = (1-a-b) mean + a zz + b q,
    from its mean. ``chunk`` cuts few very long pairs (see ``affine``).
    """
    m = F.col("_level")
    paths = {f"q_{k}": (b, (1 - a - b) * m + a * F.col("zz"), m) for k, (a, b) in enumerate(weights)}
    return affine_scan(zz, ["i", "j"], ["ts"], paths, {"_level": F.avg("zz")}, chunk, before=True)


def dynamic_correlation(zz: DataFrame, a: float, b: float, chunk: Column | None = None) -> DataFrame:
    """(ts, i, j, q, corr, cov): correlations that follow products of standardised returns, given (a, b).

    A correlation is its q over the roots of the two diagonal ones of that time.
    """
    q = dynamic_paths(zz, [(a, b)], chunk).withColumnRenamed("q_0", "q")
    own = q.where("i = j")
    side = lambda c: own.select("ts", F.col("i").alias(c), F.col("q").alias(f"_q{c}"))
    both = q.join(side("i"), ["ts", "i"]).join(side("j"), ["ts", "j"])
    corr = F.col("q") / F.sqrt(F.col("_qi") * F.col("_qj"))
    return both.select("ts", "i", "j", "q", corr.alias("corr"), (corr * F.col("sd_i") * F.col("sd_j")).alias("cov"))


def composite_likelihood(zz: DataFrame, path: DataFrame) -> DataFrame:
    """(loglik, n): the second stage's bivariate normal terms summed over all pairs and times, less those of independence."""
    z = zz.select("ts", "i", "j", "zz")
    own = lambda c: z.where("i = j").select("ts", F.col("i").alias(c), F.col("zz").alias(f"_z{c}"))
    p = z.where("i < j").join(path.select("ts", "i", "j", F.col("corr").alias("r")), ["ts", "i", "j"]).join(own("i"), ["ts", "i"]).join(own("j"), ["ts", "j"])
    free = 1 - F.col("r") ** 2
    form = (F.col("_zi") + F.col("_zj") - 2 * F.col("r") * F.col("zz")) / free
    return p.agg(F.sum(-0.5 * (F.log(free) + form - F.col("_zi") - F.col("_zj"))).alias("loglik"), F.count("*").alias("n"))


def _admissible(grid: list[tuple[float, float]]) -> list[tuple[float, float]]:
    return [(float(a), float(b)) for a, b in grid if a >= 0 and b >= 0 and a + b < 1]


SCORES = "a double, b double, loglik double, n long"


def fit_dynamic_correlation(zz: DataFrame, grid: list[tuple[float, float]], full: bool = False) -> DataFrame:
    """(a, b, loglik, n) of every candidate with a + b < 1, likeliest first: second-stage likelihoods less those of independence.

    All candidates are carried in one pass and scored in one more: pair by
    pair (composite), where n counts pairs and times, or ``full`` over the
    correlation matrix of each time, for few assets, where n counts times that
    have all assets. A candidate under which some correlation reaches one, or
    some matrix is not positive definite, has no likelihood and comes last; a
    grid without an admissible candidate gives no rows.
    """
    weights = _admissible(grid)
    if not weights:
        return zz.sparkSession.createDataFrame([], SCORES)
    q = dynamic_paths(zz, weights)
    k = len(weights)
    numbers = F.array(*[F.col(f"q_{c}") for c in range(k)])
    scored = _matrix_terms(q, numbers, k) if full else _pair_terms(q, numbers, k)
    table = F.explode(F.arrays_zip(F.lit([a for a, _ in weights]).alias("a"), F.lit([b for _, b in weights]).alias("b"), F.col("_ll").alias("loglik")))
    return scored.select(table.alias("x"), "n").select("x.a", "x.b", "x.loglik", "n").orderBy(F.desc_nulls_last("loglik"), "a", "b")


def _pair_terms(q: DataFrame, numbers: Column, k: int) -> DataFrame:
    """(_ll array, n): bivariate terms of all pairs and times, a sum for each candidate."""
    q = q.select("ts", "i", "j", "zz", numbers.alias("_q"))
    own = lambda c: q.where("i = j").select("ts", F.col("i").alias(c), F.col("zz").alias(f"_z{c}"), F.col("_q").alias(f"_q{c}"))
    p = q.where("i < j").join(own("i"), ["ts", "i"]).join(own("j"), ["ts", "j"])

    def term(c: int) -> Column:
        r = F.col("_q")[c] / F.sqrt(F.col("_qi")[c] * F.col("_qj")[c])
        free = 1 - r * r
        total = F.sum(-0.5 * (F.log(free) + (F.col("_zi") + F.col("_zj") - 2 * r * F.col("zz")) / free - F.col("_zi") - F.col("_zj")))
        return F.when(F.min(free) > 0, total)

    return p.agg(F.array(*[term(c) for c in range(k)]).alias("_ll"), F.count("*").alias("n"))


def _matrix_terms(q: DataFrame, numbers: Column, k: int) -> DataFrame:
    """(_ll array, n): -0.5 (log det R + z' inv(R) z - z'z) summed over times, a sum for each candidate.

    The matrices of a time are array columns: its pairs in order, batched
    through one Cholesky step for all candidates.
    """
    cells = q.groupBy("ts").agg(F.array_sort(F.collect_list(F.struct("i", "j", "zz", numbers.alias("q")))).alias("_c"))
    assets = F.array_size(F.filter("_c", lambda x: x["i"] == x["j"]))
    cells = cells.select(assets.alias("m"), F.transform("_c", lambda x: x["zz"]).alias("zz"), F.flatten(F.transform("_c", lambda x: x["q"])).alias("q")).where("size(zz) = m * (m + 1) / 2")
    most = cells.agg(F.max("m").alias("_most"))
    cells = cells.join(F.broadcast(most), F.col("m") == F.col("_most"))  # one row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m, n = b["m"][0].as_py(), b.num_rows
            up = np.triu_indices(m)
            at = np.array(b["q"].flatten().to_numpy(zero_copy_only=False), float).reshape(n, len(up[0]), k)
            zz = np.array(b["zz"].flatten().to_numpy(zero_copy_only=False), float).reshape(n, len(up[0]))
            full = np.zeros((n, k, m, m))
            full[:, :, up[0], up[1]] = at.transpose(0, 2, 1)
            full[:, :, up[1], up[0]] = at.transpose(0, 2, 1)
            outer = np.zeros((n, 1, m, m))
            outer[:, 0, up[0], up[1]] = zz
            outer[:, 0, up[1], up[0]] = zz
            root = np.sqrt(np.einsum("nkii->nki", full))
            r = full / root[..., :, None] / root[..., None, :]
            odd = np.linalg.eigvalsh(r).min(-1) <= 0
            r[odd] = np.eye(m)
            half = np.log(np.einsum("nkii->nki", np.linalg.cholesky(r))).sum(-1)
            form = np.einsum("nkij,nkij->nk", np.linalg.inv(r), np.broadcast_to(outer, r.shape)) - np.einsum("nkii->nk", outer)
            terms = np.where(odd, np.nan, -half - 0.5 * form)
            yield pa.RecordBatch.from_arrays([pa.array([terms.sum(0).tolist()]), pa.array([n])], ["l", "n"])

    parts = cells.select("m", "zz", "q").mapInArrow(run, "l array<double>, n long")
    total = lambda c: F.when(~F.isnan(F.sum(F.col("l")[c])), F.sum(F.col("l")[c]))
    return parts.agg(F.array(*[total(c) for c in range(k)]).alias("_ll"), F.sum("n").alias("n"))


def zoom_dynamic_correlation(zz: DataFrame, rounds: int = 3, points: int = 5, full: bool = False, a: tuple[float, float] = (0.0, 0.3), b: tuple[float, float] = (0.5, 0.99)) -> DataFrame:
    """(a, b, loglik, n) of all candidates tried in the last of ``rounds``, each a grid around the best of the one before, likeliest first."""
    spans, out = [list(a), list(b)], None
    for _ in range(rounds):
        grid = [(x, y) for x in np.linspace(*spans[0], points) for y in np.linspace(*spans[1], points)]
        out = fit_dynamic_correlation(zz, grid, full)
        best = out.first()
        if best is None:
            return out
        for span, at, (lo, hi) in zip(spans, (best["a"], best["b"]), (a, b), strict=True):
            half = (span[1] - span[0]) / (points - 1)
            span[:] = max(lo, at - half), min(hi, at + half)
    return out


def forecast_correlation(path: DataFrame, zz: DataFrame, a: float, b: float, horizon: int) -> DataFrame:
    """(i, j, h, corr): one step of the recursion from the last time, then decay towards the mean correlation of each pair."""
    last = path.groupBy("i", "j").agg(F.max_by("q", "ts").alias("q"))
    seen = zz.groupBy("i", "j").agg(F.max_by("zz", "ts").alias("x"), F.avg("zz").alias("m"))
    q1 = last.join(seen, ["i", "j"]).select("i", "j", "m", ((1 - a - b) * F.col("m") + a * F.col("x") + b * F.col("q")).alias("q1"))
    q = q1.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("q", F.col("m") + F.pow(F.lit(a + b), F.col("h") - 1) * (F.col("q1") - F.col("m")))
    side = lambda c: q.where("i = j").select(F.col("i").alias(c), "h", F.col("q").alias(f"_q{c}"))
    return q.where("i < j").join(side("i"), ["i", "h"]).join(side("j"), ["j", "h"]).select("i", "j", "h", (F.col("q") / F.sqrt(F.col("_qi") * F.col("_qj"))).alias("corr"))


def forecast_covariance(variances: DataFrame, corr: DataFrame, asset: str = "asset") -> DataFrame:
    """(i, j, h, cov) for i < j: forecast variances (asset, h, var) scaled by correlations (i, j, corr[, h])."""
    side = lambda c: variances.select(F.col(asset).alias(c), "h", F.sqrt("var").alias(f"_s{c}"))
    first = ["i", "h"] if "h" in corr.columns else ["i"]
    return corr.join(side("i"), first).join(side("j"), ["j", "h"]).select("i", "j", "h", (F.col("corr") * F.col("_si") * F.col("_sj")).alias("cov"))


def wide_returns(df: DataFrame, assets: list[str], asset: str = "asset", ts: str = "ts", ret: str = "ret", portfolio: str | None = None) -> DataFrame:
    """(portfolio, ts, r): arrays of the returns of a fixed asset list at the times that all of them have."""
    keys = [F.col(portfolio).alias("portfolio") if portfolio else F.lit("all").alias("portfolio"), F.col(ts).alias("ts")]
    wide = df.where(F.col(asset).isin(assets)).groupBy(*keys).pivot(asset, assets).agg(F.first(ret)).dropna()
    return wide.select("portfolio", "ts", F.array(*[F.col(f"`{a}`").cast("double") for a in assets]).alias("r"))


def bekk(df: DataFrame, c: np.ndarray, a: np.ndarray, b: np.ndarray) -> DataFrame:
    """(portfolio, ts, r, cov): H = C C' + A' r r' A + B' H B row by row along each portfolio, from the sample covariance; cov is row-major.

    One ordered pass holds one matrix, of an asset list that is meant to be
    short (ten or so).
    """
    c, a, b = (np.asarray(m, float) for m in (c, a, b))
    k = len(a)
    start = df.groupBy("portfolio").agg(F.array(*[F.avg(F.col("r")[i] * F.col("r")[j]) for i in range(k) for j in range(k)]).alias("_h0"))
    rows = dealt(df.join(start, "portfolio"), ["portfolio"]).sortWithinPartitions("portfolio", "ts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, h, x = None, None, None
        for batch in batches:
            out = []
            for key, r, h0 in zip(*(batch[n].to_pylist() for n in ("portfolio", "r", "_h0")), strict=True):
                if key != own:
                    own, h = key, np.array(h0).reshape(k, k)
                else:
                    h = c @ c.T + a.T @ np.outer(x, x) @ a + b.T @ h @ b
                x = np.array(r)
                out.append(h.ravel().tolist())
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in ("portfolio", "ts", "r")), pa.array(out, pa.list_(pa.float64()))], ["portfolio", "ts", "r", "cov"])

    return rows.mapInArrow(run, "portfolio string, ts timestamp, r array<double>, cov array<double>")


def bekk_forecast(path: DataFrame, c: np.ndarray, a: np.ndarray, b: np.ndarray, horizon: int) -> DataFrame:
    """(portfolio, h, cov) from each portfolio's last row: one step with its returns, then with expected products."""
    c, a, b = (np.asarray(m, float) for m in (c, a, b))
    k = len(a)

    def run(frames):
        for pdf in frames:
            out = []
            for p, r, cov in zip(pdf["portfolio"], pdf["r"], pdf["cov"]):
                h, x = np.array(cov).reshape(k, k), np.outer(r, r)
                for step in range(1, horizon + 1):
                    h = c @ c.T + a.T @ x @ a + b.T @ h @ b
                    x = h
                    out.append((p, step, h.ravel().tolist()))
            yield pd.DataFrame(out, columns=["portfolio", "h", "cov"])

    last = path.groupBy("portfolio").agg(F.max_by(F.struct("r", "cov"), "ts").alias("s")).select("portfolio", "s.r", "s.cov")
    return last.mapInPandas(run, "portfolio string, h int, cov array<double>")


def _floored(cov: np.ndarray, least: float = 1e-6) -> np.ndarray:
    """Symmetric matrices with eigenvalues of ``least`` or more."""
    w, v = np.linalg.eigh((cov + cov.transpose(0, 2, 1)) / 2)
    return (v * np.maximum(w, least)[:, None, :]) @ v.transpose(0, 2, 1)


def standardized_residuals(path: DataFrame, family: str = "normal", nu: float = 8.0) -> DataFrame:
    """``path`` (r, cov) with ``z``, returns by the inverse of the covariance's lower root, and ``loglik`` of each row, normal or t of unit variance."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in path.schema) + ", z array<double>, loglik double"

    def run(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            r = np.stack(pdf["r"].to_numpy())
            k = r.shape[1]
            root = np.linalg.cholesky(_floored(np.stack(pdf["cov"].to_numpy()).reshape(-1, k, k)))
            z = np.linalg.solve(root, r[:, :, None])[:, :, 0]
            half = np.log(np.diagonal(root, axis1=1, axis2=2)).sum(1)
            s = (z * z).sum(1)
            if family == "normal":
                ll = -0.5 * (k * math.log(2 * math.pi) + s) - half
            else:
                ll = math.lgamma((nu + k) / 2) - math.lgamma(nu / 2) - k / 2 * math.log(math.pi * (nu - 2)) - half - (nu + k) / 2 * np.log1p(s / (nu - 2))
            yield pdf.assign(z=list(z), loglik=ll)

    return path.mapInPandas(run, schema)


def compare_models(scored: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """(model, loglik, n, k, aic, bic) of scored paths and their numbers of parameters, the least AIC first."""
    out = None
    for name, (path, k) in scored.items():
        one = path.agg(F.sum("loglik").alias("loglik"), F.count("*").alias("n")).select(F.lit(name).alias("model"), "loglik", "n", F.lit(k).alias("k"), (2 * k - 2 * F.col("loglik")).alias("aic"), (k * F.log("n") - 2 * F.col("loglik")).alias("bic"))
        out = one if out is None else out.union(one)
    return out.orderBy("aic", "model")


def constant_path(df: DataFrame, assets: int) -> DataFrame:
    """``df`` (portfolio, ts, r) with the sample covariance of each portfolio at every time."""
    cells = F.array(*[F.avg(F.col("r")[i] * F.col("r")[j]) for i in range(assets) for j in range(assets)])
    return df.join(df.groupBy("portfolio").agg(cells.alias("cov")), "portfolio").select("portfolio", "ts", "r", "cov")

