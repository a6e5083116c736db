import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.functions import basic
from tickloom.functions import distributions as dist
from tickloom.operators import affine, arma, bootstrap, clean, densities, describe, diagnostics, fits, multivariate, regress, series, volatility

K, T = ["k"], ["t"]


def _series(spark, values: dict, name="ret"):
    rows = [(k, i, None if v is None else float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, f"k string, t int, {name} double")


def _by(df, column):
    return {(r.k, r.t): r[column] for r in df.collect()}


def _near(a, b, rel=1e-9):
    assert set(a) == set(b)
    for key, v in a.items():
        assert (v is None and b[key] is None) or v == pytest.approx(b[key], rel=rel, abs=1e-12), key


@pytest.fixture(scope="module")
def returns():
    rng = np.random.default_rng(4)
    out = {"a": rng.normal(size=700), "b": rng.normal(size=3), "c": [0.5]}
    return out | {"d": [None, 0.3, None, -0.2, 0.1, None]}


def test_filters_in_chunks_equal_a_walk(spark, returns):
    df = _series(spark, returns).repartition(5)
    chunk = F.floor(F.col("t") / 37)

    def walked(start, step, after=lambda v: v):
        out = {}
        for k, vs in returns.items():
            known = np.array([v for v in vs if v is not None])
            s = start(known)
            for t, v in enumerate(vs):
                out[k, t] = None if v is None else after(s)
                s = s if v is None else step(s, v)
        return out

    square = lambda x: float((x**2).mean())
    cases = [
        (lambda c: volatility.garch(df, K, T, 0.05, 0.1, 0.8, chunk=c), walked(square, lambda s, r: 0.05 + 0.1 * r * r + 0.8 * s)),
        (lambda c: volatility.igarch(df, K, T, 0.01, 0.1, chunk=c), walked(lambda x: 0.5, lambda s, r: 0.01 + 0.1 * r * r + 0.9 * s)),
        (lambda c: volatility.tarch(df, K, T, 0.05, 0.05, 0.1, 0.8, chunk=c), walked(square, lambda s, r: 0.05 + (0.15 if r < 0 else 0.05) * r * r + 0.8 * s)),
        (lambda c: volatility.aparch(df, K, T, 0.05, 0.1, 0.2, 0.8, 1.5, chunk=c), walked(lambda x: float((np.abs(x) ** 1.5).mean()), lambda s, r: 0.05 + 0.1 * (abs(r) - 0.2 * r) ** 1.5 + 0.8 * s, lambda s: s ** (2 / 1.5))),
    ]
    for path, want in cases:
        for c in (None, chunk):
            _near(_by(path(c), "var"), want)
    with pytest.raises(ValueError):
        volatility.garch(df, K, T, 0.1, [0.1, 0.1], 0.5, chunk=chunk)


def test_means_and_residuals_in_chunks(spark, returns):
    df = _series(spark, returns)
    chunk = F.floor(F.col("t") / 10)
    for adjust in (False, True):
        _near(_by(series.ewma(df, K, T, "ret", 0.3, adjust, chunk=chunk), "ewma"), _by(series.ewma(df, K, T, "ret", 0.3, adjust), "ewma"))
    known = df.where("k in ('a', 'b', 'c')")
    params = spark.createDataFrame([(k, 0.1, [0.3, -0.1], [0.4]) for k in "abc"], "k string, const double, ar array<double>, ma array<double>")
    want = {}
    for k in "abc":
        y, e = returns[k], []
        for t in range(len(y)):
            e.append(0.0 if t < 2 else y[t] - 0.1 - 0.3 * y[t - 1] + 0.1 * y[t - 2] - 0.4 * e[t - 1])
            want[k, t] = e[-1]
    for c in (None, chunk, F.col("t")):
        _near(_by(arma.arma_residuals(known, K, T, "ret", params, chunk=c), "residual"), want)
    assert affine.affine_scan(df.limit(0), K, T, {"s": (0.5, F.col("ret"), 0.0)}, chunk=chunk).count() == 0


def test_lags_positions_and_chunks(spark):
    values = {"a": list(range(50)), "b": [7]}
    df = _series(spark, values, "v")
    for c in (F.floor(F.col("t") / 7), F.col("t")):
        got = {(r.k, r.t): (r.v_1, r.v_3) for r in affine.lags(df, K, T, "v", 3, c).collect()}
        assert got == {(k, t): (vs[t - 1] if t else None, vs[t - 3] if t > 2 else None) for k, vs in values.items() for t in range(len(vs))}
    p = affine.positions(df, K, T, F.floor(F.col("t") / 7)).collect()
    assert all(r["_i"] == r.t + 1 and r["_n"] == len(values[r.k]) for r in p)
    c = affine.chunks_of(df, "t", 10, K)
    sizes = {r.c: r["count"] for r in df.where("k = 'a'").groupBy(c.alias("c")).count().collect()}
    assert len(sizes) == 5 and max(sizes.values()) <= 12
    assert df.select(affine.chunks_of(df, "t", 1000, K).alias("c")).distinct().count() == 1
    assert df.limit(0).select(affine.chunks_of(df.limit(0), "t", 10, K)).count() == 0


@pytest.mark.parametrize("limit", [None, 2])
def test_gaps_in_chunks(spark, limit):
    rng = np.random.default_rng(8)
    values = {"a": [None if rng.random() < 0.6 else float(i) for i in range(80)], "b": [None, None], "c": [1.0, None, None, None], "d": [None, None, None, 4.0]}
    df = _series(spark, values, "v")
    for method in ("ffill", "bfill", "linear"):
        for c in (F.floor(F.col("t") / 9), F.floor(F.col("t") / 2)):
            _near(_by(clean.fill(df, K, T, "v", method, limit, c), "v"), _by(clean.fill(df, K, T, "v", method, limit), "v"))


def test_trends_of_blocks_equal_the_whole_solve(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=400).cumsum(), "b": rng.normal(size=11).cumsum(), "c": [1.0, 5.0], "d": [3.0]}
    df = _series(spark, values, "v")
    for lamb, block in ((1600.0, 8), (10.0, 2), (1e6, 64)):
        got = _by(series.hodrick_prescott(df, K, T, "v", lamb, chunk=F.floor(F.col("t") / 50), block=block), "trend")
        for k, vs in values.items():
            n = len(vs)
            d = np.diff(np.eye(n), 2, axis=0) if n > 2 else np.zeros((0, n))
            want = np.linalg.solve(np.eye(n) + lamb * d.T @ d, np.array(vs))
            assert [got[k, t] for t in range(n)] == pytest.approx(want, rel=1e-7, abs=1e-9)


def test_kendall_with_ties_and_skew(spark):
    rng = np.random.default_rng(6)
    cases = {"ties": (rng.integers(0, 5, 300), rng.integers(0, 4, 300)), "skew": (np.r_[np.zeros(200), rng.normal(size=100)], np.r_[rng.normal(size=150), np.ones(150)]), "many": (rng.normal(size=600), rng.normal(size=600)), "one": (np.ones(20), np.arange(20.0))}
    for x, y in cases.values():
        df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (2.0, None)], "x double, y double")
        n = len(x)
        want = (np.sign(np.subtract.outer(x, x)) * np.sign(np.subtract.outer(y, y))).sum() / 2 / (n * (n - 1) / 2)
        for buckets in (1, 7):
            got = describe.kendall(df, "x", "y", buckets).first()
            assert got.n == n and got.kendall == pytest.approx(want, abs=1e-12)
    s = describe.spearman(spark.createDataFrame([(float(a), float(b)) for a, b in zip(*cases["ties"])], "x double, y double"), "x", "y", 3).first()
    rank = lambda v: pd.Series(v).rank().to_numpy()
    assert s.spearman == pytest.approx(np.corrcoef(rank(cases["ties"][0]), rank(cases["ties"][1]))[0, 1])


@pytest.mark.parametrize("far", [0.0, 1e4, 1e8])
def test_errors_and_folds_far_from_zero(spark, far):
    rng = np.random.default_rng(7)
    x, z = rng.normal(size=400), rng.normal(size=400)
    y = 2 * x - z + rng.normal(size=400) * (1 + np.abs(x))
    df = spark.createDataFrame([(i, float(far + a), float(b - far), float(far + c)) for i, (a, b, c) in enumerate(zip(x, z, y))], "id long, x double, z double, y double")
    full = np.c_[np.ones(400), x, z]
    inv = np.linalg.inv(full.T @ full)
    e = y - full @ inv @ full.T @ y
    lever = np.einsum("ij,jk,ik->i", full, inv, full)
    for kind, w in (("HC0", e**2), ("HC1", e**2 * 400 / 397), ("HC2", e**2 / (1 - lever)), ("HC3", e**2 / (1 - lever) ** 2)):
        v = inv @ (full.T * w) @ full @ inv
        got = {r.term: (r.coef, r.se) for r in regress.robust_errors(df, "y", ["x", "z"], kind=kind).collect()}
        assert got["x"][1] == pytest.approx(math.sqrt(v[1, 1]), rel=1e-5) and got["z"][1] == pytest.approx(math.sqrt(v[2, 2]), rel=1e-5)
        if not far:
            assert got["const"][1] == pytest.approx(math.sqrt(v[0, 0]), rel=1e-8)
    folds = {r.fold: r.mse for r in regress.k_fold(df, "y", ["x", "z"], "id", 4).collect()}
    for k in range(4):
        out = np.arange(400) % 4 == k
        b = np.linalg.lstsq(full[~out], y[~out], rcond=None)[0]
        assert folds[k] == pytest.approx(((y[out] - full[out] @ b) ** 2).mean(), rel=1e-5)


@pytest.mark.parametrize("far", [0.0, 1e8])
def test_resampled_deviations_far_from_zero(spark, far):
    v = np.random.default_rng(2).normal(size=90)
    near, away = _series(spark, {"a": v}, "v"), _series(spark, {"a": v + far}, "v")
    for boot in (lambda d: bootstrap.circular_blocks(d, K, T, "v", 10, 7), lambda d: bootstrap.stationary_blocks(d, K, T, "v", 10, 0.2)):
        one, two = ({r.rep: r for r in boot(d).collect()} for d in (near, away))
        assert all(two[k]["std"] == pytest.approx(one[k]["std"], rel=1e-6) and two[k]["mean"] - far == pytest.approx(one[k]["mean"], abs=1e-6) for k in one)


def test_likelihoods_of_all_families(spark):
    r, v = np.random.default_rng(3).normal(size=50), np.linspace(0.5, 2, 50)
    df = spark.createDataFrame([("a", float(x), float(s)) for x, s in zip(r, v)], "k string, ret double, var double")
    for name, nu, lam in (("normal", 8, 0), ("t", 5, 0), ("ged", 1.3, 0), ("skewt", 6, -0.4), ("laplace", 1, 0)):
        want = (dist.log_pdf(r / np.sqrt(v), name, nu, lam) - 0.5 * np.log(v)).sum()
        assert volatility.log_likelihood(df, K, "ret", name, nu, lam).first().loglik == pytest.approx(want)
    with pytest.raises(ValueError):
        volatility.log_likelihood(df, K, "ret", "nonsense")


def test_standardised_axes_and_lines_through_zero(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3)) @ np.array([[1.0, 0.5, 0.0], [0.0, 1.0, 300.0], [0.0, 0.0, 50.0]]) + [10.0, -5.0, 1e4]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double, c double")
    axes = regress.pca(df, ["a", "b", "c"], 3, True)
    p = regress.project(df, axes, ["a", "b", "c"])
    scores = np.array([[r.pc_1, r.pc_2, r.pc_3] for r in p.orderBy("id").collect()])
    assert scores.var(0, ddof=1) == pytest.approx([r.eigenvalue for r in axes.orderBy("component").collect()])
    back = regress.unproject(p.drop("a", "b", "c"), axes, ["a", "b", "c"]).orderBy("id").collect()
    assert np.array([[r.a, r.b, r.c] for r in back]) == pytest.approx(x)
    line = regress.ols(df, "b", ["a"], constant=False)
    got = regress.predict(df, line, "b", ["a"]).orderBy("id").collect()
    b = (x[:, 0] @ x[:, 1]) / (x[:, 0] @ x[:, 0])
    assert [r.residual for r in got] == pytest.approx(x[:, 1] - b * x[:, 0])


def test_orders_from_one_matrix(spark):
    rng = np.random.default_rng(1)
    y = np.zeros(500)
    for t in range(2, 500):
        y[t] = 0.5 * y[t - 1] - 0.4 * y[t - 2] + rng.normal()
    df = _series(spark, {"a": y, "b": rng.normal(size=200)}, "v")
    got = {r.k: (r.p, r.q, r.bic) for r in arma.choose_order(df, K, T, "v", 3, 1, "bic").collect()}
    tries = {}
    rows = arma.residual_table(df, K, T, "v", 4)
    for p in range(4):
        for q in range(2):
            if p + q:
                for r in arma.fit_arma(df, K, T, "v", p, q, 4, rows=rows, skip=7).collect():
                    tries.setdefault(r.k, []).append((r.bic, p, q))
    for k, found in tries.items():
        bic, p, q = min(found)
        assert got[k] == (p, q, pytest.approx(bic))
    assert got["a"][0] == 2


@pytest.mark.parametrize("trend", ["n", "c", "ct"])
def test_lags_of_a_unit_root_test_from_one_matrix(spark, trend):
    y = np.random.default_rng(2).normal(size=150).cumsum()
    df = _series(spark, {"a": y}, "v")
    got = diagnostics.unit_root(df, K, T, "v", 3, trend, choose=True).first()
    d, best = np.diff(y), None
    for p in range(4):
        at = np.arange(4, 150)
        x = np.c_[y[at - 1], *([np.ones(len(at))] if trend != "n" else []), *([at + 1.0] if trend == "ct" else []), *[d[at - 1 - k] for k in range(1, p + 1)]]
        b, *_ = np.linalg.lstsq(x, d[at - 1], rcond=None)
        e = d[at - 1] - x @ b
        aic = len(at) * math.log(e @ e / len(at)) + 2 * x.shape[1]
        t = b[0] / math.sqrt(np.linalg.inv(x.T @ x)[0, 0] * (e @ e) / (len(at) - x.shape[1]))
        best = min(best, (aic, p, t)) if best else (aic, p, t)
    assert (got.lags, got.n) == (best[1], 146) and got.statistic == pytest.approx(best[2], rel=1e-6)


def test_forecasts_with_future_columns_and_of_higher_orders(spark):
    rng = np.random.default_rng(3)
    y, x, ahead = rng.normal(size=60), rng.normal(size=(60, 2)), rng.normal(size=(5, 2))
    df = spark.createDataFrame([("a", t, float(v), *map(float, w)) for t, (v, w) in enumerate(zip(y, x))], "k string, t int, v double, p double, q double")
    params = spark.createDataFrame([("a", 0.2, [0.4, -0.1], [0.3, 0.2], [0.5, -0.7], 2.0)], "k string, const double, ar array<double>, ma array<double>, exog array<double>, sigma2 double")
    future = spark.createDataFrame([("a", h + 1, *map(float, w)) for h, w in enumerate(ahead)] + [("a", 7, 0.0, 0.0), ("z", 1, 0.0, 0.0)], "k string, h int, p double, q double")
    e = []
    for t in range(60):
        e.append(0.0 if t < 2 else y[t] - 0.2 - x[t] @ [0.5, -0.7] - 0.4 * y[t - 1] + 0.1 * y[t - 2] - 0.3 * e[t - 1] - 0.2 * e[t - 2])
    ys, es = list(y), list(e)
    for w in ahead:
        ys.append(0.2 + w @ [0.5, -0.7] + 0.4 * ys[-1] - 0.1 * ys[-2] + 0.3 * es[-1] + 0.2 * es[-2])
        es.append(0.0)
    res = arma.arma_residuals(df, K, T, "v", params, ["p", "q"])
    got = arma.forecast(res, K, T, "v", params, 10, ["p", "q"], future).orderBy("h").collect()
    assert [r["mean"] for r in got] == pytest.approx(ys[60:]) and [r.h for r in got] == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        arma.forecast(res, K, T, "v", params, 3, ["p", "q"])
    path = spark.createDataFrame([(k, t, float(r), float(v)) for k, n in (("a", 30), ("b", 2)) for t, (r, v) in enumerate(zip(y[:n], 1 + x[:n, 0] ** 2))], "k string, t int, ret double, var double")
    orders = spark.createDataFrame([("a", 0.1, [0.1, 0.05, 0.02], [0.3, 0.4]), ("b", 0.1, [0.2], [0.5]), ("c", 0.1, [0.2], [0.5])], "k string, omega double, alpha array<double>, beta array<double>")
    f = {(r.k, r.h): r["var"] for r in fits.forecast_orders(path, orders, K, T, 6).collect()}
    for k, n, a, b in (("a", 30, [0.1, 0.05, 0.02], [0.3, 0.4]), ("b", 2, [0.2], [0.5])):
        sq, v = list(y[:n] ** 2), list(1 + x[:n, 0] ** 2)
        for h in range(1, 7):
            v.append(0.1 + sum(w * sq[-1 - i] for i, w in enumerate(a)) + sum(w * v[-1 - i] for i, w in enumerate(b)))
            sq.append(v[-1])
            assert f[k, h] == pytest.approx(v[-1])
    assert len(f) == 12


def test_systems_of_equations_by_key(spark):
    rng = np.random.default_rng(4)
    rows = [(s, n, t, float(v)) for s in ("x", "y") for t in range(80) for n, v in zip("pqr", rng.normal(size=3))]
    df = spark.createDataFrame(rows, "s string, asset string, ts int, value double")
    got = {(r.s, r.equation, r.term): (r.coef, r.se) for r in arma.var_fit(df, ["p", "q", "r"], 2, system="s").collect()}
    cov = {(r.s, r.i, r.j): r["cov"] for r in arma.var_covariance(df, ["p", "q", "r"], 2, system="s").collect()}
    assert len(got) == 2 * 3 * 7 and len(cov) == 12
    for s in ("x", "y"):
        v = np.array([r[3] for r in rows if r[0] == s]).reshape(80, 3)
        x = np.c_[np.ones(78), v[1:-1], v[:-2]]
        b = np.linalg.lstsq(x, v[2:], rcond=None)[0]
        e = v[2:] - x @ b
        sigma = e.T @ e / (78 - 7)
        se = np.sqrt(np.outer(np.diag(np.linalg.inv(x.T @ x)), np.diag(sigma)))
        for k, term in enumerate(["const", "p_1", "q_1", "r_1", "p_2", "q_2", "r_2"]):
            for i, n in enumerate("pqr"):
                assert got[s, n, term] == (pytest.approx(b[k, i]), pytest.approx(se[k, i]))
        assert cov[s, "p", "r"] == pytest.approx(sigma[0, 2]) and cov[s, "q", "q"] == pytest.approx(sigma[1, 1])


def test_simplex_fits_beat_fine_grids(spark):
    rng, v, r = np.random.default_rng(5), 1.0, []
    for _ in range(600):
        r.append(rng.normal() * math.sqrt(v))
        v = 0.1 + 0.15 * r[-1] ** 2 + 0.75 * v
    r = np.array(r)
    f = fits.fit_series(r, "garch")
    score = lambda p, model="garch", skip=0: float((dist.log_pdf(r / np.sqrt(fits.one_path(model, r, p)), "normal")[skip:] - 0.5 * np.log(fits.one_path(model, r, p))[skip:]).sum())
    assert score(f) == pytest.approx(f["loglik"], abs=1e-9)
    near = np.linspace(0.98, 1.02, 9)
    top = max(score({"omega": f["omega"] * a, "alpha": f["alpha"] * b, "beta": f["beta"] * c}) for a in near for b in near for c in near)
    assert top <= f["loglik"] + 1e-4
    one = fits.fit_series(r, "figarch")
    again = max(score({"omega": one["omega"] * a, "d": one["d"] * b, "phi": one["phi"], "beta": one["beta"] * c}, "figarch", 100) for a in near for b in near for c in near)
    assert again <= one["loglik"] + 1e-2 and min(fits.figarch_weights(one["d"], one["phi"], one["beta"], 100)) >= 0
    df = _series(spark, {"a": r, "short": r[:50]})
    p = fits.fit_panel(df, K, T, "figarch").collect()
    assert [x.k for x in p] == ["a"] and p[0].delta == pytest.approx(one["d"]) and 0 < p[0].persistence < 1
    x, y = fits.simplex(lambda p: (p[0] - 3) ** 2 + 10 * (p[1] + p[0]) ** 2, np.zeros(2), np.ones(2))
    assert x == pytest.approx([3, -3], abs=1e-3) and y < 1e-6


def test_correlation_candidates_by_matrices(spark):
    rng = np.random.default_rng(6)
    common = rng.normal(size=200)
    z = np.c_[common + rng.normal(size=200), common + rng.normal(size=200), rng.normal(size=200), rng.normal(size=200)]
    rows = [(n, t, float(z[t, k]), 1.0) for k, n in enumerate("abcd") for t in range(200) if not (n == "d" and t == 7)]
    path = spark.createDataFrame(rows, "asset string, ts int, ret double, var double")
    grid = [(0.02, 0.9), (0.05, 0.5), (0.3, 0.3), (0.7, 0.5)]
    zz = multivariate.standardized_pairs(path)
    got = {(r.a, r.b): (r.loglik, r.n) for r in multivariate.fit_dynamic_correlation(zz, grid, full=True).collect()}
    assert len(got) == 3
    q0 = {}
    for i in range(4):
        for j in range(i, 4):
            at = [t for t in range(200) if not (t == 7 and 3 in (i, j))]
            q0[i, j] = (np.array([z[t, i] * z[t, j] for t in at]).mean(), at)
    for (a, b), (loglik, n) in got.items():
        paths = {}
        for (i, j), (m, at) in q0.items():
            q = m
            for t in at:
                paths[i, j, t] = q
                q = (1 - a - b) * m + a * z[t, i] * z[t, j] + b * q
        total = 0.0
        for t in range(200):
            if t != 7:
                q = np.array([[paths[min(i, j), max(i, j), t] for j in range(4)] for i in range(4)])
                s = np.sqrt(np.diag(q))
                c = q / np.outer(s, s)
                total += -0.5 * (np.log(np.linalg.det(c)) + z[t] @ np.linalg.inv(c) @ z[t] - z[t] @ z[t])
        assert n == 199 and loglik == pytest.approx(total)
    assert multivariate.fit_dynamic_correlation(zz, [(0.9, 0.5)]).count() == 0
    zoom = multivariate.zoom_dynamic_correlation(zz, 2, 4)
    assert zoom.count() > 4 and zoom.first().loglik >= multivariate.fit_dynamic_correlation(zz, grid).first().loglik - 5


@pytest.mark.parametrize("kind", ["TR", "TSQ"])
def test_confidence_sets_equal_pairs_of_models(spark, kind):
    rng = np.random.default_rng(8)
    loss = rng.normal(size=(80, 4)) ** 2 + [0.0, 0.1, 0.6, 0.0]
    df = spark.createDataFrame([(m, t, float(loss[t, m])) for m in range(4) for t in range(80)], "model int, t int, loss double")
    got = {r.model: r for r in bootstrap.confidence_set(df, 60, 0.2, 0.1, kind).collect()}
    reps = {}
    for r in bootstrap.stationary_blocks(df, ["model"], ["t"], "loss", 60, 0.2).collect():
        reps[r.rep, r.model] = r["mean"]
    x = np.array([[reps[k, m] for m in range(4)] for k in range(60)])
    means, left, top, step = loss.mean(0), list(range(4)), 0.0, 0
    while left:
        d = math.sqrt(80) * (means[left][:, None] - means[left])
        e = math.sqrt(80) * (x[:, left][:, :, None] - x[:, left][:, None, :]) - d
        stat, draws = (np.abs(d).max(), np.abs(e).max((1, 2))) if kind == "TR" else ((d**2).sum() / 2, (e**2).sum((1, 2)) / 2)
        top = max(top, float((draws >= stat - 1e-12).mean()))
        worst = left[int(d.mean(1).argmax())]
        r = got[worst]
        assert (r.step, r.inside) == (step, top >= 0.1) and r.statistic == pytest.approx(stat, abs=1e-9) and r.p_value == pytest.approx(top)
        left.remove(worst)
        step += 1
    assert bootstrap.confidence_set(df.limit(0), 5, 0.2).count() == 0
    assert densities.log_pdf(F.lit(0.0)) is not None


def test_gaps_visit_few_blocks_and_find_the_nearest(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.uniform(size=(3000, 2)) * 100, 1)
    x = np.c_[x, x.sum(1)]
    gap = rng.random(3000) < 0.05
    x[gap, 2] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, a double, b double, c double")
    asked, _, blocks = clean.knn_plan(df, "id", ["a", "b", "c"], 3, 50)
    share = asked.count() / (gap.sum() * blocks)
    assert blocks >= 59 and share < 0.25
    got = {r.id: r.c for r in clean.knn_impute(df, "id", ["a", "b", "c"], 3, block=50).collect()}
    full = np.flatnonzero(~gap)
    for i in np.flatnonzero(gap):
        d = np.sqrt(((x[full, :2] - x[i, :2]) ** 2).sum(1) * 3 / 2)
        assert got[i] == pytest.approx(x[full[np.lexsort((full, d))[:3]], 2].mean())
    none = df.where("id < 0")
    assert clean.knn_impute(none, "id", ["a", "b", "c"], 3).count() == 0


def test_gaps_whose_known_value_many_rows_share_visit_few_rows(spark):
    rng = np.random.default_rng(12)
    n = 2000
    x = np.c_[np.round(rng.normal(size=n) * 1000), rng.integers(0, 5, n).astype(float)]
    rows = [(i, None if i % 9 == 0 else float(a), None if i % 10 == 1 else math.nan if i % 50 == 7 else float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(6)
    asked, donors, _ = clean.knn_plan(df, "id", ["a", "b"], 3, 50)
    met = asked.where("_c = 0").join(donors.groupBy("_box").count(), "_box").groupBy("_id").agg(F.sum("count").alias("n"))
    assert met.agg(F.max("n")).first()[0] <= 3 * 5
    got = {r.id: (r.a, r.b) for r in clean.knn_impute(df, "id", ["a", "b"], 3, block=50).collect()}
    whole = [tuple(math.nan if v is None else v for v in r) for r in rows]
    for i, a, b in whole:
        for c, (own, other) in enumerate(((a, b), (b, a))):
            if rows[i][1 + c] is None:
                near = sorted((abs(r[2 - c] - other), r[0], r[1 + c]) for r in whole if r[0] != i and not math.isnan(r[1]) and not math.isnan(r[2]))[:3]
                want = sum(v for _, _, v in near) / len(near) if not math.isnan(other) else None
                assert got[i][c] == (pytest.approx(want) if want is not None else None), (i, c)


def test_gaps_of_more_kinds_than_views_find_the_nearest(spark, monkeypatch):
    monkeypatch.setattr(clean, "VIEWS", 3)
    rng = np.random.default_rng(13)
    x = rng.integers(0, 6, (150, 3)).astype(float)
    x[rng.random((150, 3)) < 0.2] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, a double, b double, c double")
    got = {r.id: [r.a, r.b, r.c] for r in clean.knn_impute(df, "id", ["a", "b", "c"], 3, block=16).collect()}
    for i, c in zip(*np.nonzero(np.isnan(x))):
        near = []
        for j in range(150):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            if j != i and both.any() and not np.isnan(x[j, c]):
                near.append((math.sqrt(((x[i] - x[j])[both] ** 2).sum() * 3 / both.sum()), j))
        top = sorted(near)[:3]
        assert got[i][c] == (pytest.approx(np.mean([x[j, c] for _, j in top])) if top else None)


def test_nearness_of_all_dimensions_and_residual_summaries(spark):
    x = np.random.default_rng(16).normal(size=130)
    df = _series(spark, {"a": x}, "v")
    for block in (512, 20):
        many = {r.dimension: r for r in diagnostics.bds(df, K, T, "v", 4, 0.7, block, least=2).collect()}
        for m in (2, 3, 4):
            one = diagnostics.bds(df, K, T, "v", m, 0.7, block).first()
            near = np.abs(x[:, None] - x) < 0.7 * x.std(ddof=1)
            n = 130 - m + 1
            run = np.logical_and.reduce([near[k : n + k, k : n + k] for k in range(m)]) & ~np.eye(n, dtype=bool)
            assert many[m].n == n and many[m]["cm"] == pytest.approx(run.sum() / (n * (n - 1)))
            assert (one.statistic, one.c1) == (pytest.approx(many[m].statistic), pytest.approx(many[m].c1))
    s = diagnostics.residual_summary(df, K, T, "v").first()
    t = np.arange(1.0, 131.0)
    e = x**2
    b = np.linalg.lstsq(np.c_[np.ones(130), t, t * t], e, rcond=None)[0]
    r2 = 1 - ((e - np.c_[np.ones(130), t, t * t] @ b) ** 2).sum() / ((e - e.mean()) ** 2).sum()
    assert s.white == pytest.approx(130 * r2) and s.white_p == pytest.approx(math.exp(-65 * r2), rel=1e-6)
    assert (s["mean"], s["std"], s.n) == (pytest.approx(x.mean()), pytest.approx(x.std()), 130)
    assert s.durbin_watson == pytest.approx((np.diff(x) ** 2).sum() / (x**2).sum())


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 100, 255])
def test_buckets_count_the_cuts_below(spark, n):
    cuts = [float(2 * k) for k in range(n)]
    rows = spark.range(-2, 2 * n + 3).select(F.col("id").cast("double").alias("v"))
    assert all(r.b == sum(c < r.v for c in cuts) for r in rows.select("v", basic.bucket(F.col("v"), cuts).alias("b")).collect())


def test_fits_of_few_large_groups_move_no_rows(spark):
    """Three groups of any size: no task takes the rows of a group, and values far from zero keep their fit."""
    df = spark.range(3000).selectExpr("id % 3 AS g", "1e8D + id % 7 AS x", "1e8D + 2 * (id % 7) + id % 5 AS y")
    fit = regress.ols(df, "y", ["x"], ["g"])
    made = {
        "ols": fit, "predict": regress.predict(df, fit, "y", ["x"], ["g"]), "robust": regress.robust_errors(df, "y", ["x"], ["g"]),
        "white": diagnostics.white(df.withColumn("e", F.col("y") - F.col("x")), ["g"], ["x"], "e"), "reset": diagnostics.reset(df, ["g"], "y", ["x"]),
    }
    for name, out in made.items():
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan, name
        for row in (line for line in plan.splitlines() if "Join" in line):
            small = name == "robust" and "cells" in plan.split(row)[1].splitlines()[1]
            assert "strategy=broadcast" in row or small or name == "reset" and "_r0" in plan.split(row)[1].splitlines()[1], (name, row)
    for r in fit.where("term = 'x'").collect():
        rows = [(i % 7, 2 * (i % 7) + i % 5) for i in range(3000) if i % 3 == r.g]
        assert abs(r.coef - np.polyfit(*np.array(rows, float).T, 1)[0]) < 1e-7


def test_chunked_scan_deals_rows_after_a_join_by_the_same_keys(spark):
    """Adaptive execution may leave a join's rows where they were read: the walk needs a shuffle of its own, which Spark must not drop."""
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0)], "k int, t int, x double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = affine.affine_scan(df, ["k"], ["t"], {"s": (1.0, F.col("x"), 0.0)}, chunk=F.col("t"))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    walk = plan[: plan.index("Join")]
    assert "REPARTITION_BY_COL" in walk
    assert [r.s for r in out.orderBy("t").collect()] == [1.0, 2.0]


def test_several_fills_read_their_rows_as_often_as_one(spark):
    rows = [("a", t, None if t in (0, 3, 4, 5, 9) else float(t * t)) for t in range(10)] + [("b", t, None) for t in range(4)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    ways = {"f": ("ffill", None), "f1": ("ffill", 1), "b1": ("bfill", 1), "l": ("linear", None)}
    scans = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    for chunk in (None, F.floor(F.col("t") / 2)):
        out = clean.fills(df, ["k"], ["t"], "v", ways, chunk)
        assert scans(out) == (1 if chunk is None else 2)
        got = out.orderBy("k", "t").collect()
        for name, (method, limit) in ways.items():
            one = clean.fill(df, ["k"], ["t"], "v", method, limit).orderBy("k", "t").collect()
            assert [r[name] for r in got] == [r.v for r in one]


def test_constant_correlation_moves_rows_by_bucket_and_not_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(f"a{a}", int(t), float(rng.normal()), float(rng.uniform(0.5, 2))) for a in range(14) for t in rng.choice(40, 25 + a % 3, replace=False)]
    rows[5] = (*rows[5][:2], None, rows[5][3])
    pdf = pd.DataFrame(rows, columns=["asset", "t", "ret", "var"])
    df = spark.createDataFrame(rows, "asset string, t int, ret double, var double")
    out = volatility.constant_correlation(df, "asset", "t", least=12)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.t, r.i, r.j): (r.corr, r.cov) for r in out.collect()}
    pdf["sd"] = np.sqrt(pdf["var"])
    pdf["z"] = pdf["ret"] / pdf["sd"]
    both = pdf.merge(pdf, on="t").query("asset_x < asset_y")
    want = {}
    for (i, j), g in both.groupby(["asset_x", "asset_y"]):
        if len(g) >= 12:
            c = g["z_x"].corr(g["z_y"])
            want |= {(t, i, j): (c, c * x * y) for t, x, y in zip(g["t"], g["sd_x"], g["sd_y"], strict=True)}
    assert want and got.keys() == want.keys()
    assert all(np.allclose(got[k], v) for k, v in want.items())


def test_robust_summary_takes_no_group_in_one_task(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(x)) for x in rng.normal(size=501)] + [("b", float(x)) for x in rng.integers(0, 3, 200)] + [("c", 4.0), ("d", None)] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    out = describe.robust_summary(df, ["k"], "v")
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.k: (r.median, r.q1, r.q3, r.iqr, r.mad) for r in out.collect()}
    assert got["d"] == (None,) * 5
    for k in "abc":
        v = np.array([x for g, x in rows if g == k and x is not None])
        q1, m, q3 = np.percentile(v, [25, 50, 75])
        assert np.allclose(got[k], (m, q1, q3, q3 - q1, np.median(np.abs(v - m))), atol=1e-12)


def _shuffled(spark) -> int:
    """Rows that all stages so far have written for a shuffle."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    gateway = spark.sparkContext._gateway
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_constant_correlation_shuffles_a_row_once_and_keeps_pairs_together(spark, tmp_path):
    """A row is shuffled once, for however many blocks and pairs it is needed; times of a pair come in order."""
    rng = np.random.default_rng(5)
    rows = [(a, int(t), f"day {t}", float(rng.normal()), float(rng.uniform(0.5, 2))) for a in range(60) for t in rng.choice(50, 30, replace=False)]
    spark.createDataFrame(rows, "asset long, t int, day string, ret double, var double").write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    before = _shuffled(spark)
    volatility.constant_correlation(df, "asset", "t", shown="day").write.parquet(f"{tmp_path}/out")
    assert _shuffled(spark) - before == len(rows)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.columns == ["day", "i", "j", "corr", "cov"]
    plain = volatility.constant_correlation(df, "asset", "t").select(F.concat(F.lit("day "), "t").alias("day"), "i", "j", "corr", "cov")
    assert out.count() == plain.count() > 0 and out.exceptAll(plain).isEmpty()
    seen = set()
    for file in tmp_path.glob("out/*.parquet"):
        got = pd.read_parquet(file)
        times, pairs = got["day"].str[4:].astype(int).to_numpy(), list(zip(got["i"], got["j"], strict=True))
        firsts = [p for k, p in enumerate(pairs) if not k or pairs[k - 1] != p]
        assert len(set(firsts)) == len(firsts) and not seen & set(firsts)
        assert all(times[k - 1] < times[k] for k in range(1, len(pairs)) if pairs[k - 1] == pairs[k])
        seen |= set(firsts)


@pytest.mark.parametrize("cells, assets", [(1 << 21, 1000), (64, 3)])
def test_constant_correlation_of_blocks_cut_into_runs(monkeypatch, cells, assets):
    """Few cells at once: the pair step in pieces gives the rows of the whole one, nulls and infinite values too."""
    monkeypatch.setattr(volatility, "_CELLS", cells)
    monkeypatch.setattr(volatility, "_ASSETS", assets)
    rng = np.random.default_rng(9)
    rows = [(a, int(t), None if rng.random() < 0.05 else float(rng.normal()), None if rng.random() < 0.05 else float(rng.uniform(0.5, 2))) for a in range(24) for t in rng.choice(40, 25, replace=False)]
    rows[7] = (*rows[7][:2], float("inf"), 1.0)
    packed = []
    for k in (0, 1):
        names = ["i", "ts", "z", "sd"]
        part = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[r for r in rows if r[0] % 2 == k], strict=True)], names)
        packed.append(next(volatility._packed(iter([part])))["rows"])
    step, pdf = volatility._pair_rows(4, ["t", "i", "j", "corr", "cov"]), pd.DataFrame(rows, columns=["asset", "t", "z", "sd"])
    got = {}
    for x in packed:
        for y in packed:
            for b in step(iter([pa.RecordBatch.from_arrays([x, y], ["one", "two"])])):
                for r in b.to_pylist():
                    assert (r["i"], r["j"], r["t"]) not in got
                    got[r["i"], r["j"], r["t"]] = r["corr"], r["cov"]
    both, want = pdf.merge(pdf, on="t").query("asset_x < asset_y"), {}
    for (i, j), g in both.groupby(["asset_x", "asset_y"]):
        if len(g) >= 4:
            z = g[["z_x", "z_y"]].dropna()
            c = np.nan if np.isinf(z.to_numpy()).any() else z["z_x"].corr(z["z_y"])
            want |= {(i, j, t): (c, c * a * b) for t, a, b in zip(g["t"], g["sd_x"], g["sd_y"], strict=True)}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert np.allclose([np.nan if x is None else x for x in got[k]], v, equal_nan=True), k
    odd = {k for k, (c, _) in got.items() if c is not None and np.isnan(c)}
    assert odd and all(rows[7][0] in k[:2] for k in odd)
