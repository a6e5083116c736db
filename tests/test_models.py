"""Models, fits, distributions, tests and inference against numpy and hand values."""

import datetime as dt
import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import distributions as dist
from tickloom.operators import align, arma, bootstrap, clean, densities, describe, diagnostics, fits, multivariate, realized, regress, series, volatility

K, T = ["k"], ["t"]


def _frame(spark, values, key="a", name="ret"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], f"k string, t int, {name} double")


def _path(df, column="var"):
    return np.array([r[column] for r in df.orderBy("t").collect()], float)


def _garch(n, seed=0, omega=0.05, alpha=0.1, beta=0.85):
    rng, v, out = np.random.default_rng(seed), 1.0, []
    for _ in range(n):
        out.append(rng.normal() * math.sqrt(v))
        v = omega + alpha * out[-1] ** 2 + beta * v
    return np.array(out)


def test_filters_of_higher_orders(spark):
    r = np.random.default_rng(1).normal(size=60)
    df = _frame(spark, r)
    v0 = (r**2).mean()
    want = [v0, v0]
    for t in range(2, 60):
        want.append(0.1 + 0.2 * r[t - 1] ** 2 + 0.05 * r[t - 2] ** 2 + 0.5 * want[t - 1] + 0.1 * want[t - 2])
    assert _path(volatility.garch(df, K, T, 0.1, [0.2, 0.05], [0.5, 0.1])) == pytest.approx(want)
    two = [0.1 / 0.02] * 2
    for t in range(2, 60):
        two.append(0.1 + 0.3 * r[t - 1] ** 2 + 0.35 * (two[t - 1] + two[t - 2]))
    assert _path(volatility.igarch(df, K, T, 0.1, 0.3, lags=2)) == pytest.approx(two)
    e = [math.log(v0)]
    for t in range(1, 60):
        z = r[t - 1] / math.exp(e[-1] / 2)
        e.append(-0.1 + 0.2 * (abs(z) - math.sqrt(2 / math.pi)) - 0.1 * z + 0.9 * e[-1])
    assert _path(volatility.egarch(df, K, T, -0.1, 0.2, -0.1, 0.9)) == pytest.approx(np.exp(e))


def test_a_long_series_in_chunks_equals_one_pass(spark):
    n = 3000
    df = spark.range(n).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") * 7200).alias("ts"), F.sin(F.col("id") * F.col("id")).alias("ret"))
    one = {r.ts: r["var"] for r in volatility.garch(df, K, ["ts"], 0.1, 0.2, 0.7).collect()}
    two = {r.ts: r["var"] for r in volatility.long_garch(df, "k", "ts", 0.1, 0.2, 0.7, days=3).collect()}
    assert len(two) == n and all(two[t] == pytest.approx(v, rel=1e-9) for t, v in one.items())


def test_null_rows_keep_the_state(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("a", 2, 3.0), (None, 0, 5.0)], "k string, t int, v double")
    got = {(r.k, r.t): r.ewma for r in series.ewma(df, K, T, "v", 0.5).collect()}
    assert got == {("a", 0): 1.0, ("a", 1): None, ("a", 2): 2.0, (None, 0): 5.0}
    assert series.ewma(df.limit(0), K, T, "v", 0.5).count() == 0


def test_trend_solves_its_equations(spark):
    y = np.random.default_rng(2).normal(size=50).cumsum()
    d = np.diff(np.eye(50), 2, axis=0)
    want = np.linalg.solve(np.eye(50) + 100 * d.T @ d, y)
    got = _path(series.hodrick_prescott(_frame(spark, y, name="v"), K, T, "v", 100.0), "trend")
    assert got == pytest.approx(want) and series._banded(y[:2], 5.0).tolist() == y[:2].tolist()


def test_spline_is_cubic_between_known_values(spark):
    x = np.arange(40.0)
    y = 0.01 * x**3 - 0.3 * x**2 + x
    v = [None if i % 3 == 1 or i in (0, 39) else float(y[i]) for i in range(40)]
    df = spark.createDataFrame([("a", i, a) for i, a in enumerate(v)], "k string, t int, v double")
    got = [r.v for r in clean.spline(df, K, T, "v").orderBy("t").collect()]
    assert got[0] is None and got[39] is None and got[2:38] == pytest.approx(y[2:38])
    runs = [r.v for r in clean.spline(df, K, T, "v", run=40).orderBy("t").collect()]
    assert runs[2:38] == pytest.approx(y[2:38])


def test_nearest_rows_fill_gaps(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    x[rng.random((60, 3)) < 0.2] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    for weights in ("uniform", "distance"):
        got = {r.id: [r.a, r.b, r.c] for r in clean.knn_impute(df, "id", ["a", "b", "c"], 4, weights, block=16).collect()}
        for i in range(60):
            for c in range(3):
                if not np.isnan(x[i, c]):
                    assert got[i][c] == pytest.approx(x[i, c])
                    continue
                near = []
                for j in range(60):
                    both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                    if j != i and both.any() and not np.isnan(x[j, c]):
                        near.append((math.sqrt(((x[i] - x[j])[both] ** 2).sum() * 3 / both.sum()), j))
                top = sorted(near)[:4]
                w = [1.0 if weights == "uniform" else 1 / d for d, _ in top]
                want = sum(a * x[j, c] for a, (_, j) in zip(w, top)) / sum(w) if top else None
                assert got[i][c] == (pytest.approx(want) if want is not None else None)


def test_mergers_and_grids(spark):
    p = spark.createDataFrame([("old", 1, 10.0), ("old", 5, 20.0), ("new", 4, 7.0), ("new", 8, 30.0)], "symbol string, d int, price double").select("symbol", F.timestamp_seconds(F.col("d") * 86400).alias("ts"), "price")
    m = spark.createDataFrame([("old", "new", 6, 0.5), ("old", "none", 6, 0.5)], "old_symbol string, new_symbol string, d int, value double").select("old_symbol", "new_symbol", F.timestamp_seconds(F.col("d") * 86400).alias("ts"), "value")
    assert [(r.symbol, r.factor) for r in align.merger_factors(p, m).collect()] == [("old", 0.5 * 30 / 20)]
    g = align.align_grid(p.withColumnsRenamed({"symbol": "asset", "price": "value"}), 86400)
    assert g.count() == 16 and g.where("value is not null").count() == 4


def test_prices_around_dates_need_no_aggregate(spark, tmp_path):
    rng = np.random.default_rng(4)
    start = dt.datetime(2024, 1, 1)
    prices = [(f"s{rng.integers(3)}", start + dt.timedelta(days=int(rng.integers(40))), None if rng.random() < 0.2 else float(rng.integers(1, 90))) for _ in range(120)]
    dates = [(f"s{rng.integers(4)}", start + dt.timedelta(days=int(rng.integers(-3, 44))), k) for k in range(60)]
    spark.createDataFrame(prices, "symbol string, ts timestamp, price double").write.parquet(str(tmp_path / "p"))
    p, d = spark.read.parquet(str(tmp_path / "p")), spark.createDataFrame(dates, "symbol string, ts timestamp, k int")
    for find, pick in ((align.price_after, lambda u, t: u >= t), (align.price_before, lambda u, t: u < t)):
        got = find(p, d)
        assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
        want = {}
        for s, t, k in dates:
            near = [u for x, u, v in prices if x == s and v is not None and pick(u, t)]
            at = (min(near) if find is align.price_after else max(near)) if near else None
            want[k] = min((v for x, u, v in prices if x == s and u == at and v is not None), default=None)
        assert {r.k: r.price for r in got.collect()} == want


def test_kendall_counts_every_pair(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 30, 200), rng.integers(0, 12, 200)
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i, j in combinations(range(200), 2))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)] + [(None, 1)], "x int, y int")
    for buckets in (1, 4, 64):
        r = describe.kendall(df, "x", "y", buckets).first()
        assert r.n == 200 and r.kendall == pytest.approx(s / (200 * 199 / 2))


def test_ranks_of_ties(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, 2.0, None)], "v double")
    got = {r.v: r.rank for r in describe.average_ranks(df, "v", "rank").collect()}
    assert got == {3.0: 3.5, 1.0: 1.0, 2.0: 2.0, None: None}


def test_large_means_do_not_cancel(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    y = 2 * x + 0.1 * rng.normal(size=300)
    df = spark.createDataFrame([(float(a) + 1e9, float(b) + 3e9) for a, b in zip(x, y)], "x double, y double")
    r = regress.ols(df, "y", ["x"]).where("term = 'x'").first()
    slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    assert r.coef == pytest.approx(slope, rel=1e-5) and 0.9 < r.r2 < 1 and r.se == pytest.approx(0.1 / math.sqrt(300), rel=0.2)
    free = regress.ols(_frame(spark, [1.0, 2.0, 4.0], name="y").withColumn("x", F.col("t") + 1.0), "y", ["x"], constant=False).first()
    assert free.coef == pytest.approx(17 / 14)


def test_axes_turn_rows_and_turn_them_back(spark):
    x = np.random.default_rng(6).normal(size=(80, 2)) @ np.array([[2.0, 1.0], [0.0, 0.5]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double")
    axes = regress.pca(df, ["a", "b"], 2)
    p = regress.project(df, axes, ["a", "b"])
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert [r.eigenvalue for r in axes.orderBy("component").collect()] == pytest.approx(values)
    assert p.agg(F.var_samp("pc_1")).first()[0] == pytest.approx(values[0])
    back = regress.unproject(p.drop("a", "b"), axes, ["a", "b"]).orderBy("id").collect()
    assert np.array([[r.a, r.b] for r in back]) == pytest.approx(x)
    cov = spark.createDataFrame([("x", "x", 4.0), ("x", "y", 3.0), ("y", "y", 9.0)], "i string, j string, value double")
    corr = describe.to_correlation(cov)
    assert corr.where("i <> j").first().value == 0.5
    again = describe.to_covariance(corr, corr.where("i = j").select("i", F.col("std_i").alias("std")))
    assert again.where("i <> j").first().value == pytest.approx(3.0)


def test_volatility_scales_by_observed_ticks(spark):
    df = spark.createDataFrame([("a", "d", i, i, p) for i, p in enumerate((100.0, 101.0, 99.0, 102.0))], "symbol string, date string, s int, seq int, price double").withColumn("ts", F.timestamp_seconds(F.col("s") * 21600))
    rv = sum(math.log(b / a) ** 2 for a, b in zip((100, 101, 99), (101, 99, 102)))
    r = realized.realized_volatility(df).first()
    assert r.rv == pytest.approx(rv) and r.volatility == pytest.approx(math.sqrt(rv * 252 / (4 / 0.75)))
    lone = realized.realized_volatility(df.where("s = 0")).first()
    assert lone.rv == 0 and lone.volatility is None


def test_arma_estimates_and_residuals(spark):
    rng = np.random.default_rng(7)
    e, y = rng.normal(size=3000), [0.0]
    for t in range(1, 3000):
        y.append(0.5 + 0.6 * y[-1] + e[t] + 0.3 * e[t - 1])
    df = _frame(spark, y)
    p = arma.fit_arma(df, K, T, "ret", 1, 1, long_ar=6)
    p = spark.createDataFrame(p.collect(), p.schema)
    r = p.first()
    assert r.ar[0] == pytest.approx(0.6, abs=0.06) and r.ma[0] == pytest.approx(0.3, abs=0.07) and r.sigma2 == pytest.approx(1, abs=0.08)
    res = _path(arma.arma_residuals(df, K, T, "ret", p), "residual")
    want = [0.0]
    for t in range(1, 3000):
        want.append(y[t] - r.const - r.ar[0] * y[t - 1] - r.ma[0] * want[-1])
    assert res == pytest.approx(want)
    f = arma.forecast(arma.arma_residuals(df, K, T, "ret", p), K, T, "ret", p, 400).orderBy("h").collect()
    mean = r.const / (1 - r.ar[0])
    assert f[0]["mean"] == pytest.approx(r.const + r.ar[0] * y[-1] + r.ma[0] * want[-1]) and f[-1]["mean"] == pytest.approx(mean, rel=1e-6)
    assert f[-1]["var"] == pytest.approx(r.sigma2 * (1 + (r.ar[0] + r.ma[0]) ** 2 / (1 - r.ar[0] ** 2)), rel=1e-6)
    assert arma.stability(p).select("stationary", "invertible").first() == (True, True)
    best = arma.choose_order(df, K, T, "ret", 1, 1, "bic").first()
    assert (best.p, best.q) == (1, 1)


def test_roots_by_step_down(spark):
    rng = np.random.default_rng(8)
    rows = [rng.uniform(-1.2, 1.2, rng.integers(0, 4)).tolist() for _ in range(80)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(rows)], "id int, w array<double>").withColumn("ok", arma.roots_outside(F.col("w")))
    for r in df.collect():
        roots = np.roots([*(-v for v in reversed(r.w)), 1.0]) if r.w else np.array([2.0])
        assert r.ok == bool((np.abs(roots) > 1).all()), r


def test_vector_autoregression(spark):
    rng, a = np.random.default_rng(9), np.array([[0.5, 0.2], [-0.1, 0.3]])
    x = np.zeros((400, 2))
    for t in range(1, 400):
        x[t] = a @ x[t - 1] + rng.normal(size=2)
    rows = [(n, t, float(x[t, k])) for k, n in enumerate("uv") for t in range(400)]
    panel = spark.createDataFrame(rows, "asset string, ts int, value double")
    fit = arma.var_fit(panel, ["u", "v"], 1)
    z = np.c_[np.ones(399), x[:-1]]
    want = np.linalg.lstsq(z, x[1:], rcond=None)[0]
    got = {(r.equation, r.term): r.coef for r in fit.collect()}
    assert [got[e, t] for e in "uv" for t in ("const", "u_1", "v_1")] == pytest.approx(want.T.ravel())
    cov = np.array([[1.0, 0.3], [0.3, 2.0]])
    irf = {(r.response, r.shock, r.h): (r.irf, r.fevd) for r in arma.var_responses(fit, ["u", "v"], 1, 3, cov).collect()}
    root, b = np.linalg.cholesky(cov), want[1:].T
    assert irf["u", "v", 2][0] == pytest.approx((b @ b @ root)[0, 1])
    assert sum(irf["v", s, 3][1] for s in "uv") == pytest.approx(1) and irf["u", "v", 0][1] == 0


def test_fits_find_the_likeliest(spark):
    r = _garch(1500, 3)
    for model in fits.SPACE:
        f = fits.fit_series(r[:400], model)
        p = {k: np.array([v]) for k, v in f.items() if k != "loglik"}
        v = fits.paths(model, r[:400], p)[:, 0]
        assert f["loglik"] == pytest.approx(-0.5 * (np.log(2 * np.pi * v) + r[:400] ** 2 / v).sum())
    best = fits.fit_series(r, "garch")
    level = float((r**2).mean())
    for a in np.linspace(0.01, 0.3, 12):
        for b in np.linspace(0.3, 0.98, 20):
            if a + b < 0.999:
                v = fits.paths("garch", r, {"omega": np.array([level * (1 - a - b)]), "alpha": np.array([a]), "beta": np.array([b])})[:, 0]
                assert best["loglik"] >= -0.5 * (np.log(2 * np.pi * v) + r**2 / v).sum() - 1e-3
    assert best["alpha"] == pytest.approx(0.1, abs=0.05) and best["beta"] == pytest.approx(0.85, abs=0.1)
    df = _frame(spark, r[:300]).union(_frame(spark, [0.0] * 50, "flat")).union(_frame(spark, [1.0], "short"))
    got = fits.fit_panel(df, K, T, "tarch").collect()
    assert [(x.k, x.n) for x in got] == [("a", 300)] and got[0].aic == pytest.approx(8 - 2 * got[0].loglik)
    both = fits.compare_models([fits.fit_panel(df, K, T, m) for m in ("garch", "igarch")], K)
    assert both.count() == 2 and both.where("best").count() == 1


def test_forecasts_run_to_the_level(spark):
    params = spark.createDataFrame([("a", "garch", 0.1, 0.1, 0.0, 0.8, 2.0, 0.9), ("a", "egarch", -0.1, 0.2, -0.05, 0.9, 2.0, 0.9), ("a", "igarch", 0.1, 0.1, 0.0, 0.9, 2.0, 1.0), ("a", "aparch", 0.1, 0.1, 0.2, 0.8, 1.5, 0.9)], "k string, model string, omega double, alpha double, gamma double, beta double, delta double, persistence double")
    last = spark.createDataFrame([("a", 0.5, 2.0)], "k string, r double, v double")
    f = {(r.model, r.h): r["var"] for r in fits.forecast(last, params, K, 300).collect()}
    lv = {r.model: r.unconditional for r in fits.levels(params).collect()}
    assert lv["igarch"] is None and all(f[m, 300] == pytest.approx(lv[m], rel=1e-6) for m in ("garch", "egarch", "aparch"))
    assert f["garch", 1] == pytest.approx(0.1 + 0.1 * 0.25 + 0.8 * 2) and f["igarch", 3] - f["igarch", 2] == pytest.approx(0.1)
    curve = {r.model: r["var"] for r in fits.news_impact(fits.levels(params).where("model <> 'igarch'"), [0.0]).collect()}
    assert curve["garch"] == pytest.approx(0.1 + 0.8 * lv["garch"])
    q = fits.forecast_quantiles(fits.forecast(last, params.where("model = 'garch'"), K, 1), [0.05, 0.5], "t", 5.0).orderBy("p").collect()
    assert q[1]["quantile"] == pytest.approx(0, abs=1e-6) and dist.cdf(np.array([q[0]["quantile"] / math.sqrt(f["garch", 1])]), "t", 5.0)[0] == pytest.approx(0.05)


def test_fractional_weights_and_path(spark):
    lam = fits.figarch_weights(0.4, 0.2, 0.3, 40)
    series_ = np.zeros(41)  # 1 - (1 - phi L)(1 - L)^d / (1 - beta L)
    delta, frac = 1.0, [1.0]
    for k in range(1, 41):
        delta *= (k - 1 - 0.4) / k
        frac.append(delta)
    num = np.convolve(frac, [1, -0.2])[:41]
    for k in range(41):
        series_[k] = num[k] + (0.3 * series_[k - 1] if k else 0)
    assert lam == pytest.approx((-series_[1:]).tolist())
    r = np.random.default_rng(1).normal(size=100)
    got = _path(fits.figarch(_frame(spark, r), K, T, 0.1, 0.4, 0.2, 0.3, 40))
    want = [(r**2).mean()] * 40 + [0.1 / 0.7 + sum(w * r[t - 1 - j] ** 2 for j, w in enumerate(lam)) for t in range(40, 100)]
    assert got == pytest.approx(want)
    f = fits.figarch_forecast(_frame(spark, r), K, T, 0.1, 0.4, 0.2, 0.3, 40, 2).orderBy("h").collect()
    one = 0.1 / 0.7 + sum(w * r[99 - j] ** 2 for j, w in enumerate(lam))
    assert f[0]["var"] == pytest.approx(one) and f[1]["var"] == pytest.approx(0.1 / 0.7 + lam[0] * one + sum(w * r[99 - j] ** 2 for j, w in enumerate(lam[1:])))


def test_covariance_paths_by_matrices(spark):
    rng = np.random.default_rng(10)
    r = rng.normal(size=(60, 2)) @ np.array([[1.0, 0.4], [0.0, 0.8]])
    rows = [(n, dt.datetime(2020, 1, 1) + dt.timedelta(days=t), float(r[t, k])) for k, n in enumerate("uv") for t in range(60)]
    df = spark.createDataFrame(rows, "asset string, ts timestamp, ret double")
    c, a, b = np.array([[0.3, 0.0], [0.1, 0.2]]), np.array([[0.3, 0.05], [0.0, 0.2]]), np.array([[0.9, 0.0], [0.02, 0.93]])
    path = multivariate.bekk(multivariate.wide_returns(df, ["u", "v"]), c, a, b)
    h = [r.T @ r / 60]
    for t in range(1, 60):
        h.append(c @ c.T + a.T @ np.outer(r[t - 1], r[t - 1]) @ a + b.T @ h[-1] @ b)
    got = path.orderBy("ts").collect()
    assert np.array([x.cov for x in got]) == pytest.approx(np.array(h).reshape(60, 4))
    ahead = c @ c.T + a.T @ np.outer(r[59], r[59]) @ a + b.T @ h[59] @ b
    f = multivariate.bekk_forecast(path, c, a, b, 2).orderBy("h").collect()
    assert f[0]["cov"] == pytest.approx(ahead.ravel()) and f[1]["cov"] == pytest.approx((c @ c.T + a.T @ ahead @ a + b.T @ ahead @ b).ravel())
    s = multivariate.standardized_residuals(path).orderBy("ts").collect()
    for x, m, y in zip(s, h, r):
        assert x.z == pytest.approx(np.linalg.solve(np.linalg.cholesky(m), y))
        assert x.loglik == pytest.approx(-math.log(2 * math.pi) - 0.5 * math.log(np.linalg.det(m)) - 0.5 * y @ np.linalg.solve(m, y))
    t = multivariate.standardized_residuals(path, "t", 1e6).agg(F.sum("loglik")).first()[0]
    assert t == pytest.approx(sum(x.loglik for x in s), rel=1e-3)


def test_dynamic_correlations_by_matrices(spark):
    rng = np.random.default_rng(11)
    z = rng.normal(size=(80, 3)) @ np.array([[1, 0.5, 0.2], [0, 0.9, 0.1], [0, 0, 0.9]])
    rows = [(n, t, float(z[t, k]), 1.0) for k, n in enumerate("uvw") for t in range(80)]
    path = spark.createDataFrame(rows, "asset string, ts int, ret double, var double")
    zz = multivariate.standardized_pairs(path)
    m = z.T @ z / 80
    q, want = m.copy(), []
    for t in range(80):
        if t:
            q = 0.1 * m + 0.1 * np.outer(z[t - 1], z[t - 1]) + 0.8 * q
        d = np.sqrt(np.diag(q))
        want.append(q / np.outer(d, d))
    got = {(r.ts, r.i, r.j): r["corr"] for r in multivariate.dynamic_correlation(zz, 0.1, 0.8).collect()}
    assert all(got[t, a, b] == pytest.approx(want[t]["uvw".index(a), "uvw".index(b)]) for t in (0, 1, 40, 79) for a, b in ("uv", "uw", "vw", "uu"))
    fit = multivariate.fit_dynamic_correlation(zz, [(0.1, 0.8), (0.02, 0.5), (0.5, 0.6)]).collect()
    total = sum(-0.5 * (math.log(1 - c * c) + (z[t, i] ** 2 + z[t, j] ** 2 - 2 * c * z[t, i] * z[t, j]) / (1 - c * c) - z[t, i] ** 2 - z[t, j] ** 2) for t in range(80) for i, j in ((0, 1), (0, 2), (1, 2)) for c in [want[t][i, j]])
    assert len(fit) == 2 and [r.loglik for r in fit if r.a == 0.1] == [pytest.approx(total)] and fit[0].loglik >= fit[1].loglik


@pytest.mark.parametrize(("family", "nu", "lam"), [("normal", 8, 0), ("t", 5, 0), ("ged", 1.3, 0), ("skewt", 6, -0.4), ("laplace", 1, 0)])
def test_distributions_agree_with_their_densities(spark, family, nu, lam):
    x = np.linspace(-25, 25, 100_001)
    f = np.exp(dist.log_pdf(x, family, nu, lam))
    assert np.trapezoid(f, x) == pytest.approx(1, abs=2e-4) and np.trapezoid(f * x, x) == pytest.approx(0, abs=2e-3) and np.trapezoid(f * x * x, x) == pytest.approx(1, abs=2e-2)
    assert np.trapezoid(f * np.abs(x), x) == pytest.approx(dist.mean_abs(family, nu, lam), abs=2e-3)
    steps = np.cumsum((f[1:] + f[:-1]) / 2 * np.diff(x))
    assert dist.cdf(x[1::5000], family, nu, lam) == pytest.approx(steps[::5000], abs=2e-4)
    p = np.array([0.001, 0.05, 0.3, 0.5, 0.9, 0.999])
    assert dist.cdf(dist.ppf(p, family, nu, lam), family, nu, lam) == pytest.approx(p, abs=1e-8)
    assert dist.ppf([0, 1, 2], family, nu, lam)[:2].tolist() == [-math.inf, math.inf] and np.isnan(dist.ppf([2.0], family, nu, lam)[0])
    df = spark.createDataFrame([(float(v),) for v in (-2.0, -0.1, 0.0, 1.5)] + [(None,)], "x double")
    got = df.select(dist.cdf_column("x", family, nu, lam).alias("c"), densities.log_pdf(F.col("x"), family, 0.0, 1.0, nu, lam).alias("l")).collect()
    assert [r.c for r in got[:4]] == pytest.approx(dist.cdf([-2.0, -0.1, 0.0, 1.5], family, nu, lam)) and got[4].c is None
    assert [r.l for r in got[:4]] == pytest.approx(dist.log_pdf([-2.0, -0.1, 0.0, 1.5], family, nu, lam))


def test_user_densities(spark):
    df = spark.createDataFrame([(float(v),) for v in np.linspace(-12, 12, 4001)], "x double")
    p = dist.asymmetric_laplace(F.col("x"), 0.3, 0.7, 1.4)
    m = dist.normal_mixture(F.col("x"), 0.3, (-1.0, 0.5), (0.5, 1.0))
    r = df.select(p["pdf"].alias("p"), p["cdf"].alias("c"), m["pdf"].alias("mp"), m["cdf"].alias("mc"), dist.asymmetric_laplace_quantile(p["cdf"], 0.3, 0.7, 1.4).alias("q"), "x").toPandas()
    step = 24 / 4000
    assert np.cumsum(r.p.to_numpy()) * step == pytest.approx(r.c.to_numpy(), abs=5e-3) and np.cumsum(r.mp.to_numpy()) * step == pytest.approx(r.mc.to_numpy(), abs=5e-3)
    mid = (r.c > 1e-6) & (r.c < 1 - 1e-6)
    assert r.q[mid].to_numpy() == pytest.approx(r.x[mid].to_numpy(), abs=1e-6)


def test_family_fits(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_t(5, 3000) * 0.02 + 0.01
    df = _frame(spark, x).union(_frame(spark, [1.0, 1.0], "flat"))
    r = densities.fit_family(df, K, "ret", "t").collect()
    assert len(r) == 1 and 3.5 < r[0].nu < 7.5
    for nu in (3.0, 4.0, 6.0, 10.0):
        for s in (0.9, 1.0, 1.1):
            assert r[0].loglik >= (dist.log_pdf((x - x.mean()) / (x.std() * s), "t", nu) - math.log(x.std() * s)).sum() - 0.2
    n = densities.fit_family(df, K, "ret", "normal").first()
    assert n.loglik == pytest.approx((dist.log_pdf((x - x.mean()) / x.std()) - math.log(x.std())).sum()) and n.nu is None
    s = densities.fit_family(df, K, "ret", "skewt").first()
    assert abs(s.lam) < 0.15 and s.loglik >= r[0].loglik - 1
    q = densities.quantile_table(densities.fit_family(df, K, "ret", "ged"), K, [0.1, 0.9], "ged").orderBy("p").collect()
    assert [v.quantile for v in q] == pytest.approx(np.quantile(x, [0.1, 0.9]), rel=0.1)


def test_goodness_of_fit(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=500)
    df = _frame(spark, x)
    z = np.sort((x - x.mean()) / x.std())
    f = dist.cdf(z)
    i = np.arange(1, 501)
    d = max((i / 500 - f).max(), (f - (i - 1) / 500).max())
    k = densities.kolmogorov_smirnov(df, K, "ret").first()
    assert (k.statistic, k.p_value) == pytest.approx((d, math.exp(-1000 * d * d)))
    li = densities.lilliefors(df, K, "ret").first()
    assert li.statistic == pytest.approx(d) and li.crit_5 == pytest.approx(0.886 / math.sqrt(500)) and li.statistic < li.crit_1
    fit = densities.qq_fit(densities.qq(df, K, "ret"), K, "ret").first()
    assert fit.r2 > 0.99 and fit.n == 500
    pits = spark.createDataFrame([("a", t, float(p)) for t, p in enumerate(dist.cdf(x))], "k string, t int, pit double")
    b = densities.berkowitz(pits, K, T, "pit").first()
    y, lag = x[1:], x[:-1]
    slope, const = np.polyfit(lag, y, 1)
    s2 = ((y - const - slope * lag) ** 2).mean()
    stat = (y**2).sum() - 499 * (math.log(s2) + 1)
    assert b.statistic == pytest.approx(stat, abs=1e-5) and 0 < b.p_value <= 1
    assert densities.berkowitz(pits.withColumn("pit", F.col("pit") ** 2), K, T, "pit").first().p_value < 1e-6


def test_unit_roots_and_trends(spark):
    rng = np.random.default_rng(14)
    walk, noise = rng.normal(size=300).cumsum(), rng.normal(size=300)
    df = _frame(spark, walk).union(_frame(spark, noise, "b"))
    for trend, extra in (("n", 0), ("c", 1), ("ct", 2), ("ctt", 3)):
        got = {r.k: r for r in diagnostics.unit_root(df, K, T, "ret", 2, trend).collect()}
        y = walk
        dy, t = np.diff(y), np.arange(4, 301.0)
        z = np.c_[y[2:-1], dy[1:-1], dy[:-2], *[t**p for p in range(extra)]] if extra else np.c_[y[2:-1], dy[1:-1], dy[:-2]]
        beta, rss, *_ = np.linalg.lstsq(z, dy[2:], rcond=None)
        se = math.sqrt(rss[0] / (len(z) - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0])
        assert got["a"].statistic == pytest.approx(beta[0] / se, rel=1e-4) and got["a"].p_value > 0.05 and got["b"].p_value < 1e-6
        assert got["b"].statistic < got["b"].crit_1 < got["b"].crit_5 < got["b"].crit_10
    assert diagnostics.unit_root(df, K, T, "ret", 4, "c", choose=True).count() == 2


def test_regression_tests_by_numpy(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(400, 2))
    y = 1 + x @ np.array([1.0, -2.0]) + 0.3 * x[:, 0] ** 2 + rng.normal(size=400) * np.exp(0.5 * x[:, 1])
    df = spark.createDataFrame([("a", *map(float, r), float(v)) for r, v in zip(x, y)], "k string, u double, v double, y double")
    one = np.c_[np.ones(400), x]
    fitted = one @ np.linalg.lstsq(one, y, rcond=None)[0]
    e = y - fitted
    rows = regress.predict(df, regress.ols(df, "y", ["u", "v"], K), "y", ["u", "v"], K)
    r2 = lambda z, t: 1 - ((t - z @ np.linalg.lstsq(z, t, rcond=None)[0]) ** 2).sum() / ((t - t.mean()) ** 2).sum()
    w = diagnostics.white(rows, K, ["u", "v"], "residual").first()
    assert w.statistic == pytest.approx(400 * r2(np.c_[one, x**2, x[:, 0] * x[:, 1]], e**2)) and w.df == 5
    b = diagnostics.breusch_pagan(rows, K, ["u", "v"], "residual").first()
    assert b.statistic == pytest.approx(400 * r2(one, e**2)) and b.df == 2
    t = diagnostics.reset(df, K, "y", ["u", "v"], 3).first()
    r0, r1 = r2(one, y), r2(np.c_[one, fitted**2, fitted**3], y)
    assert t.statistic == pytest.approx((r1 - r0) / 2 / ((1 - r1) / 395), rel=1e-6)


def test_runs_of_near_values(spark):
    x = np.random.default_rng(16).normal(size=130)
    for block in (512, 20):
        r = diagnostics.bds(_frame(spark, x), K, T, "ret", 3, 0.7, block).first()
        near = np.abs(x[:, None] - x) < 0.7 * x.std(ddof=1)
        n = 128
        one = near[:n, :n]
        run = one & near[1 : n + 1, 1 : n + 1] & near[2 : n + 2, 2 : n + 2]
        off = ~np.eye(n, dtype=bool)
        c, m = (one & off).sum() / (n * (n - 1)), (run & off).sum() / (n * (n - 1))
        deg = (one & off).sum(1)
        k = (deg * (deg - 1)).sum() / (n * (n - 1) * (n - 2))
        var = 4 * (k**3 + 2 * (k**2 * c**2 + k * c**4) + 4 * c**6 - 9 * k * c**4)
        assert (r.c1, r.cm, r.n) == (pytest.approx(c), pytest.approx(m), n) and r.statistic == pytest.approx(math.sqrt(n) * (m - c**3) / math.sqrt(var))


def test_bootstrap_draws_cover_every_replicate(spark):
    x = np.random.default_rng(17).normal(size=120)
    df = _frame(spark, x)
    sizes = df.groupBy("k").agg(F.count("*").alias("n"))
    for draws in (bootstrap.stationary_draws(sizes, 30, 0.2), bootstrap.block_draws(sizes, 30, 7), bootstrap.block_draws(sizes, 30, 7, replace=False)):
        s = bootstrap.resampled(df, K, T, "ret", draws)
        got = s.groupBy("rep").agg(F.count("*").alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count_distinct("value").alias("u")).collect()
        assert all((r.n, r.a, r.b) == (120, 0, 119) for r in got) and len(got) == 30
        if "_u" in draws.columns:
            assert all(r.u == 120 for r in got) and len({tuple(v.value for v in s.where(f"rep = {k}").orderBy("pos").collect()) for k in (0, 1)}) == 2
        else:
            sums = bootstrap._moments(draws, bootstrap.prefix_sums(df, K, T, "ret"), K)
            both = {r.rep: (r.m, r.s) for r in got}
            assert all((r["mean"], r["std"]) == (pytest.approx(both[r.rep][0], abs=1e-12), pytest.approx(both[r.rep][1])) for r in sums.collect())
    lengths = [r._len for r in bootstrap.stationary_draws(sizes, 400, 0.2).collect()]
    assert np.mean(lengths) == pytest.approx(5, rel=0.1)
    stat = bootstrap.statistic(bootstrap.resampled(df, K, T, "ret", bootstrap.block_draws(sizes, 5, 7)), K, np.ptp)
    assert stat.count() == 5 and stat.agg(F.max("stat")).first()[0] <= np.ptp(x)


def test_intervals_and_p_values(spark):
    rng = np.random.default_rng(18)
    boot = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(rng.normal(0.5, 0.2, 2000))], "k string, rep int, mean double")
    original = spark.createDataFrame([("a", 0.5)], "k string, mean double")
    bc = bootstrap.bias_corrected(boot, original, K, "mean").first()
    assert (bc.lo, bc.hi) == (pytest.approx(0.11, abs=0.04), pytest.approx(0.89, abs=0.04))
    p = {s: bootstrap.p_value(boot, original, K, "mean", 0.0, s).first().p for s in ("two", "less", "greater")}
    assert p["two"] < 0.03 and p["less"] == pytest.approx(0.5, abs=0.05) and p["less"] + p["greater"] == pytest.approx(1, abs=1e-9)


def test_better_models_are_found(spark):
    rng = np.random.default_rng(19)
    base = rng.normal(1.0, 0.2, 200)
    rows = [(m, t, float(base[t] + s + rng.normal() * 0.1)) for m, s in (("bench", 0.0), ("good", -0.3), ("same", 0.0), ("bad", 0.4)) for t in range(200)]
    df = spark.createDataFrame(rows, "model string, t int, loss double")
    r = bootstrap.reality_check(df, "bench", 200, 0.2).first()
    assert r.p_value < 0.02 and r.models == 3
    assert bootstrap.reality_check(df.where("model in ('bench', 'bad')"), "bench", 200, 0.2).first().p_value > 0.9
    for kind in ("TR", "TSQ"):
        out = bootstrap.confidence_set(df, 200, 0.2, 0.1, kind).orderBy("step").collect()
        assert [x.model for x in out][0] == "bad" and [x.model for x in out if x.inside] == ["good"] and all(a.p_value <= b.p_value for a, b in zip(out, out[1:]))
