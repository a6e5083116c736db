"""Queries of models, fits, tests and inference, next to the SQL that gives the same rows. ``catalog`` registers them with its own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.distributions import asymmetric_laplace, cdf_column, quantile_column
from ..operators import align, arma, bars, bootstrap, clean, densities, describe, diagnostics, fits, multivariate, realized, regress, series, volatility
from .tables import DAILY, PANEL, PRETS, RETS, TICKS, daily, daily_returns, panel, panel_returns, table, ticks
from .tools import query, rounded

_D, _T = ["asset"], ["ts"]
_R = f"{RETS}, o AS (SELECT asset, ts, ret, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i, count(*) OVER (PARTITION BY asset) AS n, avg(ret * ret) OVER (PARTITION BY asset) AS v0 FROM rets WHERE ret IS NOT NULL)"


def _day():
    return F.to_date("ts").cast("string").alias("day")


def _rets(spark, d):
    return daily_returns(spark, d).select("asset", "ts", "ret")


# -- ranks, matrices, cleaning, alignment -------------------------------------


@query("""SELECT round(sum(sign(a.p_size - b.p_size) * sign(a.p_retailprice - b.p_retailprice)) / (any_value(n) * (any_value(n) - 1) / 2), 8) AS kendall, any_value(n) AS n
FROM part a JOIN part b ON a.p_partkey < b.p_partkey, (SELECT count(*) AS n FROM part)""")
def a6_kendall(spark, d):
    return rounded(describe.kendall(table(spark, d, "part"), "p_size", "p_retailprice"), 8, "kendall")


@query(f"""WITH {DAILY}, c AS (SELECT ts FROM daily GROUP BY ts HAVING count(*) = 5), p AS (SELECT a.asset AS i, b.asset AS j, a.value AS x, b.value AS y FROM daily a JOIN daily b ON a.ts = b.ts AND a.asset <= b.asset JOIN c ON c.ts = a.ts)
SELECT i, j, round(corr(x, y), 8) AS corr, round(covar_samp(x, y), 0) AS cov FROM p GROUP BY ALL""")
def a9_correlation_of_covariance(spark, d):
    """Covariances at common times to correlations and back."""
    p = align.align(daily(spark, d), "inner")
    both = align.pairs(p).groupBy("i", "j").agg(F.covar_samp("value_i", "value_j").alias("value"))
    corr = describe.to_correlation(both)
    stds = corr.where("i = j").select("i", F.col("std_i").alias("std"))
    back = describe.to_covariance(corr, stds).select("i", "j", F.col("value").alias("cov"))
    return rounded(rounded(corr.select("i", "j", F.col("value").alias("corr")).join(back, ["i", "j"]), 8, "corr"), 0, "cov")


@query(f"WITH {PANEL} SELECT asset, count(*) AS n, round(sum(value), 2) AS total FROM panel WHERE (epoch_us(ts) // 86400000000 + asset) % 3 <> 0 GROUP BY asset")
def c1_drop_missing(spark, d):
    hole = F.pmod(F.floor(F.unix_micros("ts") / 86_400_000_000) + F.col("asset"), F.lit(3)) == 0
    p = panel(spark, d).withColumn("value", F.when(~hole, F.col("value")))
    return rounded(clean.drop_missing(p).groupBy("asset").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 2, "total")


@query(None)
def c4_spline(spark, d):
    hole = F.pmod(F.floor(F.unix_micros("ts") / 86_400_000_000), F.lit(7)) == 0
    p = daily(spark, d).withColumn("value", F.when(~hole, F.col("value")))
    return rounded(clean.spline(p, _D, _T, "value"), 2, "value").select("asset", _day(), "value")


def _nearest(gap: str, other: str) -> str:
    """SQL of the mean ``gap`` of the three rows nearest by ``other``."""
    return f"""(SELECT id, avg(v) AS v FROM (SELECT x.id, y.{gap} AS v, row_number() OVER (PARTITION BY x.id ORDER BY sqrt((x.{other} - y.{other}) * (x.{other} - y.{other}) * 2), y.id) AS k
FROM h x JOIN h y ON x.{gap} IS NULL AND y.{gap} IS NOT NULL AND x.id <> y.id AND x.{other} IS NOT NULL AND y.{other} IS NOT NULL) WHERE k <= 3 GROUP BY id)"""


@query(f"""WITH h AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS a, CASE WHEN c_custkey % 10 <> 1 THEN c_nationkey::DOUBLE END AS b FROM customer)
SELECT h.id, round(coalesce(h.a, p.v), 6) AS balance, round(coalesce(h.b, q.v), 6) AS nation FROM h LEFT JOIN {_nearest("a", "b")} p ON p.id = h.id LEFT JOIN {_nearest("b", "a")} q ON q.id = h.id""")
def c6_knn_impute(spark, d):
    """Balances and nations missing from some customers, each from the three nearest by the other; rows that miss both keep their gaps."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    holes = c.select(k.alias("id"), F.when(k % 9 != 0, F.col("c_acctbal")).alias("a"), F.when(k % 10 != 1, F.col("c_nationkey").cast("double")).alias("b"))
    out = clean.knn_impute(holes, "id", ["a", "b"], 3)
    return rounded(out.select("id", F.col("a").alias("balance"), F.col("b").alias("nation")), 6, "balance", "nation")


@query(f"""WITH {PANEL}, m AS (SELECT asset AS old, asset + 1 AS new, min(ts) + INTERVAL 500 DAY AS ts, 0.5 AS value FROM panel GROUP BY asset),
n AS (SELECT m.old, m.ts, any_value(m.value) AS value, arg_min(p.value, p.ts) AS np FROM m JOIN panel p ON p.asset = m.new AND p.ts >= m.ts GROUP BY ALL),
b AS (SELECT m.old, m.ts, arg_max(p.value, p.ts) AS op FROM m JOIN panel p ON p.asset = m.old AND p.ts < m.ts GROUP BY ALL)
SELECT n.old AS symbol, n.ts::DATE::VARCHAR AS day, round(value * np / op, 8) AS factor FROM n JOIN b ON n.old = b.old AND n.ts = b.ts""")
def j9_merger_factors(spark, d):
    p = panel(spark, d).select(F.col("asset").alias("symbol"), "ts", F.col("value").alias("price"))
    m = p.groupBy(F.col("symbol").alias("old_symbol")).agg((F.min("ts") + F.expr("interval 500 days")).alias("ts"), F.lit(0.5).alias("value"))
    m = m.withColumn("new_symbol", F.col("old_symbol") + 1)
    return rounded(align.merger_factors(p, m), 8, "factor").select("symbol", _day(), "factor")


@query(f"""WITH {DAILY}, g AS (SELECT unnest(generate_series(date_trunc('day', min(ts)), max(ts), INTERVAL 1 DAY)) AS ts FROM daily), a AS (SELECT DISTINCT asset FROM daily)
SELECT a.asset, g.ts::DATE::VARCHAR AS day, round(value, 3) AS value FROM g CROSS JOIN a LEFT JOIN daily d ON d.ts = g.ts AND d.asset = a.asset""")
def j5_align_grid(spark, d):
    return rounded(align.align_grid(daily(spark, d), 86_400), 3, "value").select("asset", _day(), "value")


@query(None)
def w11_hodrick_prescott(spark, d):
    return rounded(series.hodrick_prescott(daily(spark, d), _D, _T, "value", 1600.0), 2, "trend").select("asset", _day(), "trend")


# -- realized measures --------------------------------------------------------


_SAMPLED = f"""{TICKS}, c AS (SELECT *, (us - min(us) OVER (PARTITION BY symbol, date)) // 1800000000 AS bucket FROM ticks),
s AS (SELECT symbol, date, bucket, arg_min(price, (us, seq)) AS price, min(us) AS us FROM c GROUP BY ALL),
r AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY symbol, date ORDER BY us)) AS ret FROM s)"""


@query(f"""WITH {_SAMPLED}, x AS (SELECT symbol, date, ret, row_number() OVER (PARTITION BY symbol, date ORDER BY us) AS i FROM r WHERE ret IS NOT NULL),
h AS (SELECT symbol, date, trunc(0.5 * pow(count(*), 1 / 3.0::DOUBLE) * median(abs(ret)) / 0.6745)::INT AS h FROM x GROUP BY ALL),
k AS (SELECT x.symbol, x.date, sum(x.ret * y.ret * 2 * CASE WHEN k.k / h.h::DOUBLE <= 0.5 THEN 1 - 6 * (k.k / h.h::DOUBLE) ** 2 + 6 * (k.k / h.h::DOUBLE) ** 3 ELSE 2 * (1 - k.k / h.h::DOUBLE) ** 3 END) AS s
FROM x JOIN h USING (symbol, date) JOIN range(1, 60) k(k) ON k.k <= h.h JOIN x y ON y.symbol = x.symbol AND y.date = x.date AND y.i = x.i - k.k GROUP BY ALL),
v AS (SELECT symbol, date, sum(ret * ret) AS rv FROM x GROUP BY ALL)
SELECT symbol, date, round(rv + coalesce(s, 0), 6) AS rk FROM v LEFT JOIN k USING (symbol, date)""")
def m4_automatic_kernel(spark, d):
    return rounded(realized.realized_kernel(bars.sample_calendar(ticks(spark, d), 1800), None), 6, "rk")


@query(f"""WITH {_SAMPLED}, v AS (SELECT symbol, date, coalesce(sum(ret * ret), 0) AS rv, count(ret) AS n_returns, sqrt(coalesce(sum(ret * ret), 0) * 252 * (nullif(max(us) - min(us), 0) / 86400000000.0) / count(*)) AS volatility FROM r GROUP BY ALL),
f AS (SELECT symbol, date, sum(f * f) AS f FROM (SELECT symbol, date, avg(ret) OVER (PARTITION BY symbol, date ORDER BY us ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS f FROM r WHERE ret IS NOT NULL) GROUP BY ALL),
l AS (SELECT symbol, date, ret, lag(ret) OVER w AS l1, lag(ret, 2) OVER w AS l2 FROM r WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol, date ORDER BY us)),
k AS (SELECT symbol, date, sum(ret * ret) + 2 * (1 - 6 / 9.0::DOUBLE + 6 / 27.0::DOUBLE) * coalesce(sum(ret * l1), 0) + 2 * 2 / 27.0::DOUBLE * coalesce(sum(ret * l2), 0) AS rk FROM l GROUP BY ALL)
SELECT symbol, date, round(rv, 6) AS rv, n_returns, round(volatility, 6) AS volatility, round(f, 6) AS rv_filtered, round(rk, 6) AS rk FROM v LEFT JOIN f USING (symbol, date) LEFT JOIN k USING (symbol, date)""")
def m7_measures(spark, d):
    m = realized.measures(ticks(spark, d), 1800)
    return rounded(m, 6, "rv", "volatility", "rv_filtered", "rk").select("symbol", "date", "rv", "n_returns", "volatility", "rv_filtered", "rk")


# -- regressions on lags ------------------------------------------------------

_AR1 = f"{_R}, l AS (SELECT *, lag(ret) OVER (PARTITION BY asset ORDER BY i) AS x FROM o), f AS (SELECT asset, regr_slope(ret, x) AS phi, regr_intercept(ret, x) AS c, regr_count(ret, x) AS m, (regr_syy(ret, x) - regr_sxy(ret, x) ** 2 / regr_sxx(ret, x)) / regr_count(ret, x) AS s2 FROM l GROUP BY asset)"


@query(f"WITH {_AR1} SELECT asset, round(c, 8) AS const, round(phi, 8) AS ar1, round(s2, 8) AS sigma2, m AS n, round(-0.5::DOUBLE * m * (ln(2 * pi() * s2) + 1), 4) AS loglik, round(4 + m * (ln(2 * pi() * s2) + 1), 4) AS aic, round(2 * ln(m) + m * (ln(2 * pi() * s2) + 1), 4) AS bic, abs(phi) < 1 AS stationary FROM f")
def x6_ar(spark, d):
    p = arma.stability(arma.fit_arma(_rets(spark, d), _D, _T, "ret", 1))
    p = p.select("asset", "const", F.col("ar")[0].alias("ar1"), "sigma2", "n", "loglik", "aic", "bic", "stationary")
    return rounded(rounded(p, 8, "const", "ar1", "sigma2"), 4, "loglik", "aic", "bic")


def _two(y: str, a: str, b: str, source: str, keys: str = "asset") -> str:
    """SQL of a regression on two columns: b1, b2, b0 and r2."""
    return f"""s AS (SELECT {keys}, covar_pop({a}, {a}) AS saa, covar_pop({b}, {b}) AS sbb, covar_pop({a}, {b}) AS sab, covar_pop({a}, {y}) AS say, covar_pop({b}, {y}) AS sby, var_pop({y}) AS syy, avg({a}) AS ma, avg({b}) AS mb, avg({y}) AS my, count(*) AS n
FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND {y} IS NOT NULL GROUP BY {keys}),
t AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS b1, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS b2 FROM s),
fit AS (SELECT *, my - b1 * ma - b2 * mb AS b0, (b1 * say + b2 * sby) / syy AS r2 FROM t)"""


_ARMA11 = f"""{_AR1}, e AS (SELECT l.*, ret - c - phi * x AS e FROM l JOIN f USING (asset)), g AS (SELECT *, lag(e) OVER (PARTITION BY asset ORDER BY i) AS le FROM e),
{_two("ret", "x", "le", "g")}"""


@query(f"WITH {_ARMA11} SELECT asset, round(b0, 7) AS const, round(b1, 6) AS ar1, round(b2, 6) AS ma1, n FROM fit")
def x6_arma(spark, d):
    p = arma.fit_arma(_rets(spark, d), _D, _T, "ret", 1, 1, long_ar=1).select("asset", "const", F.col("ar")[0].alias("ar1"), F.col("ma")[0].alias("ma1"), "n")
    return rounded(rounded(p, 7, "const"), 6, "ar1", "ma1")


@query(f"WITH {_R}, l AS (SELECT *, lag(ret) OVER (PARTITION BY asset ORDER BY i) AS x, isodow(ts)::DOUBLE AS dow FROM o), {_two('ret', 'x', 'dow', 'l')} SELECT asset, round(b0, 7) AS const, round(b1, 7) AS ar1, round(b2, 7) AS exog1, n FROM fit")
def x7_armax(spark, d):
    r = _rets(spark, d).withColumn("dow", (F.weekday("ts") + 1).cast("double"))
    p = arma.fit_arma(r, _D, _T, "ret", 1, exog=["dow"]).select("asset", "const", F.col("ar")[0].alias("ar1"), F.col("exog")[0].alias("exog1"), "n")
    return rounded(p, 7, "const", "ar1", "exog1")


def _given(spark, d):
    """Parameters for every asset: a constant from its returns, weights 0.3 and 0.2."""
    return _rets(spark, d).groupBy("asset").agg((0.1 * F.avg("ret")).alias("const"), F.var_pop("ret").alias("sigma2")).withColumns({"ar": F.array(F.lit(0.3)), "ma": F.array(F.lit(0.2))})


_FILTER = f"""WITH RECURSIVE {_R}, k AS (SELECT asset, 0.1 * avg(ret) AS c, var_pop(ret) AS s2 FROM o GROUP BY asset), q AS (SELECT o.*, c, s2 FROM o JOIN k USING (asset)),
p AS (SELECT asset, ts, i, ret, c, s2, 0.0::DOUBLE AS e FROM q WHERE i = 1 UNION ALL SELECT q.asset, q.ts, q.i, q.ret, q.c, q.s2, q.ret - q.c - 0.3 * p.ret - 0.2 * p.e FROM p JOIN q ON q.asset = p.asset AND q.i = p.i + 1)"""


@query(f"{_FILTER} SELECT asset, ts::DATE::VARCHAR AS day, round(e, 8) AS residual FROM p")
def x8_arma_residuals(spark, d):
    return rounded(arma.arma_residuals(_rets(spark, d), _D, _T, "ret", _given(spark, d)), 8, "residual").select("asset", _day(), "residual")


@query(f"""{_FILTER}, l AS (SELECT asset, arg_max(ret, i) AS y, arg_max(e, i) AS e, any_value(c) AS c, any_value(s2) AS s2 FROM p GROUP BY asset),
one AS (SELECT asset, c, s2, c + 0.3 * y + 0.2 * e AS f FROM l)
SELECT asset, h::INT AS h, round(c / 0.7 + (f - c / 0.7) * pow(0.3, h - 1), 8) AS mean, round(s2 * (1 + 0.25 * (1 - pow(0.09, h - 1)) / 0.91), 8) AS var FROM one, range(1, 7) r(h)""")
def x10_arma_forecast(spark, d):
    r, p = _rets(spark, d), _given(spark, d)
    return rounded(arma.forecast(arma.arma_residuals(r, _D, _T, "ret", p), _D, _T, "ret", p, 6), 8, "mean", "var")


@query(None)
def x9_arma_order(spark, d):
    return rounded(arma.choose_order(_rets(spark, d), _D, _T, "ret", 2, 1), 3, "aic")


_URGENT, _LOW = "1-URGENT", "5-LOW"


@query(f"""WITH {DAILY}, w AS (SELECT ts, max(value) FILTER (WHERE asset = '1-URGENT') AS u, max(value) FILTER (WHERE asset = '5-LOW') AS l FROM daily GROUP BY ts), c AS (SELECT * FROM w WHERE u IS NOT NULL AND l IS NOT NULL),
g0 AS (SELECT u, l, lag(u) OVER (ORDER BY ts) AS lu, lag(l) OVER (ORDER BY ts) AS ll FROM c), g AS (SELECT '1-URGENT' AS asset, u AS y, lu, ll FROM g0 UNION ALL SELECT '5-LOW', l, lu, ll FROM g0), {_two("y", "lu", "ll", "g")}
SELECT asset AS equation, unnest(['const', '1-URGENT_1', '5-LOW_1']) AS term, unnest([round(b0, 3), round(b1, 7), round(b2, 7)]) AS coef, round(r2, 8) AS r2, n FROM fit""")
def x13_var(spark, d):
    f = arma.var_fit(daily(spark, d), [_URGENT, _LOW], 1)
    exact = rounded(f.withColumn("c7", F.col("coef")), 7, "c7")
    exact = rounded(rounded(exact.withColumn("c3", F.col("coef")), 3, "c3"), 8, "r2")
    return exact.select("equation", "term", F.when(F.col("term") == "const", F.col("c3")).otherwise(F.col("c7")).alias("coef"), "r2", "n")


# -- principal components and partial autocorrelations with SQL ----------------


@query("""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) SELECT unnest([1, 2])::INT AS component, unnest([round(1 + abs(r), 8), round(1 - abs(r), 8)]) AS eigenvalue, unnest([round((1 + abs(r)) / 2, 8), round((1 - abs(r)) / 2, 8)]) AS ratio_total,
round(sqrt(0.5::DOUBLE), 8) AS loading FROM c""")
def x4_pca_pair(spark, d):
    p = regress.pca(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], 2, True)
    p = p.withColumn("loading", F.array_max("loadings")).select("component", "eigenvalue", "ratio_total", "loading")
    return rounded(p, 8, "eigenvalue", "ratio_total", "loading")


@query("""WITH m AS (SELECT avg(l_quantity) AS a, avg(l_extendedprice) AS b, var_samp(l_quantity) AS va, var_samp(l_extendedprice) AS vb, covar_samp(l_quantity, l_extendedprice) AS c FROM lineitem),
e AS (SELECT *, (va + vb) / 2 + sqrt((va - vb) ** 2 / 4 + c * c) AS top FROM m), v AS (SELECT *, c / sqrt(c * c + (top - va) ** 2) AS x, (top - va) / sqrt(c * c + (top - va) ** 2) AS y FROM e)
SELECT l_orderkey, l_linenumber, round(x * (l_quantity - a) + y * (l_extendedprice - b), 3) AS pc_1 FROM lineitem, v""")
def x5_project(spark, d):
    i, columns = table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]
    return rounded(regress.project(i, regress.pca(i, columns, 1), columns), 3, "pc_1").select("l_orderkey", "l_linenumber", "pc_1")


@query(f"""WITH {_R}, c AS (SELECT asset, i, ret - avg(ret) OVER (PARTITION BY asset) AS c FROM o), g AS (SELECT asset, c, lag(c) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(c, 3) OVER w AS c3 FROM c WINDOW w AS (PARTITION BY asset ORDER BY i)),
r AS (SELECT asset, sum(c * c1) / sum(c * c) AS r1, sum(c * c2) / sum(c * c) AS r2, sum(c * c3) / sum(c * c) AS r3 FROM g GROUP BY asset)
SELECT asset, unnest([1, 2, 3])::INT AS lag, unnest([round(r1, 7), round((r2 - r1 ** 2) / (1 - r1 ** 2), 7), round((r3 + r1 ** 3 + r1 * r2 ** 2 - 2 * r1 * r2 - r1 ** 2 * r3) / (1 + 2 * r1 ** 2 * r2 - r2 ** 2 - 2 * r1 ** 2), 7)]) AS pacf FROM r""")
def a8_pacf_short(spark, d):
    return rounded(describe.pacf(_rets(spark, d), _D, _T, "ret", 3), 7, "pacf").withColumn("lag", F.col("lag").cast("int"))


# -- volatility: fits, forecasts, levels ---------------------------------------

_CANDIDATES = [(0.02, 0.05, 0.9), (0.05, 0.1, 0.8), (0.1, 0.2, 0.6), (0.2, 0.1, 0.5)]
_PO = "po AS (SELECT asset, ts, ret, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i, avg(ret * ret) OVER (PARTITION BY asset) AS v0 FROM prets WHERE ret IS NOT NULL)"
_VALUES = ", ".join(f"({k}, {w}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE)" for k, (w, a, b) in enumerate(_CANDIDATES))


@query(f"""WITH RECURSIVE {PRETS}, {_PO}, k AS (SELECT * FROM (VALUES {_VALUES}) t(k, w, a, b)),
p AS (SELECT asset, i, k, w, a, b, ret, v0 AS v FROM po, k WHERE i = 1 UNION ALL SELECT po.asset, po.i, p.k, p.w, p.a, p.b, po.ret, p.w + p.a * p.ret * p.ret + p.b * p.v FROM p JOIN po ON po.asset = p.asset AND po.i = p.i + 1),
l AS (SELECT asset, k, sum(-0.5 * (ln(2 * pi()) + ln(v) + ret * ret / v)) AS ll FROM p GROUP BY ALL)
SELECT asset, arg_max(k, (ll, -k))::INT AS candidate, round(max(ll), 4) AS loglik FROM l GROUP BY asset""")
def v11_best_candidate(spark, d):
    s = fits.score_candidates(panel_returns(spark, d).select("asset", "ts", "ret"), _D, _T, _CANDIDATES)
    return rounded(fits.best_candidate(s, _D), 4, "loglik")


@query(None)
def v11_fit_panel(spark, d):
    return rounded(fits.fit_panel(_rets(spark, d), _D, _T, "garch"), 3, "loglik", "aic", "bic").select("asset", "model", "loglik", "n", "aic", "bic")


@query(None)
def v16_compare_models(spark, d):
    r = _rets(spark, d)
    both = fits.compare_models([fits.fit_panel(r, _D, _T, m) for m in ("garch", "tarch")], _D)
    return rounded(both, 3, "aic").select("asset", "model", "aic", "aic_rank", "best")


def _models(spark, d):
    """Parameters of four models for every asset, their omega from its returns."""
    v = _rets(spark, d).groupBy("asset").agg(F.avg(F.col("ret") ** 2).alias("s"))
    rows = {"garch": (0.1, 0.0, 0.8), "tarch": (0.05, 0.1, 0.8), "igarch": (0.1, 0.0, 0.9), "agarch": (0.1, 0.05, 0.8)}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(a).alias("alpha"), F.lit(g).alias("gamma"), F.lit(b).alias("beta"), F.lit(2.0).alias("delta"), F.lit({"igarch": 1.0, "tarch": a + g / 2 + b}.get(m, a + b)).alias("persistence")) for m, (a, g, b) in rows.items()]))
    return v.withColumn("m", each).select("asset", "m.*", (0.1 * F.col("s")).alias("omega"))


_MODELS = f"""{_R}, v AS (SELECT asset, 0.1 * avg(ret * ret) AS w FROM o GROUP BY asset),
m AS (SELECT asset, w, model, a, g, b, p FROM v, (VALUES ('garch', 0.1::DOUBLE, 0.0::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE), ('tarch', 0.05, 0.1, 0.8, 0.9), ('igarch', 0.1, 0.0, 0.9, 1.0), ('agarch', 0.1, 0.05, 0.8, 0.9)) t(model, a, g, b, p))"""


@query(f"""WITH {_MODELS}, l AS (SELECT asset, arg_max(ret, i) AS r, any_value(v0) AS v FROM o GROUP BY asset),
one AS (SELECT m.*, w + a * r * r + b * v + CASE WHEN model = 'tarch' AND r < 0 THEN g * r * r WHEN model = 'agarch' THEN g * r * sqrt(v) ELSE 0 END AS f FROM m JOIN l USING (asset))
SELECT asset, model, h::INT AS h, round(CASE WHEN model = 'igarch' THEN f + w * (h - 1) ELSE w / (1 - p) + (f - w / (1 - p)) * pow(p, h - 1) END, 8) AS var FROM one, range(1, 6) r(h)""")
def v12_forecasts(spark, d):
    r = _rets(spark, d)
    last = r.groupBy("asset").agg(F.max_by("ret", "ts").alias("r"), F.avg(F.col("ret") ** 2).alias("v"))
    return rounded(fits.forecast(last, _models(spark, d), _D, 5), 8, "var")


@query(f"WITH {_MODELS} SELECT asset, model, round(CASE WHEN p < 1 THEN w / (1 - p) END, 8) AS unconditional, round(CASE WHEN p < 1 THEN ln(0.5) / ln(p) END, 6) AS half_life FROM m")
def v13_levels(spark, d):
    return rounded(rounded(fits.levels(_models(spark, d)), 8, "unconditional"), 6, "half_life").select("asset", "model", "unconditional", "half_life")


@query(f"""WITH {_MODELS} SELECT asset, model, e AS shock, round(w + a * e * e + b * w / (1 - p) + CASE WHEN model = 'tarch' AND e < 0 THEN g * e * e WHEN model = 'agarch' THEN g * e * sqrt(w / (1 - p)) ELSE 0 END, 8) AS var
FROM m, (VALUES (-1.0::DOUBLE), (-0.2), (0.0), (0.5)) t(e) WHERE p < 1""")
def v14_news_impact(spark, d):
    known = fits.levels(_models(spark, d)).where("unconditional is not null")
    return rounded(fits.news_impact(known, [-1.0, -0.2, 0.0, 0.5]), 8, "var").select("asset", "model", "shock", "var")


@query(f"""WITH {_R}, l AS (SELECT asset, arg_max(ret, i) AS r, any_value(v0) AS v FROM o GROUP BY asset), f AS (SELECT asset, h, 0.5 * v + (0.05 * v + 0.1 * r * r + 0.8 * v - 0.5 * v) * pow(0.9, h - 1) AS var FROM l, range(1, 4) r(h))
SELECT asset, h::INT AS h, p, round(sqrt(var) * CASE WHEN p < 0.5 THEN ln(2 * p) ELSE -ln(2 * (1 - p)) END / sqrt(2::DOUBLE), 7) AS quantile FROM f, (VALUES (0.01::DOUBLE), (0.05), (0.9)) t(p)""")
def v15_forecast_quantiles(spark, d):
    last = _rets(spark, d).groupBy("asset").agg(F.max_by("ret", "ts").alias("r"), F.avg(F.col("ret") ** 2).alias("v"))
    params = last.select("asset", F.lit("garch").alias("model"), (0.05 * F.col("v")).alias("omega"), F.lit(0.1).alias("alpha"), F.lit(0.0).alias("gamma"), F.lit(0.8).alias("beta"), F.lit(2.0).alias("delta"), F.lit(0.9).alias("persistence"))
    q = fits.forecast_quantiles(fits.forecast(last, params, _D, 3), [0.01, 0.05, 0.9], "laplace")
    return rounded(q, 7, "quantile").select("asset", "h", "p", "quantile")


@query(f"""WITH RECURSIVE {_R}, w(k, delta, lam) AS (SELECT 1, 0.4::DOUBLE, 0.2 - 0.3 + 0.4::DOUBLE UNION ALL SELECT k + 1, (k - 0.4) / (k + 1) * delta, 0.3 * lam + (k - 0.4) / (k + 1) * delta - 0.2 * delta FROM w WHERE k < 50),
s AS (SELECT x.asset, x.i, sum(w.lam * y.ret * y.ret) AS s FROM o x JOIN w ON true JOIN o y ON y.asset = x.asset AND y.i = x.i - w.k WHERE x.i > 50 GROUP BY ALL)
SELECT o.asset, o.ts::DATE::VARCHAR AS day, round(CASE WHEN o.i <= 50 THEN v0 ELSE 0.01 / 0.7 + s END, 7) AS var FROM o LEFT JOIN s ON s.asset = o.asset AND s.i = o.i""")
def v7_figarch(spark, d):
    return rounded(fits.figarch(_rets(spark, d), _D, _T, 0.01, 0.4, 0.2, 0.3, 50), 7, "var").select("asset", _day(), "var")


@query(f"WITH {_R} SELECT asset, ts::DATE::VARCHAR AS day, round(ret - avg(ret) OVER (PARTITION BY asset), 8) AS ret FROM o")
def v10_demean(spark, d):
    return rounded(volatility.demean(_rets(spark, d), _D), 8, "ret").select("asset", _day(), "ret")


@query(f"""WITH RECURSIVE {_R}, p AS (SELECT asset, ts, i, ret, v0 AS v FROM o WHERE i = 1 UNION ALL SELECT o.asset, o.ts, o.i, o.ret, 0.05 + 0.1 * p.ret * p.ret + 0.8 * p.v FROM p JOIN o ON o.asset = p.asset AND o.i = p.i + 1)
SELECT asset, ts::DATE::VARCHAR AS day, round(v, 7) AS var FROM p""")
def v1_long_garch(spark, d):
    """The filter cut into chunks of four weeks that are walked in parallel."""
    return rounded(volatility.long_garch(_rets(spark, d), "asset", "ts", 0.05, 0.1, 0.8), 7, "var").select("asset", _day(), "var")


# -- many assets ----------------------------------------------------------------

_Z = f"""{_R}, z AS (SELECT asset, ts, ret / sqrt(v0) AS z, sqrt(v0) AS sd FROM o), zz AS (SELECT x.ts, x.asset AS i, y.asset AS j, x.z * y.z AS zz, x.sd AS si, y.sd AS sj FROM z x JOIN z y ON x.ts = y.ts AND x.asset <= y.asset),
zo AS (SELECT *, avg(zz) OVER (PARTITION BY i, j) AS m, row_number() OVER (PARTITION BY i, j ORDER BY ts) AS k FROM zz)"""
_DCC = f"""WITH RECURSIVE {_Z}, q AS (SELECT i, j, ts, k, zz, m, si, sj, m AS q FROM zo WHERE k = 1 UNION ALL SELECT zo.i, zo.j, zo.ts, zo.k, zo.zz, zo.m, zo.si, zo.sj, 0.05 * zo.m + 0.05 * q.zz + 0.9 * q.q FROM q JOIN zo ON zo.i = q.i AND zo.j = q.j AND zo.k = q.k + 1)"""


def _level_path(spark, d):
    """Returns beside their sample variance, the simplest variance path."""
    r = _rets(spark, d)
    return r.join(r.groupBy("asset").agg(F.avg(F.col("ret") ** 2).alias("var")), "asset")


def _zz(spark, d):
    return multivariate.standardized_pairs(_level_path(spark, d))


@query(f"""{_DCC} SELECT q.ts::DATE::VARCHAR AS day, q.i, q.j, round(q.q / sqrt(a.q * b.q), 6) AS corr, round(q.q / sqrt(a.q * b.q) * q.si * q.sj, 6) AS cov
FROM q JOIN q a ON a.ts = q.ts AND a.i = q.i AND a.j = q.i JOIN q b ON b.ts = q.ts AND b.i = q.j AND b.j = q.j""")
def v19_dynamic_correlation(spark, d):
    return rounded(multivariate.dynamic_correlation(_zz(spark, d), 0.05, 0.9), 6, "corr", "cov").select(_day(), "i", "j", "corr", "cov")


_GRID = [(0.02, 0.9), (0.05, 0.5), (0.1, 0.8), (0.01, 0.2), (0.2, 0.6), (0.03, 0.95), (0.6, 0.5)]
_DCCS = f"""WITH RECURSIVE {_Z}, k AS (SELECT * FROM (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in _GRID if a + b < 1)}) t(a, b)),
q AS (SELECT a, b, i, j, ts, k, zz, m, m AS q FROM zo, k WHERE zo.k = 1 UNION ALL SELECT q.a, q.b, zo.i, zo.j, zo.ts, zo.k, zo.zz, zo.m, (1 - q.a - q.b) * zo.m + q.a * q.zz + q.b * q.q FROM q JOIN zo ON zo.i = q.i AND zo.j = q.j AND zo.k = q.k + 1),
r AS (SELECT q.a, q.b, q.ts, q.i, q.j, q.zz, q.q / sqrt(x.q * y.q) AS r, x.zz AS zi, y.zz AS zj FROM q JOIN q x ON x.a = q.a AND x.b = q.b AND x.ts = q.ts AND x.i = q.i AND x.j = q.i JOIN q y ON y.a = q.a AND y.b = q.b AND y.ts = q.ts AND y.i = q.j AND y.j = q.j WHERE q.i < q.j)"""


@query(f"{_DCCS} SELECT a, b, CASE WHEN max(abs(r)) < 1 THEN round(sum(-0.5 * (ln(abs(1 - r * r)) + (zi + zj - 2 * r * zz) / (1 - r * r) - zi - zj)), 3) END AS loglik, count(*) AS n FROM r GROUP BY a, b")
def v20_composite_likelihood(spark, d):
    """Six admissible candidates, carried in one pass."""
    return rounded(multivariate.fit_dynamic_correlation(_zz(spark, d), _GRID), 3, "loglik")


_THREE = ["1-URGENT", "3-MEDIUM", "5-LOW"]


@query(f"""{_DCCS}, c AS (SELECT a, b, ts, max(r) FILTER (WHERE i = '1-URGENT' AND j = '3-MEDIUM') AS p, max(r) FILTER (WHERE i = '1-URGENT' AND j = '5-LOW') AS q, max(r) FILTER (WHERE i = '3-MEDIUM' AND j = '5-LOW') AS r,
max(zz) FILTER (WHERE i = '1-URGENT' AND j = '3-MEDIUM') AS xy, max(zz) FILTER (WHERE i = '1-URGENT' AND j = '5-LOW') AS xz, max(zz) FILTER (WHERE i = '3-MEDIUM' AND j = '5-LOW') AS yz,
max(zi) FILTER (WHERE i = '1-URGENT') AS xx, max(zi) FILTER (WHERE i = '3-MEDIUM') AS yy, max(zj) FILTER (WHERE j = '5-LOW') AS zz FROM r GROUP BY ALL),
e AS (SELECT *, 1 + 2 * p * q * r - p * p - q * q - r * r AS det FROM c WHERE xy IS NOT NULL AND xz IS NOT NULL AND yz IS NOT NULL)
SELECT a, b, CASE WHEN min(det) > 0 AND max(greatest(abs(p), abs(q), abs(r))) < 1 THEN round(sum(-0.5 * (ln(abs(det)) + (xx * (1 - r * r) + yy * (1 - q * q) + zz * (1 - p * p) - 2 * xy * (p - q * r) - 2 * xz * (q - p * r) - 2 * yz * (r - p * q)) / det - xx - yy - zz)), 3) END AS loglik, count(*) AS n FROM e GROUP BY a, b""")
def v20_full_likelihood(spark, d):
    """Second-stage likelihoods over whole correlation matrices of three assets."""
    zz = _zz(spark, d).where(F.col("i").isin(_THREE) & F.col("j").isin(_THREE))
    return rounded(multivariate.fit_dynamic_correlation(zz, _GRID, full=True), 3, "loglik")


@query(f"""{_DCC}, l AS (SELECT i, j, any_value(m) AS m, 0.05 * any_value(m) + 0.05 * arg_max(zz, k) + 0.9 * arg_max(q, k) AS q1 FROM q GROUP BY ALL), f AS (SELECT i, j, h, m + pow(0.95, h - 1) * (q1 - m) AS q FROM l, range(1, 5) r(h))
SELECT f.i, f.j, f.h::INT AS h, round(f.q / sqrt(a.q * b.q), 7) AS corr FROM f JOIN f a ON a.i = f.i AND a.j = f.i AND a.h = f.h JOIN f b ON b.i = f.j AND b.j = f.j AND b.h = f.h WHERE f.i < f.j""")
def v21_forecast_correlation(spark, d):
    zz = _zz(spark, d)
    return rounded(multivariate.forecast_correlation(multivariate.dynamic_correlation(zz, 0.05, 0.9), zz, 0.05, 0.9, 4), 7, "corr")


@query(f"""WITH {_R}, v AS (SELECT asset, avg(ret * ret) AS v, arg_max(ret, i) AS r FROM o GROUP BY asset), c AS (SELECT x.asset AS i, y.asset AS j, corr(x.ret, y.ret) AS c FROM o x JOIN o y ON x.ts = y.ts AND x.asset < y.asset GROUP BY ALL),
f AS (SELECT asset, h, 0.5 * v + (0.05 * v + 0.1 * r * r + 0.8 * v - 0.5 * v) * pow(0.9, h - 1) AS var FROM v, range(1, 4) r(h))
SELECT i, j, a.h::INT AS h, round(c * sqrt(a.var * b.var), 7) AS cov FROM c JOIN f a ON a.asset = i JOIN f b ON b.asset = j AND b.h = a.h""")
def v18_forecast_covariance(spark, d):
    last = _rets(spark, d).groupBy("asset").agg(F.max_by("ret", "ts").alias("r"), F.avg(F.col("ret") ** 2).alias("v"))
    params = last.select("asset", F.lit("garch").alias("model"), (0.05 * F.col("v")).alias("omega"), F.lit(0.1).alias("alpha"), F.lit(0.0).alias("gamma"), F.lit(0.8).alias("beta"), F.lit(2.0).alias("delta"), F.lit(0.9).alias("persistence"))
    r = _rets(spark, d)
    rho = align.pairs(r, "asset", "ts", ("ret",)).where("i < j").groupBy("i", "j").agg(F.corr("ret_i", "ret_j").alias("corr"))
    return rounded(multivariate.forecast_covariance(fits.forecast(last, params, _D, 3), rho), 7, "cov")


_C, _A, _B = np.array([[0.1, 0.0], [0.02, 0.1]]), np.diag([0.3, 0.2]), np.diag([0.9, 0.95])
_BEKK = f"""WITH RECURSIVE {RETS}, w AS (SELECT ts, max(ret) FILTER (WHERE asset = '1-URGENT') AS x, max(ret) FILTER (WHERE asset = '5-LOW') AS y FROM rets GROUP BY ts), c AS (SELECT *, row_number() OVER (ORDER BY ts) AS i FROM w WHERE x IS NOT NULL AND y IS NOT NULL),
p AS (SELECT ts, i, x, y, (SELECT avg(x * x) FROM c) AS h11, (SELECT avg(x * y) FROM c) AS h12, (SELECT avg(y * y) FROM c) AS h22 FROM c WHERE i = 1
UNION ALL SELECT c.ts, c.i, c.x, c.y, 0.01 + 0.09 * p.x * p.x + 0.81 * p.h11, 0.002 + 0.06 * p.x * p.y + 0.855 * p.h12, 0.0104 + 0.04 * p.y * p.y + 0.9025 * p.h22 FROM p JOIN c ON c.i = p.i + 1)"""


def _bekk(spark, d):
    return multivariate.bekk(multivariate.wide_returns(_rets(spark, d), [_URGENT, _LOW]), _C, _A, _B)


@query(f"{_BEKK} SELECT ts::DATE::VARCHAR AS day, round(h11, 7) AS h11, round(h12, 7) AS h12, round(h22, 7) AS h22 FROM p")
def v22_bekk(spark, d):
    return rounded(_bekk(spark, d).select(_day(), F.col("cov")[0].alias("h11"), F.col("cov")[1].alias("h12"), F.col("cov")[3].alias("h22")), 7, "h11", "h12", "h22")


@query(f"""{_BEKK} SELECT 'bekk' AS model, round(sum(-ln(2 * pi()) - 0.5 * ln(h11 * h22 - h12 * h12) - 0.5 * (x * x * h22 - 2 * x * y * h12 + y * y * h11) / (h11 * h22 - h12 * h12)), 4) AS loglik, count(*) AS n FROM p
UNION ALL SELECT 'constant', round(sum(-ln(2 * pi()) - 0.5 * ln(a * b - e * e) - 0.5 * (x * x * b - 2 * x * y * e + y * y * a) / (a * b - e * e)), 4), count(*) FROM c, (SELECT avg(x * x) AS a, avg(x * y) AS e, avg(y * y) AS b FROM c)""")
def v24_multivariate_likelihood(spark, d):
    w = multivariate.wide_returns(_rets(spark, d), [_URGENT, _LOW])
    scored = {"bekk": (multivariate.standardized_residuals(_bekk(spark, d)), 7), "constant": (multivariate.standardized_residuals(multivariate.constant_path(w, 2)), 3)}
    return rounded(multivariate.compare_models(scored), 4, "loglik").select("model", "loglik", "n")


@query(f"""{_BEKK}, m AS (SELECT 'bekk' AS model, sum(-ln(2 * pi()) - 0.5 * ln(h11 * h22 - h12 * h12) - 0.5 * (x * x * h22 - 2 * x * y * h12 + y * y * h11) / (h11 * h22 - h12 * h12)) AS l, count(*) AS n, 7 AS k FROM p
UNION ALL SELECT 'constant', sum(-ln(2 * pi()) - 0.5 * ln(a * b - e * e) - 0.5 * (x * x * b - 2 * x * y * e + y * y * a) / (a * b - e * e)), count(*), 3 FROM c, (SELECT avg(x * x) AS a, avg(x * y) AS e, avg(y * y) AS b FROM c))
SELECT model, round(l, 4) AS loglik, n, k::INT AS k, round(2 * k - 2 * l, 4) AS aic, round(k * ln(n) - 2 * l, 4) AS bic FROM m""")
def v25_compare_multivariate(spark, d):
    w = multivariate.wide_returns(_rets(spark, d), [_URGENT, _LOW])
    scored = {"bekk": (multivariate.standardized_residuals(_bekk(spark, d)), 7), "constant": (multivariate.standardized_residuals(multivariate.constant_path(w, 2)), 3)}
    return rounded(multivariate.compare_models(scored), 4, "loglik", "aic", "bic")


# -- distributions -------------------------------------------------------------

_STD = f"{_R}, s AS (SELECT asset, ts, i, n, ret, (ret - avg(ret) OVER (PARTITION BY asset)) / stddev_pop(ret) OVER (PARTITION BY asset) AS z FROM o)"


@query(f"""WITH {_STD}, t AS (SELECT *, z * sqrt(2::DOUBLE) AS t FROM s) SELECT asset, ts::DATE::VARCHAR AS day, round(0.5 + 0.375 * t / sqrt(1 + t * t / 4) * (1 - t * t / (12 * (1 + t * t / 4))), 7) AS pit_t4,
round(CASE WHEN z < 0 THEN 0.5 * exp(sqrt(2::DOUBLE) * z) ELSE 1 - 0.5 * exp(-sqrt(2::DOUBLE) * z) END, 7) AS pit_ged1 FROM t""")
def d2_probability_transform(spark, d):
    r = densities._moments(_rets(spark, d), _D, "ret").withColumn("z", (F.col("ret") - F.col("_mean")) / F.col("_std"))
    out = r.select("asset", _day(), cdf_column("z", "t", 4.0).alias("pit_t4"), cdf_column("z", "ged", 1.0).alias("pit_ged1"))
    return rounded(out, 7, "pit_t4", "pit_ged1")


@query(f"WITH {_R}, p AS (SELECT asset, ts, (i - 0.5) / n AS p FROM o) SELECT asset, ts::DATE::VARCHAR AS day, round(CASE WHEN p < 0.5 THEN ln(2 * p) ELSE -ln(2 * (1 - p)) END / sqrt(2::DOUBLE), 7) AS q FROM p")
def d3_quantiles(spark, d):
    w = series.ordered(_D, _T)
    p = (F.row_number().over(w) - 0.5) / F.count("*").over(series.Window.partitionBy("asset"))
    return rounded(_rets(spark, d).withColumn("p", p).select("asset", _day(), quantile_column("p", "ged", 1.0).alias("q")), 7, "q")


@query(None)
def d5_fit_t(spark, d):
    return rounded(densities.fit_family(_rets(spark, d), _D, "ret", "t"), 2, "loglik").select("asset", "family", "loglik", "n")


@query(f"WITH {_R}, m AS (SELECT asset, avg(ret) AS m, stddev_pop(ret) AS s FROM o GROUP BY asset) SELECT asset, p, round(m + s * CASE WHEN p < 0.5 THEN ln(2 * p) ELSE -ln(2 * (1 - p)) END / sqrt(2::DOUBLE), 7) AS quantile FROM m, (VALUES (0.01::DOUBLE), (0.5), (0.99)) t(p)")
def d7_quantile_table(spark, d):
    f = _rets(spark, d).groupBy("asset").agg(F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("std")).withColumns({"nu": F.lit(None).cast("double"), "lam": F.lit(None).cast("double")})
    return rounded(densities.quantile_table(f, _D, [0.01, 0.5, 0.99], "laplace"), 7, "quantile")


@query(f"""WITH {_R}, k AS (SELECT asset, ret, (row_number() OVER (PARTITION BY asset ORDER BY ret) - 0.5) / n AS p, avg(ret) OVER (PARTITION BY asset) AS m, stddev_pop(ret) OVER (PARTITION BY asset) AS s FROM o),
q AS (SELECT asset, ret, m + s * CASE WHEN p < 0.5 THEN ln(2 * p) ELSE -ln(2 * (1 - p)) END / sqrt(2::DOUBLE) AS t FROM k)
SELECT asset, round(avg((ret - t) ** 2), 8) AS mse, round(corr(ret, t) ** 2, 7) AS r2, round(max(abs(ret - t)), 6) AS max_deviation, count(*) AS n FROM q GROUP BY asset""")
def d8_qq_fit(spark, d):
    q = densities.qq_fit(densities.qq(_rets(spark, d), _D, "ret", "laplace"), _D, "ret")
    return rounded(rounded(rounded(q, 8, "mse"), 7, "r2"), 6, "max_deviation")


@query(f"WITH {_R} SELECT asset, round(sum(-ln(0.5 * (1.2 + 1 / 1.2)) - CASE WHEN ret >= 0 THEN ret / 0.5 * 1.2 ELSE -ret / 0.5 / 1.2 END), 5) AS loglik, round(avg(CASE WHEN ret >= 0 THEN 1 - exp(-ret / 0.5 * 1.2) / 2.44 ELSE 1.44 / 2.44 * exp(ret / 0.5 / 1.2) END), 7) AS mean_pit FROM o GROUP BY asset")
def d10_asymmetric_laplace(spark, d):
    p = asymmetric_laplace(F.col("ret"), 0.0, 0.5, 1.2)
    return rounded(rounded(_rets(spark, d).groupBy("asset").agg(F.sum(p["logpdf"]).alias("loglik"), F.avg(p["cdf"]).alias("mean_pit")), 5, "loglik"), 7, "mean_pit")


@query(f"""WITH {_STD}, k AS (SELECT asset, n, rank() OVER (PARTITION BY asset ORDER BY z) AS lo, count(*) OVER (PARTITION BY asset ORDER BY z RANGE UNBOUNDED PRECEDING) AS hi, CASE WHEN z < 0 THEN 0.5 * exp(sqrt(2::DOUBLE) * z) ELSE 1 - 0.5 * exp(-sqrt(2::DOUBLE) * z) END AS f FROM s),
m AS (SELECT asset, any_value(n) AS n, max(greatest(hi / n - f, f - (lo - 1) / n)) AS d FROM k GROUP BY asset) SELECT asset, round(d, 8) AS statistic, round(exp(-2 * n * d * d), 8) AS p_value, n FROM m""")
def t12_kolmogorov_smirnov(spark, d):
    return rounded(densities.kolmogorov_smirnov(_rets(spark, d), _D, "ret", "laplace"), 8, "statistic", "p_value")


@query(None)
def t13_lilliefors(spark, d):
    return rounded(densities.lilliefors(_rets(spark, d), _D, "ret"), 7, "statistic", "crit_10", "crit_5", "crit_1")


@query(None)
def t7_berkowitz(spark, d):
    r = densities._moments(_rets(spark, d), _D, "ret").withColumn("pit", cdf_column((F.col("ret") - F.col("_mean")) / F.col("_std")))
    return rounded(densities.berkowitz(r.select("asset", "ts", "pit"), _D, _T, "pit"), 4, "statistic", "p_value")


# -- tests ---------------------------------------------------------------------


@query(f"""WITH {_R}, c AS (SELECT asset, i, n, ret - avg(ret) OVER (PARTITION BY asset) AS c FROM o), g AS (SELECT *, lag(c) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(c, 3) OVER w AS c3, lag(c, 4) OVER w AS c4 FROM c WINDOW w AS (PARTITION BY asset ORDER BY i)),
q AS (SELECT asset, any_value(n) * (any_value(n) + 2) * ((sum(c * c1) / sum(c * c)) ** 2 / (any_value(n) - 1) + (sum(c * c2) / sum(c * c)) ** 2 / (any_value(n) - 2) + (sum(c * c3) / sum(c * c)) ** 2 / (any_value(n) - 3) + (sum(c * c4) / sum(c * c)) ** 2 / (any_value(n) - 4)) AS q FROM g GROUP BY asset)
SELECT asset, round(q, 5) AS statistic, round(exp(-q / 2) * (1 + q / 2), 8) AS p_value FROM q""")
def t1_ljung_box_p(spark, d):
    t = diagnostics.ljung_box(_rets(spark, d), _D, _T, "ret", 4)
    return rounded(rounded(t, 5, "statistic"), 8, "p_value").select("asset", "statistic", "p_value")


@query(f"""WITH {_R}, l AS (SELECT asset, i, ret - lag(ret) OVER (PARTITION BY asset ORDER BY i) AS d, lag(ret) OVER (PARTITION BY asset ORDER BY i) AS x FROM o),
f AS (SELECT asset, regr_slope(d, x) AS b, sqrt((regr_syy(d, x) - regr_sxy(d, x) ** 2 / regr_sxx(d, x)) / (regr_count(d, x) - 2) / regr_sxx(d, x)) AS se, regr_count(d, x) AS n FROM l GROUP BY asset)
SELECT asset, round(b / se, 5) AS statistic, n, round(-2.86154 - 2.8903 / n - 4.234 / n ** 2 - 40.040 / n ** 3, 6) AS crit_5 FROM f""")
def t3_unit_root(spark, d):
    t = diagnostics.unit_root(_rets(spark, d), _D, _T, "ret", 0)
    return rounded(rounded(t, 5, "statistic"), 6, "crit_5").select("asset", "statistic", "n", "crit_5")


@query(f"""WITH {_R}, e AS (SELECT asset, i, n, ret AS x, lead(ret) OVER (PARTITION BY asset ORDER BY i) AS y, stddev_samp(ret) OVER (PARTITION BY asset) * 0.5 AS eps FROM o), m AS (SELECT * FROM e WHERE i < n),
b AS (SELECT a.asset, a.i, count(*) FILTER (WHERE a.i <> b.i AND abs(a.x - b.x) < a.eps) AS c, count(*) FILTER (WHERE a.i <> b.i AND abs(a.x - b.x) < a.eps AND abs(a.y - b.y) < a.eps) AS m, any_value(a.n) - 1 AS n FROM m a JOIN m b ON a.asset = b.asset GROUP BY a.asset, a.i),
s AS (SELECT asset, any_value(n)::DOUBLE AS n, sum(c) / (any_value(n)::DOUBLE * (any_value(n) - 1)) AS c, sum(m) / (any_value(n)::DOUBLE * (any_value(n) - 1)) AS m, sum(c * (c - 1)) / (any_value(n)::DOUBLE * (any_value(n) - 1) * (any_value(n) - 2)) AS k FROM b GROUP BY asset)
SELECT asset, round(sqrt(n) * (m - c * c) / sqrt(4 * (k * k + 2 * k * c * c + c ** 4 - 4 * k * c * c)), 5) AS statistic, round(c, 8) AS c1, round(m, 8) AS cm FROM s""")
def t4_bds(spark, d):
    return rounded(rounded(diagnostics.bds(_rets(spark, d), _D, _T, "ret", 2), 5, "statistic"), 8, "c1", "cm").select("asset", "statistic", "c1", "cm")


@query(f"WITH {_R}, e AS (SELECT asset, i, n AS rows_, ret * ret AS y, lag(ret * ret) OVER w AS a, lag(ret * ret, 2) OVER w AS b FROM o WINDOW w AS (PARTITION BY asset ORDER BY i)), {_two('y', 'a', 'b', 'e')} SELECT asset, round((n + 2) * r2, 5) AS statistic, round(exp(-(n + 2) * r2 / 2), 8) AS p_value FROM fit")
def t5_engle_arch_lags(spark, d):
    t = diagnostics.engle_arch(_rets(spark, d), _D, _T, "ret", 2)
    return rounded(rounded(t, 5, "statistic"), 8, "p_value").select("asset", "statistic", "p_value")


_LINES = """m AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem GROUP BY ALL),
e AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice - a - b * l_quantity AS e FROM lineitem JOIN m USING (l_returnflag))"""


@query(f"WITH {_LINES}, w AS (SELECT l_returnflag, x AS a, x * x AS b, e * e AS y FROM e), {_two('y', 'a', 'b', 'w', 'l_returnflag')} SELECT l_returnflag, round(n * r2, 3) AS statistic, round(exp(-n * r2 / 2), 6) AS p_value FROM fit")
def t8_white(spark, d):
    i = table(spark, d, "lineitem")
    r = regress.predict(i, regress.ols(i, "l_extendedprice", ["l_quantity"], ["l_returnflag"]), "l_extendedprice", ["l_quantity"], ["l_returnflag"])
    t = diagnostics.white(r, ["l_returnflag"], ["l_quantity"], "residual")
    return rounded(rounded(t, 3, "statistic"), 6, "p_value").select("l_returnflag", "statistic", "p_value")


@query(f"""WITH {_LINES}, h AS (SELECT *, (x - avg(x) OVER (PARTITION BY l_returnflag)) / stddev_pop(x) OVER (PARTITION BY l_returnflag) AS z FROM e),
g AS (SELECT l_returnflag, e, z, z * z AS p, z * z * z AS q FROM h), k AS (SELECT l_returnflag, regr_slope(p, z) AS pb, regr_intercept(p, z) AS pa, regr_slope(q, z) AS qb, regr_intercept(q, z) AS qa FROM g GROUP BY ALL),
r AS (SELECT l_returnflag, e, p - pa - pb * z AS a, q - qa - qb * z AS b FROM g JOIN k USING (l_returnflag)), {_two("e", "a", "b", "r", "l_returnflag")},
u AS (SELECT l_returnflag, n, r2 / 2 / ((1 - r2) / (n - 4)) AS f FROM fit) SELECT l_returnflag, round(f, 4) AS statistic, round(pow(1 + 2 * f / (n - 4), -(n - 4) / 2.0), 6) AS p_value FROM u""")
def t11_reset(spark, d):
    t = diagnostics.reset(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", ["l_quantity"], 3)
    return rounded(rounded(t, 4, "statistic"), 6, "p_value").select("l_returnflag", "statistic", "p_value")


_SUITE = f"""{_R}, c AS (SELECT asset, i, n, ret, ret - avg(ret) OVER (PARTITION BY asset) AS c FROM o), g AS (SELECT *, lag(c) OVER w AS c1, lag(c, 2) OVER w AS c2, ret - lag(ret) OVER w AS d FROM c WINDOW w AS (PARTITION BY asset ORDER BY i)),
jb AS (SELECT asset, count(*) / 6.0 * ((avg(c ** 3) / avg(c ** 2) ** 1.5) ** 2 + (avg(c ** 4) / avg(c ** 2) ** 2 - 3) ** 2 / 4) AS s FROM c GROUP BY asset),
lb AS (SELECT asset, any_value(n) * (any_value(n) + 2) * ((sum(c * c1) / sum(c * c)) ** 2 / (any_value(n) - 1) + (sum(c * c2) / sum(c * c)) ** 2 / (any_value(n) - 2)) AS s FROM g GROUP BY asset),
dw AS (SELECT asset, sum(d * d) / sum(ret * ret) AS s FROM g GROUP BY asset),
e AS (SELECT asset, ret * ret AS y, lag(ret * ret) OVER w AS a, lag(ret * ret, 2) OVER w AS b FROM o WINDOW w AS (PARTITION BY asset ORDER BY i))"""


@query(f"""WITH {_SUITE}, {_two("y", "a", "b", "e")}, ar AS (SELECT asset, (n + 2) * r2 AS s FROM fit)
SELECT asset, 'jarque_bera' AS test, round(s, 4) AS statistic, round(exp(-s / 2), 7) AS p_value FROM jb UNION ALL SELECT asset, 'ljung_box', round(s, 4), round(exp(-s / 2), 7) FROM lb
UNION ALL SELECT asset, 'engle_arch', round(s, 4), round(exp(-s / 2), 7) FROM ar UNION ALL SELECT asset, 'durbin_watson', round(s, 4), NULL FROM dw""")
def t14_residual_suite(spark, d):
    """All of the suite but the unit root, which t3's queries compare."""
    t = diagnostics.residual_suite(_rets(spark, d), _D, _T, "ret", 2).where("test <> 'unit_root'")
    return rounded(rounded(t, 4, "statistic"), 7, "p_value")


@query(f"""WITH {_SUITE}, q AS (SELECT asset, ret, c * c AS unused, ret * ret AS y, i::DOUBLE AS a, i::DOUBLE * i AS b FROM c), {_two("y", "a", "b", "q")},
m AS (SELECT asset, avg(ret) AS mean, stddev_pop(ret) AS std, min(ret) AS min, max(ret) AS max, count(*) AS n FROM o GROUP BY asset)
SELECT m.asset, round(mean, 8) AS mean, round(std, 8) AS std, round(min, 8) AS min, round(max, 8) AS max, m.n, round(jb.s, 4) AS jarque_bera, round(exp(-jb.s / 2), 7) AS jarque_bera_p, round(dw.s, 7) AS durbin_watson, round(fit.n * r2, 5) AS white, round(exp(-fit.n * r2 / 2), 7) AS white_p
FROM m JOIN jb ON jb.asset = m.asset JOIN dw ON dw.asset = m.asset JOIN fit ON fit.asset = m.asset""")
def a10_residual_summary(spark, d):
    r = diagnostics.residual_summary(_rets(spark, d), _D, _T, "ret")
    r = rounded(rounded(r, 8, "mean", "std", "min", "max"), 4, "jarque_bera")
    return rounded(rounded(r, 7, "jarque_bera_p", "durbin_watson", "white_p"), 5, "white")


@query(f"""WITH {_R}, d AS (SELECT m.m, o.*, stddev_samp(ret) OVER (PARTITION BY o.asset, m.m) * 0.5 AS eps, ret AS x0, lead(ret) OVER w AS x1, lead(ret, 2) OVER w AS x2, lead(ret, 3) OVER w AS x3 FROM o, range(2, 5) m(m) WINDOW w AS (PARTITION BY o.asset, m.m ORDER BY i)),
e AS (SELECT * FROM d WHERE i + m <= n + 1),
b AS (SELECT a.asset, a.m, a.i, any_value(a.n) - a.m + 1 AS n, count(*) FILTER (WHERE abs(a.x0 - b.x0) < a.eps) AS c,
count(*) FILTER (WHERE abs(a.x0 - b.x0) < a.eps AND abs(a.x1 - b.x1) < a.eps AND (a.m < 3 OR abs(a.x2 - b.x2) < a.eps) AND (a.m < 4 OR abs(a.x3 - b.x3) < a.eps)) AS r
FROM e a JOIN e b ON a.asset = b.asset AND a.m = b.m AND a.i <> b.i GROUP BY a.asset, a.m, a.i),
s AS (SELECT asset, m, any_value(n)::DOUBLE AS n, sum(c) / (any_value(n)::DOUBLE * (any_value(n) - 1)) AS c, sum(r) / (any_value(n)::DOUBLE * (any_value(n) - 1)) AS r, sum(c * (c - 1)) / (any_value(n)::DOUBLE * (any_value(n) - 1) * (any_value(n) - 2)) AS k FROM b GROUP BY asset, m),
v AS (SELECT *, k ** m + 2 * list_sum(list_transform(range(1, m), lambda j: k ** (m - j) * c ** (2 * j))) + (m - 1) ** 2 * c ** (2 * m) - m ** 2 * k * c ** (2 * m - 2) AS w FROM s)
SELECT asset, m::INT AS dimension, round(sqrt(n) * (r - c ** m) / sqrt(4 * w), 5) AS statistic, round(c, 8) AS c1, round(r, 8) AS cm, n::BIGINT AS n FROM v""")
def t4_bds_dimensions(spark, d):
    """Dimensions 2 to 4 from one comparison."""
    t = diagnostics.bds(_rets(spark, d), _D, _T, "ret", 4, least=2)
    return rounded(rounded(t, 5, "statistic"), 8, "c1", "cm").select("asset", "dimension", "statistic", "c1", "cm", "n")


def _numbers(seed: int, name: str, source: str) -> str:
    """SQL of a table ``source`` (.., rep, b) with a column ``name`` of portable numbers."""
    mod = 2147483647
    a = f"{name}0 AS (SELECT *, ({seed * 7919} + rep * 104729 + b * 1299709 + 1) % {mod} AS x_ FROM {source})"
    out, last = [a], f"{name}0"
    for k, c in enumerate((1013904223, 1664525, 907633385), 1):
        out.append(f"{name}{k} AS (SELECT * REPLACE (48271 * ((x_ * x_ + {c}) % {mod}) % {mod} AS x_) FROM {last})")
        last = f"{name}{k}"
    out.append(f"{name}t AS (SELECT * EXCLUDE (x_), x_ / {mod}.0::DOUBLE AS {name} FROM {last})")
    return ", ".join(out)


# -- sampling ------------------------------------------------------------------


@query(f"""WITH {TICKS}, o AS (SELECT *, 0 AS rep, row_number() OVER (PARTITION BY symbol, date ORDER BY ts, seq) - 1 AS b FROM ticks), {_numbers(11, "u", "o")},
s AS (SELECT symbol, date, coalesce(sum(3 + floor(u * 5)::BIGINT) OVER (PARTITION BY symbol, date ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM ut)
SELECT o.symbol, o.date, o.seq, o.price FROM o SEMI JOIN s ON o.symbol = s.symbol AND o.date = s.date AND o.b = s.b""")
def r7_business_random(spark, d):
    return bars.sample_business_random(ticks(spark, d), 3, 7, seed=11).select("symbol", "date", "seq", "price")


# -- inference -----------------------------------------------------------------


def _stationary(sizes: str, p: float, reps: int) -> str:
    """SQL of stationary blocks for a table of sizes (asset, n): blk (asset, n, rep, b, start, len)."""
    return f"""d0 AS (SELECT asset, n, rep, b, ceil(n * {p} + 7 * sqrt(n * {p}) + 10)::BIGINT AS most FROM {sizes}, range({reps}) r(rep), range(4000) q(b) WHERE b < ceil(n * {p} + 7 * sqrt(n * {p}) + 10)),
{_numbers(2, "u", "d0")}, {_numbers(1, "v", "ut")},
d1 AS (SELECT asset, n, rep, b, most, floor(v * n)::BIGINT AS start, 1 + floor(ln(1 - u) / ln(1 - {p}::DOUBLE))::BIGINT AS l FROM vt),
d2 AS (SELECT *, coalesce(sum(l) OVER (PARTITION BY asset, rep ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS done FROM d1),
blk AS (SELECT asset, n, rep, b, start, CASE WHEN b = most - 1 THEN n - done ELSE least(l, n - done) END AS len FROM d2 WHERE done < n)"""


_B3 = f"""{_R}, sz AS (SELECT asset, any_value(n) AS n FROM o GROUP BY asset), {_stationary("sz", 0.1, 20)},
s AS (SELECT blk.asset, rep, ret FROM blk JOIN range(4000) k(k) ON k < len JOIN o ON o.asset = blk.asset AND o.i = (start + k) % blk.n + 1)"""


@query(f"WITH {_B3} SELECT asset, rep::INT AS rep, round(avg(ret), 8) AS mean, round(stddev_pop(ret), 7) AS std FROM s GROUP BY ALL")
def b3_stationary_bootstrap(spark, d):
    return rounded(rounded(bootstrap.stationary_blocks(_rets(spark, d), _D, _T, "ret", 20, 0.1), 8, "mean"), 7, "std")


@query(f"WITH {_B3} SELECT asset, rep::INT AS rep, round(median(ret), 8) AS median FROM s GROUP BY ALL")
def b4_bootstrap_median(spark, d):
    r = _rets(spark, d)
    sizes = r.groupBy("asset").agg(F.count("*").alias("n"))
    samples = bootstrap.resampled(r, _D, _T, "ret", bootstrap.stationary_draws(sizes, 20, 0.1))
    return rounded(bootstrap.quantile_statistics(samples, _D), 8, "quantile").select("asset", "rep", F.col("quantile").alias("median"))


@query(f"WITH {_B3} SELECT asset, rep::INT AS rep, round(max(ret) - min(ret), 8) AS stat FROM s GROUP BY ALL")
def b5_user_statistic(spark, d):
    r = _rets(spark, d)
    sizes = r.groupBy("asset").agg(F.count("*").alias("n"))
    samples = bootstrap.resampled(r, _D, _T, "ret", bootstrap.stationary_draws(sizes, 20, 0.1))
    return rounded(bootstrap.statistic(samples, _D, lambda v: v.max() - v.min()), 8, "stat")


@query(f"WITH {_B3}, m AS (SELECT asset, rep, avg(ret) AS m FROM s GROUP BY ALL), a AS (SELECT asset, avg(ret) AS a FROM o GROUP BY asset) SELECT asset, avg((abs(m - a) >= abs(a))::INT) AS two, avg((m <= a)::INT) AS less, avg((m >= a)::INT) AS greater FROM m JOIN a USING (asset) GROUP BY asset")
def b7_p_values(spark, d):
    r = _rets(spark, d)
    boot = bootstrap.stationary_blocks(r, _D, _T, "ret", 20, 0.1)
    original = r.groupBy("asset").agg(F.avg("ret").alias("mean"))
    out = None
    for side in ("two", "less", "greater"):
        p = bootstrap.p_value(boot, original, _D, "mean", 0.0, side).withColumnRenamed("p", side)
        out = p if out is None else out.join(p, "asset")
    return out


_LOSS = f"{RETS}, c AS (SELECT ts FROM rets WHERE ret IS NOT NULL GROUP BY ts HAVING count(*) = 5), y AS (SELECT asset AS model, ts, ret * ret AS loss FROM rets JOIN c USING (ts))"


def _losses(spark, d):
    """Squared returns of every asset at common times, as losses of as many models."""
    r = _rets(spark, d).select(F.col("asset").alias("model"), "ts", (F.col("ret") ** 2).alias("loss"))
    common = r.groupBy("ts").count().where("count = 5").select("ts")
    return r.join(common, "ts", "left_semi")


@query(f"""WITH {_LOSS}, g AS (SELECT y.model AS asset, y.ts, b.loss - y.loss AS gain FROM y JOIN y b ON b.ts = y.ts AND b.model = '1-URGENT' WHERE y.model <> '1-URGENT'),
o AS (SELECT asset, gain, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i, count(*) OVER (PARTITION BY asset) AS n FROM g), sz AS (SELECT asset, any_value(n) AS n FROM o GROUP BY asset), {_stationary("sz", 0.1, 40)},
m AS (SELECT blk.asset, rep, avg(gain) AS m FROM blk JOIN range(4000) k(k) ON k < len JOIN o ON o.asset = blk.asset AND o.i = (start + k) % blk.n + 1 GROUP BY ALL),
a AS (SELECT asset, avg(gain) AS a, sqrt(count(*)) AS r FROM o GROUP BY asset), v AS (SELECT rep, max(r * (m - a)) AS v FROM m JOIN a USING (asset) GROUP BY rep), t AS (SELECT max(r * a) AS t, count(*) AS n FROM a)
SELECT round(t, 6) AS statistic, avg((v >= t)::INT) AS p_value, n AS models FROM v, t GROUP BY t, n""")
def b9_reality_check(spark, d):
    return rounded(bootstrap.reality_check(_losses(spark, d), "1-URGENT", 40, 0.1, t="ts"), 6, "statistic").select("statistic", "p_value", "models")


_SETS = f"""{_LOSS}, o AS (SELECT asset, loss, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i, count(*) OVER (PARTITION BY asset) AS n FROM (SELECT model AS asset, ts, loss FROM y)),
sz AS (SELECT asset, any_value(n) AS n FROM o GROUP BY asset), {_stationary("sz", 0.1, 40)},
m AS (SELECT blk.asset, rep, avg(loss) AS m FROM blk JOIN range(4000) k(k) ON k < len JOIN o ON o.asset = blk.asset AND o.i = (start + k) % blk.n + 1 GROUP BY ALL),
a AS (SELECT asset, avg(loss) AS a, sqrt(count(*)) AS root FROM o GROUP BY asset), s AS (SELECT *, row_number() OVER (ORDER BY a DESC, asset) - 1 AS step FROM a),
e AS (SELECT rep, step, root * (m - a) AS e FROM m JOIN s USING (asset))"""


def _confidence_sql(stat: str, draw: str) -> str:
    return f"""WITH {_SETS}, t AS (SELECT p.step, {stat} AS stat FROM s p JOIN s x ON x.step >= p.step JOIN s y ON y.step >= p.step GROUP BY p.step),
v AS (SELECT p.step, x.rep, {draw} AS v FROM s p JOIN e x ON x.step >= p.step JOIN e y ON y.step >= p.step AND y.rep = x.rep GROUP BY ALL),
f AS (SELECT step, stat, avg((v >= stat)::INT) AS p FROM v JOIN t USING (step) GROUP BY ALL)
SELECT asset AS model, step::INT AS step, round(stat, 6) AS statistic, max(p) OVER (ORDER BY step) AS p_value, max(p) OVER (ORDER BY step) >= 0.1 AS inside FROM f JOIN s USING (step)"""


@query(_confidence_sql("max(abs(x.root * (x.a - y.a)))", "max(abs(x.e - y.e))"))
def b10_confidence_set(spark, d):
    return rounded(bootstrap.confidence_set(_losses(spark, d), 40, 0.1, t="ts"), 6, "statistic")


@query(_confidence_sql("sum((x.root * (x.a - y.a)) ** 2) / 2", "sum((x.e - y.e) ** 2) / 2"))
def b10_confidence_set_squares(spark, d):
    return rounded(bootstrap.confidence_set(_losses(spark, d), 40, 0.1, kind="TSQ", t="ts"), 6, "statistic")
