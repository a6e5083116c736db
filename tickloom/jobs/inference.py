"""Queries of forecasts, orders, errors and filters beside those of ``models``, with the SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.distributions import hansen, log_constant
from ..operators import arma, bootstrap, clean, diagnostics, fits, multivariate, regress, series, volatility
from .models import _DCC, _FILTER, _R, _day, _given, _level_path, _rets, _two, _zz
from .tables import DAILY, GAPS, PANEL, daily, gaps, panel, table
from .tools import query, rounded

_D, _T = ["asset"], ["ts"]

# -- forecasts ------------------------------------------------------------------


@query(_FILTER.replace("q.ret - q.c - 0.3", "q.ret - q.c - 0.01 * isodow(q.ts) - 0.3") + """,
l AS (SELECT asset, arg_max(ret, i) AS y, arg_max(e, i) AS e, max(ts) AS ts, any_value(c) AS c, any_value(s2) AS s2 FROM p GROUP BY asset),
f AS (SELECT asset, 1 AS h, ts, c, s2, c + 0.01 * (isodow(ts) % 7 + 1) + 0.3 * y + 0.2 * e AS f FROM l UNION ALL SELECT asset, h + 1, ts, c, s2, c + 0.01 * ((isodow(ts) + h) % 7 + 1) + 0.3 * f FROM f WHERE h < 6)
SELECT asset, h::INT AS h, round(f, 8) AS mean, round(s2 * (1 + 0.25 * (1 - pow(0.09, h - 1)) / 0.91), 8) AS var FROM f""")
def x10_armax_forecast(spark, d):
    """Six days ahead, with the day of the week as exogenous column."""
    dow = lambda ts: (F.weekday(ts) + 1).cast("double")
    r = _rets(spark, d).withColumn("dow", dow("ts"))
    p = _given(spark, d).withColumn("exog", F.array(F.lit(0.01)))
    ahead = r.groupBy("asset").agg(F.max("ts").alias("last")).select("asset", "last", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("h"))
    ahead = ahead.select("asset", "h", dow(F.date_add(F.to_date("last"), F.col("h"))).alias("dow"))
    e = arma.arma_residuals(r, _D, _T, "ret", p, ["dow"])
    return rounded(arma.forecast(e, _D, _T, "ret", p, 6, ["dow"], ahead), 8, "mean", "var")


_LAST2 = f"""{_R}, l2 AS (SELECT asset, any_value(v0) AS v0, max(ret) FILTER (WHERE i = n) AS a, max(ret) FILTER (WHERE i = n - 1) AS b FROM o GROUP BY asset),
l AS (SELECT asset, v0, a * a AS s1, b * b AS s2, 0.5 * v0 + 0.5 * a * a AS v1, 0.5 * v0 + 0.5 * b * b AS v2 FROM l2)"""


def _orders_sql(step: str) -> str:
    return f"""WITH RECURSIVE {_LAST2}, f AS (SELECT asset, 1 AS h, v0, {step} AS v, s1, v1 FROM l UNION ALL
SELECT asset, h + 1, v0, {step}, s1, v1 FROM (SELECT asset, h, v0, v AS s1, s1 AS s2, v AS v1, v1 AS v2 FROM f WHERE h < 8))
SELECT asset, h::INT AS h, round(v, 8) AS var FROM f"""


def _ordered(spark, d, alpha: list[float], beta: list[float]):
    r = _level_path(spark, d).withColumn("var", 0.5 * F.col("var") + 0.5 * F.col("ret") ** 2)
    p = _level_path(spark, d).select("asset", (0.1 * F.col("var")).alias("omega")).distinct()
    p = p.withColumns({"alpha": F.array(*map(F.lit, alpha)), "beta": F.array(*map(F.lit, beta))})
    return rounded(fits.forecast_orders(r, p, _D, _T, 8), 8, "var")


@query(_orders_sql("0.1 * v0 + 0.1 * s1 + 0.05 * s2 + 0.7 * v1"))
def v12_forecast_2_1(spark, d):
    return _ordered(spark, d, [0.1, 0.05], [0.7])


@query(_orders_sql("0.1 * v0 + 0.1 * s1 + 0.5 * v1 + 0.3 * v2"))
def v12_forecast_1_2(spark, d):
    return _ordered(spark, d, [0.1], [0.5, 0.3])


# -- orders ---------------------------------------------------------------------

@query(f"""WITH {_R}, l AS (SELECT asset, i, ret, lag(ret) OVER w AS x, lag(ret, 2) OVER w AS z FROM o WINDOW w AS (PARTITION BY asset ORDER BY i)), g AS (SELECT * FROM l WHERE i > 4), {_two("ret", "x", "z", "g")},
a AS (SELECT asset, 1 AS p, 4 + count(*) * (1 + ln(2 * pi() * var_pop(ret) * (1 - corr(ret, x) ** 2))) AS aic FROM g GROUP BY asset UNION ALL SELECT asset, 2, 6 + n * (1 + ln(2 * pi() * syy * (1 - r2))) FROM fit)
SELECT asset, arg_min(p, (aic, p))::INT AS p, 0::INT AS q, round(min(aic), 4) AS aic FROM a GROUP BY asset""")
def x9_ar_order(spark, d):
    return rounded(arma.choose_order(_rets(spark, d), _D, _T, "ret", 2, 0), 4, "aic")


@query(f"""WITH {_R}, l AS (SELECT asset, i, ret - lag(ret) OVER w AS d, lag(ret) OVER w AS x, lag(ret) OVER w - lag(ret, 2) OVER w AS d1 FROM o WINDOW w AS (PARTITION BY asset ORDER BY i)), g AS (SELECT * FROM l WHERE i > 2), {_two("d", "x", "d1", "g")},
a AS (SELECT asset, 0 AS p, count(*) AS n, count(*) * ln(var_pop(d) * (1 - corr(d, x) ** 2)) + 4 AS aic, regr_slope(d, x) / sqrt(var_pop(d) * (1 - corr(d, x) ** 2) / (count(*) - 2) / var_pop(x)) AS t FROM g GROUP BY asset
UNION ALL SELECT asset, 1, n, n * ln(syy * (1 - r2)) + 6, b1 / sqrt(syy * (1 - r2) / (n - 3) * sbb / (saa * sbb - sab * sab)) FROM fit)
SELECT asset, round(arg_min(t, (aic, p)), 5) AS statistic, arg_min(p, (aic, p))::INT AS lags, any_value(n) AS n FROM a GROUP BY asset""")
def t3_unit_root_choose(spark, d):
    t = diagnostics.unit_root(_rets(spark, d), _D, _T, "ret", 1, choose=True)
    return rounded(t, 5, "statistic").select("asset", "statistic", "lags", "n")


_SYSTEMS = """dv AS (SELECT o_orderstatus AS system, o_orderpriority AS asset, o_orderdate AS ts, avg(o_totalprice) AS value FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL),
w AS (SELECT system, ts, max(value) FILTER (WHERE asset = '1-URGENT') AS u, max(value) FILTER (WHERE asset = '5-LOW') AS l FROM dv GROUP BY ALL), c AS (SELECT * FROM w WHERE u IS NOT NULL AND l IS NOT NULL),
g0 AS (SELECT system, u, l, lag(u) OVER (PARTITION BY system ORDER BY ts) AS lu, lag(l) OVER (PARTITION BY system ORDER BY ts) AS ll FROM c), g AS (SELECT system, '1-URGENT' AS equation, u AS y, lu, ll FROM g0 UNION ALL SELECT system, '5-LOW', l, lu, ll FROM g0)"""


def _systems(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    keys = [F.col("o_orderstatus").alias("system"), F.col("o_orderpriority").alias("asset"), F.col("o_orderdate").cast("timestamp").alias("ts")]
    return o.groupBy(*keys).agg(F.avg("o_totalprice").alias("value"))


@query(f"""WITH {_SYSTEMS}, {_two("y", "lu", "ll", "g", "system, equation")}, e AS (SELECT *, syy * n * (1 - r2) / (n - 3) AS s2, (saa * sbb - sab * sab) * n AS det FROM fit)
SELECT system, equation, unnest(['1-URGENT_1', '5-LOW_1']) AS term, unnest([round(b1, 7), round(b2, 7)]) AS coef, unnest([round(sqrt(s2 * sbb / det), 7), round(sqrt(s2 * saa / det), 7)]) AS se, n FROM e""")
def x13_var_systems(spark, d):
    """Two systems, by order status, in one plan."""
    f = arma.var_fit(_systems(spark, d), ["1-URGENT", "5-LOW"], 1, system="system").where("term <> 'const'")
    return rounded(f, 7, "coef", "se").select("system", "equation", "term", "coef", "se", "n")


@query(f"""WITH {_SYSTEMS}, {_two("y", "lu", "ll", "g", "system, equation")}, f AS (SELECT system, max(b1) FILTER (WHERE equation = '1-URGENT') AS u1, max(b2) FILTER (WHERE equation = '1-URGENT') AS u2, max(b0) FILTER (WHERE equation = '1-URGENT') AS u0,
max(b1) FILTER (WHERE equation = '5-LOW') AS l1, max(b2) FILTER (WHERE equation = '5-LOW') AS l2, max(b0) FILTER (WHERE equation = '5-LOW') AS l0 FROM fit GROUP BY system),
e AS (SELECT system, u - u0 - u1 * lu - u2 * ll AS a, l - l0 - l1 * lu - l2 * ll AS b FROM g0 JOIN f USING (system) WHERE lu IS NOT NULL)
SELECT system, unnest(['1-URGENT', '1-URGENT', '5-LOW']) AS i, unnest(['1-URGENT', '5-LOW', '5-LOW']) AS j, unnest([round(sum(a * a) / (count(*) - 3) / 1e6, 4), round(sum(a * b) / (count(*) - 3) / 1e6, 4), round(sum(b * b) / (count(*) - 3) / 1e6, 4)]) AS cov FROM e GROUP BY system""")
def x13_var_covariance(spark, d):
    c = arma.var_covariance(_systems(spark, d), ["1-URGENT", "5-LOW"], 1, system="system")
    return rounded(c.withColumn("cov", F.col("cov") / 1e6), 4, "cov")


# -- sound under large means -------------------------------------------------------

_FAR = 1e8
_FARLINE = """li AS (SELECT l_returnflag, l_orderkey, l_quantity AS x, l_extendedprice AS y FROM lineitem), m AS (SELECT l_returnflag, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS c, regr_sxx(y, x) AS sxx, count(*) AS n FROM li GROUP BY ALL),
e AS (SELECT l_returnflag, y - a - b * x AS e, x - c AS d, sxx, n, b FROM li JOIN m USING (l_returnflag))"""


def _far(spark, d):
    i = table(spark, d, "lineitem")
    return i.select("l_returnflag", "l_orderkey", (F.col("l_quantity") + _FAR).alias("x"), (F.col("l_extendedprice") + _FAR).alias("y"))


@query(f"WITH {_FARLINE} SELECT l_returnflag, round(any_value(b), 4) AS coef, round(sqrt(sum((e * d / (1 - 1.0 / n - d * d / sxx)) ** 2)) / any_value(sxx), 6) AS se FROM e GROUP BY l_returnflag")
def x2_robust_errors_far(spark, d):
    """Columns 1e8 from zero give the slopes and errors of columns around it."""
    o = regress.robust_errors(_far(spark, d), "y", ["x"], ["l_returnflag"], "HC3")
    return rounded(rounded(o.where("term = 'x'"), 4, "coef"), 6, "se").select("l_returnflag", "coef", "se")


@query("""WITH f AS (SELECT k::INT AS fold, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem, range(5) r(k) WHERE l_orderkey % 5 <> k GROUP BY ALL)
SELECT fold, count(*) AS n, round(avg((l_extendedprice - a - b * l_quantity) ** 2), 1) AS mse FROM lineitem JOIN f ON l_orderkey % 5 = fold GROUP BY fold""")
def c14_k_fold_far(spark, d):
    return rounded(regress.k_fold(_far(spark, d), "y", ["x"], "l_orderkey"), 1, "mse")


_FARBOOT = f"""{DAILY}, o AS (SELECT asset, value, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM daily),
k AS (SELECT DISTINCT asset, n, rep, p, (7919 + rep * 104729 + (p // 10) * 1299709 + 1) % 2147483647 AS x FROM o, range(20) r(rep), range(3000) q(p) WHERE p < n),
k1 AS (SELECT *, 48271 * ((x * x + 1013904223) % 2147483647) % 2147483647 AS y FROM k), k2 AS (SELECT *, 48271 * ((y * y + 1664525) % 2147483647) % 2147483647 AS z FROM k1),
k3 AS (SELECT asset, n, rep, p, 48271 * ((z * z + 907633385) % 2147483647) % 2147483647 AS w FROM k2),
b AS (SELECT k3.asset, rep, value FROM k3 JOIN o ON o.asset = k3.asset AND o.i = (floor(w / 2147483647.0::DOUBLE * k3.n)::BIGINT + p % 10) % k3.n)"""


@query(f"WITH {_FARBOOT} SELECT asset, rep::INT AS rep, round(stddev_pop(value), 2) AS std FROM b GROUP BY ALL")
def b1_block_bootstrap_far(spark, d):
    far = daily(spark, d).withColumn("value", F.col("value") + _FAR)
    return rounded(bootstrap.circular_blocks(far, _D, _T, "value", 20, 10), 2, "std").select("asset", "rep", "std")


@query("""WITH s AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, avg(l_quantity) AS m FROM lineitem GROUP BY ALL),
e AS (SELECT *, syy * (1 - r2) AS rss, syy * (1 - r2) / (n - 2) AS s2 FROM s)
SELECT l_returnflag, unnest(['const', 'l_quantity']) AS term, unnest([round(sqrt(s2 * (1.0 / n + m * m / sxx)), 5), round(sqrt(s2 / sxx), 6)]) AS se, unnest([round(a / sqrt(s2 * (1.0 / n + m * m / sxx)), 4), round(b / sqrt(s2 / sxx), 4)]) AS t,
round(r2 / (1 - r2) * (n - 2), 2) AS f, round(4 + n * (ln(2 * pi() * rss / n) + 1), 3) AS aic, round(2 * ln(n) + n * (ln(2 * pi() * rss / n) + 1), 3) AS bic, round(1 - (1 - r2) * (n - 1) / (n - 2), 8) AS adj_r2, n - 2 AS df_resid FROM e""")
def x1_ols_errors(spark, d):
    o = regress.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_returnflag"])
    five, six = rounded(o.withColumn("s5", F.col("se")), 5, "s5"), None
    six = rounded(rounded(rounded(rounded(rounded(five.withColumn("s6", F.col("se")), 6, "s6"), 4, "t"), 2, "f"), 3, "aic", "bic"), 8, "adj_r2")
    return six.select("l_returnflag", "term", F.when(F.col("term") == "const", F.col("s5")).otherwise(F.col("s6")).alias("se"), "t", "f", "aic", "bic", "adj_r2", "df_resid")


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice - sum(l_quantity * l_extendedprice) OVER () / sum(l_quantity * l_quantity) OVER () * l_quantity, 2) AS residual FROM lineitem""")
def x3_residuals_through_zero(spark, d):
    """A line through zero has no constant term."""
    i = table(spark, d, "lineitem")
    fit = regress.ols(i, "l_extendedprice", ["l_quantity"], constant=False)
    return rounded(regress.predict(i, fit, "l_extendedprice", ["l_quantity"]), 2, "residual").select("l_orderkey", "l_linenumber", "residual")


@query("""WITH m AS (SELECT avg(l_quantity) AS a, stddev_samp(l_quantity) AS sa, avg(l_extendedprice) AS b, stddev_samp(l_extendedprice) AS sb, sign(corr(l_quantity, l_extendedprice)) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, round(abs((l_quantity - a) / sa + s * (l_extendedprice - b) / sb) / sqrt(2::DOUBLE), 6) AS size FROM lineitem, m""")
def x5_project_standardized(spark, d):
    i, columns = table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]
    p = regress.project(i, regress.pca(i, columns, 1, True), columns).withColumn("size", F.abs("pc_1"))
    return rounded(p, 6, "size").select("l_orderkey", "l_linenumber", "size")


# -- likelihoods, filters -----------------------------------------------------------

_SKEW_A, _SKEW_B, _ = hansen(6.0, -0.3)
_GED_SCALE = math.exp(0.5 * (-2 / 1.5 * math.log(2) + math.lgamma(1 / 1.5) - math.lgamma(3 / 1.5)))


@query(f"""WITH {_R}, z AS (SELECT asset, ret, 0.5 * v0 + 0.5 * ret * ret + 0.01 AS v FROM o), y AS (SELECT asset, v, ret / sqrt(v) AS z, {_SKEW_B!r} * ret / sqrt(v) + {_SKEW_A!r} AS y FROM z)
SELECT asset, round(sum(ln(1.5) - ln(pow(2::DOUBLE, 1 + 1 / 1.5) * gamma(1 / 1.5) * {_GED_SCALE!r}) - 0.5 * pow(abs(z) / {_GED_SCALE!r}, 1.5) - 0.5 * ln(v)), 4) AS ged,
round(sum(({log_constant("skewt", 6.0, -0.3)!r}) - 3.5 * ln(1 + pow(y / CASE WHEN y < 0 THEN 1.3 ELSE 0.7 END, 2) / 4) - 0.5 * ln(v)), 4) AS skewt,
round(sum(lgamma(4.5) - lgamma(4) - 0.5 * ln(pi() * 6) - 4.5 * ln(1 + z * z / 6) - 0.5 * ln(v)), 4) AS t, count(*) AS n FROM y GROUP BY asset""")
def v8_likelihood_families(spark, d):
    """One variance path under three families of innovations."""
    path = _level_path(spark, d).withColumn("var", 0.5 * F.col("var") + 0.5 * F.col("ret") ** 2 + 0.01)
    of = lambda name, nu, lam=0.0: volatility.log_likelihood(path, _D, "ret", name, nu, lam)
    out = of("ged", 1.5).select("asset", F.col("loglik").alias("ged")).join(of("skewt", 6.0, -0.3).select("asset", F.col("loglik").alias("skewt")), "asset")
    return rounded(out.join(of("t", 8.0).select("asset", F.col("loglik").alias("t"), "n"), "asset"), 4, "ged", "skewt", "t")


_WINDOWS = ("triangular", "bartlett", "hamming", "blackman", "parzen", "gaussian")
_SHAPES = {
    "triangular": "1 - abs(u)", "bartlett": "1 - abs(u)", "hamming": "0.54 + 0.46 * cos(pi() * u)", "blackman": "0.42 + 0.5 * cos(pi() * u) + 0.08 * cos(2 * pi() * u)",
    "parzen": "CASE WHEN abs(u) <= 0.5 THEN 1 - 6 * u * u + 6 * abs(u) ** 3 ELSE 2 * (1 - abs(u)) ** 3 END", "gaussian": "exp(-0.5 * (u * 2.5) ** 2)",
}
_KINDS = " UNION ALL ".join(f"SELECT '{k}' AS kind, j, {s} AS g FROM (SELECT j, {'2 * (j + 0.5::DOUBLE) / 7 - 1' if k in ('triangular', 'parzen') else '2 * j / 6.0::DOUBLE - 1'} AS u FROM range(7) r(j))" for k, s in _SHAPES.items())


@query(f"""WITH {DAILY}, o AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i FROM daily), w AS ({_KINDS}),
s AS (SELECT o.asset, o.ts, w.kind, sum(w.g * p.value) / sum(w.g) AS x FROM o JOIN w ON true JOIN o p ON p.asset = o.asset AND p.i = o.i - 6 + w.j WHERE o.i >= 7 GROUP BY ALL)
SELECT asset, ts::DATE::VARCHAR AS day, kind, round(x, 3) AS wmean FROM s""")
def w6_window_kinds(spark, d):
    """Weighted means over windows of every kind."""
    s = daily(spark, d)
    for k in _WINDOWS:
        s = series.weighted_rolling(s, _D, _T, "value", 7, k, k)
    long = s.unpivot(["asset", "ts"], list(_WINDOWS), "kind", "wmean").where("wmean IS NOT NULL")
    return rounded(long, 3, "wmean").select("asset", _day(), "kind", "wmean")


@query(f"""WITH RECURSIVE {PANEL}, o AS (SELECT asset, ts, CASE WHEN (epoch_us(ts) // 86400000000) % 5 <> 0 THEN value END AS value, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i FROM panel),
e AS (SELECT asset, ts, i, value, coalesce(value, 0)::DOUBLE AS num, (value IS NOT NULL)::INT::DOUBLE AS den FROM o WHERE i = 1
UNION ALL SELECT o.asset, o.ts, o.i, o.value, CASE WHEN o.value IS NULL THEN e.num ELSE 0.8 * e.num + o.value END, CASE WHEN o.value IS NULL THEN e.den ELSE 0.8 * e.den + 1 END FROM e JOIN o ON o.asset = e.asset AND o.i = e.i + 1)
SELECT asset, ts::DATE::VARCHAR AS day, CASE WHEN value IS NOT NULL THEN round(num / den, 3) END AS ewma FROM e""")
def w8_ewma_adjusted(spark, d):
    """Adjusted weights, holes, and series cut into quarters of a year."""
    micros = F.unix_micros("ts")
    p = panel(spark, d).withColumn("value", F.when(F.pmod(F.floor(micros / 86_400_000_000), F.lit(5)) != 0, F.col("value")))
    e = series.ewma(p, _D, _T, "value", 0.2, True, chunk=F.floor(micros / (91 * 86_400_000_000)))
    return rounded(e, 3, "ewma").select("asset", _day(), "ewma")


@query(_FILTER + " SELECT asset, ts::DATE::VARCHAR AS day, round(e, 8) AS residual FROM p")
def x8_residuals_in_chunks(spark, d):
    chunk = F.floor(F.unix_micros("ts") / (100 * 86_400_000_000))
    return rounded(arma.arma_residuals(_rets(spark, d), _D, _T, "ret", _given(spark, d), chunk=chunk), 8, "residual").select("asset", _day(), "residual")


@query(f"""{_DCC} SELECT q.ts::DATE::VARCHAR AS day, q.i, q.j, round(q.q / sqrt(a.q * b.q), 6) AS corr FROM q JOIN q a ON a.ts = q.ts AND a.i = q.i AND a.j = q.i JOIN q b ON b.ts = q.ts AND b.i = q.j AND b.j = q.j""")
def v19_correlation_in_chunks(spark, d):
    chunk = F.floor(F.unix_micros("ts") / (100 * 86_400_000_000))
    return rounded(multivariate.dynamic_correlation(_zz(spark, d), 0.05, 0.9, chunk), 6, "corr").select(_day(), "i", "j", "corr")


# -- gaps and trends of cut series ------------------------------------------------------


@query(f"""WITH {GAPS}, o AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i FROM g),
e AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY i) AS pi, last_value(value IGNORE NULLS) OVER (PARTITION BY asset ORDER BY i) AS pv,
first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qi,
first_value(value IGNORE NULLS) OVER (PARTITION BY asset ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qv FROM o)
SELECT asset, ts::DATE::VARCHAR AS day, round(pv, 3) AS ffill, CASE WHEN qi - i <= 1 THEN round(qv, 3) END AS bfill_1, round(coalesce(value, pv + (qv - pv) * (i - pi) / nullif(qi - pi, 0), pv), 3) AS linear FROM e""")
def c2_c3_fill_in_chunks(spark, d):
    """Fills of series cut into months, in which no window spans a series."""
    chunk = F.floor(F.unix_micros("ts") / (30 * 86_400_000_000))
    g = clean.fills(gaps(spark, d), _D, _T, "value", {"ffill": ("ffill", None), "bfill_1": ("bfill", 1), "linear": ("linear", None)}, chunk)
    return rounded(g, 3, "ffill", "bfill_1", "linear").select("asset", _day(), "ffill", "bfill_1", "linear")


@query(None)
def w11_trend_in_blocks(spark, d):
    """The trend of series cut into blocks of about 256 days; tests hold it against the whole solve."""
    chunk = F.floor(F.unix_micros("ts") / (200 * 86_400_000_000))
    return rounded(series.hodrick_prescott(daily(spark, d), _D, _T, "value", 1600.0, chunk=chunk, block=256), 2, "trend").select("asset", _day(), "trend")
