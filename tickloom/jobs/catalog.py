"""Every registered query of the core library, next to the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basic import calendar, finite, safe_divide, uniform
from ..operators import align, bars, bootstrap, clean, densities, describe, diagnostics, fits, realized, regress, series, volatility
from . import inference, models  # noqa: F401  register their queries
from .tables import DAILY, GAPS, PANEL, PRETS, RETS, TICKS, daily, daily_returns, gaps, panel, panel_returns, table, ticks
from .tools import NUDGE, oracle_sql, queries, query, rounded, rounded_binary  # noqa: F401

_D, _T = ["asset"], ["ts"]

# -- checks and calendar ------------------------------------------------------


@query("""SELECT column_name, n, n_null, n_nan, n_inf FROM (
  SELECT 'value' AS column_name, count(*) AS n, count(*) FILTER (value IS NULL) AS n_null, count(*) FILTER (isnan(value)) AS n_nan, count(*) FILTER (isinf(value)) AS n_inf FROM events)""")
def p1_finite_report(spark, d):
    return series.finite_report(table(spark, d, "events"), ["value"])


@query("SELECT event_type, count(*) FILTER (value > 0) AS kept, count(*) FILTER (value <= 0) AS dropped FROM events GROUP BY ALL")
def p2_positive_prices(spark, d):
    e = table(spark, d, "events").withColumn("v", finite(F.col("value")))
    return e.groupBy("event_type").agg(F.count_if(F.col("v") > 0).alias("kept"), F.count_if(F.col("v") <= 0).alias("dropped"))


@query("""WITH e AS (SELECT *, ts = lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS same FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (same) AS n_duplicates, count(*) FILTER (value IS NULL) AS n_missing,
  count(*) >= 60 AND count(*) FILTER (same) = 0 AND count(*) FILTER (value IS NULL) = 0 AS valid FROM e GROUP BY ALL""")
def p3_series_report(spark, d):
    return series.series_report(table(spark, d, "events"), ["user_id"], "ts", "value", 60)


@query("SELECT event_id, user_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'")
def p4_date_range(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return series.date_range(e, "ts", "2024-01-10", "2024-01-12").select("event_id", "user_id", "value")


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN 0 ELSE l_extendedprice / l_discount END, 2) AS ratio FROM lineitem")
def p5_safe_divide(spark, d):
    i = table(spark, d, "lineitem")
    return rounded(i.select("l_orderkey", "l_linenumber", safe_divide(F.col("l_extendedprice"), F.col("l_discount")).alias("ratio")), 2, "ratio")


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day, (isodow(o_orderdate) - 1)::INT AS dayofweek,
  dayofyear(o_orderdate)::INT AS dayofyear, quarter(o_orderdate)::INT AS quarter, weekofyear(o_orderdate)::INT AS week, dayname(o_orderdate) AS weekday_name,
  day(o_orderdate) = 1 AS is_month_start, o_orderdate::DATE = last_day(o_orderdate) AS is_month_end,
  o_orderdate::DATE = (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS is_quarter_end, isodow(o_orderdate) >= 6 AS is_weekend FROM orders""")
def p6_calendar(spark, d):
    c = calendar(F.col("o_orderdate"))
    keep = ["year", "month", "day", "dayofweek", "dayofyear", "quarter", "week", "weekday_name", "is_month_start", "is_month_end", "is_quarter_end", "is_weekend"]
    return table(spark, d, "orders").select("o_orderkey", *[c[k].alias(k) for k in keep])


# -- returns and windows ------------------------------------------------------


@query(f"""WITH {DAILY} SELECT asset, ts::DATE::VARCHAR AS day, round(ln(value / lag(value) OVER w), 8) AS log_ret, round(value / lag(value) OVER w - 1, 8) AS simple_ret,
  round(100 * (value / lag(value, 2) OVER w - 1), 6) AS pct_ret FROM daily WINDOW w AS (PARTITION BY asset ORDER BY ts)""")
def w1_returns(spark, d):
    df = daily(spark, d)
    for method, periods, name in (("log", 1, "log_ret"), ("simple", 1, "simple_ret"), ("percentage", 2, "pct_ret")):
        df = series.returns(df, _D, _T, "value", method, periods, name)
    return rounded(rounded(df, 8, "log_ret", "simple_ret"), 6, "pct_ret").select("asset", F.to_date("ts").cast("string").alias("day"), "log_ret", "simple_ret", "pct_ret")


@query(f"""WITH {DAILY} SELECT asset, ts::DATE::VARCHAR AS day, round(value - 2 * lag(value) OVER w + lag(value, 2) OVER w, 4) AS diff
FROM daily WINDOW w AS (PARTITION BY asset ORDER BY ts)""")
def w3_second_difference(spark, d):
    return rounded(series.difference(daily(spark, d), _D, _T, "value", 2), 4, "diff").select("asset", F.to_date("ts").cast("string").alias("day"), "diff")


@query(f"""WITH {DAILY} SELECT * FROM (SELECT asset, ts::DATE::VARCHAR AS day, round(value, 4) AS value, round(lag(value) OVER w, 4) AS lag_1, round(lag(value, 2) OVER w, 4) AS lag_2, round(lag(value, 3) OVER w, 4) AS lag_3
FROM daily WINDOW w AS (PARTITION BY asset ORDER BY ts)) WHERE lag_3 IS NOT NULL""")
def w4_lag_table(spark, d):
    t = series.lag_table(daily(spark, d), _D, _T, "value", 3)
    return rounded(t, 4, "value", "lag_1", "lag_2", "lag_3").select("asset", F.to_date("ts").cast("string").alias("day"), "value", "lag_1", "lag_2", "lag_3")


@query(f"""WITH {DAILY} SELECT asset, ts::DATE::VARCHAR AS day, CASE WHEN count(*) OVER w = 20 THEN round(avg(value) OVER w, 3) END AS roll_mean, CASE WHEN count(*) OVER w = 20 THEN round(stddev_samp(value) OVER w, 3) END AS roll_std,
  CASE WHEN count(*) OVER w = 20 THEN round(min(value) OVER w, 3) END AS roll_min, CASE WHEN count(*) OVER w = 20 THEN round(max(value) OVER w, 3) END AS roll_max
FROM daily WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS 19 PRECEDING)""")
def w5_rolling(spark, d):
    r = series.rolling(daily(spark, d), _D, _T, "value", 20, ("mean", "std", "min", "max"))
    return rounded(r, 3, "roll_mean", "roll_std", "roll_min", "roll_max").select("asset", F.to_date("ts").cast("string").alias("day"), "roll_mean", "roll_std", "roll_min", "roll_max")


@query(f"""WITH {DAILY} SELECT asset, ts::DATE::VARCHAR AS day, round((lag(value, 2) OVER w * (1.0/3) + lag(value) OVER w + value * (1.0/3)) / (5.0/3), 3) AS wmean
FROM daily WINDOW w AS (PARTITION BY asset ORDER BY ts)""")
def w6_weighted_rolling(spark, d):
    return rounded(series.weighted_rolling(daily(spark, d), _D, _T, "value", 3), 3, "wmean").select("asset", F.to_date("ts").cast("string").alias("day"), "wmean")


@query(f"""WITH {DAILY}, s AS (SELECT asset, ts, row_number() OVER w AS pos, list(round(value, 3)) OVER (PARTITION BY asset ORDER BY ts ROWS 4 PRECEDING) AS v FROM daily WINDOW w AS (PARTITION BY asset ORDER BY ts))
SELECT asset, ts::DATE::VARCHAR AS day, array_to_string(list_transform(v, lambda x: printf('%.3f', x)), ',') AS shown FROM s WHERE pos >= 5 AND (pos - 5) % 3 = 0""")
def w7_sliding(spark, d):
    s = series.sliding(daily(spark, d), _D, _T, "value", 5, 3)
    shown = F.array_join(F.transform("values", lambda x: F.format_string("%.3f", F.round(x + NUDGE * 1e-3, 3) + F.lit(0.0))), ",")
    return s.select("asset", F.to_date("ts").cast("string").alias("day"), shown.alias("shown"))


@query(f"""WITH RECURSIVE {PANEL}, o AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i FROM panel),
e AS (SELECT asset, ts, i, value AS s FROM o WHERE i = 1 UNION ALL SELECT o.asset, o.ts, o.i, 0.9 * e.s + 0.1 * o.value FROM e JOIN o ON o.asset = e.asset AND o.i = e.i + 1)
SELECT asset, ts::DATE::VARCHAR AS day, round(s, 3) AS ewma FROM e""")
def w8_ewma(spark, d):
    return rounded(series.ewma(panel(spark, d), _D, _T, "value", 0.1), 3, "ewma").select("asset", F.to_date("ts").cast("string").alias("day"), "ewma")


@query(f"""WITH {DAILY} SELECT asset, ts::DATE::VARCHAR AS day, round(avg(value) OVER w, 3) AS smooth, round(sum(value) OVER w / 5, 3) AS zero_padded
FROM daily WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def w9_moving_average(spark, d):
    m = series.moving_average(series.moving_average(daily(spark, d), _D, _T, "value", 5), _D, _T, "value", 5, "zero", "zero_padded")
    return rounded(m, 3, "smooth", "zero_padded").select("asset", F.to_date("ts").cast("string").alias("day"), "smooth", "zero_padded")


@query(f"""WITH {RETS}, o AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i FROM rets WHERE ret IS NOT NULL)
SELECT a.asset, a.ts::DATE::VARCHAR AS day, round(sum(b.ret * exp(-0.5 * (a.i - b.i) ** 2)) / sum(exp(-0.5 * (a.i - b.i) ** 2)), 8) AS smooth
FROM o a JOIN o b ON a.asset = b.asset AND b.i BETWEEN a.i - 6 AND a.i + 6 GROUP BY a.asset, a.ts""")
def w10_kernel_smooth(spark, d):
    return rounded(series.kernel_smooth(daily_returns(spark, d), _D, _T, "ret", 1.0), 8, "smooth").select("asset", F.to_date("ts").cast("string").alias("day"), "smooth")


@query(f"""WITH {RETS} SELECT asset, ts::DATE::VARCHAR AS day, round(CASE WHEN abs(ret) < 0.05 * avg(abs(ret)) OVER (PARTITION BY asset) THEN 0 ELSE ret END, 8) AS filtered
FROM rets WHERE ret IS NOT NULL""")
def w12_threshold(spark, d):
    return rounded(series.threshold_filter(daily_returns(spark, d), _D, "ret"), 8, "filtered").select("asset", F.to_date("ts").cast("string").alias("day"), "filtered")


# -- bars and sampling --------------------------------------------------------


@query(f"""WITH {TICKS} SELECT symbol, us - us % 3600000000 AS bucket, round(avg(price), 6) AS mean, round(median(price), 6) AS median
FROM ticks GROUP BY ALL""")
def r1_resample(spark, d):
    t = ticks(spark, d)
    out = bars.resample(t, ["symbol"], "ts", "price", 3600).withColumnRenamed("price", "mean").join(bars.resample(t, ["symbol"], "ts", "price", 3600, "median").withColumnRenamed("price", "median"), ["symbol", "bucket"])
    return rounded(out, 6, "mean", "median").withColumn("bucket", F.unix_micros("bucket"))


@query(f"""WITH {TICKS}, b AS (SELECT symbol, us - us % 3600000000 AS b, sum(volume) AS volume FROM ticks GROUP BY ALL),
g AS (SELECT symbol, unnest(range(min(b), max(b) + 1, 3600000000)) AS b FROM b GROUP BY symbol)
SELECT g.symbol, g.b AS bucket, b.volume FROM g LEFT JOIN b ON g.symbol = b.symbol AND g.b = b.b""")
def r2_dense_bars(spark, d):
    b = bars.resample(ticks(spark, d), ["symbol"], "ts", "volume", 3600, "sum")
    return bars.dense(b, ["symbol"], 3600).withColumn("bucket", F.unix_micros("bucket"))


@query(f"""WITH {TICKS} SELECT symbol, us - us % 1800000000 AS bucket, arg_min(price, (us, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (us, seq)) AS close,
  sum(volume) AS volume, round(sum(price * volume) / nullif(sum(volume), 0), 6) AS vwap, round(avg(price), 6) AS twap, count(*) AS n_ticks FROM ticks GROUP BY ALL""")
def r3_price_bars(spark, d):
    return rounded(bars.price_bars(ticks(spark, d), 1800), 6, "vwap", "twap").withColumn("bucket", F.unix_micros("bucket"))


_CAL = f"""{TICKS}, c AS (SELECT *, (us - min(us) OVER (PARTITION BY symbol, date)) // 1800000000 AS bucket FROM ticks),
s AS (SELECT symbol, date, bucket, arg_min(price, (us, seq)) AS price, min(us) AS us FROM c GROUP BY ALL)"""


@query(f"WITH {_CAL} SELECT symbol, date, bucket, price FROM s")
def r6_calendar_sampling(spark, d):
    return bars.sample_calendar(ticks(spark, d), 1800).select("symbol", "date", "bucket", "price")


@query(f"WITH {TICKS} SELECT symbol, date, seq, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY ts, seq) AS i FROM ticks) WHERE (i - 1) % 5 = 0")
def r7_business_sampling(spark, d):
    return bars.sample_business(ticks(spark, d), 5).select("symbol", "date", "seq", "price")


@query(f"""WITH {TICKS}, g AS (SELECT symbol, date, min(us) + floor(k * (max(us) - min(us)) / 11)::BIGINT AS at FROM ticks, range(12) r(k) GROUP BY symbol, date, k),
n AS (SELECT g.symbol, g.date, g.at, arg_min(t.seq, (abs(t.us - g.at), t.us, t.seq)) AS seq FROM g JOIN ticks t ON t.symbol = g.symbol AND t.date = g.date GROUP BY ALL)
SELECT DISTINCT n.symbol, n.date, n.seq, t.price FROM n JOIN ticks t ON t.seq = n.seq""")
def r8_calendar_uniform(spark, d):
    return bars.sample_calendar_uniform(ticks(spark, d), 12).select("symbol", "date", "seq", "price")


@query(f"""WITH {TICKS}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY ts, seq) - 1 AS i, count(*) OVER (PARTITION BY symbol, date) AS n FROM ticks),
k AS (SELECT DISTINCT symbol, date, (k * (n - 1)) // 9 AS i FROM o, range(10) r(k))
SELECT o.symbol, o.date, o.seq, o.price FROM o JOIN k ON o.symbol = k.symbol AND o.date = k.date AND o.i = k.i""")
def r9_business_uniform(spark, d):
    return bars.sample_business_uniform(ticks(spark, d), 10).select("symbol", "date", "seq", "price")


@query(f"""WITH {TICKS} SELECT symbol, date, seq, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY ts, seq) - 1 AS i, count(*) OVER (PARTITION BY symbol, date) AS n FROM ticks)
WHERE i % greatest(n // 20, 1) = 0""")
def r10_fixed_sampling(spark, d):
    return bars.sample_fixed(ticks(spark, d), 20).select("symbol", "date", "seq", "price")


# -- cleaning -----------------------------------------------------------------

@query(f"""WITH {GAPS} SELECT asset, ts::DATE::VARCHAR AS day, round(last_value(value IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts), 3) AS ffill,
  round(first_value(value IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 3) AS bfill,
  round(last_value(value IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS 1 PRECEDING), 3) AS ffill_1 FROM g""")
def c2_fill(spark, d):
    g = gaps(spark, d).withColumns({"ffill": F.col("value"), "bfill": F.col("value"), "ffill_1": F.col("value")})
    g = clean.fill(clean.fill(clean.fill(g, _D, _T, "ffill"), _D, _T, "bfill", "bfill"), _D, _T, "ffill_1", "ffill", 1)
    return rounded(g, 3, "ffill", "bfill", "ffill_1").select("asset", F.to_date("ts").cast("string").alias("day"), "ffill", "bfill", "ffill_1")


@query(f"""WITH {GAPS}, o AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i FROM g),
e AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY i) AS pi, last_value(value IGNORE NULLS) OVER (PARTITION BY asset ORDER BY i) AS pv,
  first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qi,
  first_value(value IGNORE NULLS) OVER (PARTITION BY asset ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qv FROM o)
SELECT asset, ts::DATE::VARCHAR AS day, round(coalesce(value, pv + (qv - pv) * (i - pi) / nullif(qi - pi, 0), pv), 3) AS value FROM e""")
def c3_interpolate(spark, d):
    return rounded(clean.fill(gaps(spark, d), _D, _T, "value", "linear"), 3, "value").select("asset", F.to_date("ts").cast("string").alias("day"), "value")


@query(f"""WITH {GAPS} SELECT asset, ts::DATE::VARCHAR AS day, round(coalesce(value, avg(value) OVER (PARTITION BY asset)), 3) AS mean, round(coalesce(value, median(value) OVER (PARTITION BY asset)), 3) AS median FROM g""")
def c5_fill_statistic(spark, d):
    g = gaps(spark, d).withColumns({"mean": F.col("value"), "median": F.col("value")})
    g = clean.fill_statistic(clean.fill_statistic(g, _D, "mean"), _D, "median", "median")
    return rounded(g, 3, "mean", "median").select("asset", F.to_date("ts").cast("string").alias("day"), "mean", "median")


@query(f"""WITH {RETS}, m AS (SELECT asset, avg(ret) AS a, stddev_pop(ret) AS s, quantile_cont(ret, 0.25) AS q1, quantile_cont(ret, 0.75) AS q3, median(ret) AS med FROM rets WHERE ret IS NOT NULL GROUP BY asset),
k AS (SELECT r.asset, median(abs(ret - med)) AS mad FROM rets r JOIN m USING (asset) WHERE ret IS NOT NULL GROUP BY r.asset)
SELECT r.asset, r.ts::DATE::VARCHAR AS day, abs(ret - a) > 2 * s AS z, ret < q1 - 1.5 * (q3 - q1) OR ret > q3 + 1.5 * (q3 - q1) AS iqr, abs(ret - med) * 0.6745 > 3 * mad AS modified
FROM rets r JOIN m ON r.asset = m.asset JOIN k ON r.asset = k.asset WHERE ret IS NOT NULL""")
def c7_outliers(spark, d):
    r = daily_returns(spark, d)
    out = None
    for method, limit, name in (("zscore", 2.0, "z"), ("iqr", 1.5, "iqr"), ("mad", 3.0, "modified")):
        one = clean.outliers(r, _D, "ret", method, limit).select("asset", "ts", F.col("outlier").alias(name))
        out = one if out is None else out.join(one, ["asset", "ts"])
    return out.select("asset", F.to_date("ts").cast("string").alias("day"), "z", "iqr", "modified")


@query(f"""WITH {TICKS}, r AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY symbol, date ORDER BY ts, seq)) AS r FROM ticks),
b AS (SELECT *, coalesce(abs(r - avg(r) OVER (PARTITION BY symbol, date)) > 2.5 * stddev_pop(r) OVER (PARTITION BY symbol, date), false) AS bad FROM r),
n AS (SELECT *, coalesce(lead(bad) OVER (PARTITION BY symbol, date ORDER BY ts, seq), false) AS nb FROM b)
SELECT symbol, date, seq, price FROM n WHERE NOT bad AND NOT nb""")
def c10_tick_outliers(spark, d):
    return clean.drop_tick_outliers(ticks(spark, d), limit=2.5).select("symbol", "date", "seq", "price")


@query(f"""WITH {DAILY} SELECT asset, ts::DATE::VARCHAR AS day, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS z,
  round((value - median(value) OVER w) / (quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w), 6) AS rz FROM daily WINDOW w AS (PARTITION BY asset)""")
def c11_standardize(spark, d):
    p = daily(spark, d)
    out = clean.standardize(clean.standardize(p, _D, "value", clean.scaling(p, _D, "value")), _D, "value", clean.scaling(p, _D, "value", True), "rz")
    return rounded(out, 6, "z", "rz").select("asset", F.to_date("ts").cast("string").alias("day"), "z", "rz")


@query(f"""WITH {DAILY} SELECT asset, ts::DATE::VARCHAR AS day, row_number() OVER (PARTITION BY asset ORDER BY ts) <= floor(count(*) OVER (PARTITION BY asset) * 0.8) AS by_share, ts <= TIMESTAMP '1998-06-30 00:00:00' AS by_date FROM daily""")
def c12_splits(spark, d):
    s = clean.split_date(clean.split_fraction(daily(spark, d), _D, _T, 0.8).withColumnRenamed("train", "by_share"), "ts", "1998-06-30")
    return s.select("asset", F.to_date("ts").cast("string").alias("day"), "by_share", F.col("train").alias("by_date"))


# -- joins --------------------------------------------------------------------


@query(f"""WITH {PANEL}, a AS (SELECT DISTINCT asset FROM panel), t AS (SELECT DISTINCT ts FROM panel)
SELECT a.asset, t.ts::DATE::VARCHAR AS day, round(last_value(p.value IGNORE NULLS) OVER (PARTITION BY a.asset ORDER BY t.ts), 3) AS value
FROM a CROSS JOIN t LEFT JOIN panel p ON p.asset = a.asset AND p.ts = t.ts""")
def j3_align_outer_ffill(spark, d):
    return rounded(align.align(panel(spark, d), "outer", "ffill"), 3, "value").select("asset", F.to_date("ts").cast("string").alias("day"), "value")


@query(f"""WITH {DAILY}, c AS (SELECT ts FROM daily GROUP BY ts HAVING count(DISTINCT asset) = (SELECT count(DISTINCT asset) FROM daily))
SELECT asset, ts::DATE::VARCHAR AS day, round(value, 3) AS value FROM daily WHERE ts IN (SELECT ts FROM c)""")
def j2_align_inner(spark, d):
    return rounded(align.align(daily(spark, d), "inner"), 3, "value").select("asset", F.to_date("ts").cast("string").alias("day"), "value")


@query(f"""WITH {TICKS} SELECT a.symbol, a.seq, arg_min(b.price, (abs(a.us - b.us), b.us)) AS nearest FROM ticks a JOIN ticks b ON a.date = b.date AND b.symbol = 'click' WHERE a.symbol <> 'click' GROUP BY a.symbol, a.seq""")
def j4_align_nearest(spark, d):
    t = ticks(spark, d)
    near = align.align_nearest(t.where("symbol <> 'click'"), t.where("symbol = 'click'"), ["date"], value="price")
    return near.where("nearest is not null").select("symbol", "seq", "nearest")


_ACTIONS = "f AS (SELECT asset AS symbol, ts, 0.5 + 0.001 * asset AS factor FROM panel WHERE (epoch_us(ts) // 86400000000) % 400 = asset % 400)"


@query(f"""WITH {PANEL}, {_ACTIONS} SELECT p.asset AS symbol, p.ts::DATE::VARCHAR AS day, round(p.value * coalesce(exp(sum(ln(f.factor))), 1), 3) AS adjusted
FROM panel p LEFT JOIN f ON f.symbol = p.asset AND f.ts > p.ts GROUP BY p.asset, p.ts, p.value""")
def j7_split_adjustment(spark, d):
    p = panel(spark, d).select(F.col("asset").alias("symbol"), "ts", F.col("value").alias("price"))
    when = F.pmod(F.floor(F.unix_micros("ts") / 86_400_000_000), F.lit(400)) == F.col("symbol") % 400
    f = p.where(when).select("symbol", "ts", (0.5 + 0.001 * F.col("symbol")).alias("factor"))
    return rounded(align.adjust(p, f), 3, "adjusted").select("symbol", F.to_date("ts").cast("string").alias("day"), "adjusted")


@query(f"""WITH {PANEL}, dv AS (SELECT asset AS symbol, max(ts) - INTERVAL 400 DAY AS ts, 100.0 AS value FROM panel GROUP BY asset)
SELECT dv.symbol, dv.ts::DATE::VARCHAR AS day, round((arg_min(p.value, p.ts) + 100) / arg_min(p.value, p.ts), 8) AS factor FROM dv JOIN panel p ON p.asset = dv.symbol AND p.ts >= dv.ts GROUP BY dv.symbol, dv.ts""")
def j8_dividend_factors(spark, d):
    p = panel(spark, d).select(F.col("asset").alias("symbol"), "ts", F.col("value").alias("price"))
    dv = p.groupBy("symbol").agg((F.max("ts") - F.expr("interval 400 days")).alias("ts"), F.lit(100.0).alias("value"))
    return rounded(align.dividend_factors(p, dv), 8, "factor").select("symbol", F.to_date("ts").cast("string").alias("day"), "factor")


@query(f"""WITH {DAILY} SELECT a.asset AS i, b.asset AS j, count(*) AS n, round(corr(a.value, b.value), 8) AS corr FROM daily a JOIN daily b ON a.ts = b.ts AND a.asset <= b.asset GROUP BY ALL""")
def j10_pair_correlations(spark, d):
    p = align.pairs(daily(spark, d))
    return rounded(p.groupBy("i", "j").agg(F.count("*").alias("n"), F.corr("value_i", "value_j").alias("corr")), 8, "corr")


# -- descriptive --------------------------------------------------------------


@query(f"""WITH {RETS}, m AS (SELECT *, ret - avg(ret) OVER (PARTITION BY asset) AS c FROM rets WHERE ret IS NOT NULL)
SELECT asset, round(avg(ret), 8) AS mean, round(median(ret), 8) AS median, round(stddev_samp(ret), 8) AS std, round(min(ret), 8) AS min, round(max(ret), 8) AS max, round(max(ret) - min(ret), 8) AS range,
  round(avg(c ** 3) / stddev_samp(ret) ** 3, 6) AS skew, round(avg(c ** 4) / stddev_samp(ret) ** 4 - 3, 6) AS kurtosis, count(*) AS n FROM m GROUP BY asset""")
def a1_summary(spark, d):
    return rounded(rounded(describe.summary(daily_returns(spark, d), _D, "ret"), 8, "mean", "median", "std", "min", "max", "range"), 6, "skew", "kurtosis")


@query("""WITH q AS (SELECT l_returnflag, median(l_extendedprice) AS median, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY ALL),
m AS (SELECT l_returnflag, median(abs(l_extendedprice - median)) AS mad FROM lineitem JOIN q USING (l_returnflag) GROUP BY ALL)
SELECT l_returnflag, round(median, 3) AS median, round(q1, 3) AS q1, round(q3, 3) AS q3, round(q3 - q1, 3) AS iqr, round(mad, 3) AS mad FROM q JOIN m USING (l_returnflag)""")
def a2_robust_summary(spark, d):
    return rounded(describe.robust_summary(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice"), 3, "median", "q1", "q3", "iqr", "mad")


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, round(covar_samp({a}, {b}), 3) AS cov, round(corr({a}, {b}), 7) AS corr FROM lineitem" for k, a in enumerate(_COLS) for b in _COLS[k:]))
def a4_correlation(spark, d):
    return rounded(rounded(describe.covariance(table(spark, d, "lineitem"), _COLS), 3, "cov"), 7, "corr")


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT round(corr(a, b), 8) AS spearman, count(*) AS n FROM r""")
def a5_spearman(spark, d):
    return rounded(describe.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), 8, "spearman")


_ACF = f"""{RETS}, c AS (SELECT asset, ts, ret - avg(ret) OVER (PARTITION BY asset) AS c FROM rets WHERE ret IS NOT NULL), l AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i FROM c),
v AS (SELECT asset, sum(c * c) AS s, count(*) AS n FROM l GROUP BY asset), a AS (SELECT x.asset, k.k AS lag, sum(x.c * y.c) / any_value(s) AS acf, any_value(n) AS n FROM l x JOIN range(1, 11) k(k) ON true JOIN l y ON y.asset = x.asset AND y.i = x.i - k.k JOIN v ON v.asset = x.asset GROUP BY ALL)"""


@query(f"WITH {_ACF} SELECT asset, n, lag::INT AS lag, round(acf, 8) AS acf, round(1.96 / sqrt(n), 8) AS band FROM a")
def a7_acf(spark, d):
    return rounded(describe.acf(daily_returns(spark, d), _D, _T, "ret", 10), 8, "acf", "band")


@query(None)
def a8_pacf(spark, d):
    return rounded(describe.pacf(daily_returns(spark, d), _D, _T, "ret", 5), 8, "pacf")


@query(f"""WITH {RETS} SELECT asset, round(avg(ret), 8) AS mean, round(stddev_pop(ret), 8) AS std, round(avg(ret) / stddev_pop(ret), 7) AS sharpe, round(-quantile_cont(ret, 0.05), 8) AS var FROM rets WHERE ret IS NOT NULL GROUP BY asset""")
def a11_risk(spark, d):
    return rounded(rounded(describe.risk(daily_returns(spark, d), _D), 8, "mean", "std", "var"), 7, "sharpe")


@query("""WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, stddev_samp(l_extendedprice) AS sd, count(*) AS n FROM lineitem),
b AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 2000)), 1999) AS b, count(*) AS c, any_value(lo) AS lo, any_value(hi) AS hi, any_value(sd) AS sd, any_value(n) AS n FROM lineitem, s GROUP BY ALL),
g AS (SELECT lo + k * (hi - lo) / 19 AS x, lo + (b + 0.5) * ((hi - lo) / 2000) AS m, sd * pow(n, -0.2) AS h, c, n FROM b, range(20) r(k))
SELECT round(x, 3) AS x, round(sum(c * exp(-0.5 * ((x - m) / h) ** 2) / (n * h * 2.5066282746310002)), 10) AS density FROM g GROUP BY g.x""")
def a12_density(spark, d):
    return rounded(rounded(describe.density(table(spark, d, "lineitem"), "l_extendedprice", 20), 3, "x"), 10, "density")


# -- realized measures --------------------------------------------------------

_RV = """r AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY symbol, date ORDER BY us)) AS ret FROM s)"""


@query("""WITH t AS (SELECT user_id AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, epoch_us(ts) AS us, event_id AS seq, value AS price FROM events WHERE value > 0),
c AS (SELECT *, (us - min(us) OVER (PARTITION BY symbol, date)) // 21600000000 AS bucket FROM t),
s AS (SELECT symbol, date, bucket, arg_min(price, (us, seq)) AS price, min(us) AS us FROM c GROUP BY ALL),
r AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY symbol, date ORDER BY us)) AS ret FROM s)
SELECT symbol, date, round(coalesce(sum(ret * ret), 0), 6) AS rv, count(ret) AS n_returns FROM r GROUP BY symbol, date""")
def m1_realized_variance(spark, d):
    return rounded(realized.realized_variance(bars.sample_calendar(ticks(spark, d, "user_id"), 21600)), 6, "rv")


@query(f"""WITH {_CAL}, {_RV}, f AS (SELECT symbol, date, avg(ret) OVER (PARTITION BY symbol, date ORDER BY us ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS f FROM r WHERE ret IS NOT NULL)
SELECT symbol, date, round(sum(f * f), 6) AS rv_filtered FROM f GROUP BY ALL""")
def m2_noise_filtered_variance(spark, d):
    return rounded(realized.noise_filtered_variance(bars.sample_calendar(ticks(spark, d), 1800)), 6, "rv_filtered")


@query(f"""WITH {_CAL}, {_RV} SELECT symbol, date, round(coalesce(sum(ret * ret), 0), 6) AS rv, count(ret) AS n_returns, round(sqrt(coalesce(sum(ret * ret), 0) * 252 * (nullif(max(us) - min(us), 0) / 86400000000.0) / count(*)), 6) AS volatility FROM r GROUP BY symbol, date""")
def m3_realized_volatility(spark, d):
    return rounded(realized.realized_volatility(bars.sample_calendar(ticks(spark, d), 1800)), 6, "rv", "volatility")


@query(f"""WITH {_CAL}, {_RV}, l AS (SELECT symbol, date, ret, lag(ret) OVER w AS l1, lag(ret, 2) OVER w AS l2 FROM r WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol, date ORDER BY us))
SELECT symbol, date, round(sum(ret * ret) + 2 * (2.0/3) * coalesce(sum(ret * l1), 0) + 2 * (1.0/3) * coalesce(sum(ret * l2), 0), 6) AS rk FROM l GROUP BY ALL""")
def m4_realized_kernel(spark, d):
    return rounded(realized.realized_kernel(bars.sample_calendar(ticks(spark, d), 1800), 3, "bartlett"), 6, "rk")


@query(f"""WITH {TICKS}, b AS (SELECT symbol, date, us // 3600000000 AS b, arg_max(price, (us, seq)) AS price FROM ticks GROUP BY ALL),
r AS (SELECT symbol, date, b, ln(price / lag(price) OVER (PARTITION BY symbol, date ORDER BY b)) AS ret FROM b)
SELECT x.date, x.symbol AS i, y.symbol AS j, round(sum(x.ret * y.ret), 6) AS rcov, count(*) AS n FROM r x JOIN r y ON x.date = y.date AND x.b = y.b AND x.symbol <= y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY ALL""")
def m6_realized_covariance(spark, d):
    return rounded(realized.realized_covariance(ticks(spark, d), 3600), 6, "rcov")


@query(f"""WITH {TICKS}, c AS (SELECT *, k AS seconds, (us - min(us) OVER (PARTITION BY symbol, date)) // (k::BIGINT * 1000000) AS bucket FROM ticks, (VALUES (900), (1800), (3600)) v(k)),
s AS (SELECT symbol, date, seconds, bucket, arg_min(price, (us, seq)) AS price, min(us) AS us FROM c GROUP BY ALL),
r AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY symbol, date, seconds ORDER BY us)) AS ret FROM s),
f AS (SELECT symbol, date, seconds, avg(ret) OVER (PARTITION BY symbol, date, seconds ORDER BY us ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS f FROM r WHERE ret IS NOT NULL),
g AS (SELECT symbol, date, seconds, sum(f * f) AS f FROM f GROUP BY ALL), v AS (SELECT symbol, date, seconds, coalesce(sum(ret * ret), 0) AS rv FROM r GROUP BY ALL)
SELECT symbol, date, seconds, round(rv, 6) AS rv, round(sqrt(rv), 6) AS volatility, round(f, 6) AS rv_filtered, round((f - rv) / nullif(rv, 0) * 100, 4) AS difference_pct FROM v LEFT JOIN g USING (symbol, date, seconds)""")
def m8_signature(spark, d):
    return rounded(rounded(realized.signature(ticks(spark, d), [900, 1800, 3600]), 6, "rv", "volatility", "rv_filtered"), 4, "difference_pct")


# -- regression ---------------------------------------------------------------


@query("""SELECT l_returnflag, 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 4) AS coef, round(regr_r2(l_extendedprice, l_quantity), 7) AS r2, count(*) AS n FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT l_returnflag, 'const', round(regr_intercept(l_extendedprice, l_quantity), 4), round(regr_r2(l_extendedprice, l_quantity), 7), count(*) FROM lineitem GROUP BY l_returnflag""")
def x1_ols(spark, d):
    o = regress.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_returnflag"])
    return rounded(rounded(o, 4, "coef"), 7, "r2").select("l_returnflag", "term", "coef", "r2", "n")


@query("""WITH m AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, round(l_extendedprice - a - b * l_quantity, 2) AS residual FROM lineitem JOIN m USING (l_returnflag)""")
def x3_residuals(spark, d):
    i = table(spark, d, "lineitem")
    o = regress.ols(i, "l_extendedprice", ["l_quantity"], ["l_returnflag"])
    return rounded(regress.predict(i, o, "l_extendedprice", ["l_quantity"], ["l_returnflag"]), 2, "residual").select("l_orderkey", "l_linenumber", "residual")


@query(None)
def x4_pca(spark, d):
    return rounded(regress.pca(table(spark, d, "lineitem"), _COLS, 2, True), 8, "eigenvalue", "ratio_total", "ratio_retained").drop("loadings")


# -- volatility ---------------------------------------------------------------

_O = "o AS (SELECT asset, ts, ret, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i, avg(ret * ret) OVER (PARTITION BY asset) AS v0 FROM prets WHERE ret IS NOT NULL)"


def _path(step: str, start: str = "v0") -> str:
    return f"""WITH RECURSIVE {PRETS}, {_O}, p AS (SELECT asset, ts, i, ret, {start} AS v FROM o WHERE i = 1
UNION ALL SELECT o.asset, o.ts, o.i, o.ret, {step} FROM p JOIN o ON o.asset = p.asset AND o.i = p.i + 1)"""


_GARCH = _path("0.05 + 0.1 * p.ret * p.ret + 0.8 * p.v")


def _garch(spark, d):
    return volatility.garch(panel_returns(spark, d).select("asset", "ts", "ret"), _D, _T, 0.05, 0.1, 0.8)


def _day(df: DataFrame, *columns: str) -> DataFrame:
    return rounded(df, 7, *columns).select("asset", F.to_date("ts").cast("string").alias("day"), *columns)


@query(f"{_GARCH} SELECT asset, ts::DATE::VARCHAR AS day, round(v, 7) AS var FROM p")
def v1_garch(spark, d):
    return _day(_garch(spark, d), "var")


@query(_path("0.01 + 0.1 * p.ret * p.ret + 0.9 * p.v", "0.5::DOUBLE") + " SELECT asset, ts::DATE::VARCHAR AS day, round(v, 7) AS var FROM p")
def v2_igarch(spark, d):
    return _day(volatility.igarch(panel_returns(spark, d).select("asset", "ts", "ret"), _D, _T, 0.01, 0.1), "var")


@query(_path("0.05 + (0.05 + CASE WHEN p.ret < 0 THEN 0.1 ELSE 0 END) * p.ret * p.ret + 0.8 * p.v") + " SELECT asset, ts::DATE::VARCHAR AS day, round(v, 7) AS var FROM p")
def v3_tarch(spark, d):
    return _day(volatility.tarch(panel_returns(spark, d).select("asset", "ts", "ret"), _D, _T, 0.05, 0.05, 0.1, 0.8), "var")


@query(_path("0.05 + 0.1 * pow(abs(p.ret) - 0.2 * p.ret, 1.5) + 0.8 * p.v", "(SELECT avg(pow(abs(x.ret), 1.5)) FROM o x WHERE x.asset = o.asset)") + " SELECT asset, ts::DATE::VARCHAR AS day, round(pow(v, 2 / 1.5), 7) AS var FROM p")
def v4_aparch(spark, d):
    return _day(volatility.aparch(panel_returns(spark, d).select("asset", "ts", "ret"), _D, _T, 0.05, 0.1, 0.2, 0.8, 1.5), "var")


@query(_path("-0.05 + 0.1 * (abs(p.ret / exp(p.v / 2)) - sqrt(2 / pi())) - 0.03 * p.ret / exp(p.v / 2) + 0.9 * p.v", "ln(v0)") + " SELECT asset, ts::DATE::VARCHAR AS day, round(exp(v), 7) AS var FROM p")
def v5_egarch(spark, d):
    return _day(volatility.egarch(panel_returns(spark, d).select("asset", "ts", "ret"), _D, _T, -0.05, 0.1, -0.03, 0.9), "var")


@query(f"{_GARCH} SELECT asset, round(sum(-0.5 * (ln(2 * pi()) + ln(v) + ret * ret / v)), 5) AS loglik, count(*) AS n FROM p GROUP BY asset")
def v8_log_likelihood(spark, d):
    return rounded(volatility.log_likelihood(_garch(spark, d), _D), 5, "loglik")


@query(f"{_GARCH} SELECT asset, ts::DATE::VARCHAR AS day, round(ret / sqrt(v), 7) AS z FROM p")
def v9_standardized(spark, d):
    return _day(volatility.standardized(_garch(spark, d)), "z")


@query(f"""{_GARCH}, l AS (SELECT asset, arg_max(ret, i) AS r, arg_max(v, i) AS v FROM p GROUP BY asset)
SELECT asset, h::INT AS h, round(0.5 + (0.05 + 0.1 * r * r + 0.8 * v - 0.5) * pow(0.9, h - 1), 7) AS var FROM l, range(1, 11) k(h)""")
def v12_garch_forecast(spark, d):
    path = _garch(spark, d)
    params = path.select("asset").distinct().select("asset", F.lit(0.05).alias("omega"), F.array(F.lit(0.1)).alias("alpha"), F.array(F.lit(0.8)).alias("beta"))
    return rounded(fits.forecast_orders(path, params, _D, _T, 10), 7, "var")


# -- tests --------------------------------------------------------------------


@query(f"WITH {_ACF} SELECT asset, round(any_value(n) * (any_value(n) + 2) * sum(acf * acf / (n - lag)), 5) AS statistic, any_value(n) AS n FROM a GROUP BY asset")
def t1_ljung_box(spark, d):
    return rounded(diagnostics.ljung_box(daily_returns(spark, d), _D, _T, "ret", 10), 5, "statistic").select("asset", "statistic", "n")


@query(f"""WITH {RETS}, c AS (SELECT asset, ret - avg(ret) OVER (PARTITION BY asset) AS c FROM rets WHERE ret IS NOT NULL),
m AS (SELECT asset, count(*) AS n, avg(c ** 2) AS m2, avg(c ** 3) AS m3, avg(c ** 4) AS m4 FROM c GROUP BY asset), s AS (SELECT *, n / 6.0 * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4) AS jb FROM m)
SELECT asset, n, round(m3 / m2 ** 1.5, 6) AS skew, round(m4 / m2 ** 2 - 3, 6) AS kurtosis, round(jb, 4) AS statistic, round(exp(-jb / 2), 8) AS p_value FROM s""")
def t2_jarque_bera(spark, d):
    return rounded(rounded(rounded(diagnostics.jarque_bera(daily_returns(spark, d), _D, "ret"), 6, "skew", "kurtosis"), 4, "statistic"), 8, "p_value")


@query(f"""WITH {RETS}, e AS (SELECT asset, ret, ret - lag(ret) OVER (PARTITION BY asset ORDER BY ts) AS d FROM rets WHERE ret IS NOT NULL) SELECT asset, round(sum(d * d) / sum(ret * ret), 7) AS statistic FROM e GROUP BY asset""")
def t6_durbin_watson(spark, d):
    return rounded(diagnostics.durbin_watson(daily_returns(spark, d), _D, _T, "ret"), 7, "statistic")


@query(f"""WITH {RETS}, e AS (SELECT asset, ret * ret AS y, lag(ret * ret) OVER (PARTITION BY asset ORDER BY ts) AS x FROM rets WHERE ret IS NOT NULL) SELECT asset, round(count(*) * corr(y, x) ** 2, 6) AS statistic FROM e GROUP BY asset""")
def t5_engle_arch(spark, d):
    return rounded(diagnostics.engle_arch(daily_returns(spark, d), _D, _T, "ret"), 6, "statistic").select("asset", "statistic")


# -- bootstrap ----------------------------------------------------------------


@query("""WITH x AS (SELECT o_orderkey, (7919 * 7 + (o_orderkey % 100) * 104729 + o_orderkey * 1299709 + 1) % 2147483647 AS x FROM orders),
a AS (SELECT o_orderkey, 48271 * ((x * x + 1013904223) % 2147483647) % 2147483647 AS x FROM x), b AS (SELECT o_orderkey, 48271 * ((x * x + 1664525) % 2147483647) % 2147483647 AS x FROM a),
c AS (SELECT o_orderkey, 48271 * ((x * x + 907633385) % 2147483647) % 2147483647 AS x FROM b) SELECT o_orderkey, round(x / 2147483647.0::DOUBLE, 10) AS u FROM c""")
def b0_uniform(spark, d):
    o = table(spark, d, "orders")
    return rounded(o.select("o_orderkey", uniform(7, F.col("o_orderkey") % 100, F.col("o_orderkey")).alias("u")), 10, "u")


_BOOT = f"""{RETS}, o AS (SELECT asset, ret, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM rets WHERE ret IS NOT NULL),
k AS (SELECT DISTINCT asset, n, rep, p, (7919 + rep * 104729 + (p // 10) * 1299709 + 1) % 2147483647 AS x FROM o, range(20) r(rep), range(3000) q(p) WHERE p < n),
k1 AS (SELECT *, 48271 * ((x * x + 1013904223) % 2147483647) % 2147483647 AS y FROM k), k2 AS (SELECT *, 48271 * ((y * y + 1664525) % 2147483647) % 2147483647 AS z FROM k1),
k3 AS (SELECT asset, n, rep, p, 48271 * ((z * z + 907633385) % 2147483647) % 2147483647 AS w FROM k2),
b AS (SELECT k3.asset, rep, ret FROM k3 JOIN o ON o.asset = k3.asset AND o.i = (floor(w / 2147483647.0::DOUBLE * k3.n)::BIGINT + p % 10) % k3.n)"""


@query(f"WITH {_BOOT} SELECT asset, rep::INT AS rep, round(avg(ret), 8) AS mean, round(stddev_pop(ret), 7) AS std FROM b GROUP BY ALL")
def b1_block_bootstrap(spark, d):
    b = bootstrap.circular_blocks(daily_returns(spark, d), _D, _T, "ret", 20, 10)
    return rounded(rounded(b, 8, "mean"), 7, "std")


@query(f"""WITH {_BOOT}, s AS (SELECT asset, rep, avg(ret) AS m FROM b GROUP BY ALL)
SELECT asset, round(stddev_samp(m), 7) AS se, round(avg(m), 7) AS mean, round(median(m), 7) AS median, round(quantile_cont(m, 0.025), 7) AS lo, round(quantile_cont(m, 0.975), 7) AS hi FROM s GROUP BY asset""")
def b6_bootstrap_interval(spark, d):
    b = bootstrap.circular_blocks(daily_returns(spark, d), _D, _T, "ret", 20, 10)
    return rounded(bootstrap.interval(b, _D, "mean"), 7, "se", "mean", "median", "lo", "hi")


# -- errors, folds, unequal variances, constant correlations ------------------

_LINE = """m AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_quantity) AS c, regr_sxx(l_extendedprice, l_quantity) AS sxx, count(*) AS n FROM lineitem GROUP BY ALL),
e AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice - a - b * l_quantity AS e, l_quantity - c AS d, sxx, n, b FROM lineitem JOIN m USING (l_returnflag))"""


@query(f"WITH {_LINE} SELECT l_returnflag, round(any_value(b), 4) AS coef, round(sqrt(sum((e * d / (1 - 1.0 / n - d * d / sxx)) ** 2)) / any_value(sxx), 6) AS se FROM e GROUP BY l_returnflag")
def x2_robust_errors(spark, d):
    o = regress.robust_errors(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_returnflag"], "HC3")
    return rounded(rounded(o.where("term = 'l_quantity'"), 4, "coef"), 6, "se").select("l_returnflag", "coef", "se")


@query("""WITH f AS (SELECT k::INT AS fold, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem, range(5) r(k) WHERE l_orderkey % 5 <> k GROUP BY ALL)
SELECT fold, count(*) AS n, round(avg((l_extendedprice - a - b * l_quantity) ** 2), 1) AS mse FROM lineitem JOIN f ON l_orderkey % 5 = fold GROUP BY fold""")
def c14_k_fold(spark, d):
    return rounded(regress.k_fold(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], "l_orderkey"), 1, "mse")


def _line_residuals(spark, d):
    i = table(spark, d, "lineitem")
    return regress.predict(i, regress.ols(i, "l_extendedprice", ["l_quantity"], ["l_returnflag"]), "l_extendedprice", ["l_quantity"], ["l_returnflag"])


@query(f"WITH {_LINE} SELECT l_returnflag, round(count(*) * corr(e * e, x) ** 2, 3) AS statistic FROM e GROUP BY l_returnflag")
def t9_breusch_pagan(spark, d):
    return rounded(diagnostics.breusch_pagan(_line_residuals(spark, d), ["l_returnflag"], "l_quantity", "residual"), 3, "statistic").select("l_returnflag", "statistic")


@query(f"""WITH {RETS}, o AS (SELECT asset, ret, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i, count(*) OVER (PARTITION BY asset) AS n FROM rets WHERE ret IS NOT NULL),
s AS (SELECT *, floor(CASE WHEN n >= 30 THEN n * 0.4::DOUBLE ELSE n / 2 END) AS k FROM o) SELECT asset, round(var_samp(ret) FILTER (WHERE i > n - k) / var_samp(ret) FILTER (WHERE i <= k), 6) AS statistic, count(*) AS n FROM s GROUP BY asset""")
def t10_goldfeld_quandt(spark, d):
    return rounded(diagnostics.goldfeld_quandt(daily_returns(spark, d).where("ret IS NOT NULL"), _D, _T, "ret"), 6, "statistic")


@query(_path("0.05 + 0.1 * p.ret * p.ret - 0.05 * p.ret * sqrt(p.v) + 0.8 * p.v") + " SELECT asset, ts::DATE::VARCHAR AS day, round(v, 7) AS var FROM p")
def v6_agarch(spark, d):
    return _day(volatility.agarch(panel_returns(spark, d).select("asset", "ts", "ret"), _D, _T, 0.05, 0.1, -0.05, 0.8), "var")


@query(f"""{_GARCH}, q AS (SELECT x.ts, x.asset AS i, y.asset AS j, x.ret / sqrt(x.v) AS z, y.ret / sqrt(y.v) AS zj, sqrt(x.v) AS sd, sqrt(y.v) AS sdj FROM p x JOIN p y ON x.ts = y.ts AND x.asset < y.asset),
c AS (SELECT i, j, corr(z, zj) AS c FROM q GROUP BY ALL HAVING count(*) >= 30) SELECT ts::DATE::VARCHAR AS day, i, j, round(c, 6) AS corr, round(c * sd * sdj, 6) AS cov FROM q JOIN c USING (i, j)""")
def v17_constant_correlation(spark, d):
    path = _garch(spark, d).withColumn("day", F.to_date("ts").cast("string"))
    return rounded_binary(volatility.constant_correlation(path, "asset", "ts", least=30, shown="day"), 6, "corr", "cov")


# -- wide merge, densities, model choice --------------------------------------

_PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "none", "5-LOW": "low"}
_FAMILIES = {"laplace": ("laplace", 1.0), "normal": ("normal", 1.0), "t4": ("t", 4.0), "ged2": ("ged", 2.0)}


_WIDE = ", ".join(f"round(max(v) FILTER (WHERE asset = '{p}'), 3) AS \"{a}\"" for p, a in _PRIORITIES.items())


@query(f"""WITH {DAILY},
f AS (SELECT t.ts, a.asset, last_value(s.value IGNORE NULLS) OVER (PARTITION BY a.asset ORDER BY t.ts ROWS UNBOUNDED PRECEDING) AS v
  FROM (SELECT DISTINCT ts FROM daily) t CROSS JOIN (SELECT DISTINCT asset FROM daily) a LEFT JOIN daily s ON s.ts = t.ts AND s.asset = a.asset)
SELECT ts::DATE::VARCHAR AS day, {_WIDE} FROM f GROUP BY ts""")
def j6_merge_wide(spark, d):
    w = align.merge_wide(daily(spark, d), "asset", "ts", "value", list(_PRIORITIES))
    return rounded(w.select(F.to_date("ts").cast("string").alias("day"), *[F.col(f"`{p}`").alias(a) for p, a in _PRIORITIES.items()]), 3, *_PRIORITIES.values())


_FIT = f"""{RETS}, m AS (SELECT asset, avg(ret) AS mu, stddev_pop(ret) AS s FROM rets GROUP BY asset),
z AS (SELECT asset, (ret - mu) / s AS z, s FROM rets JOIN m USING (asset) WHERE ret IS NOT NULL),
l AS (SELECT asset, 'normal' AS model, sum(-0.5 * (ln(2 * pi()) + z * z) - ln(s)) AS loglik, count(*) AS n FROM z GROUP BY asset
UNION ALL SELECT asset, 'ged2', sum(-0.5 * (ln(2 * pi()) + z * z) - ln(s)), count(*) FROM z GROUP BY asset
UNION ALL SELECT asset, 'laplace', sum(-0.5 * ln(2::DOUBLE) - sqrt(2::DOUBLE) * abs(z) - ln(s)), count(*) FROM z GROUP BY asset
UNION ALL SELECT asset, 't4', sum(lgamma(2.5::DOUBLE) - lgamma(2::DOUBLE) - 0.5 * ln(pi() * 2) - 2.5 * ln(1 + z * z / 2) - ln(s)), count(*) FROM z GROUP BY asset)"""


@query(f"WITH {_FIT} SELECT asset, model, round(loglik, 5) AS loglik, n, round(4 - 2 * loglik, 5) AS aic, round(2 * ln(n) - 2 * loglik, 5) AS bic FROM l")
def d6_compare_families(spark, d):
    return rounded(densities.compare_families(daily_returns(spark, d), _D, "ret", _FAMILIES), 5, "loglik", "aic", "bic")


@query(f"WITH {_FIT}, c AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY 4 - 2 * loglik) AS k FROM l WHERE model <> 'ged2') SELECT asset, model, round(4 - 2 * loglik, 5) AS aic FROM c WHERE k = 1")
def a13_best_model(spark, d):
    scores = densities.compare_families(daily_returns(spark, d), _D, "ret", {m: f for m, f in _FAMILIES.items() if m != "ged2"})
    return rounded(describe.best_model(scores, _D, "model", "aic"), 5, "aic")
