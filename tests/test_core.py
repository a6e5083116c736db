import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import special
from tickloom.functions.basic import safe_divide
from tickloom.operators import align, bars, bootstrap, clean, describe, realized, regress, series, volatility
from tickloom.sources import prices

HAND = [100.0, 102.0, 105.0, 103.0, 107.0, 110.0, 112.0, 109.0, 111.0, 115.0]


def _series(spark, values, key="a"):
    return spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], "k string, t int, v double")


def test_hand_returns(spark):
    s = _series(spark, HAND)
    for method, periods, want in (("simple", 1, 0.02), ("log", 1, math.log(1.02)), ("percentage", 1, 2.0), ("simple", 2, 0.05)):
        got = [r.ret for r in series.returns(s, ["k"], ["t"], "v", method, periods).orderBy("t").collect()]
        assert got[:periods] == [None] * periods and got[periods] == pytest.approx(want)
    assert series.returns(s, ["k"], ["t"], "v", fill=0.0).where("t = 0").first().ret == 0.0


def test_hand_fills(spark):
    s = _series(spark, [1.0, 2.0, None, 4.0, 5.0, None, None, 8.0, 9.0, 10.0])
    at = lambda m, k: clean.fill(s, ["k"], ["t"], "v", m).where(f"t = {k}").first().v
    assert [at(m, 2) for m in ("ffill", "bfill", "linear")] == [2, 4, 3]
    assert at("linear", 5) == 6 and clean.fill(s, ["k"], ["t"], "v", "ffill", 1).where("t = 6").first().v is None
    edge = _series(spark, [None, 2.0, 3.0, None, 5.0, None])
    assert [r.v for r in clean.fill(edge, ["k"], ["t"], "v", "linear").orderBy("t").collect()] == [None, 2, 3, 4, 5, 5]


def test_garch_by_hand(spark):
    r = [0.5, -1.0, 2.0, 0.3]
    got = [x["var"] for x in volatility.garch(_series(spark, r).withColumnRenamed("v", "ret"), ["k"], ["t"], 0.1, 0.3, 0.6).orderBy("t").collect()]
    want = [sum(x * x for x in r) / 4]
    for x in r[:-1]:
        want.append(0.1 + 0.3 * x * x + 0.6 * want[-1])
    assert got == pytest.approx(want)


def test_partitions_do_not_matter(spark):
    s = spark.range(400).select(F.concat(F.lit("s"), F.col("id") % 3).alias("k"), F.col("id").cast("int").alias("t"), F.sin("id").alias("v"))
    one = sorted(map(tuple, series.ewma(s.repartition(1), ["k"], ["t"], "v", 0.2).collect()))
    assert one == sorted(map(tuple, series.ewma(s.repartition(7), ["k"], ["t"], "v", 0.2).collect()))
    assert {r.t for r in s.exceptAll(s.repartition(5)).collect()} == set()


def test_outliers_are_found(spark):
    rng = np.random.default_rng(42)
    v = rng.normal(size=100)
    v[[10, 25, 75]] = 10.0
    for method, limit in (("zscore", 3.0), ("iqr", 1.5), ("mad", 3.5)):
        bad = {r.t for r in clean.outliers(_series(spark, v.tolist()), ["k"], "v", method, limit).where("outlier").collect()}
        assert {10, 25, 75} <= bad


def test_realized_variance_ignores_scale(spark):
    rows = [("x", "d", dt.datetime(2024, 1, 1, 9, 0, i % 60, 0) + dt.timedelta(minutes=i // 60), i, 100 * math.exp(0.01 * math.sin(i))) for i in range(300)]
    t = spark.createDataFrame(rows, "symbol string, date string, ts timestamp, seq long, price double")
    rv = lambda df: realized.realized_variance(bars.sample_calendar(df, 30)).first().rv
    assert rv(t) > 0 and rv(t) == pytest.approx(rv(t.withColumn("price", F.col("price") * 7)))


def test_regression_and_axes(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, (b, c) in zip(y, x)], "y double, x1 double, x2 double")
    got = {r.term: r for r in regress.ols(df, "y", ["x1", "x2"]).collect()}
    m = np.c_[np.ones(200), x]
    want = np.linalg.lstsq(m, y, rcond=None)[0]
    assert [got[k].coef for k in ("const", "x1", "x2")] == pytest.approx(want.tolist()) and got["x1"].r2 > 0.99
    s2 = ((y - m @ want) ** 2).sum() / 197
    assert got["x1"].se == pytest.approx(math.sqrt(s2 * np.linalg.inv(m.T @ m)[1, 1]))
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert [r.eigenvalue for r in regress.pca(df, ["x1", "x2"], 2).orderBy("component").collect()] == pytest.approx(values.tolist())


def test_special_functions():
    assert special.gamma_p(1.0, 2.0) == pytest.approx(1 - math.exp(-2))
    assert 1 - special.gamma_p(np.array([5.0, 0.5]), np.array([18.307 / 2, 3.8415 / 2])) == pytest.approx([0.05, 0.05], abs=1e-4)
    assert special.t_cdf(np.array([2.228, -2.228]), 10) == pytest.approx([0.975, 0.025], abs=1e-4)
    assert special.beta_i(2.0, 3.0, 0.4) == pytest.approx(0.5248)
    assert special.norm_cdf(special.norm_ppf([0.01, 0.5, 0.9])) == pytest.approx([0.01, 0.5, 0.9])


def test_alignment_and_adjustment(spark):
    p = spark.createDataFrame([("a", dt.datetime(2024, 1, d), 100.0 + d) for d in (1, 2, 3, 4)], "symbol string, ts timestamp, price double")
    f = spark.createDataFrame([("a", dt.datetime(2024, 1, 3), 0.5), ("a", dt.datetime(2024, 1, 4), 0.1)], "symbol string, ts timestamp, factor double")
    assert [r.adjusted for r in align.adjust(p, f).orderBy("ts").collect()] == pytest.approx([101 * 0.05, 102 * 0.05, 103 * 0.1, 104])
    q = spark.createDataFrame([("b", dt.datetime(2024, 1, 2), 5.0)], "asset string, ts timestamp, value double").unionByName(p.select(F.col("symbol").alias("asset"), "ts", F.col("price").alias("value")))
    assert align.align(q, "inner").count() == 2 and align.align(q).count() == 8


def test_bootstrap_equals_materialised_blocks(spark):
    v = [float(x) for x in np.random.default_rng(3).normal(size=23)]
    got = {r.rep: (r.mean, r.std) for r in bootstrap.circular_blocks(_series(spark, v), ["k"], ["t"], "v", 6, 5, seed=2).collect()}

    def u(rep, k):
        x = (2 * 7919 + rep * 104729 + k * 1299709 + 1) % 2147483647
        for c in (1013904223, 1664525, 907633385):
            x = 48271 * ((x * x + c) % 2147483647) % 2147483647
        return x / 2147483647

    for rep in range(6):
        sample = [v[(int(u(rep, p // 5) * 23) + p % 5) % 23] for p in range(23)]
        assert got[rep] == pytest.approx((np.mean(sample), np.std(sample)))


def test_pacf_of_two_lags(spark):
    x = np.random.default_rng(5).normal(size=60)
    r = [q.acf for q in describe.acf(_series(spark, x.tolist()), ["k"], ["t"], "v", 2).orderBy("lag").collect()]
    got = [q.pacf for q in describe.pacf(_series(spark, x.tolist()), ["k"], ["t"], "v", 2).orderBy("lag").collect()]
    assert got == pytest.approx([r[0], (r[1] - r[0] ** 2) / (1 - r[0] ** 2)])


def test_prices_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 3), 1.5), ("a", dt.datetime(2024, 1, 2), None)], "symbol string, ts timestamp, price double")
    for fmt in ("csv", "json", "parquet"):
        prices.write_prices(df, f"{tmp_path}/p.{fmt}")
        got = prices.read_prices(spark, f"{tmp_path}/p.{fmt}", schema="symbol string, ts string, price double" if fmt != "parquet" else None)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        prices.format_of("x.xlsx")
    wide = prices.to_wide(prices.to_long(spark.createDataFrame([(1, 2.0, 3.0)], "t int, a double, b double"), ["t"], ["a", "b"]), ["t"], ["a", "b"])
    assert tuple(wide.first()) == (1, 2.0, 3.0)
    assert spark.range(1).select(safe_divide(F.lit(1.0), F.lit(0.0)).alias("x")).first().x == 0.0


def test_stream_bars_equal_batch_and_drop_late_ticks(spark, tmp_path):
    from tickloom.streaming.bars import stream_bars, stream_variance

    base = dt.datetime(2024, 1, 1)
    rows = [("a", base + dt.timedelta(seconds=20 * i), i, 100.0 + i % 7, 1.0) for i in range(200)]
    t = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, price double, volume double")
    late = spark.createDataFrame([("a", base, 999, 1.0, 1.0), ("a", base + dt.timedelta(hours=3), 1000, 1.0, 1.0)], t.schema)
    path = f"{tmp_path}/ticks"
    t.coalesce(1).write.mode("append").parquet(path)
    s = stream_bars(spark.readStream.schema(t.schema).parquet(path), "5 minutes", late="1 minute")
    q = s.writeStream.format("memory").queryName("bars").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
        late.coalesce(1).write.mode("append").parquet(path)
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.bucket: (r.open, r.high, r.low, r.close, r.volume) for r in spark.table("bars").collect()}
    want = {r.bucket: (r.open, r.high, r.low, r.close, r.volume) for r in bars.price_bars(t, 300).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 1
    v = stream_variance(spark.readStream.schema(t.schema).parquet(path).where("seq < 900"))
    q = v.writeStream.format("memory").queryName("var").outputMode("append").option("checkpointLocation", f"{tmp_path}/v").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("var").count() == 200


def _streamed(frame, name, checkpoint):
    """All rows that a stream gives until its files are read."""
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return frame.sparkSession.table(name).collect()


def _ticks_in_files(spark, path, days, seed):
    """Ticks of two symbols, out of order by some minutes, in files that a stream reads in order; then three ticks a month later."""
    rng = np.random.default_rng(seed)
    base, rows = dt.datetime(2024, 1, 1), []
    for s in ("a", "b"):
        at = np.sort(rng.choice(days * 86400, 400 * days, replace=False))
        at[0] = 0
        rows += [(s, base + dt.timedelta(seconds=int(x)), int(x), float(100 + rng.normal()), 1.0) for x in at]
    schema = "symbol string, ts timestamp, seq long, price double, volume double"
    rows.sort(key=lambda r: r[2] + rng.integers(0, 300))
    for k in range(0, len(rows), 300):
        spark.createDataFrame(rows[k : k + 300], schema).coalesce(1).write.mode("append").parquet(path)
    for k in (40, 41, 42):
        spark.createDataFrame([("c", base + dt.timedelta(days=k), 0, 1.0, 1.0)], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.createDataFrame(rows, schema), spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streamed_variance_is_by_time_across_batches(spark, tmp_path):
    from tickloom.streaming.bars import stream_variance

    t, stream = _ticks_in_files(spark, f"{tmp_path}/ticks", 1, 1)
    rows = _streamed(stream_variance(stream, late="10 minutes", idle="2 days"), "var_by_time", f"{tmp_path}/v")
    got = {(r.symbol, r.ts): r["var"] for r in rows if r.symbol != "c"}
    want = {}
    for s in ("a", "b"):
        price, var = None, 1e-4
        for r in t.where(F.col("symbol") == s).orderBy("ts").collect():
            if price:
                var = 0.94 * var + 0.06 * np.log(r.price / price) ** 2
            price = r.price
            want[s, r.ts] = var
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_streamed_realized_variance_equals_the_tables(spark, tmp_path):
    from tickloom.streaming.bars import stream_realized_variance

    t, stream = _ticks_in_files(spark, f"{tmp_path}/ticks", 3, 2)
    rows = _streamed(stream_realized_variance(stream), "rv_by_day", f"{tmp_path}/v")
    got = {(r.symbol, r.date): (r.rv, r.n_returns) for r in rows if r.symbol != "c"}
    first = {}
    for r in t.orderBy("ts").collect():
        first.setdefault((r.symbol, r.ts.date(), r.ts.hour * 2 + r.ts.minute // 30), r.price)
    want = {}
    for s, d in {k[:2] for k in first}:
        x = np.diff(np.log([first[k] for k in sorted(first) if k[:2] == (s, d)]))
        want[s, d] = ((x**2).sum(), len(x))
    assert got.keys() == want.keys() and len(got) == 6
    assert all(abs(got[k][0] - v[0]) < 1e-12 and got[k][1] == v[1] for k, v in want.items())


def test_robust_errors_and_folds_by_numpy(spark):
    from tickloom.operators import diagnostics

    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=90) * (1 + np.abs(x[:, 0]))
    df = spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(90, None, 1.0, 1.0)], "id long, a double, b double, y double")
    full = np.c_[np.ones(90), x]
    inv = np.linalg.inv(full.T @ full)
    b = inv @ full.T @ y
    e, lever = y - full @ b, np.einsum("ij,jk,ik->i", full, inv, full)
    for kind, room in (("HC0", 1), ("HC1", 87 / 90), ("HC2", 1 - lever), ("HC3", (1 - lever) ** 2)):
        want = np.sqrt(np.diag(inv @ (full.T * (e**2 / room)) @ full @ inv))
        got = {r.term: r.se for r in regress.robust_errors(df, "y", ["a", "b"], kind=kind).collect()}
        assert [got[t] for t in ("const", "a", "b")] == pytest.approx(want)
    for r in regress.k_fold(df, "y", ["a", "b"], "id", 3).collect():
        own = np.arange(90) % 3 == r.fold
        c = np.linalg.lstsq(full[~own], y[~own], rcond=None)[0]
        assert r.n == 30 and r.mse == pytest.approx(((y[own] - full[own] @ c) ** 2).mean())
    r = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(e)], "k string, t int, v double")
    assert diagnostics.goldfeld_quandt(r, ["k"], ["t"], "v").first().statistic == pytest.approx(e[54:].var(ddof=1) / e[:36].var(ddof=1))


def test_densities_have_mass_and_variance_one(spark):
    from tickloom.operators import densities

    grid = spark.range(-60_000, 60_001).select((F.col("id") / 1000).alias("x"))
    for family, nu in (("normal", 0.0), ("t", 8.0), ("ged", 1.4), ("laplace", 0.0)):
        p = F.exp(densities.log_pdf(F.col("x"), family, nu=nu))
        mass, var = grid.agg(F.sum(p) / 1000, F.sum(p * F.col("x") ** 2) / 1000).first()
        assert mass == pytest.approx(1, abs=1e-5) and var == pytest.approx(1, abs=1e-3)


def test_wide_merge_carries_values_and_best_model_breaks_ties(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 5.0), ("a", 3, 2.0), ("c", 9, 0.0)], "k string, t int, v double")
    assert [tuple(r) for r in align.merge_wide(df, "k", "t", "v", ["a", "b"]).orderBy("t").collect()] == [(1, 1.0, None), (2, 1.0, 5.0), (3, 2.0, 5.0)]
    scores = spark.createDataFrame([("s", "y", 1.0), ("s", "x", 1.0), ("s", "w", None)], "k string, model string, aic double")
    assert [tuple(r) for r in describe.best_model(scores, ["k"], "model", "aic").collect()] == [("s", "x", 1.0)]
