"""Realized measures by symbol and day."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import pairs
from .bars import US, sample_calendar
from .series import moving_average, returns

KEYS = ("symbol", "date")


def tick_returns(sampled: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Log returns between sampled ticks; the first of a group is null."""
    return returns(sampled, list(keys), ["ts", "seq"], "price")


def realized_variance(sampled: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, rv, n_returns): sum of squared log returns; one sampled tick gives zero."""
    r = tick_returns(sampled, keys)
    return r.groupBy(*keys).agg(F.coalesce(F.sum(F.col("ret") * F.col("ret")), F.lit(0.0)).alias("rv"), F.count("ret").alias("n_returns"))


def noise_filtered_variance(sampled: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Realized variance of returns smoothed over three points."""
    r = moving_average(tick_returns(sampled, keys).where("ret is not null"), list(keys), ["ts", "seq"], "ret", 3)
    return r.groupBy(*keys).agg(F.sum(F.col("smooth") * F.col("smooth")).alias("rv_filtered"))


def realized_volatility(sampled: DataFrame, scale: float = 252.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Annualised square root of realized variance.

    ``scale`` is divided by the observed ticks a day: the group's sampled ticks
    over the days from its first to its last. A group of one instant has none.
    """
    us = F.unix_micros("ts")
    span = sampled.groupBy(*keys).agg(F.count("*").alias("_ticks"), ((F.max(us) - F.min(us)) / (86_400.0 * US)).alias("_days"))
    out = realized_variance(sampled, keys).join(span, list(keys))
    return out.withColumn("volatility", F.sqrt(F.col("rv") * scale * F.nullif("_days", F.lit(0.0)) / F.col("_ticks"))).drop("_ticks", "_days")


def double_interval_variance(ticks: DataFrame, seconds: int) -> DataFrame:
    """(symbol, date, rv_double): realized variance at twice the interval."""
    return realized_variance(sample_calendar(ticks, 2 * seconds)).select(*KEYS, F.col("rv").alias("rv_double"))


def default_bandwidth(sampled: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, bandwidth): half the cube root of the number of returns times their robust deviation; below 1 for small returns, so often 0 lags."""
    r = tick_returns(sampled, keys).where("ret is not null")
    return r.groupBy(*keys).agg((0.5 * F.pow(F.count("ret"), F.lit(1 / 3)) * F.median(F.abs("ret")) / 0.6745).cast("int").alias("bandwidth"))


def kernel_weight(kind: str, x: float) -> float:
    """The weight of a lag at share x of the bandwidth."""
    if kind == "truncated":
        return 1.0
    if kind == "bartlett":
        return 1 - x
    if kind == "parzen":
        return 1 - 6 * x**2 + 6 * x**3 if x <= 0.5 else 2 * (1 - x) ** 3
    if kind == "tukey":
        return 0.5 * (1 + math.cos(math.pi * x))
    if kind == "qs":
        y = 6 * math.pi * x / 5
        return 1.0 if x == 0 else 25 / (12 * math.pi**2 * x**2) * (math.sin(y) / y - math.cos(y))
    raise ValueError(kind)


def realized_kernel(sampled: DataFrame, bandwidth: int | None = None, kind: str = "parzen", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, rk): variance plus twice the weighted autocovariances up to ``bandwidth`` lags, as lag columns in one pass.

    Without a bandwidth each group has its own (``default_bandwidth``); groups
    are then summed one at a time, a day of one symbol each.
    """
    r = tick_returns(sampled, keys).where("ret is not null")
    if bandwidth is None:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sampled.select(*keys).schema)

        def one(key, pdf):
            x, h = pdf.sort_values(["ts", "seq"])["ret"].to_numpy(), int(pdf["bandwidth"].iloc[0])
            rk = x @ x + sum(2 * kernel_weight(kind, k / h) * (x[k:] @ x[:-k]) for k in range(1, min(h, len(x) - 1) + 1))
            return pd.DataFrame([[*key, float(rk)]], columns=[*keys, "rk"])

        return r.join(default_bandwidth(sampled, keys), list(keys)).groupBy(*keys).applyInPandas(one, f"{kinds}, rk double")
    w = Window.partitionBy(*keys).orderBy("ts", "seq")
    lags = {f"_l{h}": F.lag("ret", h).over(w) for h in range(1, bandwidth + 1)}
    total = F.sum(F.col("ret") * F.col("ret"))
    for h in range(1, bandwidth + 1):
        total = total + 2 * kernel_weight(kind, h / bandwidth) * F.coalesce(F.sum(F.col("ret") * F.col(f"_l{h}")), F.lit(0.0))
    return (r.withColumns(lags) if lags else r).groupBy(*keys).agg(total.alias("rk"))


def clock_returns(ticks: DataFrame, seconds: int) -> DataFrame:
    """Log returns of all symbols on one clock of each day: the last price in each interval."""
    us = F.unix_micros("ts")
    bucket = F.floor(us / (seconds * US))
    last = ticks.groupBy("symbol", "date", bucket.alias("bucket")).agg(F.max_by("price", F.struct("ts", "seq")).alias("price"))
    return returns(last, ["symbol", "date"], ["bucket"], "price").where("ret is not null")


def realized_covariance(ticks: DataFrame, seconds: int) -> DataFrame:
    """(date, i, j, rcov, n): sums of products of synchronous returns, i <= j."""
    r = clock_returns(ticks, seconds).withColumn("_at", F.struct("date", "bucket"))
    p = pairs(r, "symbol", "_at", ("ret",))
    return p.groupBy(F.col("_at.date").alias("date"), "i", "j").agg(F.sum(F.col("ret_i") * F.col("ret_j")).alias("rcov"), F.count("*").alias("n"))


def signature(ticks: DataFrame, intervals: list[int]) -> DataFrame:
    """(symbol, date, seconds, rv, volatility, rv_filtered, difference_pct): measures against the sampling interval, all intervals in one pass.

    difference_pct is what noise filtering changes of the raw variance. Ticks
    are sampled at the intervals' greatest common divisor first, as the first
    tick of an interval is the first of the first such step in it; only those
    are repeated for the intervals. Returns are taken once, for both sums.
    """
    us, step = F.unix_micros("ts"), math.gcd(*intervals)
    began = ticks.withColumn("_us", us - F.min(us).over(Window.partitionBy("symbol", "date")))
    fine = began.groupBy("symbol", "date", F.floor(F.col("_us") / (step * US)).alias("_g")).agg(F.min(F.struct("ts", "seq", "price")).alias("_t"))
    wide = fine.withColumn("seconds", F.explode(F.array(*map(F.lit, intervals))))
    bucket: Column = F.floor(F.col("_g") * step / F.col("seconds"))
    first = wide.withColumn("bucket", bucket).groupBy("symbol", "date", "seconds", "bucket").agg(F.min("_t").alias("_t"))
    keys = ("symbol", "date", "seconds")
    r = tick_returns(first.select("symbol", "date", "seconds", "_t.*"), keys)
    around = F.avg("ret").over(Window.partitionBy(*keys).orderBy("ts", "seq").rowsBetween(-1, 1))
    r = r.withColumn("_s", F.when(F.col("ret").isNotNull(), around))
    out = r.groupBy(*keys).agg(F.coalesce(F.sum(F.col("ret") * F.col("ret")), F.lit(0.0)).alias("rv"), F.sum(F.col("_s") * F.col("_s")).alias("rv_filtered"))
    return out.select(*keys, "rv", F.sqrt("rv").alias("volatility"), "rv_filtered", ((F.col("rv_filtered") - F.col("rv")) / F.nullif(F.col("rv"), F.lit(0.0)) * 100).alias("difference_pct"))


def measures(ticks: DataFrame, seconds: int, bandwidth: int = 3) -> DataFrame:
    """Variance, filtered variance, volatility and kernel from one sampled table."""
    s = sample_calendar(ticks, seconds)
    out = realized_volatility(s)
    for other in (noise_filtered_variance(s), realized_kernel(s, bandwidth)):
        out = out.join(other, list(KEYS), "left")
    return out
