"""Bars and tick sampling schemes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basic import uniform

US = 1_000_000


def bucket_start(ts, seconds: int, closed: str = "left"):
    """The bucket of a timestamp; right-closed buckets are labelled by their end."""
    us = F.unix_micros(ts)
    if closed == "right":
        return F.timestamp_micros(F.ceil(us / (seconds * US)) * (seconds * US))
    return F.timestamp_micros(us - F.pmod(us, F.lit(seconds * US)))


def resample(df: DataFrame, keys: list[str], ts: str, value: str, seconds: int, method: str = "mean", closed: str = "left", seq: str | None = None) -> DataFrame:
    """(keys, bucket, value...): mean, sum, min, max, median, first, last or ohlc of each non-empty bucket."""
    at = F.struct(ts, seq) if seq else F.col(ts)
    v = F.col(value)
    kinds = {
        "mean": [F.avg(v).alias(value)], "sum": [F.sum(v).alias(value)], "min": [F.min(v).alias(value)], "max": [F.max(v).alias(value)], "median": [F.median(v).alias(value)],
        "first": [F.min_by(v, at).alias(value)], "last": [F.max_by(v, at).alias(value)],
        "ohlc": [F.min_by(v, at).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, at).alias("close")],
    }
    return df.groupBy(*keys, bucket_start(F.col(ts), seconds, closed).alias("bucket")).agg(*kinds[method])


def dense(bars: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Bars with the empty buckets between each series' first and last one as nulls."""
    span = bars.groupBy(*keys).agg(F.min("bucket").alias("_a"), F.max("bucket").alias("_b"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_b", F.expr(f"interval {seconds} seconds"))).alias("bucket"))
    return grid.join(bars, [*keys, "bucket"], "left")


def price_bars(ticks: DataFrame, seconds: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Open, high, low, close, volume, vwap (null without volume) and twap of each bucket of ticks (ts, seq, price, volume)."""
    at, p, v = F.struct("ts", "seq"), F.col("price"), F.col("volume")
    return ticks.groupBy(*keys, bucket_start(F.col("ts"), seconds).alias("bucket")).agg(
        F.min_by(p, at).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, at).alias("close"), F.sum(v).alias("volume"),
        (F.sum(p * v) / F.nullif(F.sum(v), F.lit(0.0))).alias("vwap"), F.avg(p).alias("twap"), F.count("*").alias("n_ticks"),
    )


def sample_calendar(ticks: DataFrame, seconds: int, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """The first tick of each non-empty interval that runs from a group's first tick."""
    us = F.unix_micros("ts")
    began = F.min(us).over(Window.partitionBy(*keys))
    bucket = F.floor((us - began) / (seconds * US))
    return ticks.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(F.min(F.struct("ts", "seq", "price")).alias("_t")).select(*keys, "bucket", "_t.*")


def sample_business(ticks: DataFrame, step: int, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """Every ``step``-th tick."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "seq"))
    return ticks.withColumn("_rn", rn).where(F.pmod(F.col("_rn") - 1, F.lit(step)) == 0).drop("_rn")


def sample_business_random(ticks: DataFrame, low: int, high: int, seed: int = 0, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """The first tick of each group and then every ``low``- to ``high``-th one, each step a portable random number, the same in every group."""
    order = Window.partitionBy(*keys).orderBy("ts", "seq")
    rows = ticks.withColumn("_at", F.row_number().over(order) - 1)
    step = low + F.floor(uniform(seed, F.lit(0), F.col("_at")) * (high - low + 1))
    steps = rows.select(*keys, "ts", "seq", step.alias("_step"))
    taken = steps.select(*keys, F.coalesce(F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_at"))
    return rows.join(taken, [*keys, "_at"], "left_semi").select(*ticks.columns)


def sample_business_uniform(ticks: DataFrame, m: int, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """About m ticks at equally spaced, truncated positions."""
    w = Window.partitionBy(*keys)
    pos = ticks.withColumns({"_i": F.row_number().over(w.orderBy("ts", "seq")) - 1, "_n": F.count("*").over(w)})
    # position p is chosen when some i * (n - 1) / (m - 1) truncates to it: the first such i is ceil(p (m - 1) / (n - 1))
    first = F.ceil(F.col("_i") * (m - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    return pos.where((F.col("_i") == 0) | (F.floor(first * (F.col("_n") - 1) / (m - 1)) == F.col("_i"))).drop("_i", "_n")


def sample_fixed(ticks: DataFrame, m: int, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """Every max(1, n div m)-th tick."""
    w = Window.partitionBy(*keys)
    pos = ticks.withColumns({"_i": F.row_number().over(w.orderBy("ts", "seq")) - 1, "_n": F.count("*").over(w)})
    return pos.where(F.pmod(F.col("_i"), F.greatest(F.floor(F.col("_n") / m), F.lit(1))) == 0).drop("_i", "_n")


def sample_calendar_uniform(ticks: DataFrame, m: int, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """The ticks nearest to m equally spaced instants (the earlier of two as near), once each; by union and windows, not a range join."""
    us = F.unix_micros("ts")
    span = ticks.groupBy(*keys).agg(F.min(us).alias("_a"), F.max(us).alias("_b"))
    grid = span.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("_k"), "_a", "_b")
    grid = grid.select(*keys, (F.col("_a") + F.floor(F.col("_k") * (F.col("_b") - F.col("_a")) / (m - 1))).alias("_us"), F.lit(None).cast("struct<us:bigint,seq:bigint,price:double>").alias("_t"))
    both = ticks.select(*keys, us.alias("_us"), F.struct(us.alias("us"), F.col("seq").cast("long").alias("seq"), F.col("price").cast("double").alias("price")).alias("_t")).unionByName(grid)
    back = Window.partitionBy(*keys).orderBy("_us", F.col("_t").isNull(), "_t.seq")
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_us"), F.col("_t").isNull(), F.desc("_t.seq"))
    near = both.withColumns({"_p": F.last("_t", True).over(back), "_q": F.last("_t", True).over(ahead)}).where("_t is null")
    pick = F.when(F.col("_q").isNull() | (F.col("_us") - F.col("_p.us") <= F.col("_q.us") - F.col("_us")), F.col("_p")).otherwise(F.col("_q"))
    return near.select(*keys, pick.alias("_t")).distinct().select(*keys, F.timestamp_micros("_t.us").alias("ts"), "_t.seq", "_t.price")
