"""Aligning series in time, and corporate actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clean import fill


def align(panel: DataFrame, method: str = "outer", fill_with: str | None = None, key: str = "asset", ts: str = "ts", value: str = "value") -> DataFrame:
    """A (ts, asset, value) panel on common times: all times (outer) or those that every asset has (inner).

    fill_with: ffill, bfill or zero for what an asset lacks.
    """
    if method == "inner":
        total = panel.select(key).distinct().agg(F.count("*").alias("_all"))
        common = panel.groupBy(ts).agg(F.count_distinct(key).alias("_n")).join(F.broadcast(total)).where("_n = _all").select(ts)
        return panel.join(common, ts, "left_semi")
    times, assets = panel.select(ts).distinct(), panel.select(key).distinct()
    out = times.join(assets).join(panel, [ts, key], "left")  # every asset at every time is the result itself
    if fill_with == "zero":
        return out.withColumn(value, F.coalesce(value, F.lit(0.0)))
    return fill(out, [key], [ts], value, fill_with) if fill_with else out


def align_grid(panel: DataFrame, seconds: int, key: str = "asset", ts: str = "ts", value: str = "value") -> DataFrame:
    """The panel at the instants of a regular grid from the day of its first to its last time."""
    span = panel.agg(F.date_trunc("day", F.min(ts)).alias("_a"), F.max(ts).alias("_b"))
    grid = span.select(F.explode(F.sequence("_a", "_b", F.expr(f"interval {seconds} seconds"))).alias(ts))
    return grid.join(panel.select(key).distinct()).join(panel, [ts, key], "left")


def align_nearest(left: DataFrame, right: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", name: str = "nearest") -> DataFrame:
    """Each left row with the value of the right row nearest in time, the earlier of two as near."""
    us = F.unix_micros(ts)
    a = left.select(*keys, F.lit(True).alias("_l"), us.alias("_us"), F.struct(*left.columns).alias("_row"), F.lit(None).cast("struct<us:bigint,v:double>").alias("_r"))
    b = right.where(F.col(value).isNotNull()).select(*keys, F.lit(False).alias("_l"), us.alias("_us"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(us.alias("us"), F.col(value).cast("double").alias("v")).alias("_r"))
    both = a.union(b)
    back, ahead = Window.partitionBy(*keys).orderBy("_us", "_l"), Window.partitionBy(*keys).orderBy(F.desc("_us"), "_l")
    near = both.withColumns({"_p": F.last("_r", True).over(back), "_q": F.last("_r", True).over(ahead)}).where("_l")
    first = F.col("_q").isNull() | (F.col("_us") - F.col("_p.us") <= F.col("_q.us") - F.col("_us"))
    return near.select("_row.*", F.when(first, F.col("_p.v")).otherwise(F.col("_q.v")).alias(name))


def adjust(prices: DataFrame, factors: DataFrame, name: str = "adjusted") -> DataFrame:
    """Prices (symbol, ts, price) times the product of all factors (symbol, ts, factor) dated after them.

    Factors join the series and are multiplied up in reverse time: one window
    instead of a range join.
    """
    rows = prices.select("symbol", "ts", F.struct(*prices.columns).alias("_row"), F.lit(0.0).alias("_f"))
    extra = factors.select("symbol", "ts", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.log("factor").alias("_f"))
    after = Window.partitionBy("symbol").orderBy(F.desc("ts")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("symbol", "ts")
    both = rows.union(extra).withColumn("_s", F.sum("_f").over(after) - F.sum("_f").over(same))
    return both.where("_row is not null").select("_row.*", (F.col("_row.price") * F.exp("_s")).alias(name))


def _by_price(prices: DataFrame, dates: DataFrame) -> DataFrame:
    """Prices and dates in one table for a window: (symbol, ts, _row, _p), a date's in ``_row``, a price in ``_p``."""
    d = dates.select("symbol", "ts", F.struct(*dates.columns).alias("_row"), F.lit(None).cast("double").alias("_p"))
    p = prices.where("price is not null").select("symbol", "ts", F.lit(None).cast(d.schema["_row"].dataType).alias("_row"), F.col("price").cast("double").alias("_p"))
    return p.union(d)


def price_after(prices: DataFrame, dates: DataFrame, name: str = "price") -> DataFrame:
    """Dates (symbol, ts, ...) with the first price on or after each; of several at that time, the lowest.

    Backwards in time, and highest price first within a time, that is the last
    price before a date's row: no aggregate of prices comes before the window.
    """
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"), F.desc_nulls_last("_p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = _by_price(prices, dates).withColumn("_x", F.last("_p", True).over(w))
    return both.where("_row is not null").select("_row.*", F.col("_x").alias(name))


def dividend_factors(prices: DataFrame, dividends: DataFrame) -> DataFrame:
    """(symbol, ts, factor): (P + D) / P of each dividend (symbol, ts, value), P the first price on or after it."""
    return price_after(prices, dividends, "_p").where("_p > 0").select("symbol", "ts", ((F.col("_p") + F.col("value")) / F.col("_p")).alias("factor"))


def price_before(prices: DataFrame, dates: DataFrame, name: str = "price") -> DataFrame:
    """Dates (symbol, ts, ...) with the last price before each; of several at that time, the lowest."""
    w = Window.partitionBy("symbol").orderBy("ts", F.desc_nulls_first("_p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = _by_price(prices, dates).withColumn("_x", F.last("_p", True).over(w))
    return both.where("_row is not null").select("_row.*", F.col("_x").alias(name))


def merger_factors(prices: DataFrame, mergers: DataFrame) -> DataFrame:
    """(symbol, ts, factor) of mergers (old_symbol, new_symbol, ts, value): value times the new symbol's first price on or after, over the old one's last before.

    The factor is the old symbol's, as ``adjust`` takes it; a merger without
    either price gives none.
    """
    one = price_after(prices, mergers.withColumn("symbol", F.col("new_symbol")), "_new").drop("symbol")
    two = price_before(prices, one.withColumn("symbol", F.col("old_symbol")), "_old")
    return two.where("_old > 0 and _new is not null").select("symbol", "ts", (F.col("value") * F.col("_new") / F.col("_old")).alias("factor"))


def pairs(panel: DataFrame, key: str = "asset", ts: str = "ts", values: tuple[str, ...] = ("value",)) -> DataFrame:
    """Synchronous pairs i <= j of a panel: (ts, i, j, value_i, value_j)."""
    a = panel.select(ts, F.col(key).alias("i"), *[F.col(v).alias(f"{v}_i") for v in values])
    b = panel.select(F.col(ts).alias("_t"), F.col(key).alias("j"), *[F.col(v).alias(f"{v}_j") for v in values])
    return a.join(b, (a[ts] == b["_t"]) & (a["i"] <= b["j"])).drop("_t")


def merge_wide(df: DataFrame, asset: str, ts: str, value: str, assets: list[str], forward: bool = True) -> DataFrame:
    """(ts, one column for each of ``assets``): the union of their times; ``forward`` carries each asset's last value on.

    The fill runs by asset before the pivot, on the grid of times, so that no
    window spans the whole table.
    """
    s = df.where(F.col(asset).isin(assets)).select(F.col(asset).alias("_a"), ts, F.col(value).alias("_v"))
    grid = s.select(ts).distinct().select(ts, F.explode(F.array(*map(F.lit, assets))).alias("_a"))
    full = grid.join(s, [ts, "_a"], "left")
    if forward:
        w = Window.partitionBy("_a").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
        full = full.withColumn("_v", F.last("_v", True).over(w))
    return full.groupBy(ts).pivot("_a", assets).agg(F.first("_v"))
