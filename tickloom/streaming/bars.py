"""Bars and realized variance over tick streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(ticks: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Open, high, low, close, volume, vwap and twap by symbol and window; ticks later than ``late`` are dropped."""
    at, p, v = F.struct("ts", "seq"), F.col("price"), F.col("volume")
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    bars = ticks.withWatermark("ts", late).groupBy("symbol", w.alias("w")).agg(
        F.min_by(p, at).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, at).alias("close"),
        F.sum(v).alias("volume"), (F.sum(p * v) / F.nullif(F.sum(v), F.lit(0.0))).alias("vwap"), F.avg(p).alias("twap"),
    )
    return bars.select("symbol", F.col("w.start").alias("bucket"), "open", "high", "low", "close", "volume", "vwap", "twap")


def stream_variance(bars: DataFrame, alpha: float = 0.06, start: float = 1e-4, late: str | None = None, idle: str = "1 day") -> DataFrame:
    """One exponentially weighted variance for each bar (symbol, ts, price), its state kept by symbol.

    Without ``late`` bars are taken batch by batch, by time within a batch.
    With it bars wait, at most that long, until the watermark has passed them,
    so that they are taken by time whatever batch they came in; bars that come
    later are dropped, and a symbol without bars for ``idle`` starts anew.
    """
    keep = int(pd.Timedelta(idle) / pd.Timedelta("1ms"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        price, var, last, times, prices = state.get if state.exists else (float("nan"), start, 0, [], [])
        whole = [pd.DataFrame({"us": times, "price": prices})] + [pdf[["us", "price"]] for pdf in frames]
        waiting = pd.concat([f for f in whole if len(f)]).sort_values("us", kind="stable") if any(map(len, whole)) else whole[0]
        passed = state.getCurrentWatermarkMs() if late else 0
        ready = waiting["us"] <= passed * 1000 if late else np.ones(len(waiting), bool)
        out, waiting = [], (waiting[ready], waiting[~ready])
        for us, p in zip(waiting[0]["us"].tolist(), waiting[0]["price"].tolist(), strict=True):
            if late and last and us - last > keep * 1000:
                price, var = float("nan"), start
            if not np.isnan(price):
                var = (1 - alpha) * var + alpha * float(np.log(p / price)) ** 2
            price, last = p, us
            out.append((key[0], us, price, var))
        times, prices = waiting[1]["us"].tolist(), waiting[1]["price"].tolist()
        at = min(times) // 1000 + 1 if times else last // 1000 + keep
        if late and not times and at <= passed:
            state.remove()
        else:
            state.update((price, var, last, times, prices))
            if late:
                state.setTimeoutTimestamp(max(at, passed + 1))
        yield pd.DataFrame(out, columns=["symbol", "us", "price", "var"])

    if late:
        bars = bars.withWatermark("ts", late)
    timed = bars.select("symbol", "ts", "price", F.unix_micros("ts").alias("us")).groupBy("symbol")
    kept = "price double, var double, last long, times array<long>, prices array<double>"
    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    out = timed.applyInPandasWithState(run, "symbol string, us long, price double, var double", kept, "append", timeout)
    return out.select("symbol", F.timestamp_micros("us").alias("ts"), "price", "var")


def stream_realized_variance(ticks: DataFrame, width: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(symbol, date, rv, n_returns) of each day in UTC, once the watermark has passed its end.

    Prices are the first ticks (ts, seq, price) of a day's non-empty intervals;
    ``width`` must divide a day. The state is the open intervals and, by day, the
    prices of the closed ones; later ticks are dropped.
    """
    first = F.min_by("price", F.struct("ts", "seq")).alias("price")
    closed = ticks.where("price is not null").withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w")).agg(first)
    path = F.sort_array(F.collect_list(F.struct(F.unix_micros("w.start").alias("us"), F.log("price").alias("log")))).alias("path")
    days = closed.groupBy("symbol", F.window(F.window_time("w"), "1 day").alias("day")).agg(path)
    n = F.size("path")
    squares = F.zip_with(F.slice("path", 2, n), F.slice("path", 1, n - 1), lambda y, x: (y["log"] - x["log"]) * (y["log"] - x["log"]))
    date = F.date_from_unix_date(F.floor(F.unix_seconds("day.start") / 86_400).cast("int"))
    return days.select("symbol", date.alias("date"), F.aggregate(squares, F.lit(0.0), lambda a, x: a + x).alias("rv"), (n - 1).cast("long").alias("n_returns"))
