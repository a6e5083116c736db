"""The library's data model over the TPC-H-like test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    """(symbol, date, ts, seq, price, volume): events with a positive value."""
    e = table(spark, sf_dir, "events").where("value > 0")
    return e.select(F.col(symbol).alias("symbol"), F.to_date("ts").cast("string").alias("date"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, ts, value): mean order price of each priority and day."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("asset"), F.col("o_orderdate").cast("timestamp").alias("ts")).agg(F.avg("o_totalprice").alias("value"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, ts, value): mean line price of each supplier and ship day."""
    i = table(spark, sf_dir, "lineitem")
    return i.groupBy(F.col("l_suppkey").alias("asset"), F.col("l_shipdate").cast("timestamp").alias("ts")).agg(F.avg("l_extendedprice").alias("value"))


TICKS = """ticks AS (SELECT event_type AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, ts, event_id AS seq, value AS price,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, epoch_us(ts) AS us FROM events WHERE value > 0)"""
DAILY = "daily AS (SELECT o_orderpriority AS asset, o_orderdate AS ts, avg(o_totalprice) AS value FROM orders GROUP BY ALL)"
PANEL = "panel AS (SELECT l_suppkey AS asset, l_shipdate AS ts, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL)"
RETS = f"{DAILY}, rets AS (SELECT *, ln(value / lag(value) OVER (PARTITION BY asset ORDER BY ts)) AS ret FROM daily)"
GAPS = f"{PANEL}, g AS (SELECT asset, ts, CASE WHEN (epoch_us(ts) // 86400000000 + asset) % 3 <> 0 THEN value END AS value FROM panel)"
PRETS = f"{PANEL}, prets AS (SELECT *, ln(value / lag(value) OVER (PARTITION BY asset ORDER BY ts)) AS ret FROM panel)"


def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.series import returns

    return returns(daily(spark, sf_dir), ["asset"], ["ts"], "value").where("ret is not null")


def panel_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.series import returns

    return returns(panel(spark, sf_dir), ["asset"], ["ts"], "value").where("ret is not null")


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel without the value of every third day."""
    day = F.floor(F.unix_micros("ts") / 86_400_000_000)
    return panel(spark, sf_dir).withColumn("value", F.when(F.pmod(day + F.col("asset"), F.lit(3)) != 0, F.col("value")))
