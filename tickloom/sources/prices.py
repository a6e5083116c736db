"""Price tables in csv, json and parquet, long and wide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {"csv": "csv", "txt": "csv", "json": "json", "parquet": "parquet"}


def format_of(path: str, fmt: str | None = None) -> str:
    """The given format, or that of the path's extension."""
    fmt = fmt or path.rstrip("/").rpartition(".")[2].lower()
    if fmt not in FORMATS:
        raise ValueError(f"no format for {path!r}; give one of {sorted(set(FORMATS.values()))}")
    return FORMATS[fmt]


def read_prices(spark: SparkSession, path: str, fmt: str | None = None, date_col: str = "ts", schema: str | None = None) -> DataFrame:
    """A table with ``date_col`` parsed to a timestamp; an absent one is an error, an unreadable date null."""
    reader = spark.read.format(fmt := format_of(path, fmt))
    if fmt == "csv":
        reader = reader.option("header", True)
    df = (reader.schema(schema) if schema else reader).load(path)
    if date_col not in df.columns:
        raise ValueError(f"no column {date_col!r} in {path!r}: {df.columns}")
    return df.withColumn(date_col, parsed(F.col(date_col)) if dict(df.dtypes)[date_col] == "string" else F.col(date_col).cast("timestamp"))


def parsed(c: Column) -> Column:
    """A timestamp of a date or time text; null if it is neither."""
    return F.try_to_timestamp(c)


def write_prices(df: DataFrame, path: str, fmt: str | None = None, by_date: str | None = None, mode: str = "errorifexists") -> None:
    """Write a table, with ``by_date`` as one folder for each day of that timestamp."""
    fmt = format_of(path, fmt)
    if by_date:
        df = df.withColumn("date", F.to_date(by_date))
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy("date") if by_date else w).save(path)


def to_long(df: DataFrame, ids: list[str], assets: list[str]) -> DataFrame:
    """Asset columns to rows (ids, asset, value)."""
    return df.unpivot(ids, assets, "asset", "value")


def to_wide(df: DataFrame, ids: list[str], assets: list[str]) -> DataFrame:
    """Rows (ids, asset, value) to one column for each listed asset; the list is part of the plan, so no pass is spent to find it."""
    return df.groupBy(*ids).pivot("asset", assets).agg(F.first("value"))
