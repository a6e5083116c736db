"""Finite checks, safe division, calendar features, a portable random number."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    """Null for null, NaN and infinities."""
    return F.when(~F.isnan(c) & ~c.isin(INF, -INF), c)


def safe_divide(a: Column, b: Column, fill: float | None = 0.0) -> Column:
    return F.when(b == 0, F.lit(fill).cast("double")).otherwise(a / b)


def calendar(ts: Column) -> dict[str, Column]:
    """Calendar features of a timestamp; Monday is day 0."""
    day, last = F.to_date(ts), F.last_day(ts)
    return {
        "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "dayofweek": F.weekday(ts), "dayofyear": F.dayofyear(ts), "quarter": F.quarter(ts),
        "hour": F.hour(ts), "minute": F.minute(ts), "second": F.second(ts), "week": F.weekofyear(ts), "weekday_name": F.date_format(ts, "EEEE"),
        "is_month_start": F.dayofmonth(ts) == 1, "is_month_end": day == last, "is_quarter_start": day == F.trunc(ts, "quarter"),
        "is_quarter_end": day == F.date_sub(F.add_months(F.trunc(ts, "quarter"), 3), 1), "is_year_start": F.dayofyear(ts) == 1,
        "is_year_end": (F.month(ts) == 12) & (F.dayofmonth(ts) == 31), "is_weekend": F.weekday(ts) >= 5, "is_late_month": F.dayofmonth(ts) >= 28,
    }


def bucket(c: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` are below ``c``: a run of cuts is found by halving, and its few cuts are counted."""
    if len(cuts) < 16:
        return _halved(c, cuts)
    step = math.isqrt(len(cuts))
    runs = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    run = _halved(c, [r[-1] for r in runs])
    inside = F.array_size(F.filter(F.get(F.lit(runs), run), lambda x: x < c))
    return F.least(run * step + F.coalesce(inside, F.lit(0)), F.lit(len(cuts)))


def _halved(c: Column, cuts: list) -> Column:
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    return F.when(c > cuts[mid], mid + 1 + _halved(c, cuts[mid + 1 :])).otherwise(_halved(c, cuts[:mid]))


#: Fixed values of the generator: modulus, multiplier, and the addend of each round.
M, A, ADDENDS = 2147483647, 48271, (1013904223, 1664525, 907633385)


def uniform(seed: Column | int, rep: Column, k: Column) -> Column:
    """A number in [0, 1) from three non-negative integers; the same on every engine and partitioning."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    x = (seed.cast("long") * 7919 + rep.cast("long") * 104729 + k.cast("long") * 1299709 + 1) % M
    for c in ADDENDS:
        x = (((x * x + c) % M) * A) % M
    return x / F.lit(float(M))


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with all rows of equal ``keys`` in one partition, for steps that Spark sees no grouping in, as mapInArrow.

    By a hash of the keys, not by them: a repartition by the keys of a join
    before it is dropped as done already, and adaptive execution may turn that
    join into a broadcast one that leaves rows where they were read.
    """
    return df.repartition(F.xxhash64(*keys))
