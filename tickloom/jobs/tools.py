"""Registration of queries with their SQL, and rounding that both engines share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUDGE = 0.0123
_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def _nudged(sql: str) -> str:
    """The SQL with every ``round(x, d)`` as ``rounded`` does it."""
    out, at = "", 0
    while (k := sql.find("round(", at)) >= 0:
        depth, end = 1, k + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner, _, digits = sql[k + 6 : end - 1].rpartition(",")
        out += f"{sql[at:k]}(round({_nudged(inner)} + {NUDGE}e-{int(digits)}, {int(digits)}) + 0.0)"
        at = end
    return out + sql[at:]


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = _nudged(sql)
        return f

    return add


def queries() -> dict[str, Callable]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Columns rounded, so that the order of additions doesn't show.

    A hundredth of the last digit is added first, so that exact ties, which
    means of prices often are, fall on one side; -0.0 becomes 0.0.
    """
    return df.withColumns({c: F.round(F.col(c) + NUDGE * 10.0**-digits, digits) + F.lit(0.0) for c in columns})


def rounded_binary(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """``rounded`` by a product and a quotient instead of decimals, for very many rows: a microsecond a number less. Products must stay below 2^53."""
    scale = 10.0**digits
    return df.withColumns({c: F.rint((F.col(c) + NUDGE * 10.0**-digits) * scale) / scale + F.lit(0.0) for c in columns})
