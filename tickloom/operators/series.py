"""Validation, returns, lags and rolling windows of keyed series.

A series table has key columns, a time, an optional tie-breaker and a value.
Every window here is partitioned by the keys, so operations that follow one
another share one shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.basic import INF, dealt
from .affine import affine_scan, positions


def ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def finite_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, n_null, n_nan, n_inf) of each column, in one pass."""
    aggs = []
    for c in columns:
        v = F.col(c)
        aggs.append(F.struct(F.lit(c).alias("column_name"), F.count("*").alias("n"), F.count_if(v.isNull()).alias("n_null"), F.count_if(F.isnan(v)).alias("n_nan"), F.count_if(F.abs(v) == INF).alias("n_inf")))
    return df.agg(F.array(*aggs).alias("r")).select(F.inline("r"))


def positive_only(df: DataFrame, column: str = "price") -> DataFrame:
    """Rows with a positive, finite price."""
    return df.where((F.col(column) > 0) & (F.col(column) < INF) & ~F.isnan(column))


def series_report(df: DataFrame, keys: list[str], order: str, value: str, min_length: int = 1) -> DataFrame:
    """A row for each series: length, duplicate times, missing values, and whether it is valid."""
    w = ordered(keys, [order])
    marked = df.withColumn("_same", F.col(order) == F.lag(order).over(w))
    out = marked.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("_same").alias("n_duplicates"), F.count_if(F.col(value).isNull()).alias("n_missing"))
    return out.withColumn("valid", (F.col("n") >= min_length) & (F.col("n_duplicates") == 0) & (F.col("n_missing") == 0))


def date_range(df: DataFrame, column: str, start: str, end: str, zone: str | None = None) -> DataFrame:
    """Rows from start to end inclusive; with a zone, of the local time there."""
    c = F.col(column)
    if zone:
        c = F.from_utc_timestamp(c, zone)
    return df.where(c.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def returns(df: DataFrame, keys: list[str], order: list[str], price: str = "price", method: str = "log", periods: int = 1, name: str = "ret", fill: float | None = None) -> DataFrame:
    """Returns over ``periods`` rows: log, simple or percentage; the first ``periods`` rows of a series are ``fill``, a missing price gives null."""
    w = ordered(keys, order)
    before = F.lag(price, periods).over(w)
    simple = F.col(price) / before - 1
    ret = {"log": F.log(F.col(price) / before), "simple": simple, "percentage": simple * 100}[method]
    return df.withColumn(name, ret if fill is None else F.when(F.row_number().over(w) <= periods, F.lit(fill)).otherwise(ret))


def difference(df: DataFrame, keys: list[str], order: list[str], value: str, n: int = 1, name: str = "diff") -> DataFrame:
    """The n-th difference as one binomial sum of lags."""
    w = ordered(keys, order)
    return df.withColumn(name, sum((F.lag(value, k).over(w) * ((-1) ** k * math.comb(n, k)) for k in range(1, n + 1)), F.col(value)))


def lag_table(df: DataFrame, keys: list[str], order: list[str], value: str, lags: int) -> DataFrame:
    """Columns lag_1 to lag_n beside each value; rows without all lags are dropped."""
    w = ordered(keys, order)
    out = df.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in range(1, lags + 1)} | {"_pos": F.row_number().over(w)})
    return out.where(F.col("_pos") > lags).drop("_pos")


def rolling(df: DataFrame, keys: list[str], order: list[str], value: str, window: int, stats: tuple[str, ...] = ("mean", "std", "sum", "min", "max")) -> DataFrame:
    """Statistics of full windows of the last ``window`` rows; null before."""
    w = ordered(keys, order).rowsBetween(-(window - 1), 0)
    kinds = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max}
    full = F.count(value).over(w) == window
    return df.withColumns({f"roll_{s}": F.when(full, kinds[s](value).over(w)) for s in stats})


def window_weights(kind: str, n: int) -> list[float]:
    """Weights of a window of n rows, largest in the middle."""
    x = [2 * (i + 0.5) / n - 1 for i in range(n)] if kind in ("triangular", "parzen") else [2 * i / (n - 1) - 1 if n > 1 else 0.0 for i in range(n)]
    shape = {
        "triangular": lambda u: 1 - abs(u), "bartlett": lambda u: 1 - abs(u), "gaussian": lambda u: math.exp(-0.5 * (u * 2.5) ** 2),
        "hamming": lambda u: 0.54 + 0.46 * math.cos(math.pi * u), "blackman": lambda u: 0.42 + 0.5 * math.cos(math.pi * u) + 0.08 * math.cos(2 * math.pi * u),
        "parzen": lambda u: 1 - 6 * u * u + 6 * abs(u) ** 3 if abs(u) <= 0.5 else 2 * (1 - abs(u)) ** 3,
    }[kind]
    return [shape(u) for u in x]


def weighted_rolling(df: DataFrame, keys: list[str], order: list[str], value: str, window: int, kind: str = "triangular", name: str = "wmean") -> DataFrame:
    """Weighted mean of full windows, as a sum of weighted lags."""
    w, weights = ordered(keys, order), window_weights(kind, window)
    total = sum(weights)
    terms = [F.lag(value, k).over(w) * (weights[window - 1 - k] / total) for k in range(window)]
    return df.withColumn(name, sum(terms[1:], terms[0]))


def sliding(df: DataFrame, keys: list[str], order: list[str], value: str, window: int, step: int = 1) -> DataFrame:
    """Arrays of ``window`` consecutive values, every ``step`` rows."""
    w = ordered(keys, order)
    out = df.withColumns({"_pos": F.row_number().over(w), "values": F.collect_list(value).over(w.rowsBetween(-(window - 1), 0))})
    return out.where((F.col("_pos") >= window) & (F.pmod(F.col("_pos") - window, F.lit(step)) == 0)).drop("_pos")


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, window: int, edge: str = "shrink", name: str = "smooth") -> DataFrame:
    """Centred mean of ``window`` rows (the larger half before); at edges of what is there, or with zeros beyond."""
    w = ordered(keys, order).rowsBetween(-(window // 2), (window - 1) // 2)
    return df.withColumn(name, F.avg(value).over(w) if edge == "shrink" else F.sum(value).over(w) / window)


def kernel_smooth(df: DataFrame, keys: list[str], order: list[str], value: str, bandwidth: float, name: str = "smooth") -> DataFrame:
    """Gaussian-kernel mean over rows; weights beyond six bandwidths, below 2e-8, are left out."""
    reach, w = math.ceil(6 * bandwidth), ordered(keys, order)
    lags = [(k, math.exp(-0.5 * (k / bandwidth) ** 2)) for k in range(-reach, reach + 1)]
    around = [(F.lag(value, k).over(w) if k > 0 else F.lead(value, -k).over(w) if k < 0 else F.col(value), g) for k, g in lags]
    top = sum((F.coalesce(c * g, F.lit(0.0)) for c, g in around), F.lit(0.0))
    low = sum((F.when(c.isNotNull(), g).otherwise(0.0) for c, g in around), F.lit(0.0))
    return df.withColumn(name, top / low)


def _diagonals(at: np.ndarray, n: int, lamb: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ``at`` (from 0) of the identity plus lamb times the squared second differences of n values: the diagonal and the two beside it."""
    main, one, two = np.ones(len(at)), np.zeros(len(at)), np.zeros(len(at))
    if n < 3:
        return main, one, two
    for shift, w in ((0, 1.0), (1, 4.0), (2, 1.0)):
        main += lamb * w * ((at >= shift) & (at < n - 2 + shift))
    one += -2 * lamb * ((at < n - 2).astype(float) + ((at >= 1) & (at < n - 1)))
    two += lamb * (at < n - 2)
    return main, one, two


def _eliminated(main: np.ndarray, one: np.ndarray, two: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """The solution (rows, columns) of a symmetric system of five diagonals, by elimination; couplings beyond the last row are ignored."""
    n = len(main)
    d, e, f, z = main.tolist(), one.tolist(), two.tolist(), [rhs[i].copy() for i in range(n)]
    for i in range(n):
        for k, off in ((1, e[i]), (2, f[i])):
            if i + k < n:
                m = off / d[i]
                d[i + k] -= m * off
                z[i + k] -= m * z[i]
                if k == 1:
                    e[i + 1] -= m * f[i]
    x = [None] * n
    for i in range(n - 1, -1, -1):
        v = z[i]
        if i + 1 < n:
            v = v - e[i] * x[i + 1]
        if i + 2 < n:
            v = v - f[i] * x[i + 2]
        x[i] = v / d[i]
    return np.array(x)


def _banded(y: np.ndarray, lamb: float) -> np.ndarray:
    """x that makes |y - x|^2 + lamb |second differences of x|^2 least."""
    return _eliminated(*_diagonals(np.arange(len(y)), len(y), lamb), y.astype(float)[:, None])[:, 0] if len(y) else y.astype(float)


def _coupled(at: np.ndarray, n: int, lamb: float) -> tuple[np.ndarray, np.ndarray]:
    """How a block's rows hang on the last two values before it and the first two after it: matrices (rows, 2)."""
    m = len(at)
    left, right = np.zeros((m, 2)), np.zeros((m, 2))
    if at[0]:
        _, one, two = _diagonals(np.array([at[0] - 2, at[0] - 1]), n, lamb)
        left[0] = two[0], one[1]
        left[1, 1] = two[1]
    if at[-1] < n - 1:
        _, one, two = _diagonals(np.array([at[-1] - 1, at[-1]]), n, lamb)
        right[-2, 0] = two[0]
        right[-1] = one[1], two[1]
    return left, right


def _interface(blocks: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Values (before 2, after 2) around each block from its (z, V | W) at its first two and last two rows.

    Unknown are four values a block, the rows of z - V before - W after; this
    small block-tridiagonal system is eliminated block by block.
    """
    k = len(blocks)
    # x_j = z_j - L_j x_(j-1) - U_j x_(j+1), where only the last two of x_(j-1) and the first two of x_(j+1) count
    low = [np.c_[np.zeros((4, 2)), v[:, :2]] for _, v in blocks]
    up = [np.c_[v[:, 2:], np.zeros((4, 2))] for _, v in blocks]
    gain, off = [], []
    for j in range(k):
        a = np.eye(4) - (low[j] @ gain[j - 1] if j else 0)
        b = blocks[j][0] - (low[j] @ off[j - 1] if j else 0)
        gain.append(np.linalg.solve(a, up[j]))
        off.append(np.linalg.solve(a, b))
    x = [None] * k
    for j in range(k - 1, -1, -1):
        x[j] = off[j] - (gain[j] @ x[j + 1] if j + 1 < k else 0)
    none = np.zeros(2)
    return [np.r_[x[j - 1][2:] if j else none, x[j + 1][:2] if j + 1 < k else none] for j in range(k)]


def hodrick_prescott(df: DataFrame, keys: list[str], order: list[str], value: str, lamb: float = 1600.0, name: str = "trend", chunk: Column | None = None, block: int = 65_536) -> DataFrame:
    """``name``: the smooth trend of each series, an exact banded solve in time and memory linear in its length.

    A series is one task without ``chunk``. With it (see ``affine``), a series
    is dealt into blocks of ``block`` rows or a little more: each block is
    solved for its own values and for what the two values on either side of it
    do to it, those few numbers a block are solved for together, and every
    block is solved once more with its neighbours' values known. Values must
    not be null.
    """
    schema, own = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]), df.columns

    def one(pdf):
        pdf = pdf.sort_values(order)
        return pdf.assign(**{name: _banded(pdf[value].to_numpy(float), lamb)})

    if chunk is None:
        return df.groupBy(*keys).applyInPandas(one, schema)
    rows = positions(df, keys, order, chunk).drop("_chunk")
    last = F.greatest(F.floor(F.col("_n") / block), F.lit(1)) - 1  # no block is shorter than ``block``, but for a single one
    rows = rows.withColumn("_b", F.least(F.floor((F.col("_i") - 1) / block), last).cast("long"))
    groups = [*keys, "_b"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*groups).schema)

    def ends(key, pdf):
        pdf = pdf.sort_values("_i")
        at, n = pdf["_i"].to_numpy() - 1, int(pdf["_n"].iloc[0])
        rhs = np.c_[pdf[value].to_numpy(float)[:, None], np.zeros((len(at), 4))]
        if len(at) > 1:
            rhs[:, 1:] = np.c_[_coupled(at, n, lamb)]
        x = _eliminated(*_diagonals(at, n, lamb), rhs)[[0, min(1, len(at) - 1), max(len(at) - 2, 0), len(at) - 1]]
        return pd.DataFrame([[*key, x.ravel().tolist()]], columns=[*groups, "_x"])

    def around(key, pdf):
        pdf = pdf.sort_values("_b")
        x = [np.array(v).reshape(4, 5) for v in pdf["_x"]]
        found = _interface([(v[:, 0], v[:, 1:]) for v in x]) if len(x) > 1 else [np.zeros(4)]
        return pd.DataFrame({c: pdf[c].to_numpy() for c in groups} | {"_x": [v.tolist() for v in found]})

    def solve(pdf):
        pdf = pdf.sort_values("_i")
        at, n, y = pdf["_i"].to_numpy() - 1, int(pdf["_n"].iloc[0]), pdf[value].to_numpy(float).copy()
        if len(at) > 1:
            y -= np.c_[_coupled(at, n, lamb)] @ np.array(pdf["_x"].iloc[0])
        return pdf[own].assign(**{name: _eliminated(*_diagonals(at, n, lamb), y[:, None])[:, 0]})

    known = rows.groupBy(*groups).applyInPandas(ends, f"{kinds}, _x array<double>").groupBy(*keys).applyInPandas(around, f"{kinds}, _x array<double>")  # a row a block
    return rows.join(known, groups).groupBy(*groups).applyInPandas(solve, schema)


def threshold_filter(df: DataFrame, keys: list[str], value: str, share: float = 0.05, name: str = "filtered") -> DataFrame:
    """Zero where the absolute value is under ``share`` of the series' mean absolute value."""
    limit = F.avg(F.abs(F.col(value))).over(Window.partitionBy(*keys)) * share
    return df.withColumn(name, F.when(F.abs(F.col(value)) < limit, 0.0).otherwise(F.col(value)))


def scan(df: DataFrame, keys: list[str], order: list[str], inputs: list[Column], step, name: str) -> DataFrame:
    """Rows with ``name``, a number computed from a state that is carried along each series.

    ``step(state, *inputs)`` gives (state, number) of a row from the state of
    the row before, None at the start of a series. A row with a null input
    keeps the state and gets null. A series is read once in order, batch by
    batch: only its state is held, whatever its length.
    """
    temp = [f"_in{k}" for k in range(len(inputs))]
    whole = dealt(df, keys).withColumns({t: c.cast("double") for t, c in zip(temp, inputs, strict=True)}).sortWithinPartitions(*keys, *order)
    keep = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for b in batches:
            out = []
            for key, *row in zip(zip(*(b[k].to_pylist() for k in keys), strict=True), *(b[t].to_pylist() for t in temp), strict=True):
                if key != own:
                    own, state = key, None
                if None in row:
                    out.append(None)
                else:
                    state, x = step(state, *row)
                    out.append(x)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(out, pa.float64())], [*keep, name])

    return whole.mapInArrow(run, schema)


def ewma(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, adjust: bool = False, name: str = "ewma", chunk: Column | None = None) -> DataFrame:
    """Exponentially weighted mean: recursive from the first value, or adjusted by the weights seen so far.

    Nulls keep the mean and get none. ``chunk``, as in ``affine.affine_scan``, is for few very long series.
    """
    x, b = F.col(value), 1 - alpha
    if adjust:
        paths = {"_num": (b, x, 0.0), "_den": (b, F.when(x.isNotNull(), 1.0), 0.0)}
        return affine_scan(df, keys, order, paths, chunk=chunk).withColumn(name, F.col("_num") / F.col("_den")).drop("_num", "_den")
    first = F.min_by(x, F.when(x.isNotNull(), F.struct(*order)))
    return affine_scan(df, keys, order, {name: (b, alpha * x, F.col("_first"))}, {"_first": first}, chunk)
