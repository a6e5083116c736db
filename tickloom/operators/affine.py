"""States that follow s = b * s_before + c along many series, or along few very long ones.

A row is an affine map of the state before it. Maps compose to maps, so a
batch of rows is composed by doubling, in vectors, and a series may be cut
into chunks: every chunk is composed to one map on its own, only those small
maps are put in order, and then all chunks are walked at once from the states
that they begin with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.basic import bucket, dealt


def chunks_of(df: DataFrame, time: str, most: int, keys: list[str]) -> Column:
    """A chunk number for ``affine_scan``: cuts at quantiles of ``time`` so that about ``most`` rows of the longest series meet in one.

    Numbers and timestamps can be cut; equal times stay together. One small
    job finds the cuts, which are literals of the column.
    """
    t = F.unix_micros(time) if df.schema[time].dataType == T.TimestampType() else F.col(time)
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    longest = counts.agg(F.max(F.struct("n", *keys)).alias("m")).select("m.*").first()
    if not longest or not longest["n"] or longest["n"] <= most:
        return F.lit(0)
    own = df
    for k in keys:
        own = own.where(F.col(k).eqNullSafe(F.lit(longest[k])))
    m = -(-longest["n"] // most)
    cuts = sorted(set(own.agg(F.percentile_approx(t, [k / m for k in range(1, m)], 100 * m)).first()[0] or []))
    return bucket(t, cuts)


def _turns(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether each row but the first has other keys than the row before it."""
    new = np.zeros(batch.num_rows - 1, bool)
    for k in keys:
        codes = pc.dictionary_encode(batch[k], null_encoding="encode").indices.to_numpy()
        new |= codes[1:] != codes[:-1]
    return new


def compose(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """States (paths, rows) of maps whose first ones have b = 0, by doubling; both arrays are used up."""
    step = 1
    while step < b.shape[1]:
        c[:, step:] += b[:, step:] * c[:, :-step]
        b[:, step:] *= b[:, :-step]
        step *= 2
    return c


class _Rows:
    """Coefficients of a batch, with rows that have a null made to keep the state."""

    def __init__(self, batch: pa.RecordBatch, paths: int):
        read = lambda x: np.stack([batch[f"_{x}{k}"].to_numpy(zero_copy_only=False).astype(float) for k in range(paths)])
        self.b, self.c, self.start = read("b"), read("c"), read("s")
        valid = [batch[f"_{x}{k}"].is_valid().to_numpy(zero_copy_only=False) for x in "bcs" for k in range(paths)]
        self.ok = np.logical_and.reduce(valid)
        self.b[:, ~self.ok], self.c[:, ~self.ok] = 1.0, 0.0
        self.start = np.nan_to_num(self.start)


def _walk(keys: list[str], names: list[str], keep: list[str], before: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            r = _Rows(batch, len(names))
            here = [batch[k][0].as_py() for k in keys]
            new = np.r_[state is None or here != own, _turns(batch, keys)]
            into = np.where(new, r.start, 0.0)
            if not new[0]:
                into[:, 0] = state
            edge = new.copy()
            edge[0] = True
            r.c += np.where(edge, r.b * into, 0.0)
            r.b[:, edge] = 0.0
            path = compose(r.b, r.c)
            own, state = [batch[k][batch.num_rows - 1].as_py() for k in keys], path[:, -1].copy()
            if before:
                path = np.where(edge, into, np.roll(path, 1, axis=1))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *(pa.array(p, pa.float64(), mask=~r.ok) for p in path)], [*keep, *names])

    return run


def _maps(keys: list[str], paths: int):
    """One row for each group of ``keys``: the map of all its rows, and the start that its first row names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, b, c, start, kinds = None, None, None, None, None

        def rows(found: list) -> pa.RecordBatch:
            keyed = [pa.array([f[0][i] for f in found], t) for i, t in enumerate(kinds)]
            numbers = [pa.array([f[x][k] for f in found]) for x in (1, 2, 3) for k in range(paths)]
            return pa.RecordBatch.from_arrays([*keyed, *numbers], [*keys, *[f"_{x}{k}" for x in "bcs" for k in range(paths)]])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(k).type for k in keys]
            r = _Rows(batch, paths)
            new = np.r_[own != [batch[k][0].as_py() for k in keys], _turns(batch, keys)]
            at = np.unique(np.r_[0, np.flatnonzero(new)])
            scale = np.multiply.reduceat(r.b, at, axis=1)
            if not new[0]:
                r.c[:, 0] += r.b[:, 0] * c
                scale[:, 0] *= b
            r.b[:, at] = 0.0
            ends = np.append(at[1:], batch.num_rows) - 1
            path, found = compose(r.b, r.c), []
            for j, (i, e) in enumerate(zip(at, ends, strict=True)):
                if new[i]:
                    if own is not None:
                        found.append((own, b, c, start))
                    own, start = [batch[k][int(i)].as_py() for k in keys], r.start[:, i]
                b, c = scale[:, j], path[:, e]
            if found:
                yield rows(found)
        if own is not None:
            yield rows([(own, b, c, start)])

    return run


def affine_scan(df: DataFrame, keys: list[str], order: list[str], paths: dict[str, tuple], levels: dict[str, Column] | None = None, chunk: Column | None = None, before: bool = False) -> DataFrame:
    """``df`` with a column for each of ``paths``: name to (b, c, start), columns or numbers, of s = b * s_before + c.

    ``start`` is the state before the first row of a series. ``before`` gives
    each row the state that it finds instead of the one that it makes. ``levels``
    are aggregates over the series by names that the columns may use. A row
    with a null in any of its numbers keeps all states and gets nulls.

    Without ``chunk`` a series is one task, which holds its states only. With
    it, series are cut where ``chunk`` changes (it must not fall along
    ``order``; keys and chunks must not be null), and no window, join or task
    spans a series: starts are taken from its first row.
    """
    names, levels = list(paths), levels or {}
    if chunk is not None:
        rows = df.join(df.groupBy(*keys).agg(*[c.alias(n) for n, c in levels.items()]), keys) if levels else df
        rows, groups = rows.withColumn("_chunk", chunk.cast("long")), [*keys, "_chunk"]
    else:
        groups = keys
        rows = df.withColumns({n: c.over(Window.partitionBy(*keys)) for n, c in levels.items()}) if levels else dealt(df, keys)
    as_column = lambda c: (c if isinstance(c, Column) else F.lit(float(c))).cast("double")
    temps = {f"_{x}{k}": as_column(c) for k, path in enumerate(paths.values()) for x, c in zip("bcs", path, strict=True)}
    rows = rows.select(*dict.fromkeys([*df.columns, *groups]), *[c.alias(t) for t, c in temps.items()])
    if chunk is not None:
        kinds = [T.StructField(k, rows.schema[k].dataType) for k in groups]
        ordered = dealt(rows, groups).sortWithinPartitions(*groups, *order)
        maps = ordered.mapInArrow(_maps(groups, len(names)), T.StructType([*kinds, *[T.StructField(t, T.DoubleType()) for t in sorted(temps, key=lambda t: "bcs".index(t[1]))]]))
        maps = maps.withColumnsRenamed({t: f"_of{t}" for t in temps})
        states = affine_scan(maps, keys, ["_chunk"], {f"_in{k}": tuple(F.col(f"_of_{x}{k}") for x in "bcs") for k in range(len(names))}, before=True)
        rows = rows.drop(*[f"_s{k}" for k in range(len(names))]).join(states.select(*groups, *[F.col(f"_in{k}").alias(f"_s{k}") for k in range(len(names))]), groups)
        rows = dealt(rows, groups)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return rows.sortWithinPartitions(*groups, *order).mapInArrow(_walk(groups, names, df.columns, before), schema)


def lags(df: DataFrame, keys: list[str], order: list[str], value: str, most: int, chunk: Column | None = None) -> DataFrame:
    """``value_1`` to ``value_most``: values of the rows before each row of its series, null where it has too few.

    With ``chunk`` (as in ``affine_scan``), windows end with a chunk; what its
    first rows miss comes from a small table of the last values before it.
    """
    if not most:
        return df
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({f"{value}_{k}": F.lag(value, k).over(w) for k in range(1, most + 1)})
    rows = df.withColumn("_chunk", chunk.cast("long"))
    groups = [*keys, "_chunk"]
    back = Window.partitionBy(*groups).orderBy(*[F.desc(o) for o in order])
    tails = rows.withColumn("_i", F.row_number().over(back)).where(F.col("_i") <= most)
    tails = tails.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(value).alias("v")))), lambda x: x["v"]).alias("_tail"))
    # a chunk has a row at least, so as many chunks back hold all that is missed
    earlier = F.collect_list("_tail").over(Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(1, most))
    tails = tails.select(*groups, F.flatten(earlier).alias("_tail"))
    w = Window.partitionBy(*groups).orderBy(*order)
    found = rows.join(tails, groups).withColumn("_at", F.row_number().over(w))
    own = {f"{value}_{k}": F.when(F.col("_at") > k, F.lag(value, k).over(w)).otherwise(F.get("_tail", F.lit(k) - F.col("_at"))) for k in range(1, most + 1)}
    return found.withColumns(own).drop("_chunk", "_tail", "_at")


def positions(df: DataFrame, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """``df`` with ``_chunk``, ``_i`` (from 1 along its series) and ``_n`` (rows of the series); no window spans a series.

    Rows are counted by chunk, and the small table of counts is summed up.
    """
    rows = df.withColumn("_chunk", chunk.cast("long"))
    groups = [*keys, "_chunk"]
    own = Window.partitionBy(*keys)
    counts = rows.groupBy(*groups).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(own.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*groups, before.alias("_before"), F.sum("_c").over(own).alias("_n"))
    at = F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) + F.col("_before")
    return rows.join(counts, groups).withColumn("_i", at).drop("_before")
