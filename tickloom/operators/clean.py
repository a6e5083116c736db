"""Imputation, outliers, scaling and splits."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .series import ordered


def fill(df: DataFrame, keys: list[str], order: list[str], value: str, method: str = "ffill", limit: int | None = None, chunk: Column | None = None) -> DataFrame:
    """Gaps of ``value``: ffill, bfill (both up to ``limit`` rows), or linear by position.

    A gap at the start stays under ffill and linear; linear carries a gap at
    the end forward. ``chunk`` (see ``affine.affine_scan``) cuts few very long
    series: windows end with a chunk, and the last value known before it and
    the first known after it come from a small table.
    """
    return fills(df, keys, order, value, {value: (method, limit)}, chunk)


def fills(df: DataFrame, keys: list[str], order: list[str], value: str, ways: dict[str, tuple[str, int | None]], chunk: Column | None = None) -> DataFrame:
    """``df`` with a column for each of ``ways``, name to (method, limit): gaps of ``value`` as ``fill`` closes them.

    All ways share one numbering of the rows and, with ``chunk``, one small
    table of a row a chunk: what is read does not grow with the ways.
    """
    w = ordered(keys, order)
    if chunk is None and all(m in ("ffill", "bfill") for m, _ in ways.values()):
        windows = {}
        for name, (method, limit) in ways.items():
            if method == "ffill":
                windows[name] = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0))
            else:
                windows[name] = F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing if limit is None else limit))
        return df.withColumns(windows)
    groups = keys if chunk is None else [*keys, "_chunk"]
    w = ordered(groups, order)
    rows = (df if chunk is None else df.withColumn("_chunk", chunk.cast("long"))).withColumn("_i", F.row_number().over(w))
    known = F.when(F.col(value).isNotNull(), F.struct("_i", F.col(value).alias("v")))
    found = rows.withColumns({"_p": F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_q": F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    if chunk is not None:
        later = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}._i") + F.col("_before")).alias("_i"), F.col(f"{c}.v").alias("v")))
        at = Window.partitionBy(*keys).orderBy("_chunk")
        past, ahead = at.rowsBetween(Window.unboundedPreceding, -1), at.rowsBetween(1, Window.unboundedFollowing)
        ends = rows.groupBy(*groups).agg(F.count("*").alias("_c"), F.max(known).alias("_e"), F.min(known).alias("_s"))
        ends = ends.withColumn("_before", F.coalesce(F.sum("_c").over(past), F.lit(0))).withColumns({"_e": later("_e"), "_s": later("_s")})
        ends = ends.select(*groups, "_before", F.last("_e", True).over(past).alias("_pp"), F.first("_s", True).over(ahead).alias("_qq"))
        found = found.join(ends, groups).withColumns({"_i": F.col("_i") + F.col("_before"), "_p": F.coalesce(later("_p"), "_pp"), "_q": F.coalesce(later("_q"), "_qq")})
    back, ahead = F.col("_i") - F.col("_p._i"), F.col("_q._i") - F.col("_i")
    out = {}
    for name, (method, limit) in ways.items():
        far = lambda d, limit=limit: F.lit(limit is not None) & (d > (limit or 0))
        if method == "ffill":
            out[name] = F.when(~far(back), F.col("_p.v"))
        elif method == "bfill":
            out[name] = F.when(~far(ahead), F.col("_q.v"))
        else:
            line = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * back / F.nullif(F.col("_q._i") - F.col("_p._i"), F.lit(0))
            out[name] = F.when(F.col(value).isNotNull(), F.col(value)).when(far(back), None).otherwise(F.coalesce(line, F.col("_p.v")))
    return found.withColumns(out).select(*dict.fromkeys([*df.columns, *ways]))


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows in which no column (of ``columns``) is null or NaN."""
    columns = columns or df.columns
    number = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) if c in number else F.col(c).isNotNull())
    return df


def not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline through (x, y) whose third derivative is continuous at the second and last but one points; a line or parabola for two or three."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x, y, n - 1), at) if n else np.full(len(at), np.nan)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    a, rhs = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i] = 6 * (slope[i] - slope[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, rhs)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    d, e = at - x[k], x[k + 1] - at
    return (m[k] * e**3 + m[k + 1] * d**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * e + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * d


def spline(df: DataFrame, keys: list[str], order: list[str], value: str, run: int = 512) -> DataFrame:
    """Gaps between known values filled by a not-a-knot cubic spline over positions; gaps at the ends stay.

    A series is cut at known values into runs of about ``run`` of them that
    overlap by 16 at either end, so a task holds one run whatever the series'
    length; a spline's pull dies out over such an overlap.
    """
    w, lap = ordered(keys, order), 16
    rows = df.withColumns({"_i": F.row_number().over(w), "_k": F.count(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    own = F.floor((F.col("_k") - 1) / run).cast("int")
    place = F.pmod(F.col("_k") - 1, F.lit(run))
    also = F.filter(F.array(own, F.when(place < lap, own - 1), F.when(place >= run - lap, own + 1)), lambda b: b.isNotNull() & (b >= 0))
    dealt = rows.withColumn("_b", F.explode(F.when(F.col("_k") == 0, F.array(F.lit(0))).otherwise(also))).withColumn("_home", F.col("_b") == F.greatest(own, F.lit(0)))
    fields = [f for f in dealt.schema if f.name != "_b"]
    schema = T.StructType([*fields])

    def one(pdf):
        pdf = pdf.sort_values("_i")
        y, x = pdf[value].to_numpy(float), pdf["_i"].to_numpy(float)
        known = ~np.isnan(y)
        if known.sum() > 1:
            gap = ~known & (x > x[known][0]) & (x < x[known][-1])
            y = y.copy()
            y[gap] = not_a_knot(x[known], y[known], x[gap])
            pdf = pdf.assign(**{value: y})
        return pdf[[f.name for f in fields]]

    return dealt.groupBy(*keys, "_b").applyInPandas(one, schema).where("_home").select(*df.columns)


#: Sets of known columns (with the column to fill) that get donors of their own; gaps of rarer sets meet whole rows.
VIEWS = 16


def _boxes(donors: DataFrame, columns: int, n: int, block: int) -> tuple[DataFrame, pd.DataFrame]:
    """Donors (_id, _v, _box) in blocks of about ``block`` rows that lie together, and the table of blocks: _box, _view, known columns, bounds, rows.

    Donors of a view that know the same columns are cut at quantiles of the
    first known column of their place ``_k`` and, within a cut, into runs along
    the second. The table has n / ``block`` rows and at most 64 for each view
    and set of known columns.
    """
    known = [F.col("_v")[j] for j in range(columns)]
    values = F.filter("_k", lambda x: x.isNotNull())
    has = sum((F.when(c.isNotNull(), F.lit(1 << j)).otherwise(F.lit(0)) for j, c in enumerate(known)), F.lit(0))
    donors = donors.withColumns({"_has": has, "_a": F.get(values, F.lit(0)), "_b": F.get(values, F.lit(1))})
    m = min(64, max(1, round((n / block) ** 0.5)))
    if m > 1:
        cuts = donors.groupBy("_view", "_has").agg(F.percentile_approx("_a", [k / m for k in range(1, m)]).alias("_cuts"))  # a row for each set of columns
        donors = donors.join(F.broadcast(cuts), ["_view", "_has"]).withColumn("_cell", F.array_size(F.filter("_cuts", lambda c: c < F.col("_a")))).drop("_cuts")
    else:
        donors = donors.withColumn("_cell", F.lit(0))
    run = F.floor((F.row_number().over(Window.partitionBy("_view", "_has", "_cell").orderBy("_b", "_a", "_id")) - 1) / block)
    donors = donors.select("_id", "_v", F.concat_ws(":", "_view", "_has", "_cell", run).alias("_box"), "_view", "_has")
    bounds = [f(F.col("_v")[j]).alias(f"{c}{j}") for j in range(columns) for c, f in (("lo", F.min), ("hi", F.max))]
    return donors, donors.groupBy("_box", "_view", "_has").agg(F.count("*").alias("rows"), *bounds).orderBy("_box").toPandas()


def _asked(boxes: pd.DataFrame, columns: int, k: int, home: bool):
    """(_id, _c, _v, _box): for every gap the blocks that may hold one of its ``k`` nearest, or only the nearest block."""
    views = {}
    for view, t in boxes.groupby("_view"):
        has = (t["_has"].to_numpy()[:, None] >> np.arange(columns) & 1).astype(bool)
        lo, hi = (t[[f"{c}{j}" for j in range(columns)]].to_numpy(float) for c in ("lo", "hi"))
        views[view] = has, lo, hi, t["_box"].to_numpy(), t["rows"].to_numpy() >= k

    def run(frames):
        for pdf in frames:
            out, same = [], {}
            for i, c, v, view, u in zip(pdf["_id"], pdf["_c"], pdf["_v"], pdf["_view"], pdf["_u"], strict=True):
                if view not in views:
                    continue
                has, lo, hi, names, enough = views[view]
                x = np.array([np.nan if a is None else a for a in v], float)
                key = view, c, None if np.isnan(u) else u, x.tobytes()
                if key in same:
                    out += [(i, c, v, b) for b in same[key]]
                    continue
                shared = has & ~np.isnan(x)
                with np.errstate(all="ignore"):
                    off = np.where(shared, np.maximum(np.maximum(lo - x, x - hi), 0.0), 0.0)
                    least = np.sqrt((off * off).sum(1) * columns / shared.sum(1))
                least[~has[:, c] | ~shared.any(1)] = np.inf
                if home:
                    order = np.lexsort((np.arange(len(least)), ~enough, least))[:1]
                    picked = order[np.isfinite(least[order])]
                else:
                    picked = np.flatnonzero((least <= (np.inf if np.isnan(u) else u * (1 + 1e-9))) & np.isfinite(least))
                same[key] = [names[b] for b in picked]
                out += [(i, c, v, b) for b in same[key]]
            yield pd.DataFrame(out, columns=["_id", "_c", "_v", "_box"])

    return run


def _visited(asked: DataFrame, donors: DataFrame, columns: int, k: int, kind: str, tasks: int, most: int = 4096) -> DataFrame:
    """(_id, _c, _d, _from, _x): the ``k`` nearest rows of a block to each gap that asks it; what asks one block often is dealt in parts.

    ``tasks`` is given because few bytes ask for much work here, and Spark
    would put them in one task.
    """
    parts = asked.groupBy("_box").agg(F.ceil(F.count("*") / most).cast("int").alias("_parts"))
    ask = asked.join(parts, "_box").select("_box", F.pmod(F.xxhash64("_id", "_c"), F.col("_parts")).cast("int").alias("_part"), "_id", "_c", "_v")
    give = donors.join(parts, "_box").select("_box", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "_id", F.lit(-1).alias("_c"), "_v")

    def nearest(key, pdf):
        a, d = pdf[pdf["_c"] >= 0], pdf[pdf["_c"] < 0]
        y = np.array([[np.nan if x is None else x for x in v] for v in d["_v"]], float)
        known = ~np.isnan(y)
        ids, out, same = d["_id"].to_numpy(), [], {}
        for i, c, v in zip(a["_id"], a["_c"], a["_v"], strict=True):
            x = np.array([np.nan if q is None else q for q in v], float)
            if (c, x.tobytes()) in same:  # a gap's own row lacks the value, so equal gaps have equal answers
                out += [(i, c, *r) for r in same[c, x.tobytes()]]
                continue
            with np.errstate(all="ignore"):
                shared = known & ~np.isnan(x)
                e = np.sqrt(np.where(shared, (y - x) ** 2, 0.0).sum(1) * columns / shared.sum(1))
            e[~shared.any(1) | ~known[:, c]] = np.inf
            near = np.flatnonzero((e <= np.partition(e, k - 1)[k - 1]) & np.isfinite(e)) if len(e) > k else np.flatnonzero(np.isfinite(e))
            found = same[c, x.tobytes()] = [(float(e[m]), ids[m], float(y[m, c])) for m in near[np.lexsort((ids[near], e[near]))[:k]]]
            out += [(i, c, *r) for r in found]
        return pd.DataFrame(out, columns=["_id", "_c", "_d", "_from", "_x"])

    return ask.unionByName(give).repartition(tasks, "_box", "_part").groupBy("_box", "_part").applyInPandas(nearest, f"_id {kind}, _c int, _d double, _from {kind}, _x double")


def _views(rows: DataFrame, gaps: DataFrame, columns: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Donors (_view, _id, _v, _k) and gaps with ``_view``: gaps of one set of known columns meet donors that differ in these columns.

    Donors in the same place ``_k`` are as far from each gap of a view, so only
    the ``k`` of the smallest ids among them can be taken: exact, and a value
    that many rows share is no crowd that each gap must visit.
    """
    found = gaps.where("_set > 0").groupBy("_set", "_c").count().orderBy(F.desc("count"), "_set", "_c").limit(VIEWS + 1).collect()
    own = [(r["_set"], r["_c"]) for r in found[:VIEWS]]
    view = reduce(lambda a, t: a.when((F.col("_set") == t[1][0]) & (F.col("_c") == t[1][1]), t[0]), enumerate(own), F.when(F.lit(False), -1)).otherwise(-1)

    def place(keep: int, also: int = -1):
        return F.array(*[F.col("_v")[j] if keep >> j & 1 or j == also else F.lit(None).cast("double") for j in range(columns)])

    kinds = [F.struct(F.lit(i).alias("_view"), place(known, c).alias("_v"), F.when(F.col("_v")[c].isNotNull(), place(known)).alias("_k")) for i, (known, c) in enumerate(own)]
    if len(found) > VIEWS:
        kinds.append(F.struct(F.lit(-1).alias("_view"), F.col("_v"), F.col("_v").alias("_k")))
    none = F.array().cast("array<struct<_view:int,_v:array<double>,_k:array<double>>>")
    seen = rows.select("_id", F.explode(F.array(*kinds) if kinds else none).alias("_s")).select("_id", "_s.*")
    seen = seen.where(F.exists("_k", lambda x: x.isNotNull()))
    rank = F.row_number().over(Window.partitionBy("_view", "_k").orderBy("_id"))
    return seen.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r"), gaps.withColumn("_view", view)


def _tasks(n: int) -> int:
    """How many tasks look for the nearest of ``n`` rows."""
    return 1 + n // 16_384


def knn_plan(df: DataFrame, row_id: str, columns: list[str], k: int = 5, block: int = 4096) -> tuple[DataFrame, DataFrame, int]:
    """(asked, donors, blocks): which blocks every gap must visit to be sure of its ``k`` nearest rows, as ``knn_impute`` does.

    The nearest block gives each gap k rows and so a bound on the k-th
    distance; a block is visited if its bounds come as near as that. A gap
    whose nearest block has fewer than k fitting rows visits them all.
    """
    cells = [F.col(c).cast("double") for c in columns]
    gap = F.filter(F.array(*[F.when(c.isNull(), F.lit(j)) for j, c in enumerate(cells)]), lambda j: j.isNotNull())
    rows = df.select(F.col(row_id).alias("_id"), F.array(*[F.when(~F.isnan(c), c) for c in cells]).alias("_v"), gap.alias("_gap"))
    kind, m = rows.schema["_id"].dataType.simpleString(), len(columns)
    n = max(1, df.count())
    tasks = _tasks(n)
    known = sum((F.when(F.col("_v")[j].isNotNull(), F.lit(1 << j)).otherwise(F.lit(0)) for j in range(m)), F.lit(0))
    gaps = rows.select("_id", "_v", known.alias("_set"), F.explode("_gap").alias("_c")).repartition(tasks, "_id")
    donors, gaps = _views(rows, gaps, m, k)
    donors, boxes = _boxes(donors, m, n, max(block, n // 250_000))
    schema = f"_id {kind}, _c int, _v array<double>, _box string"
    first = gaps.withColumn("_u", F.lit(None).cast("double")).mapInPandas(_asked(boxes, m, k, True), schema)
    bound = _visited(first, donors, m, k, kind, tasks).groupBy("_id", "_c").agg(F.when(F.count("*") >= k, F.max("_d")).alias("_u"))
    asked = gaps.join(bound, ["_id", "_c"], "left").mapInPandas(_asked(boxes, m, k, False), schema)
    return asked, donors, len(boxes)


def knn_impute(df: DataFrame, row_id: str, columns: list[str], k: int = 5, weights: str = "uniform", block: int = 4096) -> DataFrame:
    """``df`` with gaps of ``columns`` filled from the ``k`` nearest rows that have the value.

    Distance is over the columns that both rows have, scaled up to all of them;
    the smaller id is the nearer of two as near. Ids must be unique and not
    null. Of donors equal in what a gap knows, the first k are kept (``_views``);
    they lie in blocks with bounds, and a gap visits only the blocks that can
    hold one of its k nearest (``knn_plan``): exact, and no task holds more than
    a block of donors and as many gaps.
    """
    kind = df.select(row_id).schema[0].dataType.simpleString()
    asked, donors, _ = knn_plan(df, row_id, columns, k, block)
    near = _visited(asked, donors, len(columns), k, kind, _tasks(df.count()))
    top = near.withColumn("_r", F.row_number().over(Window.partitionBy("_id", "_c").orderBy("_d", "_from"))).where(F.col("_r") <= k)
    exact = F.max((F.col("_d") == 0).cast("int")).over(Window.partitionBy("_id", "_c"))
    weight = F.lit(1.0) if weights == "uniform" else F.when(exact == 1, (F.col("_d") == 0).cast("double")).otherwise(1 / F.col("_d"))
    top = top.withColumn("_w", weight).groupBy("_id", "_c").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_x"))
    wide = top.groupBy("_id").pivot("_c", list(range(len(columns)))).agg(F.first("_x"))
    joined = df.join(wide.select(F.col("_id"), *[F.col(str(j)).alias(f"_f{j}") for j in range(len(columns))]), F.col(row_id) == F.col("_id"), "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), f"_f{j}") for j, c in enumerate(columns)}).select(*df.columns)


def fill_statistic(df: DataFrame, keys: list[str], value: str, method: str = "mean") -> DataFrame:
    """Gaps filled with each series' mean, median, smallest mode, or zero."""
    if method == "zero":
        return df.withColumn(value, F.coalesce(value, F.lit(0.0)))
    stat = {"mean": F.avg, "median": F.median}.get(method)
    if stat:
        table = df.groupBy(*keys).agg(stat(value).alias("_s"))
    else:
        counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
        table = counts.groupBy(*keys).agg(F.min(F.struct(-F.col("_n"), F.col(value).alias("v"))).alias("_m")).select(*keys, F.col("_m.v").alias("_s"))
    return df.join(table, keys, "left").withColumn(value, F.coalesce(value, "_s")).drop("_s")


def outliers(df: DataFrame, keys: list[str], value: str, method: str = "zscore", limit: float = 3.0) -> DataFrame:
    """``outlier`` and ``value`` with outliers set to null: by zscore, iqr or modified z-score."""
    v = F.col(value)
    if method == "zscore":
        stats = df.groupBy(*keys).agg(F.avg(v).alias("_a"), F.stddev_pop(v).alias("_b"))
        bad = F.abs(v - F.col("_a")) > limit * F.col("_b")
    elif method == "iqr":
        stats = df.groupBy(*keys).agg(F.percentile(v, F.array(F.lit(0.25), F.lit(0.75))).alias("_q")).select(*keys, F.col("_q")[0].alias("_a"), F.col("_q")[1].alias("_b"))
        spread = F.col("_b") - F.col("_a")
        bad = (v < F.col("_a") - limit * spread) | (v > F.col("_b") + limit * spread)
    else:
        stats = df.groupBy(*keys).agg(F.median(v).alias("_a"))
        mad = df.join(stats, keys).groupBy(*keys).agg(F.median(F.abs(v - F.col("_a"))).alias("_b"))
        stats = stats.join(mad, keys)
        bad = F.abs(v - F.col("_a")) * 0.6745 > limit * F.col("_b")
    out = df.join(stats, keys, "left").withColumn("outlier", F.coalesce(bad, F.lit(False)))
    return out.withColumn(value, F.when(~F.col("outlier"), v)).drop("_a", "_b")


def drop_tick_outliers(ticks: DataFrame, keys: tuple[str, ...] = ("symbol", "date"), limit: float = 3.0) -> DataFrame:
    """Ticks without those on either side of a return farther than ``limit`` population deviations from the group's mean."""
    w, group = Window.partitionBy(*keys).orderBy("ts", "seq"), Window.partitionBy(*keys)
    r = ticks.withColumn("_r", F.log(F.col("price") / F.lag("price").over(w)))
    r = r.withColumn("_bad", F.coalesce(F.abs(F.col("_r") - F.avg("_r").over(group)) > limit * F.stddev_pop("_r").over(group), F.lit(False)))
    return r.withColumn("_next", F.coalesce(F.lead("_bad").over(w), F.lit(False))).where("not _bad and not _next").drop("_r", "_bad", "_next")


def scaling(df: DataFrame, keys: list[str], value: str, robust: bool = False) -> DataFrame:
    """(keys, center, scale): mean and deviation, or median and interquartile range; a scale of zero becomes one."""
    v = F.col(value)
    if robust:
        q = df.groupBy(*keys).agg(F.percentile(v, F.array(*(F.lit(p) for p in (0.25, 0.5, 0.75)))).alias("_q"))
        fit = q.select(*keys, F.col("_q")[1].alias("center"), (F.col("_q")[2] - F.col("_q")[0]).alias("scale"))
    else:
        fit = df.groupBy(*keys).agg(F.avg(v).alias("center"), F.stddev_samp(v).alias("scale"))
    return fit.withColumn("scale", F.when(F.coalesce("scale", F.lit(0.0)) == 0, 1.0).otherwise(F.col("scale")))


def standardize(df: DataFrame, keys: list[str], value: str, fitted: DataFrame, name: str = "z") -> DataFrame:
    """``value`` by a table of ``scaling``, from this sample or an earlier one."""
    return df.join(fitted, keys, "left").withColumn(name, (F.col(value) - F.col("center")) / F.col("scale")).drop("center", "scale")


def split_fraction(df: DataFrame, keys: list[str], order: list[str], share: float) -> DataFrame:
    """``train``: the first floor(n * share) rows of each series."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("train", F.row_number().over(ordered(keys, order)) <= F.floor(n * share))


def split_date(df: DataFrame, ts: str, date: str) -> DataFrame:
    """``train``: rows up to and including the date."""
    return df.withColumn("train", F.col(ts) <= F.lit(date).cast("timestamp"))
