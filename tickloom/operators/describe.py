"""Summaries, correlation, autocorrelation, ranks and densities."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basic import bucket
from .regress import by_group, few_groups


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, median, std, min, max, range, skew, excess kurtosis, n of each group (central moments over powers of the sample deviation)."""
    x = F.col(value)
    mean = df.groupBy(*keys).agg(F.avg(x).alias("mean"))
    c = x - F.col("mean")
    out = df.join(mean, keys).groupBy(*keys).agg(F.first("mean").alias("mean"), F.median(x).alias("median"), F.sqrt(F.sum(c**2) / (F.count(x) - 1)).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n"), F.avg(c**3).alias("_m3"), F.avg(c**4).alias("_m4"))
    return out.select(*keys, "mean", "median", "std", "min", "max", (F.col("max") - F.col("min")).alias("range"), (F.col("_m3") / F.col("std") ** 3).alias("skew"), (F.col("_m4") / F.col("std") ** 4 - 3).alias("kurtosis"), "n")


def robust_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median, q1, q3, iqr, mad)."""
    few = few_groups(df, keys)
    q = quantiles(df, keys, value, [0.25, 0.5, 0.75], few).select(*keys, F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q1"), F.col("_q")[2].alias("q3"))
    off = by_group(df, q.select(*keys, F.col("median").alias("_m")), keys, few).select(*keys, F.abs(F.col(value) - F.col("_m")).alias("_off"))
    mad = quantiles(off, keys, "_off", [0.5], few).select(*keys, F.col("_q")[0].alias("mad"))
    if keys:  # a group without values has nulls
        both = df.select(*keys).dropna(subset=keys).distinct().join(q, keys, "left").join(mad, keys, "left")
    else:
        both = q.join(F.broadcast(mad))
    return both.withColumn("iqr", F.col("q3") - F.col("q1"))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], few: bool, buckets: int = 32) -> DataFrame:
    """(keys, _q array): exact quantiles, linear between ranks, as ``percentile`` has them, of groups of any size.

    Values are cut at approximate quantiles and counted by bucket; only the
    buckets that hold an asked rank are counted value by value, so a task
    meets the distinct values of one bucket. ``few``: see ``few_groups``.
    """
    x = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    cuts = x.groupBy(*keys).agg(F.percentile_approx("_v", [k / buckets for k in range(1, buckets)]).alias("_cuts"))
    placed = by_group(x, cuts, keys, few).withColumn("_b", F.array_size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    own = Window.partitionBy(*keys)
    counts = placed.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(own.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"_base": before, "_n": F.sum("_c").over(own)})  # a row a group and bucket
    ends = [(f((F.col("_n") - 1) * p)) for p in shares for f in (F.floor, F.ceil)]
    inside = lambda r, lo, hi: (r >= lo) & (r < hi)
    asked = counts.where(reduce(lambda a, b: a | b, [inside(r, F.col("_base"), F.col("_base") + F.col("_c")) for r in ends])).drop("_c")
    values = by_group(placed, asked, [*keys, "_b"], few).groupBy(*keys, "_b", "_base", "_n", "_v").agg(F.count("*").alias("_k"))
    values = values.withColumn("_upto", F.col("_base") + F.sum("_k").over(Window.partitionBy(*keys, "_b").orderBy("_v")))
    found = [F.max(F.when(inside(r, F.col("_upto") - F.col("_k"), F.col("_upto")), F.col("_v"))).alias(f"_e{k}") for k, r in enumerate(ends)]
    out = values.groupBy(*keys).agg(F.max("_n").alias("_n"), *found)

    def between(k: int, p: float):
        at, low, high = (F.col("_n") - 1) * p, F.col(f"_e{2 * k}"), F.col(f"_e{2 * k + 1}")
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return out.select(*keys, F.array(*[between(k, p) for k, p in enumerate(shares)]).alias("_q"))


def covariance(df: DataFrame, columns: list[str], bias: bool = False) -> DataFrame:
    """(i, j, cov, corr) of all pairs i <= j of columns, in two passes: means, then centred products; corr is 0 for a constant."""
    means = df.agg(*[F.avg(c).alias(f"_m{k}") for k, c in enumerate(columns)])
    z = df.join(F.broadcast(means))
    at = lambda k: F.col(columns[k]) - F.col(f"_m{k}")
    cells = list(combinations_with_replacement(range(len(columns)), 2))
    one = z.agg(F.count("*").alias("_n"), *[F.sum(at(a) * at(b)).alias(f"_{a}_{b}") for a, b in cells])
    n = F.col("_n") if bias else F.col("_n") - 1
    scale = lambda a, b: F.sqrt(F.col(f"_{a}_{a}") * F.col(f"_{b}_{b}"))
    rows = [F.struct(F.lit(columns[a]).alias("i"), F.lit(columns[b]).alias("j"), (F.col(f"_{a}_{b}") / n).alias("cov"), F.when(scale(a, b) == 0, 0.0).otherwise(F.col(f"_{a}_{b}") / scale(a, b)).alias("corr")) for a, b in cells]
    return one.select(F.inline(F.array(*rows)))


def _cuts(df: DataFrame, columns: list[str], buckets: int) -> list[list]:
    """Cuts of each column at ``buckets`` quantiles, for all columns in one job."""
    shares = [k / buckets for k in range(1, buckets)]
    found = df.agg(*[F.percentile_approx(c, shares) for c in columns]).first()
    return [sorted(set(c or [])) for c in found]


def _numbered(counts: DataFrame, cuts: list, number: Column) -> DataFrame:
    """Distinct values (_v, _c) with ``_base``, the weight before their bucket, and ``_upto``, that of their bucket up to them; ``number`` is a value's weight."""
    run = counts.withColumn("_run", bucket(F.col("_v"), cuts))
    totals = run.groupBy("_run").agg(F.sum(number).alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = totals.select("_run", before.alias("_base"))  # one row a bucket
    upto = F.sum(number).over(Window.partitionBy("_run").orderBy("_v"))
    return run.withColumn("_upto", upto).join(F.broadcast(base), "_run")


def _rank_table(df: DataFrame, column: str, name: str, weight: str | None, cuts: list) -> DataFrame:
    """(_v, name): the average rank of every distinct value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.sum(F.col(weight) if weight else F.lit(1)).alias("_c"))
    return _numbered(counts, cuts, F.col("_c")).select("_v", (F.col("_base") + F.col("_upto") - (F.col("_c") - 1) / 2).alias(name))


def average_ranks(df: DataFrame, column: str, name: str, weight: str | None = None, buckets: int = 256) -> DataFrame:
    """``name``: average rank of ``column`` over the whole table, rows counting ``weight`` times; null for null.

    Distinct values are counted first and cut at ``buckets`` quantiles, which
    are literals of the plan: a value's rank is the running count within its
    bucket plus the counts of buckets before it, so no window holds the table
    and nothing depends on how rows are dealt out. A window task holds the
    distinct values of one bucket, so let ``buckets`` grow with their number.
    """
    cuts = _cuts(df.where(F.col(column).isNotNull()), [column], buckets)[0]
    ranked = _rank_table(df, column, name, weight, cuts)
    return df.join(ranked, df[column] == ranked["_v"], "left").drop("_v")


def spearman(df: DataFrame, x: str, y: str, buckets: int = 256) -> DataFrame:
    """(spearman, n): correlation of average ranks, over the distinct pairs of values and their counts.

    One job finds the cuts of both columns; all sums of the ranks are taken in
    one aggregate, as ranks are of one size and don't cancel.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    cuts = _cuts(both, ["_x", "_y"], buckets)
    pairs = both.groupBy("_x", "_y").agg(F.count("*").alias("_w"))
    r = pairs
    for c, name, cut in (("_x", "_rx", cuts[0]), ("_y", "_ry", cuts[1])):
        ranked = _rank_table(pairs, c, name, "_w", cut).withColumnRenamed("_v", f"{name}v")
        r = r.join(ranked, F.col(c) == F.col(f"{name}v")).drop(f"{name}v")
    w, a, b = (F.col(c).cast("double") for c in ("_w", "_rx", "_ry"))
    s = r.agg(F.sum("_w").alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.sum(w * a * b).alias("ab"))
    n = F.col("n")
    over = lambda p, q, both: F.col(both) - F.col(p) * F.col(q) / n
    return s.select((over("a", "b", "ab") / F.nullif(F.sqrt(over("a", "a", "aa") * over("b", "b", "bb")), F.lit(0.0))).alias("spearman"), "n")


def kendall(df: DataFrame, x: str, y: str, buckets: int = 64) -> DataFrame:
    """(kendall, n): concordant less discordant pairs over all pairs, ties counting for neither.

    Rows are reduced to distinct pairs with counts and x to its order number.
    Two numbers differ first in one octal digit: rows that share the digits
    above it are a group, and going up in y, a row meets running counts by
    digit of the rows below it. So every row is met once for each digit, n log n
    in all, in windows over one bucket of y of one group; what lies in lower
    buckets is added from their totals. Rows of one y are summed up beforehand,
    so neither ties nor skew of x or y swell a window.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    cuts = _cuts(both, ["_x", "_y"], buckets)
    pairs = both.groupBy("_x", "_y").agg(F.count("*").alias("w"))
    numbers = _numbered(pairs.groupBy(F.col("_x").alias("_v")).agg(F.lit(1).alias("_c")), cuts[0], F.lit(1)).select("_v", (F.col("_base") + F.col("_upto") - 1).alias("_at"))
    most = numbers.agg(F.max("_at").alias("_most"))  # one row
    digits = F.sequence(F.lit(0), F.floor(F.log(8.0, F.greatest(F.col("_most"), F.lit(1)).cast("double")) + 1e-9).cast("int"))
    rows = pairs.join(numbers, pairs["_x"] == numbers["_v"]).join(F.broadcast(most)).select("_y", "w", "_at", F.explode(digits).alias("level"))
    low = F.expr("shiftright(_at, 3 * level)")
    rows = rows.select("_y", "w", "level", F.shiftright(low, 3).alias("g"), low.bitwiseAND(F.lit(7)).alias("d"))
    of = [F.sum(F.when(F.col("d") == k, F.col("w")).otherwise(0)).cast("double").alias(f"w{k}") for k in range(8)]
    summed = rows.groupBy("level", "g", "_y").agg(*of).withColumn("j", bucket(F.col("_y"), cuts[1]))

    def signed(rows: DataFrame, group: list[str], order: str) -> DataFrame:
        """Sums of a row's weights times what lies below it with lower digits, less that with higher ones."""
        w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        met = rows.withColumns({f"r{k}": F.coalesce(F.sum(f"w{k}").over(w), F.lit(0.0)) for k in range(8)})
        lower = lambda k: sum((F.col(f"r{m}") for m in range(k)), F.lit(0.0)) - sum((F.col(f"r{m}") for m in range(k + 1, 8)), F.lit(0.0))
        return met.select(sum((F.col(f"w{k}") * lower(k) for k in range(8)), F.lit(0.0)).alias("s"))

    totals = summed.groupBy("level", "g", "j").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(8)])
    parts = signed(summed, ["level", "g", "j"], "_y").union(signed(totals, ["level", "g"], "j"))
    n = F.col("n")
    return parts.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s")).join(F.broadcast(pairs.agg(F.sum("w").alias("n")))).select((F.col("s") / (n * (n - 1) / 2)).alias("kendall"), "n")


def to_correlation(cov: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A long covariance table (keys, i, j, value), diagonal included, as correlations and ``std_i``, ``std_j``; 0 where a variance is 0."""
    keys = keys or []
    side = lambda c: cov.where("i = j").select(*keys, F.col("i").alias(c), F.sqrt("value").alias(f"std_{c}"))
    both = cov.join(side("i"), [*keys, "i"]).join(side("j"), [*keys, "j"])
    scale = F.col("std_i") * F.col("std_j")
    return both.select(*keys, "i", "j", F.when(scale == 0, 0.0).otherwise(F.col("value") / scale).alias("value"), "std_i", "std_j")


def to_covariance(corr: DataFrame, stds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A long correlation table (keys, i, j, value) scaled by a table (keys, i, std)."""
    keys = keys or []
    side = lambda c: stds.select(*keys, F.col("i").alias(c), F.col("std").alias(f"_{c}"))
    return corr.join(side("i"), [*keys, "i"]).join(side("j"), [*keys, "j"]).select(*keys, "i", "j", (F.col("value") * F.col("_i") * F.col("_j")).alias("value"))


def acf(df: DataFrame, keys: list[str], order: list[str], value: str, lags: int) -> DataFrame:
    """(keys, lag, acf, band): autocorrelations and 1.96 / sqrt(n)."""
    w = Window.partitionBy(*keys)
    c = df.withColumn("_c", F.col(value) - F.avg(value).over(w))
    c = c.withColumns({f"_l{k}": F.lag("_c", k).over(w.orderBy(*order)) for k in range(1, lags + 1)})
    one = c.groupBy(*keys).agg(F.count("_c").alias("_n"), F.sum(F.col("_c") ** 2).alias("_s"), *[F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_a{k}") for k in range(1, lags + 1)])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"_a{k}") / F.nullif(F.col("_s"), F.lit(0.0))).alias("acf"), (1.96 / F.sqrt("_n")).alias("band")) for k in range(1, lags + 1)])
    return one.select(*keys, "_n", F.inline(rows)).withColumnRenamed("_n", "n")


def pacf(df: DataFrame, keys: list[str], order: list[str], value: str, lags: int) -> DataFrame:
    """(keys, lag, pacf) by the Durbin-Levinson recursion on the array of autocorrelations."""
    a = acf(df, keys, order, value, lags).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"]).alias("r"))

    def step(s, k):
        phi = s["phi"]
        top = F.element_at("r", k) - F.aggregate(F.zip_with(phi, F.reverse(F.slice("r", 1, k - 1)), lambda p, q: p * q), F.lit(0.0), lambda x, v: x + v)
        low = 1.0 - F.aggregate(F.zip_with(phi, F.slice("r", 1, k - 1), lambda p, q: p * q), F.lit(0.0), lambda x, v: x + v)
        new = top / low
        moved = F.zip_with(phi, F.reverse(phi), lambda p, q: p - new * q)
        return F.struct(F.concat(moved, F.array(new)).alias("phi"), F.concat(s["out"], F.array(new)).alias("out"))

    empty = F.array().cast("array<double>")
    done = F.aggregate(F.sequence(F.lit(1), F.lit(lags)), F.struct(empty.alias("phi"), empty.alias("out")), step, lambda s: s["out"])
    return a.select(*keys, F.posexplode(done).alias("_k", "pacf")).select(*keys, (F.col("_k") + 1).alias("lag"), "pacf")


def risk(df: DataFrame, keys: list[str], ret: str = "ret", share: float = 0.05) -> DataFrame:
    """(keys, mean, std, sharpe, var): mean over population deviation, and historical value at risk."""
    r = F.col(ret)
    return df.groupBy(*keys).agg(F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), (F.avg(r) / F.nullif(F.stddev_pop(r), F.lit(0.0))).alias("sharpe"), (-F.percentile(r, F.lit(share))).alias("var"))


def density(df: DataFrame, value: str, points: int = 50, bins: int = 2000) -> DataFrame:
    """(x, density): a Gaussian kernel estimate at equally spaced points, over bin counts, so that work after one pass is points x bins."""
    s = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    counts = df.join(F.broadcast(s)).groupBy(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)).alias("b"), "lo", "hi", "sd", "n").agg(F.count("*").alias("c"))
    h = F.col("sd") * F.pow("n", F.lit(-0.2))
    grid = counts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / (points - 1))
    u = (F.col("x") - (F.col("lo") + (F.col("b") + 0.5) * width)) / h
    return grid.groupBy("k", "x").agg(F.sum(F.col("c") * F.exp(-0.5 * u * u) / (F.col("n") * h * 2.5066282746310002)).alias("density")).drop("k")


def best_model(scores: DataFrame, keys: list[str], model: str, criterion: str) -> DataFrame:
    """(keys, model, criterion): the model of the least criterion in each group, the first by name among equals; nulls never win."""
    ok = scores.where(F.col(criterion).isNotNull() & ~F.isnan(criterion))
    return ok.groupBy(*keys).agg(F.min(F.struct(F.col(criterion).alias("c"), F.col(model).alias("m"))).alias("_s")).select(*keys, F.col("_s.m").alias(model), F.col("_s.c").alias(criterion))
