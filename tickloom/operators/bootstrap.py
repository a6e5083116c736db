"""Block bootstraps over prefix sums.

A replicate of n rows is a few blocks, and a block's sums are the difference
of two prefix sums, so a replicate costs its blocks, not its rows. Blocks are
drawn by a portable generator: results do not depend on partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basic import uniform
from ..functions.special import norm_cdf, norm_ppf


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, i, s1, s2, n, level): sums of deviations from the series' mean ``level`` and of their squares over the first i rows, i from 0 to n.

    Sums of deviations stay as small as the series' spread, so differences of
    two of them don't cancel, however large the level.
    """
    whole = Window.partitionBy(*keys)
    w = whole.orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = F.col(value) - F.col("_level")
    rows = df.withColumn("_level", F.avg(value).over(whole)).select(*keys, F.row_number().over(w).alias("i"), F.sum(d).over(upto).alias("s1"), F.sum(d * d).over(upto).alias("s2"), F.count("*").over(whole).alias("n"), F.col("_level").alias("level"))
    zero = rows.where("i = 1").select(*keys, F.lit(0).alias("i"), F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"), "n", "level")
    return rows.union(zero)


def _moments(draws: DataFrame, p: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rep, mean, std) of draws (keys, n, rep, _from, _len) over circular prefix sums ``p``: two lookups a block."""
    total = p.where("i = n").select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("s1").alias("_t1"), F.col("s2").alias("_t2"), F.col("level").alias("_level"))
    end = F.col("_from") + F.col("_len")
    ends = F.array(F.struct(F.col("_from").alias("at"), F.lit(-1).alias("sign")), F.struct(F.pmod(end, F.col("n")).alias("at"), F.lit(1).alias("sign")))
    looks = draws.withColumn("_wrap", F.floor(end / F.col("n"))).withColumn("e", F.explode(ends))
    at = p.select(*keys, F.col("i").alias("_i"), "s1", "s2")
    hit = looks.join(at, [*[looks[k] == at[k] for k in keys], looks["e.at"] == at["_i"]])
    wrap = F.when(F.col("e.sign") == 1, F.col("_wrap")).otherwise(0)
    one, two, laps = F.sum(F.col("e.sign") * F.col("s1")), F.sum(F.col("e.sign") * F.col("s2")), F.sum(wrap)
    sums = hit.groupBy(*[looks[k] for k in keys], "rep", "n").agg(one.alias("_a"), two.alias("_b"), laps.alias("_laps"))
    sums = sums.join(total, [F.col(k) == F.col(f"_k_{k}") for k in keys]) if keys else sums.join(F.broadcast(total))
    mean, square = (F.col("_a") + F.col("_laps") * F.col("_t1")) / F.col("n"), (F.col("_b") + F.col("_laps") * F.col("_t2")) / F.col("n")
    return sums.select(*keys, "rep", (F.col("_level") + mean).alias("mean"), F.sqrt(F.greatest(square - mean**2, F.lit(0.0))).alias("std"))


def block_draws(sizes: DataFrame, replicates: int, block: int, seed: int = 1, replace: bool = True) -> DataFrame:
    """(.., rep, b, _from, _len): fixed-length blocks for tables of series sizes (.., n), the last one cut to fit.

    Without replacement, blocks start at multiples of ``block`` in a random
    order, so each row comes once.
    """
    draws = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)))
    u = uniform(seed, F.col("rep"), F.col("b"))
    if replace:
        return draws.withColumns({"_from": F.floor(u * F.col("n")), "_len": F.least(F.lit(block), F.col("n") - F.col("b") * block)})
    return draws.withColumns({"_from": F.col("b").cast("long") * block, "_len": F.least(F.lit(block), F.col("n") - F.col("b") * block), "_u": u})


def stationary_draws(sizes: DataFrame, replicates: int, p: float, seed: int = 1) -> DataFrame:
    """(.., rep, b, _from, _len): blocks of geometric length, mean 1 / p, on a circle, cut where a replicate has n rows.

    Lengths come from one portable number and starts from another. As many
    blocks are drawn as a replicate needs but for odds below 1e-9, in which its
    last block runs on to the end.
    """
    mean = F.col("n") * p
    most = F.ceil(mean + 7 * F.sqrt(mean) + 10).cast("int")
    draws = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("b", F.explode(F.sequence(F.lit(0), most - 1))).withColumn("_most", most)
    u, v = uniform(seed + 1, F.col("rep"), F.col("b")), uniform(seed, F.col("rep"), F.col("b"))
    length = F.lit(1) if p >= 1 else 1 + F.floor(F.log(1 - u) / math.log(1 - p))
    draws = draws.withColumns({"_l": length.cast("long"), "_from": F.floor(v * F.col("n"))})
    own = [c for c in sizes.columns if c != "n"]
    before = F.coalesce(F.sum("_l").over(Window.partitionBy(*own, "rep").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.col("n") - F.col("_at")
    draws = draws.withColumn("_at", before).where(F.col("_at") < F.col("n"))
    return draws.withColumn("_len", F.when(F.col("b") == F.col("_most") - 1, left).otherwise(F.least("_l", left))).drop("_l", "_at", "_most")


def circular_blocks(df: DataFrame, keys: list[str], order: list[str], value: str, replicates: int, block: int, seed: int = 1) -> DataFrame:
    """(keys, rep, mean, std): moments of circular block resamples of each series' own length."""
    p = prefix_sums(df, keys, order, value)
    return _moments(block_draws(p.where("i = n").select(*keys, "n"), replicates, block, seed), p, keys)


def stationary_blocks(df: DataFrame, keys: list[str], order: list[str], value: str, replicates: int, p: float, seed: int = 1) -> DataFrame:
    """(keys, rep, mean, std): moments of stationary-bootstrap resamples; series of equal length share their draws."""
    sums = prefix_sums(df, keys, order, value)
    return _moments(stationary_draws(sums.where("i = n").select(*keys, "n"), replicates, p, seed), sums, keys)


def resampled(df: DataFrame, keys: list[str], order: list[str], value: str, draws: DataFrame) -> DataFrame:
    """(keys, rep, pos, value): the rows of every replicate in order, for statistics that prefix sums can't give."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.select(*keys, (F.row_number().over(w) - 1).alias("_i"), F.col(value).alias("value"))
    spans = draws.where("_len > 0").withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_len").cast("int") - 1))).withColumn("_i", F.pmod(F.col("_from") + F.col("_j"), F.col("n")).cast("int"))
    first = "_u" if "_u" in draws.columns else "b"
    joined = spans.join(rows, [*keys, "_i"])
    pos = F.row_number().over(Window.partitionBy(*keys, "rep").orderBy(first, "b", "_j")) - 1
    return joined.select(*keys, "rep", pos.alias("pos"), "value")


def statistic(samples: DataFrame, keys: list[str], func) -> DataFrame:
    """(keys, rep, stat): ``func`` (array of a replicate's values in order) to a number; a replicate is one task's group."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.select(*keys, "rep").schema)

    def one(key, pdf):
        return pd.DataFrame([[*key, float(func(pdf.sort_values("pos")["value"].to_numpy()))]], columns=[*keys, "rep", "stat"])

    return samples.groupBy(*keys, "rep").applyInPandas(one, f"{kinds}, stat double")


def quantile_statistics(samples: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """(keys, rep, quantile, skew, kurtosis, sharpe) of replicates, by Spark's own aggregates."""
    v = F.col("value")
    return samples.groupBy(*keys, "rep").agg(F.percentile(v, F.lit(share)).alias("quantile"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"), (F.avg(v) / F.nullif(F.stddev_pop(v), F.lit(0.0))).alias("sharpe"))


def interval(boot: DataFrame, keys: list[str], stat: str, level: float = 0.95) -> DataFrame:
    """(keys, se, mean, median, lo, hi) of replicates."""
    s, tail = F.col(stat), (1 - level) / 2
    q = F.percentile(s, F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail)))
    out = boot.groupBy(*keys).agg(F.stddev_samp(s).alias("se"), F.avg(s).alias("mean"), q.alias("_q"))
    return out.select(*keys, "se", "mean", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("lo"), F.col("_q")[2].alias("hi"))


def bias_corrected(boot: DataFrame, original: DataFrame, keys: list[str], stat: str, level: float = 0.95) -> DataFrame:
    """(keys, lo, hi): percentile bounds moved by the share of replicates below the original statistic; no acceleration."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boot.select(*keys).schema)
    o = original.select(*keys, F.col(stat).alias("_o"))
    joined = boot.join(o, keys) if keys else boot.join(F.broadcast(o))
    tail = (1 - level) / 2
    share = joined.groupBy(*keys).agg(F.avg((F.col(stat) < F.col("_o")).cast("double")).alias("_p"), F.array_sort(F.collect_list(stat)).alias("_v"))

    def run(frames):
        for pdf in frames:
            z = norm_ppf(np.clip(pdf["_p"].to_numpy(float), 1e-6, 1 - 1e-6))
            out = pdf[keys].copy()
            for name, q in (("lo", tail), ("hi", 1 - tail)):
                at = norm_cdf(2 * z + norm_ppf([q])[0])
                out[name] = [float(np.quantile(v, a)) for v, a in zip(pdf["_v"], at)]
            yield out

    return share.mapInPandas(run, (kinds + ", " if keys else "") + "lo double, hi double")


def p_value(boot: DataFrame, original: DataFrame, keys: list[str], stat: str, null: float = 0.0, side: str = "two") -> DataFrame:
    """(keys, p): two: replicates at least as far from the original statistic as that is from ``null``; less or greater: on that side of the original."""
    o = original.select(*keys, F.col(stat).alias("_o"))
    s = F.col(stat)
    hit = {"two": F.abs(s - F.col("_o")) >= F.abs(F.col("_o") - null), "less": s <= F.col("_o"), "greater": s >= F.col("_o")}[side]
    return boot.join(o, keys).groupBy(*keys).agg(F.avg(hit.cast("double")).alias("p"))


def reality_check(losses: DataFrame, benchmark: str, replicates: int, p: float, seed: int = 1, model: str = "model", t: str = "t", loss: str = "loss") -> DataFrame:
    """(statistic, p_value, models): whether the best model's gain over the benchmark is more than luck.

    losses: (model, t, loss) at the same times for all. All models share the
    draws of a replicate; gains meet the benchmark's losses in one join.
    """
    b = losses.where(F.col(model) == benchmark).select(t, F.col(loss).alias("_b"))
    gains = losses.where(F.col(model) != benchmark).join(b, t).select(model, t, (F.col("_b") - F.col(loss)).alias("gain"))
    boot = stationary_blocks(gains, [model], [t], "gain", replicates, p, seed)
    mean = gains.groupBy(model).agg(F.avg("gain").alias("_m"), F.count("*").alias("_n"))
    top = mean.agg(F.max(F.sqrt("_n") * F.col("_m")).alias("statistic"), F.count("*").alias("models"))
    best = boot.join(mean, model).groupBy("rep").agg(F.max(F.sqrt("_n") * (F.col("mean") - F.col("_m"))).alias("_v"))
    return best.join(F.broadcast(top)).groupBy("statistic", "models").agg(F.avg((F.col("_v") >= F.col("statistic")).cast("double")).alias("p_value"))


def confidence_set(losses: DataFrame, replicates: int, p: float, size: float = 0.1, kind: str = "TR", seed: int = 1, model: str = "model", t: str = "t", loss: str = "loss") -> DataFrame:
    """(model, step, statistic, p_value, inside): models dropped one by one, the worst first, while equal loss is rejected.

    kind: TR, the largest difference of two means, or TSQ, their sum of squares
    (differences are not studentised). The worst model of those left is the one
    with the largest mean (the first by name among equals), so the order is
    known beforehand; the largest difference is the span of means, and the sum
    of squares follows from their sum and sum of squares. All steps of a
    replicate are then running spans or sums over its models, a window of as
    many rows as models, and no pair of models is formed.
    """
    mean = losses.groupBy(model).agg(F.avg(loss).alias("_m"), F.count("*").alias("_n"))
    mean = mean.withColumn("_m", F.col("_m") - F.avg("_m").over(Window.partitionBy()))
    ranks = mean.withColumn("step", F.row_number().over(Window.orderBy(F.desc("_m"), model)) - 1)  # a row a model
    boot = stationary_blocks(losses.join(ranks.select(model, "step"), model), [model, "step"], [t], loss, replicates, p, seed)
    level = losses.groupBy(model).agg(F.avg(loss).alias("_l"), F.count("*").alias("_n"))
    drawn = boot.join(level, model).withColumn("_x", F.sqrt("_n") * (F.col("mean") - F.col("_l")))

    def spread(*rep: str) -> Column:
        left = Window.partitionBy(*rep).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
        x = F.col("_x")
        if kind == "TR":
            return F.max(x).over(left) - F.min(x).over(left)
        return F.count("*").over(left) * F.sum(x * x).over(left) - F.pow(F.sum(x).over(left), F.lit(2))

    stat = ranks.withColumn("_x", F.sqrt("_n") * F.col("_m")).withColumn("statistic", spread()).select(F.col(model), F.col("step").alias("_step"), "statistic")
    draws = drawn.withColumn("_draw", spread("rep")).select("step", "_draw")
    share = draws.join(stat, F.col("step") == F.col("_step")).groupBy(model, "step", "statistic").agg(F.avg((F.col("_draw") >= F.col("statistic")).cast("double")).alias("_p"))
    top = F.max("_p").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return share.withColumn("p_value", top).select(model, "step", "statistic", "p_value", (F.col("p_value") >= size).alias("inside"))
