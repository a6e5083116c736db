"""Connected components by alternating large-star and small-star steps.

Edges stay in DataFrames. A node with a third of all edges is a skewed join
key on rows of two longs, which adaptive execution splits; minima are
aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import staged


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the smallest node it reaches.

    Nulls and loops are dropped; repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.col("a").isNull().alias("x"), F.col("b").isNull().alias("y"))
    e = staged(e.where("not x and not y and a > b").select("a", "b").distinct(), "edges")
    seen = None
    for _ in range(most):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s"))
        e = staged(small.select("s.a", "s.b").where("a > b").distinct(), "star")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select("b").distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
