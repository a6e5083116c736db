"""Sharding along a Hilbert curve over several metadata dimensions.

Every dimension is quantised to ``bits`` bits, a row's cell is its point on
the Hilbert curve through that grid, and the rows in curve order are cut into
runs. Neighbours on the curve are close in every dimension, so each run covers
a small box and a reader that filters on any of the dimensions skips most
files. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._stage import partitions, staged


def quantise_text(c: Column, bits: int) -> Column:
    """Equal values meet in one of 2**bits buckets; null is bucket 0."""
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(1 << bits)), F.lit(0)).cast("int")


def quantise_size(c: Column, bits: int, steps: int = 2) -> Column:
    """``steps`` buckets for each doubling; null or less than 1 is bucket 0."""
    log = F.floor(F.log2(F.greatest(c.cast("double"), F.lit(1.0))) * steps)
    return F.least(F.coalesce(log, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def hilbert_index(df: DataFrame, axes: list[str], bits: int, name: str) -> DataFrame:
    """``df`` with the curve position, as column ``name``, of integer columns ``axes`` below 2**bits.

    The walk over bit planes undoes, from the top plane down, the reflections
    and swaps of axes that the curve makes in each sub-cube, then Gray-decodes
    and interleaves the planes.
    """
    dims = len(axes)
    planes = F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)) if bits > 1 else F.array().cast("array<int>")
    steps = F.flatten(F.transform(planes, lambda q: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.struct(q.alias("q"), i.alias("i")))))

    def bit(q: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), q)

    def undo(x: Column, s: Column) -> Column:
        low, here, first = bit(s["q"]) - 1, F.element_at(x, s["i"] + 1), F.element_at(x, 1)
        is_set = here.bitwiseAND(bit(s["q"])) != 0
        swap = first.bitwiseXOR(here).bitwiseAND(low)
        return F.transform(x, lambda v, j: F.when(j == 0, F.when(is_set, v.bitwiseXOR(low)).otherwise(v.bitwiseXOR(swap))).when((j == s["i"]) & ~is_set, v.bitwiseXOR(swap)).otherwise(v))

    df = df.withColumn("_x", F.aggregate(steps, F.array(*axes), undo))
    gray = [F.element_at("_x", 1)]
    for k in range(2, dims + 1):
        gray.append(gray[-1].bitwiseXOR(F.element_at("_x", k)))
    df = df.withColumn("_gray", F.array(*gray))
    last = F.element_at("_gray", dims)
    df = df.withColumn("_turn", F.aggregate(planes, F.lit(0), lambda t, q: F.when(last.bitwiseAND(bit(q)) != 0, t.bitwiseXOR(bit(q) - 1)).otherwise(t)))
    index = F.lit(0).cast("long")
    for q in range(bits - 1, -1, -1):
        for k in range(1, dims + 1):
            plane = F.element_at("_gray", k).bitwiseXOR(F.col("_turn"))
            index = index * 2 + F.call_function("shiftright", plane, F.lit(q)).bitwiseAND(F.lit(1))
    return df.withColumn(name, index).drop("_x", "_gray", "_turn")


def hilbert_order(df: DataFrame, dims: dict[str, Column], bits: int, tie: list[Column], run: int = 4096) -> DataFrame:
    """``df`` with ``cell`` (curve index) and ``position`` (gapless from 0, in curve order).

    dims: name to a quantised column (0 to 2**bits - 1; see quantise_*).
    Rows of a cell are dealt over sub-runs of about ``run`` rows by a hash of
    ``tie``, so a cell that holds a third of all rows is many small windows.
    The table of cells has at most 2**(bits * dims) rows, which bounds what is
    broadcast and what the one window over all cells sees; counts are
    pre-aggregated. Equal rows get adjacent positions in any order. An empty
    table gives none. ``df`` is read three times: pass a staged, slim one.
    """
    names = [f"_q{i}" for i in range(len(dims))]
    df = df.withColumns(dict(zip(names, dims.values(), strict=True)))
    cells = df.groupBy(*names).agg(F.count("*").alias("_n"))
    cells = hilbert_index(cells, names, bits, "cell")
    cells = cells.withColumn("_base", F.sum("_n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)))
    cells = cells.select(*names, "cell", F.coalesce("_base", F.lit(0)).alias("_base"), F.ceil(F.col("_n") / run).alias("_runs"))
    dealt = df.join(F.broadcast(cells), names).withColumn("_sub", F.pmod(F.xxhash64(*tie), F.col("_runs")))
    subs = dealt.groupBy("cell", "_sub").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("cell").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    subs = subs.select("cell", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_sub_base"))
    within = Window.partitionBy("cell", "_sub").orderBy(*tie)
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1)
    return ranked.join(subs, ["cell", "_sub"]).withColumn("position", F.col("_base") + F.col("_sub_base") + F.col("_rank")).drop(*names, "_base", "_runs", "_sub", "_sub_base", "_rank")


def cut_rows(df: DataFrame, shards: int) -> DataFrame:
    """Adds ``shard`` and ``slot``: runs of ``position`` whose counts differ by one at most."""
    total = df.agg(F.count("*").alias("_n"))
    small, more = F.floor(F.col("_n") / shards), F.col("_n") % shards
    edge = more * (small + 1)
    p = F.col("position")
    shard = F.when(p < edge, F.floor(p / (small + 1))).otherwise(more + F.floor((p - edge) / F.greatest(small, F.lit(1))))
    slot = F.when(p < edge, p % (small + 1)).otherwise((p - edge) % F.greatest(small, F.lit(1)))
    return df.join(F.broadcast(total)).withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")}).drop("_n")


def shard_documents(docs: DataFrame, shards: int = 8, bits: int = 5) -> DataFrame:
    """(doc_id, size, text_crc32, cell, position, shard, slot) for every document.

    Dimensions: source, language and text size, null in any of them being
    bucket 0. Size is the text's UTF-8 bytes plus 1; a null text has size 1 and
    the checksum of an empty one. Other columns of ``docs`` are ignored, so
    they can't clash. Repeated rows each get a slot. An empty table gives none.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), quantise_text(F.col("source"), bits).alias("_source"), quantise_text(F.col("lang"), bits).alias("_lang"))
    slim = staged(slim, "slim")
    dims = {"source": F.col("_source"), "size": quantise_size(F.col("size"), bits), "lang": F.col("_lang")}
    placed = hilbert_order(slim, dims, bits, [F.col("text_crc32"), F.col("doc_id")])
    return cut_rows(placed, shards).drop("_source", "_lang")


def write_shards(df: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``df`` (unique ids) as one folder a shard, rows in curve order, for pruning by file statistics.

    A shard is many files, each a run of slots, so no task holds a whole shard.
    """
    placed = placed.select(F.col(id_col).alias("_id"), "shard", "slot")
    out = df.join(placed, df[id_col] == F.col("_id")).drop("_id")
    out.repartitionByRange(partitions(df.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
