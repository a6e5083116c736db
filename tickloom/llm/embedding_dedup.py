"""Near-duplicate embeddings by an inverted multi-index.

Two independent codebooks, one for each half of the unit vectors, form a
product grid of cells. A vector visits cells in order of a lower bound on its
distance to anything in them, by multi-sequence traversal of the two sorted
lists of half bounds, until the target recall is met. A pair is found when
either of its vectors visits the other's cell, so each need only look about
half as far. What the cells give is verified in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._groups import blocks, edges
from ._stage import partitions, staged


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """k-means centres of the rows of x; k is lowered to the number of distinct rows."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = (((c**2).sum(1) - 2 * x @ c.T)).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where((n > 0)[:, None], total / np.maximum(n, 1)[:, None], c)
    return c


def half_bounds(x: np.ndarray, c: np.ndarray, against: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, squared lower bounds to each centre's region) of every row.

    A point of region i is no farther from c[i] than from any c[k], so it lies
    beyond the plane halfway between them; the distance to the farthest such
    plane over the ``against`` nearest centres bounds the distance to the region.
    """
    d = np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T, 0)
    gap = np.sqrt(np.maximum((c**2).sum(1)[:, None] + (c**2).sum(1) - 2 * c @ c.T, 0))
    near = np.argpartition(d, min(against, len(c)) - 1, axis=1)[:, :against]
    bound = np.zeros_like(d)
    for k in near.T:
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d - np.take_along_axis(d, k[:, None], 1)) / (2 * gap[k])
        bound = np.fmax(bound, np.where(gap[k] > 1e-9, plane, 0))
    return d.argmin(1), np.maximum(bound - 1e-9, 0) ** 2


def multi_sequence(a: np.ndarray, b: np.ndarray, limit: float) -> Iterator[tuple[int, int, float]]:
    """Cells (i, j) of the product grid by growing a[i] + b[j], up to ``limit``."""
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    la, lb = a[oa].tolist(), b[ob].tolist()
    heap = [(la[0] + lb[0], 0, 0)]
    while heap:
        s, p, q = heapq.heappop(heap)
        if s > limit:
            return
        yield int(oa[p]), int(ob[q]), s
        if q + 1 < len(lb):
            heapq.heappush(heap, (la[p] + lb[q + 1], p, q + 1))
        if q == 0 and p + 1 < len(la):
            heapq.heappush(heap, (la[p + 1] + lb[0], p + 1, 0))


def _units(column: pa.Array, dim: int) -> np.ndarray:
    flatv = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    x = flatv.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, initial=0)[:, None]  # squares of large or small numbers stay in range
    return x / np.sqrt((x**2).sum(1))[:, None]


def reach(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], least: float, recall: float, seed: int = 5, each: int = 4) -> float:
    """The bound up to which cells are visited, so that a pair is found with probability ``recall``.

    Judged on neighbours at exactly the cosine ``least``, the hardest to find,
    in random directions from the unit vectors ``x``. A recall of 1 gives the
    distance itself, which no bound of a neighbour's cell passes.
    """
    if recall >= 1:
        return 2 - 2 * least + 1e-9
    rng, at, seen = np.random.default_rng(seed), x.shape[1] // 2, []
    for lo in range(0, len(x), 2048):
        u = np.repeat(x[lo : lo + 2048], each, axis=0)
        z = rng.normal(size=u.shape)
        z -= (z * u).sum(1)[:, None] * u
        y = least * u + np.sqrt(1 - least**2) * z / np.sqrt((z**2).sum(1))[:, None]
        there, back, row = np.zeros(len(u)), np.zeros(len(u)), np.arange(len(u))
        for part, c in ((slice(None, at), books[0]), (slice(at, None), books[1])):
            (hu, bu), (hy, by) = half_bounds(u[:, part], c), half_bounds(y[:, part], c)
            there += bu[row, hy]
            back += by[row, hu]
        seen.append(np.minimum(there, back))
    return float(np.quantile(np.concatenate(seen), recall)) if seen else 0.0


#: ``home`` is the cell a vector lives in, ``visits`` the others it looks into; a row lives in its cell where these are given.
ENTRY = "label long, cell long, home long, visits array<long>, probe boolean, id long, n long, vector array<{0}>"


def _cells(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home cell, bounds of the first half, bounds of the second) of unit vectors."""
    at = x.shape[1] // 2
    (h1, b1), (h2, b2) = half_bounds(x[:, :at], books[0]), half_bounds(x[:, at:], books[1])
    return h1 * len(books[1]) + h2, b1, b2


def _homes(rows: DataFrame, sent, dim: int) -> DataFrame:
    """(label, cell, h1, h2) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([b["label"], pa.array(_cells(_units(b["vector"], dim), sent.value)[0], pa.int64()), b["h1"], b["h2"]], ["label", "cell", "h1", "h2"])

    return rows.mapInArrow(run, "label long, cell long, h1 long, h2 long")


def _entries(classes: DataFrame, sent, limit: float, dim: int, kind: str) -> DataFrame:
    """Each vector at home in its cell, and as a probe in every other cell it must visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                home, b1, b2 = _cells(_units(b["vector"], dim), sent.value)
                width, n = b2.shape[1], b.num_rows
                visits = [[c for i, j, _ in multi_sequence(b1[r], b2[r], limit) if (c := i * width + j) != home[r]] for r in range(n)]
                row = np.r_[np.arange(n), np.repeat(np.arange(n), [len(v) for v in visits])]
                cell = np.r_[home, np.array([c for v in visits for c in v], np.int64)]
                t = b.take(pa.array(row))
                listed = pa.array([*visits, *[None] * (len(row) - n)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([t["label"], pa.array(cell), pa.array(home[row]), listed, pa.array(np.arange(len(row)) >= n), t["id"], t["n"], t["vector"]], [c.split()[0] for c in ENTRY.split(", ")])

    return classes.mapInArrow(run, ENTRY.format(kind))


def _verify(least: float, dim: int, span: int, step: int = 2048):
    """Within a cell: how many vectors each class links to, and edges that keep what is connected connected; ``span`` is the number of cells, empty ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches, ["label", "cell", "block"]):
            label, cell, block, probe, split = (t[c].to_numpy() for c in ("label", "cell", "block", "probe", "split"))
            ids, n, home, x = t["id"].to_numpy(), t["n"].to_numpy(), t["home"].to_numpy(), _units(t["vector"], dim)
            visits, cut = t["visits"].combine_chunks(), edges(label, cell, block)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                m = s + int(np.searchsorted(probe[s:e], True))  # homes come first
                if m == s:
                    continue
                here = visits.slice(s, m - s)
                told = np.repeat(np.arange(m - s), here.value_lengths().to_numpy(zero_copy_only=False)) * span + here.flatten().to_numpy()
                for lo in range(m if split[s] else s, e, step):
                    hi = min(e, lo + step)
                    hit = x[lo:hi] @ x[s:m].T >= least
                    later = ids[lo:hi, None] > ids[s:m]
                    # the smaller id's visit counts where the larger one's wouldn't find the pair
                    q, h = np.nonzero(hit & ~later & (home[lo:hi] != cell[s])[:, None])
                    hit &= later
                    only = ~np.isin(h * span + home[lo + q], told)
                    hit[q[only], h[only]] = True
                    if not hit.any():
                        continue
                    q, h = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
                    part = hit[np.ix_(q, h)]
                    qi, hi_ = ids[lo + q], ids[s + h]
                    top, low = qi.copy(), hi_.copy()
                    big = np.iinfo(np.int64).max
                    while True:
                        new = np.minimum(top, np.where(part, low, big).min(1))
                        low2 = np.minimum(low, np.where(part, new[:, None], big).min(0))
                        if (new == top).all() and (low2 == low).all():
                            break
                        top, low = new, low2
                    out.append((np.r_[qi, hi_], np.r_[part @ n[s + h], part.T @ n[lo + q]], np.r_[top, low]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["id", "links", "root"])

    return run


def link_vectors(vectors: DataFrame, least: float = 0.98, recall: float = 0.999, most_fitted: int = 20_000, codes: int | None = None, hot_cell: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Only rows of equal, non-null labels and of equal length are compared, each
    length by an index of its own (so lengths must be few). A vector that is
    null, empty, zero, or holds null or non-finite components links with
    nothing. Equal vectors of a label, told by two 64-bit hashes, are one class
    with a count, so copies are never paired. The codebooks, of ``codes``
    centres (sqrt(rows)/16 to a power of two, 4 to 1024), and the bound of visits
    that gives ``recall`` are fitted on the ``most_fitted`` rows of the lowest
    hashes; every vector is indexed. A recall of 1 visits every cell that can
    hold a neighbour. Cells with more than ``hot_cell`` classes are dealt over
    tasks by pairs of blocks. Repeated rows count as vectors of their own; an
    empty table gives none. Vectors are read as they are, float or double, and
    compared in double precision.
    """
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    zero = ~F.exists("embedding", lambda v: v != 0)
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & ~zero, F.lit(False))
    out = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    for r in rows.where(sound).groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect():
        same = rows.where(sound & (F.size("embedding") == r["d"]))
        if r["d"] == 1:  # both halves need a component
            same = same.withColumn("embedding", F.concat("embedding", F.array(F.lit(0).cast(kind))))
        out = out.union(_linked(same, max(2, r["d"]), r["count"], kind, least, recall, most_fitted, codes, hot_cell))
    return out


def _linked(rows: DataFrame, dim: int, count: int, kind: str, least: float, recall: float, most_fitted: int, codes: int | None, hot_cell: int) -> DataFrame:
    """``link_vectors`` of sound rows of one length."""
    spark = rows.sparkSession
    good = rows.select("vec_id", "label", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"), F.col("embedding").alias("vector"))
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most_fitted).select("vector").toArrow()
    x = _units(sample["vector"], dim)
    k = codes or int(np.clip(2 ** round(np.log2(max(1.0, np.sqrt(count) / 16))), 4, 1024))
    books = codebook(x[:, : dim // 2], k), codebook(x[:, dim // 2 :], k)
    sent, key = spark.sparkContext.broadcast(books), ["label", "h1", "h2"]
    hot = _homes(good.select("label", "h1", "h2", "vector"), sent, dim).distinct().groupBy("label", "cell").agg(F.count("*").alias("c")).where(F.col("c") > hot_cell)
    hot = staged(hot.select("label", "cell", F.ceil(F.col("c") / hot_cell).cast("int").alias("b")), "hot")
    classes = good.groupBy(*key).agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    entries = _entries(classes.select("label", "id", "n", "vector"), sent, reach(x, books, least, recall), dim, kind).join(hot, ["label", "cell"], "left")
    # a hot cell is b x b tasks: a row at home lies in all of its home block's, and probes all of its probe block's
    own, every = F.pmod(F.xxhash64("id"), F.col("b")).cast("int"), F.sequence(F.lit(0), F.col("b") - 1)
    at = lambda block, probe: F.struct(block.cast("int").alias("block"), probe.alias("probe"))
    probes = F.transform(every, lambda k: at(k * F.col("b") + own, F.lit(True)))
    homes = F.transform(every, lambda k: at(own * F.col("b") + k, F.lit(False)))
    places = F.when(F.col("b").isNull(), F.array(at(F.lit(0), F.col("probe")))).otherwise(F.when(F.col("probe"), probes).otherwise(F.concat(probes, homes)))
    entries = entries.withColumn("place", F.explode(places)).select("label", "cell", "place.block", "place.probe", F.col("b").isNotNull().alias("split"), "home", "visits", "id", "n", "vector")
    sorted_ = entries.repartition(partitions(spark), "label", "cell", "block").sortWithinPartitions("label", "cell", "block", "probe", "id")
    found = staged(sorted_.mapInArrow(_verify(least, dim, len(books[0]) * len(books[1])), "id long, links long, root long"), "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    members = good.groupBy(*key).agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).join(links, "id", "left").join(roots, "id", "left")
    members = members.select(*key, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    joined = good.select("vec_id", *key).join(members, key).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return joined
