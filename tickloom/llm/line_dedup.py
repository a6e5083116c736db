"""Line deduplication over levelled sorted runs.

A store keeps, for every line key seen, in how many documents it was found.
It is a set of runs sorted by key: each batch of documents merge-anti-joins
the runs to learn which keys are new, and adds one run of its own; when a
level holds ``fanout`` runs they are merged into one run of the next level.
A line whose key is in enough documents over all runs is dropped everywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._stage import new_path, partitions, staged

KEY = ["k1", "k2"]
RUN = "k1 long, k2 long, n_docs long, fresh boolean"


def key_of(line: bytes) -> bytes | None:
    """128 bits of the line without blanks at either end and with A-Z lower-cased, as two longs; none for an empty key.

    On bytes, ``strip`` and ``lower`` know ASCII only, as the key asks.
    """
    key = line.strip().lower()
    return hashlib.blake2b(key, digest_size=16).digest() if key else None


class LineRuns:
    """Levelled runs in a shared folder; ``levels[k]`` lists the paths of level k, newest last."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.path, self._made = new_path(spark, "line_runs"), 0

    def _write(self, counts: DataFrame, level: int) -> str:
        self._made += 1
        path = f"{self.path}/level={level}/run-{self._made}"
        counts.repartitionByRange(partitions(self.spark), *KEY).sortWithinPartitions(*KEY).write.option("compression", "zstd").parquet(path)
        return path

    def read(self) -> DataFrame | None:
        """All runs: (k1, k2, n_docs, fresh), a key once a run at most."""
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema(RUN).parquet(*paths) if paths else None

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose key no run holds."""
        runs = self.read()
        return keys if runs is None else keys.join(runs.where("fresh").select(*KEY).hint("merge"), KEY, "left_anti")

    def add(self, counts: DataFrame) -> None:
        """Add a batch's (k1, k2, n_docs) as a run, and compact every level that is full.

        The batch is merged against the keys first seen in earlier runs; what
        that anti-join leaves is marked ``fresh``, so each key is fresh in
        exactly one run and later finds of it are increments.
        """
        runs = self.read()
        if runs is None:
            counts = counts.withColumn("fresh", F.lit(True))
        else:
            old = runs.where("fresh").select(*KEY, F.lit(True).alias("_old")).hint("merge")
            counts = counts.join(old, KEY, "left").select(*KEY, "n_docs", F.col("_old").isNull().alias("fresh"))
        self.levels[0].append(self._write(counts, 0))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self.spark.read.schema(RUN).parquet(*self.levels[level])
            merged = merged.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("fresh").alias("fresh"))
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level + 1].append(self._write(merged, level + 1))
            self.levels[level] = []
            level += 1

    def frequent(self, least: int) -> DataFrame:
        """Keys found in ``least`` documents or more over all runs."""
        runs = self.read()
        return runs.groupBy(*KEY).agg(F.sum("n_docs").alias("n")).where(F.col("n") >= least).select(*KEY)


def line_keys(docs: DataFrame) -> DataFrame:
    """(_id, k1, k2): the non-empty keys of every row's lines, a key once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                keys, n = [], []
                for t in b["text"]:
                    one = {key_of(x) for x in (t.as_py() or "").encode().split(b"\n")} - {None}
                    keys += one
                    n.append(len(one))
                k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                ids = b["doc_id"].take(pa.array(np.repeat(np.arange(b.num_rows), n)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy())], ["_id", *KEY])

    return docs.select("doc_id", "text").mapInArrow(run, "_id long, k1 long, k2 long")


def doc_counts(keys: DataFrame) -> DataFrame:
    """(k1, k2, n_docs): documents by key; counts before it shuffles, so a line of every document is no hot key."""
    return keys.groupBy(*KEY).agg(F.count("*").alias("n_docs"))


OUT = "doc_id long, text string, n_lines long, n_dropped long, kept_sha256 string"


def _rebuild(carry: bool):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            drop = b["_drop"]
            both = np.stack([drop.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1).astype("<i8")
            at = drop.offsets.to_numpy()
            for r, (i, text) in enumerate(zip(b["_id"].to_pylist(), b["_text"].to_pylist(), strict=True)):
                lines = (text or "").encode().split(b"\n")
                n = len(lines)
                if at[r] < at[r + 1]:
                    gone = {k.tobytes() for k in both[at[r] : at[r + 1]]}
                    lines = [x for x in lines if key_of(x) not in gone]
                kept = b"\n".join(lines)
                for k, v in zip(rows, (i, kept.decode(), n, n - len(lines), hashlib.sha256(kept).hexdigest()), strict=True):
                    k.append(v)
            columns = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns + ([b["_carry"]] if carry else []), [c.split()[0] for c in OUT.split(", ")] + ["_carry"] * carry)

    return run


def drop_frequent_lines(docs: DataFrame, least_docs: int = 10, batches: int = 4, runs: LineRuns | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, kept_sha256): texts without the lines found in ``least_docs`` documents, with the columns of ``carry``.

    Documents arrive in ``batches`` by a hash of their id (or pass ``runs``
    of earlier corpora, which then count too). A null or empty text is one
    empty line, which is never dropped; a line of blanks has an empty key and
    stays. A text that loses all its lines becomes empty. Ids should be unique:
    rows that share one count as documents of their own, and a null id too.
    Columns other than doc_id and text are ignored. Lines travel as 128-bit
    hashes, staged once; a text is shuffled once, to meet the keys that it loses.
    """
    spark = docs.sparkSession
    whole = docs.select("doc_id", "text", *([F.struct(*carry).alias("_carry")] if carry else []))
    keys = staged(line_keys(docs), "line_keys")
    runs = runs or LineRuns(spark)
    for b in range(batches):
        runs.add(doc_counts(keys.where(F.pmod(F.xxhash64("_id"), F.lit(batches)) == b)))
    found = keys.join(runs.frequent(least_docs), KEY, "left_semi")
    places = found.groupBy("_id").agg(F.collect_set(F.struct(*KEY)).alias("_drop"))
    held = ["_carry"] if carry else []
    joined = whole.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), *held).join(places.withColumnRenamed("_id", "_at"), F.col("_id").eqNullSafe(F.col("_at")), "left")
    schema = T.StructType.fromDDL(OUT)
    if carry:
        schema = schema.add(whole.schema["_carry"])
    none = F.array().cast("array<struct<k1:bigint,k2:bigint>>")
    out = joined.select("_id", "_text", F.coalesce("_drop", none).alias("_drop"), *held).mapInArrow(_rebuild(bool(carry)), schema)
    return out.select(*(c.split()[0] for c in OUT.split(", ")), *(["_carry.*"] if carry else []))


def seen_before(docs: DataFrame, runs: LineRuns) -> DataFrame:
    """Keys of ``docs`` that are new to ``runs``: what a stream's next batch keeps under first-seen deduplication."""
    return runs.unseen(line_keys(docs).select(*KEY).distinct())
