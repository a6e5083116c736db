import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tickloom.llm import hilbert_shards, line_dedup, warc_fixity

DOCS = "doc_id long, text string, lang string, source string"


def test_hilbert_curve_is_a_walk_over_the_grid(spark):
    df = spark.range(8).select(F.col("id").cast("int").alias("a")).crossJoin(spark.range(8).select(F.col("id").cast("int").alias("b"))).crossJoin(spark.range(8).select(F.col("id").cast("int").alias("c")))
    rows = sorted((r.h, (r.a, r.b, r.c)) for r in hilbert_shards.hilbert_index(df, ["a", "b", "c"], 3, "h").collect())
    assert [h for h, _ in rows] == list(range(512))
    assert all(sum(abs(p - q) for p, q in zip(x, y)) == 1 for (_, x), (_, y) in zip(rows, rows[1:]))


def test_shards_are_even_and_gapless(spark):
    rows = [(i, "x" * (i % 50) if i % 7 else None, "en" if i % 3 else None, f"s{i % 5}") for i in range(203)] + [(1, "x", "en", "s1")] * 2
    got = hilbert_shards.shard_documents(spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("clash")), 8).collect()
    assert len(got) == 205
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted(r["position"] for r in got) == list(range(205))
    by = {r["doc_id"]: r for r in got}
    assert by[8]["text_crc32"] == zlib.crc32(b"x" * 8) and by[8]["size"] == 9 and by[7]["size"] == 1 and by[7]["text_crc32"] == 0
    placed = sorted(got, key=lambda r: r["position"])
    assert all(x["cell"] <= y["cell"] for x, y in zip(placed, placed[1:]))
    assert hilbert_shards.shard_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_shards_prune_on_every_dimension(spark):
    rows = [(i, "y" * (1 + (i * 37) % 4000), ("en", "de")[i % 2], f"s{i % 10}") for i in range(2000)]
    docs = spark.createDataFrame(rows, DOCS)
    placed = hilbert_shards.shard_documents(docs, 16).join(docs.select("doc_id", "source", "lang"), "doc_id")
    per = placed.groupBy("shard").agg(F.countDistinct("source").alias("s"), F.countDistinct("lang").alias("l")).collect()
    assert sum(r.s for r in per) < 16 * 10 * 0.6


def _curve(point, bits):
    """The published transform of axes to a Hilbert index, by loops."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return int("".join(str(x[i] >> b & 1) for b in range(bits - 1, -1, -1) for i in range(n)), 2)


def test_shards_equal_a_brute_force_placement(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["", "a", "é", "xyz"]) * rng.randint(0, 900) if i % 9 else None, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None])) for i in range(200)] + [(5, "a", "en", "s1")] * 3
    code = lambda c: 0 if c is None else zlib.crc32(c.encode()) % 32
    want = []
    for i, t, lang, source in rows:
        raw = (t or "").encode()
        size = len(raw) + 1
        want.append((_curve((code(source), min(31, int(math.log2(size) * 2)), code(lang)), 5), i, size, zlib.crc32(raw)))
    want.sort(key=lambda r: r[0])
    got = hilbert_shards.shard_documents(spark.createDataFrame(rows, DOCS), 8).collect()
    assert sorted((r["cell"], r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted(want)
    n, at = len(want), 0
    for shard in range(8):
        count = n // 8 + (shard < n % 8)
        here = sorted((r for r in got if r["shard"] == shard), key=lambda r: r["slot"])
        assert [r["slot"] for r in here] == list(range(count)) and [r["cell"] for r in here] == [w[0] for w in want[at : at + count]]
        at += count


PAGES = "page_id long, url string, html string"


def test_audit_finds_exactly_the_damage(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(300)] + [(None, None, None), (7, "http://h/7", "<p>7</p>")]
    pages = spark.createDataFrame(rows, PAGES)
    harmed = pages.withColumn("html", F.when(F.col("page_id").isin(13, 250), F.lit("<p>!!</p>")).otherwise(F.col("html"))).where("page_id is null or page_id < 299")
    got = {(r.archive, r.seq): r for r in warc_fixity.audit(warc_fixity.archived(pages, per_archive=64), warc_fixity.archived(harmed, per_archive=64), fanout=4, top=4).collect()}
    assert len(got) == 302
    bad = {r.page_id for r in got.values() if not r.intact}
    assert {250, 299} <= bad and 13 in bad and len([r for r in got.values() if r.archive == 1 and not r.intact]) == 0
    assert all(r.archive_intact == (r.archive in (-1, 1, 2)) for r in got.values())
    first = min((r for r in got.values() if r.archive == 1), key=lambda r: r.seq)
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:64>\r\nWARC-Target-URI: http://h/64\r\nContent-Type: text/html\r\nContent-Length: 9\r\n\r\n<p>64</p>\r\n\r\n"
    assert first.offset == 0 and first.length == len(record) and first.digest == hashlib.sha256(record).hexdigest()


def test_audit_reads_below_differing_nodes_only(spark):
    pages = spark.createDataFrame([(i, "u", f"{i:03}") for i in range(64)], PAGES)
    harmed = pages.withColumn("html", F.when(F.col("page_id") == 40, F.lit("xxx")).otherwise(F.col("html")))
    a, b = warc_fixity.archived(pages), warc_fixity.archived(harmed)
    la, lb = warc_fixity.merkle_levels(a, 4, 3), warc_fixity.merkle_levels(b, 4, 3)
    assert [x.count() for x in la] == [64, 16, 4, 1]
    assert [tuple(r) for r in warc_fixity.differing(la, lb, 4).collect()] == [(0, 40)]


def test_audit_of_empty_tables(spark):
    e = warc_fixity.archived(spark.createDataFrame([], PAGES))
    assert warc_fixity.audit(e, e).count() == 0


def _brute(rows, least):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    found = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            found.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(found[key(x)]) < least]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_lines_against_brute_force(spark):
    rows = [(i, "\n".join([f"line {i}", "  Common É Line\r", "\t", f"pair {i // 2}", "COMMON É line"[: 5 + i % 9]] * (1 + i % 2))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "common É line " + "z" * 100000), (104, " common É line")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, k1 string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.drop_frequent_lines(docs).collect()}
    assert got == _brute(rows, 10)


@pytest.mark.parametrize("n", [1, 9])
def test_runs_compact_and_count(spark, n):
    runs = line_dedup.LineRuns(spark, fanout=3)
    for b in range(n):
        runs.add(spark.createDataFrame([(1, 1, 2), (2, b, 1)], "k1 long, k2 long, n_docs long"))
    assert all(len(level) < 3 for level in runs.levels)
    got = {(r.k1, r.k2): r.n for r in runs.read().groupBy("k1", "k2").agg(F.sum("n_docs").alias("n")).collect()}
    assert got == {(1, 1): 2 * n} | {(2, b): 1 for b in range(n)}
    assert {(r.k1, r.k2) for r in runs.frequent(2 * n).collect()} >= {(1, 1)}
    assert runs.read().where("fresh").count() == n + 1
    new = spark.createDataFrame([("a", 1, 1), ("b", 9, 9)], "x string, k1 long, k2 long")
    assert [r.x for r in runs.unseen(new).collect()] == ["b"]
