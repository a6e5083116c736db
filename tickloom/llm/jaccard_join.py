"""Exact Jaccard join of documents on word shingles, with set-relation skipping.

Equal sets are one set, told by their size and a 64-bit sum of their shingles.
Sets are ordered by a global order, rare shingles first, and only a prefix of
each enters the inverted lists: two sets over the threshold share a prefix
shingle. Two relations between sets then spare comparisons.

By position: lists are walked in blocks of like size, and a block is skipped
against another when no positions in them can reach the threshold.

By answers: a list's first set, its leader, is compared with the others first,
on whole sets. Any other pair of the list is answered from the leader's
overlaps where these decide it: x and z share at least |x & L| + |z & L| - |L|
shingles, and at most min(|x & L|, |z & L|) + min(|x - L|, |z - L|). What is
left passes parity sketches, which never overstate how much two sets differ,
and is then compared on whole sets, each shipped once for all sets it is
compared with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import mix, shingle_sets, slices
from ._components import components
from ._groups import blocks, edges
from ._stage import partitions, staged

SKETCH, PARTS = 1 << 20, 256
#: Bits of the filter that spares sets nobody asks for: sixteen a set, and this at most.
MOST_BITS = 1 << 29
#: A list or group of comparisons is cut into runs of about 2**RUN sets.
RUN = 12
_SHIFT = np.uint64(44)


def _key(s: np.ndarray) -> int:
    """What tells a set from others of its size."""
    return int(s.sum(dtype=np.uint64).view(np.int64))


def _width(n: int) -> int:
    """Bits of the parity sketch of a set: a power of two near its size, from 256 to 65536."""
    return 1 << min(16, max(8, (n - 1).bit_length()))


def _parity(s: np.ndarray) -> bytes:
    w = _width(len(s))
    return np.packbits(np.bincount((s & np.uint64(w - 1)).astype(np.int64), minlength=w) & 1, bitorder="little").tobytes()


def _folded(blobs: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, the wider ones folded to ``width`` bits: halves add up."""
    out = np.empty((len(blobs), width // 64), np.uint64)
    for k, b in enumerate(blobs):
        out[k] = np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, width // 64), axis=0)
    return out


def _profile(size: int):
    """Per text the size, key and (once a task) parity sketch of its set; per task, counters of hashed shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, known = np.zeros(SKETCH, np.uint32), set()
        kinds = [("doc_id", pa.int64()), ("n", pa.int32()), ("key", pa.int64()), ("parity", pa.binary()), ("part", pa.int32()), ("blob", pa.binary())]
        for b in slices(batches):
            n, key, seen, parity = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64), [], [None] * b.num_rows
            for i, s in shingle_sets(b["text"], size):
                if len(s):
                    n[i], key[i] = len(s), _key(s)
                    seen.append(s >> _SHIFT)
                    if (int(n[i]), int(key[i])) not in known:
                        parity[i] = _parity(s)
                        if len(known) < 500_000:
                            known.add((int(n[i]), int(key[i])))
            if seen:
                counters += np.bincount(np.concatenate(seen).astype(np.int64), minlength=SKETCH).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n), pa.array(key), pa.array(parity, pa.binary()), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())], [c for c, _ in kinds])
        step = SKETCH // PARTS
        some = [p for p in range(PARTS) if counters[p * step : (p + 1) * step].any()]
        blobs = [counters[p * step : (p + 1) * step].tobytes() for p in some]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), k) for _, k in kinds[:4]] + [pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], [c for c, _ in kinds])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One array of counters a part, from all of that part."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for p, blob in zip(b["part"].to_pylist(), b["blob"], strict=True):
            x = np.frombuffer(blob.as_buffer(), np.uint32)
            held[p] = held[p] + x if p in held else x.astype(np.uint64)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["part", "blob"])


def _levels(profile: DataFrame) -> np.ndarray:
    """For each counter the power of two of what it holds over the median, which is what chance puts there."""
    blobs = profile.where("part is not null").select("part", "blob")
    parts = blobs.repartition(min(PARTS, 4 * partitions(blobs.sparkSession)), "part").mapInArrow(_summed, "part int, blob binary")
    counts = np.zeros(SKETCH, np.uint64)
    for r in parts.collect():
        x = np.frombuffer(r["blob"], np.uint64)
        counts[r["part"] * len(x) : (r["part"] + 1) * len(x)] = x
    return np.floor(np.log2(1.0 + np.maximum(0.0, counts - np.median(counts)))).astype(np.uint8)


#: place: the set's size and the shingle's position in it; cut: the run of a list that is cut, and the power of two of its runs.
ENTRY = "token long, cut long, doc_id long, key long, place long"
LIST = "token long, salt int, salts int, key long, n int, pos int"
_LAST = 2**63 - 1


def _prefixes(size: int, levels, num: int, den: int):
    """ENTRY rows: the prefix of each set, a set once a task. Lists of frequent shingles are cut into runs, by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, known = levels.value, set()
        for b in slices(batches):
            out, ids = [[] for _ in range(5)], b["doc_id"].fill_null(_LAST).to_numpy()
            for i, s in shingle_sets(b["text"], size):
                if not len(s) or (own := (len(s), _key(s))) in known:
                    continue
                if len(known) < 500_000:
                    known.add(own)
                keep = len(s) - -(-num * len(s) // den) + 1
                rank = level[(s >> _SHIFT).astype(np.int64)]
                order = np.argsort(rank, kind="stable")[:keep]
                power = np.maximum(0, rank[order].astype(np.int64) - RUN)
                salt = int(mix(np.array([own[1]], np.int64).view(np.uint64))[0] & np.uint64(0x7FFFFFFF)) & ((1 << power) - 1)
                for c, x in zip(out, (s[order].view(np.int64), salt << 6 | power, np.full(keep, ids[i]), np.full(keep, own[1]), own[0] << 32 | np.arange(keep)), strict=True):
                    c.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], [c.split()[0] for c in ENTRY.split(", ")])

    return run


def _need(nx, ny, num: int, den: int):
    """The least overlap of sets of these sizes that reaches the threshold: overlap * (num + den) >= num * (nx + ny)."""
    return -(-num * (nx + ny) // (num + den))


def _may(nx, px, ny, py, num: int, den: int):
    """Whether sets of these sizes, sharing the shingle at these positions, can reach the threshold."""
    most = np.minimum(px, py) + 1 + np.minimum(nx - px - 1, ny - py - 1)
    return (num * np.maximum(nx, ny) <= den * np.minimum(nx, ny)) & (most >= _need(nx, ny, num, den))


LED = f"{LIST}, lead long, lead_n int, may boolean, size int"


def _led(num: int, den: int):
    """Lists of two sets or more (and runs of longer ones) with their leaders; ``may``: only whole sets can tell this one from its leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches, ["token", "cut"]):
            token, cut_, doc, key, place = (t[c.split()[0]].to_numpy() for c in ENTRY.split(", "))
            n, pos = place >> 32, place & 0xFFFFFFFF
            one = np.lexsort((doc, n, key, cut_, token))
            one = one[edges(token[one], cut_[one], key[one], n[one])[:-1]]  # a set is there once for each task that met it
            one = one[np.lexsort((key[one], doc[one], cut_[one], token[one]))]  # its leader is the set met in the earliest document
            token, salt, salts, key, n, pos = token[one], cut_[one] >> 6, 1 << (cut_[one] & 63), key[one], n[one], pos[one]
            cut = edges(token, salt)
            size = np.repeat(np.diff(cut), np.diff(cut))
            first = np.repeat(cut[:-1], np.diff(cut))
            keep = (size > 1) | (salts > 1)
            if not keep.any():
                continue
            may = (np.arange(len(token)) != first) & _may(n, pos, n[first], pos[first], num, den)
            kinds = (np.int64, np.int32, np.int32, np.int64, np.int32, np.int32, np.int64, np.int32, bool, np.int32)
            columns = (token, salt, salts, key, n, pos, key[first], n[first], may, size)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep].astype(k)) for x, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in LED.split(", ")])

    return run


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64) + np.uint64(1)) & np.uint64(bits - 1)).astype(np.int64)


def _filter(keys: DataFrame) -> np.ndarray:
    """A filter of hashed keys, bits packed; its size grows with the number of keys up to MOST_BITS."""
    spark = keys.sparkSession
    n = keys.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    step = bits // PARTS

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.unique(_slot(b["k"].to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array((s // step).astype(np.int32)), pa.array((s % step).astype(np.int32))], ["part", "at"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            part, at = b["part"].to_numpy(), b["at"].to_numpy()
            for p in np.unique(part).tolist():
                held.setdefault(p, np.zeros(step, bool))[at[part == p]] = True
                if len(held) > 8:  # a bounded number unpacked at once; parts may come in pieces
                    q = next(iter(held))
                    yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([np.packbits(held.pop(q), bitorder="little").tobytes()], pa.binary())], ["part", "blob"])
        for q, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())], ["part", "blob"])

    out = np.zeros(bits // 8, np.uint8)
    dealt = keys.select("k").mapInArrow(slots, "part int, at int").repartition(min(PARTS, 4 * partitions(spark)), "part").sortWithinPartitions("part")
    for r in dealt.mapInArrow(packed, "part int, blob binary").toLocalIterator():
        out[r["part"] * (step // 8) : (r["part"] + 1) * (step // 8)] |= np.frombuffer(r["blob"], np.uint8)
    return out


def _asked_sets(size: int, sent):
    """(k, kn, set) of the texts whose sets may be asked for, a set once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, known = sent.value, set()
        bits = 8 * len(packed)
        for b in slices(batches):
            rows = []
            for _, s in shingle_sets(b["text"], size):
                if len(s):
                    own = (_key(s), len(s))
                    at = int(_slot(np.array([own[0]]), bits)[0])
                    if packed[at >> 3] >> (at & 7) & 1 and own not in known:
                        if len(known) < 500_000:
                            known.add(own)
                        rows.append((*own, s.tobytes()))
            k, n, blob = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int32()), pa.array(blob, pa.binary())], ["k", "kn", "set"])

    return run


PAIR = ["x", "nx", "y", "ny"]


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlaps of the sets of a group with its first one; only that one is held."""
    group, y = None, np.zeros(0, np.uint64)
    for b in batches:
        out = []
        for to, ton, part, last, k, kn, blob in zip(*(b[c].to_pylist() for c in ("to", "ton", "part", "last", "k", "kn")), b["set"], strict=True):
            s = np.frombuffer(blob.as_buffer(), np.uint64)
            if not last:
                group, y = (to, ton, part), s.copy()
                continue
            assert group == (to, ton, part)
            at = np.minimum(np.searchsorted(y, s), len(y) - 1)
            out.append((k, kn, to, ton, int((y[at] == s).sum())))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)], [*PAIR, "both"])


def overlaps(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Distinct pairs (x, nx, y, ny) of sets with ``both``, the shingles they share.

    Pairs are grouped by y, large groups in parts; y travels once a part, x once
    a pair, and a task holds one y at a time.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    many = pairs.groupBy("y", "ny").agg(F.shiftright(F.count("*"), RUN).alias("more"))
    dealt = pairs.join(many, ["y", "ny"]).withColumn("part", F.pmod(F.xxhash64("x", "nx"), F.col("more") + 1).cast("int"))
    to = [F.col("y").alias("to"), F.col("ny").alias("ton"), "part"]
    ahead = dealt.select(F.col("y").alias("k"), F.col("ny").alias("kn"), *to, F.lit(False).alias("last")).distinct()
    routes = staged(dealt.select(F.col("x").alias("k"), F.col("nx").alias("kn"), *to, F.lit(True).alias("last")).union(ahead), "routes")
    asked = spark.sparkContext.broadcast(_filter(routes.select("k").distinct()))
    sets = docs.select("text").mapInArrow(_asked_sets(size, asked), "k long, kn int, set binary").repartition(n, "k", "kn").dropDuplicates(["k", "kn"])
    shipped = routes.hint("shuffle_hash").join(sets, ["k", "kn"]).repartition(n, "to", "ton", "part").sortWithinPartitions("to", "ton", "part", "last")
    return shipped.select("to", "ton", "part", "last", "k", "kn", "set").mapInArrow(_against, "x long, nx int, y long, ny int, both int")


OPEN = "token long, run int, home boolean, key long, n int, pos int, lead long, lead_n int, both int, comp long"


def _open_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists in which sets other than the leader are of different components."""
    for t in blocks(batches, ["token"]):
        token, comp = t["token"].to_numpy(), t["comp"].to_numpy()
        cut = edges(token)
        low, high = np.minimum.reduceat(comp, cut[:-1]), np.maximum.reduceat(comp, cut[:-1])
        keep = np.repeat(low != high, np.diff(cut))
        if keep.any():
            yield from t.filter(pa.array(keep)).combine_chunks().to_batches()


def _far(one: list[bytes], two: list[bytes], most: np.ndarray) -> np.ndarray:
    """Whether sketches differ in more than ``most`` places."""
    width = np.minimum([8 * len(b) for b in one], [8 * len(b) for b in two])
    out = np.zeros(len(one), bool)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        differ = _folded([one[k] for k in at], w) ^ _folded([two[k] for k in at], w)
        out[at] = np.bitwise_count(differ).sum(1, dtype=np.int64) > most[at]
    return out


def _plausible(num: int, den: int):
    """The pairs whose sketches do not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = b["nx"].to_numpy().astype(np.int64) + b["ny"].to_numpy()
                far = _far(b["one"].to_pylist(), b["two"].to_pylist(), n - 2 * -(-num * n // (num + den)))
                yield b.select(PAIR).filter(pa.array(~far))

    return run


def _across(num: int, den: int, block: int = 256):
    """(x, nx, y, ny, sure): pairs that their leader's answers leave open, or decide to be links (``sure``).

    A list is walked in blocks of like size; a block is skipped against another
    when no sizes and positions in them can reach the threshold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches, ["token", "run"]):
            names = ("token", "run", "home", "key", "n", "pos", "lead", "lead_n", "both", "comp")
            token, run_, home, key, n, pos, lead, lead_n, both, comp = (t[c].to_numpy().astype(np.int64) for c in names)
            home, parity, found = home.astype(bool), t["parity"].to_pylist(), []
            low = np.where(both >= 0, both, 0)
            high = np.where(both >= 0, both, _need(n, lead_n, num, den) - 1)
            cut = edges(token, run_)
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if comp[s:e].min() == comp[s:e].max():
                    continue
                k = s + np.lexsort((pos[s:e], n[s:e]))
                for a in range(0, len(k), block):
                    ka = k[a : a + block]
                    for b in range(a, len(k), block):
                        kb = k[b : b + block]
                        if num * n[kb[0]] > den * n[ka[-1]]:
                            break
                        most = min(pos[ka].max(), pos[kb].max()) + min(n[ka[-1]] - pos[ka].min(), n[kb[-1]] - pos[kb].min())
                        if most < _need(n[ka[0]], n[kb[0]], num, den):
                            continue
                        hit = _may(n[ka][:, None], pos[ka][:, None], n[kb], pos[kb], num, den)
                        hit &= (comp[ka][:, None] != comp[kb]) & (home[ka][:, None] | home[kb]) & (key[ka][:, None] != key[kb])
                        if a == b:
                            hit &= np.arange(len(ka))[:, None] < np.arange(len(kb))
                        p, q = np.nonzero(hit)
                        p, q = ka[p], kb[q]
                        led = lead[p] == lead[q]
                        answered = led & ((key[p] == lead[q]) | (key[q] == lead[p]))
                        need = _need(n[p], n[q], num, den)
                        upper = np.minimum(high[p], high[q]) + np.minimum(n[p] - low[p], n[q] - low[q])
                        keep = ~answered & (~led | (upper >= need))
                        p, q, need, led = p[keep], q[keep], need[keep], led[keep]
                        if not len(p):
                            continue
                        sure = led & (low[p] + low[q] - lead_n[p] >= need)
                        ok = ~_far([parity[i] for i in p], [parity[i] for i in q], n[p] + n[q] - 2 * need)
                        p, q, sure = p[ok], q[ok], sure[ok]
                        if len(p):
                            swap = key[p] < key[q]
                            p, q = np.where(swap, p, q), np.where(swap, q, p)
                            found.append(np.stack([key[p], n[p], key[q], n[q], sure], 1))
            if found:
                f = np.unique(np.concatenate(found), axis=0)
                kinds = (np.int64, np.int32, np.int64, np.int32, bool)
                yield pa.RecordBatch.from_arrays([pa.array(f[:, c].astype(k)) for c, k in enumerate(kinds)], [*PAIR, "sure"])

    return run


def similar_sets(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links): members are rows (doc_id, n, key), links pairs of different sets (x, nx, y, ny) that reach num/den, in either order, perhaps in both.

    With ``every``, links are all there are. Otherwise sets that links already
    connect are not compared again: links are then enough to connect what all
    of them connect, and a group of near copies answers through its leaders
    rather than through all its pairs.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    profile = staged(docs.mapInArrow(_profile(size), "doc_id long, n int, key long, parity binary, part int, blob binary"), "profile")
    members = profile.where("part is null").select("doc_id", "n", "key")
    sketches = profile.where("parity is not null").select(F.col("key").alias("_key"), F.col("n").alias("_n"), "parity").dropDuplicates(["_key", "_n"])
    levels = spark.sparkContext.broadcast(_levels(profile))

    entries = docs.mapInArrow(_prefixes(size, levels, num, den), ENTRY).repartition(n, "token", "cut").sortWithinPartitions("token", "cut")
    lists = staged(entries.mapInArrow(_led(num, den), LED), "lists")
    asked = lists.where("may").select(F.col("key").alias("x"), F.col("n").alias("nx"), F.col("lead").alias("y"), F.col("lead_n").alias("ny"))
    # a list cut into runs has a leader a run: they meet the first of them
    heads = lists.where("salts > 1 and key = lead and n = lead_n").select("token", "key", "n")
    first = heads.groupBy("token").agg(F.min(F.struct("key", "n")).alias("f"))
    heads = heads.join(first, "token").where("key > f.key and n * {0} <= f.n * {1} and f.n * {0} <= n * {1}".format(num, den))
    asked = asked.union(heads.select("key", "n", "f.key", "f.n")).distinct()
    one, two = (sketches.select(F.col("_key").alias(a), F.col("_n").alias(b), F.col("parity").alias(c)) for a, b, c in (("x", "nx", "one"), ("y", "ny", "two")))
    asked = asked.join(one, ["x", "nx"]).join(two, ["y", "ny"]).mapInArrow(_plausible(num, den), "x long, nx int, y long, ny int")
    near = staged(overlaps(asked, docs, size), "near")
    links = near.where(F.col("both") * (num + den) >= num * (F.col("nx") + F.col("ny")).cast("long")).select(*PAIR)

    if every:
        known = spark.createDataFrame([], "node long, root long")
    else:
        known = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    told = near.select(F.col("x").alias("key"), F.col("nx").alias("n"), F.col("y").alias("lead"), F.col("ny").alias("lead_n"), "both")
    rest = lists.where("size > 2 or salts > 1").join(told, ["key", "n", "lead", "lead_n"], "left").join(known, F.col("key") == F.col("node"), "left")
    own = F.when(F.col("key") == F.col("lead"), F.col("n")).otherwise(F.coalesce("both", F.lit(-1))).cast("int")
    rest = rest.select("token", "salt", "salts", "key", "n", "pos", "lead", "lead_n", own.alias("both"), F.coalesce("root", "key").alias("comp"))
    fields = [c.split()[0] for c in OPEN.split(", ")]
    short = rest.where("salts = 1").withColumn("run", F.lit(0)).withColumn("home", F.lit(True)).select(*fields)
    short = short.repartition(n, "token").sortWithinPartitions("token").mapInArrow(_open_lists, OPEN)
    # of a list in runs, the sets outside the first set's component visit every run
    long_ = rest.where("salts > 1")
    whole = long_.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct("key", "comp")).alias("f")).where("low <> high")
    long_ = long_.join(whole.select("token", F.col("f.comp").alias("main")), "token")
    runs = F.when(F.col("comp") == F.col("main"), F.array("salt")).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
    long_ = long_.withColumn("run", F.explode(runs)).withColumn("home", F.col("run") == F.col("salt")).select(*fields)
    open_ = short.union(long_).join(sketches, (F.col("key") == F.col("_key")) & (F.col("n") == F.col("_n"))).select(*fields, "parity")
    open_ = open_.repartition(n, "token", "run").sortWithinPartitions("token", "run")
    more = staged(open_.mapInArrow(_across(num, den), "x long, nx int, y long, ny int, sure boolean").groupBy(*PAIR).agg(F.max("sure").alias("sure")), "across")
    checked = overlaps(more.where("not sure").select(*PAIR), docs, size).where(F.col("both") * (num + den) >= num * (F.col("nx") + F.col("ny")).cast("long"))
    return members, links.union(more.where("sure").select(*PAIR)).union(staged(checked.select(*PAIR), "more"))


def link_documents(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document; links are Jaccard similarities of num/den or more.

    A set holds the distinct ``size``-word shingles of a whole text, A-Z
    lower-cased; a shorter text is one shingle, one without words (or null) is
    empty and links with nothing. component_id is the smallest doc_id that links
    reach; rows without an id link as others do, but name no component. Rows that
    repeat, or share an id, are rows of their own. Columns other than doc_id and
    text are ignored. Shingles are 64-bit hashes.
    """
    members, links = similar_sets(docs, size, num, den)
    roots = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    classes = members.where("n > 0").groupBy("n", "key").agg(F.min("doc_id").alias("rep"))
    classes = classes.join(roots, F.col("key") == F.col("node"), "left").select("n", "key", "rep", F.coalesce("root", "key").alias("root"))
    named = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = staged(classes.join(named, "root").select("n", "key", "component_id"), "classes")
    out = members.join(named, ["n", "key"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def link_counts(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_links): to how many other rows each document is linked, its copies among them."""
    members, links = similar_sets(docs, size, num, den, every=True)
    classes = staged(members.where("n > 0").groupBy("n", "key").agg(F.count("*").alias("copies")), "copies")
    both = links.union(links.select("y", "ny", "x", "nx")).distinct()  # a pair may be found in lists of either order
    near = both.join(classes.select(F.col("key").alias("y"), F.col("n").alias("ny"), "copies"), ["y", "ny"]).groupBy(F.col("x").alias("key"), F.col("nx").alias("n")).agg(F.sum("copies").alias("others"))
    counts = classes.join(near, ["key", "n"], "left").select("n", "key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(counts, ["n", "key"], "left").select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
