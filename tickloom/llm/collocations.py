"""Phrase collocations over a prefix-free parse.

Every text is parsed into chunks that end at trigger words, which are chosen
by their content alone, so a passage gives the same chunks wherever it
stands. A chunk also carries the words that follow it in its piece, as far as
a phrase may run into them. Distinct chunks form a dictionary with the number
of times each was parsed, and phrases are counted inside the dictionary,
weighted by it. A phrase belongs to the chunk that owns its first word, so
overlaps are counted once.

Rare phrases are kept out of the shuffle without a loss: hashes are counted
first, which can only join counts, and phrases go on by their bytes only if
they and all their pairs reach the least count there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import _TABLE, LOWER, flat, mix, powers, ragged, slices
from ._groups import edges
from ._stage import partitions, staged
from .jaccard_join import _filter, _slot

#: One word in so many ends a chunk.
TRIGGER = 16
SLICE = 4 << 20
#: 0 in a word, 1 blank, 2 between pieces: [.,;:!?\x0A-\x0D]
_KIND = np.zeros(256, np.int8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_PAIR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
CHUNKS, COUNTS = "lang string, own int, chunk string", "lang string, phrase string, f long"


def _text_array(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.append(0, ends)
    kind = pa.string() if offsets[-1] < 1 << 31 else pa.large_string()
    offsets = offsets.astype(np.int32 if kind == pa.string() else np.int64)
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _segments(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of about ``SLICE`` bytes that end between pieces."""
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + SLICE)
        while hi < len(data):
            found = np.flatnonzero(_KIND[data[hi : hi + SLICE]] == 2)
            if len(found):
                hi += int(found[0])
                break
            hi = min(len(data), hi + SLICE)
        yield lo, hi
        lo = hi


def _parse(longest: int, trigger: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE // 2):
            data, offsets = flat(b["text"])
            data = np.insert(data, offsets[1:-1], 10)  # texts never share a piece
            begins = offsets[:-1] + np.arange(b.num_rows)
            for lo, hi in _segments(data):
                part = np.append(LOWER[data[lo:hi]], np.uint8(32))
                kind = _KIND[part]
                turn = np.diff(np.r_[1, kind != 0].astype(np.int8))
                s, e = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
                if not len(s):
                    continue
                doc = np.searchsorted(begins, s + lo, "right") - 1
                piece = np.cumsum(kind == 2)[s]
                last = np.r_[piece[1:] != piece[:-1], True]  # of its piece
                total = np.append(np.uint64(0), np.cumsum(_TABLE[part], dtype=np.uint64))
                cut = (mix(total[e] - total[s]) % np.uint64(trigger) == 0) | np.r_[doc[1:] != doc[:-1], True]
                stop = np.flatnonzero(cut) + 1
                first = np.r_[0, stop[:-1]]
                more = np.zeros(len(stop), np.int64)
                for k in range(longest - 1):
                    more += (more == k) & ~last[np.minimum(stop - 1 + k, len(s) - 1)]
                held = stop + more - first
                words = ragged(first, held)
                take = (e - s)[words] + 1
                out = part[ragged(s[words], take)]
                ends = np.cumsum(take)
                out[ends - 1] = np.where(last[words], 10, 32)
                ends = ends[np.cumsum(held) - 1]
                out[ends - 1] = 32
                yield pa.RecordBatch.from_arrays([b["lang"].take(pa.array(doc[first])), pa.array((stop - first).astype(np.int32)), _text_array(out, ends).cast(pa.string())], ["lang", "own", "chunk"])

    return run


def parse(docs: DataFrame, longest: int = 3, trigger: int = TRIGGER) -> DataFrame:
    """(lang, own, chunk, f): the dictionary of distinct chunks and how often each was parsed.

    A chunk is its words, each followed by a blank, or by a line feed where
    its piece ends, and a blank at the end. The first ``own`` words are its
    own; up to ``longest`` - 1 words of the last piece follow as context.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return texts.mapInArrow(_parse(longest, trigger), CHUNKS).groupBy("lang", "own", "chunk").agg(F.count("*").alias("f"))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to tables of about ``SLICE`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= SLICE:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class _Grams:
    """The words of a table of chunks: spans, keys of words and pairs, weights, and how far a phrase may run."""

    def __init__(self, t: pa.Table):
        self.data, offsets = flat(t["chunk"])
        self.ends = np.flatnonzero((self.data == 32) | (self.data == 10))  # one after every word
        self.starts = np.r_[0, self.ends[:-1] + 1]
        at = np.searchsorted(offsets, self.starts, "right") - 1
        last = (self.data[self.ends] == 10) | np.r_[at[1:] != at[:-1], True]
        begin = np.searchsorted(at, np.arange(t.num_rows))
        self.own = np.arange(len(at)) - begin[at] < t["own"].to_numpy()[at]
        self.weight = t["f"].to_numpy()[at]
        langs = t["lang"].combine_chunks().dictionary_encode()
        langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
        self.langs, code = langs.dictionary, langs.indices.to_numpy()
        self.lang = code[at]
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs.to_pylist()], np.uint64)
        up, down = powers(len(self.data))
        total = np.append(np.uint64(0), np.cumsum(_TABLE[self.data] * up[: len(self.data)], dtype=np.uint64))
        self.words = mix(mix((total[self.ends] - total[self.starts]) * down[self.starts]) + salt[self.lang])
        self.goes = ~last  # on to the next word
        self.pairs = np.zeros(len(at), np.uint64)
        self.pairs[:-1] = mix(self.words[:-1] * _PAIR[0] + self.words[1:] * _PAIR[1])


    def runs(self, longest: int, pair_known: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(m, first words, keys) of the owned phrases of 3 to ``longest`` words whose pairs are all known."""
        on, keys = self.own.copy(), self.words
        for m in range(2, longest + 1):
            n = len(self.words) - m + 1
            if n <= 0:
                return
            on = on[:n] & pair_known[m - 2 :][:n]
            keys = mix(keys[:n] * _PAIR[0] + self.words[m - 1 :] * _PAIR[1] + np.uint64(m))
            if m > 2:
                at = np.flatnonzero(on)
                yield m, at, keys[at]


def _folded(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """An array of counts in as few bytes a number as they need, like bytes next to each other."""
    size = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * w)
    return bytes([size]) + np.ascontiguousarray(x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes()


def _unplaned(data: bytes, n: int) -> tuple[np.ndarray, bytes]:
    size = data[0]
    x = np.frombuffer(data, np.uint8, n * size, 1).reshape(size, n).T
    return np.ascontiguousarray(x).view(f"<u{size}").ravel().astype(np.int64), data[1 + n * size :]


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys by their differences, and counts less one, compressed."""
    body = _planes(np.diff(keys.astype(np.int64), prepend=0)) + _planes(counts - 1)
    return len(keys).to_bytes(8, "little") + len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    steps, rest = _unplaned(pa.decompress(blob[16:], decompressed_size=size, codec="zstd", asbytes=True), n)
    return np.cumsum(steps), _unplaned(rest, n)[0] + 1


#: Keys that a task puts together before it sends them on.
HELD = 1 << 22


def _often(chunks: DataFrame, keys_of, bits: int, least: int) -> DataFrame:
    """(k): the keys whose weights reach ``least``; ``keys_of`` gives (keys, weights) of the phrases of a table.

    Keys are cut to ``bits`` bits, sorted and sent as compressed runs by their
    leading bits, a few bytes a key; a task then adds up the runs of one range.
    """
    parts = max(6, bits - 12 - 23)  # bits of a range: 64 ranges at least, 8 million keys a range
    shift = np.uint64(64 - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0

        def sent() -> pa.RecordBatch:
            k, f = _folded(keys, counts)
            part = k >> np.uint64(bits - parts)
            at = edges(part)
            blobs = [_pack(k[i:j] - (part[i] << np.uint64(bits - parts)), f[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part[at[:-1]].astype(np.int64)), pa.array(blobs, pa.binary())], ["part", "blob"])

        for t in _together(batches):
            k, f = keys_of(_Grams(t))
            if len(k):
                one = _folded([k >> shift], [f])
                keys.append(one[0])
                counts.append(one[1])
                size += len(one[0])
            if size > HELD:
                k, f = _folded(keys, counts)
                keys, counts, size = [k], [f], len(k)
                if size > HELD // 2:
                    yield sent()
                    keys, counts, size = [], [], 0
        if size:
            yield sent()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, keys, counts = None, [], []

        def often() -> pa.RecordBatch:
            k, f = _folded(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array((k + (own << (bits - parts)))[f >= least])], ["k"])

        for b in batches:
            for part, blob in zip(b["part"].to_pylist(), b["blob"], strict=True):
                if part != own and keys:
                    yield often()
                    keys, counts = [], []
                own = part
                k, f = _unpack(blob.as_py())
                keys.append(k)
                counts.append(f)
                if sum(map(len, keys[1:])) > HELD:
                    one = _folded(keys, counts)
                    keys, counts = [one[0]], [one[1]]
        if keys:
            yield often()

    sent = chunks.mapInArrow(send, "part long, blob binary").repartition(max(partitions(chunks.sparkSession), 1 << parts - 2), "part")
    return staged(sent.sortWithinPartitions("part").mapInArrow(add, "k long"), "often")


def _words_and_pairs(g: _Grams) -> tuple[np.ndarray, np.ndarray]:
    two = g.own & g.goes
    return np.r_[g.words[g.own], g.pairs[two]], np.r_[g.weight[g.own], g.weight[two]]


class _Known:
    """A filter of cut keys that tasks look keys up in."""

    def __init__(self, keys: DataFrame, bits: int):
        self.sent, self.shift = keys.sparkSession.sparkContext.broadcast(_filter(keys)), np.uint64(64 - bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        packed = self.sent.value
        at = _slot(keys >> self.shift, 8 * len(packed))
        return packed[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1

    def pairs(self, g: _Grams) -> np.ndarray:
        out = np.zeros(len(g.words), bool)
        out[g.goes] = self.has(g.pairs[g.goes])
        return out


def _longer(known: _Known, longest: int):
    def keys_of(g: _Grams) -> tuple[np.ndarray, np.ndarray]:
        found = [(k, g.weight[at]) for _, at, k in g.runs(longest, known.pairs(g))]
        return (np.concatenate([k for k, _ in found]), np.concatenate([f for _, f in found])) if found else (g.words[:0], g.weight[:0])

    return keys_of


def _counted(known: _Known, more: _Known | None, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _together(batches):
            g = _Grams(t)
            n = np.bincount(g.lang[g.own], g.weight[g.own], len(g.langs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([g.langs, pa.array([""] * len(n)), pa.array(n)], ["lang", "phrase", "f"])
            pair = known.pairs(g)
            found = [(1, np.flatnonzero(g.own & known.has(g.words))), (2, np.flatnonzero(g.own & pair))]
            if more:
                found += [(m, at[more.has(k)]) for m, at, k in g.runs(longest, pair)]
            for m, at in found:
                if not len(at):
                    continue
                s, e = g.starts[at], g.ends[at + m - 1]
                texts = _text_array(g.data[ragged(s, e - s)], np.cumsum(e - s)).dictionary_encode()
                both, where = np.unique(texts.indices.to_numpy().astype(np.int64) * len(g.langs) + g.lang[at], return_inverse=True)
                f = np.bincount(where, g.weight[at], len(both)).astype(np.int64)
                phrase = texts.dictionary.take(pa.array(both // len(g.langs))).cast(pa.string())
                yield pa.RecordBatch.from_arrays([g.langs.take(pa.array(both % len(g.langs))), phrase, pa.array(f)], ["lang", "phrase", "f"])

    return run


def phrase_counts(chunks: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """(lang, phrase, f): all phrases of 1 to ``longest`` words with f >= ``least``; the empty phrase counts every word of its lang.

    Two counts of cut hashes come first: of words and pairs, then of longer
    phrases all of whose pairs passed. Hashes have 12 bits more than the number
    of words has, and filters over those that reach ``least`` are 64 MB at most.
    What they let through by mistake costs shuffle only, since the last count
    is of bytes.
    """
    words = chunks.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]
    bits = min(63, max(30, int(words).bit_length() + 12))
    known = _Known(_often(chunks, _words_and_pairs, bits, least), bits)
    more = _Known(_often(chunks, _longer(known, longest), bits, least), bits) if longest > 2 else None
    counts = chunks.mapInArrow(_counted(known, more, longest), COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return staged(counts.where((F.col("f") >= least) | (F.col("phrase") == "")), "phrases")


def _with_parts(cuts: DataFrame, phrases: DataFrame) -> DataFrame:
    """``cuts`` with g, the count of each part.

    Phrases of one length occur no more often than words, so those with a
    ten-thousandth of all words or more are few at any size: they are
    broadcast, and no part that is left has more than that share of the rows.
    """
    total = phrases.where("phrase = ''").agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    known = phrases.where("phrase <> ''").select("lang", F.col("phrase").alias("part"), F.col("f").alias("g"))
    hot = F.col("g") >= max(1, total // 10_000)
    cuts = staged(cuts, "cuts")
    met = cuts.join(F.broadcast(known.where(hot)), ["lang", "part"], "left")
    return met.where("g is not null").unionByName(met.where("g is null").drop("g").join(known.where(~hot), ["lang", "part"]))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000, trigger: int = TRIGGER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``longest`` words of every lang.

    A-Z are lower-cased; texts are split at ``[.,;:!?\\x0A-\\x0D]`` into
    pieces and those at blanks and tabs into words. a is the count of a
    phrase; of all cuts in two, the one with the lowest
    score = floor(1000000 a a / (l r)) counts, then the earliest. Phrases that
    some longer candidate holds in at least ``inside`` percent of their
    occurrences are dropped. Ordered by score, count and the phrase's bytes.

    Null and empty texts hold no word; a null lang is ``und``, and equal to
    it; repeated rows count each; an empty table gives no rows. Columns other
    than text and lang are ignored, so none clashes. Long texts are parsed in
    spans that end between pieces. ``trigger`` changes the chunks only: one
    word in so many ends one.
    """
    spark = docs.sparkSession
    phrases = phrase_counts(staged(parse(docs, longest, trigger), "chunks"), longest, least)
    words = F.split("phrase", " ")
    candidates = phrases.where("instr(phrase, ' ') > 0").select("lang", "phrase", F.col("f").alias("a"), F.size(words).alias("w"))
    at = candidates.select("*", F.explode(F.expr("sequence(1, w - 1)")).alias("k"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.expr("substring_index(phrase, ' ', k)").alias("part")), F.struct(F.lit(1).alias("side"), F.expr("substring_index(phrase, ' ', k - w)").alias("part")))
    parts = _with_parts(at.select("lang", "phrase", "a", "k", F.explode(sides).alias("x")).select("lang", "phrase", "a", "k", "x.*"), phrases)
    cut = parts.groupBy("lang", "phrase", "a", "k").agg(F.max(F.expr("if(side = 0, g, null)")).alias("l"), F.max(F.expr("if(side = 1, g, null)")).alias("r"))
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    cut = cut.withColumn("score", F.expr(f"({wide('a')} * {wide('a')} * 1000000) div ({wide('l')} * {wide('r')})"))
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    spans = F.expr("flatten(transform(sequence(2, w - 1), m -> transform(sequence(0, w - m), i -> array_join(slice(split(phrase, ' '), i + 1, m), ' '))))")
    held = candidates.where("w > 2").select("lang", F.col("a").alias("by"), F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("by").alias("by"))
    kept = best.join(held, ["lang", "phrase"], "left").where(F.expr(f"by is null or 100 * by < {inside} * a")).drop("by")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of every lang are among the best of its parts, so no task ranks a whole lang
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(partitions(spark)))).orderBy(*order)
    few = kept.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = phrases.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
