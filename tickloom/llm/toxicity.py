"""Toxicity by class-conditional Kneser-Ney models.

Word pairs are counted for the toxic and the ordinary class over labelled
texts, a pair once a text. A class's P(word | word before) is discounted, and
what the discounts free goes to the class's P(word), whose counts are of the
distinct words before a word (continuations), not of its occurrences. That is
discounted too, and what it frees goes to one distribution that both classes
share: a word's part of the distinct pairs of all documents. Pairs found in one
text only are discounted whole, so they lean on their words altogether.

A text's score comes from the difference of the two log-likelihoods, normalised
by length: over the text, over its worst passage and over its worst
expressions, turned into a probability by a logistic fit on texts that the
models did not count. An expression's difference is damped by how often it was
counted, so that chance sightings hardly speak for a class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import LOWER, flat, mix, slices, words
from ._stage import partitions, staged

#: Words are runs of ASCII letters and of bytes above 127.
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[65:91] = _SEPARATOR[97:123] = _SEPARATOR[128:] = False
PASSAGE, WORST = 4, 5
DISCOUNT = 0.75
#: An expression counted n times has n / (n + LEAN) of its own evidence; the same at every table size.
LEAN = 8
#: Places for words outside the vocabulary, as words before one: 2 to a power that grows with the bytes of all texts.
LEAST_BITS = 24
_BUCKETS = 4096


def _text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return words(*flat(column), _SEPARATOR, LOWER)


def _places(vocabulary: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each word in a sorted vocabulary, -1 for others."""
    if not len(vocabulary):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at, -1)


def _before(at: np.ndarray, d: np.ndarray, start: int) -> np.ndarray:
    """The place of the word before each word, ``start`` at a text's beginning."""
    out = np.r_[start, at[:-1]] if len(at) else at
    return np.where(np.r_[True, d[1:] != d[:-1]], start, out) if len(at) else out


def _packed(codes: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Growing codes as steps of seven bits a byte, the last byte of a step below 128; a value for each run that begins at ``cut``, which counts from 0."""
    steps = np.diff(codes, prepend=np.int64(0))
    steps[cut] = codes[cut]
    steps = steps.astype(np.uint64)
    size = np.ones(len(steps), np.int64)
    for k in range(1, 10):
        size += steps >= np.uint64(1) << np.uint64(7 * k)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        byte = (steps[some] >> np.uint64(7 * k)) & np.uint64(127)
        out[(end - size)[some] + k] = byte | np.where(size[some] > k + 1, 128, 0).astype(np.uint64)
    offsets = np.r_[(end - size)[cut], len(out)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def _unpacked(blob: bytes) -> np.ndarray:
    b = np.frombuffer(blob, np.uint8)
    end = np.flatnonzero(b < 128) + 1
    start = np.r_[0, end[:-1]]
    out = np.zeros(len(end), np.uint64)
    for k in range(int((end - start).max(initial=0))):
        some = end - start > k
        out[some] |= (b[start[some] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return np.cumsum(out).astype(np.int64)


def other_bits(text_bytes: int) -> int:
    """Bits that tell words outside the vocabulary: places for sixteen times the words that n running ones may hold, n to the three quarters."""
    return min(40, max(LEAST_BITS, 4 + math.ceil(0.75 * math.log2(max(text_bytes, 2) / 6 + 1))))


def _preceded(sent, others: int, most: int = 3 << 20):
    """(bucket, codes): a task's distinct pairs of a vocabulary word and the word before it, or the start of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        v = len(vocabulary)
        base = v + 1 + others
        per = -(-v * base // _BUCKETS)

        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            codes = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
            bucket = codes // per
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(codes) else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), _packed(codes - bucket * per, cut)], ["bucket", "codes"])

        held, n = [], 0
        for b in slices(batches):
            h, d = _text_words(b["text"])
            if len(h):
                at = _places(vocabulary, h)
                seen = np.where(at >= 0, at, v + 1 + (mix(h) % np.uint64(others)).astype(np.int64))
                held.append(np.unique((at * base + _before(seen, d, v))[at >= 0]))
                n += len(held[-1])
            if n >= most:
                yield out(held)
                held, n = [], 0
        yield out(held)

    return run


def _types(v: int, others: int):
    """(word, n) from sorted (bucket, codes): how many distinct words come before each word; one bucket is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = v + 1 + others
        per = -(-v * base // _BUCKETS)

        def out(bucket: int | None, held: list[np.ndarray]) -> pa.RecordBatch:
            codes = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
            word, n = np.unique((codes + (bucket or 0) * per) // base, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], ["word", "n"])

        bucket, held, fresh = None, [], 0
        for b in batches:
            for k, blob in zip(b["bucket"].to_pylist(), b["codes"], strict=True):
                if k != bucket:
                    yield out(bucket, held)
                    bucket, held, fresh = k, [], 0
                held.append(_unpacked(blob.as_buffer()))
                fresh += len(held[-1])
                if fresh > 1 << 21:
                    held, fresh = [np.unique(np.concatenate(held))], 0
        yield out(bucket, held)

    return run


def continuations(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """After how many distinct words, the start of a text among them, each word of a sorted vocabulary is found in ``docs``.

    Every text counts. Tasks send their distinct pairs as packed steps of a few
    bytes each; words outside the vocabulary are told by ``other_bits`` of the
    bytes of all texts, so that counts go on growing with the corpus.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    others = 1 << other_bits(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    packed = docs.select("text").mapInArrow(_preceded(sent, others), "bucket int, codes binary")
    dealt = packed.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    counts = dealt.mapInArrow(_types(len(vocabulary), others), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary))
    out[counts["word"].to_numpy()] = counts["n"].to_numpy()
    return out


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(0, np.uint64)
    for b in slices(batches):
        seen = np.union1d(seen, _text_words(b["text"])[0])
    yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64))], ["h"])


SLOTS = [f"n{k}" for k in range(4)]  # texts by 2 * fold + class


def _tally(sent):
    """(word, first, n0..n3): texts that hold each pair of a word and the one before it, whose place is the vocabulary's size at a text's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = len(sent.value)
        for b in slices(batches):
            h, d = _text_words(b["text"])
            if not len(h):
                continue
            at = _places(sent.value, h)
            pair = at * (v + 1) + _before(at, d, v)
            order = np.lexsort((d, pair))
            pair, d = pair[order], d[order]
            once = np.r_[True, (pair[1:] != pair[:-1]) | (d[1:] != d[:-1])]  # a pair counts once a text, however often it repeats there
            pair, slot = pair[once], (b["fold"].to_numpy() * 2 + b["toxic"].to_numpy())[d[once]]
            new = np.r_[True, pair[1:] != pair[:-1]]
            group = np.cumsum(new) - 1
            n = [np.bincount(group[slot == s], minlength=int(group[-1]) + 1).astype(np.int32) for s in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array((pair[new] // (v + 1)).astype(np.int32)), pa.array((pair[new] % (v + 1)).astype(np.int32)), *map(pa.array, n)], ["word", "first", *SLOTS])

    return run


#: Which folds a model counts: one, the other, both.
VIEWS = {"0": [0], "1": [1], "b": [0, 1]}


def _counted(view: str, toxic: int):
    return sum((F.col(f"n{2 * f + toxic}") for f in VIEWS[view]), F.lit(0))


@dataclass
class Counts:
    """Counts of one class in one view: continuations by word, and by context its pairs, those of one text and those of more."""

    before: np.ndarray
    pairs: np.ndarray
    once: np.ndarray
    more: np.ndarray


@dataclass
class ClassModel:
    """P(word) and P(word | word before) of one class; ``shared`` sums to one with the mass of unknown words."""

    counts: Counts
    shared: np.ndarray

    def __post_init__(self):
        total, types = self.counts.before.sum(), (self.counts.before > 0).sum()
        self.free = DISCOUNT * types / total if total else 1.0
        self.word = np.maximum(self.counts.before - DISCOUNT, 0) / max(total, 1) + self.free * self.shared

    def backoff(self, first: np.ndarray) -> np.ndarray:
        """What a context leaves to P(word): all of it where the class never saw the context."""
        c, n = self.counts, np.maximum(self.counts.pairs[first], 1)
        return np.where(c.pairs[first] > 0, (c.once[first] + DISCOUNT * c.more[first]) / n, 1.0)

    def pair(self, n: np.ndarray, first: np.ndarray, word: np.ndarray) -> np.ndarray:
        own = np.where(n > 1, n - DISCOUNT, 0) / np.maximum(self.counts.pairs[first], 1)
        return own + self.backoff(first) * self.word[word]


@dataclass
class Model:
    """Damped log-likelihood differences of words and pairs, and the logistic weights."""

    vocabulary: np.ndarray
    word: np.ndarray
    pair: np.ndarray
    pair_ratio: np.ndarray
    prior: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    classes: list[ClassModel] = field(default_factory=list)

    def features(self, column: pa.Array) -> np.ndarray:
        """Per text: mean difference, that of the worst PASSAGE words, sum of the WORST worst expressions, all of a text's words."""
        n = len(column)
        h, d = _text_words(column)
        out = np.zeros((n, 3))
        if not len(h) or not len(self.vocabulary):
            return out
        v, at = len(self.vocabulary), _places(self.vocabulary, h)
        x = np.where(at >= 0, self.word[at], 0.0)
        if len(self.pair):
            first = _before(at, d, v)
            both = np.flatnonzero((at >= 0) & (first >= 0))
            key = at[both] * (v + 1) + first[both]
            k = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            hit = self.pair[k] == key
            x[both[hit]] = self.pair_ratio[k[hit]]
        length = np.bincount(d, minlength=n)
        out[:, 0] = np.bincount(d, x, minlength=n) / np.maximum(length, 1)
        total = np.r_[0.0, np.cumsum(x)]
        have = np.flatnonzero(length)
        start = np.searchsorted(d, have)
        i = np.arange(len(h))
        end = np.minimum(i + PASSAGE, np.searchsorted(d, d, "right"))
        out[have, 1] = np.maximum.reduceat(total[end] - total[i], start) / PASSAGE
        bad = np.flatnonzero(x > 0)
        order = bad[np.lexsort((-x[bad], d[bad]))]
        rank = np.arange(len(order)) - np.searchsorted(d[order], d[order])
        order = order[rank < WORST]
        out[:, 2] = np.bincount(d[order], x[order], minlength=n)
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(column), self.prior)
        x = self.features(column)
        z = x @ self.weights[1:] + self.weights[0]
        return np.where((x != 0).any(1), 1 / (1 + np.exp(-np.clip(z, -500, 500))), self.prior)


def _own(n: np.ndarray) -> np.ndarray:
    """The share that an expression's own counts have in its difference."""
    return n / (n + LEAN)


def fitted(vocabulary: np.ndarray, shared: np.ndarray, classes: list[Counts], word: np.ndarray, first: np.ndarray, n: np.ndarray) -> Model:
    """A model from the counts of the ordinary and the toxic class; pairs (word, first) were found in ``n`` (pairs, 2) texts."""
    ordinary, toxic = (ClassModel(c, shared) for c in classes)
    ratio = _own(ordinary.counts.before + toxic.counts.before) * (np.log(toxic.word) - np.log(ordinary.word))
    both = np.log(toxic.pair(n[:, 1], first, word)) - np.log(ordinary.pair(n[:, 0], first, word))
    own = _own(n.sum(1))
    return Model(vocabulary, ratio, word.astype(np.int64) * (len(vocabulary) + 1) + first, own * both + (1 - own) * ratio[word], classes=[ordinary, toxic])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Intercept and weights by Newton steps on standardised columns."""
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.c_[np.ones(len(x)), (x - mean) / sd]
    w = np.zeros(z.shape[1])
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    keep = np.eye(len(w)) * ridge
    keep[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + keep, z.T @ (y - p) - keep @ w)
        w += np.clip(step, -4, 4)
        if abs(step).max() < 1e-8:
            break
    return np.r_[w[0] - (w[1:] * mean / sd).sum(), w[1:] / sd]


def _columns(df: DataFrame, key: str, size: int) -> dict[str, np.ndarray]:
    """Columns of a small table by place; places it lacks hold 0."""
    got, out = df.toArrow(), {}
    at = got[key].to_numpy()
    for c in got.column_names:
        if c != key:
            out[c] = np.zeros(size, np.int32)
            out[c][at] = got[c].to_numpy()
    return out


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, held_out: int | None = 2) -> Model:
    """Fit on labelled documents; the shared distribution is counted over all of ``docs``.

    labels: (doc_id, toxic 0/1); null or other labels are ignored, an id
    labelled twice counts as toxic if it is so once. At most ``most_labelled``
    rows, those of the lowest id hashes, are used, which bounds the model: its
    words, and of its pairs those that a class has in two texts or more.
    Rows whose crc32 of the id modulo 4 is ``held_out`` are never used. With a
    class missing, or no words, every score is the share of toxic labels.
    """
    spark = docs.sparkSession
    usable = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if held_out is not None:
        usable = usable.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != held_out)
    chosen = usable.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    texts = staged(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "fold"), "labelled")
    share = texts.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, toxic = share["n"], share["t"] or 0
    prior = toxic / n if n else 0.0
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), prior)
    if not 0 < toxic < n:
        return nothing
    vocabulary = np.sort(texts.select("text").mapInArrow(_vocabulary, "h long").distinct().toArrow()["h"].to_numpy().view(np.uint64))
    if not len(vocabulary):
        return nothing
    v, sent = len(vocabulary), spark.sparkContext.broadcast(vocabulary)
    kind = "word int, first int, " + ", ".join(f"{c} int" for c in SLOTS)
    pairs = staged(texts.mapInArrow(_tally(sent), kind).groupBy("word", "first").agg(*(F.sum(c).cast("int").alias(c) for c in SLOTS)), "pairs")
    models = [(view, t) for view in VIEWS for t in (0, 1)]
    by_word = _columns(pairs.groupBy("word").agg(*(F.count_if(_counted(*m) > 0).alias(f"{m[0]}{m[1]}") for m in models)), "word", v)
    sums = [f(_counted(*m)).alias(f"{c}{m[0]}{m[1]}") for m in models for c, f in (("s", F.sum), ("o", lambda x: F.count_if(x == 1)), ("m", lambda x: F.count_if(x > 1)))]
    often = pairs.where((_counted("b", 0) > 1) | (_counted("b", 1) > 1))
    asked = pairs.join(often.select("first").distinct(), "first", "left_semi")  # other contexts leave all to their words
    by_first = _columns(asked.groupBy("first").agg(*sums), "first", v + 1)
    often = often.orderBy("word", "first").toArrow()
    word, first, *slots = (often[c].to_numpy() for c in ("word", "first", *SLOTS))
    del often
    seen = continuations(docs, vocabulary)
    shared = (seen + 1) / (seen.sum() + v + 1)  # what is left is for words outside the vocabulary

    def model(view: str) -> Model:
        counts = [Counts(by_word[f"{view}{t}"], *(by_first[f"{c}{view}{t}"] for c in "som")) for t in (0, 1)]
        return fitted(vocabulary, shared, counts, word, first, np.stack([sum(slots[2 * f + t] for f in VIEWS[view]) for t in (0, 1)], 1))

    other = spark.sparkContext.broadcast([replace(model(view), classes=[]) for view in "10"])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fold = b["fold"].to_numpy()
            x = np.where((fold == 0)[:, None], *(other.value[f].features(b["text"]) for f in (0, 1)))
            yield pa.RecordBatch.from_arrays([b["toxic"].cast(pa.int64()), *(pa.array(x[:, k]) for k in range(3))], ["toxic", "x0", "x1", "x2"])

    got = texts.mapInArrow(described, "toxic long, x0 double, x1 double, x2 double").toArrow()
    y = got["toxic"].to_numpy().astype(float)
    x = np.stack([got[f"x{k}"].to_numpy() for k in range(3)], 1)
    order = np.lexsort((x[:, 2], x[:, 1], x[:, 0], y))
    out = model("b")
    out.prior, out.weights = prior, _logistic(x[order], y[order])
    return out


def score(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """``docs`` with ``column`` from 0 to 1; a text without a known word, null and empty ones too, scores the share of toxic labels.

    A column of that name must not be there yet. Rows that repeat are scored
    each; a text of any length is scored whole.
    """
    if column in docs.columns:
        raise ValueError(f"there is a column {column} already")
    sent = docs.sparkSession.sparkContext.broadcast(replace(model, classes=[]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.score(b["text"]))], [*b.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))
