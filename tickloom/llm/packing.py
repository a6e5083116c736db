"""Sequence packing by non-negative least squares over a length histogram.

Documents become pieces: whole windows and one rest. The histogram of piece
lengths, in bins of ``grid`` tokens, has window/grid entries whatever the
corpus; short pieces of equal length are bundled to fill their bins. Shallow combinations of bins that fill a window exactly are the columns
of a matrix, their repeat counts are solved against the histogram by
non-negative least squares and rounded down, and what is left over is packed
greedily, largest first. Only the plan is made on the driver; pieces take
their places in it by their rank within their bin, on the executors.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._stage import staged

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")
#: What keeps a text from being cut by ``_PIECE``: all but ASCII and letters that stand alone in Latin-1.
_OTHER = re.compile("[^\\t-\\r -~À-ÖØ-öø-ÿ]")
#: The tokenizer's own cut of lower-cased text, its letters and digits written out.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\s0-9a-zß-öø-ÿ]+")
_open: dict[str, "WordEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Ids of texts from ids of their pieces or words, each encoded once.

    For tokenizers that drop white space before they look at words, as
    word_bpe_49k does: the ids of a text are then those of its words. Texts of
    plain letters and without added tokens are cut into the tokenizer's pieces,
    of which there are fewer: no case, no punctuation. Pieces and words are kept as packed little-endian
    ids, about ``most`` of them in two halves: when the newer is full the older
    goes, but for what was met since, so that what is frequent is not learned
    again.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.seen, self.stems = Tokenizer.from_file(path), most, {}, {}
        self.old_seen, self.old_stems = {}, {}
        self.whole = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def _stem(self, stem: str) -> bytes:
        got = self.old_stems.get(stem)
        if got is None:
            got = self._tokenized(stem)
        self.stems[stem] = got
        return got

    def _tokenized(self, stem: str) -> bytes:
        form = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(form)]).tobytes()

    def _learn(self, words: set[bytes]) -> None:
        seen, stems, before, odd, held = self.seen, self.stems, self.old_seen, [], []
        for w in words:
            if (known := before.get(w)) is not None:
                seen[w] = known
                continue
            stem = w.rstrip(b".,!?;:")
            if stem.isalpha():  # ASCII letters
                lower, tail = stem.lower().decode(), w[len(stem) :]
            elif m := _WORD.fullmatch(text := w.decode()):
                lower, tail = m[1].lower(), m[2].encode()
            else:
                odd.append(text)
                continue
            if not tail:
                seen[w] = stems.get(lower) or self._stem(lower)
            elif (end := seen.get(tail)) is not None:
                seen[w] = (stems.get(lower) or self._stem(lower)) + end
            else:
                held.append((w, lower, tail))
        odd += {tail.decode() for _, _, tail in held}
        if odd:
            for text, e in zip(odd, self.tokenizer.encode_batch(odd, add_special_tokens=False), strict=True):
                seen[text.encode()] = array("I", e.ids).tobytes()
        for w, lower, tail in held:
            seen[w] = (stems.get(lower) or self._stem(lower)) + seen[tail]

    def _learn_pieces(self, pieces: set[str]) -> None:
        for piece in pieces:
            self._stem(piece)

    def encode(self, text: str) -> bytes:
        lower, out = text.lower(), []
        plain = not _OTHER.search(text) and not any(t in lower for t in self.whole)
        units = _PIECE.findall(lower) if plain else text.encode().split()
        for k in range(0, len(units), 100_000):
            part = units[k : k + 100_000] if k or len(units) > 100_000 else units
            if len(self.seen) + len(self.stems) > self.most // 2:
                self.old_seen, self.old_stems = self.seen, self.stems
                self.seen, self.stems = {}, {}
            known = self.stems if plain else self.seen
            if new := set(part).difference(known):
                (self._learn_pieces if plain else self._learn)(new)
            out.append(b"".join(map(known.__getitem__, part)))
        return b"".join(out)


def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker, kept from task to task."""
    if path not in _open:
        _open[path] = WordEncoder(path)
    return _open[path]


def cut_documents(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document's ids in whole windows and a rest.

    A null or empty text is the end id alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for i, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                ids = enc.encode(text.as_py() or "") + end
                n = len(ids) // 4
                for s in range(0, n, window):
                    e = min(n, s + window)
                    for k, v in enumerate((i, s, e - s, zlib.crc32(memoryview(ids)[4 * s : 4 * e]), n)):
                        rows[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def fillings(bins: list[int], full: int) -> list[dict[int, int]]:
    """Shallow ways to fill ``full`` exactly: three, two or one of the bins, or one bin over and over with at most one other."""
    have, out = set(bins), {}
    for k, a in enumerate(bins):
        for m in range(1, full // a + 1):
            r = full - m * a
            if r == 0 or r in have:
                one = {a: m}
                if r:
                    one[r] = one.get(r, 0) + 1
                out[tuple(sorted(one.items()))] = one
        for b in bins[k:]:
            c = full - a - b
            if c < b:
                break
            if c in have:
                one = {}
                for x in (a, b, c):
                    one[x] = one.get(x, 0) + 1
                out[tuple(sorted(one.items()))] = one
    return [out[k] for k in sorted(out)]


def nnls(a: np.ndarray, h: np.ndarray, rounds: int = 0) -> np.ndarray:
    """x >= 0 that makes ||a x - h|| least, by an active set: columns enter by gradient and leave when they would go negative."""
    n = a.shape[1]
    x, inside = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(h.max(initial=0)))
    for _ in range(rounds or 3 * len(h)):
        w = a.T @ (h - a @ x)
        w[inside] = -np.inf
        j = int(w.argmax()) if n else 0
        if not n or w[j] <= tol:
            break
        inside[j] = True
        while True:
            p = np.flatnonzero(inside)
            g = a[:, p].T @ a[:, p]
            z = np.linalg.solve(g + 1e-10 * np.eye(len(p)), a[:, p].T @ h)
            if (z > 0).all():
                x[:] = 0
                x[p] = z
                break
            neg = z <= 0
            step = np.min(x[p][neg] / np.maximum(x[p][neg] - z[neg], 1e-300))
            x[p] += step * (z - x[p])
            drop = p[(x[p] <= 1e-12) & neg]
            if not len(drop):
                drop = p[neg][[0]]
            inside[drop] = False
            x[drop] = 0
    return x


def plan(histogram: dict[int, int], full: int) -> list[tuple[dict[int, int], int]]:
    """[(bins of a sequence with multiplicity, sequences of that kind)] that places every piece of ``histogram``."""
    left = {b: int(c) for b, c in histogram.items() if c > 0}
    bins = sorted(left)
    if not bins:
        return []
    kinds = fillings(bins, full)
    row = {b: k for k, b in enumerate(bins)}
    a = np.zeros((len(bins), len(kinds)))
    for j, kind in enumerate(kinds):
        for b, m in kind.items():
            a[row[b], j] = m
    h = np.array([left[b] for b in bins], float)
    count = np.floor(nnls(a, h) + 1e-6).astype(np.int64)
    rest = np.array([left[b] for b in bins], np.int64) - a.astype(np.int64) @ count
    for k in np.flatnonzero(rest < 0):  # rounding never takes a piece twice
        for j in np.flatnonzero((a[k] > 0) & (count > 0)):
            if rest[k] >= 0:
                break
            cut = min(int(count[j]), -(int(rest[k]) // int(a[k, j])))
            count[j] -= cut
            rest += cut * a[:, j].astype(np.int64)
    out = [(kinds[j], int(count[j])) for j in np.flatnonzero(count)]
    left = {b: int(c) for b, c in zip(bins, rest, strict=True) if c}
    while left:
        room, kind = full, {}
        for b in sorted(left, reverse=True):
            m = min(room // b, left[b])
            if m:
                kind[b] = m
                room -= m * b
        times = max(1, min(left[b] // m for b, m in kind.items()))
        out.append((kind, times))
        for b, m in kind.items():
            left[b] -= m * times
            if not left[b]:
                del left[b]
    return out


def bundle(length: int, window: int, grid: int) -> int:
    """How many pieces of one length to place as one: the power of two that leaves least of the last bin empty for each, within a quarter of the window."""
    m = best = 1
    while 2 * m <= grid and 8 * m * length <= window:
        m *= 2
        if -m * length % grid * best < -best * length % grid * m:
            best = m
    return best


def pack(pieces: DataFrame, window: int = 4096, grid: int = 16, run: int = 4096) -> DataFrame:
    """``pieces`` (doc_id, start, length, ...) with ``sequence_id`` and ``offset``; no sequence is longer than ``window``.

    ``window`` must be a multiple of ``grid``; a piece is 1 to ``window`` long.
    Short pieces of equal length go in bundles that fill their bins, so a table
    of short texts is not padded bin by bin. The counts of lengths, at most
    ``window`` rows, are all that reaches the driver. Equal lengths are ranked
    in runs of about ``run`` rows, so one length that most pieces share is many
    small windows. An empty table gives none.
    """
    spark, full = pieces.sparkSession, window // grid
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram, kinds = {}, []
    for length, n in sorted(counts.items()):
        m, row = bundle(length, window, grid), []
        for size, items in ((m * length, n // m), (length, n % m)):  # bundles, and the pieces left over
            b = -(-size // grid)
            row += [b, histogram.get(b, 0)]
            histogram[b] = histogram.get(b, 0) + items
        kinds.append((length, max(1, -(-n // run)), m, n // m * m, *row))
    histogram = {b: n for b, n in histogram.items() if n}
    parts, base, used = [], 0, dict.fromkeys(histogram, 0)
    for kind, times in plan(histogram, full):
        for b, m in kind.items():
            parts.append((b, used[b], used[b] + m * times, base, m))
            used[b] += m * times
        base += times
    assert used == histogram
    places = spark.createDataFrame(parts, "_place int, _lo long, _hi long, _base long, _m long")
    kinds = spark.createDataFrame(kinds, "length long, _runs long, _many long, _bundled long, _bin int, _at long, _bin_one int, _at_one long")
    dealt = pieces.join(F.broadcast(kinds), "length").withColumn("_sub", F.pmod(F.xxhash64("doc_id", "start"), F.col("_runs")))
    subs = dealt.groupBy("length", "_sub").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    subs = subs.select("length", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("length", "_sub").orderBy("doc_id", "start")) - 1
    ranked = dealt.withColumn("_rank", rank).join(subs, ["length", "_sub"]).withColumn("_rank", F.col("_rank") + F.col("_first"))
    within = F.col("_rank") < F.col("_bundled")
    item = F.when(within, F.col("_at") + F.floor(F.col("_rank") / F.col("_many"))).otherwise(F.col("_at_one") + F.col("_rank") - F.col("_bundled"))
    ranked = ranked.withColumn("_item", item).withColumn("_bin", F.when(within, F.col("_bin")).otherwise(F.col("_bin_one")))
    placed = ranked.join(F.broadcast(places), (F.col("_bin") == F.col("_place")) & (F.col("_item") >= F.col("_lo")) & (F.col("_item") < F.col("_hi")))
    placed = placed.withColumn("sequence_id", F.col("_base") + F.floor((F.col("_item") - F.col("_lo")) / F.col("_m")))
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("_bin"), "_item", "length", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, grid: int = 16) -> DataFrame:
    """Cuts and packs all documents: PIECES with sequence_id and offset.

    Rows that repeat are packed as often as they occur. Columns other than
    doc_id and text are ignored. Tokens are made once; only pieces (never ids)
    are written and shuffled.
    """
    return pack(staged(cut_documents(docs, tokenizer, window, end_id), "pieces"), window, grid)
