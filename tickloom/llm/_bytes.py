"""Vectorised work on the UTF-8 bytes of whole Arrow text columns.

Texts are taken where Arrow holds them, as one byte buffer with offsets.
Everything here handles one Arrow batch inside a Spark task; memory stays
near a few times ``CHUNK`` whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
#: [\x20\x09-\x0D]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    big = column.type in (pa.large_string(), pa.large_binary())
    kind = np.int64 if big else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds texts of about ``most`` bytes, or one longer text: what bounds a task's memory."""
    for b in batches:
        ends = np.cumsum(np.r_[0, pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False)])
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK * 2)
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = out
    return _powers[0], _powers[1]


def _cuts(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of about CHUNK bytes that no word crosses."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + CHUNK)
        while hi < n:
            doc = int(offsets[np.searchsorted(offsets, hi)])
            found = np.flatnonzero(sep[data[hi : min(doc, hi + CHUNK)]])
            if len(found):
                hi += int(found[0])
                break
            hi = min(doc, hi + CHUNK)
            if hi == doc:
                break
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word, in order.

    A word is a longest run of bytes that are not in ``sep`` and never
    crosses texts; ``fold`` maps bytes before they are hashed.
    """
    table, hashes, docs = _TABLE[fold], [], []
    for lo, hi in _cuts(data, offsets, sep):
        b = data[lo:hi]
        inside = ~sep[b]
        edge = np.zeros(len(b) + 1, bool)
        edge[0] = edge[-1] = True
        first, last = np.searchsorted(offsets, lo), np.searchsorted(offsets, hi, "right")
        edge[offsets[first:last] - lo] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:-1]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        if not len(s):
            continue
        up, down = powers(len(b))
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(table[b] * up[: len(b)], dtype=np.uint64, out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s]))
        docs.append(np.searchsorted(offsets, s + lo, "right") - 1)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(docs)


_MULT = (np.random.default_rng(7).integers(1, 1 << 63, 16, dtype=np.uint64) << U64(1)) | U64(1)


def shingles(hashes: np.ndarray, docs: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of ``size`` words; a shorter text gives its whole sequence as one."""
    n = len(hashes)
    out, at = [], []
    if n >= size:
        same = np.flatnonzero(docs[: n - size + 1] == docs[size - 1 :])
        h = np.zeros(len(same), np.uint64)
        for k in range(size):
            h += hashes[same + k] * _MULT[k]
        out.append(mix(h))
        at.append(docs[same])
    if n:
        first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        count = np.diff(np.r_[first, n])
        for m in range(1, size):
            f = first[count == m]
            if len(f):
                h = np.full(len(f), m, np.uint64)
                for k in range(m):
                    h += hashes[f + k] * _MULT[k]
                out.append(mix(h))
                at.append(docs[f])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, d = np.concatenate(out), np.concatenate(at)
    if len(out) > 1:
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of a column."""
    data, offsets = flat(column)
    h, d = shingles(*words(data, offsets), size)
    edges = np.searchsorted(d, np.arange(len(offsets)))
    for i in range(len(offsets) - 1):
        yield i, np.unique(h[edges[i] : edges[i + 1]])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0].., starts[1].. of runs of the given lengths, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)
