"""Exact substring deduplication by sorting sampled suffixes, deep-shallow.

Every string of ``length`` bytes elects one suffix inside it, the one whose
first ``DEPTH`` bytes hash lowest, so equal strings elect suffixes with equal
beginnings and only about one suffix in 35 bytes is sorted. Suffixes are dealt
out by their first bytes. Most repeat along with all the strings that elected
them and are settled by comparing those stretches whole. The rest are sorted:
multikey quicksort to a shallow depth, then blind tries for the groups whose
common prefix is longer; longest common prefixes to the right and, of the
reversed texts, to the left give which strings are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import _TABLE, CHUNK, flat, mix, powers
from ._groups import blocks, edges
from ._stage import partitions, staged

DEPTH = 32
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _grams(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes at each position."""
    n = len(b) - 7
    h = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        h[o::8] = np.frombuffer(b[o : o + (n - o + 7) // 8 * 8].tobytes(), "<u8")
    h = mix(h * _A + _B)
    h = h[:-8] * _A + (h[8:] ^ (h[8:] >> np.uint64(29))) * _B
    h = h[:-16] * _B + (h[16:] ^ (h[16:] >> np.uint64(31))) * _A
    return mix(h)


def _leftmost_low(v: np.ndarray, width: int) -> np.ndarray:
    """The first place of the lowest value in v[i : i + width], for each i."""
    at, w = np.arange(len(v), dtype=np.int32), 1
    while w < width:
        step = min(w, width - w)
        left = v[:-step] <= v[step:]
        at = np.where(left, at[:-step], at[step:])
        v = np.where(left, v[:-step], v[step:])
        w += step
    return at


def elected(data: np.ndarray, offsets: np.ndarray, length: int) -> list[np.ndarray]:
    """Runs of strings that elect one suffix: text, first and last string start, the suffix's place (all within the text), its beginning's hash, the stretch's hash."""
    out = [[] for _ in range(6)]
    total = len(data)
    for lo in range(0, max(0, total - length + 1), CHUNK):
        hi = min(lo + CHUNK, total - length + 1)
        b = data[lo : hi + length - 1]
        grams = _grams(b)
        at = _leftmost_low((grams >> np.uint64(32)).astype(np.uint32), length - DEPTH + 1)
        valid = np.ones(hi - lo, bool)
        first, last = np.searchsorted(offsets, lo, "right"), np.searchsorted(offsets, hi + length)
        for end in offsets[first:last].tolist():
            valid[max(0, end - length + 1 - lo) : max(0, end - lo)] = False
        p = np.flatnonzero(valid)
        if not len(p):
            continue
        a = at[p]
        new = np.r_[True, (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]
        s = p[new]
        e = p[np.r_[np.flatnonzero(new)[1:] - 1, len(p) - 1]]
        a = a[new].astype(np.int64)
        up, down = powers(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_TABLE[b] * up[: len(b)], dtype=np.uint64, out=sums[1:])
        stretch = (sums[e + length] - sums[s]) * down[s]
        stretch = mix(stretch + (a - s).astype(np.uint64) * _A + (e - s).astype(np.uint64) * _B)
        text = np.searchsorted(offsets, s + lo, "right") - 1
        base = offsets[text] - lo
        for k, x in enumerate((text, s - base, e - base, a - base, grams[a], stretch)):
            out[k].append(x)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


SUFFIX = "gram long, stretch long, id long, at int, lead short, tail short, done boolean"


def _suffixes(length: int):
    """SUFFIX rows: strings start from at - lead to at - tail. ``done``: an earlier equal stretch is in this batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, s, e, a, gram, stretch = elected(*flat(b["text"]), length)
            if not len(text):
                continue
            ids = b["id"].to_numpy()[text]
            order = np.lexsort((a, ids, stretch, gram))
            gram, stretch, ids, s, e, a = (x[order] for x in (gram, stretch, ids, s, e, a))
            cut = edges(gram, stretch)
            head = np.repeat(cut[:-1], np.diff(cut))
            done = (ids != ids[head]) | (a != a[head])
            gram = np.where(done, mix(ids.astype(np.int64).view(np.uint64) * _A + a.astype(np.uint64)), gram)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(ids), pa.array(a.astype(np.int32)), pa.array((a - s).astype(np.int16)), pa.array((a - e).astype(np.int16)), pa.array(done)], [c.split()[0] for c in SUFFIX.split(", ")])

    return run


def _blind_trie(strings: list[bytes]) -> list[int]:
    """The order of strings, found by descending on branching bytes alone and comparing once at a leaf."""
    root: list | int = 0
    same: dict[int, list[int]] = {0: [0]}
    at = lambda s, k: s[k] if k < len(s) else -1
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while isinstance(node, list):
            node = node[1].get(at(s, node[0]), next(iter(node[1].values())))
        t = strings[node]
        if s == t:
            same[node].append(i)
            continue
        n = min(len(s), len(t))
        x = int.from_bytes(s[:n], "big") ^ int.from_bytes(t[:n], "big")
        common = n - (x.bit_length() + 7) // 8
        up, key, node = None, None, root
        while isinstance(node, list) and node[0] < common:
            up, key = node, at(s, node[0])
            node = node[1][key]
        if isinstance(node, list) and node[0] == common:
            node[1][at(s, common)] = i
        else:
            fresh = [common, {at(s, common): i, at(t, common): node}]
            if up is None:
                root = fresh
            else:
                up[1][key] = fresh
        same[i] = [i]
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        else:
            out += same[node]
    return out


def deep_shallow(m: np.ndarray, size: np.ndarray, group: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the rows of a zero-padded byte matrix within their groups.

    size: bytes of each row that count. lcp[i] is the common prefix of the i-th
    row in order with the one before it, -1 at the start of a group.
    """
    n, width = m.shape
    order, tie = np.argsort(group, kind="stable"), None
    tie = group[order]
    tie = np.cumsum(np.r_[False, tie[1:] != tie[:-1]])
    for k in range(0, min(shallow, width), 8):  # multikey quicksort, eight bytes a key, on ties only
        open_ = np.r_[False, tie[1:] == tie[:-1]]
        open_[:-1] |= open_[1:]
        at = np.flatnonzero(open_)
        if not len(at):
            break
        part = m[order[at], k : k + 8]
        if part.shape[1] < 8:
            part = np.pad(part, ((0, 0), (0, 8 - part.shape[1])))
        word = np.ascontiguousarray(part).view(">u8").ravel()
        inner = np.lexsort((word, tie[at]))
        order[at], word = order[at][inner], word[inner]
        new = np.zeros(n, bool)
        new[at[1:]] = (word[1:] != word[:-1]) & (at[1:] == at[:-1] + 1)
        tie = np.cumsum(np.r_[False, tie[1:] != tie[:-1]] | new)
    cut = edges(tie)
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if e - s > 1:  # a group with a longer common prefix
            rows = order[s:e]
            order[s:e] = rows[_blind_trie([m[r, : size[r]].tobytes() for r in rows])]
    lcp = np.full(n, -1)
    if n > 1:
        differ = m[order[1:]] != m[order[:-1]]
        common = np.where(differ.any(1), differ.argmax(1), width)
        common = np.minimum(common, np.minimum(size[order[1:]], size[order[:-1]]))
        lcp[1:] = np.where(group[order[1:]] == group[order[:-1]], common, -1)
    return order, lcp


def repeated(gram: np.ndarray, ids: np.ndarray, at: np.ndarray, lead: np.ndarray, tail: np.ndarray, context: np.ndarray, length: int) -> np.ndarray:
    """Of suffixes with their surroundings, a row for each: which strings, by lead, also start earlier among them.

    Rows must be sorted by gram, id and at. ``context`` holds length - DEPTH
    bytes before each suffix and ``length`` from it on.
    """
    n, room = len(gram), length - DEPTH
    _, group = np.unique(gram, return_inverse=True)
    right, to_right = deep_shallow(context[:, room:], (length - tail).astype(np.int64), group, DEPTH + 16)
    left, to_left = deep_shallow(np.ascontiguousarray(context[:, room - 1 :: -1] if room else context[:, :0])[:, :room], lead.astype(np.int64), group, 16)
    out = np.zeros((n, room + 1), bool)
    one, two = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(room + 1):
        rows = np.flatnonzero((tail <= d) & (d <= lead))
        if len(rows) < 2:
            continue
        one[right] = np.cumsum(to_right < length - d)
        two[left] = np.cumsum(to_left < d)
        key = one[rows] * (n + 1) + two[rows]
        order = rows[np.argsort(key, kind="stable")]
        cut = edges(one[order], two[order])
        head = np.repeat(order[cut[:-1]], np.diff(cut))
        out[order, d] = (ids[order] != ids[head]) | (at[order] != at[head])
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true in each row."""
    padded = np.pad(flags, ((0, 0), (1, 1))).astype(np.int8)
    step = np.diff(padded, axis=1)
    row, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    return row, first, last - 1


def _within(context: np.ndarray, lead: np.ndarray, tail: np.ndarray, length: int) -> np.ndarray:
    """``context`` with zeros outside the strings that are left: bytes beyond them would part rows that are equal within."""
    place = np.arange(DEPTH - length, length)
    return np.where((place >= -lead[:, None]) & (place < (length - tail)[:, None]), context, 0).astype(np.uint8)


ENTRY = "gram long, id long, at int, lead short, tail short, span boolean, context binary"


def _binary(m: np.ndarray) -> pa.Array:
    n, width = m.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(m).tobytes())])


def _settled(gram, ids, at, lead, tail, context, length: int, pass_on: bool) -> Iterator[pa.RecordBatch]:
    """Rows of ENTRY: repeated strings as spans (without context), and the others if they are passed on."""
    hit = repeated(gram, ids, at, lead, tail, context, length)
    d = np.arange(hit.shape[1])
    mine = (tail[:, None] <= d) & (d <= lead[:, None])
    for flags, span in ((hit, True), (mine & ~hit, False)):
        if not span and not pass_on:
            continue
        row, first, last = _runs(flags)
        if not len(row):
            continue
        g = mix(ids[row].view(np.uint64) * _A + at[row].astype(np.uint64)).view(np.int64) if span else gram[row]
        c = np.zeros((len(row), 0), np.uint8) if span else _within(context[row], last, first, length)
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(ids[row]), pa.array(at[row].astype(np.int32)), pa.array(last.astype(np.int16)), pa.array(first.astype(np.int16)), pa.array(np.full(len(row), span)), _binary(c)], [x.split()[0] for x in ENTRY.split(", ")])


def _surroundings(length: int):
    """Texts with their open suffixes to ENTRY rows, those settled within a batch as spans."""
    room = length - DEPTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                data, offsets = flat(b["text"])
                lists = b["open"]
                count = lists.value_lengths().to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(b.num_rows), count)
                o = lists.flatten()
                gram, at, lead, tail = (o.field(k).to_numpy().astype(np.int64) for k in range(4))
                ids = b["id"].to_numpy()[text]
                place = (offsets[text] + at)[:, None] + np.arange(-room, length)
                inside = (place >= 0) & (place < len(data))
                context = _within(np.where(inside, data[np.clip(place, 0, len(data) - 1)], 0), lead, tail, length)
                order = np.lexsort((at, ids, gram))
                yield from _settled(*(x[order] for x in (gram, ids, at, lead, tail, context)), length, True)

    return run


def _settle(length: int):
    """Sorted ENTRY rows to spans (id, start, end)."""
    width = 2 * length - DEPTH

    def spans(b) -> pa.RecordBatch:
        at, lead, tail = (b[c].to_numpy().astype(np.int64) for c in ("at", "lead", "tail"))
        return pa.RecordBatch.from_arrays([b["id"].combine_chunks() if isinstance(b["id"], pa.ChunkedArray) else b["id"], pa.array(at - lead), pa.array(at - tail + length)], ["id", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches, ["gram"]):
            known = t["span"].to_numpy()
            if known.any():
                yield spans(t.filter(pa.array(known)))
            t = t.filter(pa.array(~known))
            if t.num_rows < 2:
                continue
            gram, ids, at, lead, tail = (t[c].to_numpy().astype(np.int64) for c in ("gram", "id", "at", "lead", "tail"))
            cut = edges(gram)
            many = np.repeat(np.diff(cut) > 1, np.diff(cut))
            if not many.any():
                continue
            context = flat(t["context"])[0].reshape(-1, width)
            for b in _settled(*(x[many] for x in (gram, ids, at, lead, tail, context)), length, False):
                yield spans(b)

    return run


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(id, start, end): byte spans of texts (id, text) that, ``length`` bytes at a time, also start earlier.

    Spans of a text may overlap. Earlier: in a text of smaller id, or before in
    the same text. Ids must be unique and not null; a row that repeats whole
    counts once. Suffixes whose stretch repeats within a task are settled there,
    so one passage found everywhere reaches the shuffle once a task.
    """
    if length <= DEPTH:
        raise ValueError(f"length must be over {DEPTH}")
    n = partitions(docs.sparkSession)
    docs = docs.select("id", "text")
    suffixes = docs.mapInArrow(_suffixes(length), SUFFIX).repartition(n, "gram")
    stretch = Window.partitionBy("gram", "stretch").orderBy("id", "at")
    gram = Window.partitionBy("gram").orderBy("stretch", "id", "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = suffixes.withColumn("again", F.col("done") | (F.rank().over(stretch) > 1)).withColumn("mixed", F.first("stretch").over(gram) != F.last("stretch").over(gram))
    ranked = staged(ranked.where("again or mixed").select("gram", "id", "at", "lead", "tail", "again"), "suffixes")
    whole = ranked.where("again").select("id", (F.col("at") - F.col("lead")).cast("long").alias("start"), (F.col("at") - F.col("tail") + length).cast("long").alias("end"))
    open_ = ranked.where("not again").groupBy("id").agg(F.collect_list(F.struct("gram", "at", "lead", "tail")).alias("open"))
    entries = docs.join(open_, "id").select("id", "text", "open").mapInArrow(_surroundings(length), ENTRY)
    sorted_ = entries.repartition(n, "gram").sortWithinPartitions("gram", "id", "at")
    return whole.union(sorted_.mapInArrow(_settle(length), "id long, start long, end long"))


KEPT = "id long, kept binary, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _whole(raw: bytes, p: int, q: int) -> bytes:
    """raw[p:q] without the parts of characters that a cut through either end leaves."""
    while p < q and raw[p] & 0xC0 == 0x80:
        p += 1
    while p < q < len(raw) and raw[q] & 0xC0 == 0x80:
        q -= 1
    return raw[p:q]


def _cut(with_text: bool, carry: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                rows = []
                for i, text, spans in zip(b["id"].to_pylist(), b["text"], b["spans"], strict=True):
                    raw = (text.as_py() or "").encode()
                    n, gone, runs, kept, mended = len(raw), 0, 0, raw, raw
                    if spans.is_valid and len(spans):
                        v = spans.values
                        s, e = v.field(0).to_numpy(), np.minimum(v.field(1).to_numpy(), n)
                        o = np.argsort(s, kind="stable")
                        s, e = s[o], np.maximum.accumulate(e[o])
                        new = np.r_[True, s[1:] > e[:-1]]
                        first, last = s[new].tolist(), e[np.r_[np.flatnonzero(new)[1:] - 1, len(e) - 1]].tolist()
                        runs, gone = len(first), sum(last) - sum(first)
                        pieces = list(zip([0, *last], [*first, n], strict=True))
                        kept = b"".join([raw[p:q] for p, q in pieces])
                        mended = b"".join([_whole(raw, p, q) for p, q in pieces]) if with_text else b""
                    rows.append((i, *((kept, mended.decode()) if with_text else (None, None)), n, gone, runs, hashlib.sha256(kept).hexdigest()))
                kinds = [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 7, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns + ([b["carry"]] if carry else []), [c.split()[0] for c in KEPT.split(", ")] + ["carry"] * carry)

    return run


def remove_repeats(docs: DataFrame, length: int = 100, with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, text) of every document of (doc_id, text), with the columns of ``carry``.

    ``kept``: the bytes that no repeated string of ``length`` bytes covers (null
    unless asked for); they may cut through characters, of which ``text`` leaves
    out the parts, and nothing else. A null text is empty;
    texts shorter than ``length`` stay. Ids should be unique: a row that repeats
    whole is cut as often as it occurs and never against itself; different texts
    of one id, or of null ids, which sort first, share their spans. Other columns
    are ignored; an empty table gives none.
    """
    least = F.lit(-(2**63)).cast("long")
    held = [F.struct(*carry).alias("carry")] if carry else []
    whole = docs.select(F.coalesce("doc_id", least).alias("id"), "text", *held)
    spans = repeated_spans(whole, length).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    schema = T.StructType.fromDDL(KEPT)
    if carry:
        schema = schema.add(whole.schema["carry"])
    cut = whole.join(spans, "id", "left").select("id", "text", "spans", *(["carry"] if carry else [])).mapInArrow(_cut(with_text, bool(carry)), schema)
    return cut.select(F.when(F.col("id") != least, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text", *(["carry.*"] if carry else []))
