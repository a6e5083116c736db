"""Matroska columns: store payloads as PCM tracks, parse files into packet tables.

The parser reads variable-length EBML elements, sized or unsized, walks
clusters, undoes Xiph, EBML and fixed lacing, and returns one packet for each
frame with its track, timestamp and byte range; cues are checked against the
clusters that they point to.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format: element ids.
EBML, DOC_TYPE, SEGMENT, INFO, TIMESTAMP_SCALE, MUXER, WRITER = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK, NUMBER, UID, KIND, LACING, CODEC, FRAME_NS = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_AT}
TOP = {INFO, TRACKS, CLUSTER, CUES}

FRAME, LACE, BLOCKS, HZ = 576, 8, 32, 8000
#: What a truncated or corrupt file raises.
BROKEN = (ValueError, IndexError, struct.error, RecursionError)


def size_bytes(n: int, width: int = 0) -> bytes:
    """A variable-length size; all ones are kept for the unknown size."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(eid: int, n: int) -> bytes:
    return element(eid, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def block(frames: list[bytes], track: int, relative: int, lacing: str = "fixed") -> bytes:
    """A SimpleBlock of one frame or a lace of several."""
    kinds = {"none": 0, "xiph": 1, "fixed": 2, "ebml": 3}
    lacing = "none" if len(frames) == 1 else lacing
    head = size_bytes(track) + struct.pack(">hB", relative, 0x80 | kinds[lacing] << 1)
    if lacing != "none":
        head += bytes([len(frames) - 1])
        sizes = [len(f) for f in frames]
        if lacing == "xiph":
            head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
        elif lacing == "ebml":
            head += size_bytes(sizes[0])
            for before, n in zip(sizes, sizes[1:-1]):
                d = n - before
                w = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
                head += size_bytes(d + (1 << 7 * w - 1) - 1, w)
    return element(SIMPLE_BLOCK, head + b"".join(frames))


def mux(payload: bytes, lacing: str = "fixed") -> bytes:
    """A file with one track of unsigned 8-bit mono PCM whose samples are the payload's bytes."""
    ms = FRAME * 1000 // HZ
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(MUXER, b"tickloom") + element(WRITER, b"tickloom"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", HZ)) + number(CHANNELS, 1) + number(DEPTH, 8))
    track = element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACING, 1) + number(FRAME_NS, ms * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, track], [], len(info) + len(track)
    step = FRAME * LACE * BLOCKS
    for k in range(0, len(payload), step):
        t0, body = k // FRAME * ms, [number(TIMESTAMP, k // FRAME * ms)]
        for j in range(k, min(k + step, len(payload)), FRAME * LACE):
            end = min(j + FRAME * LACE, len(payload))
            body.append(block([payload[i : i + FRAME] for i in range(j, end, FRAME)], 1, j // FRAME * ms - t0, lacing))
        cues.append(element(CUE, number(CUE_TIME, t0) + element(CUE_AT, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def varint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """(value, next position) of a variable-length integer; ids keep their length mark; an unknown size is -1."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no variable-length integer at {at}")
    v = int.from_bytes(data[at : at + width], "big")
    if keep:
        return v, at + width
    v &= (1 << 7 * width) - 1
    return (-1 if v == (1 << 7 * width) - 1 else v), at + width


def elements(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
    """(id, depth, element start, body start, body end) in file order, masters before what they hold."""
    end = len(data) if end is None else end
    while at < end:
        start = at
        eid, at = varint(data, at, keep=True)
        n, body = varint(data, at)
        if n < 0:  # unsized: a cluster ends at the next element of the segment, a segment with the file
            stop = end if eid != CLUSTER else next((s for s in _siblings(data, body, end)), end)
        else:
            stop = body + n
        if stop > end:
            raise ValueError(f"element {eid:X} at {start} runs over its parent")
        yield eid, depth, start, body, stop
        if eid in MASTERS:
            yield from elements(data, body, stop, depth + 1)
        at = stop


def _siblings(data: bytes, at: int, end: int) -> Iterator[int]:
    while at < end:
        eid, body = varint(data, at, keep=True)
        if eid in TOP:
            yield at
        n, body = varint(data, body)
        at = body + n


def frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative time, flags, [(start, length)]) of a block body."""
    track, at = varint(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    at, lacing = at + 3, flags >> 1 & 3
    if not lacing:
        return track, relative, flags, [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == 3:
        for k in range(n - 1):
            before = at
            v, at = varint(data, at)
            sizes.append(v if not k else sizes[-1] + v - ((1 << 7 * (at - before) - 1) - 1))
    else:
        if (end - at) % n:
            raise ValueError(f"uneven fixed lace at {at}")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lace overruns its block at {at}")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, relative, flags, out


def parse(data: bytes) -> tuple[list[tuple[int, int, int, bool, int, int]], dict]:
    """([(cluster, track, timestamp in ns, keyframe, offset, length)], facts about the file).

    Frames of a lace follow each other by their own track's default duration. A
    block of a group is a keyframe unless the group refers to another block.
    Data that doesn't begin with an EBML header, none at all too, is broken.
    """
    if data[:4] != EBML.to_bytes(4, "big"):
        raise ValueError("no EBML header")
    found, clusters, cues, segment, scale, stamp = [], [], [], 0, 1_000_000, 0
    tracks, inter, group = [], set(), 0
    uint = lambda a, b: int.from_bytes(data[a:b], "big")
    for eid, _, start, a, b in elements(data):
        if eid == SEGMENT:
            segment = a
        elif eid == TIMESTAMP_SCALE:
            scale = uint(a, b)
        elif eid == TRACK:
            tracks.append({"number": 0, "ns": 0, "codec": ""})
        elif eid == NUMBER and tracks:
            tracks[-1]["number"] = uint(a, b)
        elif eid == FRAME_NS and tracks:
            tracks[-1]["ns"] = uint(a, b)
        elif eid == CODEC and tracks:
            tracks[-1]["codec"] = data[a:b].decode("ascii", "replace")
        elif eid == GROUP:
            group += 1
        elif eid == REFERENCE:
            inter.add(group)
        elif eid == CLUSTER:
            clusters.append(start - segment)
        elif eid == TIMESTAMP:
            stamp = uint(a, b)
        elif eid in (SIMPLE_BLOCK, BLOCK):
            track, relative, flags, laced = frames(data, a, b)
            found.append((len(clusters) - 1, track, stamp + relative, flags & 0x80, group if eid == BLOCK else 0, laced))
        elif eid == CUE_CLUSTER:
            cues.append(uint(a, b))
    step = {t["number"]: t["ns"] for t in tracks}
    packets = [
        (cluster, track, time * scale + k * step.get(track, 0), group not in inter if group else bool(key), at, n)
        for cluster, track, time, key, group, laced in found for k, (at, n) in enumerate(laced)
    ]
    codecs = "+".join(t["codec"] for t in sorted(tracks, key=lambda t: t["number"]))
    return packets, {"codec": codecs, "clusters": len(clusters), "blocks": len(found), "cues": len(cues), "cues_ok": set(cues) <= set(clusters)}


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text's bytes, padded with 255 to whole frames, as a Matroska file.

    A null or empty text is one frame of padding. Other columns are ignored, repeated rows kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                raw = [(t.as_py() or "").encode() for t in part["text"]]
                media = [mux(x + b"\xff" * (max(1, -(-len(x) // FRAME)) * FRAME - len(x))) for x in raw]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packets(media: DataFrame) -> DataFrame:
    """The packet table of every file: doc_id, cluster, track, timestamp_ns, keyframe, offset, length, error.

    A null file has no packets; a truncated or corrupt one gives a single row of
    nulls whose ``error`` says what is wrong.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "cluster", "track", "timestamp_ns", "keyframe", "offset", "length", "error"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            for i, m in zip(b["doc_id"].to_pylist(), b["media"], strict=True):
                if not m.is_valid:
                    continue
                try:
                    rows = [(i, *p, None) for p in parse(m.as_py())[0]]
                except BROKEN as e:
                    rows = [(i, *[None] * 6, str(e) or type(e).__name__)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, cluster int, track int, timestamp_ns long, keyframe boolean, offset long, length long, error string")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def read_back(media: DataFrame) -> DataFrame:
    """READ: checksums of the payload that the parsed packets of each stored file give, and what the file says of itself.

    A null file gives nulls. Of a truncated or corrupt one only the stored bytes
    are known; ``error`` says what is wrong with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            rows = []
            for i, n, m in zip(b["doc_id"].to_pylist(), b["n_bytes"].to_pylist(), b["media"], strict=True):
                if not m.is_valid:
                    rows.append((i, n, *[None] * 7))
                    continue
                data = m.as_py()
                stored = len(data), hashlib.sha256(data).hexdigest()
                try:
                    found, facts = parse(data)
                except BROKEN as e:
                    rows.append((i, n, None, None, None, *stored, None, str(e) or type(e).__name__))
                    continue
                payload = b"".join([data[p[4] : p[4] + p[5]] for p in found])
                samples = np.frombuffer(payload, np.uint8)
                level = float(np.abs(samples.astype(np.int64) - 128).mean()) if len(samples) else 0.0
                last = found[-1][2] // 1_000_000 if found else -1
                feature = f"{facts['codec']};clusters={facts['clusters']};blocks={facts['blocks']};packets={len(found)};last_ms={last};cues={facts['cues'] if facts['cues_ok'] else 'bad'};level={level:.4f}"
                rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, feature, None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, READ)
