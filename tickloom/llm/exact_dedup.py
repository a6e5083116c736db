"""Exact deduplication by Patricia tries that own the smallest identifiers.

Every task first folds its own rows: their normalised texts go as whole byte
strings into a compressed radix trie, whose terminal nodes hold the best row
and a count, so a text leaves a task once however often it occurs there. When
a trie outgrows its budget, its largest subtree is spilled: its texts leave
the task as they stand, and a later copy of one starts anew. What leaves is
partitioned by length and content hash and goes through tries once more; a
terminal node then knows the owner of all copies. Documents are joined to
their task's copy, never to the text, so no key of that join has more rows
than one task read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import slices
from ._stage import staged

#: Bytes of texts and nodes that a task's trie may hold.
BUDGET = 48 << 20
NODE = 300
_BLANKS = bytes([0x20, *range(0x09, 0x0E)])


class Node:
    __slots__ = ("edge", "kids", "end")

    def __init__(self, edge: bytes, end=None):
        self.edge, self.kids, self.end = edge, None, end


def _shared(a: bytes, b: bytes, at: int) -> int:
    """The length of the common prefix of ``a`` and ``b[at:]``, by halving."""
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    """A Patricia trie of byte strings: edges hold strings, only branching and terminal nodes exist."""

    def __init__(self):
        self.root, self.size, self.weights = Node(b""), 0, {}

    def find(self, key: bytes) -> Node:
        """The terminal node of ``key``, made if need be; a new one has ``end`` None."""
        node, at, before = self.root, 0, self.size
        while at < len(key):
            if node.kids is None:
                node.kids = {}
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = kid = Node(key[at:])
                self.size += len(key) - at + NODE
                node = kid
                break
            edge = kid.edge
            if key.startswith(edge, at):
                at += len(edge)
            else:
                n = _shared(edge, key, at)
                fork = Node(edge[:n])
                kid.edge = edge[n:]
                fork.kids = {kid.edge[0]: kid}
                node.kids[edge[0]] = kid = fork
                self.size += NODE
                at += n
            node = kid
        if key and self.size > before:
            self.weights[key[0]] = self.weights.get(key[0], 0) + self.size - before
        return node

    def spill(self) -> Iterator[tuple[bytes, object]]:
        """Cut off the largest subtree below the root and give its (string, end), in order."""
        first = max(self.weights, key=lambda k: (self.weights[k], k))
        self.size -= self.weights.pop(first)
        yield from _walk(self.root.kids.pop(first))

    def all(self) -> Iterator[tuple[bytes, object]]:
        yield from _walk(self.root)


def _walk(top: Node) -> Iterator[tuple[bytes, object]]:
    stack = [(top, b"")]
    while stack:
        node, before = stack.pop()
        key = before + node.edge
        if node.end is not None:
            yield key, node.end
        if node.kids:
            stack += [(node.kids[c], key) for c in sorted(node.kids, reverse=True)]


FOLD = "row long, copy long, doc_id long, bytes binary, length long, hash binary, digest string, points long, best long, best_row long, n long"
_FOLD = pa.schema([("row", pa.int64()), ("copy", pa.int64()), ("doc_id", pa.int64()), ("bytes", pa.binary()), ("length", pa.int64()), ("hash", pa.binary()), ("digest", pa.string()), ("points", pa.int64()), ("best", pa.int64()), ("best_row", pa.int64()), ("n", pa.int64())])


def better(a: tuple, b: tuple) -> bool:
    """Whether (points, id, row) ``a`` stays rather than ``b``: more code points, then a smaller id, no id last, then the earlier row."""
    return (-a[0], a[1] is None, a[1] or 0, a[2]) < (-b[0], b[1] is None, b[1] or 0, b[2])


def _fold(budget: int):
    def copies(held: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for key, (copy, best, n) in held:
            digest = hashlib.sha256(key)
            rows.append({"copy": copy, "bytes": key, "length": len(key), "hash": digest.digest()[:16], "digest": digest.hexdigest(), "points": best[0], "best": best[1], "best_row": best[2], "n": n})
            size += len(key) + 200
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(rows, _FOLD)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _FOLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, trie = TaskContext.get().partitionId() << 40, Trie()
        for b in slices(batches):
            rows, to = [], []
            for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                t = t or ""
                node = trie.find(t.encode().translate(None, _BLANKS))
                mine = (len(t), i, row)
                if node.end is None:
                    node.end = [row, mine, 1]
                else:
                    node.end[2] += 1
                    if better(mine, node.end[1]):
                        node.end[1] = mine
                rows.append(row)
                to.append(node.end[0])
                row += 1
                if trie.size > budget and trie.weights:
                    yield from copies(trie.spill())
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(to), b["doc_id"]] + [pa.nulls(n, f.type) for f in list(_FOLD)[3:]], schema=_FOLD)
        yield from copies(trie.all())

    return run


OWNED = "copy long, keep_id long, keep_row long, group_size long, digest string"
_OWNED = pa.schema([("copy", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64()), ("digest", pa.string())])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Insert the copies of every length and hash into a trie of their own; rows come sorted by these, and only one trie is held."""
    rows, at, trie = [], None, Trie()

    def done() -> None:
        for _, (members, best, n, digest) in trie.all():
            rows.extend((c, best[1], best[2], n, digest) for c in members)

    def ready() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OWNED, strict=True)], schema=_OWNED)
        rows.clear()
        return out

    for b in batches:
        columns = [b[c].to_pylist() for c in ("length", "hash", "bytes", "copy", "points", "best", "best_row", "n", "digest")]
        for length, h, key, copy, points, best, best_row, n, digest in zip(*columns, strict=True):
            if (length, h) != at:
                done()
                trie, at = Trie(), (length, h)
            node = trie.find(key)
            mine = (points, best, best_row)
            if node.end is None:
                node.end = [[copy], mine, n, digest]
            else:
                node.end[0].append(copy)
                node.end[2] += n
                if better(mine, node.end[1]):
                    node.end[1] = mine
        if rows:
            yield ready()
    done()
    if rows:
        yield ready()


def owners(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): every row with the row that stays for its text.

    Texts are equal when they are the same bytes without blanks
    (``[\\x20\\x09-\\x0D]``); null counts as empty. Of equal texts the row with
    the most code points stays, then the smallest doc_id, a null id last; of
    rows equal in both too, one stays, so repeated rows have kept set once.
    An empty table gives no rows; other columns are ignored, so none clashes.
    A task holds texts of ``budget`` bytes, or one longer text.
    """
    folded = staged(docs.select("doc_id", "text").mapInArrow(_fold(budget), FOLD), "folded")
    copies = folded.where("length is not null").select("length", "hash", "bytes", "copy", "points", "best", "best_row", "n", "digest")
    owned = copies.repartition("length", "hash").sortWithinPartitions("length", "hash").mapInArrow(_own, OWNED)
    members = folded.where("length is null").select("doc_id", "row", "copy")
    kept = (F.col("row") == F.col("keep_row")).alias("kept")
    return members.join(owned, "copy").select("doc_id", "keep_id", "group_size", kept, F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``docs`` without the ids of rows that ``owners`` drops; ids should be unique, and rows without one all stay."""
    gone = owners(docs, budget).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
