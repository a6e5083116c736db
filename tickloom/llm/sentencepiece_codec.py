"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton over all pieces reads a text once; at each position its output
links give the pieces that end there, and each relaxes the best score of that
position. No piece holds a space mark behind another character, so the best
path of a text is the best paths of its stretches "marks, then word" joined,
and each stretch is solved once a worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: Fixed value of the format: an unknown character scores this much below the lowest piece.
UNKNOWN_PENALTY = 10.0
_STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_open: dict[str, "Pieces"] = {}


class Pieces:
    """A vocabulary of scored pieces with byte fallback: the identity normaliser, a mark for each space and one before the text."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: dict[int, int], unknown_id: int, most: int = 700_000):
        import ahocorasick

        self.byte_ids, self.unknown_id, self.most, self.solved = byte_ids, unknown_id, most, {}
        self.automaton = ahocorasick.Automaton()
        self.forms: dict[int, bytes] = {i: bytes([b]) for b, i in byte_ids.items()}
        low = 0.0
        for i, (piece, score) in enumerate(pieces):
            if piece:
                self.automaton.add_word(piece, (i, len(piece), score))
                self.forms[i] = piece.replace(MARK, " ").encode()
                low = min(low, score)
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {i} has a space mark inside; stretches would not be independent")
        self.automaton.make_automaton()
        self.unknown = low - UNKNOWN_PENALTY

    @classmethod
    def load(cls, path: str) -> "Pieces":
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        special = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i)
        bytes_ = {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}
        return cls([("" if special(i) else m.id_to_piece(i), m.get_score(i)) for i in ids], bytes_, m.unk_id())

    def best_path(self, stretch: str) -> list[int]:
        """Ids of the highest-scoring split; of equal ones, that whose last differing piece begins first."""
        n = len(stretch)
        best, start, piece, at = [0.0] * (n + 1), [-1] * (n + 1), [-1] * (n + 1), 0
        alone = 0  # position up to which every character has been relaxed as unknown if it is no piece
        for end, found in self._ends(stretch):
            for e in range(alone + 1, end):
                start[e], best[e] = e - 1, best[e - 1] + self.unknown
            top, single = -1e300, False
            for i, length, score in found:
                single |= length == 1
                s = end - length
                if (v := best[s] + score) > top or v == top and s < start[end]:
                    top, start[end], piece[end] = v, s, i
            if not single and (v := best[end - 1] + self.unknown) > top:
                top, start[end], piece[end] = v, end - 1, -1
            best[end], alone = top, end
        for e in range(alone + 1, n + 1):
            start[e], best[e] = e - 1, best[e - 1] + self.unknown
        out: list[int] = []
        at = n
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(stretch[start[at] : at].encode())]
            else:
                out.append(self.unknown_id)
            at = start[at]
        return out[::-1]

    def _ends(self, stretch: str) -> Iterator[tuple[int, list]]:
        end, found = -1, []
        for e, value in self.automaton.iter(stretch):
            if e != end:
                if found:
                    yield end + 1, found
                end, found = e, []
            found.append(value)
        if found:
            yield end + 1, found

    def encode(self, text: str) -> bytes:
        """Packed little-endian ids; an empty text has none."""
        if not text:
            return b""
        if len(self.solved) > self.most:
            self.solved.clear()
        words = _STRETCH.findall(MARK + text.replace(" ", MARK))
        out = list(map(self.solved.get, words))
        if None in out:
            for k, w in enumerate(words):
                if out[k] is None:
                    if (got := self.solved.get(w)) is None:
                        got = np.array(self.best_path(w), "<u4").tobytes()
                        if len(w) <= 64:
                            self.solved[w] = got
                    out[k] = got
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, ids without a form nothing."""
        try:
            raw = b"".join(map(self.forms.__getitem__, ids))
        except KeyError:
            raw = b"".join([self.forms.get(i, b"") for i in ids])
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")


def vocabulary(path: str) -> Pieces:
    """One vocabulary a Python worker, kept from task to task."""
    if path not in _open:
        _open[path] = Pieces.load(path)
    return _open[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>) of every document; a null text counts as empty. Other columns are ignored, repeated rows kept.

    The pieces write a blank as U+2581, so a text that holds that character
    gets the ids of a blank there, and decodes with a blank.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                ids = [v.encode(t.as_py() or "") for t in part["text"]]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, text, text_sha256) of encoded documents; null ids give an empty text.

    The text is the encoded one, but for U+2581, which comes back as a blank.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                lists = part["ids"]
                flat, cut = lists.flatten().to_numpy(zero_copy_only=False).tolist(), np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()]).tolist()
                texts = [v.decode(flat[s:e]) for s, e in zip(cut[:-1], cut[1:], strict=True)]
                sha = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["ids"], pa.array(texts, pa.string()), pa.array(sha, pa.string())], ["doc_id", "ids", "text", "text_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string, text_sha256 string")
