"""Fill-in-the-middle rearrangement as a pipeline of Arrow kernels.

Texts are split into units as list arrays, flattened with the index of their
parents, numbered within them, filtered by role, rebuilt to lists and joined
to prefix, middle and suffix. Everything is done on bytes, so that any mark
that is no UTF-8 can part the units and nothing is decoded on the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import slices

P, M, S = b"<P>", b"<M>", b"<S>"
#: A word with the blanks before it, or the blanks at the end.
_UNIT = rb"([ \t-\r]*[^ \t-\r]+|[ \t-\r]+)"
#: Found in no UTF-8.
_MARK = b"\xff"
ROLES = ("prefix", "middle", "suffix")
OUT = "doc_id long, output string, form string, n long, prefix string, middle string, suffix string"


def units(texts: pa.Array) -> pa.ListArray:
    """The units of binary texts as lists, with one empty unit after the last."""
    return pc.split_pattern(pc.replace_substring_regex(texts, pattern=_UNIT, replacement=rb"\1" + _MARK), _MARK)


def roles(lists: pa.ListArray, low: pa.Array, high: pa.Array) -> list[pa.Array]:
    """The bytes before unit ``low``, from there to ``high`` and after it, of every list."""
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    begin = pa.array(lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py())
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.cast(begin.take(parents), pa.int64()))
    first, second = pc.less(ordinal, low.take(parents)), pc.less(ordinal, high.take(parents))
    out = []
    for keep in (first, pc.and_not(second, first), pc.invert(second)):
        held = np.bincount(parents.filter(keep).to_numpy(), minlength=len(lists))
        offsets = pa.array(np.append(0, np.cumsum(held)), pa.int32())
        out.append(pc.binary_join(pa.ListArray.from_arrays(offsets, flat.filter(keep)), pa.scalar(b"", flat.type)))
    return out


def _mod(a: pa.Array, b) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _rearranged(rate: int, spm: int, carry: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            text = pc.fill_null(b["text"].cast(pa.binary()), b"")
            lists = units(text)
            n = pc.cast(pc.subtract(pc.list_value_length(lists), 1), pa.int64())
            h1, h2, h3, h4 = (b[f"_h{k}"] for k in range(1, 5))
            cuts = [_mod(h, pc.add(n, 1)) for h in (h1, h2)]
            parts = roles(lists, pc.min_element_wise(*cuts), pc.max_element_wise(*cuts))
            marked = pc.match_substring_regex(text, b"<[PSM]>")
            plain = pc.or_(pc.or_(marked, pc.equal(pc.binary_length(text), 0)), pc.greater_equal(_mod(h3, 100), rate))
            first = pc.less(_mod(h4, 100), spm)
            form = pc.if_else(plain, "plain", pc.if_else(first, "spm", "psm"))
            prefix, middle, suffix = parts
            join = lambda *x: pc.binary_join_element_wise(*x, b"")
            output = pc.if_else(plain, text, pc.if_else(first, join(S, suffix, P, prefix, M, middle), join(P, prefix, S, suffix, M, middle)))
            none = pa.scalar(None, pa.string())
            columns = [b["doc_id"], output.cast(pa.string()), form, n] + [pc.if_else(plain, none, x.cast(pa.string())) for x in parts]
            yield pa.RecordBatch.from_arrays(columns + ([b["_carry"]] if carry else []), [c.split()[0] for c in OUT.split(", ")] + ["_carry"] * carry)

    return run


def rearrange(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, output, form, n, prefix, middle, suffix) and the columns of ``carry``: texts with their middle moved to the end.

    A text has n units: words with the blanks (``[\\x20\\x09-\\x0D]``) before
    them, and blanks at the end. Numbers that hang on ``seed`` and doc_id alone
    choose two cuts, whether the text changes (``rate`` percent) and which form
    it takes (``spm`` percent suffix first). A text that is empty or null, or
    that holds one of the marks, stays ``plain``: its parts are null and its
    output is the text. A null id counts as one without digits; rows that share
    an id get the same numbers. Columns not in ``carry`` are ignored; a carried
    one may not be named as a result. A task holds a few times 4 MB, or one text.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(4)]
    whole = docs.select("doc_id", "text", *numbers, *([F.struct(*carry).alias("_carry")] if carry else []))
    schema = T.StructType.fromDDL(OUT)
    if carry:
        schema = schema.add(whole.schema["_carry"])
    return whole.mapInArrow(_rearranged(rate, spm, bool(carry)), schema).select(*schema.names[:7], *(["_carry.*"] if carry else []))


def _part(texts: pa.Array, mark: bytes, k: int) -> pa.Array:
    return pc.list_element(pc.split_pattern(texts, mark, max_splits=1), k)


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        form, output = b["form"], b["output"].cast(pa.binary())
        at = pa.array(np.arange(b.num_rows))
        rows, texts = [], []
        for name, first, second in (("plain", None, None), ("psm", P, S), ("spm", S, P)):
            here = pc.fill_null(pc.equal(form, name), False)
            x = output.filter(here)
            if second:
                head, middle = _part(_part(x, first, 1), M, 0), _part(x, M, 1)
                one, two = _part(head, second, 0), _part(head, second, 1)
                prefix, suffix = (one, two) if name == "psm" else (two, one)
                x = pc.binary_join_element_wise(prefix, middle, suffix, b"")
            rows.append(at.filter(here))
            texts.append(x)
        order = pc.sort_indices(pa.concat_arrays(rows))
        yield b.drop_columns(["output"]).append_column("text", pa.concat_arrays(texts).cast(pa.string()).take(order))


def restore(rearranged: DataFrame) -> DataFrame:
    """The rows of ``rearranged`` with ``text``, rebuilt from output and form, in place of output; both must not be null."""
    fields = [f for f in rearranged.schema.fields if f.name != "output"]
    return rearranged.mapInArrow(_restored, T.StructType([*fields, T.StructField("text", T.StringType())]))
