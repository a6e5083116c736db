"""Walk the groups of a sorted partition, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys`` (no nulls); only a group that runs on is held back."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = np.ones(b.num_rows, bool)
        for k in keys:
            v = b[k].to_numpy(zero_copy_only=False)
            last &= v == v[-1]
        at = int(np.argmax(last))  # the batch is sorted, so its last group begins here
        if held:
            before = [held[0][k][0].as_py() for k in keys]
            if [b[k][0].as_py() for k in keys] == before and at == 0:
                held.append(b)
                continue
            if at:
                yield pa.Table.from_batches([*held, b.slice(0, at)])
            else:
                yield pa.Table.from_batches(held)
        elif at:
            yield pa.Table.from_batches([b.slice(0, at)])
        held = [b.slice(at)]
    if held:
        yield pa.Table.from_batches(held)


def edges(*columns: np.ndarray) -> np.ndarray:
    """Starts of the groups of sorted columns, and their end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)
