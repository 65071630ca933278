"""Whole groups of rows inside a task, many at once, for folds that NumPy does over all of them together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Rows of Arrow batches that are folded together, but for a group of more.
TOGETHER = 50_000


def begins(frame: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a row is the first of its group; rows are in order of keys."""
    out = np.zeros(frame.num_rows, bool)
    out[:1] = True
    for k in keys:
        v = frame[k].combine_chunks()
        null = v.is_null().to_numpy(zero_copy_only=False)
        other = pc.fill_null(pc.not_equal(v[1:], v[:-1]), False).to_numpy(zero_copy_only=False)
        out[1:] |= (null[1:] != null[:-1]) | other
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], together: int = TOGETHER) -> Iterator[pa.Table]:
    """Batches joined to `together` rows or more and cut where groups end: each group is in one of them. Rows come in order of keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        before = [held[-1].slice(held[-1].num_rows - 1)] if held else []
        starts = np.flatnonzero(begins(pa.Table.from_batches([*before, batch]).select(keys), keys)[1:]) + 1 - len(before)
        if not len(starts) or sum(b.num_rows for b in held) + starts[-1] < together:
            held.append(batch)
            continue
        last = int(starts[-1])
        yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)
