"""Groups of sorted rows in Arrow batches, many groups at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _changes(rows: pa.Table, keys: int) -> np.ndarray:
    """Of each row but the first: whether a key differs from the row before."""
    out = np.zeros(max(0, rows.num_rows - 1), bool)
    for c in range(keys):
        column = rows.column(c).combine_chunks()
        a, b = column.slice(0, len(out)), column.slice(1)
        differ = pc.not_equal(a, b).fill_null(False)
        if pa.types.is_floating(column.type):  # Spark groups NaN with NaN
            differ = pc.and_not(differ, pc.and_(pc.is_nan(a), pc.is_nan(b)).fill_null(False))
        out |= differ.to_numpy(zero_copy_only=False)
        out |= a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False)
    return out


def whole_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, list[int]]]:
    """Of rows sorted by their first `keys` columns: tables of whole groups, and where each group begins (and the last one ends).

    A group lies in memory as a whole.
    """
    held: list[pa.Table] = []  # rows of one group
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        begin = (np.flatnonzero(_changes(new, keys)) + 1).tolist()
        if held and _changes(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), new.slice(0, 1)]), keys)[0]:
            begin.insert(0, 0)
        if begin:
            before = sum(t.num_rows for t in held)
            rows = pa.concat_tables([*held, new.slice(0, begin[-1])])
            if rows.num_rows:
                yield rows, sorted({0, *(before + x for x in begin)})
            held = []
        held.append(new.slice(begin[-1] if begin else 0))
    if held:
        rows = pa.concat_tables(held)
        yield rows, [0, rows.num_rows]
