"""Helpers for functions over Arrow record batches (DataFrame.mapInArrow)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def slices(batch: pa.RecordBatch, rows: int = 1000):
    """A batch in pieces, so that what Python holds at once stays small whatever the batch size."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def long_lists(parts: list[np.ndarray]) -> pa.Array:
    """An array<bigint> column from arrays of 64-bit words."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends) of a list column without nulls inside; null lists count as empty. ends has one entry more than rows."""
    column = column.fill_null([]) if column.null_count else column
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends - ends[0]
