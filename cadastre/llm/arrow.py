"""Small helpers for mapInArrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def byte_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each row of a string or binary column, without copies; null is empty."""
    if len(column) == 0:
        return
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    for i in range(len(column)):
        yield whole[at[i] : at[i + 1]]


def longs(values: np.ndarray) -> pa.Array:
    """A long column; unsigned hashes keep their bits."""
    return pa.array(np.ascontiguousarray(values).astype(np.uint64, copy=False).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64, copy=False))


def ints(values: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values).astype(np.int32, copy=False))
