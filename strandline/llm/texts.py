"""Texts of an Arrow column as plain bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes handled in one go, so that memory does not grow with a batch or a text.
CHUNK = 1 << 20


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts and ends; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets[:-1], offsets[1:]


def runs(starts: np.ndarray, ends: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive texts, ``first`` to before ``last``, of at most ``most`` bytes or a single text."""
    first = 0
    while first < len(starts):
        last = int(np.searchsorted(ends, starts[first] + most, "right"))
        last = max(last, first + 1)
        yield first, last
        first = last
