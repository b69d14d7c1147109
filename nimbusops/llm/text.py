"""Arrow text columns as flat byte arrays, cut into pieces of bounded size.

The helpers never copy text into Python objects: a batch is one byte array plus offsets, words are
offsets into it, and distinct words come from Arrow's dictionary encoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20  # numpy work on a piece needs up to some 50 times its size

#: Bytes A-Z to a-z, all others to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The six ASCII white space bytes.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return body[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most `limit` bytes together, or of one longer text."""
    first, last = 0, len(offsets) - 1
    while first < last:
        until = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        until = min(max(until, first + 1), last)
        yield first, until
        first = until


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: bool = False) -> pa.Array:
    """Arrow strings of byte ranges that do not overlap and come in order; bytes between them are dropped."""
    if not len(starts):
        return pa.array([], pa.string() if text else pa.binary())
    sizes = ends - starts
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    kept = data[covered(len(data), starts, ends)]
    return pa.Array.from_buffers(pa.string() if text else pa.binary(), len(starts),
                                 [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(kept))])


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Marks the places inside ranges that do not overlap."""
    some = starts < ends
    edge = np.zeros(size + 1, np.int8)
    edge[starts[some]] = 1
    edge[ends[some]] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).view(bool)


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text (maximal runs of bytes that `apart` does not mark),
    and the number of words up to each text."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~apart[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] along the first axis; empty ranges give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
