"""A bound on what one Arrow batch between Spark and Python holds."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """Sets the bound for the session of df unless it has one already. A bound on rows alone, which is
    Spark's default, lets batches grow with the length of texts."""
    conf = df.sparkSession.conf
    if conf.get(_SETTING, None) is None:
        conf.set(_SETTING, str(BATCH_BYTES))
    return df


def merged(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches in a row as one, of about `limit` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def release() -> None:
    """Give freed memory back to the system. Workers live on after a task, next to the executor's heap,
    and allocators keep what numpy and Arrow have freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own ways
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A task function that releases freed memory when it ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
