"""Arrow string columns as byte arrays, for functions that run inside ``mapInArrow``."""

from __future__ import annotations

import ctypes
import gc
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying it; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def by_bytes(off: np.ndarray, limit: int):
    """Ranges of rows [a, b) of at most ``limit`` bytes each; a longer row is alone in its range."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def strings(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary array of the slices of ``data`` that begin at ``starts`` and end at the next start."""
    off = np.append(starts, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def released(run):
    """A function for ``mapInArrow`` that gives its memory back when its task ends: idle workers are kept by Spark."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)
    return wrapped


ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark, rows: int = 1000):
    """Texts go to workers in batches of at most ``rows`` rows while this lasts; for functions that finish their Python stages inside it."""
    before = spark.conf.get(ROWS_A_BATCH)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(ROWS_A_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ROWS_A_BATCH, before)
