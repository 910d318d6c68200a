"""Arrow batches cut to bounded pieces, and memory given back between tasks."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession


def slices(batches: Iterator[pa.RecordBatch], most_rows: int = 1024, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Non-empty parts of each batch, of about ``most_bytes`` and at most ``most_rows``; one row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, min(most_rows, int(most_bytes * batch.num_rows / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def release() -> None:
    """Give the memory that a finished task has freed back to the machine; workers stay for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of Arrow batches that calls :func:`release` when its task ends."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


@contextlib.contextmanager
def small_batches(spark: SparkSession, most_bytes: int = 8 << 20) -> Iterator[None]:
    """Jobs that run inside exchange Arrow batches of at most about ``most_bytes`` with their workers; the setting is put back after."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most_bytes))
    try:
        yield
    finally:
        spark.conf.set(key, before)
