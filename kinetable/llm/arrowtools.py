"""Small helpers that Arrow-batched operators share."""

from __future__ import annotations

import ctypes
import re
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import utf8

SLICE_BYTES = 4 << 20
BATCH_BYTES = 8 << 20
PART_BYTES = 64 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(rows: DataFrame) -> DataFrame:
    """``rows``, whose session hands Python batches of BATCH_BYTES at most from now on, but for a longer text.

    The session's own bound stays if it is less.  Both sides hold a batch for each running task, so this
    bounds what a task needs beside its heap; results do not depend on it.
    """
    spark = rows.sparkSession
    own = re.fullmatch(r"(\d+)b?", spark.conf.get(BATCH_SETTING, None) or "")
    if own is None or not 0 < int(own[1]) <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return rows


def dealt_by(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` by an exchange of their own, so all rows of a ``key`` (of type long) are in one partition.

    ``repartition(key)`` is left out where a join on ``key`` has dealt rows by it; if that join turns out small while the job
    runs, its rows are read where they lie, and a key's come apart.  No join deals by this hash.
    """
    return rows.repartition(F.xxhash64(F.lit("dealt"), key))


def parts_by_bytes(rows: DataFrame, *columns: str, part: int = PART_BYTES) -> int:
    """How many partitions of about ``part`` bytes hold these string columns, the session's number of shuffle partitions at least.

    For layouts that a number fixes, which adaptive execution doesn't resize; it costs a scan of the columns' lengths.
    """
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(64)).cast("long")
    total = rows.agg(F.sum(size)).first()[0] or 0
    return max(-(-total // part), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """The batch in runs of rows of about ``limit`` bytes of ``column``; a longer text stands alone."""
    _, off = utf8(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        stop = max(begin + 1, int(np.searchsorted(off, off[begin] + limit, "right")) - 1)
        yield batch.slice(begin, stop - begin)
        begin = stop


def binary_rows(rows: np.ndarray) -> pa.Array:
    """A matrix as one fixed run of bytes a row."""
    size = rows.dtype.itemsize * rows.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def trimmed(run):
    """The batch function, with memory that its task freed given back to the system at the end.

    Python workers outlive tasks; what allocators keep would else add up over the stages of a job.
    """

    @wraps(run)
    def outer(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return outer
