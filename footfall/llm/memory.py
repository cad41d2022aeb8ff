"""Memory of an executor outside the heap: what Python workers hold, what is on its way to them."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of about BATCH_BYTES, or of one row: Spark's own limits are 10 000 rows and 64 MB.
    The JVM holds a batch twice beside its heap, in buffers that doubled to its size, and the worker once more.
    Which batch a row is in must not matter. A smaller limit that the session has stays."""
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def give_back() -> None:
    """Returns freed memory of Arrow's pool and of the C library to the system: workers are used again
    by later stages, beside the JVM's share of the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
