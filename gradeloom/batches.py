"""Arrow batches cut by bytes: the number of rows says nothing about the size of texts."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Limit the batches that Python workers get to ``BATCH_BYTES`` or one row, unless the session has a limit of its own."""
    if spark.conf.get(_SETTING, None) is None:
        spark.conf.set(_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Hand memory that this Python worker has freed back to the system; the allocators of a reused worker keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc only
        trim(0)
