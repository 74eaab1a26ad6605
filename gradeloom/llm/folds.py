"""Held-out folds and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.session import stored


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """All rows, or the ``bound`` rows whose keys have the least hashes."""
    return stored(rows.orderBy(F.xxhash64(key), key).limit(bound), "sample")
