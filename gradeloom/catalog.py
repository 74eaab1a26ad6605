"""Registry of the assessment queries: name -> callable, name -> SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradeloom.fixtures import Tables, with_views
from gradeloom.plans import book


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=q.make: f(Tables(spark, sf_dir))) for name, q in book().items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(q.sql) for name, q in book().items() if q.sql}
