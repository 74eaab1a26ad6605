"""Queries over the given tables: each applies an operator, with SQL for its result where SQL has it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gradeloom.fixtures import Tables


@dataclass
class Query:
    make: Callable[[Tables], DataFrame]
    sql: str


_BOOK: dict[str, Query] = {}


def query(sql: str = ""):
    """Register a function of the tables under its own name."""

    def put(f):
        _BOOK[f.__name__] = Query(f, sql)
        return f

    return put


def book() -> dict[str, Query]:
    from gradeloom.plans import linked, measured, moved, near, written  # noqa: F401

    return _BOOK
