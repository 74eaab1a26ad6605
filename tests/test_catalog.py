"""Every assessment query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from gradeloom import catalog
from gradeloom.fixtures import BASE
from gradeloom.session import local_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return local_session()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int,)):
        return f"{float(value):.6g}"
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if type(value).__name__ == "Decimal":
        return f"{float(value):.6g}"
    return str(value)


def rows_of(rows):
    return sorted((tuple(plain(v) for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    found = catalog.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    rows = rows_of(tuple(r) for r in found.select(columns).collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    quoted = ", ".join(f'"{c}"' for c in columns)
    result = duck.execute(f"SELECT * FROM ({sql})")
    assert sorted(d[0] for d in result.description) == columns
    assert rows == rows_of(duck.execute(f"SELECT {quoted} FROM ({sql})").fetchall())
