"""Exact joins and searches over groups of vectors against all pairs."""

import io
from contextlib import redirect_stdout
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import cells, vectors
from gradeloom.session import local_session, scratch_path


@pytest.fixture(scope="module")
def spark():
    return local_session()


def bunched(n, seed, width=8, bunches=12, apart=0.15):
    """Unit vectors around a few directions."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(bunches, width))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[draw.integers(0, bunches, n)] + apart * draw.normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, x, kind="double"):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], f"id long, vector array<{kind}>").repartition(3)


@pytest.mark.parametrize("tau, lengths", [(0.9, False), (-0.2, True), (0.3, True)])
def test_pairs(spark, monkeypatch, tau, lengths):
    """All pairs at any size of groups and partners; unit vectors and such of any length, a zero one among them."""
    monkeypatch.setattr(cells, "PARTNERS", 3)
    x = bunched(220, 1)
    if lengths:
        x *= np.random.default_rng(2).uniform(0.2, 4, size=(220, 1))
        x[7] = 0
    sim = x @ x.T
    want = {(a, b) for a, b in combinations(range(220), 2) if sim[a, b] >= tau}
    assert (np.abs(sim - tau) > 1e-9).all()
    for size in (9, 64):
        found = cells.pairs_at_least(cells.build(table(spark, x), size=size), tau).collect()
        assert {(min(r.x, r.y), max(r.x, r.y)) for r in found} == want and len(found) == len(want)


def test_far_groups_are_skipped(spark):
    """Bunched vectors: most pairs of groups need no product, and no wanted pair is lost."""
    x = bunched(1500, 3, width=16, bunches=20, apart=0.05)
    made = cells.build(table(spark, x), size=32)
    n = made.groups.count()
    assert cells.group_pairs(made, 0.8).count() < 0.4 * n * (n + 1) / 2
    sim = x @ x.T
    assert cells.pairs_at_least(made, 0.8).count() == int((np.triu(sim, 1) >= 0.8).sum())


def test_pairs_within_keys(spark):
    """A key with half of all rows, many small ones, null keys and one key that only looks like another."""
    x = bunched(300, 4)
    keys = ["hot"] * 150 + [f"k{i // 3}" for i in range(100)] + [None] * 30 + ["", "1"] * 10
    rows = spark.createDataFrame([(i, k, v.tolist()) for i, (k, v) in enumerate(zip(keys, x))], "id long, key string, vector array<double>")
    sim = x @ x.T
    want = {(a, b) for a, b in combinations(range(300), 2) if keys[a] == keys[b] and sim[a, b] >= 0.5}
    for size in (16, 500):
        found = cells.pairs_at_least(cells.build(rows, within="key", size=size), 0.5, within=True).collect()
        assert {(min(r.x, r.y), max(r.x, r.y)) for r in found} == want and len(found) == len(want)


def test_nan_links_with_nothing(spark):
    rows = spark.createDataFrame([(1, [float("nan"), 1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [float("inf"), 0.0]), (5, None), (6, [None, 1.0]), (7, [])], "id long, vector array<double>")
    assert [(r.a, r.b) for r in vectors.cosine_pairs(rows, 0.5).collect()] == [(2, 3)]
    assert {r.component for r in vectors.components(vectors.cosine_pairs(rows, 0.5), rows).collect()} == {1, 2, 4, 5, 6, 7}
    assert [(r.query_id, r.id) for r in vectors.search(rows, rows.where("id < 3").withColumnRenamed("id", "query_id"), 0.5, 1, 1).collect()] == [(2, 2)]


def brute_search(x, ids, queries, tau, min_k, cap):
    out = set()
    for q, v in queries:
        order = sorted(zip(-(x @ v), ids))[:cap]
        out |= {(q, i, n) for n, (s, i) in enumerate(order, 1) if -s >= tau or n <= min_k}
    return out


def test_index_search_append(spark, monkeypatch):
    """Search, append, search again: as over all rows; known ids stay as they are; ties at the cap; a search reads the asked cells' files only."""
    monkeypatch.setattr(cells, "LEAST_ROWS", 16)
    x = bunched(600, 5, width=16, bunches=20, apart=0.05)
    x[40:60] = x[40]  # ties across the cap
    home = scratch_path(spark, "index")
    cells.create_index(table(spark, x[:400]), home)
    asked = [(k, x[k]) for k in (3, 45, 399, 500)]
    queries = spark.createDataFrame([(q, v.tolist()) for q, v in asked], "query_id long, vector array<double>")
    found = {(r.query_id, r.id, r.nth) for r in vectors.search_index(home, queries).collect()}
    assert found == brute_search(x[:400], range(400), asked, 0.5, 3, 15)
    new = table(spark, x[400:]).withColumn("id", F.col("id") + 400)
    again = new.union(spark.createDataFrame([(3, [9.0] * 16)], "id long, vector array<double>")).union(new.where("id = 450"))
    before = cells.open_index(spark, home).groups.count()
    cells.append_index(again, home)
    cells.append_index(again, home)
    index = cells.open_index(spark, home)
    assert index.groups.count() > before and index.groups.agg(F.sum("n")).first()[0] == 600
    found = {(r.query_id, r.id, r.nth) for r in vectors.search_index(home, queries).collect()}
    assert found == brute_search(x, range(600), asked, 0.5, 3, 15)
    one = spark.createDataFrame([(3, x[3].tolist())], "query_id long, vector array<double>").withColumn("kth", F.lit(0.9))
    needed = [r[0] for r in cells._asked(index, one, 15, True).select("cell").distinct().collect()]
    out = io.StringIO()
    with redirect_stdout(out):
        index.groups.where(F.col("cell").isin(needed)).explain("formatted")
    assert len(needed) < 5 and "PartitionFilters: [isnotnull(cell" in out.getvalue()
    assert cells._asked(index, one, 15, False).count() < index.groups.count() / 2


def test_empty_tables(spark):
    rows = table(spark, bunched(5, 6))
    assert vectors.cosine_pairs(rows.limit(0), 0.1).count() == 0
    queries = rows.withColumnRenamed("id", "query_id")
    assert vectors.search(rows.limit(0), queries).count() == 0 and vectors.search(rows, queries.limit(0)).count() == 0


def test_workers_hold_one_group_and_a_bounded_tile(spark):
    """Batches are cut by bytes; of a batch one row at a time is unpacked, and its packed vectors stay buffers."""
    rows = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(50)], "id long, vector array<float>")
    assert cells.pairs_at_least(cells.build(rows), 0.5).where("x <> y").count() > 0
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    packed = np.arange(8, dtype=float).tobytes()
    batch = pa.record_batch([pa.array([4, 4]), pa.array([2, 2]), pa.array([[1, 2, 3, 4], None]), pa.array([packed, packed])], names=["n", "width", "ids", "rows"])
    each = list(cells._each(iter([batch])))
    assert [r["ids"] for r in each] == [[1, 2, 3, 4], None] and all(isinstance(r["rows"], pa.Buffer) for r in each)
    assert cells._rows(each[1]).tolist() == np.arange(8.0).reshape(4, 2).tolist()
