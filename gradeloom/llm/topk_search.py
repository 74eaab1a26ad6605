"""Exact top-k search by integer inner product: tiled matrix products, partial selection, merged lists.

Vectors are packed into blocks, one row of bytes each: the corpus into shards of ``SHARD_ROWS`` as its files are read, the
queries into tiles of ``TILE_ROWS``. A cell is one tile of queries and a group of shards; a task takes a cell's shards one
after the other and keeps the best k of each query, so it holds one tile, one shard and the lists. The lists of a tile's
cells are merged in a tree, ``FAN_IN`` at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.session import stored

from .batches import bounded_batches

SHARD_ROWS = 4096
TILE_ROWS = 8192
#: Shards of a cell, and cells that shorter corpora are spread over.
CELL_SHARDS = 128
LEAST_CELLS = 64
#: Scores that a task holds at once.
TILE_CELLS = 1 << 21
FAN_IN = 8
LONG = np.iinfo(np.int64)

_BLOCK = "block long, width int, n int, kind string, ids binary, rows binary"
_LISTS = "tile long, part long, n int, ids binary, found binary, scores binary"


def _whole(column: pa.Array) -> np.ndarray:
    """Places of the vectors that are there and hold finite numbers only."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.flatten()  # without what null lists may hold
    bad = ~np.isfinite(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
    owner = np.repeat(np.arange(len(column)), sizes)
    return np.setdiff1d(at, owner[bad], assume_unique=False)


def _packed(ids: np.ndarray, rows: np.ndarray) -> tuple[int, int, str, bytes, bytes]:
    """A block in the order of its ids; components as short integers where they fit."""
    order = np.argsort(ids, kind="stable")
    kind = "<i2" if rows.size == 0 or np.abs(rows).max() < 2**15 else "<f8"
    return rows.shape[1], len(ids), kind, ids[order].astype("<i8").tobytes(), rows[order].astype(kind).tobytes()


def packed(vectors: DataFrame, size: int, scale: float = 256.0) -> DataFrame:
    """Blocks of up to ``size`` rows of ``vectors(id, vector)`` of one width, each task's rows as they come; components are floor(scale * x)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 33, 0
        waiting: dict[int, tuple[list, list]] = {}

        def block(width: int, count: int) -> pa.RecordBatch:
            nonlocal made
            ids, rows = (np.concatenate(x) for x in waiting[width])
            waiting[width] = ([ids[count:]], [rows[count:]])
            made += 1
            values = (first + made, *_packed(ids[:count], rows[:count]))
            return pa.record_batch([pa.array([v], kind) for v, kind in zip(values, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()))], names=["block", "width", "n", "kind", "ids", "rows"])

        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            at = np.intersect1d(_whole(column), np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False)))
            widths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)[at]
            for width in np.unique(widths):
                mine = pa.array(at[widths == width])
                x = column.take(mine).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(mine), int(width))
                kept = waiting.setdefault(int(width), ([], []))
                kept[0].append(ids.take(mine).to_numpy(zero_copy_only=False).astype(np.int64))
                kept[1].append(np.floor(scale * x))
                while sum(map(len, waiting[int(width)][0])) >= size:
                    yield block(int(width), size)
        for width in sorted(waiting):
            if count := sum(map(len, waiting[width][0])):
                yield block(width, count)

    bounded_batches(vectors.sparkSession)
    return vectors.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(pack, _BLOCK)


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact inner products of integers: in floating point while every sum is below 2^53, else in longs or in whole numbers of any size."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0)) * max(1, queries.shape[1])
    if bound < 2**53:
        return queries @ shard.T
    if bound < 2**62:
        return queries.astype(np.int64) @ shard.astype(np.int64).T
    whole = lambda m: np.frompyfunc(int, 1, 1)(m).reshape(m.shape)
    return np.clip(whole(queries) @ whole(shard).T, LONG.min + 1, LONG.max).astype(np.int64)


def best_of_tile(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and scores of each row's best k, ties to the earlier column; -1 where there are fewer. ``own`` cells don't count."""
    rows, width = scores.shape
    k = min(k, width)
    limit = float(np.abs(scores).max(initial=0)) + 1
    if scores.dtype == float and (limit + 1) * width < 2**52:  # the column as the score's last digits: no two alike
        keys = scores * width
        keys += np.arange(width - 1, -1, -1)
        keys[own] = -np.inf
        at = np.argpartition(keys, width - k, axis=1)[:, width - k :]
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(keys, at, 1), axis=1), 1)
    else:
        keys = -scores
        at = np.lexsort((np.broadcast_to(np.arange(width), scores.shape), keys, own), axis=1)[:, :k]
    gone = np.take_along_axis(own, at, 1)
    return np.where(gone, -1, at), np.take_along_axis(scores, at, 1).astype(np.int64)


def merged(ids: np.ndarray, scores: np.ndarray, there: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each row's candidates, by score and smaller id."""
    order = np.lexsort((ids, -scores, ~there), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, 1) for x in (ids, scores, there))


_NONE = LONG.min  # in place of a score, where there is no candidate


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["rows"], row["kind"]).astype(float).reshape(row["n"], row["width"])


def _cells(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = ids = queries = best = None

        def lists() -> Iterator[pa.RecordBatch]:
            if best is not None:
                found, scores, there = best
                values = (*cell[:2], len(ids), ids.astype("<i8").tobytes(), found.astype("<i8").tobytes(), np.where(there, scores, _NONE).astype("<i8").tobytes())
                yield pa.record_batch([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["tile", "part", "n", "ids", "found", "scores"])

        for row in (r for b in batches for r in b.to_pylist()):
            if (row["tile"], row["part"]) != cell:
                yield from lists()
                cell, ids, best = (row["tile"], row["part"]), None, None
            if row["block"] is None:  # a tile comes before its shards
                ids, queries = _unpacked(row)
                best = (np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0), bool))
                continue
            if ids is None or queries.shape[1] != row["width"]:
                continue
            names, shard = _unpacked(row)
            step, new = max(1, TILE_CELLS // max(1, len(names))), []
            for first in range(0, len(ids), step):
                part = slice(first, first + step)
                at, scores = best_of_tile(products(queries[part], shard), ids[part, None] == names[None, :], k)
                new.append((np.where(at < 0, 0, names[at]), scores, at >= 0))
            tops = [np.concatenate(x) for x in zip(*new)]
            best = merged(*(np.concatenate(x, axis=1) for x in zip(best, tops)), k)
        yield from lists()

    return search


def _merge(k: int):
    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        n, ids = rows[0]["n"], rows[0]["ids"]
        found, scores = (np.concatenate([np.frombuffer(r[c], "<i8").reshape(n, -1) for r in rows], axis=1) for c in ("found", "scores"))
        found, scores, there = merged(found, scores, scores != _NONE, k)
        values = {"tile": [rows[0]["tile"]], "part": [rows[0]["up"]], "n": [n], "ids": [ids], "found": [found.tobytes()], "scores": [np.where(there, scores, _NONE).tobytes()]}
        return pa.table(values, pa.schema([("tile", pa.int64()), ("part", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("found", pa.binary()), ("scores", pa.binary())]))

    return merge


def _ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            found, scores = (np.frombuffer(x, "<i8").reshape(row.n, -1) for x in (row.found, row.scores))
            at, rank = np.nonzero(scores != _NONE)
            yield pd.DataFrame({"query_id": np.frombuffer(row.ids, "<i8")[at], "rank": (rank + 1).astype(np.int32), "vec_id": found[at, rank], "score": scores[at, rank]})


def top_k(corpus: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of ``corpus(id, vector)`` with the largest inner products with each row of
    ``queries(id, vector)``, all if there are fewer; ties go to the smaller id.

    Components are taken as floor(scale * x). A corpus row with the query's id is the query's own and no candidate. Rows
    without an id, without a vector or with null or non-finite components take no part; vectors of unlike widths have no
    product, and an empty one has 0. Repeated corpus rows are candidates each, repeated queries answered each. Scores beyond a long are
    shown as its largest or smallest. Ids are whole numbers; other columns are dropped.
    """
    shards = stored(packed(corpus, SHARD_ROWS, scale), "shards")
    wanted = stored(queries.select("id", "vector"), "queries")
    tiles = stored(packed(wanted.repartition(max(1, -(-wanted.count() // TILE_ROWS))), TILE_ROWS, scale), "tiles")
    n_tiles, n_shards = tiles.count(), shards.count()
    parts = max(1, -(-n_shards // CELL_SHARDS), min(n_shards, -(-LEAST_CELLS // max(1, n_tiles))))
    names = tiles.select("block").orderBy("block").toPandas()["block"].tolist()  # a number for each 8192 queries
    each_part, each_tile = F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")), F.array(*map(F.lit, names)).cast("array<long>")
    body = ["width", "n", "kind", "ids", "rows"]
    cells = tiles.select(F.col("block").alias("tile"), F.explode(each_part).alias("part"), F.lit(None).cast("long").alias("block"), *body)
    cells = cells.union(shards.select(F.explode(each_tile).alias("tile"), F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part"), "block", *body))
    dealt = cells.repartition(max(1, min(n_tiles * parts, 100_000)), "tile", "part").sortWithinPartitions("tile", "part", F.col("block").asc_nulls_first())
    lists = stored(dealt.mapInArrow(_cells(k), _LISTS), "lists")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        lists = stored(lists.withColumn("up", F.floor(F.col("part") / FAN_IN)).groupBy("tile", "up").applyInArrow(_merge(k), _LISTS), "lists")
    return lists.mapInPandas(_ranked, "query_id long, rank int, vec_id long, score long")


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all embeddings for every one whose id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return top_k(rows, rows.where("id % 50 = 0"), k=5)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
