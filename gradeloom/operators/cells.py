"""Exact cosine joins and searches over groups of vectors: only groups whose bound reaches the wanted score are multiplied.

Vectors are dealt to the nearest of a few pivots and packed, by angle to it, into groups: one row of bytes each, with the range of
angles and lengths. By the triangle inequality on angles two groups, or a query and a group, have an inner product of at most a
bound that needs only these ranges and the angle between pivots. What can reach the wanted score is shuffled as packed groups
and multiplied as matrices; nothing but the pivots and the groups' ranges passes through the driver.

Vectors may have any length and width; the product of unlike widths doesn't exist. Null vectors and those with null or
non-finite components take no part, so they link with nothing. Null ids are ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gradeloom.batches import bounded_batches, give_back
from gradeloom.session import scratch_path, stored

#: Rows of a group (about n / 32 between the two), pivots at most, and products that a task holds at once.
LEAST_ROWS, MOST_ROWS = 256, 8_192
MOST_PIVOTS = 1_024
TILE_CELLS = 1 << 19
#: Partners that a group meets in one task, groups whose ranges are broadcast at once, and queries of a block.
PARTNERS = 64
RANGES = 1 << 20
QUERY_ROWS = 4_096
SLACK = 1e-6

_GROUP = "width int, cell int, lo double, hi double, least double, most double, low_key long, high_key long, n int"
_RANGES = ["group", "width", "cell", "lo", "hi", "least", "most", "low_key", "high_key", "n"]


@dataclass
class Cells:
    """Groups ``(group, ..., ids, keys, rows)`` and the pivots of each width."""

    groups: DataFrame
    pivots: dict[int, np.ndarray]


def whole(vector: str = "vector"):
    """Condition: a vector without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles of rows to unit pivots; a row without length has none, which NaN stands for."""
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.arccos(np.clip(rows @ pivots.T / size, -1.0, 1.0))


def _pivots(vectors: DataFrame, k: int) -> dict[int, np.ndarray]:
    """``k`` vectors, those with the least hashes, as unit rows by width."""
    drawn = vectors.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(k).distinct().toArrow().column(0).combine_chunks()
    widths = drawn.value_lengths().to_numpy(zero_copy_only=False)
    found = {}
    for width in np.unique(widths):
        rows = _matrix(drawn.take(pa.array(np.flatnonzero(widths == width))), int(width))
        size = np.linalg.norm(rows, axis=1)
        if (size > 0).any():
            found[int(width)] = rows[size > 0] / size[size > 0, None]
    return found


def _placed(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with the cell (nearest pivot), the angle to it, the length and the width."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    at = vectors.columns.index("vector")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
            cell, angle, size = np.full(len(widths), -1, np.int32), np.full(len(widths), np.nan), np.zeros(len(widths))
            for width in np.unique(widths):
                mine = np.flatnonzero(widths == width)
                rows = _matrix(batch.column(at).take(pa.array(mine)), int(width))
                size[mine] = np.linalg.norm(rows, axis=1)
                if int(width) in shared.value:
                    pivots = shared.value[int(width)]
                    step = max(1, TILE_CELLS // len(pivots))
                    for first in range(0, len(rows), step):
                        part = mine[first : first + step]
                        away = _angles(rows[first : first + step], pivots)
                        near = np.argmin(np.where(np.isnan(away), np.pi, away), axis=1)
                        cell[part], angle[part] = near, away[np.arange(len(near)), near]
            yield pa.record_batch([*batch.columns, pa.array(widths, pa.int32()), pa.array(cell), pa.array(angle), pa.array(size)], names=[*batch.schema.names, "width", "cell", "angle", "size"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(place, f"{kinds}, width int, cell int, angle double, size double")


def build(vectors: DataFrame, within: str | None = None, pivots: dict[int, np.ndarray] | None = None, home: str | None = None, size: int | None = None, after: int = 0, mode: str = "append") -> Cells:
    """Groups of ``vectors(id, vector)``; with ``within``, groups follow that column's values instead of cells, small ones together
    and large ones in several. No pivots (an empty dict) is groups of rows as they come, without a shuffle and without bounds. ``home`` is a folder that the groups are added to, a folder for each cell; numbers of groups follow ``after``."""
    key = F.col(within) if within else F.lit(0)
    code = F.xxhash64(within) if within else F.lit(0).cast("long")
    rows, n = vectors.where(whole()).select("id", "vector", key.alias("key"), code.alias("code")), vectors.count()
    size = size or max(LEAST_ROWS, min(MOST_ROWS, n // 32))
    unlimited = within is not None or pivots == {}
    if pivots is None:
        pivots = {} if within else _pivots(rows, min(MOST_PIVOTS, n // size + 1))
    placed = _placed(rows, pivots)
    if within or pivots:
        order = ["width", "code", "key", "cell", "angle", "id"]
        tasks = min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // size + 1)
        dealt = stored(placed, "placed").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    else:
        dealt = placed.sortWithinPartitions("width")
    id_type, key_type = (to_arrow_type(rows.schema[c].dataType) for c in ("id", "key"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made, held, have = after + (TaskContext.get().partitionId() << 33), 0, [], 0

        def group() -> pa.RecordBatch:
            nonlocal made, held, have
            table = pa.Table.from_batches(held).combine_chunks()
            table = table.take(pc.sort_indices(table, [("id", "ascending")], null_placement="at_start"))  # ties go to the first
            column = {c: table.column(c).combine_chunks() for c in table.column_names}
            number = {c: column[c].to_numpy(zero_copy_only=False) for c in ("code", "angle", "size", "width", "cell")}
            free = unlimited or np.isnan(number["angle"]).any()
            made, held, have = made + 1, [], 0
            values = [first + made, number["width"][0], number["cell"][0], 0.0 if free else number["angle"].min(), np.pi if free else number["angle"].max(), number["size"].min(), number["size"].max(), number["code"].min(), number["code"].max(), len(table)]
            flat = column["vector"].flatten()
            kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.int64(), pa.int64(), pa.int32()]
            arrays = [pa.array([v], k) for v, k in zip(values, kinds)]
            arrays += [pa.array([column["id"].to_pylist()], pa.list_(id_type)), pa.array([column["key"].to_pylist()], pa.list_(key_type)), pa.array([flat.to_numpy(zero_copy_only=False).astype(float).tobytes()])]
            return pa.record_batch(arrays, names=["group", *(f.split()[0] for f in _GROUP.split(", ")), "ids", "keys", "rows"])

        for batch in batches:
            kind = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (("width",) if unlimited else ("width", "cell"))])
            ends = [*(np.flatnonzero((kind[:, 1:] != kind[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            start = 0
            for end in ends:  # runs of one cell
                while start < end:
                    if held and (held[-1].column("width")[-1], held[-1].column("cell")[-1]) != (batch.column("width")[start], batch.column("cell")[start]):
                        yield group()
                    stop = min(end, start + size - have)
                    held.append(batch.slice(start, stop - start))
                    have, start = have + stop - start, stop
                    if have == size:
                        yield group()
        if held:
            yield group()

    packed = dealt.mapInArrow(pack, f"group long, {_GROUP}, ids array<{rows.schema['id'].dataType.simpleString()}>, keys array<{rows.schema['key'].dataType.simpleString()}>, rows binary")
    if home is None:
        return Cells(stored(packed, "groups"), pivots)
    packed.write.mode(mode).partitionBy("cell").parquet(f"{home}/groups")
    return Cells(vectors.sparkSession.read.schema(packed.schema).parquet(f"{home}/groups"), pivots)


def _ranges(groups: DataFrame) -> Iterator[dict[str, np.ndarray]]:
    """The groups' ranges, in order of their numbers, in slices of bounded size."""
    slices = max(1, -(-groups.count() // RANGES))
    for k in range(slices):
        part = groups if slices == 1 else groups.where(F.pmod(F.xxhash64("group"), F.lit(slices)) == k)
        table = part.select(*_RANGES).toArrow().sort_by("group")
        yield {c: table.column(c).to_numpy() for c in _RANGES}


def _upper(near: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The largest product for an angle of at least ``near`` and products of lengths between ``least`` and ``most``."""
    cosine = np.cos(np.clip(near - SLACK, 0.0, np.pi))
    return np.where(cosine >= 0, most * cosine, least * cosine) + SLACK * np.maximum(1.0, most)


def group_pairs(cells: Cells, tau: float) -> DataFrame:
    """``(owner, other, part)`` for the pairs of groups that may hold products of at least tau, each pair once, a group with itself too;
    an owner's partners are dealt to parts of about ``PARTNERS``."""
    spark = cells.groups.sparkSession
    angles = {w: np.arccos(np.clip(p @ p.T, -1.0, 1.0)) for w, p in cells.pivots.items()}
    path, schema, partners = scratch_path(spark, "pairs"), "owner long, other long, part long", PARTNERS
    for ranges in _ranges(cells.groups):
        parts = max(1, -(-cells.groups.count() // partners))
        shared = spark.sparkContext.broadcast((ranges, angles))

        def pairs(batches: Iterator[pa.RecordBatch], shared=shared, parts=parts) -> Iterator[pa.RecordBatch]:
            r, angles = shared.value
            for row in (x for b in batches for x in b.to_pylist()):
                same = (r["width"] == row["width"]) & (r["group"] >= row["group"]) & (r["low_key"] <= row["high_key"]) & (r["high_key"] >= row["low_key"])
                at = np.flatnonzero(same)
                near = np.zeros(len(at))
                if row["cell"] >= 0:
                    apart = np.where(r["cell"][at] >= 0, angles[row["width"]][row["cell"], r["cell"][at]], 0.0)
                    gaps = (apart - row["hi"] - r["hi"][at], row["lo"] - apart - r["hi"][at], r["lo"][at] - apart - row["hi"])
                    near = np.where(r["cell"][at] >= 0, np.maximum.reduce(gaps), 0.0)
                a, b = np.full(len(at), row["group"]), r["group"][at]
                keep = _upper(near, row["least"] * r["least"][at], row["most"] * r["most"][at]) >= tau
                a, b = a[keep], b[keep]
                turn = (a + b) % 2 == 1  # so that owners have about as many partners each
                owner, other = np.where(turn, b, a), np.where(turn, a, b)
                yield pa.record_batch([pa.array(owner), pa.array(other), pa.array(((other >> 33) * 31 + other) % parts)], names=["owner", "other", "part"])

        cells.groups.select(*_RANGES).mapInArrow(pairs, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def dot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Scores of two blocks of rows; the only kernel that the bounds are for."""
    return left @ right.T


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, whatever the size of the batches; a whole batch is never unpacked, and packed vectors stay Arrow buffers."""
    for batch in batches:
        for k in range(batch.num_rows):
            values = zip(batch.schema.names, batch.columns)
            yield {c: v[k].as_buffer() if pa.types.is_binary(v.type) or pa.types.is_large_binary(v.type) else v[k].as_py() for c, v in values}


def _rows(row: dict) -> np.ndarray:
    return np.frombuffer(row["rows"], float).reshape(row["n"], row["width"])


def _codes(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    """The same small number for the same key."""
    seen: dict = {}
    return tuple(np.array([seen.setdefault(k, len(seen)) for k in keys]) for keys in (a, b))


Tile = Callable[[dict, dict, int, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


def _dealt(cells: Cells, pairs: DataFrame, tasks: int, body: list[str], limits: DataFrame | None = None) -> DataFrame:
    """A row of an owner (no ``other``; ``own`` if it meets itself) for each part of its partners, and after it a row of each of them.
    With ``limits(of, limits)`` owners that have some only, and these along with the owner's row."""
    bounded_batches(cells.groups.sparkSession)
    if limits is not None:
        pairs = pairs.join(limits.select("of").hint("merge"), F.col("owner") == F.col("of"), "left_semi")
    groups = cells.groups.select("group", *body)
    owners = pairs.groupBy("owner", "part").agg(F.max((F.col("owner") == F.col("other")).cast("int")).alias("own"))
    heads = owners.join(groups.hint("merge"), F.col("owner") == F.col("group")).select("owner", "part", F.lit(None).cast("long").alias("other"), "own", *body)
    partners = pairs.where("owner <> other").join(groups.hint("merge"), F.col("other") == F.col("group")).select("owner", "part", "other", F.lit(0).alias("own"), *body)
    if limits is not None:
        heads = heads.join(limits.hint("merge"), F.col("owner") == F.col("of")).drop("of")
        partners = partners.withColumn("limits", F.lit(None).cast(limits.schema["limits"].dataType))
    return heads.union(partners).repartition(max(1, min(tasks, 100_000)), "owner", "part").sortWithinPartitions("owner", "part", F.col("other").asc_nulls_first())


def _multiplied(cells: Cells, tau: float, tile: Tile, schema: str, within: bool, kernel: Kernel = dot) -> DataFrame:
    """What ``tile`` gives for the products of every pair of groups that may reach tau: of (rows of) a group, its partner, the first
    of the rows, the products, and the mask of pairs that count: each once, and of one key, with ``within``."""
    n = cells.groups.count()
    pairs = group_pairs(cells, tau if kernel is dot else float("-inf"))
    dealt = _dealt(cells, pairs, n * max(1, n // PARTNERS), ["width", "n", "ids", "keys", "rows"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = left = None
        for row in _each(batches):
            if row["other"] is None:
                head, left = row, _rows(row)
                if not row["own"]:
                    continue
            right = _rows(row)
            codes = _codes(head["keys"], row["keys"]) if within else None
            step = max(1, TILE_CELLS // max(1, len(right)))
            for first in range(0, len(left), step):
                score = kernel(left[first : first + step], right)
                counts = np.ones(score.shape, bool)
                if row["other"] is None:  # each pair of a group once
                    counts = np.arange(len(right))[None, :] > np.arange(first, first + len(score))[:, None]
                if codes is not None:
                    counts &= codes[0][first : first + step, None] == codes[1][None, :]
                yield from tile(head, row, first, score, counts)
        give_back()

    return dealt.mapInArrow(multiply, schema)


def pairs_at_least(cells: Cells, tau: float, within: bool = False, kernel: Kernel = dot) -> DataFrame:
    """``(x, y, score)`` for all pairs of rows whose score is at least tau, each once in some order; of one key, with ``within``.
    The kernel is symmetric; with another one than the product every pair of groups is looked at."""
    id_type = to_arrow_type(cells.groups.schema["ids"].dataType.elementType)

    def tile(head: dict, row: dict, first: int, score: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j = np.nonzero(counts & (score >= tau))
        if len(i):
            yield pa.record_batch([pa.array([head["ids"][first + k] for k in i], id_type), pa.array([row["ids"][k] for k in j], id_type), pa.array(score[i, j])], names=["x", "y", "score"])

    kind = cells.groups.schema["ids"].dataType.elementType.simpleString()
    return stored(_multiplied(cells, tau, tile, f"x {kind}, y {kind}, score double", within, kernel), "scores")


#: Bins of a key in a round of selection at most, and pairs that a bin is for in the largest keys; products that are looked at one by
#: one, and the width of a range that is narrow enough for it anyway; more than products of one pair of rows in double precision differ by.
SELECT_BINS = 1 << 16
BIN_PAIRS = 2_048
SELECT_VALUES = 1 << 18
SELECT_WIDTH = 1e-12
SLIVER = 1e-14
#: Rows and columns of products that are counted at once, so that they stay in a core's cache.
TILE_SIDE = 512
#: Products of a task, about, and bins that it holds before it hands its counts on.
TASK_PRODUCTS = 1 << 26
HELD_BINS = 1 << 22


class _Counts:
    """Counts of one key's products by pieces: the products of a piece lie between its ends.

    Products are made in single precision, whose error ``slack`` bounds for rows no longer than 1. Without ranges, pieces are bins of
    all that is possible, wider by the slack. With ranges, products clearly outside count for the gap that they are in, and those in or
    near a range are made again in double precision; they count for one of its bins, which ends at its least and most, or, with no bins, as they are.
    """

    def __init__(self, bins: int, ranges: list[dict] | None, width: int):
        self.bins, self.slack = bins, (width + 16) * 2.0**-23
        self.whole = bins > 0 and ranges is None
        if self.whole:
            self.reach = 1.0 + 4 * self.slack
            self.inside = np.zeros(bins + 1, np.int64)  # the last one for what isn't a pair
            return
        joint: list[list[float]] = []
        for low, high in sorted((r["low"], r["high"]) for r in ranges or [{"low": -2.0, "high": 2.0}]):
            if joint and low <= joint[-1][1]:
                joint[-1][1] = max(high, joint[-1][1])
            else:
                joint.append([low, high])
        self.lows, self.highs = np.array(joint).T
        self.gaps = np.zeros(len(joint) + 1, np.int64)
        self.inside = np.zeros(len(joint) * bins, np.int64)
        self.least, self.most = np.full(len(self.inside), np.inf), np.full(len(self.inside), -np.inf)
        self.values, self.waiting, self.waits = np.zeros(0), [], 0
        self.windows: list[list] = []  # what may lie in a range, and the gap below it
        for k, (low, high) in enumerate(joint):
            if self.windows and low - self.slack <= self.windows[-1][1]:
                self.windows[-1][1] = high + self.slack
            else:
                self.windows.append([low - self.slack, high + self.slack, k])

    def add(self, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], own: bool) -> None:
        """Count the products of two blocks of rows, each in double and in single precision; of a block with itself each pair once."""
        rows = left[1] * np.float32(self.bins / (2 * self.reach)) if self.whole else left[1]
        for first in range(0, len(rows), TILE_SIDE):
            for start in range(first if own else 0, len(right[1]), TILE_SIDE):
                score = rows[first : first + TILE_SIDE] @ right[1][start : start + TILE_SIDE].T
                pairs, twice = score.size, own and start == first
                if self.whole:
                    score += np.float32(self.bins / 2)
                if twice:
                    score[np.tril_indices(len(score))] = self.bins if self.whole else np.nan
                    pairs -= len(score) * (len(score) + 1) // 2
                if self.whole:
                    self.inside += np.bincount(score.ravel().astype(np.int64), minlength=self.bins + 1)
                else:
                    self._place(score.ravel(), pairs, left[0][first : first + TILE_SIDE], right[0][start : start + TILE_SIDE])

    def _place(self, score: np.ndarray, pairs: int, left: np.ndarray, right: np.ndarray) -> None:
        before, near, under = 0, np.zeros(len(score), bool), np.empty(len(score), bool)
        for low, high, gap in self.windows:
            np.less(score, low, out=under)
            self.gaps[gap] += np.count_nonzero(under) - before
            near ^= under
            np.less_equal(score, high, out=under)
            before = np.count_nonzero(under)
            near ^= under
        self.gaps[-1] += pairs - before
        at = np.flatnonzero(near)  # what is under a window's upper end, but not under its lower one
        if len(at) * 32 < len(score):
            i, j = np.divmod(at, len(right))
            self._exact(np.einsum("ij,ij->i", left[i], right[j]))
        else:
            self._exact((left @ right.T).ravel()[at])

    def _exact(self, x: np.ndarray) -> None:
        at, above = np.searchsorted(self.lows, x, "right"), np.searchsorted(self.highs, x, "left")
        out = at == above
        if out.any():
            self.gaps += np.bincount(at[out], minlength=len(self.gaps))
            x, above = x[~out], above[~out]
        wide = (self.highs - self.lows)[above]
        nth = np.minimum(((x - self.lows[above]) * (self.bins / wide)).astype(np.int64), self.bins - 1)
        self.waiting.append((x, above * self.bins + nth))
        self.waits += len(x)
        if self.waits > TILE_CELLS:
            self._merge()

    def _merge(self) -> None:
        if self.waiting:
            x, at = (np.concatenate(v) for v in zip(*self.waiting))
            if self.bins:
                self.inside += np.bincount(at, minlength=len(self.inside))
                np.minimum.at(self.least, at, x)
                np.maximum.at(self.most, at, x)
            else:
                n = np.concatenate([self.inside, np.ones(len(x), np.int64)])
                self.values, at = np.unique(np.concatenate([self.values, x]), return_inverse=True)
                self.inside = np.bincount(at, weights=n).astype(np.int64)
        self.waiting, self.waits = [], 0

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where a piece begins, which is the same in all tasks, the ends of what was counted in it, and counts."""
        if self.whole:
            at, wide = np.flatnonzero(self.inside[:-1]), 2 * self.reach / self.bins
            low = at * wide - self.reach - self.slack
            return low, low, low + wide + 2 * self.slack, self.inside[at]
        self._merge()
        begin, low, high, n = self.values, self.values, self.values, self.inside
        if self.bins:
            at = np.flatnonzero(self.inside)
            k, nth = np.divmod(at, self.bins)
            begin, low, high, n = self.lows[k] + nth * ((self.highs - self.lows)[k] / self.bins), self.least[at], self.most[at], self.inside[at]
        some = self.gaps > 0
        under, over = np.append(-2.0, self.highs)[some], np.append(self.lows, 2.0)[some]
        return np.concatenate([under, begin]), np.concatenate([under, low]), np.concatenate([over, high]), np.concatenate([self.gaps[some], n])


def _by_key(row: dict, names: dict) -> dict:
    """A group's rows in double and in single precision by key, of the keys named."""
    rows, at = _rows(row), {}
    for k, name in enumerate(row["keys"]):
        if name in names:
            at.setdefault(name, []).append(k)
    mine = {name: rows if len(k) == len(rows) else rows[k] for name, k in at.items()}
    return {name: (x, x.astype(np.float32)) for name, x in mine.items()}


def _brackets(counts: DataFrame) -> DataFrame:
    """``(key, total, one, two, mid, first, second, inside)`` from counts by pieces: ranges that hold the two middle products, their
    mean, the two middle distances to that mean, and how many products stand where one of the four can be."""
    key = W.partitionBy("key")
    ranks = (F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2))

    def upto(name: str):
        return F.sum("n").over(key.orderBy(name).rowsBetween(W.unboundedPreceding, 0)).alias(name)

    def placed(name: str, rank):
        return F.max(F.when((F.col(f"upto_{name}") > rank) & (F.col(f"upto_{name}") - F.col("n") <= rank), F.col(name))).over(key)

    def between(low: str, high: str, rank):
        return F.struct(placed(low, rank).alias("low"), placed(high, rank).alias("high"))

    rows = counts.withColumns({"total": F.sum("n").over(key), "upto_low": upto("low"), "upto_high": upto("high")})
    rows = rows.withColumns({"one": between("low", "high", ranks[0]), "two": between("low", "high", ranks[1])})
    rows = rows.withColumn("mid", F.struct(*(((F.col(f"one.{e}") + F.col(f"two.{e}")) / 2).alias(e) for e in ("low", "high"))))
    up, down = F.col("low") - F.col("mid.high"), F.col("mid.low") - F.col("high")
    rows = rows.withColumns({"near": F.greatest(F.lit(0.0), up, down), "far": F.greatest(F.col("high") - F.col("mid.low"), F.col("mid.high") - F.col("low"))})
    rows = rows.withColumns({"upto_near": upto("near"), "upto_far": upto("far")})
    rows = rows.withColumns({"first": between("near", "far", ranks[0]), "second": between("near", "far", ranks[1])})
    met = [(F.col(high) >= F.col(f"{r}.low")) & (F.col(low) <= F.col(f"{r}.high")) for r, low, high in (("one", "low", "high"), ("two", "low", "high"), ("first", "near", "far"), ("second", "near", "far"))]
    found = [F.first(c).alias(c) for c in ("total", "one", "two", "mid", "first", "second")]
    return rows.groupBy("key").agg(*found, F.sum(F.when(met[0] | met[1] | met[2] | met[3], F.col("n"))).alias("inside"))


def medians_within(cells: Cells) -> DataFrame:
    """``(key, n, median, mad)`` of the products of each key's pairs: their number, median, and median distance to the median.

    For rows no longer than 1. Exact, and no pair is kept: a round counts all products of the keys still open in pieces of their
    range, which give ranges for the middle ones and for the middle distances to them; the next round counts in pieces of these, until
    they are single values. Keys of fewer than two rows have no row. A null key is a key.
    """
    key = cells.groups.schema["keys"].dataType.elementType
    kind, key_type = key.simpleString(), to_arrow_type(key)
    spark, bins, few = cells.groups.sparkSession, SELECT_BINS, min(SELECT_VALUES, 1 << 10)
    pairs = group_pairs(cells, float("-inf"))
    n, rows = cells.groups.agg(F.count("*"), F.sum("n")).first()
    products = pairs.count() * ((rows or 0) / max(1, n)) ** 2
    tasks = min(2 * pairs.select("owner", "part").distinct().count(), max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(products / TASK_PRODUCTS)))
    each = stored(cells.groups.select("group", F.explode(F.array_distinct("keys")).alias("k")), "each")
    ranged = "array<struct<low:double,high:double>>"

    def binned(expected):
        return F.greatest(F.lit(64), F.least(F.lit(bins), F.greatest(2 * F.sqrt(expected), expected / BIN_PAIRS))).cast("int")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held, mine = {}, {}, {}

        def ended() -> Iterator[pa.RecordBatch]:
            for (name, _), counts in held.items():
                at, low, high, n = counts.pieces()
                yield pa.record_batch([pa.repeat(pa.scalar(name, key_type), len(n)), *map(pa.array, (at, low, high, n))], names=["key", "at", "low", "high", "n"])
            held.clear()

        for row in _each(batches):
            if row["other"] is None:
                if sum(64 + len(c.inside) for c in held.values()) > HELD_BINS:
                    yield from ended()
                for e in row["limits"]:
                    if (e["k"], row["width"]) not in held:
                        held[e["k"], row["width"]] = _Counts(e["bins"], e["ranges"], row["width"])
                mine = {e["k"]: held[e["k"], row["width"]] for e in row["limits"]}
                head = _by_key(row, mine)
            if row["other"] is not None or row["own"]:
                for name, rows in (head if row["other"] is None else _by_key(row, mine)).items():
                    mine[name].add(head[name], rows, row["other"] is None)
        yield from ended()
        give_back()

    size = F.count("*").cast("long")
    rows = cells.groups.select(F.explode("keys").alias("key")).groupBy("key").agg((size * (size - 1) / 2).alias("pairs")).where("pairs > 0")
    limits = stored(rows.select("key", F.when(F.col("pairs") > few, binned(F.col("pairs"))).otherwise(0).alias("bins"), F.lit(None).cast(ranged).alias("ranges")), "limits")
    done = []
    while True:
        own = each.join(limits.hint("merge"), F.col("k").eqNullSafe(F.col("key"))).groupBy(F.col("group").alias("of")).agg(F.collect_list(F.struct("k", "bins", "ranges")).alias("limits"))
        dealt = _dealt(cells, pairs, tasks, ["width", "n", "keys", "rows"], stored(own, "limits"))
        counts = dealt.mapInArrow(count, f"key {kind}, at double, low double, high double, n long")
        counts = counts.groupBy("key", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        found = stored(_brackets(stored(counts, "counts")), "brackets")
        wide = {c: F.col(f"{c}.high") - F.col(f"{c}.low") for c in ("one", "two", "mid", "first", "second")}
        widest = F.greatest(wide["one"], wide["two"], wide["mid"] + wide["first"], wide["mid"] + wide["second"])
        done.append(found.where(widest == 0).select("key", F.col("total").alias("n"), F.col("mid.low").alias("median"), ((F.col("first.low") + F.col("second.low")) / 2).alias("mad")))
        ends = [(F.col(f"{c}.low"), F.col(f"{c}.high")) for c in ("one", "two")]
        for c in ("first", "second"):
            ends += [(F.col("mid.low") - F.col(f"{c}.high"), F.col("mid.high") - F.col(f"{c}.low")), (F.col("mid.low") + F.col(f"{c}.low"), F.col("mid.high") + F.col(f"{c}.high"))]
        ranges = F.array(*(F.struct((low - SLIVER).alias("low"), (high + SLIVER).alias("high")) for low, high in ends))
        values = (F.col("inside") <= SELECT_VALUES) | (widest <= SELECT_WIDTH)
        limits = stored(found.where(widest > 0).select("key", F.when(values, 0).otherwise(binned(F.col("inside"))).alias("bins"), ranges.alias("ranges")), "limits")
        if limits.isEmpty():
            return reduce(DataFrame.union, done)


def _best(score: np.ndarray, cap: int) -> np.ndarray:
    """Mask of each row's ``cap`` largest, ties to the first."""
    if score.shape[1] <= cap:
        return np.ones(score.shape, bool)
    last = -np.partition(-score, cap - 1, axis=1)[:, cap - 1 : cap]
    above, ties = score > last, score == last
    return above | (ties & (np.cumsum(ties, axis=1) <= cap - above.sum(axis=1, keepdims=True)))


def _asked(cells: Cells, queries: DataFrame, cap: int, first_round: bool) -> DataFrame:
    """Packed queries for each group: in the first round for the groups with the best bounds that hold ``cap`` rows together, in
    the second for all others whose bound reaches the query's ``kth`` score so far; without pivots all in the first.
    ``queries(query_id, vector, kth, ...)``."""
    spark = queries.sparkSession
    path = scratch_path(spark, "asked")
    kind = queries.schema["query_id"].dataType
    id_type = to_arrow_type(kind)
    schema = f"group long, cell int, width int, n int, query_ids array<{kind.simpleString()}>, queries binary"
    for ranges in _ranges(cells.groups):
        shared = spark.sparkContext.broadcast((ranges, cells.pivots))

        def ask(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            r, pivots = shared.value
            for batch in batches:
                widths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                kth = batch.column(2).to_numpy(zero_copy_only=False)
                for width in np.unique(widths):
                    mine, at = np.flatnonzero(widths == width), np.flatnonzero(r["width"] == width)
                    if not len(at):
                        continue
                    rows = _matrix(batch.column(1).take(pa.array(mine)), int(width))
                    wanted = np.zeros((len(mine), len(at)), bool)
                    step = max(1, TILE_CELLS // len(at))
                    for first in range(0, len(mine), step):
                        part = slice(first, first + step)
                        size = np.linalg.norm(rows[part], axis=1, keepdims=True)
                        near = np.zeros((len(size), len(at)))
                        if int(width) in pivots:
                            apart = _angles(rows[part], pivots[int(width)])[:, np.maximum(r["cell"][at], 0)]
                            near = np.where(np.isnan(apart) | (r["cell"][at] < 0), 0.0, np.maximum(apart - r["hi"][at], r["lo"][at] - apart))
                        upper = _upper(near, size * r["least"][at], size * r["most"][at])
                        order = np.argsort(-upper, axis=1, kind="stable")
                        before = np.cumsum(r["n"][at][order], axis=1) - r["n"][at][order]
                        early = np.zeros(upper.shape, bool)
                        np.put_along_axis(early, order, (before < cap) | (not pivots), axis=1)
                        wanted[part] = early if first_round else ~early & (upper >= kth[mine[part], None])
                    for g in np.flatnonzero(wanted.any(axis=0)):
                        who = np.flatnonzero(wanted[:, g])
                        ids = batch.column(0).take(pa.array(mine[who])).to_pylist()
                        yield pa.record_batch([pa.array([r["group"][at[g]]]), pa.array([r["cell"][at[g]]], pa.int32()), pa.array([width], pa.int32()), pa.array([len(who)], pa.int32()), pa.array([ids], pa.list_(id_type)), pa.array([rows[who].tobytes()])], names=["group", "cell", "width", "n", "query_ids", "queries"])

        queries.select("query_id", "vector", "kth").mapInArrow(ask, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _answered(cells: Cells, asked: DataFrame, cap: int, kernel: Kernel) -> DataFrame:
    """``(query_id, id, score)``: the best ``cap`` rows of each group for each query that asks it. Only the cells asked are read."""
    kind, id_kind = (t.elementType for t in (asked.schema["query_ids"].dataType, cells.groups.schema["ids"].dataType))
    needed = [r[0] for r in asked.select("cell").distinct().collect()]  # as many as there are pivots at most
    groups = cells.groups.where(F.col("cell").isin(needed)).select("group", "ids", "rows", F.col("n").alias("m"))
    bounded_batches(asked.sparkSession)
    pairs = asked.join(groups.hint("merge"), "group").select("width", "n", "query_ids", "queries", "m", "ids", "rows")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            left = np.frombuffer(row["queries"], float).reshape(row["n"], row["width"])
            right = np.frombuffer(row["rows"], float).reshape(row["m"], row["width"])
            step = max(1, TILE_CELLS // max(1, len(right)))
            for first in range(0, len(left), step):
                score = kernel(left[first : first + step], right)
                i, j = np.nonzero(_best(score, cap))
                yield pa.record_batch([pa.array([row["query_ids"][first + k] for k in i], to_arrow_type(kind)), pa.array([row["ids"][k] for k in j], to_arrow_type(id_kind)), pa.array(score[i, j])], names=["query_id", "id", "score"])

    return stored(pairs.mapInArrow(answer, f"query_id {kind.simpleString()}, id {id_kind.simpleString()}, score double"), "answers")


def best_rows(cells: Cells, queries: DataFrame, cap: int, kernel: Kernel = dot) -> DataFrame:
    """``(query_id, id, score, nth)``: exactly the ``cap`` best rows for each of ``queries(query_id, vector)``, ties by id; with another
    kernel than the product the cells are without pivots.

    The groups with the best bounds are searched first; all others whose bound does not stay below a query's ``cap``-th score
    follow. Repeated query ids are one query with the vectors' results together.
    """
    asked = stored(queries.where(whole()).select("query_id", "vector"), "queries")
    asked = asked.repartition(max(1, -(-asked.count() // QUERY_ROWS)))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    first = _answered(cells, _asked(cells, asked.withColumn("kth", F.lit(0.0)), cap, True), cap, kernel)
    if not cells.pivots:
        return first.withColumn("nth", nth).where(F.col("nth") <= cap)
    so_far = first.withColumn("nth", nth).where(F.col("nth") == cap).select(F.col("query_id").alias("q"), F.col("score").alias("kth"))
    limits = asked.join(so_far.hint("merge"), F.col("query_id").eqNullSafe(F.col("q")), "left").select("query_id", "vector", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    second = _answered(cells, _asked(cells, stored(limits, "limits"), cap, False), cap, kernel)
    return first.union(second).withColumn("nth", nth).where(F.col("nth") <= cap)


def open_index(spark: SparkSession, home: str) -> Cells:
    """The index in ``home``: its pivots and, by cell, its groups."""
    pivots: dict[int, list] = {}
    for row in spark.read.parquet(f"{home}/pivots").orderBy("width", "nth").collect():  # MOST_PIVOTS at most
        pivots.setdefault(row.width, []).append(row.vector)
    schema = spark.read.parquet(f"{home}/schema").schema  # there may be no group yet
    return Cells(spark.read.schema(schema).parquet(f"{home}/groups"), {w: np.array(v) for w, v in pivots.items()})


def is_index(spark: SparkSession, home: str) -> bool:
    try:
        return not spark.read.parquet(f"{home}/made").isEmpty()
    except AnalysisException:
        return False


def create_index(vectors: DataFrame, home: str) -> Cells:
    """A search index of ``vectors(id, vector)`` in the folder ``home``; rows of one id are one row, the least vector."""
    spark = vectors.sparkSession
    rows = stored(vectors.where(whole()).groupBy("id").agg(F.min("vector").alias("vector")), "rows")
    n = rows.count()
    size = max(LEAST_ROWS, min(MOST_ROWS, n // 32))
    pivots = _pivots(rows, min(MOST_PIVOTS, n // size + 1))
    flat = [(w, k, v.tolist()) for w, p in pivots.items() for k, v in enumerate(p)]
    spark.createDataFrame(flat, "width int, nth int, vector array<double>").write.mode("overwrite").parquet(f"{home}/pivots")
    made = build(rows, pivots=pivots, home=home, mode="overwrite")
    made.groups.limit(0).write.mode("overwrite").parquet(f"{home}/schema")
    spark.range(1).write.parquet(f"{home}/made")  # an index that was broken off before is made anew by its caller
    return made


def append_index(vectors: DataFrame, home: str) -> Cells:
    """Add rows to the index; known ids are ignored, and of rows with one new id one is taken. Groups are added to cells, none is rewritten."""
    index = open_index(vectors.sparkSession, home)
    known = stored(index.groups.select(F.explode("ids").alias("known")), "known")
    new = vectors.where(whole()).groupBy("id").agg(F.min("vector").alias("vector"))
    new = new.join(known.hint("merge"), F.col("id").eqNullSafe(F.col("known")), "left_anti")
    last = index.groups.agg(F.max("group")).first()[0] or 0
    return build(new, pivots=index.pivots, home=home, after=((last >> 33) + 1) << 33)
