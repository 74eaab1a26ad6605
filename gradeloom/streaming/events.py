"""Streams: typed events, counts and learner updates; emergent clusters and a growing index by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gradeloom.operators import cells
from gradeloom.operators.upserts import upsert_knowledge_state
from gradeloom.session import scratch_path, stored
from gradeloom.streaming.points import Members, Point, Points


def subscribe(stream: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Events of the given types; none given is all of them."""
    return stream if types is None else stream.where(F.col("type").isin(*types))


def event_stats(stream: DataFrame, window: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by type; with a window, by event time with late events dropped."""
    if window is None:
        return stream.groupBy("type").agg(F.count("*").alias("n"))
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "type").agg(F.count("*").alias("n")).select("window.start", "type", "n")


def confusion_window(stream: DataFrame, horizon: str = "30 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Confusions per topic over a sliding horizon."""
    timed = stream.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    return timed.groupBy(F.window("created_at", horizon, slide), "topic").agg(F.count("*").alias("n")).select(F.col("window.end").alias("until"), "topic", "n")


def _run(stream: DataFrame, publish: Callable[[DataFrame, int], None], state: str, mode: str) -> None:
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(publish).start()
    query.awaitTermination()


def run_to_table(stream: DataFrame, spark: SparkSession, mode: str = "append", keys: Sequence[str] = (), home: str | None = None) -> DataFrame:
    """Run a stream over what is there now; its result is written to the shared folder and read back.

    Each micro-batch has its own folder, so one that is run again replaces itself. In ``update`` mode the
    last row of each of the ``keys`` counts. A call with the same ``home`` goes on where the last one ended.
    """
    home = home or scratch_path(spark, "stream")

    def publish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/rows/batch={number}")

    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{home}/rows/batch=-1")  # for a stream without batches
    _run(stream, publish, f"{home}/state", mode)
    rows = spark.read.schema(f"{_ddl(stream)}, batch long").parquet(f"{home}/rows")
    if mode == "update":
        rows = rows.groupBy(*keys).agg(*(F.max_by(c, "batch").alias(c) for c in stream.columns if c not in keys))
    return rows.select(*stream.columns)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def fold_stream(stream: DataFrame, first: DataFrame, step: Callable[[DataFrame, DataFrame], tuple[DataFrame, ...]], home: str | None = None) -> tuple[DataFrame, str]:
    """Fold a table over the micro-batches of a stream.

    ``step(table, batch)`` gives the new table and further outputs, which go to ``home/out=<nth>/batch=<number>``.
    Version n is made from version n - 1 and batch n alone, so a batch that is run again replaces what it wrote.
    Returns the newest version and ``home``; a call with the same ``home`` goes on from there. Nothing of
    ``home`` is deleted here. An empty version, or a stream without batches, is an empty table or ``first``.
    """
    spark = first.sparkSession
    home = home or scratch_path(spark, "fold")
    marks = "batch long, version long"

    def version(number: int) -> DataFrame:
        return first if number < 0 else spark.read.schema(first.schema).parquet(f"{home}/table/{number}")

    def publish(batch: DataFrame, number: int) -> None:
        table, *outputs = step(version(number - 1), batch)
        table.select(*first.columns).write.mode("overwrite").parquet(f"{home}/table/{number}")
        for nth, rows in enumerate(outputs):
            rows.write.mode("overwrite").parquet(f"{home}/out={nth}/batch={number}")
        spark.createDataFrame([(number, number)], marks).write.mode("overwrite").parquet(f"{home}/done/{number}")

    spark.createDataFrame([], marks).write.mode("append").parquet(f"{home}/done/none")
    _run(stream, publish, f"{home}/state", "append")
    last = spark.read.schema(marks).option("recursiveFileLookup", True).parquet(f"{home}/done").agg(F.max("version")).first()[0]
    return version(-1 if last is None else last), home


def student_updates(turns: DataFrame, retrieved: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A batch of chat turns: memories, 'learning' states and trajectory rows of the two best topics."""
    asked = turns.where("role = 'user'")
    memory = asked.select("student_id", F.lit("question").alias("kind"), F.col("content"), "ts")
    top = retrieved.where("nth <= 2").join(asked.select("query_id", "student_id", "ts"), "query_id").select("student_id", "topic", "ts")
    return memory, upsert_knowledge_state(states, top.withColumn("state", F.lit("learning"))), top


def student_stream(turns: DataFrame, retrieved: DataFrame, states: DataFrame, home: str | None = None) -> tuple[DataFrame, str]:
    """``student_updates`` by micro-batch: the states after the last one, and the folder of memories and trajectory rows."""

    def step(now: DataFrame, batch: DataFrame) -> tuple[DataFrame, ...]:
        memory, new, top = student_updates(batch, retrieved, now)
        return new, memory, top

    return fold_stream(turns, states, step, home)


_ARRIVALS = "subject string, seq long, kind string, id long, kp_id string, quality string, vector array<double>"
_FOUND = "subject string, seq long, id long, kp_id string, event string, similarity double, embryonic long"
#: Kinds of arrivals in the order they are taken within a place of the sequence.
_KINDS = ("point", "member", "question", "paper_end")


def arrivals(questions: DataFrame, points: DataFrame | None = None, members: DataFrame | None = None, papers: DataFrame | None = None) -> DataFrame:
    """What subjects' points grow from, as one table: ``questions(subject, seq, id, vector)``, ends of papers ``papers(subject, seq)``, and
    what is there before them: ``points(subject, kp_id, vector, quality)`` and their ``members(subject, kp_id, id, vector)``."""
    spark = questions.sparkSession
    parts = [questions.withColumn("kind", F.lit("question"))]
    parts += [df.withColumn("kind", F.lit(kind)) for kind, df in (("point", points), ("member", members), ("paper_end", papers)) if df is not None]
    wanted = spark.createDataFrame([], _ARRIVALS).schema
    rows = [df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted)) for df in parts]
    return reduce(DataFrame.union, rows)


def _in_order() -> list[Column]:
    kind = F.array_position(F.array(*map(F.lit, _KINDS)), F.col("kind"))
    return [F.col("seq").asc_nulls_first(), kind, F.col("kp_id").asc_nulls_first(), F.col("id").asc_nulls_first()]


def _take(points: Points, row) -> Iterator[tuple]:
    """One arrival; rows of ``_FOUND``. A row without a whole, finite vector takes no part, but for the end of a paper."""
    if row.kind == "paper_end":
        out, young = points.end_paper()
        yield from ((row.subject, row.seq, None, name, event, value, None) for name, event, value in out)
        yield row.subject, row.seq, None, None, "paper_completed", None, young
        return
    v = None if row.vector is None else np.asarray(row.vector, float)
    if v is None or not np.isfinite(v).all() or (points.names and points.centres.shape[1] != len(v)):
        return
    if row.kind == "point":
        points.give(row.kp_id, v, row.quality != "embryonic")
    elif row.kind == "member":
        points.add_member(row.kp_id, v)
    else:
        yield (row.subject, row.seq, row.id, *points.place(row.id, v), None)


_FOUND_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[t]) for n, t in (f.split() for f in _FOUND.split(", "))])


def with_quality(found: DataFrame, least: int = 3, members: DataFrame | None = None) -> DataFrame:
    """Assignments with the members of their point, those of ``members(kp_id)`` included, and its quality: stable from ``least`` on."""
    placed = found.where("id is not null").select("subject", "seq", "id", "kp_id", "event", "similarity")
    each = placed.select("subject", "kp_id")
    each = each if members is None else each.union(members.select("subject", "kp_id"))
    sizes = each.groupBy("subject", "kp_id").agg(F.count("*").alias("members"))
    rows = placed.join(sizes.select(F.col("subject").alias("of"), F.col("kp_id").alias("point"), "members").hint("merge"), F.col("subject").eqNullSafe(F.col("of")) & (F.col("kp_id") == F.col("point"))).drop("of", "point")
    return rows.withColumn("quality", F.when(F.col("members") >= least, F.lit("stable")).otherwise("embryonic"))


def assign_emergent(rows: DataFrame, floor: float = 0.50, spread: float = 1.0, least: int = 3, decay: float = 0.05) -> DataFrame:
    """Points that grow as questions arrive, one subject at a time in order; ``rows`` as ``arrivals`` makes them.

    A question joins its nearest point if their cosine reaches the point's threshold, and the point's centroid becomes its
    members' mean; else it founds ``kp_emb_<id>``. The threshold is ``floor`` below ``least`` members, from there on the median of
    the members' pairwise cosines less ``spread`` times their median absolute deviation, if that is more. At the end of a paper points
    that are embryonic and have fewer than ``least`` members fade by ``decay``, the others become stable.

    Rows are ``(subject, seq, id, kp_id, event, similarity, embryonic)``: ``created`` and ``assigned`` questions, points ``promoted``
    or ``faded`` (with their centroid's length), and ``paper_completed`` with the number of embryonic points. The order matters, so a subject is
    one sequential state (its centroids and members' vectors, not their pairs), read in batches. A null subject is one of its own;
    questions without a whole, finite vector of the subject's width take no part; ties in order are taken by id.
    """

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, at = None, None
        for batch in batches:
            out = []
            for row in (Row(**r) for r in batch.to_pylist()):
                if points is None or row.subject != at:  # sorted: the subject before has ended
                    points, at = Points(floor, spread, least, decay), row.subject
                out.extend(_take(points, row))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * len(_FOUND_ARROW), _FOUND_ARROW)], schema=_FOUND_ARROW)

    dealt = rows.select("subject", *_ARRIVAL_COLUMNS).repartition("subject").sortWithinPartitions("subject", *_in_order())
    return stored(dealt.mapInArrow(grow, _FOUND), "found")


_ARRIVAL_COLUMNS = ("seq", "kind", "id", "kp_id", "quality", "vector")


class _PointState(StatefulProcessor):
    """A subject's points as keyed state: an entry for each point and for each block of members, written only where changed."""

    def __init__(self, floor: float, spread: float, least: int, decay: float):
        self.settings = (floor, spread, least, decay)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.heads = handle.getMapState("points", "kp_id string", "nth long, centre binary, total binary, n long, stable boolean, bins binary, counts binary")
        self.rows = handle.getMapState("members", "kp_id string, block long", "rows binary")

    def handleInputRows(self, key, rows, timerValues):
        numbers = lambda x, kind=float: np.frombuffer(x, kind).copy()
        heads = sorted(((value, name) for (name,), value in self.heads.iterator()), key=lambda h: h[0][0]) if self.heads.exists() else []
        points = [Point(name, numbers(h[1]), numbers(h[2]), h[3], h[4], numbers(h[5], np.int64), numbers(h[6], np.int64)) for h, name in heads]

        def read(name: str, k: int) -> np.ndarray | None:
            found = self.rows.getValue((name, k)) if self.rows.containsKey((name, k)) else None
            return None if found is None else numbers(found[0]).reshape(-1, len(points[0].centre))

        members = Members(read, lambda name, k, block: self.rows.updateValue((name, k), (block.tobytes(),)))
        now = Points(*self.settings, members, points)
        none_first = lambda x: (x is not None, 0 if x is None else x)
        batch = sorted(rows, key=lambda r: (none_first(r.seq), _KINDS.index(r.kind), r.kp_id or "", none_first(r.id)))
        out = [found for row in batch for found in _take(now, row)]
        members.save()
        for nth, name in enumerate(now.names):
            if name in now.changed:
                p = now.points[name]
                self.heads.updateValue((name,), (nth, p.centre.tobytes(), p.total.tobytes(), p.n, p.stable, p.bins.tobytes(), p.counts.tobytes()))
        yield from (Row(**dict(zip(_FOUND_ARROW.names, x))) for x in out)

    def close(self) -> None:
        pass


def assign_stream(stream: DataFrame, floor: float = 0.50, spread: float = 1.0, least: int = 3, decay: float = 0.05) -> DataFrame:
    """``assign_emergent`` on a stream of ``arrivals``: points and members are keyed state, ends of papers are rows of the stream.

    The state is kept from micro-batch to micro-batch and over restarts, and only points and blocks of members that
    a batch changes are written. Within a micro-batch rows are taken in order; one that comes later than its order
    is taken when it comes. A micro-batch of a subject is held by one task: bound it at the source (``maxFilesPerTrigger``).
    Needs the RocksDB state store (``with_rocksdb``).
    """
    processor = _PointState(floor, spread, least, decay)
    rows = stream.select("subject", *_ARRIVAL_COLUMNS).groupBy("subject")
    return rows.transformWithState(processor, _FOUND, "Append", "None")


#: Settings of the state store on the executors' disks.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """The session with the RocksDB state store; its own settings come back afterwards."""
    before = {key: spark.conf.get(key, None) for key in ROCKSDB}
    try:
        for key, value in ROCKSDB.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def index_stream(first: DataFrame, stream: DataFrame, home: str) -> None:
    """Add a stream ``(id, vector)`` to the search index in ``home``, which is made of ``first`` if there is none.

    A micro-batch is searchable when its append has ended; known ids are ignored, so one that is run again adds nothing twice. A call
    with the same ``home`` goes on where the last one ended.
    """
    if not cells.is_index(first.sparkSession, home):
        cells.create_index(first, home)
    _run(stream, lambda batch, number: cells.append_index(batch, home), f"{home}/state", "append")
