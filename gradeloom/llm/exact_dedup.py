"""Stateful streaming deduplication on exact content.

Arrivals (digest, identifier, locator, no text) are a log in the shared folder, a folder for each call.
A Structured Streaming query folds the log into keyed state held by RocksDB on the executors' disks and
checkpointed to the shared folder: per digest the identifier to keep, its content locator (file and
row), the locator of the first arrival and the number of arrivals. The state never expires, so a later
call with the same ``state_folder`` resumes where the last one ended. Digest hits are then verified:
the full text of every hit is compared with the text of the digest's first arrival, read through its
locator where it came with an earlier call. Texts that share a digest without being equal are recorded
in the state folder as *splits* and form groups of their own, in later calls too.

Everything on the path is DataFrame, SQL and Structured Streaming functions.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.session import scratch_path, stored

from .locators import LOCATOR, locators, strategy, with_files, without_rows

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KEEP = "struct(doc_id, file, row)"


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def ingest(spark: SparkSession, arrivals: str, schema, state_folder: str) -> DataFrame:
    """Fold new arrivals into the state; returns ``(digest, keep, first, group_size)``, the newest of each digest."""

    def publish(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{state_folder}/index/batch={batch}")

    before = {key: spark.conf.get(key, None) for key in ROCKSDB}
    try:
        for key, value in ROCKSDB.items():
            spark.conf.set(key, value)
        groups = (
            spark.readStream.schema(schema)
            .parquet(arrivals)
            .groupBy("digest")
            .agg(F.max(F.expr(_KEEP)).alias("keep"), F.min(F.struct("call", *LOCATOR)).alias("first"), F.count("*").alias("group_size"))
        )
        query = (
            groups.writeStream.outputMode("update")
            .option("checkpointLocation", f"{state_folder}/state")
            .trigger(availableNow=True)
            .foreachBatch(publish)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    schema = groups.schema.add("batch", "long")
    newest = F.max_by(F.struct("keep", "first", "group_size"), "batch").alias("g")
    return spark.read.schema(schema).parquet(f"{state_folder}/index").groupBy("digest").agg(newest).select("digest", "g.*")


def _written(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The table at ``path``, or None where nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return None


def _call_of(spark: SparkSession, state_folder: str, label: str | None) -> tuple[int, bool]:
    """This call's number, and whether the arrivals of its label are complete already."""
    known = _written(spark, f"{state_folder}/calls", "label string, call long")
    if known is None:
        return 0, False
    again = known.where(F.col("label") == F.lit(label).cast("string")).agg(F.max("call")).first()[0]
    return (1 + known.agg(F.max("call")).first()[0], False) if again is None else (again, True)


def _contents(spark: SparkSession, at: DataFrame) -> DataFrame:
    """``at(file, row, ...)`` with ``content``, the folded text at each locator; files are named on the driver."""
    files = [unquote(r["file"]) for r in at.select("file").distinct().collect()]
    if not files:
        return at.withColumn("content", F.lit(None).cast("string"))
    found = spark.read.parquet(*files)
    texts = found.select(*locators(found), fold_ascii(F.col("text")).alias("content"))
    return texts.join(strategy(at), list(LOCATOR))


def groups(
    docs: DataFrame, state_folder: str | None = None, digest: Callable[[Column], Column] | None = None, label: str | None = None
) -> DataFrame:
    """``(file, row, doc_id, keep_id, group_size, kept, text_sha256)`` for every row that has arrived.

    Equal texts, after folding A-Z, are a group; the row with the largest doc_id is kept, and of
    repeated rows with that id the one stored last. Null ids sort below all others. Null text counts
    as empty, and empty texts are equal. Columns other than doc_id and text are ignored. An empty
    table gives no rows. ``digest`` maps folded text to the state's key (SHA-256 unless given).

    With a ``state_folder`` the rows of earlier calls are part of the result, and the Parquet files
    that they came from must still be there where a digest comes again. A call that failed can be run
    again under its ``label``: its rows count once. Calls on one folder follow one another.
    """
    spark = docs.sparkSession
    state_folder = state_folder or scratch_path(spark, "dedup")
    digest = digest or (lambda text: F.unhex(F.sha2(text, 256)))
    call, again = _call_of(spark, state_folder, label)
    log = f"{state_folder}/arrivals"
    folded = fold_ascii(F.col("text"))
    schema = docs.select("doc_id", F.lit("").alias("file"), F.lit(0).cast("long").alias("row"), digest(folded).alias("digest"), F.lit("").alias("text_sha256")).schema
    if not again:
        docs = with_files(docs)
        rows = docs.select("doc_id", "text", *locators(docs))
        light = rows.select("doc_id", *LOCATOR, digest(folded).alias("digest"), F.sha2(folded, 256).alias("text_sha256"))
        light.write.mode("overwrite").parquet(f"{log}/call={call}")
        spark.range(1).select(F.lit(label).cast("string").alias("label"), F.lit(call).cast("long").alias("call")).write.mode("append").parquet(f"{state_folder}/calls")
    schema = schema.add("call", "long")
    arrivals = spark.read.schema(schema).parquet(log)
    index = stored(ingest(spark, log, schema, state_folder), "index")

    # full bytes of every hit against the text of the digest's first arrival
    several = stored(index.where("group_size > 1").select("digest", "first"), "several")
    if again:
        came = arrivals.where(F.col("call") == call).select(*LOCATOR, "doc_id", "digest")
        texts = _contents(spark, stored(came.join(several.hint("merge"), "digest"), "came"))
    else:
        texts = rows.select(*LOCATOR, "doc_id", digest(folded).alias("digest"), folded.alias("content"))
        texts = texts.join(strategy(several), "digest")
    texts = stored(texts.withColumn("is_first", F.expr("first.file = file and first.row = row")).drop("first"), "hits")
    first = texts.where("is_first").select("digest", F.col("content").alias("first_content"))
    if call > 0:
        earlier = several.where(F.col("first.call") < call).join(texts.select("digest").distinct().hint("merge"), "digest", "left_semi")
        earlier = stored(earlier.select("digest", "first.file", "first.row"), "earlier")
        first = first.unionByName(_contents(spark, earlier).select("digest", F.col("content").alias("first_content")))
    differ = texts.where("not is_first").join(first.hint("merge"), "digest").where("content <> first_content")
    differ.select(*LOCATOR, "doc_id", "digest").write.mode("overwrite").parquet(f"{state_folder}/splits/call={call}")

    splits = spark.read.schema(differ.select(*LOCATOR, "doc_id", "digest").schema).parquet(f"{state_folder}/splits")
    found = arrivals.join(index.hint("merge"), "digest")
    if splits.limit(1).count():
        apart = stored(_contents(spark, stored(splits, "splits")), "apart")
        split = apart.groupBy("digest", "content").agg(F.max(F.expr(_KEEP)).alias("own_keep"), F.count("*").alias("own_size"))
        own = apart.join(split.hint("merge"), ["digest", "content"]).select(*LOCATOR, "own_keep", "own_size")
        rest = arrivals.join(splits.select("digest").distinct().hint("merge"), "digest", "left_semi")
        rest = rest.join(splits.select(*LOCATOR).hint("merge"), list(LOCATOR), "left_anti")
        rest = rest.groupBy("digest").agg(F.max(F.expr(_KEEP)).alias("rest_keep"), F.count("*").alias("rest_size"))
        found = (
            found.join(own.hint("merge"), list(LOCATOR), "left")
            .join(rest.hint("merge"), "digest", "left")
            .withColumn("group_size", F.coalesce("own_size", "rest_size", "group_size"))
            .withColumn("keep", F.coalesce("own_keep", "rest_keep", "keep"))
        )
    return found.select(
        *LOCATOR,
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        F.expr("keep.file = file and keep.row = row").alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``groups`` keeps, with all their columns."""
    docs = with_files(docs)
    return without_rows(docs, groups(docs).where("not kept"))
