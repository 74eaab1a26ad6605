"""Keyed writes: each returns the new state of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"n.{k}") == F.col(f"o.{k}") for k in keys))


def insert_qa(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("question_text", "answer_text"), order: str = "id") -> DataFrame:
    """Add rows whose texts are new; of equal new rows the first by ``order`` stays."""
    first = new.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_nth = 1").drop("_nth")
    return existing.unionByName(first.join(existing, list(keys), "left_anti").select(*existing.columns))


def insert_ignore(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    return existing.unionByName(new.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti").select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """New rows replace those of the same key; columns that ``new`` lacks keep their old values."""
    joined = existing.alias("o").join(new.alias("n"), _same(list(keys)), "full_outer")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")
    return joined.select(*(pick(c).alias(c) for c in existing.columns))


def accumulate_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Add counts; links without an end and self links are dropped."""
    rows = links.unionByName(new).where("src_topic <> '' and dst_topic <> '' and src_topic <> dst_topic")
    return rows.groupBy("src_topic", "dst_topic").agg(F.sum("count").alias("count"))


def upsert_knowledge_state(states: DataFrame, seen: DataFrame) -> DataFrame:
    """Latest state and evidence count per learner and topic; ``states`` counts as older."""
    new = seen.groupBy("student_id", "topic").agg(F.max_by("state", "ts").alias("state"), F.count("*").alias("evidence_count"))
    joined = states.alias("o").join(new.alias("n"), _same(["student_id", "topic"]), "full_outer")
    return joined.select(
        *(F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in ("student_id", "topic", "state")),
        (F.coalesce("o.evidence_count", F.lit(0)) + F.coalesce("n.evidence_count", F.lit(0))).alias("evidence_count"),
    )


def record_attempts(qa: DataFrame, attempts: DataFrame) -> DataFrame:
    """Add attempts; the last attempt decides the failure reason (a success clears it)."""
    new = attempts.groupBy("qa_id").agg(
        F.count_if("success").alias("s"), F.count("*").alias("t"), F.max_by(F.struct(F.when(F.col("success"), F.lit("")).otherwise(F.col("reason")).alias("reason")), "seq").alias("last")
    )
    rows = qa.join(new, qa["id"] == new["qa_id"], "left")
    return rows.select(
        *(c for c in qa.columns if c not in ("success_count", "total_attempts", "last_failure_reason")),
        (F.col("success_count") + F.coalesce("s", F.lit(0))).alias("success_count"),
        (F.col("total_attempts") + F.coalesce("t", F.lit(0))).alias("total_attempts"),
        F.when(F.col("t").isNotNull(), F.col("last.reason")).otherwise(F.col("last_failure_reason")).alias("last_failure_reason"),
    )


def fix_counters(qa: DataFrame) -> DataFrame:
    """No more successes than attempts; ``fixed`` marks the rows that were changed."""
    return qa.withColumn("fixed", F.col("success_count") > F.col("total_attempts")).withColumn("success_count", F.least("success_count", "total_attempts"))


def bump_upsert(existing: DataFrame, new: DataFrame, counter: str, *keys: str) -> DataFrame:
    """Upsert that counts writes: the counter of a written row is its old value plus one."""
    old = existing.select(*keys, F.col(counter).alias("_old"))
    return upsert(existing, new.drop(counter).join(old, list(keys), "left").withColumn(counter, F.coalesce("_old", F.lit(0)) + 1).drop("_old"), *keys)


def set_membership(members: DataFrame, moves: DataFrame) -> DataFrame:
    """Move fragments to topics and remember where they came from."""
    joined = members.alias("o").join(moves.alias("n"), F.col("o.fragment_id") == F.col("n.fragment_id"), "full_outer")
    moved = F.col("n.topic_id").isNotNull()
    return joined.select(
        F.coalesce("n.fragment_id", "o.fragment_id").alias("fragment_id"),
        F.coalesce("n.topic_id", "o.topic_id").alias("topic_id"),
        F.when(moved, F.col("o.topic_id")).otherwise(F.col("o.previous_topic_id")).alias("previous_topic_id"),
    )


def upsert_dependencies(stored: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Refresh dependencies; the first sighting of a stored one stays."""
    rows = upsert(stored, new.withColumn("last_seen_at", now), "prerequisite", "dependent")
    return rows.withColumn("first_seen_at", F.coalesce("first_seen_at", now))


def replace_edges(edges: DataFrame, fused: DataFrame) -> DataFrame:
    """All types of a fused pair give way to the fused row."""
    return edges.join(fused.select("source", "target").distinct(), ["source", "target"], "left_anti").select(*edges.columns).unionByName(fused)


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def rename_topics(qa: DataFrame, mapping: DataFrame) -> DataFrame:
    """Topics through a table ``(old, new)``; others stay."""
    return qa.join(mapping.select(F.col("old").alias("topic"), F.col("new").alias("_new")), "topic", "left").withColumn("topic", F.coalesce("_new", "topic")).drop("_new")


def backfill_sessions(qa: DataFrame, sessions: DataFrame) -> DataFrame:
    of = sessions.select(F.col("display_name").alias("paper"), F.col("id").alias("_session"))
    return qa.join(of, "paper", "left").withColumn("session_id", F.coalesce("session_id", "_session")).drop("_session")


def group_digests(qa: DataFrame) -> DataFrame:
    """Size and digest of each topic's sorted ids, which tell whether cached content is still good."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",")
    return qa.groupBy("topic").agg(F.count("*").alias("qa_count"), F.md5(ids).alias("qa_ids_hash"))


def stale_topics(qa: DataFrame, cache: DataFrame) -> DataFrame:
    """Topics whose questions differ from the cached state."""
    return group_digests(qa).join(cache.select("topic", "qa_count", "qa_ids_hash"), ["topic", "qa_count", "qa_ids_hash"], "left_anti")


def needs_run(checkpoints: DataFrame, task: str, n: int, min_growth: int = 1) -> DataFrame:
    """One row: whether the task's count grew by ``min_growth`` since it last ran."""
    last = checkpoints.where(F.col("task_name") == task).agg(F.max("qa_count_at_run").alias("last"))
    return last.select(F.lit(task).alias("task_name"), (F.col("last").isNull() | (n - F.col("last") >= min_growth)).alias("needs_run"))


def append_log(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Append rows with the time of writing."""
    rows.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)
