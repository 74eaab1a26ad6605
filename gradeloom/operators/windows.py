"""Orders within groups: percentiles, transitions, latest and best rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scalars import qn_key


def verb_length_percentile(qa: DataFrame) -> DataFrame:
    """Share of a verb's answers that are strictly shorter; null for a verb with one answer."""
    verb = W.partitionBy("command_verb")
    rows = qa.withColumn("size", F.length("answer_text"))
    share = (F.rank().over(verb.orderBy("size")) - 1) / F.count("*").over(verb)
    return rows.select("id", "command_verb", F.when(F.count("*").over(verb) > 1, share).alias("percentile"))


def _transitions(rows: DataFrame, key: str, order: list[Column | str], count_as: str) -> DataFrame:
    """Changes of kp_id along the order within a key: how often, and under how many keys."""
    path = W.partitionBy(key).orderBy(*order)
    steps = rows.withColumn("source", F.lag("kp_id").over(path)).where("source <> kp_id")
    return steps.groupBy("source", F.col("kp_id").alias("target")).agg(F.count("*").alias("count"), F.count_distinct(key).alias(count_as))


def sequential_transitions(qa: DataFrame, members: DataFrame) -> DataFrame:
    """Points that follow each other in papers, questions in natural order, repeats skipped."""
    rows = members.join(qa, members["qa_id"] == qa["id"]).select("paper", "kp_id", "id", qn_key(F.col("question_number")).alias("at"))
    return _transitions(rows, "paper", ["at", "id", "kp_id"], "papers")


def learning_transitions(trajectory: DataFrame) -> DataFrame:
    """Points that learners take up one after the other."""
    return _transitions(trajectory, "student_id", ["recorded_at", "id"], "students")


def last_n(df: DataFrame, key: str, order: str, n: int, tie: str = "id") -> DataFrame:
    """The n newest rows of each key."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order), F.desc(tie)))
    return df.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")


def context_pick(results: DataFrame, weights: DataFrame, kps: DataFrame, questions: int = 4, points: int = 3) -> DataFrame:
    """Per query the best-weighted retrieved questions, and a few stable points."""
    best = W.partitionBy("query_id").orderBy(F.desc("weight"), "id")
    rows = results.join(weights.select("id", "weight"), "id").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= questions)
    stable = kps.where("quality = 'stable'").orderBy(F.desc("mass"), "kp_id").limit(points).select(F.col("kp_id").alias("item"))
    queries = results.select("query_id").distinct()
    return rows.select("query_id", F.col("id").cast("string").alias("item"), F.lit("question").alias("kind")).union(
        queries.join(F.broadcast(stable)).select("query_id", "item", F.lit("point").alias("kind"))  # at most ``points`` rows
    )


def recent_events(events: DataFrame, n: int = 50) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("source"), "type").limit(n)


def top_patterns(patterns: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The k largest patterns of each key."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.desc("size"), "pattern"))
    return patterns.withColumn("nth", nth).where(F.col("nth") <= k)


def validate_contracts(published: DataFrame, subscribed: DataFrame) -> DataFrame:
    """Event types that only one side names; ``*`` subscribes to all."""
    everything = subscribed.where("type = '*'").select(F.lit(1).alias("any")).limit(1)
    unheard = published.select("type").distinct().join(subscribed.select("type"), "type", "left_anti").join(everything, F.lit(True), "left_anti")
    unsent = subscribed.where("type <> '*'").select("type").distinct().join(published.select("type"), "type", "left_anti")
    return unheard.select("type", F.lit("nobody subscribes").alias("issue")).union(unsent.select("type", F.lit("nobody publishes").alias("issue")))
