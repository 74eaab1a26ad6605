"""Difficulty from three signals, boundaries and judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import effective_miss_rate
from .joins import adjacent_topics
from .windows import verb_length_percentile

SIGNALS = ("miss_rate", "cross_topic", "length_percentile")
LABELS = ("basic", "intermediate", "advanced")


def difficulty_signals(qa: DataFrame, fb: DataFrame, links: DataFrame) -> DataFrame:
    """Miss rate, links of the topic (a tenth each, at most 1; 0 without a topic), length percentile."""
    near = adjacent_topics(links).groupBy("topic").agg(F.least(F.count("*") / 10, F.lit(1.0)).alias("degree"))
    rows = qa.join(effective_miss_rate(fb).withColumnRenamed("qa_id", "id"), "id", "left").join(near, "topic", "left")
    rows = rows.join(verb_length_percentile(qa).select("id", "percentile"), "id", "left")
    cross = F.when(F.coalesce("topic", F.lit("")) == "", 0.0).otherwise(F.coalesce("degree", F.lit(0.0)))
    return rows.select("id", "miss_rate", cross.alias("cross_topic"), F.col("percentile").alias("length_percentile"))


def vote(signal: Column, low: Column, high: Column, margin: float = 0.10) -> tuple[Column, Column]:
    """Label rank (1 to 3) of a signal against two boundaries, and whether it lies within the margin of one."""
    above = lambda b: b.isNotNull() & (signal >= b)
    near = lambda b: F.coalesce(F.abs(signal - b) <= margin * F.abs(b), F.lit(False))
    rank = F.when(above(high), 3).when(above(low), 2).otherwise(1)
    usable = signal.isNotNull() & (low.isNotNull() | high.isNotNull())
    return F.when(usable, rank), F.when(usable, near(low) | near(high))


def classify(signals: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """The hardest vote wins; no vote is intermediate; ``boundary`` if any vote lies on one."""
    votes = [vote(F.col(s), *(F.lit(b).cast("double") for b in bounds.get(s, (None, None)))) for s in SIGNALS]
    rank = F.array_max(F.array(*(v for v, _ in votes)))
    label = F.coalesce(*(F.when(rank == k + 1, F.lit(name)) for k, name in enumerate(LABELS)), F.lit("intermediate"))
    edge = F.coalesce(F.array_max(F.array(*(e for _, e in votes))), F.lit(False))
    return signals.withColumn("difficulty", label).withColumn("boundary", edge).withColumn("voted", rank.isNotNull())


def classify_all(signals: DataFrame, bounds: dict, judged: DataFrame) -> DataFrame:
    """Questions on a boundary or without a vote take the judged label where there is one."""
    rows = classify(signals, bounds).join(judged.select(F.col("qa_id").alias("id"), F.col("difficulty").alias("judged")), "id", "left")
    open_ = F.col("boundary") | ~F.col("voted")
    return rows.select("id", F.when(open_, F.coalesce("judged", "difficulty")).otherwise(F.col("difficulty")).alias("difficulty"), "boundary")
