"""Structured texts: lists of knowledge points, verb reports, and JSON columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LABELS = ("Detail", "Pitfall", "Scoring")


def parse_points(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Knowledge points of texts: ``(key, block, topic, number, concept, detail, pitfall, scoring)``.

    Blocks are split on blank lines; a block's first line gives the topic (up to ``"  ["``); ``N. x``
    starts a point, labelled lines belong to it, ``See also`` or ``Related:`` ends it.
    """
    blocks = texts.select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("block", "body"))
    lines = blocks.select(key, "block", F.posexplode(F.split("body", "\n")).alias("at", "line")).withColumn("line", F.trim("line"))
    order = W.partitionBy(key, "block").orderBy("at")
    start = F.regexp_extract("line", r"^(\d+)\. ", 1)
    ends = F.col("line").rlike("^(See also|Related:)")
    lines = lines.withColumn("topic", F.first(F.trim(F.split("line", r"  \[")[0])).over(order))
    mark = F.when(F.col("at") == 0, F.lit("")).when(start != "", start).when(ends, F.lit(""))
    lines = lines.withColumn("number", F.last(mark, ignorenulls=True).over(order)).where("number <> ''")
    concept = F.max(F.when(start != "", F.regexp_replace("line", r"^\d+\. ", ""))).alias("concept")
    labelled = [F.max(F.when(F.col("line").startswith(f"{k}:"), F.trim(F.regexp_replace("line", f"^{k}:", "")))).alias(k.lower()) for k in LABELS]
    return lines.groupBy(key, "block", "topic", F.col("number").cast("int").alias("number")).agg(concept, *labelled)


def format_points(points: DataFrame) -> DataFrame:
    """``(topic, text)``: each topic's heading and numbered points; low confidence gets ``(review)``."""
    rest = [F.when(F.coalesce(F.col(k.lower()), F.lit("")) != "", F.concat(F.lit(f"\n   {k}: "), F.col(k.lower()))) for k in LABELS]
    head = F.concat(F.col("number").cast("string"), F.lit(". "), F.when(F.col("low_confidence"), F.lit("(review) ")).otherwise(""), "concept")
    line = F.struct("number", F.concat(head, *(F.coalesce(r, F.lit("")) for r in rest)).alias("line"))
    rows = points.groupBy("topic", "marker").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return rows.select("topic", F.concat("topic", "marker", F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("text"))


def format_verb_report(patterns: DataFrame) -> DataFrame:
    """One text block for each row of ``patterns(verb, verb_family, sample_count, avg_answer_length,
    median_answer_length, bullet_ratio, avg_bullet_count, avg_miss_rate, pattern_summary, topic_notes)``;
    topic_notes is an array of (topic, note). A line whose figures are missing is left out."""
    double = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    lines = (
        F.format_string("%s  [%s]  (n=%d)", "verb", F.coalesce("verb_family", F.lit("")), "sample_count"),
        F.lit("-" * 40),
        F.when(F.col("avg_answer_length") > 0, F.format_string("  Avg answer length: %.0f chars  (median: %.0f)", double("avg_answer_length"), double("median_answer_length"))),
        F.when(F.col("bullet_ratio").isNotNull(), F.format_string("  Bullet/list usage: %.0f%%  (avg %.1f bullets)", double("bullet_ratio") * 100, double("avg_bullet_count"))),
        F.when(F.col("avg_miss_rate").isNotNull(), F.format_string("  Avg miss rate (AI): %.0f%%", double("avg_miss_rate") * 100)),
        F.when(F.col("pattern_summary") != "", F.concat(F.lit("  Pattern: "), "pattern_summary")),
        F.when(F.size("topic_notes") > 0, F.array_join(F.transform("topic_notes", lambda x: F.concat(F.lit("    ["), x["topic"], F.lit("] "), x["note"])), "\n")),
    )
    return patterns.select("verb", F.concat_ws("\n", *lines).alias("block"))


def decode_json_cols(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """JSON text columns as typed ones; text that isn't JSON of the kind becomes null."""
    return df.withColumns({name: F.from_json(name, kind) for name, kind in kinds.items()})


def encode_json_cols(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.to_json(name) for name in names})


def write_texts(rows: DataFrame, path: str, text: str = "text") -> None:
    """One text column as text files."""
    rows.select(text).write.mode("overwrite").text(path)
