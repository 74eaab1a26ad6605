"""Aggregations over questions, feedback, papers, learners and judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeloom.session import stored

from .scalars import REASONS, bullet_count

LEVELS = {"basic": 1, "intermediate": 2, "advanced": 3}
DIMENSIONS = ["avg_answer_length", "topic_count", "avg_miss_rate", "topic_purity_avg"]


def upper_median(values: Column) -> Column:
    """The element at ``n // 2`` of the sorted values (aggregate of a column)."""
    return F.element_at(F.array_sort(F.collect_list(values)), (F.floor(F.count(values) / 2) + 1).cast("int"))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def top_verbs(qa: DataFrame, n: int = 10) -> DataFrame:
    named = qa.where("command_verb is not null and command_verb not in ('', 'unknown')")
    return count_by(named, "command_verb").orderBy(F.desc("n"), "command_verb").limit(n)


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value; the counts, one row a value, meet in one window."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def duplicate_edges(edges: DataFrame) -> DataFrame:
    return count_by(edges, "source", "target").where("n > 1")


def qa_weights(qa: DataFrame, z: float = 1.282) -> DataFrame:
    """Mean of the success rate under a uniform prior, and the lower end of its Wilson interval.

    Both to three places, halves to even; no attempts give a lower bound of 0.
    """
    s, t = F.col("success_count") + 1.0, F.col("total_attempts") + 2.0
    mean, zz = s / t, z * z
    centre = mean + zz / (2 * t)
    width = z * F.sqrt(mean * (1 - mean) / t + zz / (4 * t * t))
    low = F.greatest(F.lit(0.0), (centre - width) / (1 + zz / t))
    return qa.withColumn("weight", F.bround(mean, 3)).withColumn(
        "lower_bound", F.when(F.col("total_attempts") > 0, F.bround(low, 3)).otherwise(0.0)
    )


def first_feedback(fb: DataFrame) -> DataFrame:
    """The first feedback row of each question, by id."""
    return fb.withColumn("nth", F.row_number().over(W.partitionBy("qa_id").orderBy("id"))).where("nth = 1").drop("nth")


def effective_miss_rate(fb: DataFrame) -> DataFrame:
    """``(qa_id, miss_rate)``: gaps count whole, thin detail half; without categories all misses count."""
    total = F.col("covered_count") + F.col("missed_count")
    sorted_out = F.col("knowledge_gap") + F.col("insufficient_detail") + F.col("misinterpretation")
    weighed = F.when(sorted_out > 0, F.col("knowledge_gap") + F.col("insufficient_detail") * 0.5).otherwise(F.col("missed_count"))
    return first_feedback(fb).select("qa_id", F.when(total > 0, weighed / total).alias("miss_rate"))


def verb_stats(qa: DataFrame, fb: DataFrame) -> DataFrame:
    """Answer length, list use and miss rate for each command verb ('' counts as 'unknown')."""
    verb = F.when(F.coalesce("command_verb", F.lit("")) == "", F.lit("unknown")).otherwise(F.col("command_verb"))
    rates = effective_miss_rate(fb.where("topic_match = 1"))
    rows = qa.withColumn("verb", verb).withColumn("bullets", bullet_count(F.col("answer_text"))).withColumn("size", F.length("answer_text"))
    return rows.join(rates, rows["id"] == rates["qa_id"], "left").groupBy("verb").agg(
        F.count("*").alias("sample_count"),
        F.bround(F.avg("size"), 4).alias("avg_length"),
        upper_median(F.col("size")).alias("median_length"),
        F.bround(F.avg((F.col("bullets") > 0).cast("int")), 4).alias("bullet_ratio"),
        F.bround(F.coalesce(F.avg(F.when(F.col("bullets") > 0, F.col("bullets"))), F.lit(0.0)), 4).alias("avg_bullets"),
        F.bround(F.avg("miss_rate"), 4).alias("avg_miss_rate"),
    )


def verb_topic_variance(qa: DataFrame, least: int = 3, spread: float = 0.3, apart: float = 0.2) -> DataFrame:
    """Topics whose mean answer length stands out within a verb that varies across topics."""
    means = qa.groupBy("command_verb", "topic").agg(F.avg(F.length("answer_text")).alias("topic_mean"), F.count("*").alias("n"))
    verb = W.partitionBy("command_verb")
    rows = means.select(
        "*",
        F.avg("topic_mean").over(verb).alias("mean"),
        F.var_pop("topic_mean").over(verb).alias("variance"),
        F.count("*").over(verb).alias("topics"),
        F.sum("n").over(verb).alias("questions"),
    )
    off = F.abs(F.col("topic_mean") - F.col("mean")) > apart * F.col("mean")
    kept = rows.where((F.col("questions") >= least) & (F.col("topics") >= 2) & (F.col("variance") > spread * F.col("mean")) & off)
    return kept.select("command_verb", "topic", "topic_mean", F.when(F.col("topic_mean") > F.col("mean"), F.lit("longer")).otherwise("shorter").alias("direction"))


def topic_difficulty(qa: DataFrame, fb: DataFrame) -> DataFrame:
    """Label counts, most frequent label (ties: the easier), 'mixed' spread and mean miss rate of a topic."""
    rates = effective_miss_rate(fb)
    counts = [F.count_if(F.col("difficulty_estimate") == level).alias(f"{level}_count") for level in LEVELS]
    rows = qa.join(rates, qa["id"] == rates["qa_id"], "left").where("topic <> ''").groupBy("topic").agg(
        F.count("*").alias("qa_count"), *counts, F.bround(F.avg("miss_rate"), 2).alias("avg_miss_rate")
    )
    best = F.greatest(*(f"{level}_count" for level in LEVELS))
    mode = F.coalesce(*(F.when(F.col(f"{level}_count") == best, F.lit(level)) for level in LEVELS))
    mixed = (F.col("basic_count") > 0) & (F.col("advanced_count") > 0)
    return rows.withColumn("mode_difficulty", mode).withColumn("difficulty_spread", F.when(mixed, F.lit("mixed")).otherwise(F.lit("uniform")))


def paper_signatures(qa: DataFrame, fb: DataFrame) -> DataFrame:
    """One row per paper: size, answer length, topics, miss rate, topic purity, verb and label shares."""
    rates = effective_miss_rate(fb)
    rows = qa.join(rates, qa["id"] == rates["qa_id"], "left").withColumn("size", F.length("answer_text"))
    whole = rows.groupBy("paper").agg(
        F.count("*").alias("qa_count"),
        F.avg("size").alias("avg_answer_length"),
        F.count_distinct("topic").alias("topic_count"),
        F.avg("miss_rate").alias("avg_miss_rate"),
    )
    by_topic = rows.groupBy("paper", "topic").agg(F.stddev_samp("size").alias("sd"), F.avg("size").alias("mean"), F.count("*").alias("n"))
    purity = by_topic.where("n >= 2 and mean > 0").groupBy("paper").agg(
        F.avg(F.greatest(F.lit(0.0), 1 - F.col("sd") / F.col("mean"))).alias("topic_purity_avg")
    )

    def shares(column: str, name: str) -> DataFrame:
        counts = rows.groupBy("paper", column).agg(F.count("*").alias("n"))
        entries = F.array_sort(F.collect_list(F.struct(F.coalesce(column, F.lit("")).alias("key"), F.col("n").alias("value"))))
        return counts.groupBy("paper").agg(F.map_from_entries(entries).alias(name))

    return (
        whole.join(purity, "paper", "left")
        .join(shares("command_verb", "verb_dist"), "paper", "left")
        .join(shares("difficulty_estimate", "difficulty_dist"), "paper", "left")
    )


def _unpivoted(signatures: DataFrame) -> DataFrame:
    return signatures.select("paper", *(F.col(d).cast("double").alias(d) for d in DIMENSIONS)).unpivot("paper", DIMENSIONS, "dimension", "value").where("value is not null")


def dimension_baselines(signatures: DataFrame, least: int = 3) -> DataFrame:
    """Mean, median and median absolute deviation of each dimension over at least three papers."""
    rows = _unpivoted(signatures)
    centre = rows.groupBy("dimension").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.count("*").alias("sample_count"))
    centre = centre.where(F.col("sample_count") >= least)
    apart = rows.join(F.broadcast(centre), "dimension").groupBy("dimension").agg(F.median(F.abs(F.col("value") - F.col("median"))).alias("mad"))
    return centre.join(apart, "dimension")  # one row for each of the fixed dimensions


def detect_anomalies(signatures: DataFrame, baselines: DataFrame) -> DataFrame:
    """Papers far from the baselines: the flagged dimensions and how grave they are together."""
    z = F.abs(F.col("value") - F.col("median")) / F.col("mad")
    scored = _unpivoted(signatures).join(F.broadcast(baselines), "dimension").where("mad > 0").withColumn("z", z)
    flags = scored.groupBy("paper").agg(
        F.count_if(F.col("z") > 3).alias("severe"),
        F.count_if(F.col("z") > 2).alias("moderate"),
        F.array_sort(F.collect_set(F.when(F.col("z") > 2, F.col("dimension")))).alias("dimensions"),
    )
    grade = F.when(F.col("moderate") >= 3, F.lit("systemic")).when(F.col("severe") > 0, F.lit("severe")).otherwise(F.lit("moderate"))
    return flags.where("severe > 0 or moderate > 0").withColumn("grade", grade)


def exam_stats(qa: DataFrame, topic: str | None = None) -> DataFrame:
    rows = qa if topic is None else qa.where(F.col("topic") == topic)
    return count_by(rows, "topic", "year", "season").orderBy(F.desc("year"), "season", "topic")


def exam_trends(members: DataFrame, qa: DataFrame) -> DataFrame:
    """Occurrences and difficulty of each point by year and season, for points of two sessions or more."""
    level = F.coalesce(*(F.when(F.col("difficulty_estimate") == k, F.lit(v)) for k, v in LEVELS.items()))
    rows = members.join(qa, members["qa_id"] == qa["id"]).groupBy("kp_id", "year", "season").agg(F.count("*").alias("occurrence_count"), F.avg(level).alias("level"))
    kp = W.partitionBy("kp_id")
    rows = rows.select("*", F.count("*").over(kp).alias("sessions"), F.size(F.collect_set("year").over(kp)).alias("years"))
    label = F.when(F.col("level") > 2.0, F.lit("advanced")).when(F.col("level") > 1.3, F.lit("intermediate")).otherwise("basic")
    return rows.where("sessions >= 2").select("kp_id", "year", "season", "occurrence_count", label.alias("avg_difficulty"), (F.col("years") >= 3).alias("recurring"))


def paper_feedback(fb: DataFrame, qa: DataFrame) -> DataFrame:
    """Retrieved and used references per paper and their ratio."""
    rows = fb.join(qa.select(F.col("id").alias("qa_id"), "paper"), "qa_id").groupBy("paper").agg(
        F.coalesce(F.sum("retrieval_count"), F.lit(0)).alias("retrieved"), F.coalesce(F.sum("used_qa_count"), F.lit(0)).alias("used")
    )
    return rows.withColumn("utility", F.when(F.col("retrieved") > 0, F.col("used") / F.col("retrieved")).otherwise(0.0))


def miss_categories(fb: DataFrame, qa: DataFrame) -> DataFrame:
    """Totals of each miss reason per paper, zeros left out."""
    held = [r for r in REASONS if r in fb.columns]
    rows = fb.join(qa.select(F.col("id").alias("qa_id"), "paper"), "qa_id").groupBy("paper").agg(*(F.sum(r).alias(r) for r in held))
    return rows.unpivot("paper", held, "reason", "n").where("n > 0")


def topic_quality(weights: DataFrame) -> DataFrame:
    """Best bound and mean of a topic, the spread of its means, and what follows for its points."""
    rows = weights.groupBy("topic").agg(
        F.max("lower_bound").alias("best_bound"), F.max("weight").alias("best_weight"), F.coalesce(F.var_samp("weight"), F.lit(0.0)).alias("variance"), F.count("*").alias("n")
    )
    low = (F.col("best_weight") < 0.4) & (F.col("variance") < 0.02) & (F.col("n") >= 2)
    marker = (
        F.when((F.col("best_bound") < 0.15) & (F.col("n") > 1), F.lit("dropped"))
        .when(F.col("best_bound") < 0.25, F.lit("review"))
        .when(F.col("best_bound") >= 0.5, F.lit("core"))
        .otherwise("")
    )
    return rows.withColumn("low_quality", low).withColumn("marker", marker)


def recent_confusions(events: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return count_by(events.where(F.col("created_at") >= now - F.make_dt_interval(F.lit(days))), "topic")


def mastered_topics(states: DataFrame, n: int = 3) -> DataFrame:
    return states.where("state = 'mastered'").groupBy("topic").agg(F.count_distinct("student_id").alias("students")).where(F.col("students") >= n)


def mark_representatives(qa: DataFrame, links: DataFrame) -> DataFrame:
    """The question of highest weight in each topic, and whether its topic links to another."""
    best = W.partitionBy("topic").orderBy(F.desc("weight"), "id")
    linked = links.where("src_topic <> dst_topic").select(F.explode(F.array("src_topic", "dst_topic")).alias("topic")).distinct().withColumn("linked", F.lit(True))
    rows = qa.withColumn("is_representative", F.row_number().over(best) == 1)
    return rows.join(linked.hint("shuffle_hash"), "topic", "left").withColumn("is_cross_topic", F.coalesce("linked", F.lit(False))).drop("linked")


def difficulty_anchors(qa: DataFrame, cap: int = 30) -> DataFrame:
    """One question per topic (representative, else best), then evenly spaced ones up to the cap.

    Topics are numbered by range: each task numbers its own, and adds the count of the ranges before it.
    """
    order = W.partitionBy("topic").orderBy(F.desc("is_representative"), F.desc("weight"), "id")
    heads = qa.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    heads = stored(heads.repartitionByRange("topic").withColumn("range", F.spark_partition_id()), "heads")
    before = heads.groupBy("range").agg(F.count("*").alias("n"))  # one row a range
    before = before.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))
    heads = heads.withColumn("own", F.row_number().over(W.partitionBy("range").orderBy("topic"))).join(F.broadcast(before), "range")
    heads = heads.withColumn("position", F.col("before") + F.col("own")).drop("range", "before", "own")
    step = heads.agg(F.greatest(F.floor(F.count("*") / cap), F.lit(1)).alias("step"))
    return heads.join(F.broadcast(step)).where("(position - 1) % step = 0").orderBy("position").limit(cap).drop("nth", "step")  # one row


def difficulty_boundaries(signals: DataFrame, labels: DataFrame) -> DataFrame:
    """Midpoints between the upper medians of neighbouring labels, for each signal."""
    rows = signals.join(labels, "qa_id").where("value is not null").groupBy("signal").pivot("difficulty", list(LEVELS)).agg(upper_median(F.col("value")))
    return rows.select(
        "signal",
        ((F.col("basic") + F.col("intermediate")) / 2).alias("basic_intermediate"),
        ((F.col("intermediate") + F.col("advanced")) / 2).alias("intermediate_advanced"),
    )


def eval_rates(judgments: DataFrame) -> DataFrame:
    """Share of passed judgments by dimension and topic, with the dimension's total (topic null)."""
    return judgments.rollup("dimension", "topic").agg(F.avg(F.col("passed").cast("int")).alias("rate"), F.count("*").alias("n"), F.grouping_id().alias("level")).where("level < 3").drop("level")


#: The least rate of a dimension below which advice is given.
LEAST_RATES = {"accuracy": 0.7, "language": 1.0, "honesty": 0.8, "pitfall": 0.7}


def eval_suggestions(rates: DataFrame) -> DataFrame:
    """Advice for dimensions below their least rate, and for topics that nothing passed in."""
    least = F.create_map(*(F.lit(x) for pair in LEAST_RATES.items() for x in pair))
    whole = rates.where(F.col("topic").isNull() & (F.col("rate") < least[F.col("dimension")])).select("dimension", "topic", F.lit("raise the dimension").alias("advice"))
    none = rates.where(F.col("topic").isNotNull() & (F.col("rate") == 0)).select("dimension", "topic", F.lit("review the topic").alias("advice"))
    return whole.union(none)


def practice_scores(judged: DataFrame, least: float = 0.7) -> DataFrame:
    points = F.col("covered_count") + F.col("missed_count")
    return judged.withColumn("score", F.when(points > 0, F.col("covered_count") / points).otherwise(0.0)).withColumn("valid", F.col("score") >= least)


def evidence_growth(kps: DataFrame, members: DataFrame) -> DataFrame:
    """Points whose members outgrew the recorded evidence: five or more, and three or half again as many."""
    held = members.groupBy("kp_id").agg(F.count("*").alias("members"))
    grown = (F.col("members") - F.col("evidence_count") >= 3) | (F.col("members") >= 1.5 * F.col("evidence_count"))
    return kps.join(held, "kp_id").where((F.col("members") > F.col("evidence_count")) & (F.col("members") >= 5) & grown).select("kp_id", "evidence_count", "members")


def open_proposals(history: DataFrame) -> DataFrame:
    return history.where("outcome = 'queued'").orderBy("kp_id", "id")


def verb_coverage(qa: DataFrame) -> DataFrame:
    named = F.coalesce("command_verb", F.lit("")) != ""
    return qa.agg(F.count_if(named & (F.col("command_verb") != "unknown")).alias("annotated"), F.count_if(F.col("command_verb") == "unknown").alias("unknown"), F.count("*").alias("total"))
