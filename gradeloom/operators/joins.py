"""Joins between questions, points, fragments, topics and learners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeloom.session import stored, tasks_for


def kp_qas(members: DataFrame, qa: DataFrame) -> DataFrame:
    return members.join(qa, members["qa_id"] == qa["id"]).select("kp_id", "qa_id", "membership_strength", "topic", "question_text")


def kp_representatives(members: DataFrame, qa: DataFrame, k: int = 3) -> DataFrame:
    """Up to k questions of each point: its representatives, or without any its strongest members."""
    rows = members.join(qa.select(F.col("id").alias("qa_id"), "topic"), "qa_id")
    any_rep = F.max("is_representative").over(W.partitionBy("kp_id"))
    kept = rows.withColumn("any", any_rep).where("not any or is_representative")
    nth = F.row_number().over(W.partitionBy("kp_id").orderBy(F.desc("membership_strength"), "qa_id"))
    return kept.withColumn("nth", nth).where(F.col("nth") <= k).select("kp_id", "qa_id", "membership_strength", "nth")


def helped_by(fragments: DataFrame, help_map: DataFrame, sources: DataFrame) -> DataFrame:
    """``(qa_id, helped_qa_id)``: questions that the fragments of the source questions helped."""
    own = fragments.join(sources.select("qa_id").distinct(), "qa_id", "left_semi").select("qa_id", F.col("point_id").alias("fragment_id"))
    return own.join(help_map.select("fragment_id", "helped_qa_id"), "fragment_id").select("qa_id", "helped_qa_id").distinct()


def second_order(fragments: DataFrame, help_map: DataFrame, sources: DataFrame) -> DataFrame:
    """``(qa_id, other_qa_id)``: questions whose fragments helped what the source's fragments helped."""
    owner = fragments.select(F.col("point_id").alias("fragment_id"), F.col("qa_id").alias("other_qa_id"))
    other = help_map.select("fragment_id", "helped_qa_id").join(owner, "fragment_id").select("helped_qa_id", "other_qa_id").distinct()
    return helped_by(fragments, help_map, sources).join(other, "helped_qa_id").where("other_qa_id <> qa_id").select("qa_id", "other_qa_id").distinct()


def behavior_scores(fragments: DataFrame, help_map: DataFrame, candidates: DataFrame, helped: DataFrame) -> DataFrame:
    """For each candidate, the help rows of its fragments on the helped questions: a tenth each, at most 1."""
    own = fragments.join(candidates.select("qa_id").distinct(), "qa_id", "left_semi").select("qa_id", F.col("point_id").alias("fragment_id"))
    rows = own.join(help_map, "fragment_id").join(helped.select("helped_qa_id").distinct(), "helped_qa_id", "left_semi")
    return rows.groupBy("qa_id").agg(F.least(F.count("*") / 10, F.lit(1.0)).alias("score"))


def adjacent_topics(links: DataFrame) -> DataFrame:
    pair = links.select(F.col("src_topic").alias("topic"), F.col("dst_topic").alias("adjacent"))
    return pair.union(pair.select(F.col("adjacent").alias("topic"), F.col("topic").alias("adjacent"))).distinct()


def linked_mask(links: DataFrame, topic: str, candidates: DataFrame) -> DataFrame:
    near = adjacent_topics(links).where(F.col("topic") == topic).select(F.col("adjacent").alias("topic"))
    return candidates.join(near, "topic", "left_semi")


def topic_helps(members: DataFrame, help_map: DataFrame) -> DataFrame:
    """``(topic_id, helped_qa_id)``, each once; the help rows are written and counted, and dealt over as many tasks as they need."""
    return helps_of(members, stored(help_map.select("fragment_id", "helped_qa_id"), "help"))


def helps_of(members: DataFrame, held: DataFrame) -> DataFrame:
    """``topic_helps`` of stored help rows, dealt by question."""
    n = tasks_for(held)
    rows = members.select("fragment_id", "topic_id").repartition(n, "fragment_id").hint("merge").join(held.repartition(n, "fragment_id"), "fragment_id")
    return rows.select("topic_id", "helped_qa_id").repartition(n, "helped_qa_id").distinct()


def topic_centralities(centrality: DataFrame, members: DataFrame) -> DataFrame:
    return centrality.join(members.select("fragment_id", "topic_id"), "fragment_id")


def topic_kps(qa: DataFrame, members: DataFrame) -> DataFrame:
    return members.join(qa, members["qa_id"] == qa["id"]).select("topic", "kp_id").distinct()


def promote_mastered(kps: DataFrame, members: DataFrame, qa: DataFrame, topics: DataFrame) -> DataFrame:
    """Accepted points with a question in a mastered topic become verified."""
    of = qa.join(topics.select("topic"), "topic", "left_semi").select(F.col("id").alias("qa_id"))
    mastered = members.join(of, "qa_id", "left_semi").select("kp_id").distinct().withColumn("mastered", F.lit(True))
    raised = F.when((F.col("quality") == "accepted") & F.col("mastered"), F.lit("verified")).otherwise(F.col("quality"))
    return kps.join(mastered, "kp_id", "left").withColumn("quality", raised).drop("mastered")


def missing_prereqs(dependencies: DataFrame, states: DataFrame, topics: DataFrame) -> DataFrame:
    """Direct prerequisites of a learner's topics that the learner hasn't mastered."""
    needed = topics.join(dependencies, topics["topic"] == dependencies["dependent"]).select("student_id", "topic", F.col("prerequisite"))
    done = states.where("state = 'mastered'").select("student_id", F.col("topic").alias("prerequisite"))
    return needed.join(done, ["student_id", "prerequisite"], "left_anti").distinct()


def open_confusions(confusions: DataFrame, topics: DataFrame, n: int = 10) -> DataFrame:
    """Of each learner's n latest confusions the unresolved ones on the given topics."""
    nth = F.row_number().over(W.partitionBy("student_id").orderBy(F.desc("created_at"), F.desc("id")))
    latest = confusions.withColumn("nth", nth).where(F.col("nth") <= n)
    return latest.where("not resolved").join(topics.select("topic").distinct(), "topic", "left_semi").drop("nth")


def kp_catalog(topics: DataFrame, qa: DataFrame) -> DataFrame:
    """Stable topics with a text by mass, then one question for each topic that they leave out."""
    named = topics.where("quality = 'stable' and coalesce(kp_concept, '') <> ''").select(F.col("name").alias("topic"), F.col("kp_concept").alias("text"), "mass", F.lit("topic").alias("kind"))
    best = W.partitionBy("topic").orderBy(F.desc("is_representative"), F.desc("success_count"), "id")
    first = qa.where("topic <> ''").withColumn("nth", F.row_number().over(best)).where("nth = 1").join(named, "topic", "left_anti")
    return named.union(first.select("topic", F.col("question_text").alias("text"), F.lit(None).cast("double").alias("mass"), F.lit("question").alias("kind")))


def analysis_hints(wanted: DataFrame, difficulty: DataFrame, dependencies: DataFrame, confusions: DataFrame, patterns: DataFrame) -> DataFrame:
    """One line for each ``wanted(student_id, topic, verb)``: difficulty, answer style of the verb,
    prerequisites, open confusions. A verb without a summary in ``patterns(verb, pattern_summary)`` says nothing."""
    before = dependencies.groupBy(F.col("dependent").alias("topic")).agg(F.array_join(F.array_sort(F.collect_set("prerequisite")), ", ").alias("before"))
    open_ = confusions.where("not resolved").groupBy("student_id", "topic").agg(F.count("*").alias("open"))
    rows = wanted.join(difficulty.select("topic", "mode_difficulty"), "topic", "left").join(before, "topic", "left").join(open_, ["student_id", "topic"], "left")
    rows = rows.join(patterns.where("pattern_summary <> ''").select("verb", "pattern_summary"), "verb", "left")
    parts = (
        F.concat(F.lit("difficulty: "), "mode_difficulty"),
        F.concat(F.lit("answer style for '"), "verb", F.lit("' questions: "), "pattern_summary"),
        F.concat(F.lit("needs: "), "before"),
        F.concat(F.lit("open confusions: "), F.col("open").cast("string")),
    )
    return rows.select("student_id", "topic", F.concat_ws("; ", *parts).alias("hint"))


def graph_export(dependencies: DataFrame, difficulty: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the topic graph. ``topics`` has parent, children and merged_from names."""
    names = dependencies.select(F.explode(F.array("prerequisite", "dependent")).alias("topic")).union(difficulty.select("topic"))
    names = names.union(topics.where("quality in ('stable', 'forming')").select("name")).distinct()
    nodes = names.hint("merge").join(difficulty.select("topic", "mode_difficulty"), "topic", "left").join(topics.select(F.col("name").alias("topic"), "quality", "mass").hint("merge"), "topic", "left")
    edges = (
        dependencies.select(F.col("prerequisite").alias("source"), F.col("dependent").alias("target"), F.lit("prerequisite").alias("type"))
        .union(topics.where("parent is not null").select("parent", "name", F.lit("parent_of")))
        .union(topics.select("name", F.explode("children"), F.lit("split_into")))
        .union(topics.select(F.explode("merged_from"), "name", F.lit("merged_from")))
    )
    return nodes, edges.distinct()


def dependency_graph(dependencies: DataFrame) -> DataFrame:
    """Prerequisites and dependents of every topic of an edge."""
    both = dependencies.select(F.col("dependent").alias("topic"), F.col("prerequisite").alias("before"), F.lit(None).cast("string").alias("after")).union(
        dependencies.select("prerequisite", F.lit(None).cast("string"), "dependent")
    )
    return both.groupBy("topic").agg(F.array_sort(F.collect_set("before")).alias("prerequisites"), F.array_sort(F.collect_set("after")).alias("dependents"))


def kp_graph(edges: DataFrame, kps: DataFrame) -> DataFrame:
    """The same for points, over prerequisite and corequisite edges; other points have empty lists."""
    kept = edges.where("type in ('prerequisite', 'corequisite')").select(F.col("source").alias("prerequisite"), F.col("target").alias("dependent"))
    none = F.array().cast("array<string>")
    found = dependency_graph(kept).withColumnRenamed("topic", "kp_id")
    return kps.select("kp_id").join(found, "kp_id", "left").select("kp_id", F.coalesce("prerequisites", none).alias("prerequisites"), F.coalesce("dependents", none).alias("dependents"))


def retrieval_sources(results: DataFrame, qa: DataFrame, n: int = 5) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    top = results.withColumn("nth", nth).where(F.col("nth") <= n)
    return top.join(qa.select("id", "topic", F.substring("question_text", 1, 200).alias("text")), "id").select("query_id", "nth", "id", "topic", "text", "score")
