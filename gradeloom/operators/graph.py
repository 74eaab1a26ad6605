"""Edges between points and topics: discovery, fusion, prerequisites, merging and splitting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeloom.session import stored

from .scalars import transition_weight

MAX_ROUNDS = 64


def cross_topic_links(uses: DataFrame, qa: DataFrame) -> DataFrame:
    """Counts of used references whose topic differs from the question's."""
    own = qa.select(F.col("id").alias("qa_id"), F.col("topic").alias("src_topic"))
    ref = qa.select(F.col("id").alias("ref_qa_id"), F.col("topic").alias("dst_topic"))
    rows = uses.where("used").join(own, "qa_id").join(ref, "ref_qa_id").where("src_topic <> '' and dst_topic <> '' and src_topic <> dst_topic")
    return rows.groupBy("src_topic", "dst_topic").agg(F.count("*").alias("count"))


def retrieval_edges(links: DataFrame, topic_points: DataFrame, least: int = 2, medium: int = 4) -> DataFrame:
    """A topic that refers to another depends on it: edges from the other's points to its own."""
    strong = links.where(F.col("count") >= least)
    source = topic_points.select(F.col("topic").alias("dst_topic"), F.col("kp_id").alias("source"))
    target = topic_points.select(F.col("topic").alias("src_topic"), F.col("kp_id").alias("target"))
    rows = strong.join(source, "dst_topic").join(target, "src_topic").where("source <> target").groupBy("source", "target").agg(F.max("count").alias("weight"))
    return rows.select("source", "target", F.col("weight").cast("double").alias("weight"), F.lit("prerequisite").alias("type"), F.when(F.col("weight") >= medium, F.lit("medium")).otherwise("low").alias("confidence"))


def sequential_edges(transitions: DataFrame, least: int = 3, high: int = 5) -> DataFrame:
    rows = transitions.where(F.col("papers") >= least)
    return rows.select("source", "target", transition_weight(F.col("count")).alias("weight"), F.when(F.col("papers") >= high, F.lit("high")).otherwise("medium").alias("confidence"))


def learning_edges(transitions: DataFrame, least: int = 3, high: int = 5) -> DataFrame:
    rows = transitions.where(F.col("students") >= least)
    return rows.select("source", "target", transition_weight(F.col("count")).alias("weight"), F.when(F.col("students") >= high, F.lit("high")).otherwise("medium").alias("confidence"))


def fuse_edges(edges: DataFrame) -> DataFrame:
    """One row per pair of ``edges(source, target, type, retrieval, semantic, sequential, learning)``."""
    names = ("retrieval", "semantic", "sequential", "learning")
    rows = edges.groupBy("source", "target").agg(*(F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in names), F.collect_set("type").alias("types"))
    r, s, q, l = (F.col(n) > 0 for n in names)
    strength = 0.4 * F.col("retrieval") + 0.3 * F.col("semantic") + 0.15 * F.col("sequential") + 0.15 * F.col("learning")
    confidence = F.when((r & s) | (r & q), F.lit("high")).when((s & l) | (q & l) | r | s, F.lit("medium")).otherwise("low")
    kind = F.coalesce(*(F.when(F.array_contains("types", k), F.lit(k)) for k in ("prerequisite", "corequisite")), F.lit("related"))
    return rows.select("source", "target", *names, F.bround(strength, 3).alias("combined_strength"), confidence.alias("confidence"), kind.alias("type"))


def transitive_prereqs(dependencies: DataFrame, topics: DataFrame, depth: int = 5) -> DataFrame:
    """``(topic, prerequisite, depth)``: everything needed before a topic, up to a number of steps."""
    edges = dependencies.select(F.col("dependent").alias("at"), F.col("prerequisite").alias("next")).distinct()
    front = topics.select("topic", F.col("topic").alias("at")).distinct()
    seen = front.select("topic", F.col("at").alias("prerequisite"), F.lit(0).alias("depth"))
    for step in range(1, depth + 1):
        new = front.join(edges, "at").select("topic", F.col("next").alias("prerequisite")).distinct().join(seen, ["topic", "prerequisite"], "left_anti")
        new = stored(new.withColumn("depth", F.lit(step)), "front")
        seen = seen.union(new)
        front = new.select("topic", F.col("prerequisite").alias("at"))
    return seen.where("depth > 0")


def dependency_candidates(links: DataFrame, near: DataFrame, texts: DataFrame) -> DataFrame:
    """Topic pairs to be judged as dependencies.

    Links of two and more both ways, alike in count, are symmetric; a link more than three times its
    reverse makes the topic it points to the prerequisite; near vectors ``(a, b)`` without a link go both ways.
    """
    named = texts.where("text <> ''").select(F.col("topic"))
    for end in ("src_topic", "dst_topic"):
        links = links.join(named.select(F.col("topic").alias(end)), end, "left_semi")
    back = links.select(F.col("src_topic").alias("dst_topic"), F.col("dst_topic").alias("src_topic"), F.col("count").alias("reverse"))
    rows = links.join(back, ["src_topic", "dst_topic"], "left").withColumn("reverse", F.coalesce("reverse", F.lit(0)))
    alike = F.abs(F.col("count") - F.col("reverse")) <= 0.5 * F.greatest("count", "reverse")
    both = (F.col("count") >= 2) & (F.col("reverse") >= 2) & alike
    one = (F.col("count") >= 2) & (F.col("count") > 3 * F.col("reverse"))
    made = rows.where(both | one).select(
        F.when(both, F.col("src_topic")).otherwise(F.col("dst_topic")).alias("prerequisite"),
        F.when(both, F.col("dst_topic")).otherwise(F.col("src_topic")).alias("dependent"),
        F.when(both, F.least("count", "reverse")).otherwise(F.col("count")).alias("link_count"),
        F.when(both, F.lit("symmetric")).otherwise("directed").alias("origin"),
    )
    pairs = near.select("a", "b").union(near.select(F.col("b"), F.col("a"))).toDF("prerequisite", "dependent")
    known = made.select("prerequisite", "dependent").union(made.select(F.col("dependent"), F.col("prerequisite"))).distinct()
    fresh = pairs.join(known, ["prerequisite", "dependent"], "left_anti")
    return made.union(fresh.select("prerequisite", "dependent", F.lit(0).cast("long"), F.lit("vector")))


def score_dependencies(candidates: DataFrame, judged: DataFrame) -> DataFrame:
    """Candidates judged 1 or 2, with confidence by score, links and origin."""
    strong = F.col("score") == 2
    confidence = (
        F.when(strong & (F.col("link_count") >= 4), F.lit("high"))
        .when((strong & (F.col("link_count") >= 2)) | (F.col("origin") == "symmetric"), F.lit("medium"))
        .otherwise("low")
    )
    kind = F.when(F.col("origin") == "symmetric", F.lit("corequisite")).otherwise("prerequisite")
    rows = candidates.join(judged, ["prerequisite", "dependent"]).where("score >= 1")
    return rows.select("prerequisite", "dependent", "link_count", "score", confidence.alias("confidence"), kind.alias("type"))


def dedup_dependencies(rows: DataFrame) -> DataFrame:
    """One row an edge, as if taken by ``seq``: a row replaces the stored one if it is high or the stored one low."""
    order = W.partitionBy("prerequisite", "dependent")
    best = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    late = F.when(F.col("confidence") == "medium", -F.col("seq")).otherwise(F.col("seq"))
    return rows.withColumn("nth", F.row_number().over(order.orderBy(best.desc(), late.desc()))).where("nth = 1").drop("nth")


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Edges a -> b without another path from a to b that visits neither end on its way.

    The frontier of an edge starts at a's other successors and grows until it meets b or nothing new.
    """
    edges = stored(edges.select("prerequisite", "dependent").distinct(), "edges")
    step = edges.select(F.col("prerequisite").alias("node"), F.col("dependent").alias("next"))
    front = edges.join(step.withColumnRenamed("node", "prerequisite").withColumnRenamed("next", "node"), "prerequisite").where("node <> dependent and node <> prerequisite")
    seen = front = stored(front.select("prerequisite", "dependent", "node").distinct(), "front")
    redundant = None
    while True:  # every round adds to what has been seen, or ends
        reached = front.join(step, "node").where("next <> prerequisite")
        found = reached.where("next = dependent").select("prerequisite", "dependent").distinct()
        redundant = stored(found if redundant is None else redundant.union(found).distinct(), "redundant")
        new = reached.where("next <> dependent").select("prerequisite", "dependent", F.col("next").alias("node")).distinct()
        new = new.join(redundant, ["prerequisite", "dependent"], "left_anti").join(seen, ["prerequisite", "dependent", "node"], "left_anti")
        front = stored(new, "front")
        if not front.limit(1).count():
            return edges.join(redundant, ["prerequisite", "dependent"], "left_anti")
        seen = stored(seen.union(front), "seen")


def greedy_matching(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs taken in ascending order (of a, then b), each if neither end has been taken before.

    In rounds: a pair is taken if it is the least open one at both of its ends, then all pairs at these ends are closed. Every round
    takes the least open pair at least. Pairs with a null end or two equal ends are left out.
    """
    open_, taken = stored(pairs.where(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "open"), []
    while open_.limit(1).count():
        ends = open_.select(F.explode(F.array("a", "b")).alias("end"), F.struct("a", "b").alias("pair"))
        least = ends.groupBy("end").agg(F.min("pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).where("n = 2")
        taken.append(stored(least.select("pair.*"), "taken"))
        used = stored(taken[-1].select(F.explode(F.array("a", "b")).alias("used")), "used")
        for end in ("a", "b"):
            open_ = open_.join(used.hint("merge"), F.col(end) == F.col("used"), "left_anti")
        open_ = stored(open_, "open")
    found = reduce(DataFrame.union, taken) if taken else open_
    return found.select(F.col("a").alias(a), F.col("b").alias(b))


def mark_corequisites(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges that exist both ways, neither of which the reduction removed, are corequisites."""
    both = kept.join(kept.select(F.col("dependent").alias("prerequisite"), F.col("prerequisite").alias("dependent")), ["prerequisite", "dependent"], "left_semi")
    rows = kept.join(both.withColumn("mutual", F.lit(True)), ["prerequisite", "dependent"], "left")
    return rows.select("prerequisite", "dependent", F.when(F.col("mutual"), F.lit("corequisite")).otherwise("prerequisite").alias("type"))


def resolve_chains(mapping: DataFrame) -> DataFrame:
    """``(old, new)`` with the final target; entries that run into a cycle are dropped."""
    rows = stored(mapping.select("old", "new").where("old <> new"), "chain")
    for _ in range(MAX_ROUNDS):
        ahead = rows.select(F.col("old").alias("new"), F.col("new").alias("then"))
        step = rows.join(ahead, "new", "left").select("old", F.coalesce("then", "new").alias("new"), F.col("then").isNotNull().alias("moved"))
        rows = stored(step.where("old <> new"), "chain")
        if not rows.where("moved").limit(1).count():
            return rows.select("old", "new")
        rows = rows.select("old", "new")
    return rows.join(rows.select(F.col("old").alias("new")), "new", "left_anti").select("old", "new")


def rewrite_links(links: DataFrame, mapping: DataFrame) -> DataFrame:
    for end in ("src_topic", "dst_topic"):
        to = mapping.select(F.col("old").alias(end), F.col("new").alias("_new"))
        links = links.join(to, end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    return links.where("src_topic <> dst_topic").groupBy("src_topic", "dst_topic").agg(F.sum("count").alias("count"))


#: Rank of a point's quality when points merge.
QUALITY_RANK = {"verified": 4, "accepted": 3, "draft": 2, "disputed": 1}


def merge_plan(kps: DataFrame, issues: DataFrame) -> DataFrame:
    """``(old, new)`` for pairs to merge: more evidence wins, then quality; equal pairs are skipped."""
    rank = F.coalesce(*(F.when(F.col("quality") == q, F.lit(r)) for q, r in QUALITY_RANK.items()), F.lit(0))
    ranked = kps.select("kp_id", F.struct("evidence_count", rank.alias("rank")).alias("standing"))
    a, b = (ranked.select(F.col("kp_id").alias(f"kp_{k}"), F.col("standing").alias(f"standing_{k}")) for k in "ab")
    rows = issues.where("action = 'merge'").join(a, "kp_a").join(b, "kp_b").where("standing_a <> standing_b")
    first = F.col("standing_a") > F.col("standing_b")
    return rows.select(F.when(first, F.col("kp_b")).otherwise(F.col("kp_a")).alias("old"), F.when(first, F.col("kp_a")).otherwise(F.col("kp_b")).alias("new"))


def merge_kps(kps: DataFrame, members: DataFrame, edges: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points, memberships and edges after the merges. Memberships keep their greatest strength."""
    plan = stored(resolve_chains(merge_plan(kps, issues)), "plan")

    def moved(df: DataFrame, column: str) -> DataFrame:
        return df.join(plan.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")

    kept = kps.join(plan.select(F.col("old").alias("kp_id")), "kp_id", "left_anti")
    held = moved(members, "kp_id").groupBy("qa_id", "kp_id").agg(F.max("membership_strength").alias("membership_strength"))
    routed = moved(moved(edges, "source"), "target").where("source <> target").groupBy("source", "target", "type").agg(F.max("combined_strength").alias("combined_strength"))
    return kept, held, routed


def split_kps(members: DataFrame, judged: DataFrame) -> DataFrame:
    """Memberships after splits ``(kp_id, part, qa_ids)``: named members go to ``<kp>s<part>`` at strength 0.8."""
    named = judged.select("kp_id", "part", F.explode("qa_ids").alias("qa_id")).join(members.select("kp_id", "qa_id").hint("merge"), ["kp_id", "qa_id"], "left_semi")
    parts = named.select("qa_id", F.concat("kp_id", F.lit("s"), F.col("part").cast("string")).alias("kp_id"), F.lit(0.8).alias("membership_strength"))
    rest = members.join(named.select("kp_id", "qa_id").distinct().hint("merge"), ["kp_id", "qa_id"], "left_anti")
    return rest.select("qa_id", "kp_id", "membership_strength").union(parts.distinct())


def split_candidates(kps: DataFrame, members: DataFrame) -> DataFrame:
    held = members.groupBy("kp_id").agg(F.count("*").alias("members"))
    return kps.join(held, "kp_id").where("evidence_count >= 6 and members >= 4").select("kp_id", "evidence_count", "members")


def review_outcome(rounds: DataFrame, streak: int = 2, most: int = 5) -> DataFrame:
    """Quality after review rounds ``(kp_id, round, passed, changed)``: two passes in a row verify; a last
    round without change keeps; the most rounds dispute; else accepted."""
    order = F.array_sort(F.collect_list(F.struct("round", "passed", "changed")))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def fold(s: Column, r: Column) -> Column:
        run = F.when(r["passed"], s["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(s["best"], run).alias("best"))

    rows = rounds.groupBy("kp_id").agg(order.alias("rounds"))
    best = F.aggregate("rounds", start, fold)["best"]
    outcome = F.when(best >= streak, F.lit("verified")).when(~F.element_at("rounds", -1)["changed"], F.lit("keep")).when(F.size("rounds") >= most, F.lit("disputed")).otherwise("accepted")
    return rows.select("kp_id", outcome.alias("outcome"))
