"""Self-organising topics: fragments move, topics split, merge and dissolve by what they help with."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeloom.session import small_or_merge, stored, tasks_for

from .graph import greedy_matching
from .joins import helps_of
from .vectors import geometric_median

LIVE = ("embryonic", "forming", "stable")


def record_help(uses: DataFrame, grades: DataFrame, fragments: DataFrame) -> DataFrame:
    """Effect of each used question's fragments on the question that used it, and its level."""
    points = F.col("covered") + F.col("missed")
    effect = F.bround(F.when(points > 0, F.col("covered") / points).otherwise(0.0), 3)
    own = fragments.select(F.col("qa_id").alias("ref_qa_id"), F.col("point_id").alias("fragment_id"))
    rows = uses.where("used").join(grades, "qa_id").join(own, "ref_qa_id").select("fragment_id", F.col("qa_id").alias("helped_qa_id"), effect.alias("help_effect"))
    rows = rows.groupBy("fragment_id", "helped_qa_id").agg(F.max("help_effect").alias("help_effect"))
    level = F.when(F.col("help_effect") >= 0.7, F.lit("direct")).when(F.col("help_effect") >= 0.3, F.lit("understanding")).otherwise("none")
    return rows.withColumn("help_level", level)


class Overlaps(NamedTuple):
    rows: DataFrame  #: ``(fragment_id, topic_id, common, f, t)``
    tasks: int  #: to deal them over by fragment


def _affinity(overlaps: DataFrame) -> DataFrame:
    return overlaps.select("fragment_id", "topic_id", (F.col("common") / F.least("f", "t")).alias("affinity"))


def _loyalty(overlaps: Overlaps, members: DataFrame) -> DataFrame:
    keys = ["fragment_id", "topic_id"]
    share = overlaps.rows.select(*keys, (F.col("common") / F.col("f")).alias("share")).repartition(overlaps.tasks, *keys)
    rows = members.select(*keys).repartition(overlaps.tasks, *keys).hint("merge").join(share, keys, "left")
    return rows.select("fragment_id", "topic_id", F.coalesce("share", F.lit(0.5)).alias("loyalty"))


def _held(help_map: DataFrame) -> DataFrame:
    """The help rows, written once: they are counted and read several times."""
    return stored(help_map.select("fragment_id", "helped_qa_id"), "help")


def _overlaps(held: DataFrame, members: DataFrame) -> Overlaps:
    """Fragments and topics that help a common question.

    A help row gets the topics of its fragment, then the list of all topics that help its question, and goes back to its fragment,
    where the lists are counted: no row is made for a pair of a help row and a topic before it can be counted. Topics go by number
    meanwhile, and tasks follow the number of help rows. The first row of a question also counts the question for its topics.
    """
    n = tasks_for(held)
    numbers = stored(members.select("topic_id").where("topic_id is not null").distinct().withColumn("no", F.monotonically_increasing_id()), "numbers")
    homes = members.join(small_or_merge(numbers), "topic_id").repartition(n, "fragment_id").groupBy("fragment_id").agg(F.collect_set("no").alias("homes"))
    own = held.where("fragment_id is not null").repartition(n, "fragment_id").distinct()
    own = own.join(homes.hint("merge"), "fragment_id", "left").withColumn("homes", F.coalesce("homes", F.array().cast("array<long>")))
    by = W.partitionBy("helped_qa_id").orderBy("fragment_id")
    rows = own.repartition(n, "helped_qa_id").select(
        "fragment_id", F.col("helped_qa_id").isNotNull().alias("linked"), (F.row_number().over(by) == 1).alias("first"),
        F.array_distinct(F.flatten(F.collect_set("homes").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))).alias("topics"),
    )
    each = rows.repartition(n, "fragment_id").select("fragment_id", "linked", "first", F.explode(F.array_append("topics", F.lit(None))).alias("no"))
    counts = each.groupBy("fragment_id", "no").agg(F.count_if("linked").alias("common"), F.count_if("first").alias("firsts"), F.count("*").alias("rows"))
    f = F.max(F.when(F.col("no").isNull(), F.col("rows"))).over(W.partitionBy("fragment_id"))  # the null that ends each list
    counts = stored(counts.select("fragment_id", "no", "common", "firsts", f.alias("f")).where("no is not null"), "overlaps")
    t = stored(counts.groupBy("no").agg(F.sum("firsts").alias("t")).join(numbers.hint("merge"), "no"), "sizes")
    return Overlaps(counts.where("common > 0").join(small_or_merge(t), "no").select("fragment_id", "topic_id", "common", "f", "t"), n)


def _only(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """Rows of the given topics."""
    return rows.join(small_or_merge(stored(topics.select("topic_id"), "wanted")), "topic_id", "left_semi")


def loyalty(help_map: DataFrame, members: DataFrame) -> DataFrame:
    """Share of a fragment's helped questions that its topic helps; half if either helps none."""
    return _loyalty(_overlaps(_held(help_map), members), members)


def affinity(help_map: DataFrame, members: DataFrame) -> DataFrame:
    """Common helped questions over the smaller set, for pairs that have any (others are 0)."""
    return _affinity(_overlaps(_held(help_map), members).rows)


def migration_threshold(n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return 0.15 * F.when(n < 100, 2.0).when(n < 300, 1.5).when(n < 500, 1.0).otherwise(0.7)


def migrations(help_map: DataFrame, members: DataFrame, topics: DataFrame, include_dissolved: bool = False, least_help: int = 20) -> DataFrame:
    """Moves ``(fragment_id, src, dst)`` to a topic with more affinity than loyalty, where enough agree."""
    return _migrations(_held(help_map), members, topics, include_dissolved, least_help)


def _migrations(held: DataFrame, members: DataFrame, topics: DataFrame, include_dissolved: bool = False, least_help: int = 20) -> DataFrame:
    n = held.agg(F.count("*").alias("n"))
    open_ = topics if include_dissolved else topics.where("quality <> 'dissolved'")
    overlaps = _overlaps(held, members)
    other = overlaps.rows.join(small_or_merge(stored(open_.select("topic_id", F.lit(True).alias("open")), "open")), "topic_id", "left").repartition(overlaps.tasks, "fragment_id")
    own = members.select("fragment_id", F.col("topic_id").alias("src")).repartition(overlaps.tasks, "fragment_id")
    share = F.max(F.when(F.col("topic_id") == F.col("src"), F.col("common") / F.col("f")))
    best = F.max(F.when((F.col("topic_id") != F.col("src")) & F.col("open"), F.struct((F.col("common") / F.least("f", "t")).alias("affinity"), "topic_id")))
    rows = own.hint("merge").join(other, "fragment_id").groupBy("fragment_id", "src").agg(F.coalesce(share, F.lit(0.5)).alias("loyalty"), best.alias("best"))
    rows = rows.join(F.broadcast(n)).where((F.col("n") >= least_help) & (F.col("best.affinity") - F.col("loyalty") > migration_threshold(F.col("n"))))  # one row
    mass = members.groupBy(F.col("topic_id").alias("src")).agg(F.count("*").alias("mass"))
    rows = rows.select("fragment_id", "src", F.col("best.topic_id").alias("dst")).join(mass, "src").withColumn("agree", F.count("*").over(W.partitionBy("src", "dst")))
    return rows.where(F.col("agree") >= F.when(F.col("mass") < 5, 2).otherwise(3)).select("fragment_id", "src", "dst")


def migrate(help_map: DataFrame, members: DataFrame, topics: DataFrame) -> DataFrame:
    """Memberships after the moves; moved fragments start with a loyalty of one half."""
    return _migrate(_held(help_map), members, topics)


def _migrate(held: DataFrame, members: DataFrame, topics: DataFrame) -> DataFrame:
    moves = _migrations(held, members, topics).select("fragment_id", "dst")
    rows = members.join(moves, "fragment_id", "left")
    return rows.select(
        "fragment_id", F.coalesce("dst", "topic_id").alias("topic_id"), F.when(F.col("dst").isNotNull(), F.col("topic_id")).otherwise(F.col("previous_topic_id")).alias("previous_topic_id")
    )


def topic_stats(members: DataFrame, help_map: DataFrame, topics: DataFrame) -> DataFrame:
    """Mass, cohesion, stability and the quality that follows."""
    return _topic_stats(members, _overlaps(_held(help_map), members), topics)


def _topic_stats(members: DataFrame, overlaps: Overlaps, topics: DataFrame) -> DataFrame:
    keys = ["fragment_id", "topic_id"]
    rows = members.repartition(overlaps.tasks, *keys).hint("merge").join(_loyalty(overlaps, members), keys).groupBy("topic_id").agg(
        F.count("*").alias("mass"), F.avg("loyalty").alias("mean"), F.count_if(F.col("previous_topic_id").isNotNull() & (F.col("previous_topic_id") != F.col("topic_id"))).alias("churn")
    )
    rows = topics.select("topic_id", "quality").join(rows, "topic_id", "left").withColumn("mass", F.coalesce("mass", F.lit(0)))
    stability = F.when(F.col("mass") > 0, 1 - F.coalesce("churn", F.lit(0)) / F.col("mass")).otherwise(0.0)
    rows = rows.select("topic_id", "quality", "mass", F.when(F.col("mass") < 2, 1.0).otherwise(F.col("mean")).alias("cohesion"), stability.alias("stability"))
    quality = (
        F.when(F.col("mass") == 0, F.lit("dissolved"))
        .when((F.col("quality") == "embryonic") & (F.col("stability") >= 0.8) & (F.col("mass") >= 4), F.lit("forming"))
        .when((F.col("stability") < 0.3) & (F.col("mass") < 3), F.lit("dissolved"))
        .otherwise(F.col("quality"))
    )
    return rows.withColumn("quality", quality)


class _Overlap:
    """Jaccard similarities of one topic's help sets, row by row from an inverted index.

    Fragments of equal sets share a kind, and only kinds are compared; memory is linear in the
    topic's help rows, as no table of all pairs is kept.
    """

    def __init__(self, helped: pd.Series):
        lists = [np.asarray(x) for x in helped]
        size = np.array([len(x) for x in lists])
        codes = pd.factorize(np.concatenate(lists))[0].astype(np.int64) if size.sum() else np.empty(0, np.int64)
        seen: dict[bytes, int] = {}
        self.kind = np.array([seen.setdefault(np.sort(x).tobytes(), len(seen)) for x in np.split(codes, np.cumsum(size)[:-1])])
        self.weight = np.bincount(self.kind)
        sets = [np.frombuffer(x, np.int64) for x in seen]
        self.size = np.array([len(x) for x in sets])
        items = np.concatenate(sets)
        self.sets, self.owner = sets, np.repeat(np.arange(len(sets)), self.size)[np.argsort(items, kind="stable")]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(items, minlength=1))])
        self.total = np.zeros(len(sets))
        for k in range(len(sets)):
            near, sim = self.near(k)
            self.total[k] = (self.weight[near] * sim).sum() - (self.size[k] > 0)

    def near(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Kinds that share a question with kind k, itself among them, and their similarities."""
        found = [self.owner[self.start[x] : self.start[x + 1]] for x in self.sets[k]]
        near, common = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        return near, common / (self.size[k] + self.size[near] - common)

    def dense(self, k: int) -> np.ndarray:
        row = np.zeros(len(self.size))
        near, sim = self.near(k)
        row[near] = sim
        return row

    def worth(self, k: int) -> np.ndarray:
        """Worth of a fragment of kind k and one of every kind as seeds, to nine decimals."""
        sim = self.dense(k)
        out = (self.total[k] + self.total - 2 * sim) / (len(self.kind) - 2) - sim
        if self.weight[k] < 2:
            out[k] = -np.inf
        return np.round(out, 9)

    def seeds(self, least: float) -> tuple[int, int] | None:
        """The first pair of greatest worth; a row is passed over if even the greatest total couldn't lift it."""
        bound = (self.total + self.total.max()) / (len(self.kind) - 2) + 1e-8
        best = least
        for k in np.argsort(-self.total, kind="stable"):
            if bound[k] < best:
                break
            best = max(best, self.worth(k).max())
        for k in dict.fromkeys(self.kind.tolist()):
            if bound[k] >= best and len(mates := np.flatnonzero(self.worth(k) >= best)):
                i = int(np.argmax(self.kind == k))
                mate = np.isin(self.kind, mates)
                mate[i] = False
                return i, int(np.argmax(mate))
        return None


def split_topics(members: DataFrame, help_map: DataFrame, topics: DataFrame, least: int = 6) -> DataFrame:
    """``(fragment_id, topic_id, part)`` of topics that fall into two groups by the questions they help.

    Similarity is the Jaccard of help sets. The seed pair has the greatest mean similarity to the other
    fragments less its own similarity (0.3 at least); others join the nearer seed, in order; both parts
    need three fragments and a mean similarity of 0.4. Figures are compared to nine decimals, ties go to
    the first pair and the first part. Topics of every size are split; as each fragment depends on those
    before it, a topic is one task, which holds the topic's help rows.
    """
    return _split_topics(members, _held(help_map), topics, least)


def _split_topics(members: DataFrame, held: DataFrame, topics: DataFrame, least: int = 6) -> DataFrame:
    n = tasks_for(held)
    live = _only(members, topics.where(F.col("quality").isin(*LIVE)))
    sized = live.withColumn("mass", F.count("*").over(W.partitionBy("topic_id"))).where(F.col("mass") >= least)
    sets = sized.repartition(n, "fragment_id").hint("merge").join(held.repartition(n, "fragment_id"), "fragment_id").groupBy("topic_id", "fragment_id").agg(F.collect_set("helped_qa_id").alias("helped"))

    def split(group: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame(columns=["fragment_id", "topic_id", "part"], dtype=object)
        if len(group) < least:
            return none
        group = group.sort_values("fragment_id")
        names, over = group["fragment_id"].tolist(), _Overlap(group["helped"])
        seeds = over.seeds(0.3)
        if seeds is None:
            return none
        to_seed = [over.dense(over.kind[s]) for s in seeds]
        held = [np.bincount([over.kind[s]], minlength=len(over.size)) for s in seeds]
        parts, inner = ([seeds[0]], [seeds[1]]), [0.0, 0.0]
        for n, k in enumerate(over.kind):
            if n not in seeds:
                near, sim = over.near(k)
                sums = [(h[near] * sim).sum() for h in held]
                mean = [round((s[k] + t) / (len(p) + 1), 9) for s, t, p in zip(to_seed, sums, parts)]
                at = int(mean[1] > mean[0])
                parts[at].append(n)
                held[at][k] += 1
                inner[at] += sums[at]
        means = [round(x / max(1, len(p) * (len(p) - 1) // 2), 9) for x, p in zip(inner, parts)]
        if min(map(len, parts)) < 3 or min(means) < 0.4:
            return none
        topic = group["topic_id"].iloc[0]
        return pd.DataFrame([(names[k], topic, f"{topic}_{s}") for s, p in zip("ab", parts) for k in p], columns=["fragment_id", "topic_id", "part"])

    return sets.groupBy("topic_id").applyInPandas(split, "fragment_id string, topic_id string, part string")


def merge_topics(members: DataFrame, help_map: DataFrame, topics: DataFrame, tau: float = 0.5, least_affinity: float = 0.4) -> DataFrame:
    """``(topic_a, topic_b, merged)``: pairs of topics that help mostly the same questions, greedily in order."""
    held = _held(help_map)
    return _merge_topics(members, held, _overlaps(held, members), topics, tau, least_affinity)


def _merge_topics(members: DataFrame, held: DataFrame, overlaps: Overlaps, topics: DataFrame, tau: float = 0.5, least_affinity: float = 0.4) -> DataFrame:
    """``overlaps`` of all members: those of a topic don't depend on other topics."""
    alive = topics.where(F.col("quality").isin(*LIVE))
    live = _only(members, alive)
    lists = stored(helps_of(live, held).groupBy("helped_qa_id").agg(F.collect_list("topic_id").alias("topics")), "lists")
    each = lists.select("helped_qa_id", "topics", F.explode("topics").alias("topic_a"))
    sizes = each.groupBy(F.col("topic_a").alias("topic_id")).agg(F.count("*").alias("n"))
    common = each.where("helped_qa_id is not null").select("topic_a", F.explode("topics").alias("topic_b")).where("topic_a < topic_b").groupBy("topic_a", "topic_b").agg(F.count("*").alias("common"))
    a, b = (sizes.select(F.col("topic_id").alias(f"topic_{k}"), F.col("n").alias(f"n_{k}")) for k in "ab")
    pairs = common.join(a, "topic_a").join(b, "topic_b").where(F.col("common") >= tau * (F.col("n_a") + F.col("n_b") - F.col("common")))
    near = _only(_affinity(overlaps.rows), alive).withColumnRenamed("topic_id", "other").repartition(overlaps.tasks, "fragment_id")
    near = near.hint("merge").join(live.select("fragment_id", "topic_id").repartition(overlaps.tasks, "fragment_id"), "fragment_id")
    size = live.groupBy("topic_id").agg(F.count("*").alias("members"))
    mean = near.groupBy("topic_id", "other").agg(F.sum("affinity").alias("total")).join(size, "topic_id").select("topic_id", "other", (F.col("total") / F.col("members")).alias("mean"))
    there = mean.select(F.col("topic_id").alias("topic_a"), F.col("other").alias("topic_b"), F.col("mean").alias("there"))
    back = mean.select(F.col("topic_id").alias("topic_b"), F.col("other").alias("topic_a"), F.col("mean").alias("back"))
    pairs = stored(pairs.join(there, ["topic_a", "topic_b"]).join(back, ["topic_a", "topic_b"]).where((F.col("there") + F.col("back")) / 2 >= least_affinity).select("topic_a", "topic_b"), "pairs")
    found = greedy_matching(pairs, "topic_a", "topic_b")
    return found.select("topic_a", "topic_b", F.concat("topic_a", F.lit("_m"), "topic_b").alias("merged"))


def redistribute(members: DataFrame, help_map: DataFrame, topics: DataFrame, least: float = 0.1) -> DataFrame:
    """Fragments of dissolved topics: the live topic of most affinity (loyalty .3), or stay (loyalty 0)."""
    return _redistribute(members, _overlaps(_held(help_map), members), topics, least)


def _redistribute(members: DataFrame, overlaps: Overlaps, topics: DataFrame, least: float = 0.1) -> DataFrame:
    """``overlaps`` of all members: those of a topic don't depend on other topics."""
    gone = _only(members, topics.where("quality = 'dissolved'")).select("fragment_id", F.col("topic_id").alias("from_topic"))
    best = _only(_affinity(overlaps.rows).where(F.col("affinity") > least), topics.where(F.col("quality").isin(*LIVE))).repartition(overlaps.tasks, "fragment_id")
    best = best.groupBy("fragment_id").agg(F.max(F.struct("affinity", "topic_id")).alias("best"))
    rows = gone.repartition(overlaps.tasks, "fragment_id").hint("merge").join(best, "fragment_id", "left")
    return rows.select("fragment_id", F.coalesce("best.topic_id", "from_topic").alias("topic_id"), F.when(F.col("best").isNotNull(), 0.3).otherwise(0.0).alias("loyalty"))


def update_centrality(centrality: DataFrame, help_map: DataFrame, members: DataFrame, topics: DataFrame) -> DataFrame:
    """Moving average of centrality: .60 old, .30 mean help, .10 topic cohesion; at most 1, three places
    (ties as nine decimals show them). Fragments without a topic or of dissolved topics are left out; a
    missing cohesion counts one half."""
    helped = help_map.groupBy("fragment_id").agg(F.avg("help_effect").alias("help"))
    rows = centrality.where("verification_count >= 1").join(helped, "fragment_id", "left").join(members.select("fragment_id", "topic_id"), "fragment_id")
    rows = rows.join(topics.where("quality <> 'dissolved'").select("topic_id", "cohesion"), "topic_id")
    new = 0.6 * F.col("centrality_score") + 0.3 * F.coalesce("help", F.lit(0.0)) + 0.1 * F.coalesce("cohesion", F.lit(0.5))
    return rows.select("fragment_id", F.bround(F.bround(F.least(new, F.lit(1.0)), 9), 3).alias("centrality_score"), (F.col("verification_count") + 1).alias("verification_count"))


def vector_cascade(qa_vectors: DataFrame, members: DataFrame, kps: DataFrame, topic_points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Point vectors from their first five questions, and topic vectors from two points or more."""
    rows = members.join(kps.where("quality <> 'disputed'").select("kp_id"), "kp_id", "left_semi").join(qa_vectors.select(F.col("id").alias("qa_id"), "vector"), "qa_id")
    first = rows.withColumn("nth", F.row_number().over(W.partitionBy("kp_id").orderBy("qa_id"))).where("nth <= 5").withColumn("weight", F.lit(1.0))
    points = stored(geometric_median(first, "kp_id").withColumnRenamed("median", "vector"), "points")
    of = topic_points.join(points, "kp_id").withColumn("n", F.count("*").over(W.partitionBy("topic"))).where("n >= 2").withColumn("weight", F.lit(1.0))
    return points, geometric_median(of, "topic").withColumnRenamed("median", "vector")


def apply_confusions(difficulty: DataFrame, confusions: DataFrame) -> DataFrame:
    """Ten confusions raise a topic by one level, five raise a basic one; other labels count as basic."""
    rows = difficulty.join(confusions.select("topic", F.col("n").alias("confusions")), "topic", "left")
    level = F.when(F.col("mode_difficulty") == "advanced", 3).when(F.col("mode_difficulty") == "intermediate", 2).otherwise(1)
    n = F.coalesce("confusions", F.lit(0))
    raised = F.when(n >= 10, F.least(level + 1, F.lit(3))).when((n >= 5) & (level == 1), 2).otherwise(level)
    label = F.when(raised == 3, F.lit("advanced")).when(raised == 2, F.lit("intermediate")).otherwise("basic")
    return rows.where(raised > level).select("topic", F.col("mode_difficulty").alias("before"), label.alias("difficulty"), F.lit("student_feedback").alias("method"))


class Cycle(NamedTuple):
    members: DataFrame
    topics: DataFrame
    report: DataFrame  #: one row: how many moved, split, merged and were dealt out
    centrality: DataFrame | None = None
    points: DataFrame | None = None
    vectors: DataFrame | None = None


def run_cycle(
    help_map: DataFrame, members: DataFrame, topics: DataFrame, helped_before: int = 0, growth: int = 20,
    centrality: DataFrame | None = None, cascade: tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None = None,
) -> Cycle:
    """One cycle: move fragments, renew topic figures; split and merge topics and deal out dissolved ones
    if more than ``growth`` help rows came since the last cycle, which saw ``helped_before``; then renew
    fragment centrality and, from the four tables of ``cascade``, point and topic vectors."""
    held = _held(help_map)
    moved = stored(_migrate(held, members, topics), "members")
    overlaps = _overlaps(held, moved)
    renewed = stored(_topic_stats(moved, overlaps, topics), "topics")
    live = renewed if held.count() > helped_before + growth else renewed.limit(0)
    split = stored(_split_topics(moved, held, live), "split")
    merged = stored(_merge_topics(moved, held, overlaps, live), "merged")
    dealt = stored(_redistribute(moved, overlaps, live), "dealt")
    to = merged.select(F.explode(F.array("topic_a", "topic_b")).alias("topic_id"), "merged")
    rows = moved.join(split.select("fragment_id", "part"), "fragment_id", "left").join(to.hint("merge"), "topic_id", "left").join(dealt.select("fragment_id", F.col("topic_id").alias("dealt")), "fragment_id", "left")
    now = F.coalesce("part", "merged", "dealt", "topic_id")
    state = rows.select("fragment_id", now.alias("topic_id"), F.when(now != F.col("topic_id"), F.col("topic_id")).otherwise(F.col("previous_topic_id")).alias("previous_topic_id"))
    counts = [
        moved.join(members.select("fragment_id", F.col("topic_id").alias("was")), "fragment_id").where("was <> topic_id").agg(F.count("*").alias("moved")),
        split.agg(F.count_distinct("topic_id").alias("split")),
        merged.agg(F.count("*").alias("merged")),
        dealt.agg(F.count("*").alias("dealt_out")),
    ]
    report = counts[0]
    for one in counts[1:]:
        report = report.join(F.broadcast(one))  # one row each
    state = stored(state, "members")
    new = None if centrality is None else update_centrality(centrality, help_map, state, renewed)
    points, vectors = (None, None) if cascade is None else vector_cascade(*cascade)
    return Cycle(state, renewed, report, new, points, vectors)


def naming_inputs(topics: DataFrame, members: DataFrame, fragments: DataFrame, n: int = 20) -> DataFrame:
    """Up to n fragment texts of each forming topic, joined."""
    forming = topics.where("quality = 'forming'").select("topic_id")
    rows = members.join(forming, "topic_id", "left_semi").join(fragments.select(F.col("point_id").alias("fragment_id"), "point_text"), "fragment_id")
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("topic_id").orderBy("fragment_id"))).where(F.col("nth") <= n)
    parts = F.array_sort(F.collect_list(F.struct("nth", "point_text")))
    return rows.groupBy("topic_id").agg(F.array_join(F.transform(parts, lambda p: p["point_text"]), "; ").alias("texts"))
