"""Similarity, clustering and retrieval over vector columns.

Vectors are ``array<float>`` of unit length, so a cosine is a dot product. Searches and self-joins are exact at every
size; they multiply packed groups of vectors that can reach the wanted score (``cells``).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeloom.operators import cells
from gradeloom.session import stored


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    """``a`` at length 1. The vector and its length are bound as elements of arrays, or they would be worked out for every component."""
    scaled = lambda v, size: F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)
    return F.transform(F.array(a), lambda v: F.transform(F.array(norm(v)), lambda size: scaled(v, size))[0])[0]


def similar_pairs(vectors: DataFrame, tau: float, encoder: str) -> DataFrame:
    """``(a, b, similarity)`` of at least tau by the encoder's own comparison; all pairs are compared."""
    from gradeloom.functions.extension import encoder_of

    found = cells.pairs_at_least(cells.build(vectors, pivots={}), tau, kernel=encoder_of(encoder).kernel).where("x <> y")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("score").alias("similarity"))


def cosine_pairs(vectors: DataFrame, tau: float) -> DataFrame:
    """``(a, b, cosine)`` for pairs a < b of ``vectors(id, vector)`` with a cosine of at least tau: all of them.

    Vectors that are null or hold nulls, NaN or infinity link with nothing, nor do null ids or vectors of unlike widths.
    """
    found = cells.pairs_at_least(cells.build(vectors), tau).where("x <> y")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("score").alias("cosine"))


def _with_limit(best: DataFrame, tau: float, min_k: int) -> DataFrame:
    return best.where((F.col("score") >= tau) | (F.col("nth") <= min_k))


def search(corpus: DataFrame, queries: DataFrame, tau: float = 0.5, min_k: int = 3, cap: int = 15, encoder: str | None = None) -> DataFrame:
    """Best ``cap`` rows of the corpus for each query: those of tau or more, and the first ``min_k`` anyway. Exact; ties by id.

    Compared by inner products, or as a registered encoder compares. One pass over all rows; for repeated searches of one corpus
    see ``search_index``."""
    from gradeloom.functions.extension import encoder_of

    kernel = cells.dot if encoder is None else encoder_of(encoder).kernel
    return _with_limit(cells.best_rows(cells.build(corpus, pivots={}), queries, cap, kernel), tau, min_k)


def search_index(home: str, queries: DataFrame, tau: float = 0.5, min_k: int = 3, cap: int = 15) -> DataFrame:
    """``search`` in the index that ``cells.create_index`` and ``cells.append_index`` keep in the folder ``home``."""
    return _with_limit(cells.best_rows(cells.open_index(queries.sparkSession, home), queries, cap), tau, min_k)


def keyword_jaccard(a: Column, b: Column) -> Column:
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.size(F.array_union(words(a), words(b))), F.lit(1))


#: Weights of the four signals of dual-channel retrieval.
DUAL_WEIGHTS = {"embedding": 0.35, "topic": 0.35, "behavior": 0.20, "keyword": 0.10}


def search_dual(corpus: DataFrame, queries: DataFrame, links: DataFrame, fragments: DataFrame, help_map: DataFrame, tau: float = 0.5, min_k: int = 3, cap: int = 15, recall: int = 30) -> DataFrame:
    """Two channels: the nearest rows, and rows that topics and help behaviour lead to.

    ``corpus(id, vector, topic, text, qa_id)``, ``queries(query_id, vector, topic, text)``. Channel B
    takes 20 rows of the query's topic, 10 of each of 5 adjacent topics and 30 second-order rows from
    the first 15 of channel A; it has no embedding score.
    """
    from .joins import adjacent_topics, helped_by, second_order

    a = search(corpus, queries, tau=-1.0, min_k=recall, cap=recall).select("query_id", "id", "score", "nth")
    topics = corpus.select("topic", "id").withColumn("rank", F.row_number().over(W.partitionBy("topic").orderBy("id"))).where("rank <= 20")
    near = adjacent_topics(links).withColumn("rank", F.row_number().over(W.partitionBy("topic").orderBy("adjacent"))).where("rank <= 5")
    own = queries.select("query_id", "topic").join(topics, "topic").select("query_id", "id")
    side = queries.select("query_id", "topic").join(near.drop("rank"), "topic").join(topics.where("rank <= 10").select(F.col("topic").alias("adjacent"), "id"), "adjacent").select("query_id", "id")
    seeds = a.where("nth <= 15").join(corpus.select("id", "qa_id"), "id").select("query_id", "qa_id").distinct()
    walk = second_order(fragments, help_map, seeds).join(seeds, "qa_id").select("query_id", F.col("other_qa_id").alias("qa_id")).distinct()
    walk = walk.join(corpus.select("id", "qa_id"), "qa_id").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("id"))).where("rank <= 30").select("query_id", "id")
    b = own.union(side).union(walk).distinct().join(a.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("score", F.lit(0.0))
    both = a.select("query_id", "id", F.col("score").alias("embedding")).union(b.select("query_id", "id", "score"))
    rows = both.join(corpus.select("id", F.col("topic").alias("row_topic"), F.col("text").alias("row_text"), "qa_id"), "id").join(queries.select("query_id", "topic", "text"), "query_id")
    helped = helped_by(fragments, help_map, seeds).join(seeds, "qa_id").select("query_id", "helped_qa_id").distinct()
    acts = fragments.select("qa_id", F.col("point_id").alias("fragment_id")).join(help_map, "fragment_id").join(helped, "helped_qa_id")
    behavior = acts.groupBy("query_id", "qa_id").agg(F.least(F.count("*") / 10, F.lit(1.0)).alias("behavior"))
    linked = adjacent_topics(links).select("topic", F.col("adjacent").alias("row_topic"), F.lit(0.5).alias("linked"))
    rows = rows.join(behavior, ["query_id", "qa_id"], "left").join(linked, ["topic", "row_topic"], "left")
    topic = F.when(F.col("topic") == F.col("row_topic"), 1.0).otherwise(F.coalesce("linked", F.lit(0.0)))
    w = DUAL_WEIGHTS
    score = w["embedding"] * F.col("embedding") + w["topic"] * topic + w["behavior"] * F.coalesce("behavior", F.lit(0.0)) + w["keyword"] * keyword_jaccard(F.col("text"), F.col("row_text"))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    rows = rows.select("query_id", "id", score.alias("score")).withColumn("nth", nth)
    return rows.where((F.col("nth") <= cap) & ((F.col("score") >= tau) | (F.col("nth") <= min_k)))


def greedy_leaders(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, leader)`` of single-pass clustering in id order over the pairs (a < b) that are near.

    An item leads if no earlier leader is near it; others follow their earliest near leader. That is
    the lexicographically first maximal independent set, found in rounds: an item is settled once all
    its earlier neighbours are.
    """
    pairs = stored(pairs.select("a", "b"), "pairs")
    open_, leaders = stored(ids.select("id"), "open"), None
    while True:  # every round settles the least open item at least
        earlier = pairs.join(open_.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        new = stored(open_.join(earlier, "id", "left_anti"), "new")
        if not new.limit(1).count():
            break
        leaders = new if leaders is None else leaders.union(new)
        covered = pairs.join(new.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        open_ = stored(open_.join(new, "id", "left_anti").join(covered, "id", "left_anti"), "open")
    if leaders is None:
        return ids.select("id", F.col("id").alias("leader")).limit(0)
    led = pairs.join(leaders.select(F.col("id").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
    return leaders.select("id", F.col("id").alias("leader")).union(led.join(leaders, "id", "left_anti"))


def greedy_clusters(vectors: DataFrame, tau: float, least: int = 1) -> DataFrame:
    """Clusters of at least ``least`` members as ``(id, leader)``."""
    found = greedy_leaders(cosine_pairs(vectors, tau), vectors)
    return found.join(found.groupBy("leader").agg(F.count("*").alias("size")).where(F.col("size") >= least), "leader").select("id", "leader", "size")


def components(pairs: DataFrame, ids: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)``: the least id reachable over the pairs, by propagation of labels and of
    the labels' labels; every round is written to the shared folder."""
    both = stored(pairs.select(F.col(a).alias("id"), F.col(b).alias("other")).union(pairs.select(F.col(b), F.col(a))).distinct(), "edges")
    labels = stored(ids.select("id", F.col("id").alias("component")).distinct(), "labels")
    while True:  # the least label of a component spreads in every round
        near = both.join(labels.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("beyond"))
        step = stored(step.join(jump, "component", "left").select("id", F.least("component", "beyond").alias("component"), "before"), "labels")
        labels = step.select("id", "component")
        if not step.where("component <> before").limit(1).count():
            return labels


def _mean_vectors(rows: DataFrame, key: str) -> DataFrame:
    each = rows.select(key, F.posexplode("vector").alias("at", "x"))
    means = each.groupBy(key, "at").agg(F.avg("x").alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("mean"))


def cluster_stats(vectors: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per member its strength (cosine with the unit centroid) and rank; per cluster the cohesion."""
    rows = vectors.join(clusters, "id")
    centres = _mean_vectors(rows, "cluster").select("cluster", unit(F.col("mean")).alias("centroid"))
    rows = rows.join(stored(centres, "centres"), "cluster").withColumn("strength", dot("vector", "centroid"))
    nth = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("strength"), "id"))
    cohesion = F.avg("strength").over(W.partitionBy("cluster"))
    return rows.select("cluster", "id", F.bround("strength", 3).alias("strength"), nth.alias("nth"), cohesion.alias("cohesion")).withColumn("representative", F.col("nth") <= 3)


#: Rows of a group whose median one task works out; larger groups are spread over tasks.
LOCAL_ROWS = 4_096


def _weiszfeld(points: np.ndarray, weight: np.ndarray, centre: np.ndarray, tolerance: float) -> tuple[np.ndarray, float, np.ndarray | None]:
    """Sums of one pass: of pulled points, of pulls, and the nearest point if it is within the tolerance."""
    away = np.linalg.norm(points - centre, axis=1)
    if (away < tolerance).any():
        return np.zeros(len(centre)), 0.0, points[away.argmin()]
    pull = weight / away
    return pull @ points, float(pull.sum()), None


def geometric_median(rows: DataFrame, key: str, rounds: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """``(key, median)``: weighted geometric median of each group's vectors, by Weiszfeld's iteration from the weighted mean.

    A group of up to ``LOCAL_ROWS`` rows is one task's work. Larger ones are spread over all tasks: a round is one pass that sums up
    each task's pulls, and groups that have settled drop out. A group ends early at a point within the tolerance of its centre.
    """
    kind = rows.schema[key].dataType.simpleString()
    rows = rows.select(key, "vector", F.col("weight").cast("double").alias("weight"))

    def median(group: pd.DataFrame) -> pd.DataFrame:
        points, weight = np.stack(group["vector"].to_numpy()).astype(float), group["weight"].to_numpy(float)
        centre = np.average(points, axis=0, weights=weight)
        for _ in range(rounds):
            pulled, pull, at = _weiszfeld(points, weight, centre, tolerance)
            moved = pulled / pull if at is None else at
            settled = at is not None or np.linalg.norm(moved - centre) < tolerance
            centre = moved
            if settled:
                break
        return pd.DataFrame({key: [group[key].iloc[0]], "median": [centre.tolist()]})

    large = stored(rows.groupBy(F.col(key).alias("large")).agg(F.count("*").alias("n")).where(F.col("n") > LOCAL_ROWS), "large")
    same = F.col(key).eqNullSafe(F.col("large"))
    small = rows.join(large.hint("merge"), same, "left_anti").groupBy(key).applyInPandas(median, f"{key} {kind}, median array<double>")
    if not large.limit(1).count():
        return small
    held = stored(rows.join(large.hint("merge"), same, "left_semi"), "rows")
    return small.union(_spread_medians(held, key, rounds, tolerance))


def _spread_medians(rows: DataFrame, key: str, rounds: int, tolerance: float) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()
    sums = f"{key} {kind}, pulled array<double>, pull double, at array<double>, away double"

    def passed(batches):
        """A task's sums of each group; a missing centre asks for the weighted mean."""
        for batch in batches:
            for _, group in batch.groupby(key, dropna=False, sort=False):
                points, weight = np.stack(group["vector"].to_numpy()).astype(float), group["weight"].to_numpy(float)
                centre, at, away = group["centre"].iloc[0], None, np.nan
                if centre is None:
                    pulled, pull = weight @ points, float(weight.sum())
                else:
                    pulled, pull, at = _weiszfeld(points, weight, np.asarray(centre, float), tolerance)
                    away = np.nan if at is None else float(np.linalg.norm(at - np.asarray(centre, float)))
                yield pd.DataFrame({key: [group[key].iloc[0]], "pulled": [pulled.tolist()], "pull": [pull], "at": [None if at is None else at.tolist()], "away": [away]})

    def after(centres: DataFrame) -> DataFrame:
        found = rows.join(centres.select(F.col(key).alias("of"), "centre").hint("merge"), F.col(key).eqNullSafe(F.col("of"))).drop("of")
        each = found.mapInPandas(passed, sums)
        nearest = each.groupBy(key).agg(F.min(F.when(F.col("at").isNotNull(), F.struct("away", "at")))["at"].alias("at"))
        parts = each.where("pull > 0").select(key, "pull", F.posexplode("pulled").alias("place", "x")).groupBy(key, "place").agg((F.sum("x") / F.sum("pull")).alias("x"))
        moved = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("moved"))
        joined = nearest.join(moved.select(F.col(key).alias("of"), "moved").hint("merge"), F.col(key).eqNullSafe(F.col("of")), "left")
        was = centres.select(F.col(key).alias("was_of"), F.col("centre").alias("was"))
        joined = joined.join(was.hint("merge"), F.col(key).eqNullSafe(F.col("was_of")))
        step = F.sqrt(F.aggregate(F.zip_with("moved", "was", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
        settled = F.coalesce(F.col("at").isNotNull() | (step < tolerance), F.lit(False))
        return stored(joined.select(key, F.coalesce("at", "moved").alias("centre"), settled.alias("settled")), "centres")

    none = F.lit(None).cast("array<double>").alias("centre")
    centres, done = after(stored(rows.select(key).distinct().select(key, none), "centres")), []
    for _ in range(rounds):
        centres = after(centres)
        done.append(centres.where("settled"))
        centres = centres.where("not settled")
        if not centres.limit(1).count():
            break
    done.append(centres)
    return reduce(DataFrame.union, done).select(key, F.col("centre").alias("median"))


def outlier_qas(vectors: DataFrame, least: int = 5, sigmas: float = 2.0, floor: float = 0.25, flat: float = 0.01) -> DataFrame:
    """Questions far from their topic's centroid, in topics of five questions or more."""
    centres = _mean_vectors(vectors, "topic").select("topic", unit(F.col("mean")).alias("centroid"))
    rows = vectors.join(stored(centres, "centres"), "topic").withColumn("distance", 1 - dot("vector", "centroid"))
    topic = W.partitionBy("topic")
    rows = rows.select("topic", "id", "distance", F.avg("distance").over(topic).alias("mean"), F.stddev_pop("distance").over(topic).alias("sd"), F.count("*").over(topic).alias("n"))
    return rows.where((F.col("n") >= least) & (F.col("sd") >= flat) & (F.col("distance") > F.col("mean") + sigmas * F.col("sd")) & (F.col("distance") > floor))


def semantic_edges(vectors: DataFrame, tau: float = 0.5, medium: float = 0.65) -> DataFrame:
    confidence = F.when(F.col("cosine") >= medium, F.lit("medium")).otherwise("low")
    return cosine_pairs(vectors, tau).select(F.col("a").alias("source"), F.col("b").alias("target"), "cosine", confidence.alias("confidence"))


def _within(rows: DataFrame, key: str, tau: float, least: int) -> DataFrame:
    """Greedy clusters inside each key: ``(key, leader, size)``. Small keys are multiplied together, large ones in several groups."""
    near = cells.pairs_at_least(cells.build(rows.select("id", "vector", key), within=key), tau, within=True).where("x <> y")
    found = greedy_leaders(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), rows).join(rows.select("id", key), "id")
    return found.groupBy(key, "leader").agg(F.count("*").alias("size")).where(F.col("size") >= least)


def discover_pitfalls(lines: DataFrame, key: str = "kp_id", tau: float = 0.80, least: int = 3, top: int = 5) -> DataFrame:
    """Recurring missed lines: clusters of ``lines(id, key, vector, line)`` within a key, the largest first."""
    enough = lines.groupBy(key).agg(F.count("*").alias("lines")).where(F.col("lines") >= least)
    found = _within(lines.join(enough, key, "left_semi"), key, tau, least)
    named = found.join(lines.select(F.col("id").alias("leader"), F.col("line").alias("pattern")), "leader")
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.desc("size"), "leader"))
    return named.withColumn("nth", nth).where(F.col("nth") <= top)


def missed_patterns(lines: DataFrame, answers: DataFrame, near: float = 0.60, tau: float = 0.80) -> DataFrame:
    """Per topic, clusters of the missed lines that its answers speak about."""
    best = lines.join(answers.select("topic", F.col("vector").alias("answer")), "topic").groupBy("id").agg(F.max(dot("vector", "answer")).alias("best"))
    kept = lines.join(best.where(F.col("best") >= near), "id", "left_semi")
    return discover_pitfalls(kept, "topic", tau, least=2)


def pitfall_relevance(pitfalls: DataFrame, topics: DataFrame, tau: float = 0.40) -> DataFrame:
    """Whether a pitfall is about its topic; without a topic text it isn't."""
    rows = pitfalls.join(topics.select("topic", F.col("vector").alias("topic_vector")), "topic", "left")
    return rows.select("id", "topic", F.coalesce(dot("vector", "topic_vector") >= tau, F.lit(False)).alias("relevant"))


def topic_merge_plan(topics: DataFrame, tau: float = 0.85, ambiguous: float = 0.30) -> tuple[DataFrame, DataFrame]:
    """Merges ``(loser, winner)`` of near topics ``(topic, vector, n)``, and pairs to be judged.

    Pairs are taken in topic order; the smaller topic goes into the larger (ties: into the first).
    A topic that has been merged is passed over as the first or second of later pairs, but a row keeps
    going after it was merged itself, so chains can occur (see ``graph.resolve_chains``).
    """
    pairs = stored(cosine_pairs(topics.select(F.col("topic").alias("id"), "vector"), ambiguous), "pairs")
    sized = topics.select("topic", "n")
    strong = pairs.where(F.col("cosine") >= tau).join(sized.select(F.col("topic").alias("a"), F.col("n").alias("n_a")), "a").join(sized.select(F.col("topic").alias("b"), F.col("n").alias("n_b")), "b")
    strong = stored(strong, "strong")
    # A topic's row is taken unless an earlier taken row of no smaller topic is near it; the first such row takes the topic in.
    leads = stored(greedy_leaders(strong.where("n_a >= n_b"), topics.select(F.col("topic").alias("id"))), "leads")
    into_first = leads.where("id <> leader").select(F.col("id").alias("loser"), F.col("leader").alias("winner"))
    rows = strong.where("n_a < n_b").join(leads.where("id = leader").select(F.col("id").alias("a")), "a")
    rows = rows.join(leads.select(F.col("id").alias("b"), "leader"), "b").where("leader = b or leader >= a")
    return into_first.union(rows.groupBy(F.col("a").alias("loser")).agg(F.max("b").alias("winner"))), pairs.where(F.col("cosine") < tau)


def apply_merge_verdicts(judged: DataFrame) -> DataFrame:
    """Renames from verdicts ``(topic_a, topic_b, merge, canonical)``; of two targets the shorter wins."""
    a, b, c = F.col("topic_a"), F.col("topic_b"), F.col("canonical")
    row = lambda x, y: F.struct(x.alias("old"), y.alias("new"))
    made = F.when(c == a, F.array(row(b, a))).when(c == b, F.array(row(a, b))).otherwise(F.array(row(a, c), row(b, c)))
    rows = judged.where("merge").select(F.inline(made)).where("old <> new")
    nth = F.row_number().over(W.partitionBy("old").orderBy(F.length("new"), "new"))
    return rows.withColumn("nth", nth).where("nth = 1").select("old", "new")


def kp_thresholds(members: DataFrame, floor: float = 0.50) -> DataFrame:
    """Similarity a question needs to join a point: median less MAD of its members' cosines, floor at least.

    The members' pairs are counted, not made: see ``cells.medians_within``. Members without a whole vector have no pairs.
    """
    made = cells.build(members.select("id", unit(F.col("vector").cast("array<double>")).alias("vector"), "kp_id"), within="kp_id")
    found = stored(cells.medians_within(made).select("key", "median", "mad"), "medians")
    sizes = members.groupBy("kp_id").agg(F.count("*").alias("n"))
    value = F.when(F.col("n") >= 3, F.greatest(F.lit(floor), F.col("median") - F.col("mad"))).otherwise(floor)
    return sizes.join(found.hint("merge"), F.col("kp_id").eqNullSafe(F.col("key")), "left").select("kp_id", "n", value.alias("threshold"))


def apply_signals(kps: DataFrame, signals: DataFrame) -> DataFrame:
    """Fold signals ``(kp_id, seq, kind, vector)`` into centroids in order: help +.05, hurt -.02, post
    +.03 (renormalised), user halfway."""
    from gradeloom.functions.extension import signal_weight

    ordered = signals.groupBy("kp_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "vector"))).alias("signals"))
    double = lambda c: c.cast("array<double>")

    def fold(centre: Column, s: Column) -> Column:
        old, new = signal_weight(s["kind"])
        return unit(F.zip_with(centre, double(s["vector"]), lambda x, y: old * x + new * y))

    rows = kps.join(ordered, "kp_id", "left")
    return rows.select("kp_id", F.coalesce(F.aggregate("signals", double(F.col("vector")), fold), double(F.col("vector"))).alias("vector"))


def decay_and_promote(kps: DataFrame, members: DataFrame, rate: float = 0.95, least: int = 3) -> DataFrame:
    """Embryonic points fade below three members and become stable from three on."""
    rows = kps.join(members.groupBy("kp_id").agg(F.count("*").alias("n")).hint("merge"), "kp_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    young = F.col("quality") == "embryonic"
    return rows.select(
        "kp_id",
        F.when(young & (F.col("n") < least), F.transform("vector", lambda x: x * rate)).otherwise(F.transform("vector", lambda x: x * 1.0)).alias("vector"),
        F.when(young & (F.col("n") >= least), F.lit("stable")).otherwise(F.col("quality")).alias("quality"),
    )


def compare_kps(vectors: DataFrame, pairs: DataFrame, encoder: str | None = None) -> DataFrame:
    """``(a, b, cosine)`` of stated pairs, or ``(a, b, similarity, method)`` as a registered encoder compares."""
    from gradeloom.functions.extension import encoder_of

    left, right = (vectors.select(F.col("id").alias(k), F.col("vector").alias(f"vector_{k}")) for k in ("a", "b"))
    rows = pairs.hint("merge").join(left, "a").join(right.hint("merge"), "b")
    if encoder is None:
        return rows.select("a", "b", cosine("vector_a", "vector_b").alias("cosine"))
    own = encoder_of(encoder)
    return rows.select("a", "b", own.compare(F.col("vector_a"), F.col("vector_b")).alias("similarity"), F.lit(own.method).alias("method"))


def place_qa(scores: DataFrame, kps: DataFrame, least: float = 0.3, most: int = 50) -> DataFrame:
    """Best point of each question by judged score, and the tier that its score gives. Only the ``most``
    points of ``kps`` with most ``evidence`` take part (ties by id)."""
    kps = kps.orderBy(F.desc("evidence"), "kp_id").limit(most)
    scores = scores.join(F.broadcast(kps.select("kp_id")), "kp_id", "left_semi")
    best = scores.where(F.col("score") >= least).groupBy("qa_id").agg(F.max(F.struct("score", "kp_id")).alias("best"))
    tier = F.when(F.col("score") >= 0.8, 0.8).when(F.col("score") >= 0.5, 0.5).otherwise(0.2)
    rows = best.select("qa_id", "best.kp_id", "best.score").join(kps.select("kp_id", "name", "description"), "kp_id")
    topic = F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise(F.substring("description", 1, 80))
    return rows.select("qa_id", "kp_id", topic.alias("topic"), tier.alias("centrality"))


def topic_related(first: DataFrame, results: DataFrame, qa: DataFrame, links: DataFrame) -> DataFrame:
    """For topics without a link: the topics among what their first question (query_id = topic) retrieves."""
    linked = links.select(F.explode(F.array("src_topic", "dst_topic")).alias("topic")).distinct()
    lone = first.select("topic").join(linked.hint("merge"), "topic", "left_anti")
    rows = results.join(qa.select("id", F.col("topic").alias("other")), "id").withColumnRenamed("query_id", "topic").join(lone.hint("merge"), "topic", "left_semi")
    return rows.where("topic <> other").groupBy("topic", "other").agg(F.count("*").alias("count"))
