"""Hand-made frames for edge cases of the assessment operators."""

import math
import random
from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import aggregates, cells, difficulty, graph, scalars, topics, upserts, vectors, windows
from gradeloom.session import local_session, scratch_path
from gradeloom.streaming import events


@pytest.fixture(scope="module")
def spark():
    return local_session()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_weights(spark):
    rows = spark.createDataFrame([(1, 0, 0), (2, 3, 3), (3, 1, 4)], "id long, success_count long, total_attempts long")
    got = {r.id: (r.weight, r.lower_bound) for r in aggregates.qa_weights(rows).collect()}
    assert got[1] == (0.5, 0.0) and got[2][0] == 0.8 and got[3][0] == 0.333


def test_upper_median(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (10,)], "x int")
    assert rows.agg(aggregates.upper_median(F.col("x"))).first()[0] == 3


@pytest.mark.parametrize("line,bullet", [("- a", True), ("1) a. b", False), ("12. x", True), ("(a) x", True), ("3 x", False)])
def test_bullets(spark, line, bullet):
    assert one(spark, scalars.is_bullet(F.lit(line))) is bullet


@pytest.mark.parametrize("text,lang", [("", "en"), ("abc", "en"), ("a" * 100 + "知" * 5, "en"), ("a" * 100 + "知" * 6, "zh")])
def test_language(spark, text, lang):
    assert one(spark, scalars.detect_lang(F.lit(text))) == lang


def test_natural_order(spark):
    rows = spark.createDataFrame([("1(a)",), ("10(a)",), ("2",), ("x",)], "q string")
    assert [r.q for r in rows.orderBy(scalars.qn_key(F.col("q"))).collect()] == ["x", "1(a)", "2", "10(a)"]


def test_sequence_skips_repeats(spark):
    qa = spark.createDataFrame([(k, "p", str(k)) for k in range(4)], "id long, paper string, question_number string")
    members = spark.createDataFrame(list(zip(range(4), "aaba")), "qa_id long, kp_id string")
    assert {(r.source, r.target, r["count"]) for r in windows.sequential_transitions(qa, members).collect()} == {("a", "b", 1), ("b", "a", 1)}


def test_votes(spark):
    rows = spark.createDataFrame([(0.109,), (0.111,)], "s double")
    got = [tuple(r) for r in rows.select(*difficulty.vote(F.col("s"), F.lit(0.10), F.lit(None).cast("double"))).collect()]
    assert got == [(2, True), (2, False)]


def test_fusion(spark):
    rows = spark.createDataFrame([("a", "b", "prerequisite", 4.0, None, None, None), ("a", "b", "related", None, 0.6, None, None)], "source string, target string, type string, retrieval double, semantic double, sequential double, learning double")
    r = graph.fuse_edges(rows).first()
    assert (r.combined_strength, r.confidence, r.type) == (1.78, "high", "prerequisite")


@pytest.mark.parametrize("edges,kept", [([("a", "b"), ("a", "c"), ("c", "b")], {("a", "c"), ("c", "b")}), ([("a", "b"), ("a", "c"), ("c", "a")], {("a", "b"), ("a", "c"), ("c", "a")})])
def test_reduction(spark, edges, kept):
    found = graph.transitive_reduction(spark.createDataFrame(edges, "prerequisite string, dependent string"))
    assert {tuple(r) for r in found.collect()} == kept


def test_chains(spark):
    rows = spark.createDataFrame([("B", "A"), ("C", "B"), ("X", "Y"), ("Y", "X")], "old string, new string")
    assert {tuple(r) for r in graph.resolve_chains(rows).collect()} == {("B", "A"), ("C", "A")}


@pytest.mark.parametrize("n,threshold", [(99, 0.30), (100, 0.225), (300, 0.15), (500, 0.105)])
def test_migration_threshold(spark, n, threshold):
    assert one(spark, topics.migration_threshold(n)) == pytest.approx(threshold)


def test_greedy_clusters(spark):
    import math

    rows = spark.createDataFrame([(k, [math.cos(a), math.sin(a)]) for k, a in enumerate(math.radians(d) for d in (0, 30, 60))], "id long, vector array<double>")
    found = vectors.greedy_clusters(rows, math.cos(math.radians(40)))
    assert {(r.id, r.leader) for r in found.collect()} == {(0, 0), (1, 0), (2, 2)}


def test_geometric_median(spark):
    rows = spark.createDataFrame([("g", [0.0, 0.0], 1.0), ("g", [0.0, 0.0], 1.0), ("g", [10.0, 0.0], 1.0)], "k string, vector array<double>, weight double")
    assert vectors.geometric_median(rows, "k").first()["median"][0] < 0.5


def test_insert_once(spark):
    rows = spark.createDataFrame([(2, "q", "a"), (1, "q", "a")], "id long, question_text string, answer_text string")
    assert [r.id for r in upserts.insert_qa(rows.limit(0), rows).collect()] == [1]


def brute_split(sets):
    """Parts of one topic's help sets in order, over all pairs in exact fractions."""
    n = len(sets)
    sim = [[Fraction(len(a & b), len(a | b)) if a | b else Fraction(0) for b in sets] for a in sets]
    total = [sum(row) - row[k] for k, row in enumerate(sim)]
    worth = {(i, j): (total[i] + total[j] - 2 * sim[i][j]) / (n - 2) - sim[i][j] for i, j in combinations(range(n), 2)}
    i, j = max(worth, key=worth.get)
    if worth[i, j] < Fraction(3, 10):
        return {}
    parts = ([i], [j])
    for k in range(n):
        if k not in (i, j):
            near = [(sim[k][s] + sum(sim[k][m] for m in p)) / (len(p) + 1) for s, p in zip((i, j), parts)]
            parts[near[1] > near[0]].append(k)
    means = [sum(sim[a][b] for a, b in combinations(p, 2)) / max(1, len(p) * (len(p) - 1) // 2) for p in parts]
    return {} if min(map(len, parts)) < 3 or min(means) < Fraction(4, 10) else {k: s for s, p in zip("ab", parts) for k in p}


def test_split_topics(spark):
    """Topics of every size, above 400 fragments too, split as over all pairs."""
    rng = np.random.default_rng(5)
    sets = {}
    for t, n in enumerate([6, 7, 9, 12, 20, 30, 30, 40, 5, 120]):
        camps = [rng.choice(50, 6, replace=False) + (0 if t % 3 else 100 * c) for c in range(2)]
        sets[f"t{t}"] = [{int(x) for x in camps[int(rng.integers(2))] if rng.random() < 0.9} or {int(camps[0][0])} for _ in range(n)]
    sets["one"], sets["large"] = [{1, 2}] * 8, [{100 * (k % 2) + x for x in range(4 + k % 3)} for k in range(450)]
    want = {(f"{t}_{k:04d}", f"{t}_{s}") for t, own in sets.items() if len(own) >= 6 for k, s in brute_split(own).items()}
    assert any(f.startswith("large") for f, _ in want) and len({p[:2] for _, p in want}) > 3
    members = spark.createDataFrame([(f"{t}_{k:04d}", t) for t, own in sets.items() for k in range(len(own))], "fragment_id string, topic_id string")
    help_map = spark.createDataFrame([(f"{t}_{k:04d}", x) for t, own in sets.items() for k, s in enumerate(own) for x in s], "fragment_id string, helped_qa_id long")
    live = spark.createDataFrame([(t, "forming") for t in sets], "topic_id string, quality string")
    assert {(r.fragment_id, r.part) for r in topics.split_topics(members, help_map, live).collect()} == want


def test_pairs_in_blocks(spark, monkeypatch):
    """Every pair at any size: several blocks, and the blocks' sizes don't show."""
    monkeypatch.setattr(cells, "LEAST_ROWS", 20)
    x = np.random.default_rng(2).normal(size=(150, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [1.0, None]), (None, [1.0] * 8), (902, [1.0]), (903, [0.5])], "id long, vector array<float>")
    sim = x.astype(float) @ x.T.astype(float)
    want = {(a, b) for a, b in combinations(range(150), 2) if sim[a, b] >= 0.3} | {(902, 903)}
    found = [(r.a, r.b) for r in vectors.cosine_pairs(rows, 0.3).collect()]
    assert set(found) == want and len(found) == len(want)
    assert vectors.cosine_pairs(rows.limit(0), 0.3).count() == 0
    best = vectors.search(rows.where("id < 150"), rows.where("id < 150").withColumnRenamed("id", "query_id"), 0.5, 3, 15).collect()
    order = [sorted(range(150), key=lambda k: (-sim[q, k], k))[:15] for q in range(150)]
    assert {(r.query_id, r.id) for r in best} == {(q, k) for q in range(150) for n, k in enumerate(order[q]) if sim[q, k] >= 0.5 or n < 3}


def test_search_of_many_queries(spark):
    """More queries than a block has rows."""
    corpus = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(4)], "id long, vector array<double>")
    queries = spark.range(5001).select(F.col("id").alias("query_id"), F.array(F.lit(0.0), F.lit(1.0)).alias("vector"))
    found = vectors.search(corpus, queries, tau=2.0, min_k=1, cap=2).groupBy("id").count().collect()
    assert {tuple(r) for r in found} == {(2, 5001), (3, 5001)}


def test_whole_tables(spark):
    """Queries without SQL run over their whole tables, not over the first ids."""
    from gradeloom import catalog

    data = "/root/testdata/sf0.01"
    run = lambda name: catalog.queries()[name](spark, data).collect()
    rows = spark.read.parquet(f"{data}/embeddings.parquet").selectExpr("concat('topic_', label) AS topic", "embedding AS vector", "1.0D AS weight")
    want = {r.topic: float(np.linalg.norm(r["median"])) for r in vectors.geometric_median(rows, "topic").collect()}
    assert {r.topic: r.size for r in run("v8_geometric_median")} == pytest.approx(want, abs=1e-4)
    medians = {r.topic: r["median"] for r in vectors.geometric_median(rows, "topic").collect()}
    assert all(r.median == pytest.approx(list(medians[r.topic]), abs=1e-4) for r in run("v8_geometric_median"))
    assert max(int(r.loser[1:]) for r in run("v14_topic_merge_plan")) >= 200


def test_rendered_values(spark):
    """Each type's values against its range, by difficulty; examples and unknown names."""
    params = [("b", "Binary string", "1"), ("h", "hex", "F"), ("d", "denary", "1"), ("k", "colour", "red"), ("n", None, None)]
    rows = spark.createDataFrame([(k, "{b}|{h}|{d}|{k}|{n}|{x}", params) for k in range(40)], "template_id long, template string, params array<struct<name:string,type:string,example:string>>")
    for level, bits, low, high, least, most in (("basic", 4, 1, 15, 1, 100), ("intermediate", 8, 16, 255, 100, 10000), ("hard", 16, 256, 65535, 100, 10000)):
        found = scalars.render_variations(rows, n=2, difficulty=level).collect()
        assert len(found) == 80 and len({r.question for r in found}) > 40
        for r in found:
            b, h, d, *rest = r.question.split("|")
            assert len(b) == bits and low <= int(b, 2) <= high and len(h) == 2 and h == h.upper() and 1 <= int(h, 16) <= 255
            assert least <= int(d) <= most and rest == ["red", "0", "{x}"]


def test_greedy_chain(spark):
    """A chain takes a round for every second item, however long it is."""
    ids = spark.range(14)
    pairs = spark.range(13).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = {r.id: r.leader for r in vectors.greedy_leaders(pairs, ids).collect()}
    assert found == {k: k - k % 2 for k in range(14)}


def test_centrality_edges(spark):
    """Dissolved topics and fragments without a topic are left out; a missing cohesion counts one half."""
    old = spark.createDataFrame([(x, 0.5, n) for x, n in (("a", 1), ("b", 1), ("c", 1), ("d", 1), ("e", 0))], "fragment_id string, centrality_score double, verification_count int")
    helped = spark.createDataFrame([("a", 1.0), ("a", 0.5), ("c", 1.0)], "fragment_id string, help_effect double")
    members = spark.createDataFrame([("a", "t"), ("b", "u"), ("c", "gone"), ("e", "t")], "fragment_id string, topic_id string")
    of = spark.createDataFrame([("t", "forming", 1.0), ("u", "stable", None), ("gone", "dissolved", 1.0)], "topic_id string, quality string, cohesion double")
    got = {r.fragment_id: r.centrality_score for r in topics.update_centrality(old, helped, members, of).collect()}
    assert got == {"a": 0.625, "b": 0.35}


def test_cycle_gate(spark):
    """Without new help rows nothing splits, merges or is dealt out; centrality is renewed all the same."""
    rows = [(f"f{k}", f"{'xy'[k // 6]}", k // 3, 1.0) for k in range(12)]
    helped = spark.createDataFrame([(f, q * 10 + j, e) for f, _, q, e in rows for j in range(3)], "fragment_id string, helped_qa_id long, help_effect double")
    members = spark.createDataFrame([(f, t, None) for f, t, _, _ in rows], "fragment_id string, topic_id string, previous_topic_id string")
    of = spark.createDataFrame([("x", "forming"), ("y", "forming")], "topic_id string, quality string")
    old = spark.createDataFrame([(f, 0.5, 1) for f, *_ in rows], "fragment_id string, centrality_score double, verification_count int")
    open_, shut = (topics.run_cycle(helped, members, of, helped_before=n, centrality=old) for n in (0, 16))
    assert {r.topic_id for r in open_.members.collect()} == {"x_a", "x_b", "y_a", "y_b"} and open_.report.first()["split"] == 2
    assert {r.topic_id for r in shut.members.collect()} == {"x", "y"} and shut.report.first()["split"] == 0
    assert shut.centrality.count() == 12


def test_index_by_batch_and_restart(spark):
    """An index without rows at first; known ids stay, each call goes on where the last one ended, every part can be searched."""
    schema, home = "id long, vector array<double>", scratch_path(spark, "index")
    path = scratch_path(spark, "stream")
    first = spark.createDataFrame([], schema)
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<double>")
    for part, found in (([(1, [1.0, 0.0]), (1, [2.0, 0.0])], [1]), ([(2, [0.9, 0.1]), (1, [0.0, 9.0]), (3, None)], [1, 2]), ([], [1, 2]), ([(4, [3.0, 0.0])], [4, 1, 2])):
        spark.createDataFrame(part, schema).write.mode("append").parquet(path)
        events.index_stream(first, spark.readStream.schema(schema).parquet(path), home)
        assert [r.id for r in vectors.search_index(home, asked).orderBy("nth").collect()] == found


def test_learner_states_by_batch(spark):
    turns = "query_id long, student_id long, role string, content string, ts long"
    states = spark.createDataFrame([(1, "heat", "mastered", 4)], "student_id long, topic string, state string, evidence_count long")
    retrieved = spark.createDataFrame([(10, "heat", 1), (10, "light", 2), (11, "heat", 1), (10, "far", 3)], "query_id long, topic string, nth int")
    path, home = scratch_path(spark, "turns"), None
    for part in ([(10, 1, "user", "why", 1), (10, 1, "assistant", "so", 2)], [(11, 1, "user", "how", 3)]):
        spark.createDataFrame(part, turns).write.mode("append").parquet(path)
        found, home = events.student_stream(spark.readStream.schema(turns).parquet(path), retrieved, states, home)
    assert {(r["topic"], r["state"], r["evidence_count"]) for r in found.collect()} == {("heat", "learning", 6), ("light", "learning", 1)}
    memory = spark.read.parquet(f"{home}/out=0")
    assert sorted(r["content"] for r in memory.collect()) == ["how", "why"]


def test_update_mode_keeps_the_last_count(spark):
    path, home = scratch_path(spark, "bus"), scratch_path(spark, "bus")
    spark.createDataFrame([], "type string").write.parquet(path)
    empty = events.run_to_table(events.event_stats(spark.readStream.schema("type string").parquet(path)), spark, "update", ["type"])
    assert empty.columns == ["type", "n"] and not empty.collect()
    for part in (["a", "a", "b"], ["a"]):
        spark.createDataFrame([(x,) for x in part], "type string").write.mode("append").parquet(path)
        found = events.run_to_table(events.event_stats(spark.readStream.schema("type string").parquet(path)), spark, "update", ["type"], home)
    assert {(r["type"], r["n"]) for r in found.collect()} == {("a", 3), ("b", 1)}


def unit_rows(n, width, seed):
    points = np.random.default_rng(seed).normal(size=(n, width))
    return (points / np.linalg.norm(points, axis=1, keepdims=True)).tolist()


def brute_leaders(rows, tau):
    """id -> leader: each free item, in order, takes the free ones near it."""
    leader = {}
    for a, v in rows:
        if a not in leader:
            leader[a] = a
            leader |= {b: a for b, w in rows if b > a and b not in leader and np.dot(v, w) >= tau}
    return leader


def brute_pitfalls(lines, tau, least, top=5, enough=3):
    out = set()
    for key in {key for _, key, _ in lines}:
        rows = [(i, v) for i, k, v in lines if k == key]
        if len(rows) >= enough:
            sizes = Counter(brute_leaders(rows, tau).values())
            kept = sorted((-n, leader) for leader, n in sizes.items() if n >= least)[:top]
            out |= {(key, leader, -n, nth) for nth, (n, leader) in enumerate(kept, 1)}
    return out


def test_pitfalls_and_missed_patterns(spark):
    keys = ["a"] * 40 + ["b"] * 20 + ["c"] * 2
    lines = [(i, k, v) for i, (k, v) in enumerate(zip(keys, unit_rows(62, 3, 1)))]
    frame = spark.createDataFrame([(i, k, f"line {i}", v) for i, k, v in lines], "id long, topic string, line string, vector array<double>")
    found = vectors.discover_pitfalls(frame, "topic", 0.8, 3)
    expected = brute_pitfalls(lines, 0.8, 3)
    assert expected and {(r["topic"], r["leader"], r["size"], r["nth"]) for r in found.collect()} == expected
    assert all(r["pattern"] == f"line {r['leader']}" for r in found.collect())
    answers = [(k, v) for k, v in zip("aabb", unit_rows(4, 3, 2))]
    near = [(i, k, v) for i, k, v in lines if any(k == t and np.dot(v, w) >= 0.2 for t, w in answers)]
    found = vectors.missed_patterns(frame, spark.createDataFrame(answers, "topic string, vector array<double>"), 0.2, 0.8)
    expected = brute_pitfalls(near, 0.8, 2, enough=2)
    assert expected and {(r["topic"], r["leader"], r["size"]) for r in found.collect()} == {x[:3] for x in expected}


def test_merge_plan_in_order(spark):
    rows = [(f"t{i:02d}", v, i * 7 % 5) for i, v in enumerate(unit_rows(40, 3, 3))]
    plan, judged = vectors.topic_merge_plan(spark.createDataFrame(rows, "topic string, vector array<double>, n long"), 0.8, 0.5)
    merged, between = {}, set()
    for a, v, n in rows:
        between |= {(a, b) for b, w, _ in rows if b > a and 0.5 <= np.dot(v, w) < 0.8}
        if a not in merged:
            for b, w, m in rows:
                if b > a and b not in merged and np.dot(v, w) >= 0.8:
                    loser, winner = (a, b) if n < m else (b, a)
                    merged[loser] = winner
    assert merged and {r["loser"]: r["winner"] for r in plan.collect()} == merged
    assert {(r["a"], r["b"]) for r in judged.collect()} == between


def test_anchors_are_spaced_over_topics(spark):
    rows = [(i, None if i % 23 == 0 else f"topic {i % 23:02d}", (i * 37 % 101) / 100, False) for i in range(230)]
    found = aggregates.difficulty_anchors(spark.createDataFrame(rows, "id long, topic string, weight double, is_representative boolean"), cap=7)
    heads = {}
    for i, topic, weight, _ in rows:
        heads[topic] = min(heads.get(topic, (0, 0)), (-weight, i)) if topic in heads else (-weight, i)
    names = sorted(heads, key=lambda x: (x is not None, x or ""))
    assert [(r["topic"], r["id"]) for r in found.orderBy("position").collect()] == [(x, heads[x][1]) for x in names[::3][:7]]


def test_headers_take_the_longest_topic(spark):
    points = spark.createDataFrame([("heat and light",), ("heat",), ("sound",), (None,), ("heat",)], "header string")
    links = spark.createDataFrame([("heat", "a", 3), ("heat", "b", 1)], "src string, dst string, count long")
    related = spark.createDataFrame([("heat and", "x", 2), ("heat and", "w", 2)], "topic string, other string, count long")
    found = {(r["header"], r["topic"], r["note"]) for r in scalars.annotate_related(points, links, related).collect()}
    assert found == {("heat and light", "heat and", "Related: w, x"), ("heat", "heat", "See also: a (ref 3)"), ("sound", None, None), (None, None, None)}
