"""What used to be one task's work, spread over tasks: against the sequential rule."""

import random
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import cells, graph, vectors
from gradeloom.session import local_session, stored


@pytest.fixture(scope="module")
def spark():
    return local_session()


def brute_matching(pairs):
    used, out = set(), set()
    for a, b in sorted(pairs):
        if a != b and a not in used and b not in used:
            used |= {a, b}
            out.add((a, b))
    return out


def test_greedy_matching(spark):
    draw = random.Random(1)
    sets = [{(draw.randrange(n), draw.randrange(n)) for _ in range(m)} for n, m in ((8, 12), (40, 60), (60, 300))] + [{(k, k + 1) for k in range(9)}, {(0, k) for k in range(30)}]
    rows = [(f"{g}.{a:03d}", f"{g}.{b:03d}") for g, pairs in enumerate(sets) for a, b in pairs]
    frame = spark.createDataFrame(rows + rows[:5] + [(None, "x")], "a string, b string")
    assert {tuple(r) for r in graph.greedy_matching(frame, "a", "b").collect()} == brute_matching(rows)
    assert graph.greedy_matching(frame.limit(0), "a", "b").count() == 0


def brute_plan(rows, near):
    """The order of the rule: rows by topic, a merged topic is passed over, a row goes on after its own merge."""
    merged = {}
    for k, (a, n) in enumerate(rows):
        if a not in merged:
            for b, m in rows[k + 1 :]:
                if b not in merged and (a, b) in near:
                    loser, winner = (a, b) if n < m else (b, a)
                    merged[loser] = winner
    return merged


def test_merge_plan_on_random_graphs(spark):
    """Many graphs at once, as topics in planes of their own: vectors that are near exactly where the graph says."""
    draw, rows, expected = random.Random(4), [], {}
    for g in range(30):
        n = 9
        angles = [draw.uniform(0, 2 * np.pi) for _ in range(n)]
        topics = [(f"{g:02d}.{k}", draw.randrange(4)) for k in range(n)]
        near = {(topics[i][0], topics[j][0]) for i, j in combinations(range(n), 2) if np.cos(angles[i] - angles[j]) >= 0.7}
        expected |= brute_plan(topics, near)
        for (name, size), angle in zip(topics, angles):
            v = [0.0] * 60
            v[2 * g], v[2 * g + 1] = float(np.cos(angle)), float(np.sin(angle))
            rows.append((name, v, size))
    plan, _ = vectors.topic_merge_plan(spark.createDataFrame(rows, "topic string, vector array<double>, n long"), 0.7, 0.5)
    got = [(r["loser"], r["winner"]) for r in plan.collect()]
    assert dict(got) == expected and len(got) == len(expected) and len(expected) > 40


def brute_median(points, weight, rounds=20, tolerance=1e-4):
    centre = sum(w * p for w, p in zip(weight, points)) / sum(weight)
    for _ in range(rounds):
        away = [float(np.sqrt(((p - centre) ** 2).sum())) for p in points]
        if min(away) < tolerance:
            return points[away.index(min(away))]
        pull = [w / d for w, d in zip(weight, away)]
        moved = sum(f * p for f, p in zip(pull, points)) / sum(pull)
        if np.sqrt(((moved - centre) ** 2).sum()) < tolerance:
            return moved
        centre = moved
    return centre


def test_geometric_medians_in_tasks_and_over_tasks(spark, monkeypatch):
    """Groups that settle, that run out of rounds, that end at a point, of one row, of equal rows; weights; a null key."""
    draw = np.random.default_rng(3)
    groups = {"wide": draw.normal(size=(60, 5)), "one": draw.normal(size=(1, 5)), "same": np.ones((30, 5)), "cross": np.concatenate([np.eye(5), -np.eye(5), np.zeros((1, 5))]), None: draw.normal(size=(40, 5))}
    groups["far"] = np.concatenate([draw.normal(size=(25, 5)), 1e4 + draw.normal(size=(20, 5))])
    weights = {k: draw.uniform(0.5, 2, len(v)) if k != "cross" else np.ones(len(v)) for k, v in groups.items()}
    rows = [(k, p.tolist(), float(w)) for k, v in groups.items() for p, w in zip(v, weights[k])]
    frame = spark.createDataFrame(rows, "g string, vector array<double>, weight double").repartition(6)
    expected = {k: brute_median(list(v), weights[k]) for k, v in groups.items()}
    for local in (4096, 20, 0):
        monkeypatch.setattr(vectors, "LOCAL_ROWS", local)
        found = {r.g: np.array(r.median) for r in vectors.geometric_median(frame, "g").collect()}
        assert found.keys() == expected.keys()
        for k, v in expected.items():
            assert np.allclose(found[k], v, rtol=1e-9, atol=1e-9), (local, k)


def test_thresholds_of_points(spark, monkeypatch):
    """Median less MAD without the pairs: one hot point, small ones together, equal vectors, rounds of selection."""
    draw = np.random.default_rng(6)
    sizes = {"hot": 180, "two": 2, "one": 1, None: 7, **{f"k{i}": 3 + i % 4 for i in range(25)}}
    rows, vectors_of = [], {}
    for k, n in sizes.items():
        vectors_of[k] = 1.0 + draw.normal(size=(n, 6)) if k != "k3" else np.ones((n, 6))
        rows += [(len(rows) + i, k, v.tolist()) for i, v in enumerate(vectors_of[k])]
    frame = spark.createDataFrame(rows, "id long, kp_id string, vector array<double>").repartition(5)
    expected = {}
    for k, v in vectors_of.items():
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        sims = np.array([float(a @ b) for a, b in combinations(u, 2)])
        expected[k] = max(0.1, float(np.median(sims) - np.median(np.abs(sims - np.median(sims))))) if len(v) >= 3 else 0.1
    for bins, values, least in ((4096, 50_000, 256), (64, 20, 16)):
        for name, value in (("SELECT_BINS", bins), ("SELECT_VALUES", values), ("LEAST_ROWS", least)):
            monkeypatch.setattr(cells, name, value)
        found = {r.kp_id: (r.n, r.threshold) for r in vectors.kp_thresholds(frame, 0.1).collect()}
        assert {k: n for k, (n, _) in found.items()} == sizes
        assert all(abs(found[k][1] - t) < 1e-12 for k, t in expected.items())


def test_medians_in_few_passes(spark, monkeypatch):
    """Median and MAD of all pairs by three passes over them at most (four where few are taken as values): a key in several groups, products in two heaps, equal rows, rows of unlike widths, null keys."""
    draw = np.random.default_rng(8)
    one = np.concatenate([np.ones((30, 8)), -np.ones((33, 8))])
    made = {"hot": [1 + draw.normal(size=(1700, 8))], "heaps": [one + 0.01 * draw.normal(size=one.shape)], "same": [np.ones((400, 8))], "widths": [draw.normal(size=(40, 8)), draw.normal(size=(70, 3))], "apart": [draw.normal(size=(1, 8)), draw.normal(size=(1, 3))], None: [draw.normal(size=(50, 8))], "pair": [draw.normal(size=(2, 8))]}
    rows, expected = [], {}
    for k, blocks in made.items():
        units = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in blocks]
        rows += [(k, v.tolist()) for u in units for v in u]
        sims = np.concatenate([(u @ u.T)[np.triu_indices(len(u), 1)] for u in units])
        if len(sims):
            expected[k] = (len(sims), np.median(sims), np.median(np.abs(sims - np.median(sims))))
    frame = spark.createDataFrame([(n, k, v) for n, (k, v) in enumerate(rows)], "id long, key string, vector array<double>").repartition(4)
    kept, passes = cells.stored, []
    monkeypatch.setattr(cells, "stored", lambda df, label: (passes.append(label), kept(df, label))[1])
    groups = cells.build(frame, within="key")
    for values, most in ((cells.SELECT_VALUES, 3), (2_000, 4)):
        monkeypatch.setattr(cells, "SELECT_VALUES", values)
        passes.clear()
        found = {r.key: (r.n, r["median"], r.mad) for r in cells.medians_within(groups).collect()}
        assert passes.count("counts") <= most
        assert found.keys() == expected.keys()
        for k, (n, median, mad) in expected.items():
            assert found[k][0] == n and abs(found[k][1] - median) < 1e-12 and abs(found[k][2] - mad) < 1e-12, k


@pytest.mark.parametrize("bins, ranges", [(1000, None), (0, None), (500, [(-0.3, -0.1), (0.2, 0.2 + 1e-13), (0.2 + 1e-7, 0.4), (0.35, 0.5)]), (0, [(-0.3, -0.1), (0.0, 0.001)])])
def test_pieces_hold_their_products(bins, ranges):
    """Every product counts once, in a piece that it lies in; of a block with itself each pair once."""
    draw = np.random.default_rng(9)
    x, y = ((v / np.linalg.norm(v, axis=1, keepdims=True)) for v in (draw.normal(size=(1100, 7)), draw.normal(size=(600, 7))))
    x[5] = x[900] = y[3]
    counts = cells._Counts(bins, ranges and [{"low": a, "high": b} for a, b in ranges], 7)
    both = [(v, v.astype(np.float32)) for v in (x, y)]
    counts.add(both[0], both[1], False)
    counts.add(both[0], both[0], True)
    _, low, high, n = counts.pieces()
    products = np.sort(np.concatenate([(x @ y.T).ravel(), (x @ x.T)[np.triu_indices(len(x), 1)]]))
    assert n.sum() == len(products)
    at_least, at_most = (np.repeat(e[order], n[order]) for e in (low, high) for order in [np.argsort(e)])
    assert (at_least <= products + 1e-15).all() and (products <= at_most + 1e-15).all()
    if ranges:  # as fine as asked for, inside the ranges
        inside = np.any([(products > a + 1e-12) & (products < b - 1e-12) for a, b in ranges], axis=0)
        assert (at_most - at_least)[inside].max() < (0.3 / bins + 1e-12 if bins else 1e-15)


def test_units_of_wide_vectors(spark):
    """A vector's length is worked out once, not for each of its components; vectors without length and null ones stay as they are."""
    took = {}
    for width in (16, 1024):
        rows = spark.range((1 << 18) // width, numPartitions=4).select(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda x: F.sin(x + F.col("id"))).alias("v"))
        rows = stored(rows, "rows")
        for _ in range(2):
            began = time.time()
            least, most = rows.select(vectors.norm(vectors.unit(F.col("v"))).alias("size")).agg(F.min("size"), F.max("size")).first()
            took[width] = time.time() - began
        assert abs(least - 1) < 1e-12 and abs(most - 1) < 1e-12
    assert took[1024] < 4 * took[16] + 2
    odd = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],), ([1.0, None],)], "v array<double>").select(vectors.unit(F.col("v")))
    assert [r[0] for r in odd.collect()] == [[0.6, 0.8], [0.0, 0.0], None, [], [1.0, None]]
