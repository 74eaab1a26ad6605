"""Emergent points against a plain run of the rule: all members kept, all pairs worked out again for each question."""

import random
from itertools import combinations

import numpy as np
import pytest

from gradeloom.session import local_session, scratch_path
from gradeloom.streaming import events, points

SCHEMA = "subject string, seq long, kind string, id long, kp_id string, quality string, vector array<double>"
ORDER = {"point": 0, "member": 1, "question": 2, "paper_end": 3}


@pytest.fixture(scope="module")
def spark():
    return local_session()


def brute_threshold(members, floor, spread):
    if len(members) < 3:
        return floor
    unit = [v / (np.linalg.norm(v) + 1e-10) for v in members]
    sims = np.array([float(a @ b) for a, b in combinations(unit, 2)])
    median = float(np.median(sims))
    return max(floor, median - spread * float(np.median(np.abs(sims - median))))


def brute_points(rows, floor=0.5, spread=1.0, least=3, decay=0.05):
    """Events of ``rows(subject, seq, kind, id, kp_id, quality, vector)`` and how often the median decided."""
    state, out, adaptive = {}, [], 0
    for subject, seq, kind, id_, kp_id, quality, v in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, ORDER[r[2]], r[4] or "", r[3] or 0)):
        held = state.setdefault(subject, {})
        v = None if v is None else np.array(v, float)
        if kind == "point":
            held[kp_id] = {"centre": v, "members": [], "young": quality == "embryonic"}
        elif kind == "member":
            held[kp_id]["members"].append(v)
        elif kind == "paper_end":
            for name, p in held.items():
                if p["young"] and len(p["members"]) < least:
                    p["centre"] = p["centre"] * (1 - decay)
                    out.append((subject, seq, None, name, "faded", round(float(np.linalg.norm(p["centre"])), 9), None))
                elif p["young"]:
                    p["young"] = False
                    out.append((subject, seq, None, name, "promoted", 1.0, None))
            out.append((subject, seq, None, None, "paper_completed", None, sum(p["young"] for p in held.values())))
        else:
            sims = {name: float(p["centre"] @ v / (np.linalg.norm(p["centre"]) * np.linalg.norm(v) + 1e-10)) for name, p in held.items()}
            best = max(sims, key=sims.get, default=None)
            limit = brute_threshold(held[best]["members"], floor, spread) if best else 0
            adaptive += limit > floor
            if best and sims[best] >= limit:
                p = held[best]
                p["members"].append(v)
                p["centre"] = np.mean(p["members"], axis=0)
                out.append((subject, seq, id_, best, "assigned", round(sims[best], 9), None))
            else:
                held[f"kp_emb_{id_}"] = {"centre": v, "members": [v], "young": True}
                out.append((subject, seq, id_, f"kp_emb_{id_}", "created", 1.0, None))
    return sorted(out, key=repr), adaptive


def found_in(rows):
    return sorted(((r.subject, r.seq, r.id, r.kp_id, r.event, None if r.similarity is None else round(r.similarity, 9), r.embryonic) for r in rows.collect()), key=repr)


def gathered(n, seed, subjects=2, width=6, around=5):
    """Questions around a few directions, so that points grow, some of them wide and some narrow."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(around, width))
    return [(f"s{i % subjects}", i, "question", i, None, None, (centres[k] + draw.normal(size=width) * (0.15 + 0.2 * k)).tolist()) for i, k in enumerate(draw.integers(0, around, n))]


def given(rows):
    """Every ninth question as a member of a point that is there before, with a centre of its own."""
    first = [("s0", None, "point", None, f"kp_{k}", "stable" if k else "embryonic", rows[k * 2][6]) for k in range(3)]
    return first + [("s0", None, "member", 10_000 + i, f"kp_{i % 3}", None, r[6]) for i, r in enumerate(rows[::9])], [r for i, r in enumerate(rows) if i % 9]


@pytest.mark.parametrize("width, floor", [(3, 0.5), (6, 0.3)])
def test_points_like_the_rule(spark, width, floor):
    """500 vectors, from nothing and from given points: thresholds of their own decide, and the exact cosines are asked for."""
    rows = gathered(500, 1, width=width)
    ends = [(f"s{k % 2}", s, "paper_end", None, None, None, None) for k in range(2) for s in (99, 250, 400)]
    before, rest = given(rows)
    for all_ in (rows + ends, before + rest + ends):
        expected, adaptive = brute_points(all_, floor)
        random.Random(2).shuffle(all_)
        found = events.assign_emergent(spark.createDataFrame(all_, SCHEMA).repartition(4), floor)
        assert found_in(found) == expected and adaptive > 100
        assert {e[4] for e in expected} == {"created", "assigned", "faded", "promoted", "paper_completed"}


def test_arrivals_and_quality(spark):
    rows = gathered(60, 3)
    before, rest = given(rows)
    frame = spark.createDataFrame(before + rest, SCHEMA)
    kinds = {k: frame.where(f"kind = '{k}'") for k in ORDER}
    made = events.arrivals(kinds["question"].select("subject", "seq", "id", "vector"), kinds["point"].drop("seq", "id"), kinds["member"].drop("seq", "quality"))
    expected, _ = brute_points(before + rest)
    found = events.assign_emergent(made)
    assert found_in(found) == expected
    sizes = {}
    for s, _, _, kp, *_ in expected + [("s0", 0, 0, r[4]) for r in before if r[2] == "member"]:
        sizes[s, kp] = sizes.get((s, kp), 0) + 1
    for r in events.with_quality(found, members=kinds["member"]).collect():
        assert r.members == sizes[r.subject, r.kp_id] and r.quality == ("stable" if r.members >= 3 else "embryonic")


def test_stream_over_batches_papers_and_restarts(spark):
    """Three micro-batches with papers' ends between, each by a new query on the same state: as one run over all rows."""
    rows = gathered(150, 5)
    before, rest = given(rows)
    ends = [(s, q, "paper_end", None, None, None, None) for s in ("s0", "s1") for q in (40, 60, 149)]
    all_ = before + rest + ends
    expected, adaptive = brute_points(all_, 0.4)
    assert adaptive and {e[4] for e in expected} >= {"faded", "promoted"}
    path, home = scratch_path(spark, "points"), scratch_path(spark, "points")
    with events.with_rocksdb(spark):
        for low, high in ((-1, 50), (50, 100), (100, 200)):
            part = [r for r in all_ if low <= (-1 if r[1] is None else r[1]) < high]
            spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(path)
            found = events.run_to_table(events.assign_stream(spark.readStream.schema(SCHEMA).parquet(path), 0.4), spark, home=home)
    assert found_in(found) == expected


def test_rows_that_take_no_part(spark):
    rows = [("s", 1, "question", 1, None, None, [1.0, 0.0]), ("s", 2, "question", 2, None, None, None), ("s", 3, "question", 3, None, None, [float("nan"), 1.0])]
    rows += [("s", 4, "question", 4, None, None, [1.0]), (None, 5, "question", 5, None, None, [0.0, 0.0]), ("s", 6, "question", 6, None, None, [2.0, 0.0])]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert [(r.subject, r.id, r.kp_id, r.event) for r in events.assign_emergent(frame).orderBy("id").collect()] == [("s", 1, "kp_emb_1", "created"), (None, 5, "kp_emb_5", "created"), ("s", 6, "kp_emb_1", "assigned")]
    assert events.assign_emergent(frame.limit(0)).count() == 0


@pytest.mark.parametrize("n", [3, 4, 7, 300, 700])
def test_thresholds_from_bins(n):
    """The bounds hold the threshold, and the selected one is that of all pairs; equal and opposite vectors too."""
    draw = np.random.default_rng(n)
    for vectors in (draw.normal(size=(n, 4)), np.repeat(draw.normal(size=(2, 4)), n, axis=0)[:n], np.array([[1.0, 0], [-1.0, 0]] * n)[:n]):
        now = points.Points(floor=-2.0)
        now.give("p", vectors[0], True)
        for v in vectors:
            now.add_member("p", v)
        p = now.points["p"]
        expected = brute_threshold(list(vectors), -9.0, 1.0)
        assert abs(now.threshold(p) - expected) < 1e-12
        assert now.reaches(p, expected + 1e-7) and not now.reaches(p, expected - 1e-7)
        assert p.bounds[0] <= expected + 1e-12 and expected - 1e-12 <= p.bounds[1] and p.counts.sum() == n * (n - 1) // 2
