"""Help rows dealt by their number: tasks grow with the table, results as by hand."""

import random

import pytest
from pyspark.sql import functions as F

from gradeloom import session
from gradeloom.operators import joins, topics
from gradeloom.session import local_session


@pytest.fixture(scope="module")
def spark():
    return local_session()


@pytest.fixture
def tables(spark, monkeypatch):
    """Repeated and null rows, fragments of two topics and of none."""
    monkeypatch.setattr(session, "TASK_ROWS", 25)
    rnd = random.Random(3)
    pick = lambda name, n: rnd.choice([None, *(f"{name}{k}" for k in range(n))])
    help_rows = [(pick("f", 30), rnd.choice([None, *range(40)])) for _ in range(400)]
    member_rows = list(dict.fromkeys((pick("f", 30), pick("t", 6)) for _ in range(45)))
    help_map = spark.createDataFrame(help_rows, "fragment_id string, helped_qa_id long")
    return help_rows, member_rows, help_map, spark.createDataFrame(member_rows, "fragment_id string, topic_id string")


def by_hand(help_rows, member_rows):
    own, helps = {}, {}
    for f, q in help_rows:
        own.setdefault(f, set()).add(q)
    for f, t in member_rows:
        if f is not None and f in own:
            helps.setdefault(t, set()).update(own[f])
    shared = {(f, t): len((own[f] & helps[t]) - {None}) for f in own for t in helps if f is not None and t is not None}
    return own, helps, {k: n for k, n in shared.items() if n}


def test_topic_helps_over_counted_tasks(spark, tables):
    help_rows, member_rows, help_map, members = tables
    found = joins.topic_helps(members, help_map)
    assert found.rdd.getNumPartitions() == 400 / 25  # 8 before, whatever the rows
    rows = [tuple(r) for r in found.collect()]
    assert len(set(rows)) == len(rows) and set(rows) == {(t, q) for t, qs in by_hand(help_rows, member_rows)[1].items() for q in qs}


def test_affinity_and_loyalty_over_counted_tasks(spark, tables):
    help_rows, member_rows, help_map, members = tables
    own, helps, shared = by_hand(help_rows, member_rows)
    found = topics.loyalty(help_map, members)
    assert found.rdd.getNumPartitions() == 400 / 25
    wanted = sorted((str(f), str(t), shared[f, t] / len(own[f]) if (f, t) in shared else 0.5) for f, t in member_rows)
    assert sorted((str(r.fragment_id), str(r.topic_id), r.loyalty) for r in found.collect()) == wanted
    affinity = {(r.fragment_id, r.topic_id): r.affinity for r in topics.affinity(help_map, members).collect()}
    assert affinity == {(f, t): n / min(len(own[f]), len(helps[t])) for (f, t), n in shared.items()}


def test_moves_and_dealing_out(spark, tables):
    help_rows, member_rows, help_map, members = tables
    own, helps, shared = by_hand(help_rows, member_rows)
    about = spark.createDataFrame([(f"t{k}", ("dissolved", "stable", "forming")[k % 3]) for k in range(6)], "topic_id string, quality string")
    near = lambda f, closed: max(((n / min(len(own[f]), len(helps[t])), t) for (g, t), n in shared.items() if g == f and t not in closed), default=None)
    dealt = {(f, (b[1] if (b := near(f, {"t0", "t3"})) and b[0] > 0.1 else t)) for f, t in member_rows if t in ("t0", "t3")}
    assert {(r.fragment_id, r.topic_id) for r in topics.redistribute(members, help_map, about).collect()} == dealt
    wanted, mass = {}, {}
    for f, t in member_rows:
        mass[t] = mass.get(t, 0) + 1
        best = near(f, {"t0", "t3", t}) if t is not None else None
        if best and best[0] - (shared[f, t] / len(own[f]) if (f, t) in shared else 0.5) > 0.15:
            wanted.setdefault((t, best[1]), set()).add((f, t, best[1]))
    kept = {m for (t, _), ms in wanted.items() if len(ms) >= (2 if mass[t] < 5 else 3) for m in ms}
    assert {tuple(r) for r in topics.migrations(help_map, members, about).collect()} == kept


def test_cycle_writes_help_once(spark, tables, monkeypatch):
    _, _, help_map, members = tables
    labels, stored = [], topics.stored
    monkeypatch.setattr(topics, "stored", lambda df, label: labels.append(label) or stored(df, label))
    members = members.withColumn("previous_topic_id", F.lit(None).cast("string"))
    about = members.select("topic_id").where("topic_id is not null").distinct().withColumn("quality", F.lit("forming"))
    topics.run_cycle(help_map, members, about)
    assert (labels.count("help"), labels.count("overlaps")) == (1, 2)
