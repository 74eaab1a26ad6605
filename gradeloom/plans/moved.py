"""Self-organising topics and streams."""

from pyspark.sql import functions as F

from gradeloom.operators import topics as top
from gradeloom.operators import vectors as vec
from gradeloom.plans import query
from gradeloom.plans.linked import uses
from gradeloom.session import scratch_path, stored
from gradeloom.streaming import events

_SETS = """own AS (SELECT DISTINCT fragment_id, helped_qa_id FROM fx_help), helps AS (SELECT DISTINCT topic_id, helped_qa_id FROM fx_membership JOIN fx_help USING (fragment_id)),
over AS (SELECT fragment_id, topic_id, count(*) AS common FROM own JOIN helps USING (helped_qa_id) GROUP BY 1, 2),
f AS (SELECT fragment_id, count(*) AS f FROM own GROUP BY 1), h AS (SELECT topic_id, count(*) AS t FROM helps GROUP BY 1),
aff AS (SELECT fragment_id, topic_id, common / CAST(least(f, t) AS DOUBLE) AS affinity, common / CAST(f AS DOUBLE) AS share FROM over JOIN f USING (fragment_id) JOIN h USING (topic_id)),
loy AS (SELECT m.fragment_id, m.topic_id, coalesce(share, 0.5) AS loyalty FROM fx_membership m LEFT JOIN aff ON aff.fragment_id = m.fragment_id AND aff.topic_id = m.topic_id)"""
_QUALITY = "CASE hash WHEN 0 THEN 'dissolved' WHEN 1 THEN 'embryonic' ELSE 'forming' END"
_TOPICS = f"tp AS (SELECT topic_id, {_QUALITY} AS quality FROM (SELECT topic_id, CAST(right(topic_id, 1) AS INT) % 3 AS hash FROM fx_membership GROUP BY topic_id))"


def _topics(t):
    k = F.expr("cast(right(topic_id, 1) as int) % 3")
    return t("fx_membership").select("topic_id").distinct().withColumn("quality", F.when(k == 0, "dissolved").when(k == 1, "embryonic").otherwise("forming")).withColumn("cohesion", F.lit(0.5))


@query("""WITH u AS (SELECT DISTINCT l_orderkey AS qa_id, l_partkey + 1 AS ref FROM lineitem WHERE l_returnflag = 'R'), h AS (
  SELECT point_id AS fragment_id, u.qa_id AS helped_qa_id, max(round_even(CASE WHEN covered_count + missed_count > 0 THEN covered_count / CAST(covered_count + missed_count AS DOUBLE) ELSE 0.0 END, 3)) AS help_effect
  FROM u JOIN fx_feedback f ON f.qa_id = u.qa_id JOIN fx_fragments x ON x.qa_id = u.ref GROUP BY 1, 2)
SELECT *, CASE WHEN help_effect >= 0.7 THEN 'direct' WHEN help_effect >= 0.3 THEN 'understanding' ELSE 'none' END AS help_level FROM h""")
def o1_record_help(t):
    grades = t("fx_feedback").select("qa_id", F.col("covered_count").alias("covered"), F.col("missed_count").alias("missed"))
    return top.record_help(uses(t), grades, t("fx_fragments"))


@query(f"WITH {_SETS} SELECT fragment_id, topic_id, loyalty FROM loy")
def o2_loyalty(t):
    return top.loyalty(t("fx_help"), t("fx_membership"))


@query(f"WITH {_SETS} SELECT fragment_id, topic_id, affinity FROM aff")
def o3_affinity(t):
    return top.affinity(t("fx_help"), t("fx_membership"))


@query("SELECT fragment_id, round_even(0.15 * CASE WHEN count(*) < 10 THEN 2.0 WHEN count(*) < 30 THEN 1.5 WHEN count(*) < 50 THEN 1.0 ELSE 0.7 END, 6) AS threshold FROM fx_help GROUP BY 1")
def o4_migration_threshold(t):
    rows = t("fx_help").groupBy("fragment_id").agg(F.count("*").alias("n"))
    return rows.select("fragment_id", F.bround(top.migration_threshold(F.col("n") * 10), 6).alias("threshold"))


@query(f"""WITH {_SETS}, {_TOPICS}, n AS (SELECT 0.15 * CASE WHEN count(*) < 100 THEN 2.0 WHEN count(*) < 300 THEN 1.5 WHEN count(*) < 500 THEN 1.0 ELSE 0.7 END AS th FROM fx_help),
best AS (SELECT fragment_id, l.topic_id AS src, any_value(loyalty) AS loyalty, max((affinity, a.topic_id)) AS b FROM loy l JOIN aff a USING (fragment_id) JOIN tp ON tp.topic_id = a.topic_id AND quality <> 'dissolved' WHERE l.topic_id <> a.topic_id GROUP BY 1, 2),
mv AS (SELECT fragment_id, src, b[2] AS dst FROM best, n WHERE b[1] - loyalty > th), mass AS (SELECT topic_id AS src, count(*) AS mass FROM fx_membership GROUP BY 1)
SELECT fragment_id, src, dst FROM (SELECT *, count(*) OVER (PARTITION BY src, dst) AS agree FROM mv JOIN mass USING (src)) WHERE agree >= CASE WHEN mass < 5 THEN 2 ELSE 3 END""")
def o5_migrations(t):
    return top.migrations(t("fx_help"), t("fx_membership"), _topics(t))


@query(f"""WITH {_SETS}, {_TOPICS}, s AS (SELECT m.topic_id, count(*) AS mass, avg(loyalty) AS mean, count(*) FILTER (previous_topic_id IS NOT NULL AND previous_topic_id <> m.topic_id) AS churn FROM fx_membership m JOIN loy ON loy.fragment_id = m.fragment_id AND loy.topic_id = m.topic_id GROUP BY 1),
x AS (SELECT tp.topic_id, quality, mass, CASE WHEN mass < 2 THEN 1.0 ELSE mean END AS cohesion, 1 - churn / CAST(mass AS DOUBLE) AS stability FROM tp JOIN s USING (topic_id))
SELECT topic_id, mass, round_even(cohesion, 6) AS cohesion, round_even(stability, 6) AS stability, CASE WHEN quality = 'embryonic' AND stability >= 0.8 AND mass >= 4 THEN 'forming' WHEN stability < 0.3 AND mass < 3 THEN 'dissolved' ELSE quality END AS quality FROM x""")
def o6_topic_stats(t):
    rows = top.topic_stats(t("fx_membership"), t("fx_help"), _topics(t))
    return rows.select("topic_id", "mass", F.bround("cohesion", 6).alias("cohesion"), F.bround("stability", 6).alias("stability"), "quality")


def _cliques(part, shared=False):
    """Twenty topics of about twenty fragments for each 400 parts. The fragments of a topic help in two separate camps, so that a split
    shows; with ``shared``, four topics help nearly the same questions, each shifted a little."""
    no = F.floor(F.col("p_partkey") / 400) * 20 + F.col("p_partkey") % 20
    parts = part.select(F.format_string("f_%04d", "p_partkey").alias("fragment_id"), no.alias("no"), (F.floor(F.col("p_partkey") / 20) % 2 * 100).alias("camp"))
    parts = parts.withColumn("topic_id", F.format_string("topic_%04d", "no"))
    members = parts.select("fragment_id", "topic_id", F.lit(None).cast("string").alias("previous_topic_id"))
    base = F.floor(F.col("no") / 4) * 1000 + F.col("no") % 3 if shared else F.col("no") * 1000
    help_map = parts.select("fragment_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"), "camp", base.alias("base")).select("fragment_id", (F.col("base") + F.col("camp") + F.col("k")).alias("helped_qa_id"), F.lit(0.8).alias("help_effect"))
    help_map = stored(help_map, "help")
    topics = members.select("topic_id", F.lit("forming").alias("quality"), F.lit(0.5).alias("cohesion")).distinct()
    return help_map, members, topics


_PARTS = "f AS (SELECT printf('f_%04d', p_partkey) AS fragment_id, p_partkey // 400 * 20 + p_partkey % 20 AS no, printf('topic_%04d', p_partkey // 400 * 20 + p_partkey % 20) AS topic_id, p_partkey // 20 % 2 AS camp FROM part)"


@query(f"""WITH {_PARTS}
SELECT fragment_id, topic_id, topic_id || CASE WHEN camp = first_value(camp) OVER (PARTITION BY topic_id ORDER BY fragment_id) THEN '_a' ELSE '_b' END AS part
FROM f QUALIFY least(count(*) FILTER (camp = 0) OVER (PARTITION BY topic_id), count(*) FILTER (camp = 1) OVER (PARTITION BY topic_id)) >= 3""")
def o7_split_topics(t):
    help_map, members, topics = _cliques(t("part"))
    return top.split_topics(members, help_map, topics)


@query(f"""WITH RECURSIVE {_PARTS}, h AS (SELECT fragment_id, topic_id, no // 4 * 1000 + no % 3 + camp * 100 + unnest([1, 2, 3, 4]) AS q FROM f),
helps AS (SELECT DISTINCT topic_id, q FROM h), n AS (SELECT topic_id, count(*) AS n FROM helps GROUP BY 1), size AS (SELECT topic_id, count(*) AS m FROM f GROUP BY 1), own AS (SELECT fragment_id, any_value(topic_id) AS topic_id, count(*) AS own FROM h GROUP BY 1),
both_ AS (SELECT a.topic_id AS a, b.topic_id AS b, count(*) AS common FROM helps a JOIN helps b ON a.q = b.q AND a.topic_id < b.topic_id GROUP BY 1, 2),
near AS (SELECT a, b FROM both_ JOIN n x ON x.topic_id = a JOIN n y ON y.topic_id = b WHERE common >= 0.5 * (x.n + y.n - common)),
aff AS (SELECT fragment_id, h.topic_id, t.topic_id AS other, count(*) AS common FROM h JOIN helps t USING (q) GROUP BY 1, 2, 3),
mean AS (SELECT aff.topic_id, other, sum(common / CAST(least(own, n) AS DOUBLE)) / any_value(m) AS mean FROM aff JOIN own USING (fragment_id) JOIN n ON n.topic_id = other JOIN size ON size.topic_id = aff.topic_id GROUP BY 1, 2),
pairs AS (SELECT a, b, row_number() OVER (ORDER BY a, b) AS nth FROM near JOIN mean x ON x.topic_id = a AND x.other = b JOIN mean y ON y.topic_id = b AND y.other = a WHERE (x.mean + y.mean) / 2 >= 0.4),
walk AS (SELECT 0::BIGINT AS nth, CAST([] AS VARCHAR[]) AS used, false AS taken, '' AS a, '' AS b
UNION ALL SELECT p.nth, CASE WHEN ok THEN list_concat(used, [p.a, p.b]) ELSE used END, ok, p.a, p.b FROM (SELECT p.*, used, NOT list_contains(used, p.a) AND NOT list_contains(used, p.b) AS ok FROM walk w JOIN pairs p ON p.nth = w.nth + 1) p)
SELECT a AS topic_a, b AS topic_b, a || '_m' || b AS merged FROM walk WHERE taken""")
def o8_merge_topics(t):
    help_map, members, topics = _cliques(t("part"), shared=True)
    return top.merge_topics(members, help_map, topics)


@query(f"""WITH {_TOPICS}, gone AS (SELECT fragment_id, topic_id AS home FROM fx_membership JOIN tp USING (topic_id) WHERE quality = 'dissolved'),
lv AS (SELECT m.fragment_id, topic_id FROM fx_membership m JOIN tp USING (topic_id) WHERE quality <> 'dissolved'), own AS (SELECT DISTINCT fragment_id, helped_qa_id FROM fx_help), helps AS (SELECT DISTINCT topic_id, helped_qa_id FROM lv JOIN fx_help USING (fragment_id)),
a AS (SELECT fragment_id, topic_id, count(*) AS c FROM own JOIN helps USING (helped_qa_id) GROUP BY 1, 2), f AS (SELECT fragment_id, count(*) AS f FROM own GROUP BY 1), h AS (SELECT topic_id, count(*) AS t FROM helps GROUP BY 1),
b AS (SELECT fragment_id, max((c / CAST(least(f, t) AS DOUBLE), topic_id)) AS x FROM a JOIN f USING (fragment_id) JOIN h USING (topic_id) WHERE c / CAST(least(f, t) AS DOUBLE) > 0.1 GROUP BY 1)
SELECT fragment_id, coalesce(x[2], home) AS topic_id, CASE WHEN x IS NOT NULL THEN 0.3 ELSE 0.0 END AS loyalty FROM gone LEFT JOIN b USING (fragment_id)""")
def o9_redistribute(t):
    return top.redistribute(t("fx_membership"), t("fx_help"), _topics(t))


@query(f"""WITH {_TOPICS}, tc AS (SELECT *, CASE WHEN right(topic_id, 1) < '5' THEN 0.25 END AS cohesion FROM tp)
SELECT fragment_id, round_even(round_even(least(0.6 * 0.5 + 0.3 * avg(help_effect) + 0.1 * coalesce(max(cohesion), 0.5), 1.0), 9), 3) AS centrality_score, count(*) + 1 AS verification_count
FROM fx_help JOIN fx_membership USING (fragment_id) JOIN tc USING (topic_id) WHERE quality <> 'dissolved' GROUP BY 1""")
def o10_update_centrality(t):
    old = t("fx_help").groupBy("fragment_id").agg(F.count("*").alias("verification_count")).withColumn("centrality_score", F.lit(0.5))
    topics = _topics(t).withColumn("cohesion", F.when(F.expr("right(topic_id, 1)") < "5", 0.25))
    return top.update_centrality(old, t("fx_help"), t("fx_membership"), topics)


@query()
def o11_vector_cascade(t):
    members = t("fx_vectors").select(F.col("id").alias("qa_id"), F.concat(F.lit("kp_"), (F.col("id") % 60).cast("string")).alias("kp_id"))
    kps = members.select("kp_id", F.lit("accepted").alias("quality")).distinct()
    of = members.select(F.concat(F.lit("topic_"), (F.col("qa_id") % 6).cast("string")).alias("topic"), "kp_id").distinct()
    return top.vector_cascade(t("fx_vectors"), members, kps, of)[1].select("topic", F.size("vector").alias("width"), F.transform("vector", lambda x: F.bround(x.cast("double"), 4)).alias("vector"))


@query("""WITH c AS (SELECT topic, count(*) AS n FROM fx_confusions GROUP BY topic), d AS (SELECT topic, CASE WHEN length(topic) = 7 THEN 'basic' ELSE 'intermediate' END AS before, n FROM c)
SELECT topic, before, CASE WHEN before = 'basic' THEN 'intermediate' ELSE 'advanced' END AS difficulty, 'student_feedback' AS method FROM d WHERE n >= 10 OR (n >= 5 AND before = 'basic')""")
def o12_apply_confusions(t):
    counts = t("fx_confusions").groupBy("topic").agg(F.count("*").alias("n"))
    return top.apply_confusions(counts.select("topic", F.when(F.length("topic") == 7, "basic").otherwise("intermediate").alias("mode_difficulty")), counts)


@query()
def o13_run_cycle(t):
    return top.run_cycle(t("fx_help"), t("fx_membership"), _topics(t))[0]


@query(f"""WITH {_TOPICS}, r AS (SELECT topic_id, fragment_id, row_number() OVER (PARTITION BY topic_id ORDER BY fragment_id) AS nth FROM fx_membership JOIN tp USING (topic_id) JOIN fx_fragments ON point_id = fragment_id WHERE quality = 'forming')
SELECT topic_id, string_agg('text of ' || fragment_id, '; ' ORDER BY nth) AS texts FROM r WHERE nth <= 20 GROUP BY 1""")
def o14_naming_inputs(t):
    fragments = t("fx_fragments").select("point_id", F.concat(F.lit("text of "), "point_id").alias("point_text"))
    return top.naming_inputs(_topics(t), t("fx_membership"), fragments)


def _stream(t, table):
    return _as_stream(t(table), table)


def _as_stream(rows, label):
    """The rows as a stream of files in the shared folder."""
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def _bus(t):
    return _stream(t, "events").select(F.col("event_type").alias("type"), F.col("props").alias("payload"), "ts", F.col("user_id").alias("source"))


@query("SELECT type, payload, source FROM fx_bus WHERE type IN ('error', 'purchase')")
def t1_subscribe(t):
    return events.run_to_table(events.subscribe(_bus(t), ["error", "purchase"]).select("type", "payload", "source"), t.spark)


@query("SELECT type, count(*) AS n FROM fx_bus GROUP BY type")
def t2_event_stats(t):
    return events.run_to_table(events.event_stats(_bus(t)), t.spark, "update", ["type"])


@query("""WITH n AS (SELECT session_id AS student_id, 'topic_' || (turn % 5) AS topic, count(*) AS c FROM fx_chat WHERE role = 'user' GROUP BY 1, 2)
SELECT coalesce(n.student_id, s.student_id) AS student_id, coalesce(n.topic, s.topic) AS topic, CASE WHEN n.topic IS NOT NULL THEN 'learning' ELSE s.state END AS state, coalesce(s.evidence_count, 0) + coalesce(c, 0) AS evidence_count
FROM fx_states s FULL JOIN n ON n.student_id = s.student_id AND n.topic = s.topic""")
def t3_student_updates(t):
    turns = t("fx_chat").select((F.col("session_id") * 100 + F.col("turn")).alias("query_id"), F.col("session_id").alias("student_id"), "role", "content", F.col("turn").alias("ts"), "turn")
    retrieved = turns.select("query_id", F.concat(F.lit("topic_"), (F.col("turn") % 5).cast("string")).alias("topic"), F.lit(1).alias("nth"))
    return events.student_stream(_as_stream(turns, "turns"), retrieved, t("fx_states"))[0]


@query("""WITH w AS (SELECT topic, unnest(generate_series(date_trunc('day', created_at) + INTERVAL 1 DAY, date_trunc('day', created_at) + INTERVAL 5 DAY, INTERVAL 1 DAY)) AS until FROM fx_confusions)
SELECT until, topic, count(*) AS n FROM w GROUP BY 1, 2""")
def t4_confusion_window(t):
    rows = _stream(t, "events").where("event_type = 'error'").select(F.concat(F.lit("topic_"), (F.col("event_id") % 20).cast("string")).alias("topic"), F.col("ts").alias("created_at"))
    found = events.run_to_table(events.confusion_window(rows, "5 days", "1 day"), t.spark, "update", ["until", "topic"])
    return found.withColumn("until", F.col("until").cast("timestamp_ntz"))


@query()
def t5_assign_in_order(t):
    """Subjects of 250 vectors, a paper's end after every 50 places of the sequence."""
    rows = t("fx_vectors").select(F.concat((F.col("id") % 4).cast("string"), F.lit("_"), F.floor(F.col("id") / 1000).cast("string")).alias("subject"), F.col("id").alias("seq"), "id", "vector")
    papers = rows.groupBy("subject", F.floor(F.col("seq") / 50).alias("paper")).agg(F.max("seq").alias("seq"))
    with events.with_rocksdb(t.spark):
        return events.run_to_table(events.assign_stream(_as_stream(events.arrivals(rows, papers=papers), "vectors"), floor=0.2), t.spark)


@query("""WITH s AS (SELECT b.id AS query_id, a.id, list_dot_product(a.vector::DOUBLE[], b.vector::DOUBLE[]) AS score FROM fx_vectors a JOIN fx_vectors b ON b.id % 100 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM s)
SELECT query_id, id, round_even(score, 5) AS score, nth FROM n WHERE nth <= 15 AND (score >= 0.5 OR nth <= 3)""")
def t6_index_append(t):
    """An index of every second vector takes in all of them from a stream, known ones for the second time; then it is searched."""
    rows = t("fx_vectors").select("id", "vector")
    home = scratch_path(t.spark, "index")
    events.index_stream(rows.where("id % 2 = 0"), _as_stream(rows, "vectors"), home)
    return vec.search_index(home, rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")).withColumn("score", F.bround("score", 5))
