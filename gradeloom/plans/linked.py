"""Joins and graph operators."""

from pyspark.sql import functions as F

from gradeloom.operators import graph, joins, windows
from gradeloom.plans import query
from gradeloom.plans.measured import _KPS, points

_FRAGMENTS = "frag AS (SELECT point_id AS fragment_id, qa_id FROM fx_fragments)"
_HELPED = f"{_FRAGMENTS}, src AS (SELECT DISTINCT qa_id FROM fx_fragments WHERE qa_id % 10 = 0), helped AS (SELECT DISTINCT frag.qa_id, helped_qa_id FROM frag JOIN src USING (qa_id) JOIN fx_help USING (fragment_id))"
_ADJACENT = "adjacent AS (SELECT src_topic AS topic, dst_topic AS adjacent FROM fx_links UNION SELECT dst_topic, src_topic FROM fx_links)"
_TOPIC_KPS = "tk AS (SELECT DISTINCT topic, kp_id FROM fx_members JOIN fx_qa ON qa_id = id)"
_DEPS = "deps AS (SELECT DISTINCT 'topic_' || (event_id % 19 + 1) AS dependent, 'topic_' || (event_id % 7) AS prerequisite FROM events WHERE event_id % 19 + 1 > event_id % 7)"


def _sources(t):
    return t("fx_fragments").where("qa_id % 10 = 0").select("qa_id").distinct()


def _deps(t):
    """Topic dependencies by a fixed rule: numbered topics, lower before higher."""
    rows = t("events").where("event_id % 19 + 1 > event_id % 7")
    return rows.selectExpr("concat('topic_', event_id % 19 + 1) as dependent", "concat('topic_', event_id % 7) as prerequisite").distinct()


@query("SELECT kp_id, qa_id, membership_strength, topic, question_text FROM fx_members JOIN fx_qa ON qa_id = id")
def j1_kp_qas(t):
    return joins.kp_qas(t("fx_members"), t("fx_qa"))


@query("""WITH r AS (SELECT kp_id, qa_id, membership_strength, qa_id % 40 = 0 AND kp_id < 'kp_0025' AS rep FROM fx_members JOIN fx_qa ON qa_id = id), k AS (SELECT *, bool_or(rep) OVER (PARTITION BY kp_id) AS has_rep FROM r)
SELECT kp_id, qa_id, membership_strength, row_number() OVER (PARTITION BY kp_id ORDER BY membership_strength DESC, qa_id) AS nth FROM k WHERE NOT has_rep OR rep QUALIFY nth <= 3""")
def j2_kp_representatives(t):
    members = t("fx_members").withColumn("is_representative", (F.col("qa_id") % 40 == 0) & (F.col("kp_id") < "kp_0025"))
    return joins.kp_representatives(members, t("fx_qa"))


@query(f"WITH {_HELPED} SELECT DISTINCT h.qa_id, o.qa_id AS other_qa_id FROM helped h JOIN fx_help x USING (helped_qa_id) JOIN frag o ON o.fragment_id = x.fragment_id WHERE o.qa_id <> h.qa_id")
def j3_second_order(t):
    return joins.second_order(t("fx_fragments"), t("fx_help"), _sources(t))


@query(f"WITH {_HELPED} SELECT qa_id, helped_qa_id FROM helped")
def j4_helped_by(t):
    return joins.helped_by(t("fx_fragments"), t("fx_help"), _sources(t))


@query(f"""WITH {_HELPED} SELECT frag.qa_id, CAST(least(count(*) / 10.0, 1.0) AS DOUBLE) AS score FROM frag JOIN fx_help USING (fragment_id)
WHERE frag.qa_id % 3 = 0 AND helped_qa_id IN (SELECT helped_qa_id FROM helped) GROUP BY 1""")
def j5_behavior_scores(t):
    helped = joins.helped_by(t("fx_fragments"), t("fx_help"), _sources(t))
    return joins.behavior_scores(t("fx_fragments"), t("fx_help"), t("fx_fragments").where("qa_id % 3 = 0"), helped)


@query(f"WITH {_ADJACENT} SELECT * FROM adjacent")
def j6_adjacent_topics(t):
    return joins.adjacent_topics(t("fx_links"))


@query(f"WITH {_ADJACENT} SELECT n_name AS topic FROM nation WHERE n_name IN (SELECT adjacent FROM adjacent WHERE topic = 'CHINA')")
def j7_linked_mask(t):
    return joins.linked_mask(t("fx_links"), "CHINA", t("nation").select(F.col("n_name").alias("topic")))


@query("SELECT DISTINCT topic_id, helped_qa_id FROM fx_membership JOIN fx_help USING (fragment_id)")
def j8_topic_helps(t):
    return joins.topic_helps(t("fx_membership"), t("fx_help"))


@query("SELECT fragment_id, topic_id, count(*) AS verification_count FROM fx_help JOIN fx_membership USING (fragment_id) GROUP BY 1, 2")
def j9_topic_centralities(t):
    return joins.topic_centralities(t("fx_help").groupBy("fragment_id").agg(F.count("*").alias("verification_count")), t("fx_membership"))


@query(f"WITH {_TOPIC_KPS} SELECT * FROM tk")
def j10_topic_kps(t):
    return joins.topic_kps(t("fx_qa"), t("fx_members"))


@query(f"""WITH {_KPS}, {_TOPIC_KPS} SELECT kp_id, evidence_count, CASE WHEN quality = 'accepted' AND kp_id IN (SELECT kp_id FROM tk WHERE topic = 'CHINA') THEN 'verified' ELSE quality END AS quality FROM kps""")
def j11_promote_mastered(t):
    china = t("nation").where("n_name = 'CHINA'").select(F.col("n_name").alias("topic"))
    return joins.promote_mastered(points(t), t("fx_members"), t("fx_qa"), china)


@query(f"""WITH {_DEPS} SELECT DISTINCT s.student_id, s.topic, prerequisite FROM fx_states s JOIN deps ON dependent = s.topic
WHERE NOT EXISTS (SELECT 1 FROM fx_states m WHERE m.state = 'mastered' AND m.student_id = s.student_id AND m.topic = prerequisite)""")
def j12_missing_prereqs(t):
    return joins.missing_prereqs(_deps(t), t("fx_states"), t("fx_states").select("student_id", "topic"))


@query("""SELECT id, student_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY created_at DESC, id DESC) AS nth FROM fx_confusions)
WHERE nth <= 10 AND NOT resolved AND topic IN ('topic_1', 'topic_2', 'topic_3')""")
def j13_open_confusions(t):
    topics = t("fx_confusions").where("topic in ('topic_1', 'topic_2', 'topic_3')").select("topic")
    return joins.open_confusions(t("fx_confusions"), topics).select("id", "student_id", "topic")


@query("""WITH s AS (SELECT n_name AS topic, 'about ' || n_name AS text, CAST(n_nationkey AS DOUBLE) AS mass, 'topic' AS kind FROM nation WHERE n_regionkey < 2)
SELECT * FROM s UNION ALL (SELECT topic, question_text, NULL, 'question' FROM fx_qa WHERE topic NOT IN (SELECT topic FROM s)
QUALIFY row_number() OVER (PARTITION BY topic ORDER BY success_count DESC, id) = 1)""")
def j14_kp_catalog(t):
    topics = t("nation").select(F.col("n_name").alias("name"), F.concat(F.lit("about "), "n_name").alias("kp_concept"), F.col("n_nationkey").cast("double").alias("mass"), F.when(F.col("n_regionkey") < 2, "stable").otherwise("forming").alias("quality"))
    return joins.kp_catalog(topics, t("fx_qa").withColumn("is_representative", F.lit(False)))


@query(f"""WITH {_DEPS}, b AS (SELECT dependent, string_agg(prerequisite, ', ' ORDER BY prerequisite) AS before FROM deps GROUP BY 1),
o AS (SELECT student_id, topic, count(*) AS open FROM fx_confusions WHERE NOT resolved GROUP BY 1, 2), w AS (SELECT *, CASE student_id % 3 WHEN 0 THEN 'building' WHEN 1 THEN 'machinery' ELSE 'none' END AS verb FROM fx_states),
p AS (SELECT command_verb AS verb, 'seen ' || count(*) || ' times' AS pattern_summary FROM fx_qa WHERE command_verb <> 'machinery' GROUP BY 1)
SELECT s.student_id, s.topic, concat_ws('; ', CASE WHEN s.topic < 'topic_15' THEN 'difficulty: basic' END, 'answer style for ''' || p.verb || ''' questions: ' || pattern_summary, 'needs: ' || before, 'open confusions: ' || open) AS hint
FROM w s LEFT JOIN p ON p.verb = s.verb LEFT JOIN b ON dependent = s.topic LEFT JOIN o ON o.student_id = s.student_id AND o.topic = s.topic""")
def j15_analysis_hints(t):
    difficulty = t("fx_states").where("topic < 'topic_15'").select("topic", F.lit("basic").alias("mode_difficulty")).distinct()
    k = F.col("student_id") % 3
    wanted = t("fx_states").select("student_id", "topic", F.when(k == 0, "building").when(k == 1, "machinery").otherwise("none").alias("verb"))
    seen = t("fx_qa").groupBy(F.col("command_verb").alias("verb")).agg(F.count("*").alias("n"))
    summary = F.when(F.col("verb") == "machinery", "").otherwise(F.concat(F.lit("seen "), F.col("n").cast("string"), F.lit(" times")))
    return joins.analysis_hints(wanted, difficulty, _deps(t), t("fx_confusions"), seen.select("verb", summary.alias("pattern_summary")))


def _export(t):
    topics = _deps(t).select(F.col("dependent").alias("name")).distinct().select(
        "name", F.when(F.length("name") == 8, "stable").otherwise("embryonic").alias("quality"), F.length("name").alias("mass"), F.lit("root").alias("parent"),
        F.array(F.concat("name", F.lit("_a")), F.concat("name", F.lit("_b"))).alias("children"), F.array().cast("array<string>").alias("merged_from"))
    difficulty = t("fx_states").select("topic", F.lit("basic").alias("mode_difficulty")).distinct()
    return joins.graph_export(_deps(t), difficulty, topics)


@query(f"""WITH {_DEPS}, t AS (SELECT DISTINCT dependent AS name FROM deps) SELECT prerequisite AS source, dependent AS target, 'prerequisite' AS type FROM deps
UNION SELECT 'root', name, 'parent_of' FROM t UNION SELECT name, name || '_a', 'split_into' FROM t UNION SELECT name, name || '_b', 'split_into' FROM t""")
def j16_graph_edges(t):
    return _export(t)[1]


@query(f"""WITH {_DEPS}, n AS (SELECT prerequisite AS topic FROM deps UNION SELECT dependent FROM deps UNION SELECT topic FROM fx_states), t AS (SELECT DISTINCT dependent AS name FROM deps)
SELECT n.topic, CASE WHEN n.topic IN (SELECT topic FROM fx_states) THEN 'basic' END AS mode_difficulty, CASE WHEN length(name) = 8 THEN 'stable' WHEN name IS NOT NULL THEN 'embryonic' END AS quality, length(name) AS mass FROM n LEFT JOIN t ON n.topic = name""")
def j16_graph_nodes(t):
    return _export(t)[0]


@query(f"""WITH {_DEPS}, n AS (SELECT prerequisite AS topic FROM deps UNION SELECT dependent FROM deps)
SELECT topic, coalesce((SELECT string_agg(prerequisite, ',' ORDER BY prerequisite) FROM deps WHERE dependent = topic), '') AS prerequisites,
  coalesce((SELECT string_agg(dependent, ',' ORDER BY dependent) FROM deps WHERE prerequisite = topic), '') AS dependents FROM n""")
def j17_dependency_graph(t):
    return joins.dependency_graph(_deps(t)).select("topic", *(F.array_join(c, ",").alias(c) for c in ("prerequisites", "dependents")))


@query("""SELECT n_name AS kp_id, coalesce((SELECT string_agg(src_topic, ',' ORDER BY src_topic) FROM fx_links WHERE dst_topic = n_name AND count % 2 = 0), '') AS prerequisites,
  coalesce((SELECT string_agg(dst_topic, ',' ORDER BY dst_topic) FROM fx_links WHERE src_topic = n_name AND count % 2 = 0), '') AS dependents FROM nation""")
def j18_kp_graph(t):
    edges = t("fx_links").select(F.col("src_topic").alias("source"), F.col("dst_topic").alias("target"), F.when(F.col("count") % 2 == 0, "prerequisite").otherwise("related").alias("type"))
    found = joins.kp_graph(edges, t("nation").select(F.col("n_name").alias("kp_id")))
    return found.select("kp_id", *(F.array_join(c, ",").alias(c) for c in ("prerequisites", "dependents")))


@query("SELECT id % 25 AS query_id, row_number() OVER (PARTITION BY id % 25 ORDER BY id * 7 % 101 DESC, id) AS nth, id, topic, substr(question_text, 1, 200) AS text, id * 7 % 101 AS score FROM fx_qa QUALIFY nth <= 5")
def j19_retrieval_sources(t):
    results = t("fx_qa").select((F.col("id") % 25).alias("query_id"), "id", (F.col("id") * 7 % 101).alias("score"))
    return joins.retrieval_sources(results, t("fx_qa"))


_USES = "uses AS (SELECT l_orderkey AS qa_id, l_partkey + 1 AS ref_qa_id, l_returnflag = 'R' AS used FROM lineitem)"


def uses(t):
    return t("lineitem").select(F.col("l_orderkey").alias("qa_id"), (F.col("l_partkey") + 1).alias("ref_qa_id"), (F.col("l_returnflag") == "R").alias("used"))


@query(f"WITH {_USES} SELECT a.topic AS src_topic, b.topic AS dst_topic, count(*) AS count FROM uses JOIN fx_qa a ON a.id = qa_id JOIN fx_qa b ON b.id = ref_qa_id WHERE used AND a.topic <> b.topic GROUP BY 1, 2")
def g1_cross_topic_links(t):
    return graph.cross_topic_links(uses(t), t("fx_qa"))


@query(f"""WITH {_TOPIC_KPS}
SELECT a.kp_id AS source, b.kp_id AS target, CAST(max(count) AS DOUBLE) AS weight, 'prerequisite' AS type, CASE WHEN max(count) >= 12 THEN 'medium' ELSE 'low' END AS confidence
FROM fx_links JOIN tk a ON a.topic = dst_topic JOIN tk b ON b.topic = src_topic WHERE count >= 2 AND a.kp_id <> b.kp_id GROUP BY 1, 2""")
def g2_retrieval_edges(t):
    return graph.retrieval_edges(t("fx_links"), joins.topic_kps(t("fx_qa"), t("fx_members")), medium=12)


@query("""WITH r AS (SELECT paper, kp_id, lag(kp_id) OVER (PARTITION BY paper ORDER BY CAST(regexp_extract(question_number, '^(\\d+)', 1) AS INT), regexp_replace(question_number, '^\\d+', ''), id, kp_id) AS source FROM fx_members JOIN fx_qa ON qa_id = id),
tr AS (SELECT source, kp_id AS target, count(*) AS count, count(DISTINCT paper) AS papers FROM r WHERE source <> kp_id GROUP BY 1, 2)
SELECT source, target, CAST(least(count / 10.0, 1.0) AS DOUBLE) AS weight, CASE WHEN papers >= 5 THEN 'high' ELSE 'medium' END AS confidence FROM tr WHERE papers >= 3""")
def g3_sequential_edges(t):
    return graph.sequential_edges(windows.sequential_transitions(t("fx_qa"), t("fx_members")))


_LEARN = """r AS (SELECT student_id, kp_id, lag(kp_id) OVER (PARTITION BY student_id ORDER BY recorded_at, id) AS source FROM fx_trajectory),
tr AS (SELECT source, kp_id AS target, count(*) AS count, count(DISTINCT student_id) AS students FROM r WHERE source <> kp_id GROUP BY 1, 2)"""


@query(f"WITH {_LEARN} SELECT source, target, CAST(least(count / 10.0, 1.0) AS DOUBLE) AS weight, CASE WHEN students >= 5 THEN 'high' ELSE 'medium' END AS confidence FROM tr WHERE students >= 3")
def g4_learning_edges(t):
    return graph.learning_edges(windows.learning_transitions(t("fx_trajectory")))


_EDGES = """edges AS (SELECT src_topic AS source, dst_topic AS target, CASE WHEN count % 3 = 0 THEN 'prerequisite' ELSE 'related' END AS type, CASE WHEN count % 2 = 0 THEN CAST(count AS DOUBLE) END AS retrieval, CASE WHEN count % 3 = 0 THEN 0.5 END AS semantic, CASE WHEN count % 5 = 0 THEN 0.3 END AS sequential, NULL AS learning FROM fx_links),
f AS (SELECT source, target, coalesce(max(retrieval), 0.0) AS r, CAST(coalesce(max(semantic), 0.0) AS DOUBLE) AS s, CAST(coalesce(max(sequential), 0.0) AS DOUBLE) AS q, max(type = 'prerequisite') AS pre FROM edges GROUP BY 1, 2)"""


@query(f"""WITH {_EDGES} SELECT source, target, r AS retrieval, s AS semantic, q AS sequential, CAST(0.0 AS DOUBLE) AS learning, round_even(0.4 * r + 0.3 * s + 0.15 * q, 3) AS combined_strength,
  CASE WHEN r > 0 AND (s > 0 OR q > 0) THEN 'high' WHEN r > 0 OR s > 0 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN pre THEN 'prerequisite' ELSE 'related' END AS type FROM f""")
def g5_fuse_edges(t):
    n = F.col("count")
    edges = t("fx_links").select(F.col("src_topic").alias("source"), F.col("dst_topic").alias("target"), F.when(n % 3 == 0, "prerequisite").otherwise("related").alias("type"), F.when(n % 2 == 0, n.cast("double")).alias("retrieval"),
                                 F.when(n % 3 == 0, 0.5).alias("semantic"), F.when(n % 5 == 0, 0.3).alias("sequential"), F.lit(None).cast("double").alias("learning"))
    return graph.fuse_edges(edges)


@query(f"""WITH RECURSIVE {_DEPS}, walk AS (SELECT DISTINCT dependent AS topic, prerequisite, 1 AS depth FROM deps UNION SELECT w.topic, d.prerequisite, depth + 1 FROM walk w JOIN deps d ON d.dependent = w.prerequisite WHERE depth < 5)
SELECT topic, prerequisite, min(depth) AS depth FROM walk WHERE topic <> prerequisite GROUP BY 1, 2""")
def g6_transitive_prereqs(t):
    return graph.transitive_prereqs(_deps(t), _deps(t).select(F.col("dependent").alias("topic")))


_CANDIDATES = """pair AS (SELECT a.src_topic, a.dst_topic, a.count AS count, coalesce(b.count, 0) AS reverse FROM fx_links a LEFT JOIN fx_links b ON b.src_topic = a.dst_topic AND b.dst_topic = a.src_topic),
cand AS (SELECT src_topic AS prerequisite, dst_topic AS dependent, least(count, reverse) AS link_count, 'symmetric' AS origin FROM pair WHERE count >= 2 AND reverse >= 2 AND abs(count - reverse) <= 0.5 * greatest(count, reverse)
UNION ALL SELECT dst_topic, src_topic, count, 'directed' FROM pair WHERE count >= 2 AND count > 3 * reverse AND NOT (reverse >= 2 AND abs(count - reverse) <= 0.5 * greatest(count, reverse))
UNION ALL SELECT n_name, r_name, 0, 'vector' FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, n_name, 0, 'vector' FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _candidates(t):
    """A nation lies near its region, which no link names."""
    near = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))
    return graph.dependency_candidates(t("fx_links"), near, t("nation").select(F.col("n_name").alias("topic"), F.lit("x").alias("text")))


@query(f"WITH {_CANDIDATES} SELECT * FROM cand")
def g7_dependency_candidates(t):
    return _candidates(t)


@query(f"""WITH {_CANDIDATES}, s AS (SELECT *, (length(prerequisite) + length(dependent)) % 3 AS score FROM cand)
SELECT prerequisite, dependent, link_count, score, CASE WHEN score = 2 AND link_count >= 4 THEN 'high' WHEN (score = 2 AND link_count >= 2) OR origin = 'symmetric' THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN origin = 'symmetric' THEN 'corequisite' ELSE 'prerequisite' END AS type FROM s WHERE score >= 1""")
def g8_score_dependencies(t):
    found = _candidates(t)
    judged = found.select("prerequisite", "dependent", ((F.length("prerequisite") + F.length("dependent")) % 3).alias("score")).distinct()
    return graph.score_dependencies(found, judged)


@query("""WITH r AS (SELECT 'topic_' || (event_id % 20) AS prerequisite, event_type AS dependent, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM events)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY prerequisite, dependent ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, CASE confidence WHEN 'medium' THEN -seq ELSE seq END DESC) = 1""")
def g9_dedup_dependencies(t):
    confidence = F.when(F.col("event_id") % 5 == 0, "high").when(F.col("event_id") % 5 == 1, "medium").otherwise("low")
    return graph.dedup_dependencies(t("events").select(F.concat(F.lit("topic_"), (F.col("event_id") % 20).cast("string")).alias("prerequisite"), F.col("event_type").alias("dependent"), F.col("event_id").alias("seq"), confidence.alias("confidence")))


@query(f"""WITH RECURSIVE {_DEPS}, walk AS (SELECT d.prerequisite AS a, d.dependent AS b, e.dependent AS node FROM deps d JOIN deps e ON e.prerequisite = d.prerequisite AND e.dependent NOT IN (d.dependent, d.prerequisite)
UNION SELECT w.a, w.b, e.dependent FROM walk w JOIN deps e ON e.prerequisite = w.node WHERE w.node <> w.b AND e.dependent <> w.a)
SELECT prerequisite, dependent FROM deps WHERE NOT EXISTS (SELECT 1 FROM walk WHERE a = prerequisite AND b = dependent AND node = dependent)""")
def g10_transitive_reduction(t):
    return graph.transitive_reduction(_deps(t))


@query("""SELECT src_topic AS prerequisite, dst_topic AS dependent, CASE WHEN EXISTS (SELECT 1 FROM fx_links b WHERE b.src_topic = a.dst_topic AND b.dst_topic = a.src_topic AND b.count % 2 = 0) THEN 'corequisite' ELSE 'prerequisite' END AS type FROM fx_links a WHERE count % 2 = 0""")
def g11_mark_corequisites(t):
    links = t("fx_links").select(F.col("src_topic").alias("prerequisite"), F.col("dst_topic").alias("dependent"), "count")
    return graph.mark_corequisites(links.drop("count"), links.where("count % 2 = 0").drop("count"))


_MERGE = f"""{_KPS}, ranked AS (SELECT *, CASE quality WHEN 'verified' THEN 4 WHEN 'accepted' THEN 3 WHEN 'draft' THEN 2 ELSE 1 END AS rank FROM kps),
pairs AS (SELECT a.kp_id AS x, b.kp_id AS y, (a.evidence_count, a.rank) > (b.evidence_count, b.rank) AS first FROM ranked a JOIN ranked b ON CAST(substr(a.kp_id, 4) AS INT) % 2 = 1 AND CAST(substr(b.kp_id, 4) AS INT) = CAST(substr(a.kp_id, 4) AS INT) + 1 WHERE (a.evidence_count, a.rank) <> (b.evidence_count, b.rank)),
plan AS (SELECT CASE WHEN first THEN y ELSE x END AS old, CASE WHEN first THEN x ELSE y END AS new FROM pairs)"""


def _merged(t):
    kps = points(t)
    number = F.substring("kp_id", 4, 10).cast("int")
    issues = kps.where(number % 2 == 1).select(F.col("kp_id").alias("kp_a"), F.concat(F.lit("kp_"), F.lpad((number + 1).cast("string"), 4, "0")).alias("kp_b"), F.lit("merge").alias("action"))
    edges = kps.select(F.col("kp_id").alias("source"), F.lit("kp_0001").alias("target"), F.lit("related").alias("type"), F.lit(0.5).alias("combined_strength"))
    return graph.merge_kps(kps, t("fx_members"), edges, issues)


@query(f"WITH {_MERGE} SELECT qa_id, coalesce(new, kp_id) AS kp_id, max(membership_strength) AS membership_strength FROM fx_members LEFT JOIN plan ON old = kp_id GROUP BY 1, 2")
def g12_merge_kps(t):
    return _merged(t)[1]


@query("""SELECT qa_id, CASE WHEN kp_id = 'kp_0007' THEN 'kp_0007s' || (qa_id % 2) ELSE kp_id END AS kp_id, CASE WHEN kp_id = 'kp_0007' THEN 0.8 ELSE membership_strength END AS membership_strength FROM fx_members""")
def g13_split_kps(t):
    members = t("fx_members").where("kp_id = 'kp_0007'")
    judged = members.groupBy("kp_id", (F.col("qa_id") % 2).alias("part")).agg(F.collect_list("qa_id").alias("qa_ids"))
    return graph.split_kps(t("fx_members"), judged)


@query(f"WITH {_KPS}, m AS (SELECT kp_id, count(*) AS members FROM fx_members GROUP BY 1) SELECT kp_id, evidence_count, members FROM kps JOIN m USING (kp_id) WHERE evidence_count >= 6 AND members >= 4")
def g14_split_candidates(t):
    return graph.split_candidates(points(t), t("fx_members"))


@query("""WITH r AS (SELECT event_id // 5 AS kp_id, event_id % 5 AS round, value > 20 AS passed, value > 10 AS changed FROM events),
l AS (SELECT *, coalesce(passed AND lag(passed) OVER (PARTITION BY kp_id ORDER BY round), FALSE) AS twice FROM r)
SELECT kp_id, CASE WHEN bool_or(twice) THEN 'verified' WHEN NOT arg_max(changed, round) THEN 'keep' WHEN count(*) >= 5 THEN 'disputed' ELSE 'accepted' END AS outcome FROM l GROUP BY kp_id""")
def g15_review_outcome(t):
    rows = t("events").select(F.floor(F.col("event_id") / 5).alias("kp_id"), (F.col("event_id") % 5).alias("round"), (F.col("value") > 20).alias("passed"), (F.col("value") > 10).alias("changed"))
    return graph.review_outcome(rows)


