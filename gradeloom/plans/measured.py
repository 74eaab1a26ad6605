"""Aggregations, windows and difficulty over questions, feedback, papers and learners."""

from pyspark.sql import functions as F

from gradeloom.operators import aggregates as agg
from gradeloom.operators import difficulty as dif
from gradeloom.operators import scalars, windows
from gradeloom.plans import query

_MISS = """miss AS (
  SELECT qa_id, CASE WHEN covered_count + missed_count > 0 THEN
    (CASE WHEN knowledge_gap + insufficient_detail + misinterpretation > 0 THEN knowledge_gap + insufficient_detail * 0.5 ELSE missed_count END)
    / CAST(covered_count + missed_count AS DOUBLE) END AS miss_rate FROM fx_feedback)"""
_WEIGHTS = """weights AS (
  SELECT id, topic, (success_count + 1.0) / (total_attempts + 2.0) AS m, CAST(total_attempts + 2.0 AS DOUBLE) AS t, total_attempts, success_count FROM fx_qa
), weighed AS (
  SELECT id, topic, round_even(CAST(m AS DOUBLE), 3) AS weight,
    CASE WHEN total_attempts > 0 THEN round_even(greatest(0.0, (m + 1.282 * 1.282 / (2 * t) - 1.282 * sqrt(m * (1 - m) / t + 1.282 * 1.282 / (4 * t * t))) / (1 + 1.282 * 1.282 / t)), 3) ELSE 0.0 END AS lower_bound
  FROM weights)"""
_LEVEL = "CASE difficulty_estimate WHEN 'basic' THEN 1 WHEN 'intermediate' THEN 2 ELSE 3 END"


@query("SELECT topic, count(*) AS n FROM fx_qa GROUP BY topic")
def a1_count_by(t):
    return agg.count_by(t("fx_qa"), "topic")


@query("SELECT command_verb, count(*) AS n FROM fx_qa WHERE command_verb NOT IN ('', 'unknown') GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def a2_top_verbs(t):
    return agg.top_verbs(t("fx_qa"))


@query("SELECT difficulty_estimate, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM fx_qa GROUP BY 1")
def a3_distribution(t):
    return agg.distribution(t("fx_qa"), "difficulty_estimate")


@query("SELECT topic AS source, paper AS target, count(*) AS n FROM fx_qa GROUP BY 1, 2 HAVING count(*) > 1")
def a4_duplicate_edges(t):
    return agg.duplicate_edges(t("fx_qa").select(F.col("topic").alias("source"), F.col("paper").alias("target")))


@query(f"WITH {_WEIGHTS} SELECT id, topic, weight, lower_bound FROM weighed")
def a5_qa_weights(t):
    return agg.qa_weights(t("fx_qa")).select("id", "topic", "weight", "lower_bound")


@query(f"WITH {_MISS} SELECT qa_id, miss_rate FROM miss")
def a6_effective_miss_rate(t):
    return agg.effective_miss_rate(t("fx_feedback"))


@query(f"""WITH {_MISS}, rows AS (
  SELECT CASE WHEN command_verb = '' THEN 'unknown' ELSE command_verb END AS verb, length(answer_text) AS size, miss_rate
  FROM fx_qa LEFT JOIN (SELECT miss.* FROM miss JOIN fx_feedback f ON f.qa_id = miss.qa_id WHERE f.topic_match = 1) m ON m.qa_id = fx_qa.id)
SELECT verb, count(*) AS sample_count, round_even(avg(size), 4) AS avg_length, list_sort(list(size))[CAST(floor(count(*) / 2) AS INT) + 1] AS median_length,
  0.0 AS bullet_ratio, 0.0 AS avg_bullets, round_even(avg(miss_rate), 4) AS avg_miss_rate FROM rows GROUP BY verb""")
def a7_verb_stats(t):
    return agg.verb_stats(t("fx_qa"), t("fx_feedback"))


@query("""WITH m AS (SELECT command_verb, topic, avg(length(answer_text)) AS topic_mean, count(*) AS n FROM fx_qa GROUP BY 1, 2),
v AS (SELECT *, avg(topic_mean) OVER w AS mean, var_pop(topic_mean) OVER w AS variance, count(*) OVER w AS topics, sum(n) OVER w AS questions FROM m WINDOW w AS (PARTITION BY command_verb))
SELECT command_verb, topic, round_even(topic_mean, 6) AS topic_mean, CASE WHEN topic_mean > mean THEN 'longer' ELSE 'shorter' END AS direction
FROM v WHERE questions >= 3 AND topics >= 2 AND variance > 0.0003 * mean AND abs(topic_mean - mean) > 0.0005 * mean""")
def a8_verb_topic_variance(t):
    # answers of the test tables hardly vary, so the thresholds are a thousandth and a four-hundredth of the defaults
    return agg.verb_topic_variance(t("fx_qa"), spread=0.0003, apart=0.0005).withColumn("topic_mean", F.bround("topic_mean", 6))


@query(f"""WITH {_MISS}, c AS (
  SELECT topic, count(*) AS qa_count, count(*) FILTER (difficulty_estimate = 'basic') AS basic_count, count(*) FILTER (difficulty_estimate = 'intermediate') AS intermediate_count,
    count(*) FILTER (difficulty_estimate = 'advanced') AS advanced_count, round_even(avg(miss_rate), 2) AS avg_miss_rate
  FROM fx_qa LEFT JOIN miss ON miss.qa_id = fx_qa.id WHERE topic <> '' GROUP BY topic)
SELECT *, CASE greatest(basic_count, intermediate_count, advanced_count) WHEN basic_count THEN 'basic' WHEN intermediate_count THEN 'intermediate' ELSE 'advanced' END AS mode_difficulty,
  CASE WHEN basic_count > 0 AND advanced_count > 0 THEN 'mixed' ELSE 'uniform' END AS difficulty_spread FROM c""")
def a9_topic_difficulty(t):
    return agg.topic_difficulty(t("fx_qa"), t("fx_feedback"))


_SIGNATURES = f"""{_MISS}, r AS (SELECT fx_qa.*, length(answer_text) AS size, miss_rate FROM fx_qa LEFT JOIN miss ON miss.qa_id = fx_qa.id),
purity AS (SELECT paper, avg(greatest(0.0, 1 - sd / mean)) AS topic_purity_avg FROM (
  SELECT paper, topic, stddev_samp(size) AS sd, avg(size) AS mean, count(*) AS n FROM r GROUP BY 1, 2) WHERE n >= 2 AND mean > 0 GROUP BY paper),
signatures AS (SELECT r.paper, count(*) AS qa_count, avg(size) AS avg_answer_length, count(DISTINCT topic) AS topic_count, avg(miss_rate) AS avg_miss_rate,
  any_value(topic_purity_avg) AS topic_purity_avg FROM r LEFT JOIN purity ON purity.paper = r.paper GROUP BY r.paper)"""
_LONG = """long AS (
  SELECT paper, 'avg_answer_length' AS dimension, avg_answer_length AS value FROM signatures UNION ALL SELECT paper, 'topic_count', topic_count FROM signatures
  UNION ALL SELECT paper, 'avg_miss_rate', avg_miss_rate FROM signatures UNION ALL SELECT paper, 'topic_purity_avg', topic_purity_avg FROM signatures),
centre AS (SELECT dimension, avg(value) AS mean, median(value) AS median, count(*) AS sample_count FROM long WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 3),
baselines AS (SELECT centre.*, mad FROM centre JOIN (SELECT dimension, median(abs(value - median)) AS mad FROM long JOIN centre USING (dimension) GROUP BY 1) USING (dimension))"""


@query(f"""WITH {_SIGNATURES} SELECT paper, qa_count, round_even(avg_answer_length, 6) AS avg_answer_length, topic_count, round_even(avg_miss_rate, 6) AS avg_miss_rate,
  round_even(topic_purity_avg, 6) AS topic_purity_avg FROM signatures""")
def a10_paper_signatures(t):
    rows = agg.paper_signatures(t("fx_qa"), t("fx_feedback"))
    return rows.select("paper", "qa_count", "topic_count", *(F.bround(c, 6).alias(c) for c in ("avg_answer_length", "avg_miss_rate", "topic_purity_avg")))


@query(f"WITH {_SIGNATURES}, {_LONG} SELECT dimension, round_even(mean, 6) AS mean, round_even(median, 6) AS median, round_even(mad, 6) AS mad, sample_count FROM baselines")
def a11_dimension_baselines(t):
    rows = agg.dimension_baselines(agg.paper_signatures(t("fx_qa"), t("fx_feedback")))
    return rows.select("dimension", "sample_count", *(F.bround(c, 6).alias(c) for c in ("mean", "median", "mad")))


@query(f"""WITH {_SIGNATURES}, {_LONG}, z AS (SELECT paper, dimension, abs(value - median) / mad AS z FROM long JOIN baselines USING (dimension) WHERE value IS NOT NULL AND mad > 0),
flags AS (SELECT paper, count(*) FILTER (z > 3) AS severe, count(*) FILTER (z > 2) AS moderate, array_to_string(list_sort(list(dimension) FILTER (z > 2)), ',') AS dimensions FROM z GROUP BY paper)
SELECT *, CASE WHEN moderate >= 3 THEN 'systemic' WHEN severe > 0 THEN 'severe' ELSE 'moderate' END AS grade FROM flags WHERE severe > 0 OR moderate > 0""")
def a12_detect_anomalies(t):
    from gradeloom.session import stored

    signatures = stored(agg.paper_signatures(t("fx_qa"), t("fx_feedback")), "signatures")
    return agg.detect_anomalies(signatures, agg.dimension_baselines(signatures)).withColumn("dimensions", F.array_join("dimensions", ","))


@query("SELECT topic, year, season, count(*) AS n FROM fx_qa GROUP BY 1, 2, 3")
def a13_exam_stats(t):
    return agg.exam_stats(t("fx_qa"))


@query(f"""WITH r AS (SELECT kp_id, year, season, count(*) AS occurrence_count, avg({_LEVEL}) AS level FROM fx_members JOIN fx_qa ON qa_id = id GROUP BY 1, 2, 3),
k AS (SELECT kp_id, count(*) AS sessions, count(DISTINCT year) AS years FROM r GROUP BY 1)
SELECT kp_id, year, season, occurrence_count, CASE WHEN level > 2.0 THEN 'advanced' WHEN level > 1.3 THEN 'intermediate' ELSE 'basic' END AS avg_difficulty, years >= 3 AS recurring
FROM r JOIN k USING (kp_id) WHERE sessions >= 2""")
def a14_exam_trends(t):
    return agg.exam_trends(t("fx_members"), t("fx_qa"))


@query("""SELECT paper, CAST(sum(covered_count + missed_count) AS BIGINT) AS retrieved, CAST(sum(covered_count) AS BIGINT) AS used,
  CASE WHEN sum(covered_count + missed_count) > 0 THEN sum(covered_count) / CAST(sum(covered_count + missed_count) AS DOUBLE) ELSE 0.0 END AS utility
FROM fx_feedback f JOIN fx_qa q ON f.qa_id = q.id GROUP BY paper""")
def a15_paper_feedback(t):
    fb = t("fx_feedback").withColumn("retrieval_count", F.expr("covered_count + missed_count")).withColumnRenamed("covered_count", "used_qa_count")
    return agg.paper_feedback(fb, t("fx_qa"))


@query("""WITH s AS (SELECT paper, sum(knowledge_gap) AS a, sum(misinterpretation) AS b, sum(insufficient_detail) AS c FROM fx_feedback f JOIN fx_qa q ON f.qa_id = q.id GROUP BY paper)
SELECT * FROM (SELECT paper, 'knowledge_gap' AS reason, CAST(a AS BIGINT) AS n FROM s UNION ALL SELECT paper, 'misinterpretation', b FROM s UNION ALL SELECT paper, 'insufficient_detail', c FROM s) WHERE n > 0""")
def a16_miss_categories(t):
    return agg.miss_categories(t("fx_feedback"), t("fx_qa"))


@query(f"""WITH {_WEIGHTS}, q AS (SELECT topic, max(lower_bound) AS best_bound, max(weight) AS best_weight, coalesce(var_samp(weight), 0.0) AS variance, count(*) AS n FROM weighed GROUP BY topic)
SELECT topic, best_bound, best_weight, round_even(variance, 8) AS variance, n, best_weight < 0.4 AND variance < 0.02 AND n >= 2 AS low_quality,
  CASE WHEN best_bound < 0.15 AND n > 1 THEN 'dropped' WHEN best_bound < 0.25 THEN 'review' WHEN best_bound >= 0.5 THEN 'core' ELSE '' END AS marker FROM q""")
def a17_topic_quality(t):
    return agg.topic_quality(agg.qa_weights(t("fx_qa"))).withColumn("variance", F.bround("variance", 8))


@query("SELECT topic, count(*) AS n FROM fx_confusions WHERE created_at >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY GROUP BY topic")
def a18_recent_confusions(t):
    now = t("events").agg(F.max("ts")).first()[0]
    return agg.recent_confusions(t("fx_confusions"), F.lit(now).cast("timestamp_ntz"), days=20)


@query("SELECT topic, count(DISTINCT student_id) AS students FROM fx_states WHERE state = 'mastered' GROUP BY topic HAVING count(DISTINCT student_id) >= 3")
def a19_mastered_topics(t):
    return agg.mastered_topics(t("fx_states"))


@query(f"""WITH {_WEIGHTS} SELECT id, topic, weight, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, id) = 1 AS is_representative,
  topic IN (SELECT src_topic FROM fx_links UNION SELECT dst_topic FROM fx_links) AS is_cross_topic FROM weighed""")
def a20_mark_representatives(t):
    return agg.mark_representatives(agg.qa_weights(t("fx_qa")).select("id", "topic", "weight"), t("fx_links"))


@query(f"""WITH {_WEIGHTS}, heads AS (SELECT id, topic, weight FROM weighed QUALIFY row_number() OVER (PARTITION BY topic ORDER BY weight DESC, id) = 1),
nth AS (SELECT *, row_number() OVER (ORDER BY topic) AS position, (SELECT greatest(floor(count(*) / 10), 1) FROM heads) AS step FROM heads)
SELECT id, topic, weight FROM nth WHERE (position - 1) % step = 0 ORDER BY position LIMIT 10""")
def a21_difficulty_anchors(t):
    rows = agg.qa_weights(t("fx_qa")).withColumn("is_representative", F.lit(False))
    return agg.difficulty_anchors(rows, cap=10).select("id", "topic", "weight")


@query(f"""WITH {_MISS}, m AS (SELECT difficulty_estimate AS d, list_sort(list(miss_rate)) AS l FROM fx_qa JOIN miss ON qa_id = id WHERE miss_rate IS NOT NULL GROUP BY 1),
u AS (SELECT d, l[CAST(floor(len(l) / 2) AS INT) + 1] AS v FROM m)
SELECT 'miss_rate' AS signal, (max(v) FILTER (d = 'basic') + max(v) FILTER (d = 'intermediate')) / 2 AS basic_intermediate,
  (max(v) FILTER (d = 'intermediate') + max(v) FILTER (d = 'advanced')) / 2 AS intermediate_advanced FROM u""")
def a22_difficulty_boundaries(t):
    signals = agg.effective_miss_rate(t("fx_feedback")).select("qa_id", F.lit("miss_rate").alias("signal"), F.col("miss_rate").alias("value"))
    return agg.difficulty_boundaries(signals, t("fx_qa").select(F.col("id").alias("qa_id"), F.col("difficulty_estimate").alias("difficulty")))


_JUDGED = """judged AS (SELECT CASE id % 4 WHEN 0 THEN 'accuracy' WHEN 1 THEN 'language' WHEN 2 THEN 'honesty' ELSE 'pitfall' END AS dimension, topic, success_count > 0 AS passed FROM fx_qa),
rates AS (SELECT dimension, topic, avg(CAST(passed AS INT)) AS rate, count(*) AS n FROM judged GROUP BY dimension, topic UNION ALL SELECT dimension, NULL, avg(CAST(passed AS INT)), count(*) FROM judged GROUP BY dimension)"""


def _judged(t):
    kinds = F.element_at(F.array(*map(F.lit, ("accuracy", "language", "honesty", "pitfall"))), (F.col("id") % 4).cast("int") + 1)
    return t("fx_qa").select(kinds.alias("dimension"), "topic", (F.col("success_count") > 0).alias("passed"))


@query(f"WITH {_JUDGED} SELECT dimension, topic, round_even(rate, 9) AS rate, n FROM rates")
def a23_eval_rates(t):
    return agg.eval_rates(_judged(t)).withColumn("rate", F.bround("rate", 9))


@query(f"""WITH {_JUDGED} SELECT dimension, topic, 'raise the dimension' AS advice FROM rates WHERE topic IS NULL AND rate < CASE dimension WHEN 'accuracy' THEN 0.7 WHEN 'language' THEN 1.0 WHEN 'honesty' THEN 0.8 ELSE 0.7 END
UNION ALL SELECT dimension, topic, 'review the topic' FROM rates WHERE topic IS NOT NULL AND rate = 0""")
def a24_eval_suggestions(t):
    return agg.eval_suggestions(agg.eval_rates(_judged(t)))


@query("""WITH s AS (SELECT qa_id, CASE WHEN covered_count + missed_count > 0 THEN covered_count / CAST(covered_count + missed_count AS DOUBLE) ELSE 0.0 END AS score FROM fx_feedback)
SELECT qa_id, score, score >= 0.7 AS valid FROM s""")
def a25_practice_scores(t):
    return agg.practice_scores(t("fx_feedback")).select("qa_id", "score", "valid")


_KPS = "kps AS (SELECT kp_id, count(*) - CAST(substr(kp_id, 4) AS INT) % 7 AS evidence_count, CASE CAST(substr(kp_id, 4) AS INT) % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'accepted' WHEN 2 THEN 'draft' ELSE 'disputed' END AS quality FROM fx_members GROUP BY kp_id)"


def points(t):
    """Points with evidence and quality by fixed rules."""
    number = F.substring("kp_id", 4, 10).cast("int")
    quality = F.element_at(F.array(*map(F.lit, ("verified", "accepted", "draft", "disputed"))), number % 4 + 1)
    return t("fx_members").groupBy("kp_id").agg(F.count("*").alias("n")).select("kp_id", (F.col("n") - number % 7).alias("evidence_count"), quality.alias("quality"))


@query(f"""WITH {_KPS}, m AS (SELECT kp_id, count(*) AS members FROM fx_members GROUP BY 1)
SELECT kp_id, evidence_count, members FROM kps JOIN m USING (kp_id) WHERE members > evidence_count AND members >= 5 AND (members - evidence_count >= 3 OR members >= 1.5 * evidence_count)""")
def a26_evidence_growth(t):
    return agg.evidence_growth(points(t), t("fx_members"))


@query("SELECT event_type AS kp_id, event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'queued' ELSE 'completed' END AS outcome FROM events WHERE event_id % 3 = 0")
def a27_open_proposals(t):
    return agg.open_proposals(t("events").select(F.col("event_type").alias("kp_id"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "queued").otherwise("completed").alias("outcome")))


@query("SELECT count(*) FILTER (command_verb NOT IN ('', 'unknown')) AS annotated, count(*) FILTER (command_verb = 'unknown') AS unknown, count(*) AS total FROM fx_qa")
def a28_verb_coverage(t):
    return agg.verb_coverage(t("fx_qa"))


_PERCENTILE = """percentiles AS (SELECT id, command_verb, CASE WHEN count(*) OVER (PARTITION BY command_verb) > 1 THEN
  (rank() OVER (PARTITION BY command_verb ORDER BY length(answer_text)) - 1) / CAST(count(*) OVER (PARTITION BY command_verb) AS DOUBLE) END AS percentile FROM fx_qa)"""


@query(f"WITH {_PERCENTILE} SELECT * FROM percentiles")
def w1_verb_length_percentile(t):
    return windows.verb_length_percentile(t("fx_qa"))


@query("""WITH r AS (SELECT paper, kp_id, lag(kp_id) OVER (PARTITION BY paper ORDER BY CAST(regexp_extract(question_number, '^(\\d+)', 1) AS INT), regexp_replace(question_number, '^\\d+', ''), id, kp_id) AS source FROM fx_members JOIN fx_qa ON qa_id = id)
SELECT source, kp_id AS target, count(*) AS count, count(DISTINCT paper) AS papers FROM r WHERE source <> kp_id GROUP BY 1, 2""")
def w2_sequential_transitions(t):
    return windows.sequential_transitions(t("fx_qa"), t("fx_members"))


@query("""WITH r AS (SELECT student_id, kp_id, lag(kp_id) OVER (PARTITION BY student_id ORDER BY recorded_at, id) AS source FROM fx_trajectory)
SELECT source, kp_id AS target, count(*) AS count, count(DISTINCT student_id) AS students FROM r WHERE source <> kp_id GROUP BY 1, 2""")
def w3_learning_transitions(t):
    return windows.learning_transitions(t("fx_trajectory"))


@query("SELECT id, student_id, kp_id FROM fx_trajectory QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY recorded_at DESC, id DESC) <= 5")
def w4_last_n(t):
    return windows.last_n(t("fx_trajectory"), "student_id", "recorded_at", 5).select("id", "student_id", "kp_id")


@query(f"""WITH {_WEIGHTS}, q AS (SELECT id % 50 AS query_id, id FROM fx_qa), top AS (SELECT query_id, CAST(id AS VARCHAR) AS item, 'question' AS kind FROM q JOIN weighed USING (id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, id) <= 4),
p AS (SELECT kp_id FROM fx_members GROUP BY kp_id ORDER BY count(*) DESC, kp_id LIMIT 3)
SELECT * FROM top UNION ALL SELECT query_id, kp_id, 'point' FROM (SELECT DISTINCT query_id FROM q), p""")
def w5_context_pick(t):
    kps = t("fx_members").groupBy("kp_id").agg(F.count("*").alias("mass")).withColumn("quality", F.lit("stable"))
    return windows.context_pick(t("fx_qa").select((F.col("id") % 50).alias("query_id"), "id"), agg.qa_weights(t("fx_qa")), kps)


@query("SELECT type, payload, source FROM fx_bus ORDER BY ts DESC, source DESC, type LIMIT 50")
def w6_recent_events(t):
    return windows.recent_events(t("fx_bus")).select("type", "payload", "source")


@query("SELECT topic, kp_id AS pattern, count(*) AS size FROM fx_members JOIN fx_qa ON qa_id = id GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, kp_id) <= 5")
def w7_top_patterns(t):
    rows = t("fx_members").join(t("fx_qa").select(F.col("id").alias("qa_id"), "topic"), "qa_id").groupBy("topic", F.col("kp_id").alias("pattern")).agg(F.count("*").alias("size"))
    return windows.top_patterns(rows, "topic").drop("nth")


@query("(SELECT src_topic AS topic FROM fx_links INTERSECT SELECT topic FROM fx_qa) EXCEPT SELECT n_name FROM nation WHERE n_regionkey = 0")
def w8_set_operations(t):
    linked = t("fx_links").select(F.col("src_topic").alias("topic")).intersect(t("fx_qa").select("topic"))
    return linked.subtract(t("nation").where("n_regionkey = 0").select(F.col("n_name").alias("topic")))


@query("""WITH p AS (SELECT DISTINCT type FROM fx_bus WHERE source % 2 = 0 OR type <> 'error'), s AS (SELECT DISTINCT type FROM fx_bus WHERE type <> 'view' UNION ALL SELECT 'alarm')
SELECT type, 'nobody subscribes' AS issue FROM p WHERE type NOT IN (SELECT type FROM s) UNION ALL SELECT type, 'nobody publishes' FROM s WHERE type NOT IN (SELECT type FROM p)""")
def w9_validate_contracts(t):
    bus = t("fx_bus")
    alarm = bus.sparkSession.range(1).select(F.lit("alarm").alias("type"))
    return windows.validate_contracts(bus.where("source % 2 = 0 or type <> 'error'").select("type"), bus.where("type <> 'view'").select("type").distinct().union(alarm))


_DEGREE = """adjacent AS (SELECT src_topic AS topic, dst_topic AS other FROM fx_links UNION SELECT dst_topic, src_topic FROM fx_links),
degree AS (SELECT topic, least(count(*) / 10.0, 1.0) AS degree FROM adjacent GROUP BY topic)"""
_SIGNALS = f"""{_MISS}, {_PERCENTILE}, {_DEGREE}, signals AS (
  SELECT q.id, miss_rate, CASE WHEN q.topic = '' THEN 0.0 ELSE coalesce(CAST(degree AS DOUBLE), 0.0) END AS cross_topic, percentile AS length_percentile
  FROM fx_qa q LEFT JOIN miss ON miss.qa_id = q.id LEFT JOIN degree ON degree.topic = q.topic LEFT JOIN percentiles p ON p.id = q.id)"""
_BOUNDS = {"miss_rate": (0.3, 0.6), "length_percentile": (0.4, 0.8)}
_VOTES = """votes AS (SELECT id, CASE WHEN miss_rate >= 0.6 THEN 3 WHEN miss_rate >= 0.3 THEN 2 WHEN miss_rate IS NOT NULL THEN 1 END AS v1,
  CASE WHEN length_percentile >= 0.8 THEN 3 WHEN length_percentile >= 0.4 THEN 2 WHEN length_percentile IS NOT NULL THEN 1 END AS v2,
  coalesce(abs(miss_rate - 0.3) <= 0.1 * 0.3 OR abs(miss_rate - 0.6) <= 0.1 * 0.6, FALSE) OR coalesce(abs(length_percentile - 0.4) <= 0.1 * 0.4 OR abs(length_percentile - 0.8) <= 0.1 * 0.8, FALSE) AS boundary FROM signals),
labelled AS (SELECT id, CASE greatest(v1, v2) WHEN 3 THEN 'advanced' WHEN 2 THEN 'intermediate' WHEN 1 THEN 'basic' ELSE 'intermediate' END AS difficulty, boundary, greatest(v1, v2) IS NOT NULL AS voted FROM votes)"""


@query(f"WITH {_SIGNALS} SELECT * FROM signals")
def d1_difficulty_signals(t):
    return dif.difficulty_signals(t("fx_qa"), t("fx_feedback"), t("fx_links"))


@query(f"WITH {_SIGNALS}, {_VOTES} SELECT id, v1 AS rank FROM votes")
def d2_vote(t):
    rows = dif.difficulty_signals(t("fx_qa"), t("fx_feedback"), t("fx_links"))
    return rows.select("id", dif.vote(F.col("miss_rate"), F.lit(0.3), F.lit(0.6))[0].alias("rank"))


@query(f"WITH {_SIGNALS}, {_VOTES} SELECT id, difficulty, boundary FROM labelled")
def d3_classify(t):
    return dif.classify(dif.difficulty_signals(t("fx_qa"), t("fx_feedback"), t("fx_links")), _BOUNDS).select("id", "difficulty", "boundary")


@query(f"""WITH {_SIGNALS}, {_VOTES} SELECT l.id, CASE WHEN boundary OR NOT voted THEN coalesce(j.difficulty_estimate, difficulty) ELSE difficulty END AS difficulty, boundary
FROM labelled l LEFT JOIN (SELECT id, difficulty_estimate FROM fx_qa WHERE id % 3 = 0) j ON j.id = l.id""")
def d4_classify_all(t):
    judged = t("fx_qa").where("id % 3 = 0").select(F.col("id").alias("qa_id"), F.col("difficulty_estimate").alias("difficulty"))
    return dif.classify_all(dif.difficulty_signals(t("fx_qa"), t("fx_feedback"), t("fx_links")), _BOUNDS, judged)
