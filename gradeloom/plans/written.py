"""Sources, scalar functions and keyed writes."""

from pyspark.sql import functions as F

from gradeloom.operators import scalars as sc
from gradeloom.operators import upserts as up
from gradeloom.plans import query
from gradeloom.sources import papers, texts

_NAMES = "names AS (SELECT DISTINCT concat(substr(paper, 1, 8), CASE id % 5 WHEN 0 THEN '_QP_' WHEN 4 THEN '_er_' ELSE '_ms_' END, CAST(id % 7 AS VARCHAR)) AS file_name FROM fx_qa)"


def _files(t):
    kind = F.when(F.col("id") % 5 == 0, "_QP_").when(F.col("id") % 5 == 4, "_er_").otherwise("_ms_")
    return t("fx_qa").select(F.concat(F.substring("paper", 1, 8), kind, (F.col("id") % 7).cast("string")).alias("file_name")).distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3")
def s1_scan(t):
    return papers.scan(t.spark, f"{t.sf_dir}/orders.parquet", "o_orderkey long, o_totalprice double", [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query(f"WITH {_NAMES} SELECT file_name, regexp_extract(file_name, '(?i)^(.+)_(qp|ms)_(.+)$', 1) AS prefix, lower(regexp_extract(file_name, '(?i)^(.+)_(qp|ms)_(.+)$', 2)) AS doc_type, regexp_extract(file_name, '(?i)^(.+)_(qp|ms)_(.+)$', 3) AS number FROM names WHERE regexp_matches(file_name, '(?i)^(.+)_(qp|ms)_(.+)$')")
def s2_parse_paper_names(t):
    return papers.parse_paper_names(_files(t))


@query(f"""WITH {_NAMES}, p AS (SELECT substr(file_name, 1, 8) AS prefix, split_part(file_name, '_', 4) AS number, max(file_name) FILTER (file_name LIKE '%QP%') AS qp, max(file_name) FILTER (file_name LIKE '%ms%') AS ms
FROM names WHERE file_name NOT LIKE '%er%' GROUP BY 1, 2) SELECT prefix, number, qp, ms FROM p WHERE qp IS NOT NULL AND ms IS NOT NULL""")
def s3_pair_papers(t):
    return papers.pair_papers(_files(t))[0]


@query("SELECT DISTINCT split_part(paper, '_', 1) AS subject_code, CASE substr(paper, 6, 1) WHEN 's' THEN 'S1' WHEN 'w' THEN 'S2' ELSE 'S3' END AS season, 2000 + CAST(substr(paper, 7, 2) AS INT) AS year, paper AS display_name FROM fx_qa")
def s4_exam_sessions(t):
    return papers.exam_sessions(t("fx_qa"))


@query("SELECT DISTINCT paper, 2000 + CAST(substr(paper, 7, 2) AS INT) AS year FROM fx_qa WHERE paper NOT LIKE '%_0'")
def s5_pending_papers(t):
    return papers.pending_papers(t("fx_qa"), t("fx_qa").where("paper like '%\\_0'").select("paper").distinct())


@query("SELECT id, 0 AS block, source AS topic, 1 AS number, lang AS concept, concat('of ', source) AS detail, NULL AS pitfall, NULL AS scoring FROM (SELECT doc_id AS id, lang, source FROM documents)")
def s6_parse_points(t):
    text = F.concat("source", F.lit("  [n]\n1. "), "lang", F.lit("\nDetail: of "), "source", F.lit("\nSee also: x\nDetail: no"))
    return texts.parse_points(t("documents").select(F.col("doc_id").alias("id"), text.alias("text")))


@query("SELECT n_name AS topic, concat(n_name, '', chr(10), '1. ', CASE WHEN n_nationkey % 2 = 0 THEN '(review) ' ELSE '' END, 'region ', CAST(n_regionkey AS VARCHAR), chr(10), '   Detail: key ', CAST(n_nationkey AS VARCHAR)) AS text FROM nation")
def s7_format_points(t):
    rows = t("nation").select(F.col("n_name").alias("topic"), F.lit("").alias("marker"), F.lit(1).alias("number"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("concept"),
                              F.concat(F.lit("key "), F.col("n_nationkey").cast("string")).alias("detail"), F.lit("").alias("pitfall"), F.lit("").alias("scoring"), (F.col("n_nationkey") % 2 == 0).alias("low_confidence"))
    return texts.format_points(rows)


@query("""WITH v AS (SELECT command_verb AS verb, count(*) AS n, length(command_verb) % 2 = 0 AS even FROM fx_qa GROUP BY 1)
SELECT verb, concat_ws(chr(10), printf('%s  [%s]  (n=%d)', verb, CASE WHEN even THEN 'describe' ELSE '' END, n), repeat('-', 40), CASE WHEN even THEN printf('  Avg answer length: %.0f chars  (median: %.0f)', CAST(n * 3 AS DOUBLE), CAST(n AS DOUBLE)) END,
  printf('  Bullet/list usage: %.0f%%  (avg %.1f bullets)', CAST(30.0 AS DOUBLE), CAST(1.75 AS DOUBLE)), CASE WHEN NOT even THEN '  Avg miss rate (AI): 20%' END, CASE WHEN even THEN '  Pattern: of ' || verb END, CASE WHEN NOT even THEN '    [a] note a' || chr(10) || '    [' || verb || '] note b' END) AS block FROM v""")
def s8_format_verb_report(t):
    rows = t("fx_qa").groupBy(F.col("command_verb").alias("verb")).agg(F.count("*").alias("sample_count"))
    even, n = F.length("verb") % 2 == 0, F.col("sample_count")
    notes = F.array(*(F.struct(a.alias("topic"), F.lit(b).alias("note")) for a, b in ((F.lit("a"), "note a"), (F.col("verb"), "note b"))))
    rows = rows.withColumns({
        "verb_family": F.when(even, "describe"), "avg_answer_length": F.when(even, n * 3), "median_answer_length": n, "bullet_ratio": F.lit(0.3), "avg_bullet_count": F.lit(1.75),
        "avg_miss_rate": F.when(~even, 0.2), "pattern_summary": F.when(even, F.concat(F.lit("of "), "verb")), "topic_notes": F.when(~even, notes)})
    return texts.format_verb_report(rows)


@query("SELECT source, CAST(json_extract(payload, '$.k') AS BIGINT) AS k FROM fx_bus")
def s9_decode_json(t):
    return texts.decode_json_cols(t("fx_bus"), {"payload": "map<string,bigint>"}).select("source", F.col("payload")["k"].alias("k"))


@query("""SELECT q.paper, CASE WHEN q.id % 3 = 0 THEN CAST(q.id AS VARCHAR) ELSE q.question_number || '#' || q.id END AS question_number, q.question_text, q.answer_text,
  CASE WHEN q.id % 3 = 0 THEN CAST(q.id AS VARCHAR) ELSE q.question_number || '#' || q.id END AS parent_question FROM fx_qa q""")
def s10_qa_from_pairs(t):
    number = F.when(F.col("id") % 3 == 0, "").otherwise(F.concat("question_number", F.lit("#"), F.col("id").cast("string")))
    rows = t("fx_qa").withColumn("question_number", number).withColumn("position", F.col("id")).withColumn("parent_question", F.lit(""))
    return papers.qa_from_pairs(rows.select("paper", "question_number", "position", "parent_question", "question_text"), rows.select("paper", "question_number", "position", "answer_text")).select("paper", "question_number", "question_text", "answer_text", "parent_question")


@query("SELECT id, topic FROM fx_qa WHERE season = 'S1' AND year = 2019 ORDER BY id LIMIT 40")
def p1_where_eq(t):
    return sc.where_eq(t("fx_qa"), "id", 40, season="S1", year=2019).select("id", "topic")


@query("SELECT position, id, topic FROM fx_qa JOIN (VALUES (0, 7), (1, 3), (2, 5), (3, 3)) v(position, want) ON id = want")
def p2_by_ids(t):
    return sc.by_ids(t("fx_qa"), [7, 3, 5, 3]).select("position", "id", "topic")


@query("SELECT topic, id FROM fx_qa WHERE difficulty_estimate = 'basic' QUALIFY row_number() OVER (PARTITION BY topic ORDER BY id % 10 = 0 DESC, success_count DESC, id) <= 5")
def p3_topic_questions(t):
    return sc.topic_questions(t("fx_qa").withColumn("is_representative", F.col("id") % 10 == 0), difficulty="basic", n=5).select("topic", "id")


@query("SELECT p_name AS topic, p_size AS quality FROM part WHERE p_size IN (1, 2)")
def p4_by_quality(t):
    return sc.by_quality(t("part").select(F.col("p_name").alias("topic"), F.col("p_size").alias("quality")), [1, 2])


@query("SELECT CASE WHEN topic LIKE 'A%' THEN '(uncategorized)' ELSE topic END AS topic, count(*) AS qa_count, min(id) AS first_id FROM fx_qa GROUP BY 1")
def p5_topic_groups(t):
    return sc.topic_groups(t("fx_qa").withColumn("topic", F.when(F.col("topic").startswith("A"), "").otherwise(F.col("topic"))))


@query("SELECT topic, substr(string_agg(answer_text, ' ' ORDER BY id), 1, 2000) AS text FROM fx_qa GROUP BY topic")
def p6_topic_texts(t):
    return sc.topic_texts(t("fx_qa"))


@query("""SELECT qa_id, CASE WHEN covered_count + missed_count > 0 THEN covered_count / CAST(covered_count + missed_count AS DOUBLE) ELSE 0.0 END AS coverage_ratio,
  CASE WHEN qa_id % 3 = 0 THEN 1 ELSE 0 END AS topic_match FROM fx_feedback""")
def p7_derive_feedback(t):
    rows = t("fx_feedback").withColumn("step0_topic", F.lit("Heat")).withColumn("round2_topic", F.when(F.col("qa_id") % 3 == 0, "HEAT").otherwise(""))
    return sc.derive_feedback(rows).select("qa_id", "coverage_ratio", "topic_match")


@query("SELECT l_orderkey AS qa_id, string_agg(CAST(l_linenumber AS VARCHAR), chr(10) ORDER BY l_linenumber) AS missed_text, nullif(count(*) FILTER (l_returnflag = 'R'), 0) AS gaps FROM lineitem GROUP BY 1")
def p8_parse_missed(t):
    reason = F.when(F.col("l_returnflag") == "R", "knowledge_gap").otherwise("other")
    rows = t("lineitem").groupBy(F.col("l_orderkey").alias("qa_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("point"), reason.alias("reason")))).alias("missed"))
    text, counts = sc.parse_missed(F.col("missed"))
    return rows.select("qa_id", text.alias("missed_text"), counts["knowledge_gap"].alias("gaps"))


@query("SELECT doc_id AS qa_id, source AS topic, trim(line) AS line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''")
def p9_missed_lines(t):
    docs = t("documents")
    return sc.missed_lines(docs.select(F.col("doc_id").alias("qa_id"), F.col("text").alias("missed_text")), docs.select(F.col("doc_id").alias("id"), F.col("source").alias("topic")))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'summary' ELSE trim(question_text || ' ' || answer_text) END AS text FROM fx_qa")
def p10_encode_text(t):
    empty = F.col("id") % 4 == 0
    return t("fx_qa").select("id", sc.encode_text(F.when(empty, "").otherwise(F.col("question_text")), F.when(empty, "").otherwise(F.col("answer_text")), F.lit("summary")).alias("text"))


@query("""SELECT doc_id, CASE WHEN length(text) > 0 AND (length(han) - length(regexp_replace(han, '[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]', '', 'g'))) / CAST(length(han) AS DOUBLE) > 0.05 THEN 'zh' ELSE 'en' END AS guess
FROM (SELECT doc_id, text, translate(text, 't', '知') AS han FROM documents)""")
def p11_detect_lang(t):
    return t("documents").select("doc_id", sc.detect_lang(F.translate("text", "t", "知")).alias("guess"))


@query("SELECT DISTINCT topic, 'topic_' || replace(replace(topic, ' ', '_'), '/', '_') AS topic_id FROM fx_qa")
def p12_topic_id(t):
    return t("fx_qa").select("topic", sc.topic_id(F.col("topic")).alias("topic_id")).distinct()


@query("SELECT DISTINCT question_number, CAST(regexp_extract(question_number, '^(\\d+)', 1) AS BIGINT) AS number, regexp_replace(question_number, '^\\d+', '') AS rest FROM fx_qa")
def p13_qn_key(t):
    return t("fx_qa").select("question_number", sc.qn_key(F.col("question_number")).alias("k")).distinct().select("question_number", "k.*")


@query("SELECT DISTINCT kp_id || 's1' AS kp_id, CAST(regexp_extract(kp_id, '^kp_(\\d+)', 1) AS INT) AS idx FROM fx_members")
def p14_kp_idx(t):
    return t("fx_members").select(F.concat("kp_id", F.lit("s1")).alias("kp_id")).distinct().select("kp_id", sc.kp_idx(F.col("kp_id")).alias("idx"))


_LINES = "lines AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '- a' WHEN 1 THEN '1) a. b' WHEN 2 THEN '12. x' WHEN 3 THEN '(a) x' WHEN 4 THEN '3 x' ELSE '7) x' END AS line FROM documents)"


@query(f"WITH {_LINES} SELECT doc_id, line, CASE WHEN line IN ('- a', '12. x', '(a) x', '7) x') THEN TRUE ELSE FALSE END AS bullet FROM lines")
def p15_is_bullet(t):
    line = F.element_at(F.array(*map(F.lit, ("- a", "1) a. b", "12. x", "(a) x", "3 x", "7) x"))), (F.col("doc_id") % 6).cast("int") + 1)
    return t("documents").select("doc_id", line.alias("line")).withColumn("bullet", sc.is_bullet(F.col("line")))


@query("SELECT doc_id, '  • ' || lang || chr(10) || chr(10) || source AS text FROM documents")
def p16_normalize_text(t):
    return t("documents").select("doc_id", sc.normalize_text(F.concat(F.lit("- "), "lang", F.lit("  \n\n\n\n"), "source", F.lit(" "))).alias("text"))


@query("""WITH s AS (SELECT src_topic, string_agg(dst_topic || ' (ref ' || count || ')', ', ' ORDER BY count DESC, dst_topic) AS see FROM fx_links WHERE count >= 2 GROUP BY 1)
SELECT topic || ' unit' AS header, topic, 'See also: ' || see AS note FROM (SELECT DISTINCT src_topic AS topic FROM fx_links) x JOIN s ON s.src_topic = x.topic
UNION ALL SELECT topic || ' unit', topic, 'Related: ' || string_agg(other, ', ' ORDER BY nth) FILTER (nth <= 3 AND count >= 2)
FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY count DESC, other) AS nth FROM (SELECT p_brand AS topic, split_part(p_type, ' ', 1) AS other, count(*) AS count FROM part GROUP BY 1, 2)) GROUP BY topic""")
def p17_annotate_related(t):
    links = t("fx_links").select(F.col("src_topic").alias("src"), F.col("dst_topic").alias("dst"), "count")
    related = t("part").groupBy(F.col("p_brand").alias("topic"), F.substring_index("p_type", " ", 1).alias("other")).agg(F.count("*").alias("count"))
    headers = links.select("src").union(related.select("topic")).select(F.concat("src", F.lit(" unit")).alias("header")).distinct()
    return sc.annotate_related(headers, links, related)


@query("SELECT src_topic, dst_topic, CAST(least(count / 10.0, 1.0) AS DOUBLE) AS weight FROM fx_links")
def p18_transition_weight(t):
    return t("fx_links").select("src_topic", "dst_topic", sc.transition_weight(F.col("count")).alias("weight"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lang || ' ' || upper(source) || ' Heat and Light. Xy', '\\b[A-Z][A-Za-z]{2,}\\b'))), ',') AS terms FROM documents")
def p19_key_terms(t):
    text = F.concat("lang", F.lit(" "), F.upper("source"), F.lit(" Heat and Light. Xy"))
    return t("documents").select("doc_id", F.array_join(sc.key_terms(text), ",").alias("terms"))


@query("SELECT id, CASE id % 3 WHEN 0 THEN 'short-recall' WHEN 1 THEN 'elaboration' ELSE command_verb END AS family FROM fx_qa")
def p20_verb_family(t):
    verb = F.when(F.col("id") % 3 == 0, "State").when(F.col("id") % 3 == 1, "explain").otherwise(F.col("command_verb"))
    return t("fx_qa").select("id", sc.verb_family(verb).alias("family"))


_PARAMS = "from_json('[{\"name\":\"m\",\"type\":\"Denary number\",\"example\":\"7\"},{\"name\":\"c\",\"type\":\"hexadecimal\",\"example\":\"1F\"},{\"name\":\"b\",\"type\":\"binary\"},{\"name\":\"k\",\"type\":\"colour\",\"example\":\"red\"}]', 'array<struct<name:string,type:string,example:string>>')"


@query()
def p21_render_variations(t):
    rows = t("part").select(F.col("p_partkey").alias("template_id"), F.concat(F.lit("A "), "p_name", F.lit(" weighs {m} kg, has code {c} and flags {b}, and is {k}.")).alias("template"), F.expr(_PARAMS).alias("params"))
    return sc.render_variations(rows, n=2, difficulty="intermediate")


_HALF = "SELECT id, question_text, answer_text FROM fx_qa"


@query(f"WITH old AS ({_HALF} WHERE id % 2 = 0), new AS (SELECT min(id) + 1000000 AS id, question_text, answer_text FROM fx_qa GROUP BY 2, 3) SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.question_text = n.question_text AND old.answer_text = n.answer_text)")
def u1_insert_qa(t):
    rows = t("fx_qa").select("id", "question_text", "answer_text")
    return up.insert_qa(rows.where("id % 2 = 0"), rows.union(rows).withColumn("id", F.col("id") + 1_000_000))


@query("SELECT o_orderkey AS id, o_orderstatus AS name FROM orders")
def u2_insert_ignore(t):
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"))
    there = F.col("id") % 3 == 0
    return up.insert_ignore(rows.where(there), rows.withColumn("name", F.when(there, "new").otherwise(F.col("name"))), "id")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE topic END AS topic, year FROM fx_qa")
def u3_upsert(t):
    rows = t("fx_qa").select("id", "topic", "year")
    return up.upsert(rows, rows.where("id % 3 = 0").select("id", F.lit("new").alias("topic")), "id")


@query("SELECT src_topic, dst_topic, 3 * count AS count FROM fx_links")
def u4_accumulate_links(t):
    links = t("fx_links")
    return up.accumulate_links(links, links.union(links).union(links.select("src_topic", "src_topic", "count")))


@query("""WITH n AS (SELECT student_id, topic, arg_max(CASE WHEN resolved THEN 'mastered' ELSE 'learning' END, created_at) AS state, count(*) AS c FROM fx_confusions GROUP BY 1, 2)
SELECT coalesce(n.student_id, s.student_id) AS student_id, coalesce(n.topic, s.topic) AS topic, coalesce(n.state, s.state) AS state, coalesce(s.evidence_count, 0) + coalesce(c, 0) AS evidence_count
FROM fx_states s FULL JOIN n ON n.student_id = s.student_id AND n.topic = s.topic""")
def u5_upsert_knowledge_state(t):
    seen = t("fx_confusions").select("student_id", "topic", F.when(F.col("resolved"), "mastered").otherwise("learning").alias("state"), F.col("created_at").alias("ts"))
    return up.upsert_knowledge_state(t("fx_states"), seen)


@query("""WITH a AS (SELECT l_orderkey AS qa_id, count(*) FILTER (l_returnflag = 'R') AS s, count(*) AS t, arg_max(CASE WHEN l_returnflag = 'R' THEN '' ELSE l_linestatus END, l_shipdate::VARCHAR || l_partkey || l_suppkey || l_linenumber) AS r FROM lineitem GROUP BY 1)
SELECT q.id, q.success_count + coalesce(s, 0) AS success_count, q.total_attempts + coalesce(t, 0) AS total_attempts, coalesce(r, '') AS last_failure_reason FROM fx_qa q LEFT JOIN a ON a.qa_id = q.id""")
def u6_record_attempts(t):
    seq = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"))
    attempts = t("lineitem").select(F.col("l_orderkey").alias("qa_id"), (F.col("l_returnflag") == "R").alias("success"), F.col("l_linestatus").alias("reason"), seq.alias("seq"))
    rows = t("fx_qa").withColumn("last_failure_reason", F.lit(""))
    return up.record_attempts(rows, attempts).select("id", "success_count", "total_attempts", "last_failure_reason")


@query("SELECT id, least(success_count + id % 3, total_attempts) AS success_count, success_count + id % 3 > total_attempts AS fixed FROM fx_qa")
def u7_fix_counters(t):
    return up.fix_counters(t("fx_qa").withColumn("success_count", F.expr("success_count + id % 3"))).select("id", "success_count", "fixed")


@query("SELECT p_partkey AS fragment_id, CASE WHEN p_partkey % 2 = 0 THEN 2 WHEN p_partkey % 3 = 0 THEN 1 END AS verification_count FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def u8_bump_upsert(t):
    rows = t("part").select(F.col("p_partkey").alias("fragment_id"), F.lit(1).alias("verification_count"))
    return up.bump_upsert(rows.where("fragment_id % 2 = 0"), rows.where("fragment_id % 2 = 0 or fragment_id % 3 = 0"), "verification_count", "fragment_id")


@query("SELECT fragment_id, CASE WHEN length(fragment_id) % 2 = 0 THEN 'moved' ELSE topic_id END AS topic_id, CASE WHEN length(fragment_id) % 2 = 0 THEN topic_id ELSE previous_topic_id END AS previous_topic_id FROM fx_membership")
def u9_set_membership(t):
    rows = t("fx_membership")
    return up.set_membership(rows, rows.where("length(fragment_id) % 2 = 0").select("fragment_id", F.lit("moved").alias("topic_id")))


@query("""SELECT src_topic AS prerequisite, dst_topic AS dependent, count + CASE WHEN length(src_topic) % 2 = 0 THEN 1 ELSE 0 END AS topic_link_count,
  DATE '2024-01-01' AS first_seen_at, CASE WHEN length(src_topic) % 2 = 0 THEN DATE '2024-06-01' ELSE DATE '2024-01-01' END AS last_seen_at FROM fx_links""")
def u10_upsert_dependencies(t):
    day = F.lit("2024-01-01").cast("date")
    rows = t("fx_links").select(F.col("src_topic").alias("prerequisite"), F.col("dst_topic").alias("dependent"), F.col("count").alias("topic_link_count"), day.alias("first_seen_at"), day.alias("last_seen_at"))
    new = rows.where("length(prerequisite) % 2 = 0").select("prerequisite", "dependent", (F.col("topic_link_count") + 1).alias("topic_link_count"))
    return up.upsert_dependencies(rows, new, F.lit("2024-06-01").cast("date"))


@query("SELECT src_topic AS source, dst_topic AS target, CASE WHEN count % 2 = 0 THEN 'fused' ELSE 'related' END AS type FROM fx_links UNION ALL SELECT src_topic, dst_topic, 'semantic' FROM fx_links WHERE count % 2 = 1")
def u11_replace_edges(t):
    links = t("fx_links").select(F.col("src_topic").alias("source"), F.col("dst_topic").alias("target"), "count")
    edges = links.select("source", "target", F.lit("related").alias("type")).union(links.select("source", "target", F.lit("semantic")))
    return up.replace_edges(edges, links.where("count % 2 = 0").select("source", "target", F.lit("fused").alias("type")))


@query("SELECT id, topic FROM fx_qa WHERE NOT (id % 5 = 0)")
def u12_delete_where(t):
    return up.delete_where(t("fx_qa").select("id", "topic"), F.col("id") % 5 == 0)


@query("SELECT id, CASE WHEN topic = 'CHINA' THEN 'JAPAN' ELSE topic END AS topic FROM fx_qa")
def u13_rename_topics(t):
    mapping = t("nation").where("n_name = 'CHINA'").select(F.col("n_name").alias("old"), F.lit("JAPAN").alias("new"))
    return up.rename_topics(t("fx_qa").select("id", "topic"), mapping)


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 0 ELSE length(paper) + year END AS session_id FROM fx_qa")
def u14_backfill_sessions(t):
    sessions = t("fx_qa").select(F.col("paper").alias("display_name"), F.expr("length(paper) + year").alias("id")).distinct()
    return up.backfill_sessions(t("fx_qa").withColumn("session_id", F.when(F.col("id") % 2 == 0, 0)), sessions).select("id", "session_id")


@query("SELECT topic, count(*) AS qa_count, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS qa_ids_hash FROM fx_qa WHERE topic < 'J' GROUP BY topic")
def u15_stale_topics(t):
    rows = t("fx_qa")
    return up.stale_topics(rows, up.group_digests(rows.where("topic >= 'J'")))


@query("SELECT 'verbs' AS task_name, count(*) - max(n) >= 20 AS needs_run FROM fx_help, (SELECT count(*) - 5 AS n FROM fx_help)")
def u16_needs_run(t):
    n = t("fx_help").count()
    done = t.spark.range(1).select(F.lit("verbs").alias("task_name"), F.lit(n - 5).alias("qa_count_at_run"))
    return up.needs_run(done, "verbs", n, min_growth=20)


@query("SELECT event_id AS id, event_type AS stage FROM events UNION ALL SELECT event_id, event_type FROM events WHERE event_type = 'error'")
def u17_append_log(t):
    from gradeloom.session import scratch_path

    path = scratch_path(t.spark, "log")
    rows = t("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("stage"))
    up.append_log(t.spark, path, rows)
    up.append_log(t.spark, path, rows.where("stage = 'error'"))
    return t.spark.read.parquet(path).select("id", "stage")

