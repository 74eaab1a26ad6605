"""Domain tables as views over the given tables; the same SQL runs on Spark and on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: View name -> SQL over the base tables.
VIEWS = {
    "fx_qa": """
SELECT o.o_orderkey AS id, concat('Q', o.o_orderkey, ' ', o.o_orderpriority) AS question_text, concat('status ', o.o_orderstatus, ' for ', c.c_name) AS answer_text, n.n_name AS topic, concat('1145_', CASE WHEN month(o.o_orderdate) <= 4 THEN 'm' WHEN month(o.o_orderdate) <= 8 THEN 's' ELSE 'w' END, substring(cast(year(o.o_orderdate) AS varchar(4)), 3, 2), '_', cast(o.o_custkey % 3 AS varchar(4))) AS paper, concat(cast(o.o_orderkey % 40 AS varchar(8)), '(', o.o_orderstatus, ')') AS question_number, year(o.o_orderdate) AS year, CASE WHEN month(o.o_orderdate) <= 4 THEN 'S3' WHEN month(o.o_orderdate) <= 8 THEN 'S1' ELSE 'S2' END AS season, lower(c.c_mktsegment) AS command_verb, CASE WHEN substring(o.o_orderpriority,1,1) IN ('1','2') THEN 'advanced' WHEN substring(o.o_orderpriority,1,1) = '3' THEN 'intermediate' ELSE 'basic' END AS difficulty_estimate, coalesce(l.s, 0) AS success_count, coalesce(l.t, 0) AS total_attempts
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS s, count(*) AS t
FROM lineitem
GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
""",
    "fx_feedback": """
SELECT l_orderkey AS id, l_orderkey AS qa_id, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS covered_count, sum(CASE WHEN l_linestatus <> 'O' THEN 1 ELSE 0 END) AS missed_count, sum(CASE WHEN l_linestatus <> 'O' AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS knowledge_gap, sum(CASE WHEN l_linestatus <> 'O' AND l_returnflag = 'A' THEN 1 ELSE 0 END) AS insufficient_detail, sum(CASE WHEN l_linestatus <> 'O' AND l_returnflag = 'N' THEN 1 ELSE 0 END) AS misinterpretation, CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE 1 END AS topic_match
FROM lineitem
GROUP BY l_orderkey
""",
    "fx_members": """
SELECT l_orderkey AS qa_id, concat('kp_', lpad(cast(p.p_size AS varchar(4)), 4, '0')) AS kp_id, max(l_discount * 10) AS membership_strength
FROM lineitem
JOIN part p ON l_partkey = p.p_partkey
GROUP BY l_orderkey, p.p_size
""",
    "fx_links": """
SELECT cn.n_name AS src_topic, sn.n_name AS dst_topic, count(*) AS count
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation cn ON c.c_nationkey = cn.n_nationkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation sn ON s.s_nationkey = sn.n_nationkey
WHERE cn.n_name <> sn.n_name
GROUP BY cn.n_name, sn.n_name
""",
    "fx_help": """
SELECT concat('f_', cast(l_partkey AS varchar(12))) AS fragment_id, l_orderkey AS helped_qa_id, max(1 - l_discount) AS help_effect
FROM lineitem
GROUP BY l_partkey, l_orderkey
""",
    "fx_membership": """
SELECT concat('f_', cast(p_partkey AS varchar(12))) AS fragment_id, p_brand AS topic_id, CASE WHEN p_size % 4 = 0 THEN p_type ELSE NULL END AS previous_topic_id
FROM part
""",
    "fx_fragments": """
SELECT concat('f_', cast(l_partkey AS varchar(12))) AS point_id, min(l_orderkey) AS qa_id, cast(max(l_quantity) AS int) AS marks
FROM lineitem
GROUP BY l_partkey
""",
    "fx_trajectory": """
SELECT event_id AS id, user_id AS student_id, event_type AS kp_id, ts AS recorded_at
FROM events
""",
    "fx_confusions": """
SELECT event_id AS id, user_id AS student_id, concat('topic_', cast(event_id % 20 AS varchar(4))) AS topic, value > 20 AS resolved, ts AS created_at
FROM events
WHERE event_type = 'error'
""",
    "fx_states": """
SELECT user_id AS student_id, concat('topic_', cast(event_id % 20 AS varchar(4))) AS topic, max(CASE WHEN event_type = 'purchase' THEN 'mastered' ELSE 'learning' END) AS state, count(*) AS evidence_count
FROM events
GROUP BY user_id, event_id % 20
""",
    "fx_chat": """
SELECT conv_id AS session_id, turn, role, text AS content
FROM conversations
""",
    "fx_vectors": """
SELECT vec_id AS id, embedding AS vector, concat('topic_', cast(label AS varchar(4))) AS topic
FROM embeddings
""",
    "fx_text": """
SELECT doc_id AS id, split_part(text, chr(10), 1) AS question_text, text AS answer_text, source AS topic, lang
FROM documents
""",
    "fx_bus": """
SELECT event_type AS type, props AS payload, ts, user_id AS source
FROM events
""",
}


class Tables:
    """Base tables and domain views of one folder, loaded by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        words = set(VIEWS[name].split())
        for base in BASE:
            if base in words:
                self(base).createOrReplaceTempView(base)
        return self.spark.sql(VIEWS[name])


def with_views(sql: str) -> str:
    """``sql`` with the views it names as common table expressions in front."""
    names = [name for name in VIEWS if name in sql]
    if not names:
        return sql
    views = ", ".join(f"{name} AS ({VIEWS[name].strip()})" for name in names)
    head = sql.strip()
    if head.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {head[15:]}"
    return f"WITH {views}, {head[5:]}" if head.upper().startswith("WITH ") else f"WITH {views} {head}"
