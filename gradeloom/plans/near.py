"""Vector operators over the embeddings, and what is built on them."""

from pyspark.sql import functions as F

from gradeloom.functions import extension
from gradeloom.operators import graph
from gradeloom.operators import vectors as vec
from gradeloom.plans import query

_DOT = "list_dot_product(a.vector::DOUBLE[], b.vector::DOUBLE[])"
_PAIRS = f"pairs AS (SELECT a.id AS a, b.id AS b, {_DOT} AS cosine FROM fx_vectors a JOIN fx_vectors b ON a.id < b.id)"
_COMPONENTS = """walk AS (SELECT id, id AS other FROM fx_vectors UNION SELECT w.id, e.y FROM walk w JOIN e ON e.x = w.other)"""


def _topics(t):
    """One vector and a size for each label."""
    rows = t("fx_vectors").groupBy("topic").agg(F.min_by("vector", "id").alias("vector"), F.count("*").alias("n"))
    return rows


@query(f"WITH {_PAIRS} SELECT a, b, round_even(cosine, 5) AS cosine FROM pairs WHERE cosine >= 0.35")
def v1_cosine_pairs(t):
    return vec.cosine_pairs(t("fx_vectors"), 0.35).withColumn("cosine", F.bround("cosine", 5))


@query(f"""WITH s AS (SELECT b.id AS query_id, a.id, {_DOT} AS score FROM fx_vectors a JOIN fx_vectors b ON b.id % 100 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM s)
SELECT query_id, id, round_even(score, 5) AS score, nth FROM n WHERE nth <= 15 AND (score >= 0.5 OR nth <= 3)""")
def v2_search(t):
    queries = t("fx_vectors").where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    return vec.search(t("fx_vectors"), queries).withColumn("score", F.bround("score", 5))


@query("""WITH c AS (SELECT id, vector::DOUBLE[] AS v, n_name AS topic, f.topic AS text, id + 1 AS qa_id FROM fx_vectors f JOIN nation ON n_nationkey = id % 25), q AS (SELECT id AS query_id, v, topic, text FROM c WHERE id % 100 = 0),
d AS (SELECT query_id, c.id, list_dot_product(c.v, q.v) AS score FROM c, q), a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM d QUALIFY nth <= 30),
tops AS (SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY id) AS rank FROM c), adj AS (SELECT src_topic AS topic, dst_topic AS adjacent FROM fx_links UNION SELECT dst_topic, src_topic FROM fx_links),
near AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY adjacent) AS nth FROM adj QUALIFY nth <= 5), seeds AS (SELECT DISTINCT query_id, qa_id FROM a JOIN c USING (id) WHERE nth <= 15),
hb AS (SELECT DISTINCT query_id, qa_id, helped_qa_id FROM seeds JOIN fx_fragments USING (qa_id) JOIN fx_help ON fragment_id = point_id),
walk AS (SELECT DISTINCT query_id, o.qa_id AS other FROM hb JOIN fx_help h USING (helped_qa_id) JOIN fx_fragments o ON o.point_id = h.fragment_id WHERE o.qa_id <> hb.qa_id),
w AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS nth FROM walk JOIN c ON qa_id = other QUALIFY nth <= 30),
b AS ((SELECT query_id, id FROM q JOIN tops USING (topic) WHERE rank <= 20 UNION SELECT query_id, id FROM q JOIN near USING (topic) JOIN tops ON tops.topic = adjacent AND rank <= 10 UNION SELECT query_id, id FROM w) EXCEPT SELECT query_id, id FROM a),
beh AS (SELECT query_id, f.qa_id, least(count(*) / 10.0, 1.0) AS behavior FROM fx_fragments f JOIN fx_help ON fragment_id = point_id JOIN (SELECT DISTINCT query_id, helped_qa_id FROM hb) USING (helped_qa_id) GROUP BY 1, 2),
r AS (SELECT query_id, id, score FROM a UNION ALL SELECT query_id, id, 0.0 FROM b),
s AS (SELECT r.query_id, r.id, 0.35 * score + 0.35 * CASE WHEN q.topic = c.topic THEN 1.0 WHEN adjacent IS NOT NULL THEN 0.5 ELSE 0.0 END + 0.20 * coalesce(behavior, 0.0) + 0.10 * CASE WHEN q.text = c.text THEN 1.0 ELSE 0.0 END AS score
  FROM r JOIN c USING (id) JOIN q ON q.query_id = r.query_id LEFT JOIN beh ON beh.query_id = r.query_id AND beh.qa_id = c.qa_id LEFT JOIN adj ON adj.topic = q.topic AND adjacent = c.topic)
SELECT query_id, id, round_even(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM s QUALIFY nth <= 15 AND (s.score >= 0.5 OR nth <= 3)""")
def v3_search_dual(t):
    nation = t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("topic"))
    corpus = t("fx_vectors").select("id", "vector", (F.col("id") % 25).cast("int").alias("key"), F.col("topic").alias("text"), (F.col("id") + 1).alias("qa_id")).join(nation, "key")
    queries = corpus.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector", "topic", "text")
    return vec.search_dual(corpus, queries, t("fx_links"), t("fx_fragments"), t("fx_help")).withColumn("score", F.bround("score", 5))


@query("""WITH w AS (SELECT p_partkey AS id, list_distinct(list_filter(string_split(lower(p_type || ' ' || p_name), ' '), lambda x: x <> '')) AS words FROM part)
SELECT a.id AS a, b.id AS b, len(list_intersect(a.words, b.words)) / CAST(greatest(len(list_distinct(list_concat(a.words, b.words))), 1) AS DOUBLE) AS jaccard FROM w a JOIN w b ON b.id = a.id + 1""")
def v4_keyword_jaccard(t):
    a = t("part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), F.concat_ws(" ", "p_type", "p_name").alias("text_a"))
    b = t("part").select(F.col("p_partkey").alias("b"), F.concat_ws(" ", "p_type", "p_name").alias("text_b"))
    return a.join(b, "b").select("a", "b", vec.keyword_jaccard(F.col("text_a"), F.col("text_b")).alias("jaccard"))


@query()
def v5_greedy_clusters(t):
    return vec.greedy_clusters(t("fx_vectors"), 0.3, least=2)


@query(f"WITH RECURSIVE {_PAIRS}, e AS (SELECT a AS x, b AS y FROM pairs WHERE cosine >= 0.6 UNION ALL SELECT b, a FROM pairs WHERE cosine >= 0.6), {_COMPONENTS} SELECT id, min(other) AS component FROM walk GROUP BY id")
def v6_components(t):
    return vec.components(vec.cosine_pairs(t("fx_vectors"), 0.6), t("fx_vectors"))


@query("""WITH x AS (SELECT id, topic, unnest(vector) AS x, unnest(range(64)) AS pos FROM fx_vectors), m AS (SELECT topic, pos, avg(x::DOUBLE) AS m FROM x GROUP BY 1, 2), n AS (SELECT topic, sqrt(sum(m * m)) AS size FROM m GROUP BY 1)
SELECT topic AS cluster, id, round_even(sum(x::DOUBLE * m) / any_value(size), 3) AS strength FROM x JOIN m USING (topic, pos) JOIN n USING (topic) GROUP BY topic, id""")
def v7_cluster_stats(t):
    rows = t("fx_vectors")
    return vec.cluster_stats(rows.select("id", "vector"), rows.select("id", F.col("topic").alias("cluster"))).select("cluster", "id", "strength")


@query()
def v8_geometric_median(t):
    rows = t("fx_vectors").withColumn("weight", F.lit(1.0))
    return vec.geometric_median(rows, "topic").select("topic", F.bround(vec.norm("median"), 4).alias("size"), F.transform("median", lambda x: F.bround(x.cast("double"), 4)).alias("median"))


@query("""WITH x AS (SELECT id, topic, unnest(vector) AS x, unnest(range(len(vector))) AS pos FROM fx_vectors), m AS (SELECT topic, pos, avg(x::DOUBLE) AS m FROM x GROUP BY 1, 2), n AS (SELECT topic, sqrt(sum(m * m)) AS size FROM m GROUP BY 1),
d AS (SELECT topic, id, 1 - sum(x::DOUBLE * m) / any_value(size) AS distance FROM x JOIN m USING (topic, pos) JOIN n USING (topic) GROUP BY topic, id),
w AS (SELECT *, avg(distance) OVER (PARTITION BY topic) AS mean, stddev_pop(distance) OVER (PARTITION BY topic) AS sd, count(*) OVER (PARTITION BY topic) AS held FROM d)
SELECT topic, id FROM w WHERE held >= 5 AND sd >= 0.01 AND distance > mean + sd AND distance > 0.25""")
def v9_outlier_qas(t):
    return vec.outlier_qas(t("fx_vectors"), sigmas=1.0).select("topic", "id")


@query(f"WITH {_PAIRS} SELECT a AS source, b AS target, round_even(cosine, 5) AS cosine, CASE WHEN cosine >= 0.65 THEN 'medium' ELSE 'low' END AS confidence FROM pairs WHERE cosine >= 0.5")
def v10_semantic_edges(t):
    return vec.semantic_edges(t("fx_vectors")).withColumn("cosine", F.bround("cosine", 5))


def _lines(t):
    return t("fx_vectors").select("id", "topic", "vector", F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))


@query()
def v11_discover_pitfalls(t):
    return vec.discover_pitfalls(_lines(t).withColumnRenamed("topic", "kp_id"), tau=0.3, least=2)


@query()
def v12_missed_patterns(t):
    return vec.missed_patterns(_lines(t), _topics(t), near=0.1, tau=0.3)


@query("""WITH first AS (SELECT topic, arg_min(vector, id) AS v FROM fx_vectors WHERE topic <> 'topic_3' GROUP BY topic)
SELECT id, f.topic, coalesce(list_dot_product(vector::DOUBLE[], v::DOUBLE[]) >= 0.4, FALSE) AS relevant FROM fx_vectors f LEFT JOIN first ON first.topic = f.topic""")
def v13_pitfall_relevance(t):
    return vec.pitfall_relevance(t("fx_vectors"), _topics(t).where("topic <> 'topic_3'"))


@query()
def v14_topic_merge_plan(t):
    rows = t("fx_vectors").select(F.format_string("t%012d", "id").alias("topic"), "vector", (F.col("id") % 7).alias("n"))
    return vec.topic_merge_plan(rows, tau=0.35)[0]


@query("SELECT greatest(src_topic, dst_topic) AS old, min(least(src_topic, dst_topic)) AS new FROM fx_links WHERE length(src_topic) = length(dst_topic) GROUP BY 1")
def v15_apply_merge_verdicts(t):
    a, b = F.col("src_topic"), F.col("dst_topic")
    return vec.apply_merge_verdicts(t("fx_links").select(a.alias("topic_a"), b.alias("topic_b"), (F.length(a) == F.length(b)).alias("merge"), F.least(a, b).alias("canonical")))


_CHAIN = "chain AS (SELECT 'n' || p_partkey AS old, 'n' || (p_partkey // 2) AS new FROM part WHERE p_partkey > 0)"


def _chain(t):
    return t("part").where("p_partkey > 0").select(F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("old"), F.concat(F.lit("n"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("new"))


@query(f"WITH {_CHAIN} SELECT old, 'n0' AS new FROM chain")
def v16_resolve_chains(t):
    return graph.resolve_chains(_chain(t))


@query("WITH m AS (SELECT CASE src_topic WHEN 'CHINA' THEN 'JAPAN' ELSE src_topic END AS src_topic, CASE dst_topic WHEN 'CHINA' THEN 'JAPAN' ELSE dst_topic END AS dst_topic, count FROM fx_links) SELECT src_topic, dst_topic, CAST(sum(count) AS BIGINT) AS count FROM m WHERE src_topic <> dst_topic GROUP BY 1, 2")
def v17_rewrite_links(t):
    return graph.rewrite_links(t("fx_links"), t("nation").where("n_name = 'CHINA'").select(F.col("n_name").alias("old"), F.lit("JAPAN").alias("new")))


@query()
def v18_assign_emergent(t):
    """Every tenth vector is a member of a point that is there before; the others arrive in order."""
    from gradeloom.streaming import events

    rows = t("fx_vectors").select(F.concat("topic", F.lit("_"), F.floor(F.col("id") / 1000).cast("string")).alias("subject"), F.col("id").alias("seq"), "id", "vector")
    members = rows.where("id % 10 = 0").withColumn("kp_id", F.concat(F.lit("kp_"), (F.col("id") % 30).cast("string")))
    points = members.groupBy("subject", "kp_id").agg(F.min_by("vector", "id").alias("vector"), F.lit("stable").alias("quality"))
    found = events.assign_emergent(events.arrivals(rows.where("id % 10 > 0"), points, members), floor=0.2)
    return events.with_quality(found, members=members)


@query(f"""WITH s AS (SELECT a.topic AS kp_id, {_DOT} AS sim FROM fx_vectors a JOIN fx_vectors b ON a.topic = b.topic AND a.id < b.id), m AS (SELECT kp_id, median(sim) AS med FROM s GROUP BY 1), d AS (SELECT kp_id, any_value(med) AS med, median(abs(sim - med)) AS mad FROM s JOIN m USING (kp_id) GROUP BY 1)
SELECT topic AS kp_id, count(*) AS n, round_even(CASE WHEN count(*) >= 3 THEN greatest(0.05, any_value(med) - any_value(mad)) ELSE 0.05 END, 5) AS threshold FROM fx_vectors LEFT JOIN d ON d.kp_id = topic GROUP BY topic""")
def v19_kp_thresholds(t):
    return vec.kp_thresholds(t("fx_vectors").withColumnRenamed("topic", "kp_id"), floor=0.05).withColumn("threshold", F.bround("threshold", 5))


@query("""WITH RECURSIVE s AS (SELECT id // 4 AS kp_id, CAST(id % 4 AS INT) AS nth, vector::DOUBLE[] AS v FROM fx_vectors),
fold AS (SELECT id AS kp_id, 0 AS nth, vector::DOUBLE[] AS c FROM fx_vectors UNION ALL SELECT kp_id, nth + 1, list_transform(c, lambda x: x / size)
FROM (SELECT kp_id, nth, c, sqrt(list_dot_product(c, c)) AS size FROM (SELECT f.kp_id, f.nth, list_transform(f.c, lambda x, i: [1.0, 1.0, 1.0, 0.5][f.nth + 1] * x + [0.05, -0.02, 0.03, 0.5][f.nth + 1] * s.v[i]) AS c FROM fold f JOIN s ON s.kp_id = f.kp_id AND s.nth = f.nth))),
ended AS (SELECT kp_id, arg_max(c, nth) AS c FROM fold GROUP BY kp_id)
SELECT kp_id, unnest(range(len(c))) AS at, round_even(unnest(c), 4) + 0.0 AS x FROM ended""")
def v20_apply_signals(t):
    rows = t("fx_vectors").select(F.col("id").alias("kp_id"), "vector")
    kind = F.element_at(F.array(*map(F.lit, ("help", "hurt", "post", "user"))), (F.col("id") % 4).cast("int") + 1)
    signals = t("fx_vectors").select(F.floor(F.col("id") / 4).alias("kp_id"), F.col("id").alias("seq"), kind.alias("kind"), "vector")
    found = vec.apply_signals(rows, signals).select("kp_id", F.posexplode("vector").alias("at", "x"))
    return found.select("kp_id", F.col("at").cast("long").alias("at"), (F.bround("x", 4) + 0.0).alias("x"))


@query("""WITH m AS (SELECT id AS kp_id, id % 5 AS n FROM fx_vectors) SELECT kp_id, CASE WHEN n >= 3 THEN 'stable' ELSE 'embryonic' END AS quality, CASE WHEN n < 3 THEN 0.95 ELSE 1.0 END AS size FROM m""")
def v21_decay_and_promote(t):
    kps = t("fx_vectors").select(F.col("id").alias("kp_id"), "vector", F.lit("embryonic").alias("quality"))
    members = t("fx_vectors").where("id % 5 > 0").select(F.col("id").alias("kp_id"), F.explode(F.sequence(F.lit(1), (F.col("id") % 5).cast("int"))).alias("qa_id"))
    return vec.decay_and_promote(kps, members).select("kp_id", "quality", F.bround(vec.norm("vector"), 3).alias("size"))


@query(f"SELECT a.id AS a, b.id AS b, round_even({_DOT}, 4) AS cosine FROM fx_vectors a JOIN fx_vectors b ON b.id = a.id + 1")
def v22_compare_kps(t):
    last = t("fx_vectors").agg(F.max("id")).first()[0]
    pairs = t("fx_vectors").where(F.col("id") < last).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return vec.compare_kps(t("fx_vectors"), pairs).withColumn("cosine", F.bround("cosine", 4))


@query("""WITH k AS (SELECT kp_id FROM fx_members GROUP BY 1 ORDER BY count(*) % 7 DESC, kp_id LIMIT 50),
b AS (SELECT qa_id, max((membership_strength, kp_id)) AS x FROM fx_members JOIN k USING (kp_id) WHERE membership_strength >= 0.3 GROUP BY 1)
SELECT qa_id, x[2] AS kp_id, 'about ' || x[2] AS topic, CASE WHEN x[1] >= 0.8 THEN 0.8 WHEN x[1] >= 0.5 THEN 0.5 ELSE 0.2 END AS centrality FROM b""")
def v23_place_qa(t):
    kps = t("fx_members").groupBy("kp_id").agg((F.count("*") % 7).alias("evidence"))
    kps = kps.select("kp_id", F.lit("").alias("name"), F.concat(F.lit("about "), "kp_id").alias("description"), "evidence")
    return vec.place_qa(t("fx_members").withColumnRenamed("membership_strength", "score"), kps)


@query("""WITH r AS (SELECT q.topic, o.topic AS other FROM (SELECT min(id) AS id, topic FROM fx_qa WHERE topic NOT IN (SELECT src_topic FROM fx_links WHERE dst_topic < 'F' UNION SELECT dst_topic FROM fx_links WHERE dst_topic < 'F') GROUP BY topic) q JOIN fx_qa o ON o.id % 97 = q.id % 97)
SELECT topic, other, count(*) AS count FROM r WHERE topic <> other GROUP BY 1, 2""")
def v24_topic_related(t):
    first = t("fx_qa").groupBy("topic").agg(F.min("id").alias("first"))
    results = first.select(F.col("topic").alias("query_id"), (F.col("first") % 97).alias("k")).join(t("fx_qa").select("id", (F.col("id") % 97).alias("k")), "k").select("query_id", "id")
    return vec.topic_related(first, results, t("fx_qa"), t("fx_links").where("dst_topic < 'F'"))


@query()
def x1_register_encoder(t):
    """Documents as vectors of the default encoder, and how like the next one each is by either registered comparison."""
    texts = t("documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = texts.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    likes = [vec.compare_kps(extension.encode(texts, encoder=name), pairs, name) for name in ("hashing", "features")]
    vectors = extension.encode(texts).select("id", F.transform("vector", lambda x: F.bround(x.cast("double"), 4)).alias("vector"))
    cosine, overlap = (df.select(F.col("a").alias("id"), F.bround("similarity", 5).alias(df_name)) for df, df_name in zip(likes, ("cosine_next", "overlap_next")))
    return vectors.join(cosine.hint("merge"), "id", "left").join(overlap.hint("merge"), "id", "left").withColumnRenamed("id", "doc_id")


@query("SELECT id AS kp_id, 1.0 AS size FROM fx_vectors")
def x2_register_signal(t):
    extension.register_signal("echo", 1.0, 1.0)
    rows = t("fx_vectors").select(F.col("id").alias("kp_id"), "vector")
    signals = t("fx_vectors").select(F.col("id").alias("kp_id"), F.lit(1).alias("seq"), F.lit("echo").alias("kind"), "vector")
    return vec.apply_signals(rows, signals).select("kp_id", F.bround(vec.norm("vector"), 3).alias("size"))
