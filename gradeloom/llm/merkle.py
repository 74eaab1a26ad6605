"""A Merkle manifest of a dataset: every row is a leaf, every source a tree, and the sources' roots a tree of their own.

Nodes of a tree stand in a row, numbered from 0. While more than one is left, every ``ARITY`` consecutive ones
(the last run may have fewer, even one) are hashed into one. A tree is built in blocks of ``ARITY ** LEVELS`` nodes:
a block's nodes lie in one window partition, and at level k, whose nodes are the rows ``ARITY ** k`` apart, lag and
lead columns of that fixed offset are the siblings, masked by the slot in the run and the run's length; the first
row of a run hashes the parent. One round of blocks is one shuffle and one sort, and leaves a row for each block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeloom.session import stored

from .folds import remainder
from .locators import strategy

ARITY = 3
LEVELS = 6
BLOCK = ARITY**LEVELS


def leaf(*values: Column) -> Column:
    """Digest of a row's values: each is ``-`` if null, else its length in bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, from 0 by ``order`` within the non-null ``group``, and ``n``, the group's rows.

    Rows are dealt by ranges of group and order, so a large group lies in many tasks; what a task holds of a
    group is counted, and the counts before it are added up. Nulls of ``order`` come first.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    dealt = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    kept = stored(dealt.withColumn("at", F.monotonically_increasing_id()), "numbered")
    task = F.shiftright("at", 33)  # the id's upper bits
    parts = kept.groupBy(*group, task.alias("task")).agg(F.min("at").alias("least"), F.count("*").alias("m"))
    all_ = W.partitionBy(*group)  # a row for each task at most
    before = F.sum("m").over(all_.orderBy("task")) - F.col("m")
    parts = stored(parts.select(*group, "task", (before - F.col("least")).alias("shift"), F.sum("m").over(all_).alias("n")), "parts")
    found = kept.withColumn("task", task).join(strategy(parts), [*group, "task"])
    return found.select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "n")


def _levels(nodes: DataFrame, group: Sequence[str]) -> DataFrame:
    """``nodes`` in blocks, with a column ``step_k`` for each level (what stands before and after the node in its run;
    null in rows that are no node of the level, and where one node is left) and ``top``, the block's node above."""
    over = f"OVER (PARTITION BY {', '.join(group)}, block ORDER BY pos)"
    rows = nodes.withColumn("top", F.col("node"))
    for level in range(LEVELS):
        span = ARITY**level
        far = range(1, ARITY)
        rows = rows.selectExpr("*", *(f"{f}(top, {k * span}) {over} AS {f}_{k}" for f in ("lag", "lead") for k in far))
        slot, size = f"pos DIV {span} % {ARITY}", f"ceil(n / {span})"
        behind = f"{size} - pos DIV {span} > "  # nodes of the level from this one on; a run's are cut by its slot
        before = "concat(" + ", ".join(f"if({slot} >= {k}, lag_{k}, '')" for k in reversed(far)) + ")"
        after = "concat(" + ", ".join(f"if({slot} + {k} < {ARITY} AND {behind}{k}, lead_{k}, '')" for k in far) + ")"
        step = f"if(pos % {span} = 0 AND {size} > 1, struct({before} AS before, {after} AS after), NULL)"
        parent = f"if({size} > 1, sha2(concat({before}, top, {after}), 256), top)"
        names = [c for c in rows.columns if c != "top" and not c.startswith(("lag_", "lead_"))]
        rows = rows.selectExpr(*names, f"{step} AS step_{level}", f"if(pos % {span * ARITY} = 0, {parent}, NULL) AS top")
    return rows


def climb(nodes: DataFrame, group: Sequence[str]) -> list[DataFrame]:
    """The rounds of the trees over ``nodes(*group, pos, n, node)``: the nodes themselves, then the nodes above their
    blocks, and so on; the last has a row for each group, its root."""
    rounds, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        most = -(-most // BLOCK)
        rows = _levels(rounds[-1].withColumn("block", F.floor(F.col("pos") / BLOCK)), group).where(F.col("pos") % BLOCK == 0)
        up = rows.select(*group, F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("node"))
        rounds.append(stored(up, "nodes"))
    return rounds


def descend(rounds: list[DataFrame], group: Sequence[str], above: DataFrame) -> DataFrame:
    """The nodes of the first round with their ``proof`` up to the group's root, followed by the proof in
    ``above(*group, proof, ...)``, whose other columns come along."""
    carried = [c for c in above.columns if c not in group]
    above = above.withColumn("pos", F.lit(0).cast("long"))
    for nth in range(len(rounds) - 2, -1, -1):
        blocks = above.select(*group, F.col("pos").alias("block"), *carried).withColumnRenamed("proof", "upper")
        rows = _levels(rounds[nth].withColumn("block", F.floor(F.col("pos") / BLOCK)).join(blocks.hint("merge"), [*group, "block"]), group)
        so_far = W.partitionBy(*group, "block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
        own = F.array_compact(F.array(*(F.last(f"step_{k}", ignorenulls=True).over(so_far) for k in range(LEVELS))))
        above = rows.select(*rounds[nth].columns, F.concat(own, "upper").alias("proof"), *(c for c in carried if c != "proof"))
        if nth:
            above = stored(above, "proofs")
    if len(rounds) == 1:
        above = rounds[0].join(above.drop("pos").hint("merge"), list(group))
    return above


def manifest(rows: DataFrame) -> DataFrame:
    """``rows(source, doc_id, leaf, ...)`` with ``subroot`` (of the source), ``root`` (of all) and ``proof``, the siblings from
    the leaf to the root as (before, after) of each level.

    Leaves of a source ascend by doc_id, a null one first, equal ids by their digests; so repeated rows are leaves of
    their own. Sources ascend bytewise, null first, as a group of its own. No rows, no root. Further columns stay, but for
    the names used here (``none``, ``key``, ``all``, ``at``, ``pos``, ``n``, ``node``, ``block``, ``top``).
    """
    of_source, of_all = ["none", "key"], ["all"]
    named = rows.withColumns({"none": F.col("source").isNotNull(), "key": F.coalesce("source", F.lit("")), "node": F.col("leaf")})  # null sorts first
    leaves = climb(numbered(stored(named, "leaves"), of_source, ["doc_id", "leaf"]), of_source)
    subroots = leaves[-1].select(*of_source, "node", F.lit(0).alias("all"))
    sources = climb(numbered(subroots, of_all, of_source), of_all)
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    root = sources[-1].select("all", F.col("node").alias("root"), nothing.alias("proof"))
    upper = stored(descend(sources, of_all, root).select(*of_source, "proof", "root", F.col("node").alias("subroot")), "sources")
    return descend(leaves, of_source, upper).select(*rows.columns, "proof", "subroot", "root")


def root_of(leaf_: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf_, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of a proof: of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, verified after every second document (by crc32 of its id) lost its line breaks.

    A null id has no checksum, so such a document isn't tampered with.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = lambda text: leaf(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text)
    tampered = F.when(remainder(F.col("doc_id"), 2) == 0, fields(F.translate("text", "\n", "")))
    found = manifest(docs.select("source", "doc_id", fields(F.col("text")).alias("leaf"), tampered.alias("tampered")))
    folded = root_of(F.coalesce("tampered", "leaf"), F.col("proof"))
    rows = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {text})"
#: crc32 of the id's digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ascii(d)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)))"""
_RUN = "string_agg(node, '' ORDER BY idx)"
ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_LEAF.format(text=_FIELD.format("text"))} AS leaf,
    CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF.format(text=_FIELD.format("replace(text, chr(10), '')"))} END AS tampered FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves
), nodes AS (
  SELECT source, 0 AS level, pos AS idx, n, leaf AS node FROM placed
  UNION ALL SELECT source, level + 1, idx // 3, (n + 2) // 3, sha256({_RUN}) FROM nodes WHERE n > 1 GROUP BY source, level, n, idx // 3
), subroots AS (
  SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, pos AS idx, n, node FROM subroots
  UNION ALL SELECT level + 1, idx // 3, (n + 2) // 3, sha256({_RUN}) FROM tops WHERE n > 1 GROUP BY level, n, idx // 3
), root AS (SELECT node AS root FROM tops WHERE n = 1
), steps AS (
  SELECT p.source, p.pos, a.level, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM placed p JOIN nodes a ON a.source IS NOT DISTINCT FROM p.source AND a.n > 1 AND a.idx = p.pos // CAST(pow(3, a.level) AS BIGINT)
  JOIN nodes b ON b.source IS NOT DISTINCT FROM p.source AND b.level = a.level AND b.idx // 3 = a.idx // 3 GROUP BY 1, 2, 3
  UNION ALL
  SELECT p.source, p.pos, 1000 + a.level, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx < a.idx), ''), coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '')
  FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN tops a ON a.n > 1 AND a.idx = s.pos // CAST(pow(3, a.level) AS BIGINT)
  JOIN tops b ON b.level = a.level AND b.idx // 3 = a.idx // 3 GROUP BY 1, 2, 3
), proofs AS (SELECT source, pos, list(before ORDER BY level) AS before, list(after ORDER BY level) AS after, string_agg(before || after, '' ORDER BY level) AS siblings FROM steps GROUP BY 1, 2
), folds AS (
  SELECT p.source, p.pos, 1 AS nth, coalesce(tampered, leaf) AS node, before, after FROM placed p LEFT JOIN proofs f ON f.source IS NOT DISTINCT FROM p.source AND f.pos = p.pos
  UNION ALL SELECT source, pos, nth + 1, sha256(before[nth] || node || after[nth]), before, after FROM folds WHERE nth <= len(before)
), ended AS (SELECT source, pos, arg_max(node, nth) AS folded_root FROM folds GROUP BY 1, 2)
SELECT doc_id, leaf, s.node AS subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN ended e ON e.source IS NOT DISTINCT FROM p.source AND e.pos = p.pos
LEFT JOIN proofs f ON f.source IS NOT DISTINCT FROM p.source AND f.pos = p.pos, root
"""
