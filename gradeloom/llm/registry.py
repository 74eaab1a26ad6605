"""The training-data queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat_query, decontaminate, exact_dedup, fim_chunks, language_mix, merkle, ngram_join, quality, surrogates, topk_search, toxicity, url_filter_query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item it holds 0.8 or more of, by 5-word shingles."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents, from the streaming state."""
    found = exact_dedup.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by keyed surrogates."""
    return surrogates.with_surrogates(table(spark, sf_dir, "documents"), key="gradeloom")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the multilingual byte-level vocabulary."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose distinct 3-word shingles have a Jaccard similarity of 0.9 or more, as components."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


_QUERIES = {f.__name__: f for f in (
    op1_benchmark_decontamination,
    url_filter_query.op2_url_filters,
    op3_exact_dedup,
    quality.op4_quality_classifier,
    toxicity.op5_toxicity_pu,
    chat_query.op6_chat_formatting,
    op7_pii_surrogates,
    op8_byte_bpe,
    op9_ngram_jaccard_join,
    language_mix.op10_language_mixture,
    merkle.op11_merkle_manifest,
    fim_chunks.op12_fill_in_middle,
    topk_search.op13_exact_topk,
)} | {"pipeline": corpus_pipeline.run}
_ORACLES: dict[str, str] = {
    "op2_url_filters": url_filter_query.ORACLE,
    "op6_chat_formatting": chat_query.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_fill_in_middle": fim_chunks.ORACLE,
    "op13_exact_topk": topk_search.ORACLE,
    "op3_exact_dedup": """
WITH folded AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM documents
), grouped AS (
  SELECT folded, max(doc_id) AS keep_id, count(*) AS group_size FROM folded GROUP BY folded
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(folded) AS text_sha256 FROM folded JOIN grouped USING (folded)
""",
}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
