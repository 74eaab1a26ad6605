"""The corpus pipeline: each stage takes (spark, docs, folder of tables) and returns a DataFrame.

In every stage a null text counts as empty, which has no near copies and holds no benchmark item; a null or repeated doc_id
changes nothing, as rows are told apart by file and place; extra columns of any name come along up to the last stage, which
drops them and returns repeated rows each. An empty table stays empty.

A stage's result is written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of ``documents``; the last returns each remaining document's tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import byte_bpe, decontaminate, exact_dedup, ngram_join, toxicity
from gradeloom.llm.folds import remainder
from gradeloom.llm.locators import Numbered
from gradeloom.session import scratch_path

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below one half; each row goes by its own text, whatever its id."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs.where(remainder(F.col("doc_id"), 5) != 0), labels.where(remainder(F.col("doc_id"), 5) != 0))
    rows = Numbered(docs)
    return rows.without(toxicity.scores(rows.keyed(), model).where(F.col("score") >= 0.5).select(F.col("doc_id").alias("number")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by a Jaccard similarity of 0.8 or more of 5-word shingles."""
    return ngram_join.one_of_each(docs, width=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row goes by its own text, whatever its id."""
    rows = Numbered(docs)
    leaks = decontaminate.contaminated(rows.keyed(), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.without(leaks.select(F.col("doc_id").alias("number")).distinct())


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as counts and digests, and the digest of what they decode to."""
    return byte_bpe.digests(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: SQL can express neither the trained classifier nor the tokenizer.
ORACLE_SQL = None
