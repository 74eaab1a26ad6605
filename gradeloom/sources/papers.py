"""Paper files: names, pairs, sessions, what is left to process, and question rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = r"(?i)^(.+)_(qp|ms)_(.+)$"
_SESSION = r"^(\d+)_([smw])(\d{2})_(\d+)"
#: Season letter -> session code.
SEASONS = {"s": "S1", "w": "S2", "m": "S3"}
UNKNOWN_YEAR = 9999


def scan(spark: SparkSession, path: str, schema=None, order_by=None, limit: int | None = None) -> DataFrame:
    """A table with an explicit schema where one is given, optionally ordered and cut."""
    df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    df = df.orderBy(order_by) if order_by is not None else df
    return df.limit(limit) if limit is not None else df


def parse_paper_names(files: DataFrame, name: str = "file_name") -> DataFrame:
    """``prefix, doc_type, number`` of names like ``<prefix>_qp_<number>``; other names are dropped."""
    part = lambda k: F.regexp_extract(name, _NAME, k)
    return files.where(F.col(name).rlike(_NAME)).select("*", part(1).alias("prefix"), F.lower(part(2)).alias("doc_type"), part(3).alias("number"))


def pair_papers(files: DataFrame, name: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """Question papers with their mark schemes, and files without a partner."""
    both = parse_paper_names(files, name).groupBy("prefix", "number").pivot("doc_type", ["qp", "ms"]).agg(F.max(name))
    pairs = both.where("qp is not null and ms is not null")
    return pairs, both.where("qp is null or ms is null").select("prefix", "number", F.coalesce("qp", "ms").alias(name))


def session_parts(display: Column) -> tuple[Column, Column, Column]:
    """Subject, season code and year (9999 if unknown) of a display name like ``1145_s19_1``."""
    known = display.rlike(_SESSION)
    codes = F.create_map(*(F.lit(x) for pair in SEASONS.items() for x in pair))
    year = F.regexp_extract(display, _SESSION, 3).try_cast("int") + 2000
    return (
        F.when(known, F.regexp_extract(display, _SESSION, 1)),
        F.when(known, codes[F.regexp_extract(display, _SESSION, 2)]),
        F.when(known, year).otherwise(UNKNOWN_YEAR),
    )


def exam_sessions(papers: DataFrame, name: str = "paper") -> DataFrame:
    """One row for each distinct session that a paper name gives."""
    subject, season, year = session_parts(F.col(name))
    rows = papers.select(subject.alias("subject_code"), season.alias("season"), year.alias("year"), F.col(name).alias("display_name"))
    return rows.where("subject_code is not null").dropDuplicates(["subject_code", "season", "year", "display_name"])


def pending_papers(papers: DataFrame, processed: DataFrame, name: str = "paper") -> DataFrame:
    """Papers that aren't processed yet, by year (unknown years last)."""
    left = papers.select(name).distinct().join(processed.select(name), name, "left_anti")
    return left.withColumn("year", session_parts(F.col(name))[2]).orderBy("year", name)


def qa_from_pairs(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with their answers by paper and number; a missing number is the position, a missing
    parent the number."""
    number = F.coalesce(F.nullif(F.col("question_number"), F.lit("")), F.col("position").cast("string"))
    rows = questions.withColumn("question_number", number).join(answers.withColumn("question_number", number).drop("position"), ["paper", "question_number"])
    return rows.withColumn("parent_question", F.coalesce(F.nullif(F.col("parent_question"), F.lit("")), "question_number"))
