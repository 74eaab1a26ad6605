"""Rows named by the file and row that hold them: ids may be null or repeated."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.session import stored

LOCATOR = ("file", "row")
MAX_BROADCAST_ROWS = 200_000


def with_files(docs: DataFrame) -> DataFrame:
    """``docs`` itself if its rows come from files that can be named, else a stored copy that does."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        return stored(docs, "docs")
    return docs


def locators(docs: DataFrame) -> list[Column]:
    at = docs.metadataColumn("_metadata")
    return [at["file_path"].alias("file"), at["row_index"].alias("row")]


def strategy(df: DataFrame, bound: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast a table that a count shows to be within its bound, else sort and merge."""
    return df.hint("broadcast" if df.limit(bound + 1).count() <= bound else "merge")


#: Files of a table whose numbers are broadcast; rows of a file that a number can tell apart.
MAX_FILES = 1_000_000
ROW_BITS = 40


class Numbered:
    """The rows of a table by a long each: the number of the file, by path, and the place in it."""

    def __init__(self, docs: DataFrame):
        self.docs = with_files(docs)
        paths = stored(self.docs.select(self.docs.metadataColumn("_metadata")["file_path"].alias("path")).distinct(), "paths")
        nth = F.row_number().over(Window.orderBy("path"))  # a row for each file
        self.files = stored(paths.select("path", nth.cast("long").alias("nth")), "files")

    def _with_number(self, *columns: Column) -> DataFrame:
        at = self.docs.metadataColumn("_metadata")
        number = (F.shiftleft(self.files["nth"], ROW_BITS) + at["row_index"]).alias("number")
        return self.docs.join(strategy(self.files, MAX_FILES), at["file_path"] == self.files["path"]).select(*columns, number)

    def keyed(self) -> DataFrame:
        """``(doc_id, text)`` with the row's number for doc_id."""
        return self._with_number(self.docs["text"]).select(F.col("number").alias("doc_id"), "text")

    def ids(self) -> DataFrame:
        """``(number, doc_id)``."""
        return self._with_number(self.docs["doc_id"]).select("number", "doc_id")

    def without(self, drop: DataFrame) -> DataFrame:
        """The rows whose numbers aren't in ``drop(number)``, with all their columns."""
        drop = stored(drop.select(F.col("number").alias("drop_number")), "drop")
        at = self.docs.metadataColumn("_metadata")
        gone = drop.join(self.files.hint("merge"), F.shiftright("drop_number", ROW_BITS) == F.col("nth"))
        gone = stored(gone.select(F.col("path").alias("drop_path"), (F.col("drop_number") - F.shiftleft("nth", ROW_BITS)).alias("drop_row")), "gone")
        same = (at["file_path"] == gone["drop_path"]) & (at["row_index"] == gone["drop_row"])
        return self.docs.join(strategy(gone), same, "left_anti").select(*(self.docs[c] for c in self.docs.columns))


def without_rows(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """The rows of ``with_files(docs)`` that aren't in ``drop(file, row)``, with all their columns."""
    drop = stored(drop.select(*(F.col(c).alias(f"drop_{c}") for c in LOCATOR)), "drop")
    at = docs.metadataColumn("_metadata")
    same = (at["file_path"] == drop["drop_file"]) & (at["row_index"] == drop["drop_row"])
    return docs.join(strategy(drop), same, "left_anti").select(*(docs[c] for c in docs.columns))
