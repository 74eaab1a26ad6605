"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Test items are short and documents long, so a Jaccard-style signature of a whole document says
little about an item inside it. Items are therefore partitioned by size (powers of two of their
shingle count). An item keeps a *bottom-m MinHash sketch*: its ``m = n - ceil(t n) + 1`` least hashes
under one random permutation. A document that holds a share ``t`` of the item's shingles lacks at
most ``n - ceil(t n)`` of them, so it holds at least one of any ``m``: the search loses nothing. Each
size partition has a hash ceiling, its largest sketch value, and a document's sketch for the
partition is its own hashes below that ceiling. Candidates share a sketch value within a partition;
they count only after exact containment over all shingles.

Documents are read once. Two bit tables of fixed size (``TABLE_BITS``), built by a distributed OR
over the items' hashes, go to the tasks, so that only documents with a possible hit leave them.
However many items there are, the tables keep their size: they only filter less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.session import stored

from .batches import bounded_batches
from .hashing import NOT_ALNUM, set_digest, shingle_sets, utf8, word_spans

TABLE_BITS = 1 << 23


def _short_widths(items: DataFrame, width: int) -> list[int]:
    """Numbers of words below ``width`` that occur among the items."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            _, _, of = word_spans(data, offsets, NOT_ALNUM)
            found |= set(np.bincount(of, minlength=1).tolist()) & set(range(1, width))
        yield pa.record_batch([pa.array(sorted(found), pa.int32())], names=["words"])

    return sorted(r["words"] for r in items.select(F.lower("text").alias("text")).mapInArrow(emit, "words int").distinct().collect())  # below ``width``


def _item_sets(items: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``(item_id, size_class, tokens, sketch)`` of every item with words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column(0), width, NOT_ALNUM):
                sketch = [s[: len(s) - -(-len(s) * num // den) + 1] for s in sets]
                yield pa.record_batch(
                    [
                        batch.column(1).slice(first, len(sets)),
                        pa.array([len(s).bit_length() for s in sets], pa.int32()),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                        pa.array([s.view(np.int64) for s in sketch], pa.list_(pa.int64())),
                    ],
                    names=["item_id", "size_class", "tokens", "sketch"],
                )

    key = items.schema["item_id"].dataType.simpleString()
    folded = items.select(F.lower("text").alias("text"), "item_id")
    out = folded.mapInArrow(emit, f"item_id {key}, size_class int, tokens array<long>, sketch array<long>")
    return out.where("size_class > 0").dropDuplicates(["item_id", "tokens"])


def _bit_table(tokens: DataFrame) -> np.ndarray:
    """A table of ``TABLE_BITS`` bits with one set for each value of the column ``token``."""
    place = F.pmod("token", F.lit(TABLE_BITS))
    words = tokens.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(token, {TABLE_BITS}) & 63 as int))")).alias("bits")
    )
    table = np.zeros(TABLE_BITS // 64, np.uint64)
    rows = words.toArrow()  # at most TABLE_BITS / 64 rows
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return table


def _in_table(table: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    place = tokens & np.uint64(TABLE_BITS - 1)
    return (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``(doc_id, item_id, item_shingles, found_shingles, containment)`` of every leaked pair.

    A pair is returned when the document holds at least ``num/den`` of the item's distinct shingles
    of ``width`` words (lower case; words are runs of letters and digits). An item of fewer words is a
    single shingle of all its words, and documents are shingled at the widths of such items too. Null
    and empty texts match nothing; null ids are returned as they are; repeated document rows give
    repeated pairs; repeated item rows with one id and one text count once. Other columns of either
    table are ignored. Empty tables give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    item_sets = stored(_item_sets(items, width, num, den), "items")
    short = _short_widths(items, width)
    sketches = item_sets.select("item_id", "size_class", F.explode("sketch").alias("token"))
    ceilings = sketches.groupBy("size_class").agg(F.max(F.shiftrightunsigned("token", 1)).alias("top")).collect()  # a row per power of two
    shared = spark.sparkContext.broadcast(
        (
            _bit_table(sketches.select("token")),
            _bit_table(item_sets.select(F.explode("tokens").alias("token"))),
            [(r["size_class"], r["top"]) for r in ceilings],
        )
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch_table, token_table, tops = shared.value
        sent = set()
        for batch in batches:
            more = [shingle_sets(batch.column(0), w, NOT_ALNUM, as_texts=True) for w in short]
            for first, sets in shingle_sets(batch.column(0), width, NOT_ALNUM):
                for _, extra in map(next, more):  # the same slices
                    sets = [np.union1d(s, e) for s, e in zip(sets, extra)]
                rows, digests, tokens, sketch, classes = [], [], [], [], []
                for k, s in enumerate(sets):
                    hits = s[_in_table(sketch_table, s)]
                    if not len(hits):
                        continue
                    below = [(c, hits[(hits >> np.uint64(1)) <= top]) for c, top in tops]
                    below = [(c, h) for c, h in below if len(h)]
                    if not below:
                        continue
                    key = set_digest(s)
                    rows.append(first + k)
                    digests.append(key)
                    if key in sent:
                        tokens.append(None), sketch.append(None), classes.append(None)
                        continue
                    sent.add(key)
                    tokens.append(s[_in_table(token_table, s)].view(np.int64))
                    sketch.append(np.concatenate([h for _, h in below]).view(np.int64))
                    classes.append(np.repeat([c for c, _ in below], [len(h) for _, h in below]).astype(np.int32))
                if rows:
                    digests = np.array(digests, np.int64)
                    yield pa.record_batch(
                        [
                            batch.column(1).take(pa.array(rows)),
                            pa.array(digests[:, 0]),
                            pa.array(digests[:, 1]),
                            pa.array(tokens, pa.list_(pa.int64())),
                            pa.array(sketch, pa.list_(pa.int64())),
                            pa.array(classes, pa.list_(pa.int32())),
                        ],
                        names=["doc_id", "node", "check", "found", "sketch", "classes"],
                    )

    key = docs.schema["doc_id"].dataType.simpleString()
    folded = docs.select(F.lower("text").alias("text"), "doc_id")
    hits = stored(
        folded.mapInArrow(search, f"doc_id {key}, node long, check long, found array<long>, sketch array<long>, classes array<int>"), "hits"
    )
    texts = hits.where("found is not null").dropDuplicates(["node", "check"])
    of_texts = texts.select("node", "check", F.explode(F.arrays_zip("sketch", "classes")).alias("z")).select(
        "node", "check", F.col("z.sketch").alias("token"), F.col("z.classes").alias("size_class")
    )
    candidates = of_texts.join(sketches.hint("merge"), ["size_class", "token"]).select("node", "check", "item_id").distinct()
    common = F.size(F.array_intersect("tokens", "found"))
    verified = (
        candidates.join(texts.select("node", "check", "found").hint("merge"), ["node", "check"])
        .join(item_sets.select(F.col("item_id").alias("item"), "tokens").hint("merge"), F.expr("item_id <=> item"))
        .select("node", "check", "item_id", F.size("tokens").alias("item_shingles"), common.alias("found_shingles"))
        .where(f"{den} * cast(found_shingles as long) >= {num} * cast(item_shingles as long)")
    )
    return hits.select("doc_id", "node", "check").join(verified.hint("merge"), ["node", "check"]).select(
        "doc_id",
        "item_id",
        F.col("item_shingles").cast("long").alias("item_shingles"),
        F.col("found_shingles").cast("long").alias("found_shingles"),
        (F.col("found_shingles") / F.col("item_shingles")).alias("containment"),
    )
