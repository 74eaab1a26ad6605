"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed where the documents are. Trees are fitted on the driver over a sample of
labelled rows of bounded size (``MAX_TRAINING_ROWS`` rows of a few dozen numbers), flattened into
arrays, broadcast, and traversed for a whole batch of documents at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import bounded_batches
from .folds import bounded_sample, remainder
from .hashing import SPACES, slices, utf8, word_hashes, word_spans

MAX_TRAINING_ROWS = 20_000
TREES, DEPTH, BINS = 120, 4, 64
RATE, MIN_WEIGHT, RIDGE = 0.1, 1.0, 1.0

_LINES = np.zeros(256, bool)
_LINES[0x0A] = True
_SYMBOLS = b"#$%&*!|"
NAMES = (
    ["log_bytes", "log_words", "log_lines", "word_bytes", "line_words"]
    + ["upper", "lower", "digits", "punctuation", "beyond_ascii", "spaces"]
    + [f"symbol_{c}" for c in ("hash", "dollar", "percent", "and", "star", "bang", "bar")]
    + ["distinct_words", "top_word", "repeated_neighbours", "distinct_lines", "symbol_endings", "long_words", "byte_entropy"]
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` for each document of a slice, words and lines compared with A-Z folded; an empty
    document has zeros."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    table = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    size = table.sum(axis=1)
    safe = np.maximum(size, 1)
    starts, ends, doc = word_spans(data, offsets, SPACES)
    words = np.bincount(doc, minlength=n).astype(float)
    some = np.maximum(words, 1)
    hashes = word_hashes(data, starts, ends)
    length = ends - starts
    line_starts, line_ends, line_doc = word_spans(data, offsets, _LINES)
    lines = np.bincount(line_doc, minlength=n).astype(float)

    def spread(of: np.ndarray, values: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values and the most frequent one, as shares of each document's total."""
        order = np.lexsort((values, of))
        new = np.append(True, (of[order][1:] != of[order][:-1]) | (values[order][1:] != values[order][:-1]))[: len(order)]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(order)))
        top = np.zeros(n)
        np.maximum.at(top, of[order][first], count)
        return np.bincount(of[order][first], minlength=n) / total, top / total

    distinct, top = spread(doc, hashes, some)
    distinct_lines, _ = spread(line_doc, word_hashes(data, line_starts, line_ends), np.maximum(lines, 1))
    same = np.bincount(doc[1:][(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    ending = np.isin(data[ends - 1], np.frombuffer(_SYMBOLS, np.uint8)) if len(ends) else np.zeros(0, bool)
    share = table / safe[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    punctuation = [b for b in range(33, 127) if not chr(b).isalnum()]
    columns = [
        np.log1p(size), np.log1p(words), np.log1p(lines),
        np.bincount(doc, weights=length, minlength=n) / some, words / np.maximum(lines, 1),
        share[:, 65:91].sum(axis=1), share[:, 97:123].sum(axis=1), share[:, 48:58].sum(axis=1),
        share[:, punctuation].sum(axis=1), share[:, 128:].sum(axis=1), share[:, SPACES].sum(axis=1),
        *(share[:, c] for c in _SYMBOLS),
        distinct, top, same / some, distinct_lines,
        np.bincount(doc[ending], minlength=n) / some, np.bincount(doc[length > 20], minlength=n) / some, entropy,
    ]
    return np.stack(columns, axis=1)


@dataclass
class Trees:
    """Complete trees of one depth, flattened: node k of a tree has the children 2k + 1 and 2k + 2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:  # complete trees: all rows reach the leaves together
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost logistic loss. No rows give 0.5 everywhere, one class gives its smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T] if len(x) else []
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1) if len(x) else None
    trees = []
    score = np.full(len(y), base)
    for _ in range(TREES if len(x) and 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            cell = ((node - first)[:, None] * x.shape[1] + np.arange(x.shape[1])) * BINS + binned
            shape = (width, x.shape[1], BINS)
            cells = width * x.shape[1] * BINS
            gs = np.bincount(cell.ravel(), np.repeat(g, x.shape[1]), cells).reshape(shape).cumsum(axis=2)
            hs = np.bincount(cell.ravel(), np.repeat(h, x.shape[1]), cells).reshape(shape).cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(hs < MIN_WEIGHT) | (ht - hs < MIN_WEIGHT)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        score += value[leaf]
        trees.append((feature, threshold, value))
    if not trees:
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    return Trees(base, *(np.stack(part) for part in zip(*trees)))


def _per_document(docs: DataFrame, rows, kind: str) -> DataFrame:
    """``rows(statistics)`` -> arrays, one for each column after doc_id."""
    bounded_batches(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for first, end, part, cuts in slices(data, offsets):
                yield pa.record_batch([batch.column(1).slice(first, end - first), rows(statistics(part, cuts))], names=["doc_id", "out"])

    return docs.select("text", "doc_id").mapInArrow(emit, f"doc_id {key}, out {kind}")


def train(docs: DataFrame, labelled: DataFrame, label: str = "quality", bound: int = MAX_TRAINING_ROWS) -> Trees:
    """Fit on ``labelled(doc_id, <label>)``: at most ``bound`` of its rows, those of least hashed ids.

    Null labels and ids teach nothing; a label without a document neither.
    """
    sample = bounded_sample(labelled.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", label), "doc_id", bound)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi")  # at most ``bound`` ids
    found = _per_document(texts, lambda x: pa.array(list(x), pa.list_(pa.float64())), "array<double>")
    rows = found.join(F.broadcast(sample), "doc_id").orderBy("doc_id", label).toArrow()
    x = np.stack(rows.column("out").to_pylist()) if rows.num_rows else np.zeros((0, len(NAMES)))
    return fit(np.asarray(x, float), rows.column(label).to_numpy().astype(float))


def scores(docs: DataFrame, trees: Trees) -> DataFrame:
    """``(doc_id, score)`` for every row and whole text of ``docs``; null counts as empty.

    Repeated rows repeat, null ids stay, other columns are dropped, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    return _per_document(docs, lambda x: pa.array(shared.value.probability(x)), "double").withColumnRenamed("out", "score")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels outside the held-out fold."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    trees = train(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return scores(docs, trees).select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
