"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (P) and text that isn't confirmed toxic (U) train a linear classifier over the
presence of words and word beginnings. The risk is corrected by the class prior p,

    p R_P(toxic) + (1 - p) / (1 - q) max(0, R_U(clean) - q R_P(clean)),

whose second term is kept from going negative, as in non-negative PU learning. The smooth loss of the fit is no count of errors, so
the bias is set afterwards by the same risk with zero-one loss, on documents that a fit has not seen. q is the prior left in U:
p where hardly any document is labelled, less the more of the toxic ones are confirmed and so not in U.
Features are counted over both samples where the documents are; the driver sees the bounded samples'
chosen features only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.session import stored

from .batches import bounded_batches
from .folds import bounded_sample, remainder
from .hashing import NOT_ALNUM, mix, slices, utf8, word_hashes, word_spans

MAX_POSITIVES = 10_000
MAX_UNLABELLED = 15_000
MAX_FEATURES = 1024
BEGINNINGS = (5, 7)
MIN_DOCUMENTS, MIN_SURPRISE = 3, 3.5
STEPS, BATCH, RATE, RIDGE = 320, 1024, 0.02, 1e-4
PARTS = 4


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature hash) pairs of a slice, ordered by document."""
    starts, ends, doc = word_spans(data, offsets, NOT_ALNUM)
    hashes, owners = [word_hashes(data, starts, ends)], [doc]
    for n in BEGINNINGS:
        long = ends - starts > n
        hashes.append(mix(word_hashes(data, starts[long], starts[long] + n) + np.uint64(n)))
        owners.append(doc[long])
    hashed, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    new = np.append(True, (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1]))[: len(hashed)]
    return owner[new], hashed[new]


def _slices(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for first, end, part, cuts in slices(data, offsets):
            yield batch, first, end, *features(part, cuts)


def chosen_features(sample: DataFrame, n_p: int, n_u: int) -> np.ndarray:
    """Features that P holds more often than U beyond chance: the ``MAX_FEATURES`` most surprising."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, end, owner, hashed in _slices(batches):
            toxic = batch.column(1).to_numpy(zero_copy_only=False)[first:end][owner]
            found, at = np.unique(hashed, return_inverse=True)
            p = np.bincount(at, weights=toxic, minlength=len(found)).astype(np.int64)
            n = np.bincount(at, minlength=len(found))
            yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(p), pa.array(n - p)], names=["feature", "p", "u"])

    counted = sample.select("text", "positive").mapInArrow(count, "feature long, p long, u long")
    counted = counted.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= MIN_DOCUMENTS)
    rate = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    surprise = (F.col("p") / n_p - F.col("u") / max(n_u, 1)) / F.sqrt(rate * (1 - rate) * (1 / n_p + 1 / max(n_u, 1)))
    best = counted.withColumn("surprise", surprise).where(F.col("surprise") >= MIN_SURPRISE)
    rows = best.orderBy(F.desc("surprise"), "feature").limit(MAX_FEATURES).toArrow()
    return np.sort(rows.column("feature").to_numpy().astype(np.int64).view(np.uint64))


@dataclass
class Model:
    known: np.ndarray
    weights: np.ndarray
    bias: float

    def probability(self, owner: np.ndarray, hashed: np.ndarray, n_docs: int) -> np.ndarray:
        total = np.full(n_docs, self.bias)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, hashed), len(self.known) - 1)
            hit = self.known[at] == hashed
            total += np.bincount(owner[hit], weights=self.weights[at[hit]], minlength=n_docs)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit(x_p: np.ndarray, x_u: np.ndarray, prior: float, left: float | None = None, seed: int = 0) -> tuple[np.ndarray, float]:
    """Minimise the non-negative risk with sigmoid loss by Adam; where the corrected term of a batch is
    negative, its gradient is stepped back, as the non-negative estimator asks. ``left`` is the share of
    toxic documents in U, ``prior`` unless given."""
    left = prior if left is None else left
    rng = np.random.default_rng(seed)
    theta = np.append(np.full(x_u.shape[1], 0.5), -1.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def side(x: np.ndarray, sign: float) -> tuple[float, np.ndarray]:
        """Mean sigmoid loss of calling x toxic (1) or clean (-1), and its gradient."""
        loss = 1 / (1 + np.exp(np.clip(sign * (x @ theta[:-1] + theta[-1]), -50, 50)))
        slope = -sign * loss * (1 - loss) / len(x)
        return float(loss.mean()), np.append(x.T @ slope, slope.sum())

    for step in range(1, STEPS + 1):
        u = x_u[rng.integers(0, len(x_u), min(len(x_u), BATCH))]
        p = x_p[rng.integers(0, len(x_p), min(len(x_p), BATCH))]
        _, up = side(p, 1.0)
        p_clean, p_down = side(p, -1.0)
        u_clean, u_down = side(u, -1.0)
        rest = (1 - prior) / (1 - left) * (u_down - left * p_down)
        gradient = prior * up + rest if u_clean - left * p_clean >= 0 else -rest
        gradient[:-1] += RIDGE * theta[:-1]
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def decision(p: np.ndarray, u: np.ndarray, prior: float, left: float) -> float:
    """The total from which on calling a document toxic has the least estimated risk, counted in errors: the same estimator as in
    ``fit`` with zero-one loss, midway between totals of P and U that occur; the highest of equal ones."""
    seen = np.unique(np.concatenate([p, u]))
    if len(seen) < 2:
        return 0.0
    cuts = (seen[1:] + seen[:-1]) / 2
    missed = np.searchsorted(np.sort(p), cuts) / len(p)
    called = 1 - np.searchsorted(np.sort(u), cuts) / len(u)
    risk = prior * missed + (1 - prior) / (1 - left) * np.maximum(0, called - left * (1 - missed))
    return float(cuts[np.flatnonzero(risk <= risk.min() + 1e-12)[-1]])


def fit_with_decision(x_p: np.ndarray, x_u: np.ndarray, prior: float, left: float) -> tuple[np.ndarray, float]:
    """``fit``, with the bias set so that one half is the decision of the estimated risk. The totals it is estimated on are those of
    documents that a fit has not seen: each of ``PARTS`` parts is scored by a fit on the others."""
    weights, bias = fit(x_p, x_u, prior, left)
    parts = min(PARTS, len(x_p), len(x_u))
    if parts < 2:
        return weights, bias
    in_p, in_u = np.arange(len(x_p)) % parts, np.arange(len(x_u)) % parts
    p, u = np.empty(len(x_p)), np.empty(len(x_u))
    for k in range(parts):
        w, b = fit(x_p[in_p != k], x_u[in_u != k], prior, left)
        p[in_p == k], u[in_u == k] = x_p[in_p == k] @ w + b, x_u[in_u == k] @ w + b
    return weights, bias - decision(p, u, prior, left)


def train(docs: DataFrame, labelled: DataFrame, label: str = "toxic", positives: int = MAX_POSITIVES, unlabelled: int = MAX_UNLABELLED) -> Model:
    """Learn from ``labelled(doc_id, <label>)`` and the texts of ``docs``.

    P: documents with label 1, at most ``positives``; U: documents without a label 1, at most
    ``unlabelled``; both those of least hashed ids. The prior is the share of 1 among all non-null
    labels, and the prior left in U follows from it and the share of documents that have a label,
    taken as chosen at random. Without P or U the model gives every text the prior.
    """
    bounded_batches(docs.sparkSession)
    labelled = labelled.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    n, ones = labelled.agg(F.count("*"), F.coalesce(F.sum(label), F.lit(0))).first()
    prior = min(max((ones + 0.5) / (n + 1), 1e-3), 0.999)
    blank = Model(np.empty(0, np.uint64), np.empty(0), float(np.log(prior / (1 - prior))))
    toxic = stored(labelled.where(F.col(label) == 1).select("doc_id").distinct(), "toxic")
    known_ids = labelled.select("doc_id").distinct()
    named = docs.where("doc_id is not null").select("doc_id")
    seen = named.join(known_ids.withColumn("known", F.lit(1)).hint("merge"), "doc_id", "left").agg(F.count("known"), F.count("*")).first()
    confirmed = seen[0] / max(seen[1], 1)  # share of documents with a label
    left = prior * (1 - confirmed) / (1 - prior * confirmed)
    p_ids = bounded_sample(toxic, "doc_id", positives)
    u_ids = bounded_sample(named.join(toxic.hint("merge"), "doc_id", "left_anti"), "doc_id", unlabelled)
    ids = p_ids.select("doc_id", F.lit(1.0).alias("positive")).union(u_ids.select("doc_id", F.lit(0.0).alias("positive")).distinct())
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "positive", F.lower("text").alias("text")), "sample")
    counts = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_p, n_u = counts.get(1.0, 0), counts.get(0.0, 0)
    if not n_p or not n_u:
        return blank
    known = chosen_features(sample, n_p, n_u)
    if not len(known):
        return blank
    shared = sample.sparkSession.sparkContext.broadcast(known)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch, first, end, owner, hashed in _slices(batches):
            at = np.minimum(np.searchsorted(table, hashed), len(table) - 1)
            hit = table[at] == hashed
            cuts = np.searchsorted(owner[hit], np.arange(end - first + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(at[hit].astype(np.int32)))
            yield pa.record_batch([batch.column(1).slice(first, end - first), batch.column(2).slice(first, end - first), lists], names=["positive", "doc_id", "has"])

    key = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.select("text", "positive", "doc_id").mapInArrow(pick, f"positive double, doc_id {key}, has array<int>").orderBy("doc_id").toArrow()
    x = np.zeros((rows.num_rows, len(known)), np.float32)
    has = rows.column("has").combine_chunks()
    x[np.repeat(np.arange(rows.num_rows), has.value_lengths().to_numpy()), has.flatten().to_numpy()] = 1
    positive = rows.column("positive").to_numpy() == 1
    return Model(known, *fit_with_decision(x[positive], x[~positive], prior, left))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` for every row and whole text of ``docs``; null counts as empty.

    Repeated rows repeat, null ids stay, other columns are dropped, an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = docs.schema["doc_id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, end, owner, hashed in _slices(batches):
            out = pa.array(shared.value.probability(owner, hashed, end - first))
            yield pa.record_batch([batch.column(1).slice(first, end - first), out], names=["doc_id", "score"])

    return docs.select(F.lower("text").alias("text"), "doc_id").mapInArrow(emit, f"doc_id {key}, score double")


def op5_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside the held-out fold."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fold = remainder(F.col("doc_id"), 5)
    model = train(docs.where(fold != 0), labels.where(fold != 0))
    held_out = F.coalesce(fold == 0, F.lit(False)).alias("held_out")
    return scores(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
