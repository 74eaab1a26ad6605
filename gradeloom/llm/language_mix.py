"""Language identification as multilingual mixture inference.

Training counts hashed character n-grams (1 to 3 characters, over word-padded lower-case text) per
language over all labelled documents; each task sends one count vector per language. A document is
then a mixture: expectation-maximisation estimates the proportions of its languages from the n-gram
likelihoods, and languages are dropped, least proportion first, while that raises the penalised
likelihood ``log L - penalty * |languages| * log(n-grams)``.

Tasks see the table of log-likelihoods, a float for each language and bin: at most ``MAX_CELLS`` (64
MB). With more than 512 languages there are fewer bins, half as many for every doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bounded_batches
from .folds import remainder
from .hashing import mix, slices, utf8

BINS = 1 << 15
MAX_CELLS = 1 << 24
SMOOTHING = 0.5
ROUNDS = 12
PENALTY = 1.0
UNDETERMINED = "und"
_SLICE = 1 << 20


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all n-grams of a slice and the document of each; grams never cross documents.

    Works on code points: runs of characters that aren't letters count as one space.
    """
    text = data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    begins = (data & 0xC0) != 0x80
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[begins] if len(data) else np.empty(0, np.int64)
    letter = (points > 0xBF) | ((points | 32) - 97 < 26)
    letter |= (points == 0xAA) | (points == 0xB5) | (points == 0xBA)
    letter &= (points != 0xD7) & (points != 0xF7) & ((points < 0x2000) | (points > 0x206F))
    shown = np.where(letter, points, np.uint32(32))
    keep = letter | np.append(True, letter[:-1]) | np.append(True, doc[1:] != doc[:-1])
    shown, doc = shown[keep].astype(np.uint64), doc[keep]
    grams, owner = [], []
    for n in (1, 2, 3):
        if len(shown) < n:
            break
        whole = doc[n - 1 :] == doc[: len(doc) - n + 1]
        key = np.full(len(shown) - n + 1, n, np.uint64)
        blank = np.ones(len(key), bool)
        for k in range(n):
            part = shown[k : len(shown) - n + 1 + k]
            key = key * np.uint64(0x110000) + part
            blank &= part == 32
        use = whole & ~blank
        grams.append((mix(key[use]) % np.uint64(BINS)).astype(np.int64))
        owner.append(doc[: len(key)][use])
    if not grams:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(grams), np.concatenate(owner)


def gram_counts(texts: DataFrame) -> DataFrame:
    """``(lang, bin, n)`` over all rows of ``texts(text, lang)``: counts are summed inside each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            langs = batch.column(1).to_pylist()
            for first, end, part, cuts in slices(data, offsets, _SLICE):
                bins, owner = _grams(part, cuts)
                of = langs[first:end]
                for lang in set(of):
                    mine = np.fromiter((x == lang for x in of), bool, end - first)
                    totals.setdefault(lang, np.zeros(BINS, np.int64))
                    totals[lang] += np.bincount(bins[mine[owner]], minlength=BINS)
        for lang, n in totals.items():
            found = np.flatnonzero(n)
            yield pa.record_batch([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n[found])], names=["lang", "bin", "n"])

    seen = texts.mapInArrow(count, "lang string, bin long, n long")
    return seen.groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def train(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log-likelihoods per bin. Rows with a null lang or text teach nothing;
    an empty table gives a model without languages."""
    bounded_batches(texts.sparkSession)
    rows = gram_counts(texts.where("lang is not null and text is not null").select("text", F.col("lang").cast("string"))).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    bins = BINS
    while bins > 1 and len(langs) * bins > MAX_CELLS:
        bins //= 2
    table = np.full((len(langs), bins), SMOOTHING)
    at = np.searchsorted(np.array(langs, object), rows.column("lang").to_numpy(zero_copy_only=False)) if langs else []
    if langs:
        np.add.at(table, (at, rows.column("bin").to_numpy() % bins), rows.column("n").to_numpy())
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _fit(weights: np.ndarray, like: np.ndarray, cuts: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document for its set of active languages.

    ``like``: likelihood of each distinct gram (rows) under each language, scaled by the row's largest.
    """
    size = np.diff(cuts)
    total = np.add.reduceat(weights, cuts[:-1])
    share = active / active.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        each = np.repeat(share, size, axis=0)
        joint = like * each * (weights / np.einsum("ij,ij->i", like, each))[:, None]
        share = np.add.reduceat(joint, cuts[:-1], axis=0) / total[:, None]
    fit = np.add.reduceat(weights * np.log(np.einsum("ij,ij->i", like, np.repeat(share, size, axis=0))), cuts[:-1])
    return share, fit


def _infer(bins: np.ndarray, owner: np.ndarray, n_docs: int, logs: np.ndarray) -> np.ndarray:
    """Mixture proportions per document, 0 for languages that are not in the selected set."""
    out = np.zeros((n_docs, len(logs)))
    if not len(bins):
        return out
    width = logs.shape[1]
    cells, counts = np.unique(owner * width + bins % width, return_counts=True)
    docs, where = np.unique(cells // width, return_index=True)
    weights = counts.astype(np.float64)
    raw = logs[:, cells % width].astype(np.float64)
    like = np.ascontiguousarray(np.maximum(np.exp(raw - raw.max(axis=0)), 1e-12).T)
    cuts = np.append(where, len(cells))
    total = np.add.reduceat(weights, where)
    cost = PENALTY * np.log(np.maximum(total, 2))
    active = np.ones((len(docs), len(logs)))
    share, fit = _fit(weights, like, cuts, active)
    score = fit - cost * active.sum(axis=1)
    open_ = np.ones(len(docs), bool)
    for _ in range(len(logs) - 1):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        fewer = active[at].copy()
        least = np.where(fewer > 0, share[at], np.inf).argmin(axis=1)
        fewer[np.arange(len(at)), least] = 0
        rows = np.repeat(open_, np.diff(cuts))
        sub = np.append(0, np.cumsum(np.diff(cuts)[at]))
        new_share, new_fit = _fit(weights[rows], like[rows], sub, fewer)
        new_score = new_fit - cost[at] * fewer.sum(axis=1)
        better = (new_score >= score[at]) & (fewer.sum(axis=1) > 0)
        won = at[better]
        active[won], share[won], score[won] = fewer[better], new_share[better], new_score[better]
        open_[:] = False
        open_[won[active[won].sum(axis=1) > 1]] = True
    out[docs] = share
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``(doc_id, lang_pred, score, langs, proportions)`` for every row of ``docs(doc_id, text)``.

    ``lang_pred`` has the largest proportion (the first in order on ties) and ``score`` is that
    proportion; ``langs`` and ``proportions`` hold the selected set, largest first. A null text, one
    without a letter, or a model without languages gives ``und``, score 0 and no languages. Texts are
    read whole. Repeated rows repeat; null ids stay; other columns are dropped; an empty table gives no rows.
    """
    langs, logs = model
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((langs, logs))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            spoken = batch.column(2).to_numpy(zero_copy_only=False)
            for first, end, part, cuts in slices(data, offsets, _SLICE // max(4, len(names))):
                share = _infer(*_grams(part, cuts), end - first, table) if names else np.zeros((end - first, 1))
                share[~spoken[first:end]] = 0
                order = np.argsort(-share, axis=1, kind="stable")
                best = share[np.arange(len(share)), order[:, 0]]
                picks = [[k for k in row if s[k] > 0] for row, s in zip(order, share)]
                yield pa.record_batch(
                    [
                        batch.column(1).slice(first, end - first),
                        pa.array([names[p[0]] if p else UNDETERMINED for p in picks], pa.string()),
                        pa.array(np.clip(best, 0, 1)),
                        pa.array([[names[k] for k in p] for p in picks], pa.list_(pa.string())),
                        pa.array([[float(s[k]) for k in p] for p, s in zip(picks, share)], pa.list_(pa.float64())),
                    ],
                    names=["doc_id", "lang_pred", "score", "langs", "proportions"],
                )

    key = docs.schema["doc_id"].dataType.simpleString()
    spoken = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("spoken")
    kind = f"doc_id {key}, lang_pred string, score double, langs array<string>, proportions array<double>"
    return docs.select(F.lower("text").alias("text"), "doc_id", spoken).mapInArrow(predict, kind)


def op10_language_mixture(spark, sf_dir: str) -> DataFrame:
    """Languages of every document, learnt from the documents outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = remainder(F.col("doc_id"), 4)
    model = train(docs.where(fold != 2).select("text", "lang"))
    found = identify(docs, model).withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)))
    return found.select("doc_id", "held_out", "lang_pred", "score", "langs", "proportions")
