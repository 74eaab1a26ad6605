"""Extension points: encoders and centroid signals by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind of signal -> (weight of the centroid, weight of the signal's vector).
_signals: dict[str, tuple[float, float]] = {"help": (1.0, 0.05), "hurt": (1.0, -0.02), "post": (1.0, 0.03), "user": (0.5, 0.5)}


@dataclass(frozen=True)
class Encoder:
    """A way to make vectors and to compare them: two columns at a time, and two blocks of rows at a time."""

    encode: Callable[[DataFrame, str], DataFrame]
    dim: int
    compare: Callable[[Column, Column], Column]
    kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]
    method: str


_encoders: dict[str, Encoder] = {}


def cosine_of(a: Column, b: Column) -> Column:
    """Cosine; 0 with a vector without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-10)


def cosine_kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left @ right.T / (np.linalg.norm(left, axis=1)[:, None] * np.linalg.norm(right, axis=1)[None, :] + 1e-10)


def overlap_of(a: Column, b: Column) -> Column:
    """Shared features (places that aren't 0) as a share of all features of both; 0 without any."""
    either = F.zip_with(a, b, lambda x, y: F.when((x != 0) & (y != 0), 2).when((x != 0) | (y != 0), 1).otherwise(0))
    shared, all_ = F.size(F.filter(either, lambda x: x == 2)), F.size(F.filter(either, lambda x: x > 0))
    return F.when(all_ > 0, shared / all_).otherwise(0.0)


def overlap_kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    a, b = (left != 0).astype(float), (right != 0).astype(float)
    shared = a @ b.T
    return shared / np.maximum(a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :] - shared, 1.0)


def register_encoder(
    name: str, encode: Callable[[DataFrame, str], DataFrame], dim: int,
    compare: Callable[[Column, Column], Column] = cosine_of, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray] = cosine_kernel, method: str = "cosine",
) -> None:
    """``encode(df, text_column)`` adds a column ``vector`` of ``dim`` numbers; ``compare`` and ``kernel`` give the same symmetric
    similarity, for columns and for blocks (a search needs the kernel, a comparison of stated pairs the column)."""
    _encoders[name] = Encoder(encode, dim, compare, kernel, method)


def encoder_of(name: str) -> Encoder:
    return _encoders[name]


def encode(df: DataFrame, text: str = "text", encoder: str = "hashing") -> DataFrame:
    return _encoders[encoder].encode(df, text)


def hashing_encoder(df: DataFrame, text: str, size: int = 64) -> DataFrame:
    """Hashed words, unit length; needs no model."""
    words = Tokenizer(inputCol=text, outputCol="_words").transform(df)
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=size).transform(words)
    return Normalizer(inputCol="_counts", outputCol="_unit").transform(counts).withColumn("vector", vector_to_array("_unit", "float32")).drop("_words", "_counts", "_unit")


def feature_encoder(df: DataFrame, text: str, size: int = 256) -> DataFrame:
    """Which hashed words occur, as ones and zeros."""
    words = Tokenizer(inputCol=text, outputCol="_words").transform(df)
    found = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=size, binary=True).transform(words)
    return found.withColumn("vector", vector_to_array("_counts", "float32")).drop("_words", "_counts")


register_encoder("hashing", hashing_encoder, 64)
register_encoder("features", feature_encoder, 256, overlap_of, overlap_kernel, "overlap")


def register_signal(kind: str, centroid: float, vector: float) -> None:
    _signals[kind] = (centroid, vector)


def signal_weight(kind: Column) -> tuple[Column, Column]:
    """Weights of a signal's kind; an unknown kind changes nothing."""
    pick = lambda k, default: F.coalesce(*(F.when(kind == name, F.lit(w[k])) for name, w in _signals.items()), F.lit(default))
    return pick(0, 1.0), pick(1, 0.0)
