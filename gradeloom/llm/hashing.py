"""Vectorised words and word shingles over Arrow string columns.

All functions work on the UTF-8 bytes of a slice of documents at once; nothing loops over words in
Python. Hashes are 64 bits wide: a polynomial over randomised byte values, finished with a bijective
mixer. Slices hold a quarter of a megabyte of text (what is made of one takes some sixty times that),
a longer document is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_WORD_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)

#: Space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Every ASCII byte that is neither a letter nor a digit; bytes of non-ASCII letters count as letters.
NOT_ALNUM = np.ones(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    NOT_ALNUM[_lo:_hi] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=_U)
    return _powers[0], _powers[1]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of at most ``limit`` bytes: first row, end row, bytes, offsets from 0."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of bytes that aren't separators."""
    inside = ~separators[data]
    if not len(inside):
        none = np.empty(0, np.int64)
        return none, none, none
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """One 64-bit hash per word; ``lower`` folds A-Z only."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE_VALUES[_LOWER[data] if lower else data] * power[: len(data)], dtype=_U, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def shingles(words: np.ndarray, doc_of: np.ndarray, n_docs: int, width: int, as_texts: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` words in a row, and the document of each, in text order.

    A document with fewer words, but at least one, has a single shingle: its whole word sequence.
    With ``as_texts`` every shingle has the hash of a whole text of these words that is too short.
    """
    count = np.bincount(doc_of, minlength=n_docs)
    first = np.cumsum(count) - count
    total = len(words)
    if not total:
        return np.empty(0, _U), np.empty(0, np.int64)
    mixed = np.zeros(total, _U)
    for k in range(min(width, total)):
        mixed[: total - k] += words[k:] * _WORD_FACTORS[k]
    whole = np.arange(total) + width <= (first + count)[doc_of]
    out, out_doc = mix(mixed[whole] ^ mix(np.array([width], _U)) if as_texts else mixed[whole]), doc_of[whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        sums = np.array([np.sum(words[first[d] : first[d] + count[d]] * _WORD_FACTORS[: count[d]], dtype=_U) for d in short], _U)
        out = np.concatenate([out, mix(sums ^ mix(count[short].astype(_U)))])
        out_doc = np.concatenate([out_doc, short])
        order = np.argsort(out_doc, kind="stable")
        out, out_doc = out[order], out_doc[order]
    return out, out_doc


def shingle_sets(column: pa.Array, width: int, separators: np.ndarray = SPACES, as_texts: bool = False) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each slice its first row and, per document, the sorted distinct shingle hashes."""
    data, offsets = utf8(column)
    for first, end, part, part_offsets in slices(data, offsets):
        starts, ends, doc_of = word_spans(part, part_offsets, separators)
        hashes, of = shingles(word_hashes(part, starts, ends), doc_of, end - first, width, as_texts)
        cuts = np.searchsorted(of, np.arange(end - first + 1))
        yield first, [np.unique(hashes[cuts[d] : cuts[d + 1]]) for d in range(end - first)]


def set_digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two independent signed 64-bit digests of a sorted set."""
    if not len(tokens):
        return 0, 0
    place = mix(np.arange(1, len(tokens) + 1, dtype=_U))
    a = mix(np.sum(tokens * (place | _U(1)), dtype=_U, keepdims=True))
    b = mix(np.sum(mix(tokens ^ _U(0x5851F42D4C957F2D)), dtype=_U, keepdims=True) + _U(len(tokens)))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])
