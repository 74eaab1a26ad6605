"""Fill-in-the-middle documents, cut at line ends that are found from summaries of content-defined chunks.

A text's bytes are cut where a rolling hash of the last 32 of them has ``CHUNK_BITS`` zero bits on top, so equal passages
of different documents give equal chunks. Each task keeps the summaries of the chunks it has met, by digest, and a hit
counts only if the bytes are equal: code points, ends of lines, and whether a control string is inside; those that
straddle chunks are seen by the chunks' first and last bytes. A document's line count and the chunk that holds a cut
come from sums over its chunks; only the chunks of its two cuts are looked into.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import bounded_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
REACH = len(MARKS[0]) - 1
CHUNK_BITS = 10
MAX_CHUNK = 1 << 16
WINDOW = 32
SLICE = 1 << 20
#: Bytes of chunks whose summaries a task remembers, in each of two generations.
CACHE_BYTES = 8 << 20


def _table() -> np.ndarray:
    x = (np.arange(256, dtype=np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


_TABLE = _table()


def boundaries(data: np.ndarray) -> np.ndarray:
    """Ascending places in ``data`` (bytes) before which the rolling hash asks for a cut, never inside a code point."""
    found = []
    for first in range(0, len(data), SLICE):
        base = max(0, first - WINDOW)
        h = _TABLE[data[base : first + SLICE]]
        for s in (1, 2, 4, 8, 16):  # sums of 2, 4, ... 32 bytes
            h[s:] = h[s:] + (h[:-s] << np.uint32(s))
        at = np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + base + 1
        found.append(at[(at > first) & (at < len(data))])
    at = np.concatenate(found) if found else np.empty(0, int)
    return at[(data[at] & 0xC0) != 0x80]


def code_points(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


class Summary(NamedTuple):
    content: bytes
    chars: int
    line_ends: np.ndarray
    marked: bool


def summarise(content: bytes) -> Summary:
    ends = np.flatnonzero(np.frombuffer(content, np.uint8) == 10).astype(np.int32) + 1
    return Summary(content, code_points(content), ends, any(m in content for m in MARKS))


class Memo:
    """Summaries by digest, checked by content; the older of two generations is forgotten when the newer is full."""

    def __init__(self, limit: int = CACHE_BYTES, digest=xxhash.xxh3_64_intdigest):
        self.limit, self.digest, self.size = limit, digest, 0
        self.new: dict[int, Summary] = {}
        self.old: dict[int, Summary] = {}

    def __call__(self, content: bytes) -> Summary:
        key = self.digest(content)
        found = self.new.get(key) or self.old.get(key)
        if found is None or found.content != content:
            found = summarise(content)
        if key not in self.new:
            if self.size + len(content) > self.limit:
                self.old, self.new, self.size = self.new, {}, 0
            self.new[key] = found
            self.size += len(content)
        return found


def pieces(data: memoryview, places: np.ndarray) -> Iterator[bytes]:
    """``data`` cut at the places, and where none comes for ``MAX_CHUNK`` bytes."""
    first = 0
    for end in [*places.tolist(), len(data)]:
        while end - first > MAX_CHUNK:
            cut = first + MAX_CHUNK
            while data[cut] & 0xC0 == 0x80 and cut > first + 1:
                cut -= 1
            yield bytes(data[first:cut])
            first = cut
        if end > first:
            yield bytes(data[first:end])
            first = end


def cut(chunks: list[Summary], h1: int, h2: int) -> tuple[int, int, int, bool]:
    """Lines of the chunks' text, code points before its first and second cut, and whether it holds a control string."""
    lines, chars, marked, tail = [0], [0], False, b""
    for c in chunks:
        lines.append(lines[-1] + len(c.line_ends))
        chars.append(chars[-1] + c.chars)
        marked = marked or c.marked or any(m in tail + c.content[:REACH] for m in MARKS)
        tail = (tail + c.content[-REACH:])[-REACH:]
    n = lines[-1] + (bool(chunks) and not tail.endswith(b"\n"))

    def before(k: int) -> int:
        if k > lines[-1]:
            return chars[-1]  # the last line has no end
        at = bisect_left(lines, k)  # the first chunk with k ends, itself included
        if not at:
            return 0
        c = chunks[at - 1]
        return chars[at - 1] + code_points(c.content[: c.line_ends[k - lines[at - 1] - 1]])

    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, before(first), before(second), marked


_CUTS = pa.struct([("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64()), ("marked", pa.bool_())])


def _cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    memo = Memo()
    for texts, h1, h2 in batches:
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2] if texts.buffers()[2] is not None else b""
        places, view = boundaries(np.frombuffer(data, np.uint8)), memoryview(data)
        rows = []
        for k, (a, b) in enumerate(zip(h1.to_pylist(), h2.to_pylist())):
            start, end = int(offsets[k]), int(offsets[k + 1])
            own = places[np.searchsorted(places, start + WINDOW) : np.searchsorted(places, end)] - start  # a window within the text
            rows.append(dict(zip(("n", "first", "second", "marked"), cut([memo(p) for p in pieces(view[start:end], own)], a, b))))
        yield pa.array(rows, _CUTS)


def with_cuts(docs: DataFrame, seed: int = 7, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with a struct ``cuts``: lines, places of the two cuts, control strings, and the four draws of the row's digest."""
    bounded_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    found = F.arrow_udf(_typed(), "n long, first long, second long, marked boolean")
    return docs.withColumn("cuts", found(F.coalesce(F.col(text), F.lit("")), draws[0], draws[1])).withColumns({"draw_3": draws[2], "draw_4": draws[3]})


def _typed():
    def cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return _cuts(batches)

    cuts.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return cuts


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """``(doc_id, text, n, form, prefix_chars, middle_chars, output)`` of ``docs(doc_id, text)``: ``rate`` in a hundred documents are
    reordered, ``spm`` in a hundred of these with the suffix first.

    A null text is empty. Empty texts and those that hold a control string stay plain. A null id draws as an empty one;
    repeated rows draw alike and stay rows of their own; other columns are dropped. Texts are valid UTF-8.
    """
    text = F.coalesce("text", F.lit(""))
    rows = with_cuts(docs.select("doc_id", text.alias("text")), seed)
    c = F.col("cuts")
    plain = (F.col("text") == "") | c["marked"] | (F.col("draw_3") % 100 >= rate)
    form = F.when(plain, F.lit("plain")).when(F.col("draw_4") % 100 < spm, F.lit("spm")).otherwise(F.lit("psm"))
    rows = rows.select("doc_id", "text", c["n"].alias("n"), form.alias("form"), c["first"].cast("int").alias("first"), c["second"].cast("int").alias("second"))
    t, first, second = (F.col(x) for x in ("text", "first", "second"))
    prefix, middle, suffix = F.substring(t, F.lit(1), first), F.substring(t, first + 1, second - first), F.substring(t, second + 1, F.lit(2**31 - 1))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm_ = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    made = F.col("form") != "plain"
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(t)
    return rows.select("doc_id", "text", "n", "form", F.when(made, first.cast("long")).alias("prefix_chars"), F.when(made, (second - first).cast("long")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from: its parts hold no control string, so the first of each ends a part."""
    body, middle = F.substring_index(output, MIDDLE, 1), F.substring(output, F.locate(MIDDLE, output) + len(MIDDLE), F.length(output))
    head, mark = (F.when(form == "psm", F.lit(m)).otherwise(F.lit(o)) for m, o in ((PREFIX, SUFFIX), (SUFFIX, PREFIX)))
    body = F.substring(body, F.length(head) + 1, F.length(body))
    at = F.instr(body, mark)
    one, two = F.substring(body, F.lit(1), at - 1), F.substring(body, at + F.length(mark), F.length(body))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its fill-in-the-middle form, and the text rebuilt from that."""
    rows = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    back = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS draw FROM d),
p AS (SELECT *, len(units) AS n, least(draw[1] % (n + 1), draw[2] % (n + 1)) AS a, greatest(draw[1] % (n + 1), draw[2] % (n + 1)) AS b FROM u),
s AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:], ''), '') AS suffix,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR draw[3] % 100 >= 100 THEN 'plain' WHEN draw[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM s
"""
