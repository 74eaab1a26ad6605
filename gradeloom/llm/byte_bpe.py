"""Byte-level BPE through a global shuffle of distinct words.

1. Each task cuts its texts into pre-tokens and keeps, per *chunk* of documents, the distinct words
   once and every document as positions: its pre-tokens as numbers of the chunk's words. Both are
   written once, packed (a compressed row per chunk and word class, and a row per chunk), into a table
   bucketed by chunk.
2. Words are shuffled by class, a hash of the word, so all chunks' copies of a word meet and it is
   encoded once. However frequent a word is, it travels once per chunk.
3. Ids go back to their chunks and join the positions bucket by bucket, so positions aren't shuffled.
   They are read in order: the document's ids. Decoding joins ids with the token-byte table, whose size
   is that of the vocabulary.

A chunk holds at most ``CHUNK_BYTES`` of text (a longer document is a chunk of its own) and ends after
the document that brings it above ``CHUNK_WORDS`` distinct words, so no task
holds more than a chunk and the distinct words of one class. There are as many classes and buckets as
shuffle partitions, and more where these would get over ``CLASS_BYTES`` of text each.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from gradeloom.session import scratch_path

from .batches import bounded_batches, give_back

CHUNK_BYTES = 32 << 20
CHUNK_WORDS = 1 << 18
CLASS_BYTES = 64 << 20
MAX_CLASSES = 100_000  # what Spark allows as buckets
OUTPUT_BYTES = 4 << 20
_ONE_BYTE = 192
_WIDE = (1 << 32) - 1
_ROWS = 256

_KIND = "chunk string, class int, numbers binary, words binary, count int, doc_ids array<{key}>, positions array<binary>"


def ranks_of(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers, compressed: one byte for those below 192, else a mark and two bytes; all in four bytes
    if one is too large for that."""
    import zstandard

    if len(numbers) and numbers.max() >= _ONE_BYTE + (64 << 16):
        return zstandard.ZstdCompressor(level=9).compress(np.uint32(_WIDE).tobytes() + numbers.astype("<u4").tobytes())
    big = numbers >= _ONE_BYTE
    rest = numbers[big] - _ONE_BYTE
    first = numbers.astype(np.uint8)
    first[big] = _ONE_BYTE + (rest >> 16)
    planes = (rest & 0xFFFF).astype("<u2").view(np.uint8).reshape(-1, 2).T
    return zstandard.ZstdCompressor(level=9).compress(np.uint32(len(numbers)).tobytes() + first.tobytes() + planes.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    if n == _WIDE:
        return np.frombuffer(raw, "<u4", -1, 4).astype(np.int64)
    numbers = np.frombuffer(raw, np.uint8, n, 4).astype(np.int64)
    big = numbers >= _ONE_BYTE
    planes = np.frombuffer(raw, np.uint8, -1, 4 + n).reshape(2, -1).astype(np.int64)
    numbers[big] = ((numbers[big] - _ONE_BYTE) << 16) + planes[0] + (planes[1] << 8) + _ONE_BYTE
    return numbers


def _pack_words(words: list[bytes]) -> bytes:
    import zstandard

    sizes = np.fromiter(map(len, words), "<u4", len(words))  # a long run of one kind of character is one word
    return zstandard.ZstdCompressor(level=9).compress(sizes.tobytes() + b"".join(words))


def _unpack_words(blob: bytes, n: int) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    ends = 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64))
    return [raw[a:b] for a, b in zip(np.append(4 * n, ends[:-1]).tolist(), ends.tolist())]


def _pretokens(docs: DataFrame, pattern: str, classes: int) -> DataFrame:
    """Packed rows: (chunk, class, numbers, words) of distinct words, and (chunk, doc_ids, positions)."""
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        import regex

        give_back()
        find = regex.compile(pattern).findall
        task, done = TaskContext.get().partitionId(), 0

        def flush(words, rows, ids):
            coded = [w.encode() for w in words]
            often = np.zeros(len(coded), np.int64)
            for row in rows:
                np.add.at(often, row, 1)
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(coded), np.int64)
            rank[order] = np.arange(len(coded))
            of = np.fromiter((crc32(coded[k]) % classes for k in order), np.int64, len(coded))
            by_class = np.argsort(of, kind="stable")
            cuts = np.flatnonzero(np.diff(of[by_class], prepend=-1, append=classes))
            groups = [by_class[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.list_(ids.type), pa.list_(pa.binary())]
            names = ["chunk", "class", "numbers", "words", "count", "doc_ids", "positions"]

            def rows_of(n, **columns):
                columns["chunk"] = [f"{task}-{done}"] * n
                return pa.record_batch([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in zip(names, kinds)], names=names)

            for k in range(0, len(groups), 64):
                part = groups[k : k + 64]
                yield rows_of(
                    len(part),
                    **{"class": [of[g[0]] for g in part]},
                    numbers=[_pack(np.diff(g, prepend=0)) for g in part],
                    words=[_pack_words([coded[order[i]] for i in g]) for g in part],
                    count=[len(g) for g in part],
                )
            yield rows_of(1, doc_ids=[ids.to_pylist()], positions=[[_pack(rank[r]) for r in rows]])

        words, rows, ids, held = {}, [], [], 0
        for batch in batches:
            for text, doc_id in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                if rows and (held + len(text) > CHUNK_BYTES or len(words) > CHUNK_WORDS):
                    yield from flush(words, rows, pa.array(ids, batch.column(1).type))
                    words, rows, ids, held, done = {}, [], [], 0, done + 1
                    give_back()
                held += len(text)
                number = words.setdefault
                rows.append(np.fromiter((number(w, len(words)) for w in find(text)), np.int32))
                ids.append(doc_id.as_py())
            kind = batch.column(1).type
        if rows:
            yield from flush(words, rows, pa.array(ids, kind))
            del words, rows, ids
        give_back()

    return docs.select("text", "doc_id").mapInArrow(emit, _KIND.format(key=key_type))


def _bucketed(df: DataFrame, n: int, column: str) -> DataFrame:
    """``df`` written to the shared folder in ``n`` buckets of ``column``; joins on it needn't shuffle it."""
    spark, name = df.sparkSession, f"pretokens_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n, column).option("path", scratch_path(spark, "pretokens")).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and the plan knows them
    return table


def _encoded_words(words: DataFrame, ranks, pattern: str) -> DataFrame:
    """``(chunk, numbers, sizes, ids)``: ids of each chunk's words, every distinct word encoded once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        give_back()
        known, now = {}, None
        for batch in _small(batches):
            sizes, ids = [], []
            for class_, blob, n in zip(*(batch.column(k).to_pylist() for k in ("class", "words", "count"))):
                if class_ != now:
                    known, now = {}, class_
                found = []
                for word in _unpack_words(blob, n):
                    if word not in known:
                        known[word] = encode(word.decode())
                    found.append(known[word])
                sizes.append(_pack(np.fromiter(map(len, found), np.int64, n)))
                ids.append(_pack(np.fromiter((i for f in found for i in f), np.int64)))
            yield pa.record_batch([batch.column("chunk"), batch.column("numbers"), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], names=["chunk", "numbers", "sizes", "ids"])
        known.clear()
        give_back()

    return words.sortWithinPartitions("class").mapInArrow(emit, "chunk string, numbers binary, sizes binary, ids binary")


def _chunks(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_ids, positions, parts)`` of every chunk; parts hold the ids of its distinct words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ranks = spark.sparkContext.broadcast(ranks_of(path))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MAX_CLASSES, max(partitions, -(-text_bytes // CLASS_BYTES)))
    packed = _bucketed(_pretokens(docs, pattern, n), n, "chunk")
    words = packed.where("class is not null").select("chunk", "class", "numbers", "words", "count")
    words = words.repartition("class") if n == partitions else words.repartition(n, "class")
    parts = _encoded_words(words, ranks, pattern).repartition(n, "chunk")
    parts = parts.groupBy("chunk").agg(F.collect_list(F.struct("numbers", "sizes", "ids")).alias("parts"))
    positions = packed.where("class is null").select("chunk", "doc_ids", "positions")
    return positions.join(parts.hint("merge"), "chunk", "left").select("doc_ids", "positions", "parts")


def _documents(docs: DataFrame, path: str, pattern: str, decoded: bool) -> DataFrame:
    """``(doc_id, ids)``, and what the ids decode to, of every row of ``docs``."""
    key_type = docs.schema["doc_id"].dataType.simpleString()
    token_bytes = docs.sparkSession.sparkContext.broadcast(_token_bytes(path)) if decoded else None
    names = ["doc_id", "ids", "decoded"] if decoded else ["doc_id", "ids"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows, kind):
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), [kind, pa.binary(), pa.binary()])], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type.value_type
            for k in range(batch.num_rows):
                start, size, flat = _word_table(batch.column(2)[k])
                out, held = [], 0
                for doc_id, numbers in zip(batch.column(0)[k].as_py(), batch.column(1)[k].values):
                    at = _unpack(numbers.as_py())
                    ids = flat[_ranges(start[at], size[at])]
                    row = (doc_id, ids.astype("<u4").tobytes())
                    out.append((*row, _decoded(ids, *token_bytes.value)) if decoded else row)
                    held += 8 + sum(map(len, out[-1][1:]))
                    if held > OUTPUT_BYTES:
                        yield packed(out, kind)
                        out, held = [], 0
                if out:
                    yield packed(out, kind)
            give_back()

    kind = f"doc_id {key_type}, ids binary" + ", decoded binary" * decoded
    return _chunks(docs, path, pattern).mapInArrow(emit, kind)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)`` for every row of ``docs(doc_id, text)``: ids as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded separately by the ranks in the file at ``path``, without
    special tokens, over the whole text. Null and empty texts have no ids (empty binary). Repeated
    rows repeat, null doc_ids stay null, other columns are ignored, an empty table gives no rows.
    """
    return _documents(docs, path, pattern, decoded=False)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, a few at a time, so that what is made of them stays small too."""
    for batch in batches:
        first = 0
        while first < batch.num_rows:
            rows = max(1, min(_ROWS, OUTPUT_BYTES * batch.num_rows // max(1, batch.nbytes)))
            yield batch.slice(first, rows)
            first += rows


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indexes of the ranges, one range after the other."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


def _word_table(parts: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and ids by word number."""
    if not parts.is_valid:
        none = np.zeros(0, np.int64)
        return none, none, none
    found = [(np.cumsum(_unpack(p["numbers"].as_py())), _unpack(p["sizes"].as_py()), _unpack(p["ids"].as_py())) for p in parts.values]
    numbers, sizes, flat = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    start, size = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    start[numbers], size[numbers] = np.cumsum(sizes) - sizes, sizes
    return start, size, flat


def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: start and size of each rank's bytes, and all bytes."""
    tokens = sorted((rank, token) for token, rank in ranks_of(path).items())
    size = np.zeros(tokens[-1][0] + 1, np.int64)
    size[[rank for rank, _ in tokens]] = [len(token) for _, token in tokens]
    return np.cumsum(size) - size, size, np.frombuffer(b"".join(token for _, token in tokens), np.uint8)


def _decoded(ids: np.ndarray, start: np.ndarray, size: np.ndarray, flat: np.ndarray) -> bytes:
    return flat[_ranges(start[ids], size[ids])].tobytes()


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded(doc_id, ids)`` with ``decoded``, the bytes of its ids in order; null ids give null."""
    table = encoded.sparkSession.sparkContext.broadcast(_token_bytes(path))
    key_type = encoded.schema["doc_id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            out = [_decoded(np.frombuffer(ids.as_py(), "<u4").astype(np.int64), *table.value) if ids.is_valid else None for ids in batch.column("ids")]
            yield pa.record_batch([batch.column("doc_id"), batch.column("ids"), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(emit, f"doc_id {key_type}, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of encoding and decoding every document."""
    return _documents(docs, path, pattern, decoded=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
