"""Exact n-gram Jaccard join with signature trees.

1. *Hints.* Each task counts the shingles of the text it reads; those that several of its documents
   hold are summed over the corpus. At most ``MAX_HINTS`` of them (a share of the sum that no more
   can reach) are kept. They only order tokens, common ones last, and never decide a result.
2. *Postings.* Sets that link must share one of their first ``n - ceil(t n) + 1`` tokens in that
   order. A second pass finds tokens that still are in many prefixes; they move behind the others.
   Where one stays in a prefix, its pairs with the tokens after it, as far as the next common token
   of linked sets can be, take its place. A task chains long runs of sets that share a token itself and sends one posting for the
   run, so a token leaves a task a bounded number of times however many documents hold it. Postings
   are shuffled by token; pairs of a short run are kept if sizes and hash-class counts (a bound on
   how far the sets differ) allow a link, long runs are chained. The components of what is left are
   *blocks*: no link crosses one.
3. *Trees.* Each block, in chunks of bounded token count, is searched by a dual traversal of
   signature trees (``signature_tree``). Where a block has several chunks, one set of each component
   found so far is searched first; after that only chunk pairs that are not yet one component are
   traversed against each other, skipping node pairs inside one component.
4. Links become components by star contraction; every document gets the least id of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.session import stored

from .batches import bounded_batches
from .components import components
from .hashing import SPACES, mix, set_digest, shingle_sets
from .locators import Numbered, strategy
from .signature_tree import join_labels, linked_pairs

MAX_HINTS = 1 << 17
HINT_TOKENS = 1 << 21
POSTING_TOKENS = 1 << 19
PIECE = 1 << 15
MAX_BROADCAST_NODES = 1 << 21
CHUNK_SETS = 2048
MAX_RUN = 32
MAX_HOT = 1 << 22
MIN_SPREAD = 0.01
WINDOW = 1.5
CHUNK_TOKENS = 2_000_000


def _batches(batches, width: int, separators: np.ndarray):
    """Documents of Arrow batches of one string column, slice by slice, as sorted token sets."""
    for batch in batches:
        for first, sets in shingle_sets(batch.column(0), width, separators):
            yield batch, first, sets


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts that the receiving side can hold many of."""
    for first in range(0, batch.num_rows, PIECE):
        yield batch.slice(first, PIECE)


def token_hints(docs: DataFrame, width: int, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles and a rough logarithm of how common they are; at most ``MAX_HINTS``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            tokens = np.concatenate(held)
            held.clear()
            tokens.sort()  # in place: there are many, and few of them are met three times
            often = np.unique(tokens[2:][tokens[2:] == tokens[:-2]])
            n = np.searchsorted(tokens, often, "right") - np.searchsorted(tokens, often)
            return pa.record_batch([pa.array(often.view(np.int64)), pa.array(n)], names=["token", "n"])

        seen, held, size = set(), [], 0
        for _, _, sets in _batches(batches, width, separators):
            for tokens in sets:
                if len(tokens) and (key := set_digest(tokens)) not in seen:
                    seen.add(key)
                    held.append(tokens)
                    size += len(tokens)
            if size > HINT_TOKENS:
                yield from _pieces(flush(held))
                seen, size = set(), 0
        if held:
            yield from _pieces(flush(held))

    counts = stored(docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "hints")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return _ranked(counts.where(F.col("n") >= max(8, -(-total // MAX_HINTS))))


def _prefix(tokens: np.ndarray, hints: tuple[np.ndarray, np.ndarray], num: int, den: int, window: float = 1.0) -> tuple[np.ndarray, int]:
    """The tokens up to one beyond ``window`` prefixes in the shared order (tokens without a hint by
    hash, then tokens with one, common ones last), and the prefix length ``n - ceil(t n) + 1``."""
    size = len(tokens)
    length = size - -(-size * num // den) + 1
    end = int(length * window) + 1
    known, ranks = hints
    if len(known):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        rank = np.where(known[at] == tokens, ranks[at], 0)
        if rank[:end].any():
            return tokens[np.lexsort((tokens, rank))[:end]], length
    return tokens[:end], length


def _keys(first: np.ndarray, length: int, hot: np.ndarray) -> np.ndarray:
    """Keys of which two linked sets share one: a prefix token, or for a hot one, the token with each
    token after it up to one beyond the prefix, where the next common token of a linked set must be."""
    if length == len(first) or not len(hot):
        return first[:length]
    is_hot = hot[np.minimum(np.searchsorted(hot, first[:length]), len(hot) - 1)] == first[:length]
    if not is_hot.any():
        return first[:length]
    return np.concatenate([first[:length][~is_hot], *(mix(first[k : k + 1]) ^ first[k + 1 :] for k in np.flatnonzero(is_hot))])


def hot_tokens(docs: DataFrame, hints, width: int, num: int, den: int, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in or shortly after the prefixes of more than ``MAX_RUN`` sets whose sizes vary
    (``MIN_SPREAD``, a squared coefficient of variation), and their ranks: too common to compare all
    that share one, and no group of copies.

    None are named if they are more than ``MAX_HOT`` (32 MB); their sets are then chained unseen, as
    are the sets of a common token whose sizes agree."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(seen):
            tokens, at, n = np.unique(np.concatenate([x for x, _ in seen.values()]), return_inverse=True, return_counts=True)
            sizes = np.repeat([float(k) for _, k in seen.values()], [len(x) for x, _ in seen.values()])
            sums = [np.bincount(at, weights=sizes**k, minlength=len(tokens)) for k in (1, 2)]
            return pa.record_batch([pa.array(tokens.view(np.int64)), pa.array(n), *map(pa.array, sums)], names=["token", "n", "s1", "s2"])

        seen, held = {}, 0
        for _, _, sets in _batches(batches, width, separators):
            for tokens in sets:
                if len(tokens) and (node := set_digest(tokens)[0]) not in seen:
                    first, length = _prefix(tokens, hints.value, num, den, WINDOW)
                    seen[node] = (first.copy(), len(tokens))  # not a view that keeps the whole set
                    held += len(first)
            if held > POSTING_TOKENS:
                yield from _pieces(flush(seen))
                seen, held = {}, 0
        if seen:
            yield from _pieces(flush(seen))

    counts = docs.select("text").mapInArrow(count, "token long, n long, s1 double, s2 double").groupBy("token")
    counts = counts.agg(*(F.sum(k).alias(k) for k in ("n", "s1", "s2"))).where(F.col("n") > MAX_RUN)
    hot = stored(counts.where(F.col("s2") * F.col("n") >= (1 + MIN_SPREAD) * F.col("s1") * F.col("s1")).select("token", "n"), "hot")
    if hot.limit(MAX_HOT + 1).count() > MAX_HOT:
        return np.empty(0, np.uint64), np.empty(0, np.int8)
    return _ranked(hot)


def _ranked(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in order, and one more than the binary logarithm of their counts; a table of bounded size."""
    rows = counts.toArrow()
    tokens = rows.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], (1 + np.log2(rows.column("n").to_numpy()[order])).astype(np.int8)


def _with_hot(hints: tuple[np.ndarray, np.ndarray], hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hints and hot tokens as one order; a token of both keeps the rank of its hint."""
    tokens, first = np.unique(np.concatenate([hints[0], hot[0]]), return_index=True)
    return tokens, np.concatenate([hints[1], hot[1]])[first]


def _counts(tokens: np.ndarray) -> np.ndarray:
    """How many tokens fall into each of ``m`` hash classes, at most 255; m is a power of two near n / 8."""
    m = 1 << min(11, max(4, len(tokens).bit_length() - 3))
    return np.minimum(np.bincount((tokens & np.uint64(m - 1)).astype(np.int64), minlength=m), 255).astype(np.uint8)


def _fits(n_a: int, n_b: int, a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether sets with these sizes and class counts can link: class counts of sets that link differ,
    summed, by no more than the sets do, ``(den - num) / (den + num)`` of their sizes together."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if len(a) < len(b):
        if b.max() == 255:
            return True
        b = b.reshape(-1, len(a)).sum(axis=0, dtype=np.int64)
        b = np.minimum(b, 255)
    apart = int(np.abs(a.astype(np.int64) - b).sum())
    return (den + num) * apart <= (den - num) * (n_a + n_b)


def _pairs_or_chain(token: np.ndarray, low: np.ndarray, high: np.ndarray, coarse: np.ndarray, num: int, den: int):
    """Index pairs of postings sorted by (token, low): all of a short run, neighbours of a long one.

    Returns both ends and whether the pair stands as it is: pairs of two single sets in a short run may
    still be ruled out by their class counts, all other edges stand for whole runs.
    """
    head = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    length = np.diff(np.append(head, len(token)))
    of = np.repeat(np.arange(len(head)), length)
    top = np.maximum.accumulate(high + of * (1 << 40)) - of * (1 << 40)
    p, q, stands = [], [], []
    for gap in range(1, MAX_RUN):
        i = np.arange(max(0, len(token) - gap))
        i = i[(of[i] == of[i + gap]) & (length[of[i]] <= MAX_RUN)]
        if not len(i):
            break
        i = i[high[i] * den >= low[i + gap] * num]
        p.append(i)
        q.append(i + gap)
        stands.append(coarse[i] | coarse[i + gap])
    i = np.arange(max(0, len(token) - 1))
    i = i[(of[i] == of[i + 1]) & (length[of[i]] > MAX_RUN)]
    i = i[top[i] * den >= low[i + 1] * num]
    p.append(i)
    q.append(i + 1)
    stands.append(np.ones(len(i), bool))
    return np.concatenate(p), np.concatenate(q), np.concatenate(stands)


_POSTING = "token long, low long, high long, node long, other long, coarse boolean, counts binary"


def _posting_batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = {"token": pa.int64(), "low": pa.int64(), "high": pa.int64(), "node": pa.int64(), "other": pa.int64(), "coarse": pa.bool_(), "counts": pa.binary()}
    return pa.record_batch([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds))


def _postings(docs: DataFrame, hints, hot, width: int, num: int, den: int, separators: np.ndarray) -> DataFrame:
    """Three kinds of rows. With a token: a posting, of one set or (coarse) of a long run of sets that
    the task holds itself. With ``other``: an edge of such a run. With counts: a set's size and classes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(seen):
            nodes = np.array(list(seen), np.int64)
            sizes = np.array([x[0] for x in seen.values()], np.int64)
            parts = [x[1] for x in seen.values()]
            yield _posting_batch(node=nodes, low=sizes, counts=[x[2].tobytes() for x in seen.values()])
            token = np.concatenate(parts)
            at = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            order = np.lexsort((nodes[at], sizes[at], token))
            token, at = token[order], at[order]
            size = sizes[at]
            head = np.append(True, (token[1:] != token[:-1]) | (size[:-1] * den < size[1:] * num))
            start = np.flatnonzero(head)
            length = np.diff(np.append(start, len(token)))
            long = length > MAX_RUN
            inner = np.flatnonzero(~head & np.repeat(long, length))
            if len(inner):
                ties = np.unique(np.stack([at[inner - 1], at[inner]]), axis=1)
                yield _posting_batch(node=nodes[ties[0]], other=nodes[ties[1]])
            keep = head | ~np.repeat(long, length)
            top = np.where(np.repeat(long, length), size[np.repeat(start + length - 1, length)], size)
            yield _posting_batch(
                token=token[keep].view(np.int64), low=size[keep], high=top[keep], node=nodes[at[keep]], coarse=np.repeat(long, length)[keep]
            )

        seen, held = {}, 0
        for _, _, sets in _batches(batches, width, separators):
            for tokens in sets:
                if len(tokens) and (node := set_digest(tokens)[0]) not in seen:
                    keys = _keys(*_prefix(tokens, hints.value, num, den), hot.value)
                    seen[node] = (len(tokens), keys.copy(), _counts(tokens))
                    held += len(keys)
            if held > POSTING_TOKENS:
                for batch in flush(seen):
                    yield from _pieces(batch)
                seen, held = {}, 0
        if seen:
            for batch in flush(seen):
                yield from _pieces(batch)

    return docs.select("text").mapInArrow(emit, _POSTING)


def _candidates(postings: DataFrame, num: int, den: int) -> DataFrame:
    """``(a, b, stands)`` edges between sets that share a token, and ``(a, size, counts)`` of the sets."""

    def out(a, b=None, stands=None, size=None, counts=None):
        n = len(a)
        return pa.record_batch(
            [
                pa.array(a, pa.int64()),
                pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64()),
                pa.nulls(n, pa.bool_()) if stands is None else pa.array(stands, pa.bool_()),
                pa.nulls(n, pa.int64()) if size is None else size,
                pa.nulls(n, pa.binary()) if counts is None else counts.cast(pa.binary()),
            ],
            names=["a", "b", "stands", "size", "counts"],
        )

    def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(name).to_numpy(zero_copy_only=False)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(columns):
            token, low, high, node, coarse = columns
            p, q, stands = _pairs_or_chain(token, low, high, coarse, num, den)
            a, b = np.maximum(node[p], node[q]), np.minimum(node[p], node[q])
            pair = mix(mix(a.view(np.uint64)) ^ b.view(np.uint64)) & ~np.uint64(1) | stands
            _, once = np.unique(pair, return_index=True)
            once = once[a[once] != b[once]]
            return out(a[once], b[once], stands[once])

        rest = None
        for batch in batches:
            counted = batch.column("counts").is_valid()
            sets = batch.filter(counted)
            if sets.num_rows:
                yield out(sets.column("node"), size=sets.column("low"), counts=sets.column("counts"))
            edges = batch.filter(batch.column("other").is_valid())
            if edges.num_rows:
                yield out(edges.column("node"), edges.column("other"), np.ones(edges.num_rows, bool))
            found = batch.filter(batch.column("token").is_valid())
            if not found.num_rows:
                continue
            now = [numbers(found, k) for k in ("token", "low", "high", "node", "coarse")]
            if rest is not None:
                now = [np.append(x, y) for x, y in zip(rest, now)]
            cut = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1 if (now[0] != now[0][-1]).any() else 0
            if cut:
                yield solve([x[:cut] for x in now])
            rest = [x[cut:] for x in now]
        if rest is not None:
            yield solve(rest)

    spread = F.coalesce("token", F.xxhash64("node", "other"))
    return (
        postings.withColumn("key", spread)
        .repartition("key")
        .drop("key")
        .sortWithinPartitions("token", "low", "node")
        .mapInArrow(emit, "a long, b long, stands boolean, size long, counts binary")
    )


def _edges(found: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate edges that size and class counts leave."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(k).to_numpy() for k in ("size_a", "size_b")]
            counts = [[np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(k)] for k in ("counts_a", "counts_b")]
            fits = [_fits(*sides, num, den) for sides in zip(*sizes, *counts)]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    pairs = stored(found.where("b is not null").groupBy("a", "b").agg(F.max("stands").alias("stands")), "pairs")
    sets = found.where("counts is not null").select(F.col("a").alias("node"), "size", "counts").dropDuplicates(["node"])
    for end in ("a", "b"):
        side = sets.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("counts").alias(f"counts_{end}"))
        pairs_in = pairs.where("not stands") if end == "a" else tested
        tested = pairs_in.join(side.hint("merge"), end)
    tested = tested.select("a", "b", "size_a", "size_b", "counts_a", "counts_b").mapInArrow(keep, "a long, b long")
    return pairs.where("stands").select("a", "b").union(tested)


def _chunks(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(node, block, parts, task)`` of every set in a block; blocks are dealt into chunks by a hash."""
    sizes = found.where("counts is not null").groupBy(F.col("a").alias("node")).agg(F.first("size").alias("n"))
    sizes = stored(blocks.join(sizes.hint("merge"), "node"), "sizes")
    weights = sizes.groupBy("block").agg(F.count("*").alias("held"), F.sum("n").alias("weight"))
    parts = F.greatest(F.ceil(F.col("held") / CHUNK_SETS), F.ceil(F.col("weight") / CHUNK_TOKENS)).cast("long")
    chunk = F.pmod(F.xxhash64("node"), F.col("parts"))
    dealt = sizes.join(weights.select("block", parts.alias("parts")).hint("merge"), "block").withColumn("chunk", chunk)
    return stored(dealt.select("node", "block", "parts", "chunk", F.xxhash64("block", "chunk").alias("task")), "chunks")


def _documents_with_sets(docs: DataFrame, chunks: DataFrame, width: int, separators: np.ndarray) -> DataFrame:
    """Per document its set's size, digests and task; the set itself once per reading task for blocks.

    The tasks of sets are broadcast while there are at most ``MAX_BROADCAST_NODES`` (32 MB); beyond
    that every set is written and a shuffle join finds those of blocks.
    """
    spark = docs.sparkSession
    shared = None
    if chunks.limit(MAX_BROADCAST_NODES + 1).count() <= MAX_BROADCAST_NODES:
        table = chunks.select("node", "task").toArrow().sort_by("node")
        shared = spark.sparkContext.broadcast((table.column("node").to_numpy(), table.column("task").to_numpy()))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        for batch, first, sets in _batches(batches, width, separators):
            digests = np.array([set_digest(s) for s in sets], np.int64).reshape(-1, 2)
            give = np.array([len(s) > 0 for s in sets], bool)
            task = np.zeros(len(sets), np.int64)
            if shared is not None:
                nodes, tasks = shared.value
                at = np.minimum(np.searchsorted(nodes, digests[:, 0]), max(0, len(nodes) - 1))
                give &= (nodes[at] == digests[:, 0]) if len(nodes) else False
                task = tasks[at] if len(nodes) else task
            kept = []
            for k, s in enumerate(sets):
                fresh = bool(give[k]) and (key := tuple(digests[k])) not in sent
                if fresh:
                    sent.add(key)
                kept.append(s.view(np.int64) if fresh else None)
            yield pa.record_batch(
                [
                    batch.column(1).slice(first, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests[:, 0]),
                    pa.array(digests[:, 1]),
                    pa.array(task),
                    pa.array(kept, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "node", "check", "task", "tokens"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    kind = f"doc_id {key}, n_shingles long, node long, check long, task long, tokens array<long>"
    rows = stored(docs.select("text", "doc_id").mapInArrow(emit, kind), "sets")
    if shared is None:
        found = rows.where("tokens is not null").drop("task").join(chunks.select("node", "task").hint("merge"), "node")
        light = rows.withColumn("tokens", F.lit(None).cast("array<long>")).select("doc_id", "n_shingles", "node", "check", "task", "tokens")
        return light, found.select("node", "check", "task", "tokens")
    return rows, rows.where("tokens is not null").select("node", "check", "task", "tokens")


def _search(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links inside every task group: rows ``(task, side, label, node, check, tokens)`` -> ``(a, a2, b, b2)``.

    A group holds a bounded number of tokens. Copies of one set inside a group count once. The links
    returned are enough to connect what is linked: one for each pair of components they join.
    """

    def solve(rows: list[tuple]) -> np.ndarray:
        unique = {}
        for side, label, node, check, tokens in rows:
            unique.setdefault((side, node, check), (label, tokens))
        if len(unique) < 2:
            return np.empty((0, 4), np.int64)
        keys = np.array([k[1:] for k in unique], np.int64)
        side = np.array([k[0] for k in unique], np.int64)
        _, labels = np.unique(np.array([x[0] for x in unique.values()]), return_inverse=True)
        sets = [x[1].view(np.uint64) for x in unique.values()]
        found = []
        for p, q in linked_pairs(sets, num, den, labels, side):
            new = labels[p] != labels[q]
            p, q = p[new], q[new]
            if not len(p):
                continue
            ties = np.sort(np.stack([labels[p], labels[q]]), axis=0)
            _, first = np.unique(ties, axis=1, return_index=True)
            found.append(np.hstack([keys[p[first]], keys[q[first]]]))
            labels = join_labels(labels, p, q)
        return np.concatenate(found) if found else np.empty((0, 4), np.int64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(links):
            return pa.record_batch([pa.array(np.ascontiguousarray(links[:, k])) for k in range(4)], names=["a", "a2", "b", "b2"])

        task, held = None, []
        for batch in batches:
            now, side, label, node, check = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            tokens = batch.column(5)
            flat, cuts = tokens.flatten().to_numpy(), np.append(0, np.cumsum(tokens.value_lengths().to_numpy()))
            for k in range(len(now)):
                if now[k] != task:
                    if held:
                        yield packed(solve(held))
                    task, held = now[k], []
                held.append((side[k], label[k], node[k], check[k], flat[cuts[k] : cuts[k + 1]].copy()))
        if held:
            yield packed(solve(held))

    return (
        rows.select("task", "side", "label", "node", "check", "tokens")
        .repartition("task")
        .sortWithinPartitions("task")
        .mapInArrow(emit, "a long, a2 long, b long, b2 long")
    )


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with the label of their component so far; a node without links is its own component."""
    ids = F.xxhash64("node", "check")
    found = components(links.select(F.xxhash64("a", "a2").alias("a"), F.xxhash64("b", "b2").alias("b")))
    found = found.withColumnRenamed("node", "id")
    return nodes.withColumn("id", ids).join(found.hint("merge"), "id", "left").withColumn("label", F.coalesce("root", "id")).drop("id", "root")


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, separators: np.ndarray = SPACES) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``.

    Documents link when ``den * |intersection| >= num * |union|`` of their distinct shingles of
    ``width`` words; words are runs of bytes outside ``separators``, A-Z folded. A text of fewer
    words is one shingle; a null or empty text, or one without words, has none and links with
    nothing: its component is its own id. ``component_id`` is the least doc_id reachable by links
    (null ids are passed over; null if no document of the component has an id). Equal rows and equal
    sets share a component. Other columns of ``docs`` are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    bounded_batches(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast
    hints = share(token_hints(docs, width, separators))
    hot = hot_tokens(docs, hints, width, num, den, separators)
    order = share(_with_hot(hints.value, hot))
    found = stored(_candidates(_postings(docs, order, share(hot[0]), width, num, den, separators), num, den), "found")
    blocks = stored(components(_edges(found, num, den)), "blocks").withColumnRenamed("root", "block")
    chunks = _chunks(found, blocks)
    rows, sets = _documents_with_sets(docs, chunks, width, separators)
    first = sets.withColumn("label", F.xxhash64("node", "check")).withColumn("side", F.lit(0))
    links = stored(_search(first, num, den), "links")
    large = stored(chunks.where("parts > 1").select("node", "block", "chunk"), "large")
    if large.limit(1).count():
        links = _across_chunks(stored(sets.drop("task").join(large.hint("merge"), "node"), "split"), links, num, den)

    classes = rows.where("n_shingles > 0").groupBy("node", "check").agg(F.min("doc_id").alias("least"))
    ends = links.select(F.col("a").alias("node"), F.col("a2").alias("check")).union(links.select("b", "b2")).distinct()
    tied = _labelled(ends, links).join(classes.hint("merge"), ["node", "check"])
    least = tied.groupBy("label").agg(F.min("least").alias("component"))
    tied = stored(tied.join(least.hint("merge"), "label").select("node", "check", "component"), "tied")
    classes = classes.join(tied.hint("merge"), ["node", "check"], "left")
    classes = stored(classes.select("node", "check", F.coalesce("component", "least").alias("component")), "classes")
    return rows.select("doc_id", "n_shingles", "node", "check").join(classes.hint("merge"), ["node", "check"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _across_chunks(sets: DataFrame, links: DataFrame, num: int, den: int) -> DataFrame:
    """The links of blocks that take several chunks, beside those found inside each chunk."""
    # one set of every component and chunk, in groups of bounded size
    nodes = stored(_labelled(sets.select("block", "chunk", "node", "check", F.size("tokens").alias("n")), links), "labels")
    head = nodes.groupBy("block", "chunk", "label").agg(F.min_by(F.struct("node", "check", "n"), F.xxhash64("node", "check")).alias("h"))
    head = head.select("block", "label", "h.node", "h.check", "h.n")
    sizes = head.groupBy("block").agg(F.count("*").alias("held"), F.sum("n").alias("weight"))
    groups = F.greatest(F.ceil(F.col("held") / CHUNK_SETS), F.ceil(F.col("weight") / CHUNK_TOKENS)).cast("long")
    head = head.join(sizes.select("block", groups.alias("groups")).hint("merge"), "block")
    head = head.withColumn("task", F.xxhash64("block", F.pmod(F.xxhash64("node", "check", F.lit(1)), F.col("groups")))).withColumn("side", F.lit(0))
    tokens = sets.select("block", "node", "check", "tokens").hint("merge")
    links = stored(links.union(_search(head.drop("block").join(tokens, ["node", "check"]), num, den)), "links")

    # chunk pairs that are not one component yet
    nodes = stored(_labelled(sets.select("block", "chunk", "node", "check"), links), "labels")
    chunks = stored(nodes.groupBy("block", "chunk").agg(F.min("label").alias("lo"), F.max("label").alias("hi")), "chunks")
    other = chunks.select("block", F.col("chunk").alias("chunk2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = chunks.join(other.hint("merge"), "block").where("chunk < chunk2 and not (lo = hi and lo2 = hi2 and lo = lo2)")
    pairs = pairs.withColumn("task", F.xxhash64("block", "chunk", "chunk2")).select("block", "chunk", "chunk2", "task")
    sides = stored(
        pairs.select("block", "chunk", "task", F.lit(0).alias("side")).union(pairs.select("block", "chunk2", "task", F.lit(1).alias("side"))), "pairs"
    )
    nodes = nodes.join(sides.hint("merge"), ["block", "chunk"]).select("task", "side", "label", "node", "check")
    return stored(links.union(_search(nodes.join(tokens.drop("block"), ["node", "check"]), num, den)), "links")


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, separators: np.ndarray = SPACES) -> DataFrame:
    """One row of ``docs`` for every component: that of the least doc_id, null ids last and equal ids in
    the order they are stored. Rows without words link with nothing and all stay. All columns are kept."""
    rows = Numbered(docs)
    assigned = stored(jaccard_components(rows.keyed(), width, num, den, separators).select("doc_id", "component_id"), "assigned")
    others = assigned.where("doc_id <> component_id").select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    members = stored(others.union(others.select(F.col("component").alias("row"), "component").distinct()), "members")
    ids = rows.ids().join(strategy(members), F.col("number") == F.col("row")).select("number", "component", "doc_id")
    ids = stored(ids, "ids")
    kept = ids.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "number"))["number"].alias("kept"))
    return rows.without(ids.join(kept.hint("merge"), "component").where("number <> kept").select("number"))
