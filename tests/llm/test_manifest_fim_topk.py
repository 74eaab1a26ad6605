"""Operators 11 to 13 against brute force, and their defined results in edge cases."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gradeloom.llm import fim_chunks, merkle, topk_search
from gradeloom.session import local_session
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def spark():
    return local_session()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at // 3 * 3
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 3])))
        at //= 3
    return out


def brute_manifest(rows):
    """``rows``: (source, doc_id, leaf)."""
    by_source = {}
    for source, doc_id, leaf in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        by_source.setdefault(source, []).append((doc_id, leaf))
    trees = {s: climb([x[1] for x in leaves]) for s, leaves in by_source.items()}
    top = climb([t[-1][0] for t in trees.values()])
    return sorted(
        ((s, i, leaf, trees[s][-1][0], top[-1][0], tuple(siblings(trees[s], k) + siblings(top, nth))) for nth, s in enumerate(by_source) for k, (i, leaf) in enumerate(by_source[s])),
        key=repr,
    )


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest(spark, monkeypatch, levels):
    """Trees of every size around the arity's powers; null sources and ids, repeated rows, extra columns; blocks of several sizes."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    rows = [(f"s{n}", k, sha(f"{n} {k}")) for n in (1, 2, 3, 4, 9, 10, 28, 31) for k in range(n)]
    rows += [(None, 5, sha("a")), (None, None, sha("b")), (None, 5, sha("a")), ("", 1, sha("c")), ("é", 1, sha("d")), ("z" * 5000, 1, sha("e"))]
    table = spark.createDataFrame([(*r, "x") for r in rows], "source string, doc_id long, leaf string, tampered string")
    found = merkle.manifest(table).withColumn("folded", merkle.root_of(F.col("leaf"), F.col("proof"))).collect()
    assert all(r.folded == r.root and r.tampered == "x" for r in found)
    assert sorted(((r.source, r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.proof))) for r in found), key=repr) == brute_manifest(rows)


def test_manifest_of_one_and_none(spark):
    one = spark.createDataFrame([(None, 3, sha("x"))], "source string, doc_id long, leaf string")
    row = merkle.manifest(one).first()
    assert row.leaf == row.subroot == row.root and row.proof == []
    assert merkle.manifest(one.limit(0)).count() == 0


def test_leaf(spark):
    row = spark.createDataFrame([(7, None, "é\n", "")], "a long, b string, c string, d string")
    assert row.select(merkle.leaf(*map(F.col, "abcd"))).first()[0] == sha("1:7-3:é\n0:")


TEXTS = ["", "a", "\n", "a\n", "a\nb", "\n\n\n", "é€😀\n" * 3000 + "end", "no line end " * 9000, "x\n<P", "holds <S> inside\n", "<", "<P\n>", "line\n" * 40_000]


def lines(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def brute_cut(text, h1, h2):
    units = lines(text)
    first, second = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    return len(units), len("".join(units[:first])), len("".join(units[:second])), any(m in text for m in ("<P>", "<S>", "<M>"))


@pytest.mark.parametrize("digest", [None, lambda _: 1])
def test_cuts_from_chunks(monkeypatch, digest):
    """Every cut of every text equals the plain one, for chunks of any length, a full memo and digests that clash."""
    draw = random.Random(3)
    memo = fim_chunks.Memo(limit=200, **({"digest": digest} if digest else {}))
    for text in TEXTS[:6] + TEXTS[8:12] + ["é\n😀 <M" + ">" * k for k in range(2)]:
        data = text.encode()
        for size in (1, 2, 3, 7):
            places = [k for k in range(size, len(data), size) if data[k] & 0xC0 != 0x80]
            chunks = [memo(p) for p in fim_chunks.pieces(memoryview(data), np.array(places, int))]
            assert b"".join(c.content for c in chunks) == data
            for _ in range(20):
                h1, h2 = draw.getrandbits(32), draw.getrandbits(32)
                assert fim_chunks.cut(chunks, h1, h2) == brute_cut(text, h1, h2)


def test_boundaries_follow_content(monkeypatch):
    """A shared passage is cut alike wherever it stands, however the bytes are sliced; never inside a code point; long runs are cut."""
    draw = np.random.default_rng(1)
    passage = draw.integers(32, 127, 50_000).astype(np.uint8)
    ahead = draw.integers(32, 127, 3_333).astype(np.uint8)
    alone, behind = fim_chunks.boundaries(passage), fim_chunks.boundaries(np.concatenate([ahead, passage]))
    assert len(alone) > 20 and set(alone[alone > 32] + 3_333) == set(behind[behind > 3_333 + 32])
    monkeypatch.setattr(fim_chunks, "SLICE", 1_000)
    assert (fim_chunks.boundaries(passage) == alone).all()
    wide = np.frombuffer(("é€😀" * 20_000).encode(), np.uint8)
    assert ((wide[fim_chunks.boundaries(wide)] & 0xC0) != 0x80).all()
    run = b"a" * 300_000
    assert [len(p) for p in fim_chunks.pieces(memoryview(run), np.empty(0, int))] == [65_536] * 4 + [300_000 - 4 * 65_536]


def test_fill_in_middle(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, None), (None, "a\nb\nc"), (3, TEXTS[6]), (3, TEXTS[6]), (90, "x" * 2_000_000 + "\n<M>")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "form", "cuts", "first", "draw_3", "output")})
    found = fim_chunks.fill_in_middle(table)
    assert found.where(~F.col("text").eqNullSafe(fim_chunks.restored(F.col("output"), F.col("form")))).count() == 0
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found.collect()), key=repr)
    want = []
    for i, t in rows:
        t, digest = t or "", sha(f"7:{'' if i is None else i}")
        h1, h2, _, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
        n, a, b, marked = brute_cut(t, h1, h2)
        form = "plain" if not t or marked else "spm" if h4 % 100 < 50 else "psm"
        parts = {"P": t[:a], "S": t[b:], "M": t[a:b]}
        out = t if form == "plain" else "".join(f"<{c.upper()}>{parts[c.upper()]}" for c in form)
        want.append((i, n, form, *((None, None) if form == "plain" else (a, b - a)), out))
    assert got == sorted(want, key=repr) and {g[2] for g in got} == {"plain", "psm", "spm"}
    assert fim_chunks.fill_in_middle(table.limit(0)).count() == 0
    assert {r.form for r in fim_chunks.fill_in_middle(table, rate=0).collect()} == {"plain"}


def test_prefix_of_spm_holds_its_own_middle(spark):
    """Texts that end like a control string begins."""
    rows = spark.createDataFrame([(k, f"<\n<P\n<S\n<M\n{'<' * (k % 3)}") for k in range(40)], "doc_id long, text string")
    found = fim_chunks.fill_in_middle(rows)
    assert found.where(F.col("text") != fim_chunks.restored(F.col("output"), F.col("form"))).count() == 0
    assert found.where("form = 'plain'").count() == 0


def brute_top(corpus, queries, k):
    whole = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    ints = lambda v: [int(np.floor(256.0 * x)) for x in v]
    fits = lambda s: max(min(s, 2**63 - 1), -(2**63) + 1)
    rows = [(i, ints(v)) for i, v in corpus if i is not None and whole(v)]
    out = []
    for q, v in queries:
        if q is not None and whole(v):
            v = ints(v)
            best = sorted((-fits(sum(a * b for a, b in zip(v, w))), i) for i, w in rows if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard, tile, cell, spread", [(4096, 8192, 128, 64), (7, 3, 2, 1), (16, 1000, 1, 40)])
def test_top_k(spark, monkeypatch, shard, tile, cell, spread):
    """Ties, repeated and hot vectors, nulls, non-finite and huge components, unlike widths; blocks, cells and merges of several sizes."""
    for name, value in (("SHARD_ROWS", shard), ("TILE_ROWS", tile), ("CELL_SHARDS", cell), ("LEAST_CELLS", spread)):
        monkeypatch.setattr(topk_search, name, value)
    draw = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in draw.integers(-3, 4, 4) / 4]) for i in draw.permutation(200)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)] + [(300, None), (301, [1.0, None, 1.0, 1.0]), (302, [float("nan"), 1.0, 1.0, 1.0]), (303, [float("inf")] * 4), (None, [1.0] * 4)]
    rows += [(350, [0.5, 1.0]), (351, [1.0, 1.0]), (400, []), (401, []), (450, [1e6] * 4), (451, [3e9, 1.0, 1.0, -2.0]), (452, [1e30, 0.25, 0.25, 0.25]), (500, [0.5] * 4), (500, [0.5] * 4)]
    table = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5).withColumn("tile", F.lit(1))
    queries = table.where("id % 50 = 0 or id in (351, 452)")
    asked = [(i, v) for i, v in rows if i is not None and (i % 50 == 0 or i in (351, 452))]
    got = sorted(map(tuple, topk_search.top_k(table, queries, k=5).collect()))
    assert got == brute_top(rows, asked, 5)


def test_top_k_of_empty_tables(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<float>")
    for corpus, queries in ((table, table.limit(0)), (table.limit(0), table), (table.limit(0), table.limit(0)), (table, table)):
        found = topk_search.top_k(corpus, queries)
        assert found.columns == ["query_id", "rank", "vec_id", "score"] and found.count() == 0


def test_whole_vectors():
    column = pa.array([[1.0], None, [None, 2.0], [], [float("inf")], [3.0, 4.0]], pa.list_(pa.float32()))
    assert topk_search._whole(column).tolist() == [0, 3, 5] and topk_search._whole(column.slice(2)).tolist() == [1, 3]
