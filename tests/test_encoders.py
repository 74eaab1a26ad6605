"""Encoders and their comparisons against plain hashing, and what is built of medians against a plain run."""

import re
from itertools import combinations

import numpy as np
import pytest

from gradeloom import catalog
from gradeloom.functions import extension
from gradeloom.operators import topics, vectors
from gradeloom.session import local_session
from tests.test_spread import brute_median

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return local_session()


def murmur3(data, seed=42):
    """32 bits of the public hash that the default encoder counts words by, as a signed number."""
    mask, h = 0xFFFFFFFF, seed
    turned = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    mixed = lambda k: turned(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    whole = len(data) // 4 * 4
    for k in range(0, whole, 4):
        h = (turned(h ^ mixed(int.from_bytes(data[k : k + 4], "little")), 13) * 5 + 0xE6546B64) & mask
    if data[whole:]:
        h ^= mixed(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> shift)) * factor & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def words_of(text):
    """Split at each blank character, as the tokenizer does: trailing empty words go, others stay."""
    found = re.split(r"[ \t\n\x0b\f\r]", text.lower())
    while len(found) > 1 and found[-1] == "":
        found.pop()
    return found


def test_encoder_by_plain_hashing(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    plain, bits = {}, {}
    for i, text in docs.items():
        v, f = np.zeros(64), np.zeros(256)
        for word in words_of(text):
            v[murmur3(word.encode()) % 64] += 1
            f[murmur3(word.encode()) % 256] = 1
        plain[i], bits[i] = v / np.linalg.norm(v), f
    found = catalog.queries()["x1_register_encoder"](spark, DATA).collect()
    assert len(found) == len(docs) and extension.encoder_of("hashing").dim == 64 and extension.encoder_of("features").dim == 256
    for r in found:
        assert np.allclose(r.vector, plain[r.doc_id], atol=6e-5)
        if r.doc_id + 1 in docs:
            other = r.doc_id + 1
            assert abs(r.cosine_next - plain[r.doc_id] @ plain[other]) < 2e-5
            both, either = (bits[r.doc_id] * bits[other]).sum(), np.maximum(bits[r.doc_id], bits[other]).sum()
            assert abs(r.overlap_next - both / either) < 1e-5
        else:
            assert r.cosine_next is None and r.overlap_next is None


def test_overlap_through_search_and_pairs(spark):
    """A comparison that isn't a product: through search, pairs and stated pairs; also by an encoder of one's own."""
    draw = np.random.default_rng(8)
    x = (draw.random((80, 12)) < 0.3) * draw.normal(size=(80, 12))
    x[5] = 0
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    f = x != 0
    like = np.array([[(a & b).sum() / max(1, (a | b).sum()) for b in f] for a in f])
    found = vectors.search(table, table.where("id < 9").withColumnRenamed("id", "query_id"), 0.5, 3, 6, encoder="features").collect()
    order = {q: sorted(range(80), key=lambda k: (-like[q, k], k))[:6] for q in range(9)}
    assert {(r.query_id, r.id, r.nth) for r in found} == {(q, k, n) for q in order for n, k in enumerate(order[q], 1) if like[q, k] >= 0.5 or n <= 3}
    pairs = vectors.similar_pairs(table, 0.4, "features").collect()
    assert {(r.a, r.b) for r in pairs} == {(a, b) for a, b in combinations(range(80), 2) if like[a, b] >= 0.4}
    stated = spark.createDataFrame([(1, 2), (5, 6), (7, 7)], "a long, b long")
    for r in vectors.compare_kps(table, stated, "features").collect():
        assert abs(r.similarity - like[r.a, r.b]) < 1e-12 and r.method == "overlap"
    extension.register_encoder("own", lambda df, text: df, 12)
    assert {r.method for r in vectors.compare_kps(table, stated, "own").collect()} == {"cosine"}


def test_vector_cascade(spark):
    """Points from their first five questions, topics from two points or more; disputed points and lone topics are left out."""
    draw = np.random.default_rng(9)
    x = {q: draw.normal(size=5) for q in range(60)}
    members = [(q, f"kp{q % 7}") for q in x] + [(1, "kp2")]
    quality = {f"kp{k}": "disputed" if k == 3 else "stable" for k in range(7)}
    of = [("a", "kp0"), ("a", "kp1"), ("a", "kp2"), ("b", "kp4"), ("b", "kp3"), ("c", "kp5"), ("c", "kp6")]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = topics.vector_cascade(
        make([(q, v.tolist()) for q, v in x.items()], "id long, vector array<double>"), make(members, "qa_id long, kp_id string"),
        make(list(quality.items()), "kp_id string, quality string"), make(of, "topic string, kp_id string"),
    )
    points = {}
    for kp in quality:
        if quality[kp] != "disputed":
            rows = [x[q] for q in sorted(q for q, k in members if k == kp)[:5]]
            points[kp] = brute_median(rows, [1.0] * len(rows))
    got = {r.kp_id: np.array(r.vector) for r in found[0].collect()}
    assert got.keys() == points.keys() and all(np.allclose(got[k], points[k], atol=1e-9) for k in points)
    held = {t: [points[k] for s, k in sorted(of) if s == t and k in points] for t in "abc"}
    topics_ = {t: brute_median(v, [1.0] * len(v)) for t, v in held.items() if len(v) >= 2}
    got = {r.topic: np.array(r.vector) for r in found[1].collect()}
    assert got.keys() == topics_.keys() == {"a", "c"} and all(np.allclose(got[k], topics_[k], atol=1e-9) for k in topics_)
