"""Exact and near duplicates."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from brute import brute_classes, lowered
from larkspan.llm import exact_dedup, near_dedup
from larkspan.llm import queries as q


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_against_brute_force(awkward, documents, bits):
    for df in (awkward, documents):
        got = exact_dedup.exact_duplicates(df, hash_bits=bits).collect()
        groups = {}
        for r in df.select("doc_id", "text").collect():
            groups.setdefault(lowered(r.text), []).append(r.doc_id)
        want = sorted(((i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids), key=repr)
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
        assert sum(r.kept for r in got) == len(groups) == len({r.text_sha256 for r in got if r.kept})
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_without_copies(awkward, nothing):
    left = exact_dedup.without_copies(awkward)
    assert left.columns == awkward.columns
    assert sorted((lowered(r.text) for r in left.collect())) == sorted({lowered(r.text) for r in awkward.collect()})
    assert exact_dedup.exact_duplicates(nothing).count() == 0 == exact_dedup.without_copies(nothing).count()


def test_chunks_are_content_defined(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    text = " ".join(words)
    df = spark.createDataFrame([(text,), ("some new words in front " + text,)], "text string")
    a, b = (r[0] for r in df.select(exact_dedup.chunks(df.text)).collect())
    assert "".join(a) == text and len(set(a) & set(b)) > 0.8 * len(a)


def varied(rng, n=120):
    base = [rng.choice(["ta", "ro", "mi", "ne", "ku"]) + str(rng.randint(0, 400)) for _ in range(n)]
    out = [" ".join(base)]
    for changes in (1, 1, 2, 3, 4, 6, 9, 14):
        w = list(base)
        for _ in range(changes):
            w[rng.randrange(n)] = f"new{rng.random()}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [256, 4])
def test_near_against_brute_force(spark, block):
    rng = random.Random(8)
    texts = [t for _ in range(25) for t in varied(rng)]
    texts += ["short text", "short text", "Short  TEXT", "one", "", " ", "a b c d e f", "a b c d e g"] + ["to be or not to be " * k for k in (3, 30, 31)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, near_dedup.Settings(block=block)).collect()
    want = brute_classes(dict(enumerate(texts)))
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_near_query(spark, documents):
    got = q.QUERIES["op5_near_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes({r.doc_id: r.text for r in documents.collect()})


def test_near_edges(awkward, nothing):
    got = near_dedup.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    assert {r.class_id for r in got if r.doc_id in (1, 2)} == {1} and sum(r.kept for r in got if r.class_id == 1) == 1
    assert {r.class_id for r in got if r.doc_id in (3, 4, 5, 7)} == {3}
    left = near_dedup.without_near_copies(awkward)
    assert left.columns == awkward.columns and {1, 3, 6, 8} <= {r.doc_id for r in left.collect()}
    assert near_dedup.near_duplicates(nothing).count() == 0 == near_dedup.without_near_copies(nothing).count()


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    for trial in range(6):
        e = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
        a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
        x, y = (e[:45], a[:45]), (e[15:], b[15:])
        x, y = ((s[np.argsort(s)], w[np.argsort(s)]) for s, w in (x, y))
        j = near_dedup.similarity(x, y)
        same = (near_dedup.signature(*x, 4000) == near_dedup.signature(*y, 4000)).mean()
        assert abs(same - j) < 4 * (j * (1 - j) / 4000) ** 0.5 + 0.002


def test_components_of_a_chain(spark):
    n = 60
    names = [f"{(i * 37) % n:02d}".encode() for i in range(n)]
    links = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in zip(names, names[1:])] + [(bytearray(b"x"), bytearray(b"y"))], "a binary, b binary")
    roots = {bytes(r.node): bytes(r.root) for r in near_dedup.components(links).collect()}
    assert roots == {k: b"00" for k in names} | {b"x": b"x", b"y": b"x"}
