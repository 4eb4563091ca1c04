"""Sharding, mixing, the pipeline and the registered queries."""

import hashlib
import os
import re
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from larkspan.llm import language_id, mixing, sharding
from larkspan.llm import queries as q
from tokenizers import Tokenizer
from tools.check_oracle import TABLES, canonical

from brute import brute_classes, lowered

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def least_capacity(sizes, shards):
    """Dynamic programme over all contiguous partitions."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    best = [0] + [10**18] * len(sizes)
    for _ in range(shards):
        best = [min(max(best[j], int(sums[i] - sums[j])) for j in range(i + 1)) for i in range(len(sizes) + 1)]
    return best[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 90), min_size=1, max_size=25), st.integers(1, 7))
def test_capacity_against_all_partitions(sizes, shards):
    ends = np.cumsum(sizes)
    known = sharding.Known(np.arange(len(sizes)), ends)
    total = int(ends[-1])
    capacity = sharding.smallest_capacity(known, total, max(sizes), shards)
    assert capacity == least_capacity(sizes, shards) and not known.noted
    cuts = sharding.cuts_within(known, total, shards, capacity)
    assert len(cuts) == shards and cuts[-1] == total and max(np.diff([0, *cuts])) <= capacity and set(cuts) <= {*ends.tolist()}


@pytest.mark.parametrize("boundaries", [1 << 18, 7])
def test_sharding(documents, awkward, nothing, boundaries):
    for df, shards in ((documents, 40), (awkward, 3)):
        s = sharding.Settings(shards=shards, boundaries=boundaries)
        got = sharding.shard(df, s).collect()
        texts = df.select("doc_id", "text").collect()
        want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in texts)
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
        assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
        groups, homes = {}, {}
        for r in got:
            homes.setdefault(r.text_crc32, set()).add(r.shard)
        assert max(map(len, homes.values())) == 1
        for r in texts:
            groups.setdefault(r.text or "", []).append(r.doc_id)
        ordered = sorted(groups, key=lambda t: min((i for i in groups[t] if i is not None), default=1 << 62))
        sizes = [(len(t.encode()) + 16) * len(groups[t]) for t in ordered]
        loads = Counter()
        for r in got:
            loads[r.shard] += r.size
        if df is documents:
            assert max(loads.values()) == least_capacity(sizes, shards)
        for shard in loads:
            assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert sharding.shard(nothing).count() == 0


def resharing(sizes, weights):
    """The rule as it is told: cap, then share the excess anew until none is above."""
    total, left = 1.5 * sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while left:
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in left)
        share = {i: rest * weights[i] / sum(weights[j] for j in left) for i in left}
        over = {i for i in left if share[i] > 2 * sizes[i]}
        for i in over or left:
            out[i] = 2.0 * sizes[i] if over else share[i]
        left -= over or left
    return out


@given(st.lists(st.integers(0, 10_000), max_size=12))
def test_targets(sizes):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    assert mixing.targets(sizes) == pytest.approx(resharing(sizes, weights), rel=1e-9, abs=1e-6)


def test_schedule_is_even(spark):
    words = [50_000, 12_345, 0, 777, 30_000]
    got = mixing.schedule(spark, words, 16).orderBy("slot").toPandas()
    need = [-(-w // 16) for w in words]
    for s, n in enumerate(need):
        assert sorted(got[got.s == s]["rank"]) == list(range(n))
        assert got[got.s == s]["rank"].is_monotonic_increasing
    for part in (0.1, 0.5, 0.9):  # every stretch from the start holds the shares
        head = Counter(got.s[: int(len(got) * part)])
        assert all(abs(head[s] - part * n) < 12 for s, n in enumerate(need))


def test_mix_pieces(documents):
    s = mixing.Settings(block=64)
    places, pieces = mixing.mix(documents, s)
    p, d = pieces.toPandas(), places.toPandas()
    assert not p.duplicated(["slot", "first", "s", "lap"]).any()
    assert p.groupby("slot").s.nunique().max() == 1
    assert ((p.to_word - p.from_word).groupby(p.slot).sum() <= 64).all()
    taken = (p.to_word - p.from_word).groupby(p.s).sum()
    for s_, goal in d.groupby("s").target.first().items():
        assert taken.get(s_, 0) == int(goal)
    slots = brute_slots([-(-int(goal) // 64) for _, goal in sorted(d.groupby("s").target.first().items())])
    assert all(slots[r.s][r["rank"]] == r.slot for _, r in p.iterrows())


def test_mixed_documents(awkward, nothing, documents):
    out = mixing.mixed_documents(awkward)
    assert out.columns == awkward.columns
    texts = {(r.doc_id, r.text) for r in awkward.collect()}
    assert {(r.doc_id, r.text) for r in out.collect()} <= texts
    assert mixing.mixed_sizes(awkward).count() == awkward.count()
    assert mixing.mixed_documents(nothing).count() == 0 == mixing.mixed_sizes(nothing).count()
    sized = mixing.mixed_sizes(documents).toPandas()
    assert (sized.taken <= 2 * sized["size"]).all() and ((sized.taken > 0) == (sized.n_slots > 0)).all() and (sized.first_slot.isna() == (sized.taken == 0)).all()
    for block in (1024, 50):
        got = [(r.doc_id, r.text) for r in mixing.mixed_documents(documents, mixing.Settings(block=block)).collect()]
        assert got == brute_mix([(r.doc_id, r.text, r.source) for r in documents.collect()], block)


def test_many_sources_and_rows_alike(spark):
    """Each of the rows that differ in another column only keeps it; more sources than rows in any of them."""
    rows = [(1, "one text of five words", "a", f"x{i % 40}") for i in range(60)] + [(i, f"text {i}", f"s{i}", "y") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, other string")
    got = Counter(tuple(r) for r in mixing.mixed_documents(df, mixing.Settings(block=7)).collect())
    given = Counter(rows)
    assert set(got) <= set(given) and all(n <= 2 * given[r] for r, n in got.items())
    assert sum(n for r, n in got.items() if r[2] == "a") in range(60, 121) and len({r[3] for r in got if r[2] == "a"}) == 40
    sized = mixing.mixed_sizes(df).toPandas()
    assert len(sized) == len(rows) and (sized[sized.source_size == 300].taken <= 10).all()



@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(q.SQL))
def test_query_against_sql(spark, con, name):
    got, want = q.QUERIES[name](spark, SF).toArrow(), con.execute(q.SQL[name]).to_arrow_table()
    rows = lambda t: canonical(t.column_names, zip(*[c.to_pylist() for c in t.columns]))
    assert rows(got) == rows(want)
    assert {n: str(t).replace("large_", "") for n, t in zip(got.schema.names, got.schema.types)} == {n: str(t) for n, t in zip(want.schema.names, want.schema.types)}


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in q.QUERIES} == {f"op{i}" for i in range(1, 14)}


def brute_slots(need):
    """Slots of every source by the golden-ratio points, counted one by one."""
    total, found, slot = sum(need), [[] for _ in need], 0
    ends = [sum(need[: i + 1]) * 2**64 // max(total, 1) - 1 for i in range(len(need))]
    while any(len(f) < n for f, n in zip(found, need)):
        point = slot * mixing.GOLDEN % 2**64
        found[next(i for i, e in enumerate(ends) if need[i] and point <= e)].append(slot)
        slot += 1
    return found


def brute_mix(docs, block=1024):
    """(id, text) of every document the mix takes, in the order of the stream; docs are (id, text, source)."""
    words = lambda t: len(re.findall(mixing.WORD, t or ""))
    names = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    sizes = [sum(words(t) for _, t, s in docs if s == name) for name in names]
    taken = []
    for name, size, goal in zip(names, sizes, mixing.targets(sizes)):
        own = sorted(((int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16), i, t) for i, t, s in docs if s == name), key=repr)
        own.sort(key=lambda r: r[0])
        at, mine = 0, []
        for _ in range(2):
            for _, i, t in own:
                n = words(t)
                if n and at + n / 2 <= goal:
                    mine.append((at, at + n, i, t))
                at += n
        taken.append(mine)
    slots = brute_slots([-(-max((end for _, end, _, _ in mine), default=0) // block) for mine in taken])
    found = sorted((slots[s][at // block], at, s, i, t) for s, mine in enumerate(taken) for at, _, i, t in mine)
    return [(i, t) for _, _, _, i, t in found]


def test_pipeline(spark, documents):
    """Every stage against brute force on what the stage before it kept."""
    library = Tokenizer.from_file(q.VOCABULARY)
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.staged(stage(spark, docs, SF), name)
        rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        if name != "bpe_encoding":
            assert out.columns == documents.columns
        if name == "language_id":
            model = language_id.train(docs.where(q.remainder(4) != 2))
            want = [(i, t) for i, t, _ in rows if language_id.score(t, model)[1] >= model.least and language_id.score(t, model)[0] != "und"]
        elif name == "exact_dedup":
            last = {}
            for i, t, _ in sorted(rows):
                last[lowered(t)] = (i, t)
            want = list(last.values())
        elif name == "near_dedup":
            classes = brute_classes({i: t for i, t, _ in rows})
            want = [(i, t) for i, t, _ in rows if classes[i] == i]
        elif name == "mixing":
            want = brute_mix(rows)
        else:
            want = [(i, library.encode(t, add_special_tokens=False).ids) for i, t, _ in rows]
        got = [(r.doc_id, r.ids if name == "bpe_encoding" else r.text) for r in out.collect()]
        assert sorted(got) == sorted(want), name
        docs = out
    assert sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.ids) for r in docs.collect())


def test_pipeline_edges(spark, awkward, nothing):
    for df in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES:
            df = corpus_pipeline.staged(stage(spark, df, SF), name)
        assert "n_tokens" in df.columns
