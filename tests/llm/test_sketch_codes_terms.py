"""Scaled sketches, vector codes and source divergence against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from larkspan.llm import queries as q
from larkspan.llm import scaled_sketch, source_divergence, transducer, vector_codes

SF = "/root/testdata/sf0.001"


# --- scaled sketches ---------------------------------------------------------------


def plain_sketch(text, s=scaled_sketch.Settings()):
    every = sorted({int(h) for h in scaled_sketch.shingle_hashes(text.lower().encode("utf-8", "replace").split(), s.words)})
    low = [h for h in every if h < 2**48 // s.scale]
    if len(low) >= s.least:
        return 2**48 // s.scale, low
    if len(every) <= s.least:
        return 2**48 - 1, every
    return every[s.least - 1] + 1, every[: s.least]


def plain_contained(a, b):
    if a == b:
        return 1.0
    bound = min(a[0], b[0])
    mine, theirs = {h for h in a[1] if h < bound or a[0] == b[0]}, set(b[1])
    return len(mine & theirs) / len(mine) if mine else 0.0


def written(s):
    return "".join(f"{h:012x}" for h in [s[0], *s[1]])


def expected(rows):
    rows = sorted(rows)
    texts = [t for _, t in rows]
    out = []
    for i, (name, text) in enumerate(rows):
        following = texts[(i + 1) % len(texts)]
        n = len(text) // 4
        new = text[: len(text) - n] + following[:n]
        own, changed, other = plain_sketch(text), plain_sketch(new), plain_sketch(following)
        out.append((name, len(text), hashlib.sha256(new.encode()).hexdigest(), written(own), written(changed), plain_contained(own, changed), plain_contained(own, other)))
    return out


def test_query_against_plain_sketches(spark, documents):
    got = sorted(tuple(r) for r in q.QUERIES["op11_scaled_sketch"](spark, SF).collect())
    assert got == expected([(r.doc_id, r.text or "") for r in documents.select("doc_id", "text").collect()])


@pytest.mark.parametrize("parts", [1, 3, 200])
def test_next_texts_over_any_number_of_ranges(spark, documents, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        some = documents.where("doc_id % 3 = 0")
        got = {r.doc_id: r.edited_sha256 for r in scaled_sketch.fingerprints_of_edits(some).collect()}
        assert got == {e[0]: e[2] for e in expected([(r.doc_id, r.text or "") for r in some.collect()])}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_sketch_edges(spark, awkward, nothing):
    got = scaled_sketch.fingerprints_of_edits(awkward).collect()
    assert len(got) == awkward.count() and scaled_sketch.fingerprints_of_edits(nothing).count() == 0
    empty = "f" * 12
    assert {r.fingerprint for r in got if r.n_chars == 0} == {empty}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = spark.createDataFrame([(1, "a lone text of some words")], "doc_id long, text string")
    (r,) = scaled_sketch.fingerprints_of_edits(one).collect()
    assert r.near_next == 1.0


def test_estimates_and_merging(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 40_000)]
    long, part = " ".join(words), " ".join(words[:4000])
    a, b = scaled_sketch.sketch(part), scaled_sketch.sketch(long)
    assert scaled_sketch.contained(a, b) == 1.0 and abs(scaled_sketch.contained(b, a) - 0.1) < 0.02
    assert scaled_sketch.parsed(a.text()).text() == a.text()
    halves = [" ".join(words[:20_004]), " ".join(words[20_000:])]
    joined = scaled_sketch.united(*map(scaled_sketch.sketch, halves))
    assert joined.text() == b.text()
    short = ["a few words of a note", "another few words that are longer than the first note by some more words and words"]
    both = scaled_sketch.united(*map(scaled_sketch.sketch, short))
    df = spark.createDataFrame([(None, halves[0]), (None, halves[1]), ("s", short[0]), ("s", short[1]), ("e", "")], "k string, text string")
    prints = scaled_sketch.fingerprints(df, id_col="k")
    got = {r.k: r.fingerprint for r in scaled_sketch.merged(prints, ["k"]).collect()}
    assert got == {None: b.text(), "s": both.text(), "e": "f" * 12}
    pairs = spark.createDataFrame([(a.text(), b.text()), (None, b.text())], "x string, y string")
    assert [r[0] for r in pairs.select(scaled_sketch.containment("x", "y")).collect()] == [1.0, None]


# --- vector codes ------------------------------------------------------------------


def plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Exact k-means over Python's whole numbers; rows are (id, label, vector)."""
    kept = [(i, l, [math.floor(x * scale) for x in v]) for i, l, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = lambda v, p: tuple(v[p * len(v) // parts : (p + 1) * len(v) // parts])
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, _, v in kept:
                own[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [tuple(sum(c) // len(own[i]) for c in zip(*own[i])) if i in own else e for i, e in enumerate(books[p])]
    found = [[nearest(cut(v, p), books[p]) for p in range(parts)] for _, _, v in kept]
    total = Counter()
    for (_, label, _), f in zip(kept, found):
        total[label] += sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), total[label], sha) for (i, label, _), f in zip(kept, found)), key=repr)


def coded(df, **kw):
    return sorted((tuple(r)[:5] for r in vector_codes.vector_codes(df, vector_codes.Settings(**kw)).collect()), key=repr)


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 60), st.integers(1, 12), st.integers(1, 9))
def test_codes_against_plain_k_means(spark, seed, n, entries, groups):
    rng = np.random.default_rng(seed)
    # few different values, so that ties, repeated vectors and unused entries occur
    rows = [(int(i), int(rng.integers(0, 3)) or None, [float(x) / 4 for x in rng.integers(-3, 4, 8)]) for i in rng.integers(0, 40, n)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert coded(df, entries=entries, groups=groups, scale=8) == plain_codes(rows, entries=entries, scale=8)


def test_code_edges(spark):
    bad = [(1, 1, None), (2, 1, [0.5, None, 0.0, 1.0]), (3, None, [0.5, float("nan"), 0.0, 1.0]), (4, 2, [0.5, float("inf"), 0.0, 1.0])]
    good = [(5, None, [0.5, -0.25, 0.0, 1.0]), (None, 2, [-0.001, 3.0, 2.0, 1.0]), (5, None, [0.5, -0.25, 0.0, 1.0]), (6, 2, [1e4, -1e4, 0.0, 1.0])]
    schema = "vec_id long, label int, embedding array<double>"
    df = spark.createDataFrame(bad + good, schema).selectExpr("*", *[f"'x' AS {n}" for n in ("code", "codes", "error", "scans", "vector", "of", "CODEBOOKS_sha256")])
    assert coded(df) == plain_codes(bad + good)
    for rows in (bad, []):
        assert coded(spark.createDataFrame(rows, schema)) == []
    for rows in ([(1, 1, [0.0] * 4), (2, 1, [0.0] * 8)], [(1, 1, [0.0] * 5)], [(1, 1, [1e300] * 4)]):
        with pytest.raises(Exception, match="vectors must have|components must stay"):
            coded(spark.createDataFrame(rows, schema))


def test_bounds_spare_scans(spark):
    """Rows near well separated entries: after the first round hardly a group is scanned again."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 10, (24, 16))
    rows = [(i, 0, [float(x) for x in (centres[i % 24] + rng.normal(0, 0.05, 16))]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    out = vector_codes.vector_codes(df, vector_codes.Settings(entries=24)).toPandas()
    assert sorted((tuple(r)[:5] for r in out.itertuples(index=False)), key=repr) == plain_codes(rows, entries=24)
    assert out.scans.mean() < 0.45 * 5 * 4 * 8


def test_net_displacement_is_tighter():
    """An entry that goes and returns costs a bound nothing, though its steps add up."""
    there, back = np.zeros((1, 2, 2), np.int64), np.array([[[5, 0], [0, 0]]])
    books = vector_codes.Codebooks([there, back, there], np.zeros((1, 2), np.int64))
    assert books.moved()[:, 0, 0].round(6).tolist() == [0.0, 5.0, 0.0]


# --- source divergence -------------------------------------------------------------


@given(st.sets(st.text("abé\U0001f600", min_size=1, max_size=6)), st.lists(st.text("abcé", max_size=8)))
def test_ordinals(terms, others):
    ordered = sorted(t.encode() for t in terms)
    made = transducer.unpacked(transducer.built(ordered).packed())
    place = {t: i for i, t in enumerate(ordered)}
    asked = ordered + [o.encode() for o in others]
    assert made.ordinals(asked).tolist() == [place.get(t, -1) for t in asked]


def test_transducer_is_minimal():
    made = transducer.built(sorted(a + b for a in (b"x", b"yy", b"z") for b in (b"ing", b"ed", b"s")))
    # the root, the state after a first y, and one state for each set of endings
    endings = (b"ing", b"ed", b"s")
    sets = {frozenset(e[len(start):] for e in endings if e.startswith(start)) for whole in endings for start in (whole[:i] for i in range(len(whole) + 1))}
    assert len(made.final) == len(sets) + 2
    with pytest.raises(ValueError):
        transducer.built([b"b", b"a"])


def plain_divergence(rows, s):
    """rows are (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate({i: i + 32 for i in range(65, 91)}))) for text, lang, source in rows]
    held = Counter((lang, t) for lang, _, ts in found for t in set(ts))
    kept = defaultdict(list)
    for (lang, t), n in held.items():
        if n >= s.least:
            kept[lang].append(t)
    counts, whole = defaultdict(Counter), defaultdict(Counter)
    for lang, source, ts in found:
        own = [t for t in ts if t in set(kept[lang])]
        counts[lang, source].update(own)
        whole[lang].update(own)
    p = lambda c, v: {t: 1 + s.unit * (c[t] + s.smooth) // (sum(c.values()) + s.smooth * len(v)) for t in v}
    shares = {g: p(c, kept[g[0]]) for g, c in counts.items()}
    overall = {lang: p(c, kept[lang]) for lang, c in whole.items()}
    out = []
    for lang, source in counts:
        mine = shares[lang, source]
        pairs = [(-sum(abs(mine[t] - shares[lang, o][t]) for t in mine), o.encode()) for k, o in counts if k == lang and o != source]
        terms = [(overall[lang][t] - mine[t], t.encode()) for t in mine if counts[lang, source][t] and mine[t] > overall[lang][t]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[: s.top])):
            out += [(lang, source, part, item.decode(), -f, i + 1) for i, (f, item) in enumerate(items)]
    return sorted(out)


@pytest.mark.parametrize("kw", [{}, dict(least=2, block_terms=7, sent_bytes=9000, pair_terms=16, pair_sources=3, held=50, top=4)])
def test_divergence(documents, awkward, nothing, kw):
    s = source_divergence.Settings(**kw)
    for df in (documents, awkward):
        want = plain_divergence([(r.text, r.lang, r.source) for r in df.select("text", "lang", "source").collect()], s)
        assert sorted(tuple(r) for r in source_divergence.divergence(df, s).collect()) == want
    assert source_divergence.divergence(nothing, s).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    n, total, v = 3 * 10**14, 9 * 10**17, 1234567
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(n, total, v)], "n long, total long, v long")
    got = df.select(source_divergence.share(F.col("n"), F.col("total"), F.col("v"), source_divergence.Settings())).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v) and isinstance(got, int) and not isinstance(got, Decimal)
