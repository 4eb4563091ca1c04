"""Language identification, line field, quality model."""

import re

import numpy as np
import pytest
from larkspan.llm import language_id, line_crf, quality_model
from larkspan.llm import queries as q

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = q.QUERIES["op9_language_id"](spark, SF).join(docs, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and len(held) > 200
    assert (held.lang_pred == held.lang).mean() > 0.98
    assert got.accepted.mean() > 0.98 and got.score.between(0, 1).all()


def test_language_edges(awkward, nothing):
    model = language_id.train(awkward)
    got = language_id.identify(awkward, model).collect()
    assert len(got) == awkward.count()
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5, 7)} == {"und"}
    assert not [r for r in got if r.lang_pred == "und" and (r.accepted or r.score)]
    assert {r.lang_pred for r in got if r.doc_id == 10} == {"ja"}
    kept = language_id.accepted_rows(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == sum(r.accepted for r in got)
    empty = language_id.train(nothing)
    assert empty.labels == () and {r.lang_pred for r in language_id.identify(awkward, empty).collect()} == {"und"}
    assert language_id.identify(nothing, model).count() == 0


def test_language_blocks(monkeypatch):
    s = language_id.Settings()
    text = "eine kleine Geschichte über viele Wörter " * 50
    whole = np.sort(language_id.buckets(text, s))
    monkeypatch.setattr(language_id, "BLOCK", 64)
    assert (np.sort(language_id.buckets(text, s)) == whole).all()


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    dup, seen, windows = 0, set(), {}
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    cover = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(cover), n < 20 or 100 * len(cover) > 30 * n


def test_base_rules(awkward, documents):
    field = line_crf.train(documents)
    for df in (awkward, documents):
        got = line_crf.quality_rules(df, field).collect()
        texts = df.select("doc_id", "text").collect()
        want = sorted(((r.doc_id, *brute_base(r.text)) for r in texts), key=repr)
        assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=repr) == want
        assert not [r for r in got if r.kept and (r.base_failed or r.content_share < 0.5)]


def test_rules_keep_good_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = q.QUERIES["op1_line_crf"](spark, SF).join(labels, "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.3


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for n in range(1, 9):
        x = rng.normal(size=(n, len(line_crf.FEATURES)))
        field = line_crf.Field(rng.normal(size=(len(line_crf.FEATURES), 2)), rng.normal(size=(2, 2)))
        value = lambda y: sum((x @ field.emit)[i, s] for i, s in enumerate(y)) + sum(field.move[a, b] for a, b in zip(y, y[1:]))
        paths = [[k >> i & 1 for i in range(n)] for k in range(2**n)]
        assert value(line_crf.viterbi(x, field).tolist()) == pytest.approx(max(map(value, paths)))


def test_sums_agree_with_all_paths():
    rng = np.random.default_rng(5)
    scores, move = rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
    paths = [[k >> i & 1 for i in range(5)] for k in range(32)]
    weight = np.array([np.exp(sum(scores[i, s] for i, s in enumerate(y)) + sum(move[a, b] for a, b in zip(y, y[1:]))) for y in paths])
    z, p, moves = line_crf._sums(scores, move)
    assert z == pytest.approx(np.log(weight.sum()))
    for i in range(5):
        assert p[i, 1] == pytest.approx(sum(w for w, y in zip(weight, paths) if y[i]) / weight.sum())
    assert moves[0, 1] == pytest.approx(sum(w * sum((a, b) == (0, 1) for a, b in zip(y, y[1:])) for w, y in zip(weight, paths)) / weight.sum())


def test_line_labels_and_edges(awkward, nothing):
    field = line_crf.train(nothing)
    assert line_crf.quality_rules(nothing, field).count() == 0
    lines = line_crf.line_labels(awkward, line_crf.train(awkward)).collect()
    assert {r.label for r in lines} <= {"content", "boilerplate"}
    assert sorted(r.line for r in lines if r.doc_id == 12) == [0, 1]


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = q.QUERIES["op2_quality_model"](spark, SF)
    assert got.count() == 1000
    held = got.where("held_out").join(labels, "doc_id").toPandas()
    assert held.score.between(0, 1).all() and (held.predicted == (held.score >= 0.5)).all()
    # 0.85 of the labels are 1
    assert (held.predicted == held.quality).mean() > 0.9


def test_quality_edges(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (2, 0), (8, 0), (99, 1), (None, 1), (6, None)], "doc_id long, quality int")
    model = quality_model.train(awkward, labels, quality_model.Settings(buckets=256, dims=8))
    got = quality_model.score(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = quality_model.train(nothing, labels.limit(0), quality_model.Settings(buckets=256, dims=8))
    assert quality_model.score(awkward, none).count() == awkward.count() and quality_model.score(nothing, none).count() == 0


def test_random_indexing_by_hand(spark):
    s = quality_model.Settings(buckets=128, dims=16, window=1)
    docs = spark.createDataFrame([("a b",), ("a c a",)], "text string")
    places, signs = quality_model.index_vectors(s)
    t = quality_model.Tokens(s.buckets)
    a, b, c = (int(t(x)[0]) for x in "abc")
    index = np.zeros((s.buckets + 1, s.dims))
    for i in range(s.buckets):
        index[i, places[i]] = signs[i]
    total = np.zeros((s.buckets, s.dims))
    for x, y in ((a, b), (b, a), (a, c), (c, a), (c, a), (a, c)):
        total[x] += index[y]
    size = np.linalg.norm(total, axis=1, keepdims=True)
    want = np.divide(total, size, out=np.zeros_like(total), where=size > 0)
    used = size[:, 0] > 0
    want[used] -= want[used].mean(axis=0)
    assert np.allclose(quality_model.corpus_vectors(docs, s)[:-1], want, atol=1e-6)
