"""Naive Bayes, least squares and callers' metrics against plain versions."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow.compute as pc
import pytest
from larkspan.operators import bayes, classify, least_squares
from larkspan.operators.metrics import UserMetric, user_metric

TOKEN = re.compile(r"[^\W_]+")


def plain_scores(rows, text, a):
    """(score, label) of every class, best first; rows are (text, label)."""
    docs, words = Counter(), {}
    for t, label in rows:
        docs[label] += 1
        words.setdefault(label, Counter()).update(TOKEN.findall(t.lower()))
    known = {w for c in words.values() for w in c}
    unit = lambda x: round(math.log(x) * 1e6)
    read = [w for w in TOKEN.findall((text or "").lower()) if w in known]
    out = []
    for label, c in words.items():
        base = unit(a / (sum(c.values()) + a * len(known)))
        score = unit(docs[label] / sum(docs.values())) + len(read) * base + sum(unit((c[w] + a) / a) for w in read if c[w])
        out.append((-score, label))
    return [(-s, label) for s, label in sorted(out)]


@pytest.mark.parametrize("labels", [2, 3, 70])
def test_bayes_against_plain_counts(spark, labels):
    rng = np.random.default_rng(labels)
    rows = []
    for i in range(400):
        label = int(rng.integers(0, labels))
        rows.append((i, " ".join(f"W{int(x)}" for x in rng.integers(0, 40, rng.integers(1, 12)) + 3 * (label % 5)), f"l{label:02}"))
    df = spark.createDataFrame(rows, "i int, text string, label string")
    model = bayes.fit_bayes(df.filter("i < 300"), df.filter("i >= 300"), smoothing=(0.5,))
    asked = spark.createDataFrame([(i, t) for i, t, _ in rows[250:]] + [(900, None), (901, ""), (902, "unheard w1 w1 W1")], "i int, text string")
    train = [(t, label) for i, t, label in rows if i < 300]
    texts = {r.i: r.text for r in asked.collect()}
    for keys in (["i"], None):
        for r in bayes.predict_bayes(asked, model, keys=keys).collect():
            want = plain_scores(train, texts[r.i], 0.5)
            total = sum(math.exp((s - want[0][0]) / 1e6) for s, _ in want)
            assert r.predicted == want[0][1] and r.confidence == pytest.approx(1 / total)
            assert r.probs == pytest.approx({label: math.exp((s - want[0][0]) / 1e6) / total for s, label in want})


@pytest.mark.parametrize("labels", [2, 40])
def test_only_rare_words_travel(spark, labels, monkeypatch):
    """Frequent words are weighed where they are read; with any number of them looked up there the scores are the same."""
    rows = [(i, "the cat and the dog " * 5 + f"w{i % 17} rare{i} unheard{i}", f"l{i % labels:02}") for i in range(400)]
    df = spark.createDataFrame(rows, "i int, text string, label string")
    held, stage = {}, bayes.staged

    def kept(table, name):
        held[name] = stage(table, name)
        return held[name]

    monkeypatch.setattr(bayes, "staged", kept)
    seen = set()
    for most in (0, 30, 50_000):
        monkeypatch.setattr(bayes, "MAX_LOOKUP_ROWS", most)
        held.pop("cells", None)
        model = bayes.fit_bayes(df.filter("i < 300"), df.filter("i >= 200"))
        travel = held["cells"].filter("_rare IS NOT NULL") if "cells" in held else None
        if most == 0:
            assert travel.count() == 200 * 7
        elif most == 30:
            assert {r["_rare"] for r in travel.select("_rare").collect()}.isdisjoint({"the", "cat", "and", "dog"})
        else:
            assert travel is None
        found = bayes.predict_bayes(df, model, keys=["i"]).collect()
        seen.add((model.smoothing, model.score, tuple(sorted((r.i, r.predicted, r.confidence, tuple(sorted(r.probs.items()))) for r in found))))
    ((smoothing, _, found),) = seen
    train = [(t, label) for i, t, label in rows if i < 300]
    assert [p for _, p, *_ in found[::40]] == [plain_scores(train, t, smoothing)[0][1] for _, t, _ in rows[::40]]


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    rows = [(i, f"a{i % 7} b{i % 11} c{i % 3}", f"l{i % 4}") for i in range(300)]
    df = spark.createDataFrame(rows, "i int, text string, label string")
    seen = set()
    for parts in (1, 5, 13):
        model = bayes.fit_bayes(df.repartition(parts).filter("i < 200"), df.filter("i >= 200"))
        seen.add((model.smoothing, tuple(sorted((r.i, r.predicted, r.confidence) for r in bayes.predict_bayes(df.repartition(parts), model, keys=["i"]).collect()))))
    assert len(seen) == 1


def test_bayes_edges(spark):
    schema = "text string, label int, extra string"
    rows = [("cat dog", 1, "x"), (None, 1, "x"), ("  ", 0, "x"), ("tree", None, "x"), ("tree leaf", 0, None), ("?!", 0, None)]
    df = spark.createDataFrame(rows, schema)
    model = bayes.fit_bayes(df, df, smoothing=(1.0,))
    assert {r.label: (r.docs, r.n) for r in model.classes.collect()} == {"0": (2, 2), "1": (1, 2)}
    got = bayes.predict_bayes(df, model).collect()
    assert len(got) == len(rows) and {r.predicted for r in got if not (r.text or "").strip()} == {"0"}
    none = bayes.fit_bayes(df.limit(0), df.limit(0))
    assert [r.predicted for r in bayes.predict_bayes(df, none).collect()] == [None] * len(rows)
    assert bayes.predict_bayes(df.limit(0), model).count() == 0
    video = classify.predict_video(df.drop("label"), model).collect()
    assert {r.label_name for r in video} == {"coding", "entertainment"}


def test_metric_of_the_caller_chooses(spark):
    """Accuracy favours the large class, the callers' metric the recall of the small one."""
    rows = [(i, "common word" + (" rare" if i % 10 == 0 and i % 20 else ""), "b" if i % 10 == 0 else "a") for i in range(400)]
    df = spark.createDataFrame(rows, "i int, text string, label string")
    recall = UserMetric(
        lambda y, p: [pc.sum(pc.equal(y, "b")).as_py() or 0, pc.sum(pc.and_(pc.equal(y, "b"), pc.equal(p, "b"))).as_py() or 0],
        lambda s: s[1] / max(s[0], 1))
    scored = spark.createDataFrame([("b", "b"), ("b", "a"), ("a", "b"), ("b", None)], "label string, prediction string")
    assert user_metric(scored, recall) == pytest.approx(1 / 3) and user_metric(scored.limit(0), recall) is None
    model = bayes.fit_bayes(df.filter("i < 300"), df.filter("i >= 300"), metric=recall, smoothing=(1000.0, 0.1))
    assert model.smoothing == 0.1 and model.score == 0.5
    logistic = classify.fit_text_classifier(df.filter("i < 300"), df.filter("i >= 300"), cells=64, grid=(0.01,), metric=UserMetric(
        lambda y, p: [len(y), pc.sum(pc.equal(y, p)).as_py() or 0], lambda s: s[1] / s[0]))
    assert logistic.score == pytest.approx(0.95, abs=0.06)


def test_least_squares(spark):
    rng = np.random.default_rng(2)
    x, lang = rng.normal(size=(500, 5)), rng.integers(0, 5, 500)
    y = x @ [1.0, -2.0, 0.5, 0.0, 3.0] + lang * 0.7 + rng.normal(0, 0.1, 500)
    rows = [(i, x[i].tolist(), int(lang[i]), float(y[i])) for i in range(500)] + [(500, None, 1, 1.0), (501, [0.0] * 5, 9, 1.0), (502, [0.0] * 5, 1, None)]
    df = spark.createDataFrame(rows, "i int, embedding array<double>, language_id int, target_norm double").repartition(7)
    sums = least_squares.moments(df.filter("i < 400 OR i >= 500"), "embedding", "target_norm")
    design = np.hstack([x, np.eye(6)[lang]])[:400]
    assert sums.n == 400 and np.allclose(sums.gram, design.T @ design) and np.allclose(sums.cross, design.T @ y[:400])
    for penalty in (0.0, 0.1):
        model = least_squares.solved(sums, penalty)
        ridge = np.diag([400 * penalty] * 5 + [0.0] * 5)
        want = np.linalg.solve(design[:, :10].T @ design[:, :10] + ridge, design[:, :10].T @ y[:400])
        assert np.allclose(model.weights, want[:5]) and np.allclose(model.offsets[:5], want[5:])
    best = least_squares.fit_least_squares(df.filter("i < 400"), df.filter("i >= 400 AND i < 500"))
    assert best.penalty == 0.0
    got = {r.i: r.prediction for r in classify.predict_normalized(df, best).collect()}
    assert np.allclose([got[i] for i in range(500)], x @ best.weights + best.offsets[lang])
    assert got[500] is None and got[501] == pytest.approx(best.offsets[:5].mean())
    worst = UserMetric(lambda t, p: [float(np.abs(t.to_numpy() - p.to_numpy()).sum())], lambda s: s[0])
    assert least_squares.fit_least_squares(df.filter("i < 400"), df.filter("i >= 400 AND i < 500"), metric=worst).penalty == 0.1
    assert least_squares.moments(df.limit(0), "embedding", "target_norm") is None
