import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.functions.text import php_prelude
from larkspan.operators import calendar, classify, code_metrics, synth
from larkspan.operators.regression import fit_calibration


def metrics_of(spark, language, code):
    df = spark.createDataFrame([(code, language)], "code string, language string")
    r = code_metrics.code_metrics(df).first()
    return r["n_functions"], r["cyclomatic_complexity"], r["nloc"], r["token_count"]


@pytest.mark.parametrize("language,code,want", [
    ("python", "def add(a, b):\n    return a + b", (1, 1, 2)),
    ("python", "def f(x):\n    # if\n\n    '''if\n    for'''\n    if x and 'or' in x:\n        return 1\n", (1, 3, 5)),
    ("python", "def f():\n  def g(): pass\n", (2, 1, 2)),
    ("java", "public int add(int a, int b) {\n    return a + b;\n}", (1, 1, 3)),
    ("java", 'int f(int a) throws E { /* if */ for (;;) { if (a > 1 && s("||")) { } } }', (1, 4, 1)),
    ("javascript", "function p(i) {\n  // if\n  if (i || `&&`) { return 1 ? 2 : 3; }\n}", (1, 4, 3)),
    ("php", "function f($a) { # if\n foreach ($a as $b) { } }", (1, 2, 2)),
    ("ruby", "def f(a)\n  # if\n  1 if a.empty? && a\nend", (1, 3, 3)),
    ("go", "func f(a int) int {\n switch a { case 1: return 1 }\n}", (1, 2, 3)),
])
def test_code_metrics(spark, language, code, want):
    assert metrics_of(spark, language, code)[:3] == want


@pytest.mark.parametrize("language", list(code_metrics.LANGUAGE_IDS))
def test_long_strings_do_not_recurse(spark, language):
    code = 'f("' + "\\\\n" * 100_000 + '")'
    assert metrics_of(spark, language, code)[1] == 1


def test_ascii_code_is_counted_alike_in_batches(spark):
    """The patterns of the Arrow batches and Spark's expressions agree on odd pieces put together at random."""
    rng = random.Random(7)
    bits = ["if", "for", "and", "or", '"', "'", "`", '"""', "#", "//", "/*", "*/", "\n", "\r\n", "\r", " ", "\t", "\\", "x", "(", ")", "{", "}", "&&", "?",
            " ? ", "=begin", "=end", "<?php", "def ", "function f", "=>", "func", "case", "new A.B", "throws E", "try", "é", "\x0b", "\x1c", "\x00"]
    names = [*code_metrics.LANGUAGE_IDS, "cobol", None]
    rows = [(i, rng.choice(names), "".join(rng.choices(bits[: -4 if i % 2 else None], k=rng.randint(0, 30)))) for i in range(3000)]
    df = spark.createDataFrame([*rows, (3000, "go", None)], "i int, language string, code string")
    text = php_prelude(F.col("code"), F.col("language"))
    want = df.select("i", F.inline(F.array(code_metrics._any_counts(text, F.col("language")))))
    got = code_metrics.code_metrics(df).drop("code", "language")
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_label_code(spark):
    rows = [(1, i, "go", "func f() { if a {} }", "") for i in range(5)] + [
        (2, 0, "python", None, "def f(): pass"), (2, 1, "python", "x = 1", ""), (2, 2, "cobol", "def f(): pass", ""),
        (2, 3, "python", "def f(): pass" + " " * 4000, "")]
    df = spark.createDataFrame(rows, "shard int, line int, language string, code string, original_string string")
    got = {(r["shard"], r["line"], r["language_id"], r["cyclomatic_complexity"]) for r in code_metrics.label_code(df, ["shard", "line"], 3, 4000).collect()}
    assert got == {(1, 0, 5, 2), (1, 1, 5, 2), (1, 2, 5, 2), (2, 0, 0, 1)}


COLORS = {"a": "#ff0000", "b": "#0000ff"}


def events(spark, rows):
    data = [(dt.datetime.fromisoformat(t), p, m) for t, p, m in rows]
    return spark.createDataFrame(data, "ts timestamp, platform string, minutes double")


def test_calendar(spark):
    df = events(spark, [("2024-02-01T23:59:59", "a", 30.0), ("2024-02-01T01:00:00", "b", 10.9), ("2024-02-29T12:00:00", "a", 130.0), ("2024-02-03T00:00:00", "b", 0.0)])
    cells = {r["date"]: r for r in calendar.activity_calendar(df, "ts", "platform", "minutes", COLORS).collect()}
    assert len(cells) == 29
    first, last, none = (cells[dt.date(2024, 2, d)] for d in (1, 29, 3))
    assert first["activity"] == {"a": 30, "b": 10} and first["total"] == 40
    assert first["color"] == "rgb(191, 0, 63)" and first["intensity"] == 0.6
    assert (first["weekday"], first["week_index"], first["month_label"]) == (3, 0, "Feb")
    assert (last["weekday"], last["week_index"], last["intensity"]) == (3, 4, 1.0)
    assert none["activity"] == {} and none["total"] == 0 and none["color"] is None and none["opacity"] == 1.0
    month = calendar.month_grids(calendar.activity_calendar(df, "ts", "platform", "minutes", COLORS)).first()
    assert [len(w) for w in month["weeks"]] == [7] * 5
    assert month["weeks"][0][:3] == [None] * 3 and month["weeks"][0][3]["date"] == dt.date(2024, 2, 1)
    assert month["weeks"][4][4] is None
    spine = [r["date"] for r in calendar.last_weeks(spark.createDataFrame([(dt.date(2024, 3, 1),)], "date date")).collect()]
    assert len(spine) == 371 and max(spine) == dt.date(2024, 3, 1)


TEMPLATES = {"open_app": ["open {x}", "could you launch {x}"], "mute": ["mute", "mute the sound"], "run_command": ["run {x}"]}
POOLS = {"open_app": ["Chrome", "Word"], "run_command": ["git pull"]}


def test_generated_commands(spark):
    df = synth.generate_commands(spark, TEMPLATES, POOLS, slot_draws=40, plain_draws=20, short={"Chrome": ["gc"]}, typo={"Word": ["wrod"]})
    rows = df.collect()
    main = [r for r in rows if r["variant"] <= 3]
    assert len(main) == 3 * (40 + 20 + 40)
    assert {r["slot"] for r in rows if r["intent"] == "open_app"} == {"Chrome", "Word"}
    assert all(r["slot"] == "" for r in rows if r["intent"] == "mute")
    extra = [r for r in rows if r["variant"] == 4]
    assert extra and all(("gc" if r["slot"] == "Chrome" else "wrod") in r["text"].lower() for r in extra)
    again = synth.generate_commands(spark, TEMPLATES, POOLS, slot_draws=40, plain_draws=20, short={"Chrome": ["gc"]}, typo={"Word": ["wrod"]})
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again.repartition(3).collect()))
    other = synth.generate_commands(spark, TEMPLATES, POOLS, slot_draws=40, plain_draws=20, seed=7)
    assert {r["text"] for r in other.collect()} != {r["text"] for r in main}


def test_noise_shares(spark):
    df = spark.range(20000).select(F.col("id"), synth.add_noise(F.lit("Open It"), [F.col("id")]).alias("t"))
    got = df.agg(
        F.avg(F.col("t").rlike(r"[.!?]$").cast("int")).alias("mark"), F.avg((F.upper("t") == F.col("t")).cast("int")).alias("upper"),
        F.avg((F.lower("t") == F.col("t")).cast("int")).alias("lower"),
        F.avg(F.col("t").rlike("(?i)" + "|".join(synth.REASONS)).cast("int")).alias("why")).first()
    assert got["mark"] == pytest.approx(0.44, abs=0.02) and got["upper"] == pytest.approx(0.05, abs=0.01)
    assert got["lower"] == pytest.approx(0.30, abs=0.02) and got["why"] == pytest.approx(0.12, abs=0.01)
    polite = spark.range(300).select(synth.add_noise(F.lit("can you go"), [F.col("id")]).alias("t")).collect()
    assert all(r["t"].lower().startswith("can you go") for r in polite)


def test_other_generators(spark):
    chat = synth.plain_chat(spark, ["hello", "who are you"]).collect()
    assert len(chat) == 12 and {r["intent"] for r in chat} == {"general_chat"}
    about = synth.chat_about(spark, ["{x} is great"], ["Chrome"], n=30).collect()
    assert len(about) == 30 and all("chrome" in r["text"].lower() and r["slot"] == "" for r in about)
    mixed = synth.ambiguous_commands(spark, [("open {x}", "open_app", ["A1"]), ("open {x}", "open_project", ["B1"])], n=40).collect()
    assert {(r["intent"], r["slot"]) for r in mixed} == {("open_app", "A1"), ("open_project", "B1")}
    two = synth.two_step_commands(spark, [("open {x}", ["A"], "run {x}", ["B"]), ("shutdown", [], "close {x}", ["C"])], n=40).collect()
    assert {r["slot"] for r in two} == {"A;B", "C"} and {r["intent"] for r in two} == {"multi_intent"}
    values = synth.slot_values(spark.createDataFrame([("A;B",), ("",), (None,)], "slot string")).collect()
    assert [(r["slot_no"], r["slot_value"]) for r in values] == [(0, "A"), (1, "B")]


def test_balance_and_split(spark):
    df = synth.generate_commands(spark, TEMPLATES, POOLS, slot_draws=60, plain_draws=30)
    out = synth.balance_and_split(df, ["draw_id", "variant"])
    assert out.count() == out.select("text").distinct().count() == df.select("text").distinct().count()
    n = out.count()
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert (sizes["train"], sizes["val"]) == (int(n * 0.8), int(n * 0.9) - int(n * 0.8))


def test_text_classifier(spark):
    rows = [(i, ("code python loop" if i % 2 else "funny cat video") + f" {i}", i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, text string, label int")
    model = classify.fit_text_classifier(df.filter("i < 60"), df.filter("i >= 60"), cells=256, grid=(0.01,))
    assert model.score == 1.0 and model.labels == ["0", "1"]
    scored = classify.predict_video(spark.createDataFrame([("python code",), ("cat",), (None,)], "text string"), model)
    out = scored.collect()
    assert [r["label_name"] for r in out[:2]] == ["coding", "entertainment"] and out[2]["text"] is None
    assert set(out[0]["probs"]) == {"coding", "entertainment"}
    assert all(r["confidence"] == pytest.approx(max(r["probs"].values())) for r in out)
    named = df.withColumn("label", F.when(F.col("label") == 1, "z").otherwise("a"))
    model = classify.fit_text_classifier(named.filter("i < 60"), named.filter("i >= 60"), metric="f1", cells=256, grid=(0.01,))
    assert classify.predict_text(spark.createDataFrame([("python",)], "text string"), model).first()["predicted"] == "z"


def test_dense_score(spark):
    rng = np.random.default_rng(0)
    x, ids = rng.normal(size=(50, 8)).astype("float32"), rng.integers(0, 6, 50)
    w = classify.DenseWeights(rng.normal(size=(6, 16)), [(rng.normal(size=(24, 256)), rng.normal(size=256)), (rng.normal(size=(256, 64)), rng.normal(size=64)), (rng.normal(size=(64, 1)), rng.normal(size=1))])
    df = spark.createDataFrame([(i, x[i].tolist(), int(ids[i])) for i in range(50)], "i int, embedding array<float>, language_id int")
    got = {r["i"]: r["prediction"] for r in classify.dense_score(df.repartition(4), w).collect()}
    h = np.hstack([x.astype("float64"), w.language[ids]])
    for k, (m, b) in enumerate(w.layers):
        h = h @ m + b
        h = np.maximum(h, 0) if k < 2 else h
    assert np.allclose([got[i] for i in range(50)], h[:, 0])


def test_complexity_model_and_scores(spark):
    rng = np.random.default_rng(1)
    x, lang = rng.normal(size=(300, 4)), rng.integers(0, 6, 300)
    y = x @ [1.0, -2.0, 0.5, 0.0] + lang * 0.3
    df = spark.createDataFrame([(i, x[i].tolist(), int(lang[i]), float(y[i])) for i in range(300)], "i int, embedding array<double>, language_id int, target_norm double")
    model = classify.fit_complexity_model(df.filter("i < 250"), df.filter("i >= 250"))
    assert model.validation_mae < 1e-6
    calibration = fit_calibration(classify.predict_normalized(df, model).withColumn("language", F.lit("go")), "language", target="target_norm")
    rows = spark.createDataFrame([("GO", [0.0] * 4, 2.0), ("cobol", [0.0] * 4, 0.0), (None, [0.0] * 4, 0.0)], "language string, embedding array<double>, z double")
    out = classify.score_complexity(rows, F.lit(1.0), F.lit(0.5), calibration, code_metrics.LANGUAGE_IDS, lambda d: d.withColumn("prediction", F.col("z"))).collect()
    assert out[0]["raw_complexity"] == round(np.expm1(2.0), 2) and out[0]["error"] is None
    assert out[1]["error"] == "Unknown language 'cobol'" and out[1]["raw_complexity"] is None and out[2]["error"] == "Unknown language ''"
