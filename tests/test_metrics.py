import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.functions import numeric
from larkspan.operators import metrics, regression


def frame(spark, pairs, kind="int"):
    return spark.createDataFrame(pairs, f"label {kind}, prediction {kind}")


def by_hand(pairs, c):
    tp = sum(y == p == c for y, p in pairs)
    said, true = sum(p == c for _, p in pairs), sum(y == c for y, _ in pairs)
    return (tp / said if said else 0.0, tp / true if true else 0.0, 2 * tp / (said + true) if said + true else 0.0, true)


@pytest.mark.parametrize("pairs", [
    [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("b", "d")],
    [("a", "a"), ("b", "b")], [("a", "b")],
])
def test_report(spark, pairs):
    rows = metrics.classification_report(frame(spark, pairs, "string")).collect()
    got = {r["class"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in rows}
    classes = sorted({c for pair in pairs for c in pair})
    for c in classes:
        assert got[c] == pytest.approx(by_hand(pairs, c))
    n = len(pairs)
    assert got["accuracy"][0] == pytest.approx(sum(y == p for y, p in pairs) / n)
    for k in range(3):
        assert got["macro avg"][k] == pytest.approx(np.mean([by_hand(pairs, c)[k] for c in classes]))
        assert got["weighted avg"][k] == pytest.approx(sum(by_hand(pairs, c)[k] * by_hand(pairs, c)[3] for c in classes) / n)


def test_binary_zero_denominators(spark):
    assert tuple(metrics.binary_metrics(frame(spark, [(0, 0), (0, 0)])).first()) == (1.0, 0.0, 0.0, 0.0)
    assert tuple(metrics.binary_metrics(frame(spark, [(1, 0), (1, 1), (0, 1), (1, 1)])).first()) == pytest.approx((0.5, 2 / 3, 2 / 3, 2 / 3))


def test_confusion(spark):
    df = frame(spark, [(0, 1), (0, 1), (1, 1)])
    assert [tuple(r) for r in metrics.confusion_matrix(df, [0, 1]).collect()] == [(0, 0, 2), (1, 0, 1)]
    assert [tuple(r) for r in metrics.confusion_counts(df).collect()] == [(0, 1, 2), (1, 1, 1)]
    assert tuple(metrics.accuracy(df).first()) == (1, 3, pytest.approx(1 / 3))


def test_empty_metrics(spark):
    empty = frame(spark, [(1, 1)]).limit(0)
    assert tuple(metrics.binary_metrics(empty).first()) == (None, 0.0, 0.0, 0.0)
    assert tuple(metrics.weighted_metrics(empty).first()) == (None, 0.0, 0.0, 0.0)


def test_regression_metrics(spark):
    rows = [("x", 1.0, 2.0), ("x", 2.0, 2.5), ("x", 4.0, 3.0), ("y", 5.0, 5.0), ("y", 5.0, 6.0), ("z", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, target double, prediction double")
    got = {r["g"]: r for r in metrics.regression_metrics_by(df, "g").collect()}
    assert set(got) == {"x", "y", "z", "OVERALL"} and got["OVERALL"]["n"] == 6
    t, p = np.array([1, 2, 4.0]), np.array([2, 2.5, 3])
    assert got["x"]["mae"] == pytest.approx(np.mean(abs(t - p)))
    assert got["x"]["rmse"] == pytest.approx(np.sqrt(np.mean((t - p) ** 2)))
    assert got["x"]["r2"] == pytest.approx(1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum())
    assert math.isnan(got["y"]["r2"]) and math.isnan(got["z"]["r2"])
    assert metrics.regression_metrics_by(df.limit(0), "g").count() == 0


def test_scaler_roundtrip(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 50)], "y double")
    scaler = regression.fit_scaler(df, "y")
    logs = np.log1p([1, 2, 3, 50])
    assert tuple(scaler.first()) == pytest.approx((logs.mean(), logs.std(ddof=1)))
    back = regression.invert_scaler(regression.apply_scaler(df, scaler, "y"), scaler, "target_norm", "again")
    assert all(r["y"] == pytest.approx(r["again"]) for r in back.collect())


def test_calibration_matches_least_squares(spark):
    groups = {"a": ([1, 2, 3.0], [2, 4, 7.0]), "flat": ([2, 2, 2.0], [1, 2, 3.0]), "one": ([3.0], [6.0]), "zero": ([0.0, 0.0], [1.0, 3.0])}
    rows = [(g, float(p), float(t)) for g, (ps, ts) in groups.items() for p, t in zip(ps, ts)]
    df = spark.createDataFrame(rows, "g string, prediction double, target double")
    got = {r["g"]: (r["a"], r["b"]) for r in regression.fit_calibration(df, "g").collect()}
    for g, (p, t) in groups.items():
        want = np.linalg.lstsq(np.vstack([p, np.ones_like(p)]).T, np.array(t), rcond=None)[0]
        assert got[g] == pytest.approx(tuple(want), abs=1e-9), g
    fitted = regression.fit_calibration(df.filter("g = 'a'"), "g")
    out = {(r["g"], r["prediction"]): r["calibrated"] for r in regression.apply_calibration(df, fitted, "g", "prediction").collect()}
    assert out["one", 3.0] == 3.0 and out["a", 1.0] != 1.0


def test_numeric_functions(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([1000.0, 0.0, 0.0],)], "s array<double>")
    rows = df.select(numeric.softmax("s").alias("p"), numeric.argmax("s").alias("a")).collect()
    e = np.exp(np.array([1, 3, 3.0]) - 3)
    assert np.allclose(rows[0]["p"], e / e.sum()) and [r["a"] for r in rows] == [1, 0]
    levels = spark.createDataFrame([(t,) for t in (0, 1, 29, 30, 69, 70, 129, 130)], "t int").select(numeric.intensity("t").alias("i"))
    assert [r["i"] for r in levels.collect()] == [0.0, 0.35, 0.35, 0.6, 0.6, 0.8, 0.8, 1.0]
    opacity = spark.range(1).select(numeric.opacity(F.lit(0.6), F.lit(True)), numeric.opacity(F.lit(0.0), F.lit(False))).first()
    assert tuple(opacity) == (pytest.approx(0.7), 1.0)
