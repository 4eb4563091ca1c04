"""Classification and regression scores as aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio

OVERALL = "OVERALL"


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """A null on either side is a miss."""
    hit = F.coalesce(F.col(label) == F.col(prediction), F.lit(False))
    return df.agg(
        F.count_if(hit).alias("correct"), F.count(F.lit(1)).alias("total"),
        F.avg(hit.cast("double")).alias("accuracy"),
    )


def binary_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", positive: int = 1,
) -> DataFrame:
    """Accuracy, precision, recall and F1 of one positive class; a null is not that class and never right."""
    y = F.coalesce(F.col(label) == positive, F.lit(False))
    p = F.coalesce(F.col(prediction) == positive, F.lit(False))
    counts = df.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"),
        F.avg(F.coalesce(F.col(label) == F.col(prediction), F.lit(False)).cast("double")).alias("accuracy"),
    )
    scored = counts.select(
        "accuracy",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )
    return scored


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Long form: one row per (truth, prediction) that occurs."""
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n")).orderBy(label, prediction)


def confusion_matrix(
    df: DataFrame, classes: Sequence, label: str = "label", prediction: str = "prediction",
) -> DataFrame:
    """Rows are the truth, one column per predicted class."""
    counts = df.groupBy(label).pivot(prediction, sorted(classes)).agg(F.count(F.lit(1)))
    named = counts.select(label, *[F.col(f"`{c}`").alias(f"pred_{c}") for c in sorted(classes)])
    return named.na.fill(0).orderBy(label)


def class_scores(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of every class seen on either side."""
    cells = df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0)
    sides = cells.select(F.inline(F.array(
        F.struct(F.col(label).cast("string").alias("class"), F.col("n").alias("truth"),
                 F.lit(0).cast("bigint").alias("predicted"), hit.cast("bigint").alias("tp")),
        F.struct(F.col(prediction).cast("string").alias("class"), F.lit(0).cast("bigint").alias("truth"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
    )))
    per_class = sides.filter(F.col("class").isNotNull()).groupBy("class").agg(
        F.sum("truth").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )
    return per_class.select(
        "class",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support", "tp",
    )


def _weighted(c: str) -> Column:
    return F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))


def weighted_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    scores = class_scores(df, label, prediction)
    return scores.agg(
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[_weighted(c).alias(c) for c in ("precision", "recall", "f1")],
    )


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction", names: dict | None = None,
) -> DataFrame:
    """One row per class, then accuracy, macro average and weighted average.

    The overall row is a second grouping set over the class rows, so the data
    is read and counted once. ``kind`` keeps the reading order.
    """
    scores = class_scores(df, label, prediction)
    if names:
        table = F.create_map(*[F.lit(str(x)) for pair in names.items() for x in pair])
        scores = scores.withColumn("class", F.coalesce(F.try_element_at(table, F.col("class")), F.col("class")))
    sets = scores.rollup("class").agg(
        F.grouping("class").alias("_all"), F.sum("support").alias("support"),
        F.try_divide(F.sum("tp"), F.sum("support")).alias("acc"),
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[_weighted(c).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
    )

    def line(kind: int, name: Column, precision: str, recall: str, f1: str) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), name.alias("class"), F.col(precision).alias("precision"),
            F.col(recall).alias("recall"), F.col(f1).alias("f1"), F.col("support").alias("support"),
        )

    own = F.array(line(0, F.col("class"), "m_precision", "m_recall", "m_f1"))
    summary = F.array(
        line(1, F.lit("accuracy"), "acc", "acc", "acc"),
        line(2, F.lit("macro avg"), "m_precision", "m_recall", "m_f1"),
        line(3, F.lit("weighted avg"), "w_precision", "w_recall", "w_f1"),
    )
    return sets.select(F.inline(F.when(F.col("_all") == 1, summary).otherwise(own)))


def _regression_aggregates(prediction: str, target: str) -> list[Column]:
    p, t = F.col(prediction).cast("double"), F.col(target).cast("double")
    residual = F.sum((t - p) * (t - p))
    spread = F.var_pop(t) * F.count(t)
    constant = F.min(t) == F.max(t)
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(p - t)).alias("mae"),
        F.sqrt(F.avg((p - t) * (p - t))).alias("rmse"),
        F.when(constant, F.lit(float("nan"))).otherwise(1 - F.try_divide(residual, spread)).alias("r2"),
    ]


def regression_metrics(df: DataFrame, prediction: str = "prediction", target: str = "target") -> DataFrame:
    """MAE, RMSE and R2; R2 is NaN when the target does not vary."""
    return df.agg(*_regression_aggregates(prediction, target))


def regression_metrics_by(
    df: DataFrame, group: str, prediction: str = "prediction", target: str = "target",
) -> DataFrame:
    """The same per group plus an OVERALL row, in one aggregate."""
    rows = df.filter(F.col(group).isNotNull()).withColumn(group, F.col(group).cast("string"))
    out = rows.rollup(group).agg(*_regression_aggregates(prediction, target), F.grouping(group).alias("_all"))
    return (
        out.withColumn(group, F.when(F.col("_all") == 1, OVERALL).otherwise(F.col(group)))
        .filter(F.col("n") > 0).drop("_all")
    )


@dataclass(frozen=True)
class UserMetric:
    """A caller's score, higher is better.

    ``sums`` turns the labels and predictions of a batch into numbers that add up over batches;
    ``score`` makes the result of their totals.
    """

    sums: Callable[[pa.Array, pa.Array], Sequence[float]]
    score: Callable[[list[float]], float]


def user_metric(df: DataFrame, metric: UserMetric, label: str = "label", prediction: str = "prediction") -> float | None:
    """The caller's score over all rows; each task gives one row of sums. Null without rows."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = np.asarray(metric.sums(batch.column(0), batch.column(1)), float)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    parts = df.select(label, prediction).mapInArrow(add, "sums array<double>").select(F.posexplode("sums").alias("i", "x"))
    found = parts.groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    return float(metric.score([r["x"] for r in found])) if found else None
