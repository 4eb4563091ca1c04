"""Ridge regression from sums that tasks add up, for the complexity score.

A row's features are its vector, with one offset per language. Each task adds up the products of
all pairs of features; their total has a size set by the vector's width, not by the rows, and every
penalty is solved on it. Offsets are not penalized.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import UserMetric, regression_metrics, user_metric

LANGUAGES = 6
PENALTIES = (0.0, 0.01, 0.1)


@dataclass
class LeastSquaresModel:
    """One weight per vector component, one offset per language id; ``mean_offset`` stands for other ids."""

    weights: np.ndarray
    offsets: np.ndarray
    mean_offset: float
    penalty: float
    score: float | None = None


@dataclass
class Moments:
    """Sums over ``n`` rows: ``gram`` of all pairs of features, ``cross`` of features and target."""

    gram: np.ndarray
    cross: np.ndarray
    n: int


def _design(vectors: pa.Array, ids: np.ndarray, languages: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(vectors), -1)
    return np.hstack([x, np.eye(languages)[ids]])


def moments(df: DataFrame, vec: str, target: str, language: str = "language_id", languages: int = LANGUAGES) -> Moments | None:
    """The sums of all rows that have a vector, a target and a known language; nothing without such rows.

    A task gives one row per feature. The rows of a feature are added up in one place, as many as there are tasks.
    """
    rows = df.select(F.col(vec).cast("array<double>").alias("v"), F.col(target).cast("double").alias("y"), F.col(language).cast("int").alias("l"))
    rows = rows.filter(F.col("v").isNotNull() & F.col("y").isNotNull() & F.col("l").between(0, languages - 1))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _design(batch.column("v"), batch.column("l").to_numpy(), languages)
                y = batch.column("y").to_numpy()[:, None]
                # the last column is the feature's sum with the target, the last row counts
                found = np.vstack([x.T @ np.hstack([x, y]), np.full((1, x.shape[1] + 1), len(x))])
                total = found if total is None else total + found
        if total is not None:
            yield _rows(total)

    def unite(table: pa.Table) -> pa.Table:
        total = np.sum(np.stack(table.column("sums").to_numpy()), axis=0)
        return pa.table({"i": pa.array([table.column("i")[0].as_py()], pa.int32()), "sums": pa.array([total.tolist()], pa.list_(pa.float64()))})

    def _rows(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    schema = "i int, sums array<double>"
    found = rows.mapInArrow(add, schema).groupBy("i").applyInArrow(unite, schema).orderBy("i").toArrow()
    if not found.num_rows:
        return None
    total = np.stack(found.column("sums").to_numpy())
    return Moments(total[:-1, :-1], total[:-1, -1], int(total[-1, 0]))


def solved(sums: Moments, penalty: float, languages: int = LANGUAGES) -> LeastSquaresModel:
    """The least squared error plus ``n * penalty`` times the squared weights; the shortest solution if it is not unique."""
    width = len(sums.cross) - languages
    ridge = np.diag([sums.n * penalty] * width + [0.0] * languages)
    found = np.linalg.lstsq(sums.gram + ridge, sums.cross, rcond=1e-12)[0]
    seen = np.diag(sums.gram)[width:] > 0
    offsets = found[width:]
    return LeastSquaresModel(found[:width], offsets, float(offsets[seen].mean()) if seen.any() else 0.0, penalty)


def fit_least_squares(
    train: DataFrame, validation: DataFrame, vec: str = "embedding", target: str = "target_norm",
    penalties: Sequence[float] = PENALTIES, metric: UserMetric | None = None,
) -> LeastSquaresModel:
    """The penalty with the lowest absolute error on the validation rows, or the best by the caller's metric.

    The training rows are read once, whatever the number of penalties.
    """
    sums = moments(train, vec, target)
    if sums is None:
        raise ValueError("no training rows")
    best: LeastSquaresModel | None = None
    for penalty in penalties:
        model = solved(sums, penalty)
        scored = predict_least_squares(validation, model, vec, "_p")
        if metric is not None:
            score = user_metric(scored, metric, target, "_p")
        else:
            error = regression_metrics(scored, "_p", target).first()["mae"]
            score = None if error is None else -error
        model.score = score
        if best is None or (score is not None and (best.score is None or score > best.score)):
            best = model
    return best


def predict_least_squares(df: DataFrame, model: LeastSquaresModel, vec: str = "embedding", name: str = "prediction") -> DataFrame:
    """Attach the prediction; null without a vector. A language id beyond the known ones gets the mean offset."""
    weights, offsets, rest = model.weights, model.offsets, model.mean_offset

    @F.pandas_udf("double")
    def run(vectors: pd.Series, ids: pd.Series) -> pd.Series:
        out = np.full(len(vectors), np.nan)
        have = vectors.notna().to_numpy()
        if have.any():
            numbers = ids[have].fillna(-1).to_numpy().astype(int)
            known = (numbers >= 0) & (numbers < len(offsets))
            own = np.where(known, offsets[np.where(known, numbers, 0)], rest)
            out[have] = np.stack(vectors[have].to_numpy()).astype("float64") @ weights + own
        return pd.Series(out).where(have, None)

    return df.withColumn(name, run(F.col(vec), F.col("language_id")))
