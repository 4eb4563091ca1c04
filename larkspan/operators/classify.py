"""Text classifiers and the complexity regressor on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, OneHotEncoder, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import argmax, unscale_expm1
from ..functions.text import is_blank
from ..session import scratch_path
from .bayes import BayesModel, predict_bayes
from .clean import label_name
from .lookup import MAX_LOOKUP_ROWS
from .least_squares import LeastSquaresModel, predict_least_squares
from .metrics import UserMetric, regression_metrics, user_metric, weighted_metrics
from .ranking import label_vocabulary
from .regression import apply_calibration

# Names of the two video classes.
VIDEO_LABELS = {0: "entertainment", 1: "coding"}


@dataclass
class TextModel:
    """Fitted features and classifier with the score that chose it."""

    features: PipelineModel
    classifier: object
    labels: list[str]
    score: float


def _without_summary(model: object, spark: SparkSession) -> object:
    """The fitted model read from its saved form.

    A training summary holds the session, which cannot be sent to tasks any more once the session has observed a pass.
    """
    path = scratch_path(spark, "model")
    model.write().save(path)
    return type(model).load(path)


def text_features(cells: int) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol="_input", outputCol="_tokens", pattern=r"[\p{L}\p{N}]+", gaps=False),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=cells),
        IDF(inputCol="_tf", outputCol="features"),
    ])


def fit_text_classifier(
    train: DataFrame, validation: DataFrame, text: str = "text", label: str = "label",
    metric: str | UserMetric = "accuracy", grid: Sequence[float] = (0.001, 0.01, 0.1), cells: int = 1 << 14,
    max_iter: int = 30, labels: Sequence[str] | None = None,
) -> TextModel:
    """Multinomial logistic regression; the penalty is chosen on the validation rows.

    ``metric`` is ``accuracy``, ``f1`` (support-weighted) or a caller's. Labels may be
    strings or integers; the vocabulary covers both tables, a caller's metric sees label numbers.
    Labels go through the driver and are bounded; ``fit_bayes`` has no such bound.
    """
    if labels is None:
        found = label_vocabulary([train, validation], label).orderBy(label).limit(MAX_LOOKUP_ROWS + 1)
        labels = [str(r[0]) for r in found.collect()]
        if len(labels) > MAX_LOOKUP_ROWS:
            raise ValueError("too many distinct labels for a classifier")
    index = F.create_map(*[F.lit(x) for i, name in enumerate(labels) for x in (name, float(i))])

    def prepared(df: DataFrame) -> DataFrame:
        rows = df.filter(~is_blank(text) & F.col(label).isNotNull())
        return rows.select(
            F.col(text).alias("_input"), F.try_element_at(index, F.col(label).cast("string")).alias("_y")
        )

    features = text_features(cells).fit(prepared(train))
    keep = ["_y", "features"]
    fit_rows = features.transform(prepared(train)).select(*keep).persist(StorageLevel.MEMORY_AND_DISK)
    val_rows = features.transform(prepared(validation)).select(*keep).persist(StorageLevel.MEMORY_AND_DISK)
    best: TextModel | None = None
    try:
        for penalty in grid:
            model = LogisticRegression(
                featuresCol="features", labelCol="_y", family="multinomial", regParam=penalty,
                maxIter=max_iter, predictionCol="_p",
            ).fit(fit_rows)
            model = _without_summary(model, train.sparkSession)
            scored = model.transform(val_rows).select("_y", "_p")
            if isinstance(metric, UserMetric):
                score = user_metric(scored, metric, "_y", "_p") or 0.0
            else:
                score = weighted_metrics(scored, "_y", "_p").first()[metric] or 0.0
            if best is None or score > best.score:
                best = TextModel(features, model, list(labels), score)
    finally:
        fit_rows.unpersist()
        val_rows.unpersist()
    return best


def predict_text(df: DataFrame, model: TextModel | BayesModel, text: str = "text", keys: Sequence[str] | None = None) -> DataFrame:
    """Attach ``predicted``, ``confidence`` and the probability of every class.

    Logistic regression is stateless, so it works on a stream as well; naive Bayes joins
    tables, see ``predict_bayes`` for ``keys``. A blank text has no tokens and gets the class prior.
    """
    if isinstance(model, BayesModel):
        return predict_bayes(df, model, text, keys)
    filled = df.withColumn("_input", F.coalesce(F.col(text), F.lit("")))
    scored = model.classifier.transform(model.features.transform(filled))
    probs = vector_to_array("probability")
    names = F.array(*[F.lit(x) for x in model.labels])
    # A class that the training rows lack has no column; pad names to the width.
    out = scored.withColumn("_probs", probs).withColumns({
        "predicted": F.get(names, argmax("_probs")),
        "confidence": F.array_max("_probs"),
        "probs": F.map_from_arrays(F.slice(names, F.lit(1), F.size("_probs")), F.col("_probs")),
    })
    return out.select(*df.columns, "predicted", "confidence", "probs")


def predict_video(
    df: DataFrame, model: TextModel | BayesModel, text: str = "text", keys: Sequence[str] | None = None,
) -> DataFrame:
    """Integer label, its name, confidence and probabilities by name."""
    scored = predict_text(df, model, text, keys)
    return scored.select(
        *df.columns,
        F.col("predicted").cast("int").alias("prediction"),
        label_name(F.col("predicted").cast("int"), VIDEO_LABELS).alias("label_name"),
        "confidence",
        F.transform_keys("probs", lambda k, v: label_name(k.cast("int"), VIDEO_LABELS)).alias("probs"),
    )


# --- complexity --------------------------------------------------------------


@dataclass
class ComplexityModel:
    pipeline: PipelineModel
    regressor: object
    validation_mae: float


def _assembled(languages: int) -> Pipeline:
    return Pipeline(stages=[
        OneHotEncoder(inputCol="language_id", outputCol="_lang", handleInvalid="keep"),
        VectorAssembler(inputCols=["_vec", "_lang"], outputCol="features"),
    ])


def _with_vector(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("_vec", array_to_vector(F.col(vec).cast("array<double>")))


def fit_complexity_model(
    train: DataFrame, validation: DataFrame, vec: str = "embedding", target: str = "target_norm",
    penalties: Sequence[float] = (0.0, 0.01, 0.1), trees: int = 0,
) -> ComplexityModel:
    """Regress the normalized target on vector and language; lowest validation MAE wins."""
    pipeline = _assembled(6).fit(_with_vector(train, vec))

    def prepared(df: DataFrame) -> DataFrame:
        rows = pipeline.transform(_with_vector(df, vec))
        return rows.select("features", F.col(target).alias("_y")).persist(StorageLevel.MEMORY_AND_DISK)

    fit_rows, val_rows = prepared(train), prepared(validation)
    candidates = [
        LinearRegression(featuresCol="features", labelCol="_y", predictionCol="_p", regParam=p) for p in penalties
    ]
    if trees:
        candidates.append(GBTRegressor(featuresCol="features", labelCol="_y", predictionCol="_p", maxIter=trees, seed=42))
    best: ComplexityModel | None = None
    try:
        for candidate in candidates:
            model = _without_summary(candidate.fit(fit_rows), train.sparkSession)
            mae = regression_metrics(model.transform(val_rows), "_p", "_y").first()["mae"]
            if best is None or (mae is not None and mae < best.validation_mae):
                best = ComplexityModel(pipeline, model, mae if mae is not None else float("inf"))
    finally:
        fit_rows.unpersist()
        val_rows.unpersist()
    return best


def predict_normalized(df: DataFrame, model: ComplexityModel | LeastSquaresModel, vec: str = "embedding") -> DataFrame:
    if isinstance(model, LeastSquaresModel):
        return predict_least_squares(df, model, vec)
    scored = model.regressor.transform(model.pipeline.transform(_with_vector(df, vec)))
    return scored.withColumn("prediction", F.col("_p")).select(*df.columns, "prediction")


def score_complexity(
    df: DataFrame, params_mean: Column, params_std: Column, calibration: DataFrame,
    language_ids: dict[str, int], predict,
) -> DataFrame:
    """Raw and calibrated complexity per snippet; an unknown language is an error row.

    ``predict`` adds a normalized ``prediction`` to rows with ``language_id``.
    """
    ids = F.create_map(*[F.lit(x) for pair in language_ids.items() for x in pair])
    language = F.lower("language")
    known = F.try_element_at(ids, language)
    error = F.when(
        known.isNull(), F.concat(F.lit("Unknown language '"), F.coalesce(language, F.lit("")), F.lit("'"))
    )
    # Error rows go along under id 0 and lose their numbers at the end: one pass over the data.
    rows = df.withColumns({
        "error": error, "language_id": F.coalesce(known, F.lit(0)), "language": language,
    })
    scored = apply_calibration(predict(rows), calibration, "language", "prediction")

    def shown(c: str) -> Column:
        return F.when(F.col("error").isNull(), F.bround(unscale_expm1(c, params_mean, params_std), 2))

    return scored.select(
        *df.columns, shown("prediction").alias("raw_complexity"),
        shown("calibrated").alias("calibrated_complexity"), "error",
    )


@dataclass
class DenseWeights:
    """Language lookup and the three layers of a trained scoring head."""

    language: np.ndarray
    layers: Sequence[tuple[np.ndarray, np.ndarray]]


def dense_score(df: DataFrame, weights: DenseWeights, vec: str = "embedding", name: str = "prediction") -> DataFrame:
    """Forward pass over Arrow batches; weights are broadcast once."""
    shared = df.sparkSession.sparkContext.broadcast((weights.language, list(weights.layers)))

    @F.pandas_udf("double")
    def run(vectors: pd.Series, ids: pd.Series) -> pd.Series:
        language, layers = shared.value
        if not len(vectors):
            return pd.Series([], dtype="float64")
        x = np.hstack([np.stack(vectors.to_numpy()).astype("float64"), language[ids.to_numpy()]])
        for i, (matrix, bias) in enumerate(layers):
            x = x @ matrix + bias
            if i < len(layers) - 1:
                x = np.maximum(x, 0)
        return pd.Series(x[:, 0])

    return df.withColumn(name, run(F.col(vec), F.col("language_id")))
