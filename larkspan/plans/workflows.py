"""Whole workflows put together from the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip, video_text
from ..operators import chunking, clean, metrics, profile, ranking, regression, search, splits
from ..operators.bayes import BayesModel
from ..operators.classify import VIDEO_LABELS, ComplexityModel, TextModel, predict_normalized, predict_text, score_complexity
from ..operators.code_metrics import LANGUAGE_IDS
from ..operators.entities import extract_entities
from ..operators.least_squares import LeastSquaresModel
from ..sources import files, sinks

# --- corpus ------------------------------------------------------------------------


def build_index(
    spark: SparkSession, root: str, out: str, make_embed: Callable[[], search.EmbedFn] = search.hashed_words,
    sep: str = "\n\n",
) -> DataFrame | None:
    """Scan, decode, chunk, embed and store a file tree.

    Returns the statistics of the writing pass, or nothing when no file had any text. A file that
    cannot be parsed in its format is chunked as plain text.
    """
    return index_documents(files.read_documents(files.scan_files(spark, root)), out, make_embed, sep)


def index_documents(
    documents: DataFrame, out: str, make_embed: Callable[[], search.EmbedFn] = search.hashed_words, sep: str = "\n\n",
) -> DataFrame | None:
    """Chunk, embed and store documents given as ``filename, filepath, extension, content``; statistics as of ``build_index``."""
    return sinks.write_index_counted(
        documents, out, lambda df: search.embed(chunking.chunk_documents(df, sep=sep, flag="parsed"), make_embed=make_embed))


def search_index(
    spark: SparkSession, path: str, queries: DataFrame, k: int = search.TOP_K, min_score: float = search.MIN_SCORE,
    make_embed: Callable[[], search.EmbedFn] = search.hashed_words,
) -> DataFrame:
    """``rank, score, filename, filepath, chunk_id, preview`` per query."""
    return search.search(spark.read.parquet(path), queries, k=k, min_score=min_score, make_embed=make_embed)


def verify_embedding(
    spark: SparkSession, texts: Sequence[str], dimension: int,
    make_embed: Callable[[], search.EmbedFn] = search.hashed_words,
) -> DataFrame:
    """Sizes are right, and the first two texts are closer than the first and third."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i INT, content STRING")
    vectors = search.embed(rows, make_embed=make_embed)
    near = search.similarity_topk(
        vectors.filter("i = 0"), vectors, query_id="i", query_vec="embedding", ids=["i"], k=len(texts), min_score=-1.0
    )
    score = lambda i: F.max(F.when(F.col("i") == i, F.col("score")))
    sizes = vectors.agg(F.bool_and(F.size("embedding") == dimension)).scalar()
    return near.agg(score(1).alias("related"), score(2).alias("unrelated")).select(
        sizes.alias("sizes_ok"), "related", "unrelated", (F.col("related") > F.col("unrelated")).alias("order_ok")
    )


# --- videos ------------------------------------------------------------------------


def profile_videos(df: DataFrame) -> dict[str, DataFrame]:
    """One small table per question about a raw video set."""
    return {
        "rows": profile.row_count(df),
        "labels": profile.value_counts(df, "label"),
        "label_percent": profile.value_percentages(df, "label"),
        "per_channel": profile.value_counts(df, "channel"),
        "duplicate_ids": profile.duplicate_count(df, "video_id"),
        "empty_descriptions": profile.blank_share(df, "description"),
        "lengths": profile.mean_length(df, ["title"], ["description"]),
        "nulls": profile.null_counts(df),
        "largest_channels": profile.largest_groups(df, "channel"),
        "smallest_channels": profile.smallest_groups(df, "channel"),
    }


def prepare_videos(
    raw: DataFrame, validation: Sequence[str], test: Sequence[str], order: Sequence[str],
    description_chars: int | None = None,
) -> DataFrame:
    """Clean, deduplicate by id, build the text and hold out whole channels.

    ``order`` names the columns of the source order; the first row of an id stays.
    """
    rows = raw.filter(F.col("title").isNotNull()).withColumns({
        "description": strip(F.coalesce("description", F.lit(""))),
        "title": strip("title"), "channel": strip("channel"),
    })
    unique = ranking.dedupe_first(rows, ["video_id"], [F.col(c) for c in order])
    texts = unique.withColumn("text", video_text("title", "channel", "description", description_chars))
    return splits.holdout_split(texts, "channel", validation, test)


def evaluate_classifier(
    scored: DataFrame, label: str = "label", prediction: str = "prediction", names: dict | None = VIDEO_LABELS,
) -> dict[str, DataFrame]:
    return {
        "accuracy": metrics.accuracy(scored, label, prediction),
        "binary": metrics.binary_metrics(scored, label, prediction),
        "weighted": metrics.weighted_metrics(scored, label, prediction),
        "confusion": metrics.confusion_counts(scored, label, prediction),
        "report": metrics.classification_report(scored, label, prediction, names),
        "predictions": clean.with_correct(scored, label, prediction),
    }


# --- commands ----------------------------------------------------------------------


def run_intent_pipeline(
    df: DataFrame, model: TextModel | BayesModel, threshold: float = clean.CONFIDENCE_THRESHOLD, text: str = "text",
) -> DataFrame:
    """Intent, confidence and entities per sentence; unsure rows read ``unknown``."""
    scored = predict_text(df, model, text).withColumnRenamed("predicted", "intent").drop("probs")
    return extract_entities(clean.confidence_gate(scored, threshold), text)


def reality_check(
    holdout: DataFrame, model: TextModel | BayesModel, text: str = "text", truth: str = "intent",
) -> dict[str, DataFrame]:
    """Per-row result, accuracy, report and the uncertain rows of a hold-out set."""
    rows = clean.clean_labelled(holdout, text, truth)
    scored = predict_text(rows, model, text).drop("probs").withColumnRenamed("predicted", "prediction")
    checked = clean.with_correct(scored, truth, "prediction")
    return {
        "rows": checked,
        "accuracy": metrics.accuracy(checked, truth, "prediction"),
        "report": metrics.classification_report(checked, truth, "prediction"),
        "low_confidence": clean.low_confidence(checked),
    }


# --- complexity --------------------------------------------------------------------


def predict_complexity(
    df: DataFrame, model: ComplexityModel | LeastSquaresModel, scaler: DataFrame, calibration: DataFrame,
    make_embed: Callable[[], search.EmbedFn] = search.hashed_words,
) -> DataFrame:
    """Raw and calibrated complexity per ``code, language`` row; bad languages as error rows."""
    mean, std = regression.scaler_values(scaler)

    def predict(rows: DataFrame) -> DataFrame:
        vectors = rows.withColumn("embedding", search.embed_column(F.coalesce("code", F.lit("")), make_embed))
        return predict_normalized(vectors, model).drop("embedding")

    return score_complexity(df, mean, std, calibration, LANGUAGE_IDS, predict)
