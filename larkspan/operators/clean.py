"""Projections, filters and predicates over labelled tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, is_blank, strip
from .lookup import lookup_with_default

CONFIDENCE_THRESHOLD = 0.60
LOW_CONFIDENCE = 0.70


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def strip_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: strip(F.col(c).cast("string")) for c in columns})


def drop_blank(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.filter(~is_blank(c))
    return df


def blank_to_null(c: Column | str) -> Column:
    return F.when(~is_blank(c), col(c))


def clean_labelled(df: DataFrame, text: str = "text", label: str = "intent") -> DataFrame:
    """Keep text and label, both present and non-blank, stripped."""
    require_columns(df, [text, label])
    kept = df.select(text, label).dropna(subset=[text, label])
    return drop_blank(strip_columns(kept, [text, label]), [text, label])


def dropped_count(raw: DataFrame, text: str = "text", label: str = "intent") -> DataFrame:
    """How many rows ``clean_labelled`` keeps and drops, in one aggregate."""
    ok = ~is_blank(text) & ~is_blank(label)
    return raw.agg(
        F.count_if(ok).alias("kept"),
        F.count_if(~ok).alias("dropped"),
    )


def keep_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


def exclude_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Drop listed values; a null is not in the list, so it stays."""
    return df.filter(~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))


def cast_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Integer labels; a text that is no integer becomes null."""
    return df.withColumn(label, F.col(label).try_cast("int"))


def with_correct(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.withColumn("correct", F.col(label) == F.col(prediction))


def label_name(c: Column | str, names: dict[int, str]) -> Column:
    """Name of a class id; an unknown id is shown as its own text."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, col(c)), col(c).cast("string"))


def decode_label_ids(df: DataFrame, names: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Replace a class id by its name from a table ``(id, name)``."""
    joined = lookup_with_default(df, names, [id_col], {name_col: F.col(id_col).cast("string")})
    return joined.drop(id_col)


def usable_code(df: DataFrame, max_chars: int | None = None) -> DataFrame:
    """``code``, else the original text; present and, on demand, not too long."""
    code = F.coalesce(F.nullif("code", F.lit("")), F.nullif("original_string", F.lit("")))
    present = df.withColumn("code", code).filter(F.col("code").isNotNull())
    return present if max_chars is None else present.filter(F.length("code") <= max_chars)


def confidence_gate(
    df: DataFrame, threshold: float = CONFIDENCE_THRESHOLD,
    intent: str = "intent", confidence: str = "confidence",
) -> DataFrame:
    """Below the threshold the intent reads ``unknown``; the confidence stays."""
    sure = F.coalesce(F.col(confidence) >= threshold, F.lit(False))
    return df.withColumns({
        intent: F.when(sure, F.col(intent)).otherwise(F.lit("unknown")),
        confidence: F.coalesce(F.col(confidence), F.lit(0.0)),
    })


def low_confidence(df: DataFrame, below: float = LOW_CONFIDENCE, confidence: str = "confidence") -> DataFrame:
    return df.filter(F.col(confidence) < below)
