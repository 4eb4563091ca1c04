"""Reproducible and group-held-out splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import SEED, digest, global_cuts

VAL_SHARE = 0.1


def holdout_split(df: DataFrame, column: str, validation: Sequence[str], test: Sequence[str]) -> DataFrame:
    """Whole groups go to validation or test; everything else is training."""
    c = F.col(column)
    return df.withColumn(
        "split",
        F.when(c.isin(list(validation)), "val").when(c.isin(list(test)), "test").otherwise("train"),
    )


def positional_split(
    df: DataFrame, keys: Sequence[str], train_to: float = 0.8, val_to: float = 0.9, seed: int | str = SEED,
) -> DataFrame:
    """Shuffle by digest, cut at ``floor(n * 0.8)`` and ``floor(n * 0.9)``."""
    total = F.col("total")
    cuts = global_cuts(df, keys, {"train": F.floor(total * train_to), "val": F.floor(total * val_to)}, seed)
    h = digest(keys, seed)
    return df.withColumn(
        "split", F.when(h <= cuts["train"], "train").when(h <= cuts["val"], "val").otherwise("test")
    )


def validation_split(
    df: DataFrame, keys: Sequence[str], share: float = VAL_SHARE, rounding: str = "floor", seed: int | str = SEED,
) -> DataFrame:
    """Train and validation; the validation size is rounded down or up."""
    if rounding not in ("floor", "ceil"):
        raise ValueError("rounding must be 'floor' or 'ceil'")
    round_size = F.floor if rounding == "floor" else F.ceil
    cuts = global_cuts(df, keys, {"val": round_size(F.col("total") * share)}, seed)
    return df.withColumn("split", F.when(digest(keys, seed) <= cuts["val"], "val").otherwise("train"))
