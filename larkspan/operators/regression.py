"""Target scaling, per-group calibration and their inverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import calibrate, scale_log1p, unscale_expm1
from .lookup import lookup_join


def fit_scaler(df: DataFrame, target: str) -> DataFrame:
    """One row: mean and sample deviation of ``log1p(target)``."""
    y = F.log1p(F.col(target).cast("double"))
    return df.agg(F.avg(y).alias("target_mean"), F.stddev_samp(y).alias("target_std"))


def scaler_values(scaler: DataFrame) -> tuple[Column, Column]:
    """Mean and deviation as scalar subqueries: no join, nothing collected."""
    pair = scaler.select(F.struct("target_mean", "target_std")).scalar()
    return pair.getField("target_mean"), pair.getField("target_std")


def apply_scaler(df: DataFrame, scaler: DataFrame, target: str, name: str = "target_norm") -> DataFrame:
    mean, std = scaler_values(scaler)
    return df.withColumn(name, scale_log1p(target, mean, std))


def invert_scaler(df: DataFrame, scaler: DataFrame, column: str, name: str) -> DataFrame:
    mean, std = scaler_values(scaler)
    return df.withColumn(name, unscale_expm1(column, mean, std))


def fit_calibration(
    df: DataFrame, group: str, prediction: str = "prediction", target: str = "target",
) -> DataFrame:
    """Least squares ``target = a * prediction + b`` per group, over rows that have both numbers.

    A constant predictor has no unique line; the shortest solution is taken.
    """
    p, t = F.col(prediction).cast("double"), F.col(target).cast("double")
    both = t.isNotNull() & p.isNotNull()
    paired = lambda c: F.when(both, c)
    fits = df.groupBy(group).agg(
        F.regr_slope(t, p).alias("_a"), F.regr_intercept(t, p).alias("_b"),
        F.min(paired(p)).alias("_low"), F.max(paired(p)).alias("_high"), F.avg(paired(t)).alias("_t"), F.count_if(both).alias("n"),
    )
    flat = F.col("_low") == F.col("_high")
    scale = F.col("_t") / (F.col("_low") * F.col("_low") + 1)
    return fits.select(
        group,
        F.coalesce(F.when(flat, F.col("_low") * scale).otherwise(F.col("_a")), F.lit(0.0)).alias("a"),
        F.coalesce(F.when(flat, scale).otherwise(F.col("_b")), F.lit(0.0)).alias("b"),
        "n",
    )


def apply_calibration(
    df: DataFrame, calibration: DataFrame, group: str, column: str, name: str = "calibrated",
) -> DataFrame:
    """Corrected value per group; a group without coefficients is unchanged."""
    joined = lookup_join(df, calibration.select(group, "a", "b"), [group], "left")
    return joined.withColumn(name, calibrate(column, F.col("a"), F.col("b"))).drop("a", "b")


def merge_params(params: DataFrame, calibration: DataFrame, group: str, note: str | None = None) -> DataFrame:
    """Parameter document with the calibration block replaced.

    The calibration has one row per language, so its map is built from at most
    as many entries as there are languages.
    """
    entries = calibration.agg(F.map_from_entries(F.collect_list(
        F.struct(F.col(group), F.struct(F.col("a"), F.col("b")))
    )).alias("m"))
    out = params.withColumn("per_language_calibration", entries.scalar())
    return out.withColumn("calibration_note", F.lit(note)) if note else out
