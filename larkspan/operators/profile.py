"""Dataset profiling: one small result table per question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..session import staged
from .lookup import settle

QUARTILES = (0.25, 0.5, 0.75)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column)


def value_percentages(df: DataFrame, column: str) -> DataFrame:
    """Share of each value in percent, two decimals."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(column, F.round(F.col("n") * 100.0 / total, 2).alias("percent")).orderBy(
        F.desc("percent"), column
    )


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of their key; repeated nulls count too."""
    per_key = df.groupBy(F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def blank_share(df: DataFrame, column: str) -> DataFrame:
    blank = F.count_if(is_blank(column))
    return df.agg(
        blank.alias("blank"),
        F.round(F.try_divide(blank * 100.0, F.count(F.lit(1))), 2).alias("blank_percent"),
    )


def mean_length(df: DataFrame, skip_null: Sequence[str], null_as_empty: Sequence[str] = ()) -> DataFrame:
    """Mean text length; a null is skipped or counts as length 0."""
    return df.agg(
        *[F.avg(F.length(c)).alias(f"{c}_mean_length") for c in skip_null],
        *[F.avg(F.coalesce(F.length(c), F.lit(0))).alias(f"{c}_mean_length") for c in null_as_empty],
    )


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column with its number of nulls, in one pass."""
    sums = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return sums.unpivot([], df.columns, "column_name", "nulls")


def largest_groups(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    sizes = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return sizes.orderBy(F.desc("n"), column).limit(n)


def smallest_groups(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    sizes = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return sizes.orderBy("n", column).limit(n)


def bounds_below(bounds: Column, value: Column, most: int) -> Column:
    """How many of at most ``most`` ascending bounds are below a value, by halving."""
    steps = [1 << i for i in reversed(range(most.bit_length()))]

    def step(at: Column, width: Column) -> Column:
        return F.when(F.get(bounds, at + width - 1) < value, at + width).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def grouped_quantiles(
    df: DataFrame, group: str, value: str, points: Sequence[float] = QUARTILES, slices: int = 200,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group; a null group is left out.

    Equal values are counted first, once, into a staged table. Approximate bounds cut each group's values
    into slices; the slice sizes tell which slice holds a wanted rank, and only
    those slices are sorted, each in a task of its own. The bounds only steer
    the work: the result is exact for any bounds, and a double only when it is interpolated.
    """
    counted = staged(
        df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
        .select(F.col(group), F.col(value).alias("_v"))
        .groupBy(group, "_v").agg(F.count(F.lit(1)).alias("_c")),
        "value-counts",
    )
    shares = [i / slices for i in range(1, slices)]
    bounds, fits = settle(
        counted.groupBy(group).agg(F.array_distinct(F.percentile_approx("_v", shares, 1_000)).alias("_bounds")),
        max_rows=5_000,
    )
    joined = counted.join(F.broadcast(bounds) if fits else bounds, group)
    sliced = joined.select(
        group, "_v", "_c", bounds_below(F.col("_bounds"), F.col("_v"), slices).alias("_slice")
    )
    running = W.partitionBy(group).orderBy("_slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    sizes = (
        sliced.groupBy(group, "_slice").agg(F.sum("_c").alias("_n"))
        .withColumn("_before", F.sum("_n").over(running) - F.col("_n"))
        .withColumn("_total", F.sum("_n").over(W.partitionBy(group)))
    )
    wanted = F.explode(F.array(*[F.lit(p) for p in points]))
    place = sizes.select("*", wanted.alias("_p")).withColumn("_rank", F.col("_p") * (F.col("_total") - 1))
    ends = place.select(
        "*", F.explode(F.array(F.floor("_rank").cast("bigint"), F.ceil("_rank").cast("bigint"))).alias("_k")
    ).filter((F.col("_before") <= F.col("_k")) & (F.col("_k") < F.col("_before") + F.col("_n")))
    ends = ends.select(group, "_slice", "_before", "_p", "_rank", "_k").distinct()
    in_slice = W.partitionBy(group, "_slice", "_p", "_k").orderBy("_v").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    marks, fits = settle(ends)
    hit = (
        sliced.join(F.broadcast(marks) if fits else ends, [group, "_slice"])
        .withColumn("_upto", F.col("_before") + F.sum("_c").over(in_slice))
        .filter((F.col("_upto") - F.col("_c") <= F.col("_k")) & (F.col("_k") < F.col("_upto")))
    )
    low, high = F.min("_v").cast("double"), F.max("_v").cast("double")
    part = F.any_value("_rank") - F.floor(F.any_value("_rank"))
    return hit.groupBy(group, F.col("_p").alias("point")).agg((low + (high - low) * part).alias("quantile"))


def grouped_describe(df: DataFrame, group: str, value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of a number per group."""
    v = F.col(value).cast("double")
    rows = df.filter(F.col(group).isNotNull())
    moments = rows.groupBy(group).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    quart = grouped_quantiles(rows, group, value)
    wide = quart.groupBy(group).agg(*[
        F.max(F.when(F.col("point") == p, F.col("quantile"))).alias(name)
        for p, name in zip(QUARTILES, ("q25", "q50", "q75"))
    ])
    return moments.join(wide, group, "left").select(
        group, "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).cast("bigint").alias("distinct_values"))


def sorted_distinct(df: DataFrame, column: str | Column) -> DataFrame:
    return df.select(column).distinct().orderBy(1)
