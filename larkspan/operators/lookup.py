"""Small-table lookups whose size is checked before anything is broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

MAX_LOOKUP_ROWS = 50_000
MAX_LOOKUP_BYTES = 128 << 20


def settle(df: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> tuple[DataFrame, bool]:
    """Write a table once and tell whether it is small enough to be broadcast.

    Its rows and the bytes of its text columns are counted where they are, so nothing
    but two numbers reaches the driver, and a table that does not fit is read
    again from its copy, not computed again.
    """
    held = staged(df, "lookup")
    wide = [F.octet_length(f.name) for f in held.schema if f.dataType.typeName() in ("string", "binary")]
    size = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(16 * len(held.columns))).cast("bigint")
    nested = any(f.dataType.typeName() in ("array", "map", "struct") for f in held.schema)
    if nested:
        size = size + F.octet_length(F.to_json(F.struct("*")))
    seen = held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return held, seen["n"] <= max_rows and seen["bytes"] <= MAX_LOOKUP_BYTES


def lookup_join(
    df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left",
    max_rows: int = MAX_LOOKUP_ROWS,
) -> DataFrame:
    """Attach a lookup table: broadcast within the bound, shuffled beyond it."""
    small, fits = settle(table, max_rows)
    return df.join(F.broadcast(small) if fits else small, list(on), how)


def lookup_with_default(
    df: DataFrame, table: DataFrame, on: Sequence[str], defaults: dict[str, Column],
    max_rows: int = MAX_LOOKUP_ROWS,
) -> DataFrame:
    """Left lookup where a missing key takes the default expression."""
    joined = lookup_join(df, table, on, "left", max_rows)
    return joined.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def semi_join(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    return lookup_join(df, keys.select(*on).distinct(), on, "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``keys``; a null key is kept."""
    return lookup_join(df, keys.select(*on).distinct(), on, "left_anti")


def suffixed_values(df: DataFrame, column: str, suffixes: Sequence[str], name: str = "value") -> DataFrame:
    """Every distinct value with every suffix, distinct and sorted.

    The suffixes are literals, so the pairs are made row by row without a join.
    """
    ends = F.explode(F.array(*[F.lit(x) for x in suffixes])).alias("_end")
    pairs = df.select(column).distinct().select(column, ends)
    return pairs.select(F.concat(F.col(column), F.col("_end")).alias(name)).distinct().orderBy(name)
