"""Vector expressions over ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product accumulated in double, left to right."""
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column | str) -> Column:
    """Unit vector; an all-zero vector stays as it is."""
    return let(l2_norm(v), lambda n: F.when(n == 0, col(v).cast("array<double>")).otherwise(
        F.transform(col(v), lambda x: x.cast("double") / n)
    ))


def masked_mean(vectors: Column | str, mask: Column | str) -> Column:
    """Mean over the unmasked rows of an array of token vectors, one row per text."""
    v, m = col(vectors), col(mask)
    kept = F.greatest(F.aggregate(m, F.lit(0.0), lambda acc, x: acc + x.cast("double")), F.lit(1e-6))
    weighted = F.zip_with(v, m, lambda row, w: F.transform(row, lambda x: x.cast("double") * w.cast("double")))
    zero = F.transform(F.get(v, F.lit(0)), lambda x: F.lit(0.0))
    summed = F.aggregate(weighted, zero, lambda acc, row: F.zip_with(acc, row, lambda x, y: x + y))
    return let(kept, lambda n: F.transform(summed, lambda x: x / n))


def has_dimension(v: Column | str, d: int) -> Column:
    return F.coalesce(F.size(col(v)) == d, F.lit(False))
