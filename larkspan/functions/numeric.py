"""Scalar arithmetic: target scaling, class scores, display values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let


def scale_log1p(y: Column | str, mean: Column, std: Column) -> Column:
    return (F.log1p(col(y).cast("double")) - mean) / std


def unscale_expm1(z: Column | str, mean: Column, std: Column) -> Column:
    return F.expm1(col(z) * std + mean)


def calibrate(z: Column | str, a: Column, b: Column) -> Column:
    """Linear correction in normalized space; unchanged without coefficients."""
    return F.coalesce(a * col(z) + b, col(z))


def softmax(scores: Column | str) -> Column:
    s = col(scores)
    powers = let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return let(powers, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def argmax(scores: Column | str) -> Column:
    """0-based position of the first maximum."""
    s = col(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def ratio(num: Column, den: Column) -> Column:
    """0 when the denominator is 0, the rule of every score here."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / F.when(den == 0, F.lit(1)).otherwise(den))


# Minutes per day -> heat level.
INTENSITY_STEPS = ((30, 0.35), (70, 0.6), (130, 0.8))


def intensity(total: Column | str) -> Column:
    t = col(total)
    out = F.when(t == 0, 0.0)
    for below, level in INTENSITY_STEPS:
        out = out.when(t < below, level)
    return out.otherwise(1.0)


def opacity(level: Column | str, has_activity: Column) -> Column:
    return F.when(has_activity, 0.25 + col(level) * 0.75).otherwise(1.0)


def hex_channel(color: Column | str, position: int) -> Column:
    """Red (0), green (1) or blue (2) of a ``#rrggbb`` text."""
    return F.conv(F.substring(col(color), 2 + 2 * position, 2), 16, 10).cast("int")


def hash_fraction(*parts: Column) -> Column:
    """Reproducible number in [0, 1) from text parts; the same in any SQL with md5."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_pick(n: int | Column, *parts: Column) -> Column:
    """Reproducible 0-based choice among ``n``."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.floor(hash_fraction(*parts) * n).cast("int")
