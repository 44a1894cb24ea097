"""Vector expressions on ``array<float>``; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(vec: Column) -> Column:
    return vec.cast("array<float>")


def vec_lincomb(a: Column, wa: float | Column, b: Column, wb: float | Column) -> Column:
    wa = F.lit(wa) if not isinstance(wa, Column) else wa
    wb = F.lit(wb) if not isinstance(wb, Column) else wb
    return F.zip_with(a, b, lambda x, y: x.cast("double") * wa + y.cast("double") * wb)


def vec_ip(a: Column, b: Column) -> Column:
    """Inner product, accumulated left to right in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def vec_unit(vec: Column) -> Column:
    """Scale to length one; a zero vector stays as it is."""
    norm = F.sqrt(vec_ip(vec, vec))
    return F.when(norm > 0, F.transform(vec, lambda x: x.cast("double") / norm)).otherwise(
        vec.cast("array<double>")
    )


def vec_blend_guard(long: Column, short: Column, weight_long: float = 0.7) -> Column:
    """Blend two preference vectors.

    Of two vectors of one length the weighted mean, of different lengths the long-term
    one, otherwise whichever exists, else null.
    """
    blend = vec_lincomb(long, weight_long, short, 1 - weight_long)
    return (
        F.when(long.isNotNull() & short.isNotNull() & (F.size(long) == F.size(short)), blend)
        .when(long.isNotNull(), long.cast("array<double>"))
        .otherwise(short.cast("array<double>"))
    )
