"""Native vector expressions (VEC-1, VEC-2, dot products).

Vectors are ``array<float>`` columns; arithmetic is done in double. Every
function returns a Column built from higher-order functions, so the work stays
in the JVM next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12  # normalise() divides by max(norm, 1e-12)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Sum of element products, in index order, as double."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sum_squares(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_norm(a) -> Column:
    return F.sqrt(sum_squares(a))


def l2_normalize(a) -> Column:
    """``x / max(||x||, 1e-12)`` element-wise; a zero vector stays zero.

    The norm is computed once in the ``finish`` step of the fold and then
    applied, so the expression is linear in the dimension.
    """
    a = _c(a)
    return F.aggregate(
        a, F.lit(0.0).cast("double"),
        lambda acc, x: acc + x.cast("double") * x.cast("double"),
        lambda s: F.transform(a, lambda x: x.cast("double") / F.greatest(F.sqrt(s), F.lit(NORM_FLOOR))))


def subtract(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))


def is_valid(v, dim) -> Column:
    """VEC-1: exact dimension, every value present and finite."""
    v = _c(v)
    d = dim if isinstance(dim, Column) else F.lit(dim)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) == d) & finite, F.lit(False))


def invalid_reason(v, dim) -> Column:
    v = _c(v)
    d = dim if isinstance(dim, Column) else F.lit(dim)
    return (F.when(v.isNull(), F.lit("missing"))
            .when(F.size(v) != d, F.lit("dimension"))
            .when(~F.forall(v, lambda x: x.isNotNull()), F.lit("null value"))
            .when(~F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf")))),
                  F.lit("not finite")))


