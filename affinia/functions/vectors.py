"""Expressions over array<double> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_doubles(col: Column | str) -> Column:
    return _c(col).cast("array<double>")


def dot(left: Column | str, right: Column | str) -> Column:
    products = F.zip_with(as_doubles(left), as_doubles(right), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(col: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_doubles(col), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(col: Column | str) -> Column:
    """Unit-length vector; a zero vector stays as it is.

    The norm is put into a one-element array first, so that it is computed once
    per row and not once per position.
    """
    v = as_doubles(col)
    scaled = F.transform(
        F.array(norm(v)),
        lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)),
    )
    return F.element_at(scaled, 1)


def is_zero(col: Column | str) -> Column:
    return F.forall(as_doubles(col), lambda x: x == 0.0)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)
