"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.binding import let


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, value: total + value)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, v: total + v * v))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors of one row; 0 when either has no length."""
    a, b = as_double(left), as_double(right)
    scale = norm(a) * norm(b)
    return F.when(scale == 0.0, 0.0).otherwise(dot(a, b) / scale)


def unit(vector: Column) -> Column:
    """The vector scaled to length one; a zero vector stays zero."""
    def scaled(values: Column) -> Column:
        return let(
            norm(values),
            lambda length: F.when(length == 0.0, values).otherwise(F.transform(values, lambda v: v / length)),
        )

    return let(as_double(vector), scaled)


def is_finite(vector: Column) -> Column:
    return ~F.exists(
        as_double(vector), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    )


def vector_problem(vector: Column, dimensions: int) -> Column:
    """Why a vector cannot enter an index of *dimensions*; null when it can."""
    return (
        F.when(vector.isNull(), "missing_vector")
        .when(F.size(vector) != dimensions, "wrong_dimensions")
        .when(~is_finite(vector), "non_finite_value")
    )
