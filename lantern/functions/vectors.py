"""Column functions on vectors (arrays of numbers), summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """The vector at unit length; one of zeros is an error."""
    n = norm(v)
    return F.when(n == 0, F.raise_error(F.lit("a vector of zeros has no direction"))).otherwise(F.transform(v, lambda x: (x.cast("double") / n).cast("float")))


def of_dimension(v: Column, dimension: int) -> Column:
    """The vector, or an error if it has another dimension."""
    return F.when(F.size(v) == dimension, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dimension} dimensions, not "), F.size(v).cast("string"))))
