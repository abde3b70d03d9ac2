"""Dense vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_vector(values: Column) -> Column:
    """Vector divided by its Euclidean length; a zero vector stays as it is."""
    square = F.aggregate(values, F.lit(0.0), lambda total, x: total + x * x)
    length = F.when(square > 0, F.sqrt(square)).otherwise(F.lit(1.0))
    return F.zip_with(values, F.array_repeat(length, F.size(values)), lambda x, n: x / n)
