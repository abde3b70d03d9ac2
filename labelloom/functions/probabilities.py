"""Class-probability JSON, maps, arrays and the values derived from them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def labelled_probabilities(json: Column, labels: Sequence[str]) -> Column:
    """JSON object ``{class: p}`` as a struct with one double per class of the taxonomy.

    A typed struct keeps every later step in generated code; classes missing in
    the JSON become null and are read as 0 by ``probability_array``.
    """
    schema = T.StructType([T.StructField(label, T.DoubleType()) for label in labels])
    return F.from_json(json, schema, {"mode": "FAILFAST"})


def probability_map(json: Column) -> Column:
    """JSON object as ``map<string,double>``."""
    return F.from_json(json, "map<string,double>", {"mode": "FAILFAST"})


def probability_array(probabilities: Column, labels: Sequence[str]) -> Column:
    """Array in label order from a struct or map; a missing class counts 0."""
    return F.array(*[F.coalesce(probabilities.getItem(label), F.lit(0.0)) for label in labels])


def array_total(values: Column, size: int) -> Column:
    return reduce(add, [F.get(values, F.lit(i)) for i in range(size)])


def normalised(values: Column, total: Column) -> Column:
    """Divide by the sum; a sum that is not positive fails the job."""
    checked = F.when(total > 0, total).otherwise(
        F.raise_error(F.lit("a probability vector has a non-positive sum"))
    )
    return F.zip_with(values, F.array_repeat(checked, F.size(values)), lambda p, t: p / t)


def entry_of(values: Column, label: Column, labels: Sequence[str]) -> Column:
    """Entry of a label-ordered array that belongs to ``label`` (null if unknown)."""
    choice = F.lit(None).cast("double")
    for position, name in reversed(list(enumerate(labels))):
        choice = F.when(label == name, F.get(values, F.lit(position))).otherwise(choice)
    return choice


def one_hot(label: Column, labels: Sequence[str]) -> Column:
    """Array of 0.0/1.0 in label order."""
    return F.array(*[(label == name).cast("double") for name in labels])


def sorted_json(map_column: Column) -> Column:
    """JSON text of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(map_column))))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is 0 where the denominator is 0."""
    return F.coalesce(numerator / F.nullif(denominator, F.lit(0)), F.lit(0.0))
