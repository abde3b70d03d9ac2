"""Size checks that guard broadcasts and driver-sized dimension tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A taxonomy, a class list or a run grid is configuration written by people.
MAX_DIMENSION_ROWS = 100_000
MAX_BROADCAST_ROWS = 1_000_000
MAX_CLASSES = 10_000


def dimension(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A configuration table; its size is known, so joins may broadcast it."""
    if len(rows) > MAX_DIMENSION_ROWS:
        raise ValueError(f"{len(rows)} rows are too many for a configuration table")
    return F.broadcast(spark.createDataFrame(list(rows), schema).coalesce(1))


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that at most ``max_rows`` rows exist.

    Pass a stored table, whose count reads file footers only. Larger tables keep their shuffle join.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast for a table whose row bound follows from parameters."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def class_array(df: DataFrame, column: str, max_classes: int = MAX_CLASSES) -> Column:
    """Sorted distinct values of a label column as one array, as a scalar subquery.

    Fails when the column holds more than ``max_classes`` values, so that the
    array stays small whatever the input.
    """
    found = (
        df.select(F.col(column).alias("label"))
        .where(F.col("label").isNotNull())
        .distinct()
        .limit(max_classes + 1)
        .agg(F.sort_array(F.collect_list("label")).alias("labels"))
    )
    return found.select(
        F.when(F.size("labels") <= max_classes, F.col("labels")).otherwise(
            F.raise_error(F.lit(f"more than {max_classes} classes in {column}"))
        )
    ).scalar()


def small_table(df: DataFrame, rows: int) -> DataFrame:
    """Compute a result now and broadcast its values, if it has at most ``rows`` rows.

    For results that are few in practice (one row per fraction, bin or run), so
    that nothing is computed twice. A larger result stays a lazy table without a hint.
    """
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema).coalesce(1))
