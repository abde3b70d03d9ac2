"""Key-based joins: alignment of truth and predictions, gaps, pending work."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_row_per_key(df: DataFrame, *keys: str) -> DataFrame:
    """The table itself, failing the job if a key occurs twice.

    Rows are shuffled and sorted once by the keys; a following join on the same keys
    reuses partitioning and order. For wide rows that no join follows, see ``unique_keys``.
    """
    rows = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    single = F.when(F.col("_n") == 1, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("duplicate key: "), F.to_json(F.struct(*keys)))).cast("boolean")
    )
    return df.withColumn("_n", rows).where(single).drop("_n")


def unique_keys(df: DataFrame, *keys: str) -> DataFrame:
    """The table itself, failing the job if a key occurs twice; only the keys are shuffled."""
    repeated = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .agg(F.max(F.to_json(F.struct(*keys))).alias("_key"))
        .scalar()
    )
    single = F.when(repeated.isNull(), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("duplicate key: "), repeated)).cast("boolean")
    )
    return df.where(single)


def same_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two results of the same grouping; a null group meets the null group."""
    other = right.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in right.columns if c not in by])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return left.join(other, same, how).drop(*[f"_{c}" for c in by])


def aligned(truth: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Truth and predictions one to one; every id must occur on both sides.

    One full outer join finds unpredicted and unknown ids alike. Either fails
    the job; ``unpredicted`` and ``unknown`` list them instead.
    """
    left = one_row_per_key(truth, key).withColumn("_in_truth", F.lit(True))
    right = one_row_per_key(predictions, key).withColumn("_in_predictions", F.lit(True))
    both = F.col("_in_truth") & F.col("_in_predictions")
    checked_key = F.when(both, F.col(key)).otherwise(
        F.raise_error(
            F.concat(
                F.when(F.col("_in_truth"), "no prediction for id ").otherwise("unknown id "),
                F.col(key).cast("string"),
            )
        )
    )
    values = [c for c in left.columns + right.columns if c not in (key, "_in_truth", "_in_predictions")]
    return left.join(right, key, "full_outer").select(checked_key.alias(key), *values).where(
        F.col(key).isNotNull()
    )


def left_aligned(truth: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """All truth rows with their prediction, null where there is none."""
    return one_row_per_key(truth, key).join(one_row_per_key(predictions, key), key, "left")


def matched(responses: DataFrame, truth: DataFrame, key: str = "id") -> DataFrame:
    """Inner one-to-one join of responses and truth."""
    return one_row_per_key(responses, key).join(one_row_per_key(truth, key), key)


def unknown(predictions: DataFrame, truth: DataFrame, key: str = "id") -> DataFrame:
    """Predictions whose id is not in the truth table."""
    return predictions.join(truth.select(key), key, "left_anti")


def unpredicted(truth: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Truth rows without a prediction."""
    return truth.join(predictions.select(key), key, "left_anti")


def pending(inputs: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Inputs that have no result yet."""
    return inputs.join(done.select(*keys), list(keys), "left_anti")


def requested(results: DataFrame, inputs: DataFrame, key: str = "id") -> DataFrame:
    """Results for the requested ids only."""
    return results.join(inputs.select(key), key, "left_semi")


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the left table that the right table lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def coverage(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys without a counterpart, both ways: ``missing`` from ``known``, ``unknown`` to the data."""
    missing = key_difference(found, known, key).withColumn("kind", F.lit("missing"))
    extra = key_difference(known, found, key).withColumn("kind", F.lit("unknown"))
    return missing.unionByName(extra)


def labels_outside(df: DataFrame, columns: Sequence[str], labels: DataFrame) -> DataFrame:
    """Values of label columns that the class table (column ``label``) lacks, with row counts.

    The columns are unfolded to one, counted with map-side combination, and only
    the distinct values meet the class table.
    """
    named = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("label")) for c in columns])
    counted = df.select(F.inline(named)).groupBy("column", "label").agg(F.count(F.lit(1)).alias("rows"))
    return counted.join(labels.select("label"), "label", "left_anti").select("column", "label", "rows")
