"""Checks that return their violations; an empty table means the check passed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators.joins import coverage, labels_outside, unknown, unpredicted
from labelloom.operators.taxonomy import queue_status
from labelloom.sizing import dimension

# Kinds of change an intent can undergo.
CHANGES = ("split", "move", "unchanged")


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    """The table itself; raises before any job if a column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def _violation(rule: str, key: Column, message: Column) -> list[Column]:
    return [F.lit(rule).alias("rule"), key.alias("key"), message.alias("message")]


def taxonomy_violations(
    queues: DataFrame,
    mapping: DataFrame,
    corpus_intents: DataFrame | None = None,
    expected_queues: dict[str, int] | None = None,
    expected_intents: int | None = None,
    header: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """All broken rules of a taxonomy as ``rule, key, message``.

    ``header`` takes what ``taxonomy_header_violations`` found, so that one table holds every violation.
    """
    rows = [("header", field, message) for field, message in header]
    found = [dimension(queues.sparkSession, rows, "rule string, key string, message string")]
    blank = queues.where(F.coalesce(F.trim("description"), F.lit("")) == "")
    found.append(
        blank.select(
            *_violation("description", F.concat_ws(".", "stage", "queue"), F.lit("description is blank"))
        )
    )
    for stage in ("v1", "v2"):
        names = queues.where(F.col("stage") == stage).select(F.col("queue").alias(stage))
        strays = mapping.join(names, stage, "left_anti")
        found.append(
            strays.select(
                *_violation("queue", F.col("intent"), F.lit(f"{stage} queue is not defined"))
            )
        )
        if expected_queues and stage in expected_queues:
            size = expected_queues[stage]
            found.append(
                queues.agg(F.count_if(F.col("stage") == stage).alias("n"))
                .where(F.col("n") != size)
                .select(
                    *_violation(
                        "queue count",
                        F.lit(stage),
                        F.concat(F.lit(f"expected {size}, found "), F.col("n").cast("string")),
                    )
                )
            )
    if expected_intents is not None:
        found.append(
            mapping.agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") != expected_intents)
            .select(
                *_violation(
                    "intent count",
                    F.lit("mapping"),
                    F.concat(
                        F.lit(f"expected {expected_intents}, found "), F.col("n").cast("string")
                    ),
                )
            )
        )
    kind_known = F.coalesce(F.col("change").isin(*CHANGES), F.lit(False))
    found.append(
        mapping.where(~kind_known).select(
            *_violation("change type", F.col("intent"), F.lit("is not split, move or unchanged"))
        )
    )
    stays = F.coalesce(F.col("v1") == F.col("v2"), F.lit(False))
    found.append(
        mapping.where(kind_known & (stays != (F.col("change") == "unchanged"))).select(
            *_violation("change", F.col("intent"), F.lit("change type contradicts the queues"))
        )
    )
    if corpus_intents is not None:
        found.append(
            coverage(mapping, corpus_intents, "intent").select(
                *_violation(
                    "coverage",
                    F.col("intent"),
                    F.when(F.col("kind") == "missing", "not in the mapping").otherwise("not in the corpus"),
                )
            )
        )
    return reduce(DataFrame.unionByName, found)


def taxonomy_header_violations(config: dict, version: str, dataset: str) -> list[tuple[str, str]]:
    """Field and message for each of the two header fields of a configuration that is not as expected."""
    expected = {"version": version, "dataset": dataset}
    return [(field, f"is not {value}") for field, value in expected.items() if config.get(field) != value]


def count_violations(
    df: DataFrame, columns: Sequence[str], rows: int | None = None, classes: dict[str, int] | None = None
) -> DataFrame:
    """Unexpected row count, class counts or nulls as ``measure, expected, found``; one pass."""
    measures = [F.count(F.lit(1)).alias("rows")]
    measures += [F.count_if(F.col(c).isNull()).alias(f"nulls in {c}") for c in columns]
    measures += [F.count_distinct(c).alias(f"classes in {c}") for c in (classes or {})]
    expected = {f"nulls in {c}": 0 for c in columns}
    expected |= {f"classes in {c}": n for c, n in (classes or {}).items()}
    if rows is not None:
        expected["rows"] = rows
    facts = F.array(
        *[
            F.struct(
                F.lit(name).alias("measure"),
                F.lit(value).cast("bigint").alias("expected"),
                F.col(f"`{name}`").alias("found"),
            )
            for name, value in expected.items()
        ]
    )
    return df.agg(*measures).select(F.inline(facts)).where(F.col("expected") != F.col("found"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def ambiguous_clean_queues(history: DataFrame, mapping: DataFrame) -> DataFrame:
    """Clean V1 queues whose rows carry more than one V2 label."""
    clean = queue_status(mapping).where(F.col("status") == "CLEAN").select(F.col("v1").alias("v1_label"))
    return (
        history.groupBy("v1_label", "v2_label")
        .agg(F.count(F.lit(1)).alias("rows"))
        .join(clean, "v1_label", "left_semi")
        .groupBy("v1_label")
        .agg(F.count(F.lit(1)).alias("labels"), F.sum("rows").alias("rows"))
        .where(F.col("labels") > 1)
    )


def prediction_violations(truth: DataFrame, predictions: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    """Unpredicted and unknown ids, and labels outside the taxonomy, as ``rule, key, rows``."""
    one = F.lit(1).cast("bigint").alias("rows")
    missing = unpredicted(truth, predictions).select(
        F.lit("no prediction").alias("rule"), F.col("id").cast("string").alias("key"), one
    )
    strays = unknown(predictions, truth).select(
        F.lit("unknown id").alias("rule"), F.col("id").cast("string").alias("key"), one
    )
    outside = labels_outside(predictions, ["prediction"], classes).unionByName(
        labels_outside(truth, [label], classes)
    )
    named = outside.select(
        F.concat(F.lit("label outside taxonomy in "), "column").alias("rule"),
        F.col("label").alias("key"),
        "rows",
    )
    return missing.unionByName(strays).unionByName(named)


def non_positive_sums(df: DataFrame, total: str = "raw_total") -> DataFrame:
    """Rows whose probabilities do not have a positive sum."""
    return df.where(~(F.col(total) > 0)).select("id", total)
