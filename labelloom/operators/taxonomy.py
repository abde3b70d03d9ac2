"""Relabelling through a taxonomy and the transition between its two versions.

A mapping table holds ``intent, v1, v2, change``; a queue table holds
``stage, queue, description``. Both come from ``sources.taxonomy``, which checks
their size and hints their broadcast. The hint travels with every table derived
from them, so the corpus is not shuffled by label; a mapping beyond the bound is
joined by shuffle instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Entries of a sketch of distinct values, as a power of two.
SKETCH_BITS = 16


def named_classes(df: DataFrame, names: DataFrame, index: str = "label") -> DataFrame:
    """Replace a class index by its name (``names``: ``label, intent``)."""
    return df.join(names, index, "left").drop(index)


def relabelled(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add ``v1_label`` and ``v2_label``; an intent without a mapping fails the job."""
    targets = mapping.select("intent", F.struct("v1", "v2").alias("_target"))
    known = F.when(F.col("_target").isNotNull(), F.col("_target")).otherwise(
        F.raise_error(F.concat(F.lit("unmapped intent: "), F.coalesce("intent", F.lit("null"))))
    )
    return (
        df.join(targets, "intent", "left")
        .withColumn("_target", known)
        .select(*df.columns, F.col("_target.v1").alias("v1_label"), F.col("_target.v2").alias("v2_label"))
    )


def model_view(df: DataFrame) -> DataFrame:
    """What a model may see at test time: id and text."""
    return df.select("id", F.col("text").cast("string").alias("text"))


def training_view(df: DataFrame, label: str = "v2_label") -> DataFrame:
    """What a model may learn from: id, text and one label, never the intent."""
    return df.select("id", F.col("text").cast("string").alias("text"), label)


def queue_status(mapping: DataFrame) -> DataFrame:
    """Destinations of each V1 queue; one destination is CLEAN, several are IMPURE."""
    destinations = mapping.groupBy("v1").agg(F.sort_array(F.collect_set("v2")).alias("destinations"))
    status = F.when(F.size("destinations") == 1, "CLEAN").otherwise("IMPURE")
    return destinations.select("v1", "destinations", status.alias("status"))


def queues_with_status(mapping: DataFrame, status: str) -> DataFrame:
    return queue_status(mapping).where(F.col("status") == status).select("v1")


def rows_by_status(labelled: DataFrame, mapping: DataFrame, status: str) -> DataFrame:
    """Corpus rows whose V1 queue is CLEAN or IMPURE."""
    queues = queues_with_status(mapping, status).withColumnRenamed("v1", "v1_label")
    return labelled.join(queues, "v1_label", "left_semi")


def reusable_history(labelled: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows whose V2 label follows from their V1 label."""
    return rows_by_status(labelled, mapping, "CLEAN").select("id", "text", "v1_label", "v2_label")


def candidates(labelled: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows that need a new label under V2."""
    return rows_by_status(labelled, mapping, "IMPURE")


def affected_queues(mapping: DataFrame) -> DataFrame:
    """V2 queues that receive rows from an impure V1 queue."""
    impure = queues_with_status(mapping, "IMPURE")
    return mapping.join(impure, "v1", "left_semi").select("v2").distinct()


def transition_matrix(labelled: DataFrame) -> DataFrame:
    """Rows per (v1_label, v2_label)."""
    return labelled.groupBy("v1_label", "v2_label").agg(F.count(F.lit(1)).alias("rows"))


def class_counts(df: DataFrame, label: str, classes: DataFrame | None = None) -> DataFrame:
    """Rows per class; with a class table (column ``label``), absent classes count 0."""
    counted = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    if classes is None:
        return counted
    return classes.select("label").join(counted, "label", "left").select(
        "label", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows")
    )


def queue_distribution(df: DataFrame, queue: str, splits: Sequence[str] = ("train", "test")) -> DataFrame:
    """Rows per queue and split, their total, the share of the first split, and a TOTAL row."""

    def rows_in(split: str) -> Column:
        return F.count_if(F.col("split") == split)

    first = splits[0]
    totals = df.withColumn("queue", F.col(queue)).rollup("queue").agg(
        *[rows_in(split).alias(split) for split in splits],
        F.count_if(F.col("split").isin(*splits)).alias("total"),
        F.grouping("queue").alias("_is_total"),
    )
    # One row per queue is left here, so a window over all of them is small.
    whole = F.max(F.when(F.col("_is_total") == 1, F.col(first))).over(Window.partitionBy())
    return totals.select(
        F.when(F.col("_is_total") == 1, "TOTAL").otherwise(F.col("queue")).alias("queue"),
        *splits,
        "total",
        (F.col(first) / F.nullif(whole, F.lit(0))).alias("share"),
    )


def distinct_counts(df: DataFrame, *columns: str, approximate: bool = False) -> DataFrame:
    """Number of distinct values of each column, as (column, values).

    Exact by default: values of all columns are made distinct in one shuffle, and
    partial aggregation folds frequent values first. ``approximate`` moves sketches only.
    """
    if approximate:
        sketches = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        named = [F.struct(F.lit(c).alias("column"), F.col(c).alias("values")) for c in columns]
        return sketches.select(F.inline(F.array(*named)))
    named = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return (
        df.select(F.inline(F.array(*named)))
        .where(F.col("value").isNotNull())
        .distinct()
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("values"))
    )


def distinct_sketches(df: DataFrame, *columns: str) -> DataFrame:
    """``column, rows, sketch``: what to keep of a load to count distinct values over loads later, in one pass.

    Values count as strings. A sketch has 2^SKETCH_BITS entries of 8 bits at most, whatever the number of rows; its relative
    error is about 1.04 / 2^(SKETCH_BITS / 2), and far less for up to some thousand values.
    """
    sketches = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(SKETCH_BITS)).alias(f"_{i}") for i, c in enumerate(columns)]
    )
    named = [F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"_{i}").alias("sketch")) for i, c in enumerate(columns)]
    return sketches.select(F.inline(F.array(*named)))


def merged_distinct_counts(sketches: DataFrame) -> DataFrame:
    """``column, loads, rows, values`` from the sketches of any number of loads, without their rows."""
    merged = F.hll_union_agg("sketch", F.lit(False))
    return sketches.groupBy("column").agg(
        F.count(F.lit(1)).alias("loads"), F.sum("rows").alias("rows"), F.hll_sketch_estimate(merged).alias("values")
    )


def candidate_supply(pool: DataFrame, affected: DataFrame, budget: int) -> DataFrame:
    """Candidates per affected queue, and whether they cover the label budget."""
    counted = pool.groupBy(F.col("v2_label").alias("v2")).agg(F.count(F.lit(1)).alias("rows"))
    rows = F.coalesce("rows", F.lit(0)).cast("bigint")
    return affected.join(counted, "v2", "left").select(
        "v2", rows.alias("rows"), (rows >= budget).alias("enough")
    )


def new_labels(affected: DataFrame, budgets: Sequence[int]) -> DataFrame:
    """Labels to acquire per budget: budget times the number of affected queues."""
    queues = F.count_distinct("v2")
    return affected.agg(queues.alias("affected")).select(
        F.explode(F.array(*[F.lit(b) for b in budgets])).alias("budget"), "affected"
    ).select("budget", (F.col("budget") * F.col("affected")).alias("new_labels"))
