"""Metrics of many runs: completeness of the grid and summaries over draws."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.sizing import dimension

RUN = ("model", "budget", "draw")


def run_grid(
    spark: SparkSession, models: Sequence[str], budgets: Sequence[int], draws: Sequence[int]
) -> DataFrame:
    """Expected runs, one row per model, budget and draw."""
    return dimension(spark, list(product(models, budgets, draws)), "model string, budget int, draw int")


def grid_gaps(grid: DataFrame, runs: DataFrame) -> DataFrame:
    """Expected runs that are ``missing`` and runs recorded twice (``duplicate``)."""
    counted = runs.groupBy(*RUN).agg(F.count(F.lit(1)).alias("results"))
    joined = grid.join(counted, list(RUN), "left").withColumn(
        "results", F.coalesce("results", F.lit(0)).cast("bigint")
    )
    kind = F.when(F.col("results") == 0, "missing").when(F.col("results") > 1, "duplicate")
    return joined.select(*RUN, "results", kind.alias("kind")).where(F.col("kind").isNotNull())


def with_display_name(runs: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``model_display`` from a table ``model, model_display``; fall back to the model."""
    return runs.join(names, "model", "left").withColumn(
        "model_display", F.coalesce("model_display", "model")
    )


def draw_summary(runs: DataFrame, by: Sequence[str] = ("model", "model_display", "budget")) -> DataFrame:
    """Mean, sample deviation, least and largest macro-F1 and accuracy over draws."""
    measures = [
        f(metric).alias(f"{metric}_{name}")
        for metric in ("macro_f1", "accuracy")
        for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    ]
    return runs.groupBy(*by).agg(F.count("draw").alias("draws"), *measures)


def label_efficiency(summary: DataFrame, cost: DataFrame) -> DataFrame:
    """Quality per number of acquired labels (``cost``: ``budget, new_labels``)."""
    return summary.join(cost, "budget").select(
        "model_display",
        "budget",
        "new_labels",
        "macro_f1_mean",
        "macro_f1_min",
        "macro_f1_max",
        "accuracy_mean",
    )


def run_cards(training: DataFrame, by: Sequence[str], label: str = "v2_label") -> DataFrame:
    """Training rows, classes and newly acquired labels per run (``is_new`` marks the latter)."""
    return training.groupBy(*by).agg(
        F.count(F.lit(1)).alias("training_examples"),
        F.count_distinct(label).alias("classes"),
        F.count_if("is_new").alias("new_labels"),
    )
