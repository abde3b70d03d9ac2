"""Classification metrics. One pass over the predictions yields confusion counts;
every other metric is arithmetic on those few rows. ``by`` names run columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.probabilities import ratio
from labelloom.operators.joins import same_groups
from labelloom.sizing import class_array

TOTALS = ("support", "predicted", "hits")


def correct(prediction: Column, truth: Column) -> Column:
    """1 where the prediction equals the truth, else 0."""
    return F.coalesce((prediction == truth).cast("int"), F.lit(0))


def confusion_counts(outcomes: DataFrame, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (actual, predicted)."""
    return outcomes.groupBy(
        *by, F.col(truth).alias("actual"), F.col("prediction").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def accuracy(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Examples, errors and accuracy."""
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)))
    total = F.sum("n")
    return counts.groupBy(*by).agg(
        total.alias("examples"), (total - hit).alias("errors"), (hit / total).alias("accuracy")
    )


def class_report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support for every class seen as truth or prediction."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(
            F.col("actual").alias("label"),
            F.col("n").alias("support"),
            F.lit(0).cast("bigint").alias("predicted"),
            hit.alias("hits"),
        ),
        F.struct(
            F.col("predicted").alias("label"),
            F.lit(0).cast("bigint").alias("support"),
            F.col("n").alias("predicted"),
            F.lit(0).cast("bigint").alias("hits"),
        ),
    )
    totals = (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in TOTALS])
    )
    return totals.select(
        *by,
        "label",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
    )


def macro_f1(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean F1 over all classes of the report."""
    return report.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def report_summary(report: DataFrame, counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The ``accuracy``, ``macro avg`` and ``weighted avg`` rows below a class report."""
    support = F.sum("support")
    measures = ("precision", "recall", "f1")
    macro = report.groupBy(*by).agg(
        F.lit("macro avg").alias("label"),
        *[F.avg(m).alias(m) for m in measures],
        support.cast("double").alias("support"),
    )
    weighted = report.groupBy(*by).agg(
        F.lit("weighted avg").alias("label"),
        *[(F.sum(F.col(m) * F.col("support")) / support).alias(m) for m in measures],
        support.cast("double").alias("support"),
    )
    overall = accuracy(counts, by).select(
        *by,
        F.lit("accuracy").alias("label"),
        *[F.col("accuracy").alias(m) for m in (*measures, "support")],
    )
    return overall.unionByName(macro).unionByName(weighted)


def full_report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Class rows followed by the summary rows."""
    report = class_report(counts, by)
    return report.withColumn("support", F.col("support").cast("double")).unionByName(
        report_summary(report, counts, by)
    )


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """(actual, predicted, n) over all pairs of *truth* labels, zeros included.

    A predicted value that never occurs as truth has no column here, while it
    does lower ``macro_f1``.
    """
    labels = class_array(counts, "actual")
    grid = counts.select("actual").distinct().select("actual", F.explode(labels).alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def confusion_table(counts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Confusion matrix with one column per label of a given list."""
    return (
        counts.where(F.col("actual").isin(*labels))
        .groupBy("actual")
        .pivot("predicted", list(labels))
        .agg(F.sum("n"))
        .fillna(0, subset=list(labels))
    )


def run_metrics(counts: DataFrame, label_column: str, by: Sequence[str] = ()) -> DataFrame:
    """One record per run: examples, macro-F1, accuracy."""
    score = macro_f1(class_report(counts, by), by)
    total = accuracy(counts, by)
    joined = same_groups(total, score, by) if by else total.withColumn("macro_f1", score.scalar())
    return joined.select(
        *by,
        F.lit(label_column).alias("label_column"),
        F.col("examples").alias("test_examples"),
        "macro_f1",
        "accuracy",
    )
