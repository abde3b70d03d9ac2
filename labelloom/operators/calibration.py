"""Probability calibration and confidence-ranked review.

``calibration_cases`` yields one row per scored text. One grouped pass over it
(``bin_totals``) holds everything that the reliability table and the summary need.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.binning import fixed_bin, quantile_bucket, unit_edges
from labelloom.functions.probabilities import (
    array_total,
    entry_of,
    labelled_probabilities,
    normalised,
    probability_array,
    ratio,
)
from labelloom.operators.evaluation import correct
from labelloom.operators.joins import matched, same_groups
from labelloom.operators.ordering import exact_quantiles, prefix_sums, running_totals
from labelloom.session import stored
from labelloom.sizing import MAX_DIMENSION_ROWS, small_table

# Number of bins and quantiles, review fractions, and the smallest
# probability that enters a logarithm (double precision epsilon).
BINS = 10
QUANTILES = 10
REVIEW_FRACTIONS = (0.1, 0.2, 0.3)
LOG_CLIP = 2.220446049250313e-16


def probability_columns(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Parse ``probabilities`` JSON into ``raw_p`` and ``p`` arrays and ``raw_total``."""
    parsed = labelled_probabilities(F.col("probabilities"), labels)
    return (
        df.withColumn("_parsed", parsed)
        .withColumn("raw_p", probability_array(F.col("_parsed"), labels))
        .drop("_parsed")
        .withColumn("raw_total", array_total(F.col("raw_p"), len(labels)))
        .withColumn("p", normalised(F.col("raw_p"), F.col("raw_total")))
    )


def calibration_cases(
    responses: DataFrame, truth: DataFrame, labels: Sequence[str], label: str = "v2_label"
) -> DataFrame:
    """Responses joined with truth, with correctness and selected probabilities."""
    joined = matched(
        responses.select("id", "prediction", "confidence", "probabilities"), truth.select("id", label)
    )
    return probability_columns(joined, labels).select(
        "id",
        "prediction",
        label,
        correct(F.col("prediction"), F.col(label)).alias("correct"),
        entry_of(F.col("raw_p"), F.col("prediction"), labels).alias("selected_probability_raw"),
        entry_of(F.col("p"), F.col("prediction"), labels).alias("selected_probability"),
        F.col("confidence").cast("double").alias("api_confidence"),
        entry_of(F.col("p"), F.col(label), labels).alias("true_probability"),
        "raw_total",
        "p",
    )


def bin_totals(cases: DataFrame, classes: int, bins: int = BINS, by: Sequence[str] = ()) -> DataFrame:
    """All sums of the calibration report, per group and fixed probability bin."""
    selected = F.col("selected_probability")
    squares = reduce(add, [F.pow(F.get("p", F.lit(i)), 2) for i in range(classes)])
    brier = squares - 2 * F.col("true_probability") + 1
    loss = -F.log(F.greatest("true_probability", F.lit(LOG_CLIP)))
    return (
        cases.withColumn("bin", fixed_bin(selected, unit_edges(bins)))
        .groupBy(*by, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("correct").alias("correct"),
            F.sum(selected).alias("selected"),
            F.sum(F.pow(selected - F.col("correct"), 2)).alias("top_squares"),
            F.sum(brier).alias("squares"),
            F.sum(loss).alias("loss"),
            F.max(F.abs(F.col("raw_total") - 1)).alias("raw_error"),
            F.max(F.abs(array_total(F.col("p"), classes) - 1)).alias("normalised_error"),
            F.max(F.abs(F.col("api_confidence") - F.col("selected_probability_raw"))).alias(
                "confidence_error"
            ),
            F.sum("api_confidence").alias("confidence"),
            F.min("api_confidence").alias("confidence_min"),
            F.max("api_confidence").alias("confidence_max"),
        )
    )


def reliability_bins(totals: DataFrame, bins: int = BINS, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean probability, accuracy and gap for every bin of every group; empty bins hold nulls."""
    edges = unit_edges(bins)
    grid = F.array(
        *[F.struct(F.lit(i + 1).alias("bin"), F.lit(edges[i]).alias("lower"), F.lit(edges[i + 1]).alias("upper")) for i in range(bins)]
    )
    # Computed first: a join would push "bin is not null" down to the parsed probabilities.
    known = small_table(totals, MAX_DIMENSION_ROWS)
    groups = known.select(*by).distinct() if by else totals.sparkSession.range(1)
    cells = groups.select(*by, F.inline(grid))
    mean, share = F.col("selected") / F.col("n"), F.col("correct") / F.col("n")
    return same_groups(cells, known, [*by, "bin"], "left").select(
        *by,
        "bin",
        "lower",
        "upper",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("count"),
        mean.alias("mean_probability"),
        share.alias("accuracy"),
        F.abs(mean - share).alias("absolute_gap"),
    )


def calibration_summary(totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per group with accuracy, diagnostics, ECE, MCE, Brier scores and log loss."""
    n = F.sum("n")
    gap = F.abs(F.col("selected") - F.col("correct"))
    return totals.groupBy(*by).agg(
        n.alias("examples"),
        F.sum("correct").alias("correct"),
        (n - F.sum("correct")).alias("errors"),
        (F.sum("correct") / n).alias("accuracy"),
        F.max("raw_error").alias("max_raw_sum_error"),
        F.max("normalised_error").alias("max_normalised_sum_error"),
        F.max("confidence_error").alias("max_confidence_difference"),
        (F.sum("selected") / n).alias("mean_selected_probability"),
        (F.sum("selected") / n - F.sum("correct") / n).alias("probability_minus_accuracy"),
        (F.sum(gap) / n).alias("ece"),
        F.max(gap / F.col("n")).alias("mce"),
        (F.sum("top_squares") / n).alias("top_label_brier"),
        (F.sum("squares") / n).alias("multiclass_brier"),
        (F.sum("loss") / n).alias("log_loss"),
        (F.sum("confidence") / n).alias("mean_confidence"),
        F.min("confidence_min").alias("min_confidence"),
        F.max("confidence_max").alias("max_confidence"),
    )


def with_quantile(df: DataFrame, column: str, quantiles: int = QUANTILES, by: Sequence[str] = ()) -> DataFrame:
    """Add the 1-based ``quantile`` bucket of its group; equal edges are merged, ties stay together."""
    steps = [i / quantiles for i in range(quantiles + 1)]
    edges = exact_quantiles(df, column, steps, by).select(*by, F.array_distinct("quantiles").alias("_edges"))
    known = df.where(F.col(column).isNotNull())
    if by:
        with_edges = same_groups(known, small_table(edges, MAX_DIMENSION_ROWS), by)
    else:
        with_edges = known.withColumn("_edges", edges.scalar())
    return with_edges.withColumn("quantile", quantile_bucket(F.col(column), F.col("_edges"), quantiles)).drop("_edges")


def confidence_quantiles(cases: DataFrame, quantiles: int = QUANTILES, by: Sequence[str] = ()) -> DataFrame:
    """Count, confidence range and accuracy per confidence quantile, within each group."""
    return (
        with_quantile(cases, "api_confidence", quantiles, by)
        .groupBy(*by, "quantile")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min("api_confidence").alias("min_confidence"),
            F.max("api_confidence").alias("max_confidence"),
            F.avg("api_confidence").alias("mean_confidence"),
            F.avg("correct").alias("accuracy"),
            (1 - F.avg("correct")).alias("error_rate"),
        )
    )


def _confidence() -> Column:
    """The confidence; a case without one has no place in any order and fails the job."""
    missing = F.concat(F.lit("no confidence for id "), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    return F.coalesce("api_confidence", F.raise_error(missing).cast("double"))


def risk_coverage(cases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For every confidence of a group: cases up to it, errors among them, and both as shares."""
    curve = running_totals(
        cases.select(*by, _confidence().alias("api_confidence"), "correct"),
        "api_confidence",
        {"cases": F.count(F.lit(1)), "errors": F.sum(1 - F.col("correct")).cast("long")},
        by,
    )
    return curve.select(
        *by,
        F.col("api_confidence"),
        F.col("cases_up_to").alias("reviewed_cases"),
        F.col("errors_up_to").alias("errors_caught"),
        (F.col("cases_up_to") / F.col("cases_total")).alias("review_fraction"),
        ratio(F.col("errors_up_to"), F.col("errors_total")).alias("error_capture_rate"),
        (F.col("errors_up_to") / F.col("cases_up_to")).alias("reviewed_error_rate"),
    )


def review_order(cases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, api_confidence, id, error, place, caught`` with ``place_total, caught_total``: the order of review, stored.

    ``place`` numbers the cases of a group by (confidence, id), ``caught`` counts the errors up to there. One
    shuffle of these columns answers every fraction.
    """
    narrow = cases.select(
        *by, _confidence().alias("api_confidence"), "id",
        (1 - F.col("correct")).cast("long").alias("error"), F.lit(1).cast("long").alias("one"),
    )
    return stored(prefix_sums(narrow, by, ["api_confidence", "id"], {"place": "one", "caught": "error"}).drop("one"), "review-order")


def review_cuts(ordered: DataFrame, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The last case of each group's lowest-confidence share: a row of ``review_order`` and its ``review_fraction``.

    A share covers ``ceil(cases * fraction)`` cases.
    """
    wanted = F.filter(
        F.array(*[F.struct(F.lit(f).alias("f"), F.ceil(F.col("place_total") * F.lit(f)).alias("k")) for f in fractions]),
        lambda x: x["k"] == F.col("place"),
    )
    return ordered.withColumn("_cut", F.explode(wanted)).withColumn("review_fraction", F.col("_cut.f")).drop("_cut")


def review_table(cases: DataFrame, fractions: Sequence[float] = REVIEW_FRACTIONS, by: Sequence[str] = ()) -> DataFrame:
    """Errors caught when the least confident share of each group's cases is reviewed.

    Order is (confidence, id). Since the cut may fall inside a run of equal confidence, the least and most errors any
    other order could catch are given too. All groups and fractions come from one ordering of the cases.
    """
    ordered = review_order(cases, by)
    found = review_cuts(ordered, fractions, by)
    cuts = small_table(found, MAX_DIMENSION_ROWS)
    tie = [*by, "api_confidence"]
    cut_runs = cuts.select(*tie).distinct()
    runs = (
        same_groups(ordered, cut_runs if cuts is found else F.broadcast(cut_runs), tie)
        .groupBy(*tie)
        .agg(
            F.count(F.lit(1)).alias("tied"),
            F.sum("error").alias("tied_errors"),
            F.min("place").alias("first"),
            F.min(F.col("caught") - F.col("error")).alias("errors_below"),
        )
    )
    needed = F.col("place") - F.col("first") + 1
    least = F.greatest(needed - (F.col("tied") - F.col("tied_errors")), F.lit(0))
    return same_groups(cuts, runs, tie).select(
        *by,
        "review_fraction",
        (F.col("review_fraction") * 100).alias("review_percentage"),
        F.col("place").alias("reviewed_cases"),
        F.col("caught_total").alias("total_errors"),
        F.col("caught").alias("errors_caught"),
        ratio(F.col("caught"), F.col("caught_total")).alias("error_capture_rate"),
        (F.col("caught") / F.col("place")).alias("reviewed_error_rate"),
        F.col("api_confidence").alias("max_confidence_reviewed"),
        (F.col("errors_below") + least).alias("errors_caught_least"),
        (F.col("errors_below") + F.least(needed, F.col("tied_errors"))).alias("errors_caught_most"),
    )


def lowest_confidence(cases: DataFrame, fraction: float, by: Sequence[str] = ()) -> DataFrame:
    """The cases to review: the least confident share of each group in the order (confidence, id).

    ``cases`` is read twice; only the columns of the order are shuffled.
    """
    last = F.struct(F.col("api_confidence").alias("confidence"), "id").alias("_last")
    cuts = small_table(review_cuts(review_order(cases, by), [fraction], by).select(*by, last), MAX_DIMENSION_ROWS)
    if by:
        bounded = same_groups(cases, cuts, by)
    else:
        bounded = cases.withColumn("_last", cuts.scalar())
    return bounded.where(F.struct(F.col("api_confidence").alias("confidence"), "id") <= F.col("_last")).drop("_last")
