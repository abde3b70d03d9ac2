"""Calibration of selected probabilities and review by confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import probabilities as P
from labelloom.functions.binning import fixed_bin, unit_edges
from labelloom.operators import calibration, checks
from labelloom.plans import inputs as given
from labelloom.plans.inputs import CASES_SQL, LABELS, RUN_SQL
from labelloom.plans.registry import query, rounded, short
from labelloom.session import stored

EDGES_SQL = ", ".join(f"CAST({edge!r} AS DOUBLE)" for edge in unit_edges(10)[1:-1])
BIN_SQL = f"1 + len(list_filter([{EDGES_SQL}], lambda e: selected >= e))"
BINNED_SQL = f"""{CASES_SQL},
binned AS (SELECT *, CAST({BIN_SQL} AS INTEGER) AS bin FROM cases),
bins AS (
  SELECT bin, count(*) AS n, avg(selected) AS mean, avg(CAST(correct AS DOUBLE)) AS acc
  FROM binned GROUP BY bin)"""


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    return calibration.calibration_cases(given.chosen(spark, folder), given.truth(spark, folder), LABELS)


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    return calibration.calibration_summary(calibration.bin_totals(_cases(spark, folder), len(LABELS)))


def _review_cases(spark: SparkSession, folder: str) -> DataFrame:
    return stored(_cases(spark, folder).select("id", "api_confidence", "correct"), "cases")


@query(
    f"""WITH {CASES_SQL} SELECT id, prediction, truth AS v2_label, correct,
    round(raw_selected, 9) AS selected_probability_raw, round(selected, 9) AS selected_probability,
    confidence AS api_confidence FROM cases"""
)
def selected_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    cases = _cases(spark, folder).drop("true_probability", "raw_total", "p")
    return rounded(cases, "selected_probability_raw", "selected_probability", digits=9)


@query(
    f"""WITH {BINNED_SQL},
    grid AS (SELECT CAST(i AS INTEGER) AS bin,
               (i - 1) * CAST(0.1 AS DOUBLE) AS lower,
               CASE WHEN i = 10 THEN CAST(1 AS DOUBLE) ELSE i * CAST(0.1 AS DOUBLE) END AS upper
             FROM range(1, 11) r(i))
    SELECT bin, lower, upper, coalesce(n, 0) AS count, round(mean, 6) AS mean_probability,
           round(acc, 6) AS accuracy, round(abs(mean - acc), 6) AS absolute_gap
    FROM grid LEFT JOIN bins USING (bin)"""
)
def reliability_bins(spark: SparkSession, folder: str) -> DataFrame:
    bins = calibration.reliability_bins(calibration.bin_totals(_cases(spark, folder), len(LABELS)))
    return rounded(bins, "mean_probability", "accuracy", "absolute_gap")


@query(f"WITH {BINNED_SQL} SELECT id, bin FROM binned")
def probability_bins(spark: SparkSession, folder: str) -> DataFrame:
    bin_number = fixed_bin(F.col("selected_probability"), unit_edges(10))
    return _cases(spark, folder).select("id", bin_number.alias("bin"))


@query(
    f"""WITH {BINNED_SQL} SELECT round(sum(n * abs(mean - acc)) / sum(n), 6) AS ece,
    round(max(abs(mean - acc)), 6) AS mce FROM bins"""
)
def calibration_errors(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_summary(spark, folder).select("ece", "mce"), "ece", "mce")


@query(f"WITH {CASES_SQL} SELECT round(avg(pow(selected - correct, 2)), 6) AS top_label_brier FROM cases")
def top_label_brier(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_summary(spark, folder).select("top_label_brier"), "top_label_brier")


@query(f"WITH {CASES_SQL} SELECT round(avg(squares - 2 * p_true + 1), 6) AS multiclass_brier FROM cases")
def multiclass_brier(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_summary(spark, folder).select("multiclass_brier"), "multiclass_brier")


@query(
    f"""WITH {CASES_SQL} SELECT round(avg(-ln(greatest(p_true, 2.220446049250313e-16))), 6) AS log_loss
    FROM cases"""
)
def log_loss(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_summary(spark, folder).select("log_loss"), "log_loss")


@query(
    f"""WITH {CASES_SQL} SELECT round(max(abs(raw_total - 1)), 9) AS max_raw_sum_error,
    CAST(0 AS DOUBLE) AS max_normalised_sum_error,
    round(max(abs(confidence - raw_selected)), 9) AS max_confidence_difference FROM cases"""
)
def probability_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    names = ["max_raw_sum_error", "max_normalised_sum_error", "max_confidence_difference"]
    return rounded(_summary(spark, folder).select(*names), *names, digits=9)


@query(
    f"""WITH {CASES_SQL} SELECT round(avg(selected), 6) AS mean_selected_probability,
    round(avg(selected) - avg(CAST(correct AS DOUBLE)), 6) AS probability_minus_accuracy,
    round(avg(confidence), 6) AS mean_confidence, min(confidence) AS min_confidence,
    max(confidence) AS max_confidence FROM cases"""
)
def confidence_overview(spark: SparkSession, folder: str) -> DataFrame:
    names = ["mean_selected_probability", "probability_minus_accuracy", "mean_confidence"]
    return rounded(
        _summary(spark, folder).select(*names, "min_confidence", "max_confidence"), *names
    )


QUANTILE_SQL = f"""WITH {CASES_SQL},
edges AS (
  SELECT list_sort(list_distinct(quantile_cont(confidence,
    [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM cases),
bucketed AS (
  SELECT *, CAST(1 + len(list_filter(e[2:len(e) - 1], lambda x: confidence > x)) AS INTEGER) AS quantile
  FROM cases, edges)"""


@query(f"{QUANTILE_SQL} SELECT id, quantile FROM bucketed")
def quantile_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return calibration.with_quantile(_review_cases(spark, folder), "api_confidence").select("id", "quantile")


@query(
    f"""{QUANTILE_SQL} SELECT quantile, count(*) AS count, min(confidence) AS min_confidence,
    max(confidence) AS max_confidence, round(avg(confidence), 6) AS mean_confidence,
    round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy,
    round(1 - avg(CAST(correct AS DOUBLE)), 6) AS error_rate FROM bucketed GROUP BY quantile"""
)
def confidence_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    table = calibration.confidence_quantiles(_review_cases(spark, folder))
    return rounded(table, "mean_confidence", "accuracy", "error_rate")


RANKED_SQL = f"""WITH {CASES_SQL},
ranked AS (
  SELECT *, row_number() OVER (ORDER BY confidence, id) AS r, count(*) OVER () AS total,
         sum(1 - correct) OVER () AS all_errors
  FROM cases)"""


@query(
    f"""{RANKED_SQL}, wanted AS (SELECT CAST(f AS DOUBLE) AS f FROM (VALUES (0.1), (0.2), (0.3)) v(f)),
    reviewed AS (SELECT * FROM ranked, wanted WHERE r <= ceil(total * f)),
    cuts AS (
      SELECT f, count(*) AS k, sum(1 - correct) AS errors, max(confidence) AS c, max(all_errors) AS all_errors
      FROM reviewed GROUP BY f),
    tied AS (
      SELECT cuts.f, count(*) FILTER (confidence < c) AS below,
             sum(1 - correct) FILTER (confidence < c) AS errors_below,
             count(*) FILTER (confidence = c) AS n_tied,
             sum(1 - correct) FILTER (confidence = c) AS errors_tied
      FROM cases, cuts GROUP BY cuts.f)
    SELECT f AS review_fraction, round(f * 100, 6) AS review_percentage, k AS reviewed_cases,
           CAST(all_errors AS BIGINT) AS total_errors, CAST(errors AS BIGINT) AS errors_caught,
           round(CAST(errors AS DOUBLE) / all_errors, 6) AS error_capture_rate,
           round(CAST(errors AS DOUBLE) / k, 6) AS reviewed_error_rate, c AS max_confidence_reviewed,
           CAST(errors_below + greatest(k - below - (n_tied - errors_tied), 0) AS BIGINT) AS errors_caught_least,
           CAST(errors_below + least(k - below, errors_tied) AS BIGINT) AS errors_caught_most
    FROM cuts JOIN tied USING (f)"""
)
def review_table(spark: SparkSession, folder: str) -> DataFrame:
    table = calibration.review_table(_review_cases(spark, folder))
    return rounded(table, "review_percentage", "error_capture_rate", "reviewed_error_rate")


@query(
    f"""{RANKED_SQL} SELECT id, confidence AS api_confidence, correct FROM ranked
    WHERE r <= ceil(total * CAST(0.2 AS DOUBLE))"""
)
def lowest_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return calibration.lowest_confidence(_review_cases(spark, folder), 0.2)


@query(
    f"""WITH {CASES_SQL}, levels AS (
      SELECT confidence, count(*) AS n, sum(1 - correct) AS e FROM cases GROUP BY confidence),
    running AS (
      SELECT confidence, sum(n) OVER (ORDER BY confidence) AS n, sum(e) OVER (ORDER BY confidence) AS e,
             sum(n) OVER () AS all_n, sum(e) OVER () AS all_e FROM levels)
    SELECT confidence AS api_confidence, CAST(n AS BIGINT) AS reviewed_cases, CAST(e AS BIGINT) AS errors_caught,
           round(CAST(n AS DOUBLE) / all_n, 6) AS review_fraction,
           round(CAST(e AS DOUBLE) / all_e, 6) AS error_capture_rate,
           round(CAST(e AS DOUBLE) / n, 6) AS reviewed_error_rate FROM running"""
)
def risk_coverage(spark: SparkSession, folder: str) -> DataFrame:
    curve = calibration.risk_coverage(_review_cases(spark, folder))
    return rounded(curve, "review_fraction", "error_capture_rate", "reviewed_error_rate")


# ------------------------------------------------- per model, budget and draw

RUN = ("model", "budget", "draw")
RUNS_SQL = f"{CASES_SQL}, runs AS (SELECT *, {RUN_SQL} FROM cases)"


def _run_cases(spark: SparkSession, folder: str) -> DataFrame:
    return given.run_of(_cases(spark, folder))


def _run_review(spark: SparkSession, folder: str) -> DataFrame:
    return stored(_run_cases(spark, folder).select(*RUN, "id", "api_confidence", "correct"), "run-cases")


RUN_BINS_SQL = f"""{RUNS_SQL}, binned AS (SELECT *, CAST({BIN_SQL} AS INTEGER) AS bin FROM runs),
bins AS (
  SELECT model, budget, draw, bin, count(*) AS n, avg(selected) AS mean, avg(CAST(correct AS DOUBLE)) AS acc
  FROM binned GROUP BY ALL)"""


@query(
    f"""WITH {RUN_BINS_SQL}, errors AS (
      SELECT model, budget, draw, sum(n * abs(mean - acc)) / sum(n) AS ece, max(abs(mean - acc)) AS mce FROM bins GROUP BY ALL)
    SELECT model, budget, draw, count(*) AS examples, round(avg(CAST(correct AS DOUBLE)), 11) AS accuracy,
           round(any_value(ece), 11) AS ece, round(any_value(mce), 11) AS mce,
           round(avg(pow(selected - correct, 2)), 11) AS top_label_brier, round(avg(squares - 2 * p_true + 1), 11) AS multiclass_brier,
           round(avg(-ln(greatest(p_true, 2.220446049250313e-16::DOUBLE))), 11) AS log_loss, min(confidence) AS min_confidence
    FROM runs JOIN errors USING (model, budget, draw) GROUP BY ALL"""
)
def calibration_by_run(spark: SparkSession, folder: str) -> DataFrame:
    summary = calibration.calibration_summary(calibration.bin_totals(_run_cases(spark, folder), len(LABELS), by=RUN), RUN)
    names = ("accuracy", "ece", "mce", "top_label_brier", "multiclass_brier", "log_loss")
    return rounded(summary.select(*RUN, "examples", *names, "min_confidence"), *names, digits=11)


@query(
    f"""WITH {RUN_BINS_SQL}, grid AS (
      SELECT model, budget, draw, CAST(i AS INTEGER) AS bin, (i - 1) * CAST(0.1 AS DOUBLE) AS lower,
             CASE WHEN i = 10 THEN CAST(1 AS DOUBLE) ELSE i * CAST(0.1 AS DOUBLE) END AS upper
      FROM (SELECT DISTINCT model, budget, draw FROM runs), range(1, 11) r(i))
    SELECT model, budget, draw, bin, lower, upper, coalesce(n, 0) AS count, round(mean, 6) AS mean_probability,
           round(acc, 6) AS accuracy, round(abs(mean - acc), 6) AS absolute_gap
    FROM grid LEFT JOIN bins USING (model, budget, draw, bin)"""
)
def reliability_by_run(spark: SparkSession, folder: str) -> DataFrame:
    totals = calibration.bin_totals(_run_cases(spark, folder), len(LABELS), by=RUN)
    return rounded(calibration.reliability_bins(totals, by=RUN), "mean_probability", "accuracy", "absolute_gap")


@query(
    f"""WITH {RUNS_SQL}, edges AS (
      SELECT model, budget, draw, list_sort(list_distinct(quantile_cont(confidence,
        [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM runs GROUP BY ALL),
    bucketed AS (
      SELECT *, CAST(1 + len(list_filter(e[2:len(e) - 1], lambda x: confidence > x)) AS INTEGER) AS quantile
      FROM runs JOIN edges USING (model, budget, draw))
    SELECT model, budget, draw, quantile, count(*) AS count, min(confidence) AS min_confidence,
           max(confidence) AS max_confidence, round(avg(confidence), 6) AS mean_confidence,
           round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, round(1 - avg(CAST(correct AS DOUBLE)), 6) AS error_rate
    FROM bucketed GROUP BY ALL"""
)
def confidence_quantiles_by_run(spark: SparkSession, folder: str) -> DataFrame:
    table = calibration.confidence_quantiles(_run_review(spark, folder), by=RUN)
    return rounded(table, "mean_confidence", "accuracy", "error_rate")


RANKED_RUNS_SQL = f"""{RUNS_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model, budget, draw ORDER BY confidence, id) AS r,
         count(*) OVER (PARTITION BY model, budget, draw) AS total FROM runs),
wanted AS (SELECT CAST(f AS DOUBLE) AS f FROM (VALUES (0.1), (0.2), (0.3)) v(f))"""


@query(
    f"""WITH {RANKED_RUNS_SQL}, cuts AS (
      SELECT model, budget, draw, f, count(*) FILTER (r <= ceil(total * f)) AS k,
             sum(1 - correct) FILTER (r <= ceil(total * f)) AS errors, sum(1 - correct) AS all_errors,
             max(confidence) FILTER (r <= ceil(total * f)) AS c FROM ranked, wanted GROUP BY ALL),
    tied AS (
      SELECT cuts.model, cuts.budget, cuts.draw, f, count(*) FILTER (confidence < c) AS below,
             sum(1 - correct) FILTER (confidence < c) AS errors_below, count(*) FILTER (confidence = c) AS n_tied,
             sum(1 - correct) FILTER (confidence = c) AS errors_tied
      FROM runs JOIN cuts USING (model, budget, draw) GROUP BY ALL)
    SELECT model, budget, draw, f AS review_fraction, k AS reviewed_cases, CAST(all_errors AS BIGINT) AS total_errors,
           CAST(errors AS BIGINT) AS errors_caught, round(CAST(errors AS DOUBLE) / all_errors, 6) AS error_capture_rate,
           c AS max_confidence_reviewed,
           CAST(coalesce(errors_below, 0) + greatest(k - below - (n_tied - errors_tied), 0) AS BIGINT) AS errors_caught_least,
           CAST(coalesce(errors_below, 0) + least(k - below, errors_tied) AS BIGINT) AS errors_caught_most
    FROM cuts JOIN tied USING (model, budget, draw, f)"""
)
def review_by_run(spark: SparkSession, folder: str) -> DataFrame:
    table = calibration.review_table(_run_review(spark, folder), by=RUN)
    return rounded(table.drop("review_percentage", "reviewed_error_rate"), "error_capture_rate")


@query(
    f"""WITH {RANKED_RUNS_SQL} SELECT model, budget, draw, id, confidence AS api_confidence, correct
    FROM ranked WHERE r <= ceil(total * CAST(0.2 AS DOUBLE))"""
)
def lowest_confidence_by_run(spark: SparkSession, folder: str) -> DataFrame:
    return calibration.lowest_confidence(_run_review(spark, folder), 0.2, RUN)


@query(
    f"""WITH {RUNS_SQL}, levels AS (
      SELECT model, budget, draw, confidence, count(*) AS n, sum(1 - correct) AS e FROM runs GROUP BY ALL)
    SELECT model, budget, draw, confidence AS api_confidence,
           CAST(sum(n) OVER w AS BIGINT) AS reviewed_cases, CAST(sum(e) OVER w AS BIGINT) AS errors_caught,
           round(CAST(sum(n) OVER w AS DOUBLE) / sum(n) OVER g, 6) AS review_fraction,
           round(CAST(sum(e) OVER w AS DOUBLE) / sum(e) OVER g, 6) AS error_capture_rate,
           round(CAST(sum(e) OVER w AS DOUBLE) / sum(n) OVER w, 6) AS reviewed_error_rate
    FROM levels WINDOW g AS (PARTITION BY model, budget, draw), w AS (PARTITION BY model, budget, draw ORDER BY confidence)"""
)
def risk_coverage_by_run(spark: SparkSession, folder: str) -> DataFrame:
    curve = calibration.risk_coverage(_run_review(spark, folder), RUN)
    return rounded(curve, "review_fraction", "error_capture_rate", "reviewed_error_rate")


# ----------------------------------------------------------- probability values


ENTRIES_SQL = f"""WITH {CASES_SQL}, names AS (
  SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS label),
entries AS (
  SELECT id, label, truth, raw_total,
         CASE WHEN label = prediction THEN raw_selected WHEN label = truth THEN raw_true
              ELSE (1 - best) / 4 * scale END AS raw
  FROM cases, names)"""


@query(f"{ENTRIES_SQL} SELECT id, label, round(raw, 9) AS p FROM entries")
def probability_maps(spark: SparkSession, folder: str) -> DataFrame:
    """JSON to a map; classes missing in the JSON count 0."""
    parsed = given.chosen(spark, folder).select(
        "id", P.probability_map(F.col("probabilities")).alias("m")
    )
    entries = F.arrays_zip(
        F.array(*[F.lit(x) for x in LABELS]).alias("label"),
        P.probability_array(F.col("m"), LABELS).alias("p"),
    )
    return rounded(parsed.select("id", F.inline(entries).alias("label", "p")), "p", digits=9)


def _with_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return calibration.probability_columns(
        given.chosen(spark, folder).select("id", "prediction", "probabilities"), LABELS
    )


@query(f"{ENTRIES_SQL} SELECT id, round(max(raw), 9) AS largest, round(sum(raw), 9) AS total, "
       "count(*) AS classes FROM entries GROUP BY id")
def probability_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _with_vectors(spark, folder).select(
        "id",
        short(F.array_max("raw_p"), 9).alias("largest"),
        short(F.col("raw_total"), 9).alias("total"),
        F.size("raw_p").cast("bigint").alias("classes"),
    )


@query(f"{ENTRIES_SQL} SELECT id, label, round(raw / raw_total, 9) AS p FROM entries")
def normalised_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    entries = F.arrays_zip(F.array(*[F.lit(x) for x in LABELS]).alias("label"), F.col("p"))
    vectors = _with_vectors(spark, folder).select("id", F.inline(entries).alias("label", "p"))
    return rounded(vectors, "p", digits=9)


@query(f"{ENTRIES_SQL} SELECT id, label, CAST(label = truth AS DOUBLE) AS hot FROM entries")
def one_hot_truth(spark: SparkSession, folder: str) -> DataFrame:
    answered = given.chosen(spark, folder).select("id")
    truth = given.truth(spark, folder).join(answered, "id", "left_semi")
    entries = F.arrays_zip(
        F.array(*[F.lit(x) for x in LABELS]).alias("label"),
        P.one_hot(F.col("v2_label"), LABELS).alias("hot"),
    )
    return truth.select("id", F.inline(entries).alias("label", "hot"))


@query(
    """SELECT event_id AS id, '{"event":"' || event_type || '","props":"' || json_extract_string(props, '$.k')
    || '","user":"' || user_id || '"}' AS json FROM events"""
)
def sorted_json(spark: SparkSession, folder: str) -> DataFrame:
    events = given.table(spark, folder, "events")
    fields = F.create_map(
        F.lit("user"), F.col("user_id").cast("string"),
        F.lit("props"), F.get_json_object("props", "$.k"),
        F.lit("event"), F.col("event_type"),
    )
    return events.select(F.col("event_id").alias("id"), P.sorted_json(fields).alias("json"))


@query(
    f"""WITH {CASES_SQL} SELECT prediction, CAST(coalesce(sum(correct), 0) AS BIGINT) AS hits,
    count(*) FILTER (confidence >= 0.98) AS sure,
    round(coalesce(sum(correct) FILTER (confidence >= 0.98)
      / nullif(CAST(count(*) FILTER (confidence >= 0.98) AS DOUBLE), 0), 0), 6) AS sure_accuracy
    FROM cases GROUP BY prediction"""
)
def guarded_ratios(spark: SparkSession, folder: str) -> DataFrame:
    sure = F.col("api_confidence") >= 0.98
    return _cases(spark, folder).groupBy("prediction").agg(
        F.sum("correct").alias("hits"),
        F.count_if(sure).alias("sure"),
        short(P.ratio(F.sum(F.when(sure, F.col("correct"))), F.count_if(sure))).alias("sure_accuracy"),
    )


@query(
    """SELECT doc_id AS id, CAST(quality + toxic AS DOUBLE) AS raw_total FROM labels
    WHERE quality + toxic = 0"""
)
def non_positive_sums(spark: SparkSession, folder: str) -> DataFrame:
    totals = given.table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), (F.col("quality") + F.col("toxic")).cast("double").alias("raw_total")
    )
    return checks.non_positive_sums(totals)
