"""Evaluation of predictions, and summaries over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.names import run_name
from labelloom.operators import accounting, checks, evaluation, joins, runs, taxonomy
from labelloom.plans import inputs as given
from labelloom.plans.inputs import EVENTS_SQL, RUN_SQL
from labelloom.plans.registry import query, rounded, short
from labelloom.session import new_path
from labelloom.sizing import dimension
from labelloom.sources.runs import discover_runs
from labelloom.sources.tables import keyed, read_records, write_records

KEYED_BUCKETS = 8
MODEL_NAMES = [("m0", "Model zero")]
USD_PER_MILLION = 0.042


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    return given.scored(spark, folder).select("id", "prediction")


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return joins.aligned(given.truth(spark, folder), _predictions(spark, folder))


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.confusion_counts(_outcomes(spark, folder), "v2_label")


def _run_counts(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.confusion_counts(given.run_of(_outcomes(spark, folder)), "v2_label", runs.RUN)


def _run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.run_metrics(_run_counts(spark, folder), "v2_label", runs.RUN)


def _classes(spark: SparkSession) -> DataFrame:
    return dimension(spark, [(label,) for label in given.LABELS], "label string")


def _names(spark: SparkSession) -> DataFrame:
    return dimension(spark, MODEL_NAMES, "model string, model_display string")


REPORT_SQL = """
counts AS (SELECT truth AS actual, prediction AS predicted, count(*) AS n FROM scored GROUP BY ALL),
sides AS (
  SELECT actual AS label, n AS support, 0 AS predicted, CASE WHEN actual = predicted THEN n ELSE 0 END AS hits
  FROM counts
  UNION ALL SELECT predicted, 0, n, 0 FROM counts),
report AS (
  SELECT label, coalesce(sum(hits) / nullif(CAST(sum(predicted) AS DOUBLE), 0), 0) AS precision,
         coalesce(sum(hits) / nullif(CAST(sum(support) AS DOUBLE), 0), 0) AS recall,
         coalesce(2 * sum(hits) / nullif(CAST(sum(support) + sum(predicted) AS DOUBLE), 0), 0) AS f1,
         CAST(sum(support) AS DOUBLE) AS support
  FROM sides GROUP BY label)"""

# Metrics per run of the grid, from the same formulas grouped by run.
RUNS_SQL = f"""
run_rows AS (SELECT *, {RUN_SQL} FROM scored),
run_counts AS (
  SELECT model, budget, draw, truth AS actual, prediction AS predicted, count(*) AS n
  FROM run_rows GROUP BY ALL),
run_sides AS (
  SELECT model, budget, draw, actual AS label, n AS support, 0 AS predicted,
         CASE WHEN actual = predicted THEN n ELSE 0 END AS hits FROM run_counts
  UNION ALL SELECT model, budget, draw, predicted, 0, n, 0 FROM run_counts),
run_f1 AS (
  SELECT model, budget, draw, label,
         coalesce(2 * sum(hits) / nullif(CAST(sum(support) + sum(predicted) AS DOUBLE), 0), 0) AS f1,
         sum(support) AS support, sum(hits) AS hits
  FROM run_sides GROUP BY ALL),
runs AS (
  SELECT model, budget, draw, CAST(sum(support) AS BIGINT) AS test_examples, avg(f1) AS macro_f1,
         CAST(sum(hits) AS DOUBLE) / sum(support) AS accuracy
  FROM run_f1 GROUP BY ALL)"""


@query(f"WITH {EVENTS_SQL} SELECT id, truth AS v2_label, prediction FROM scored")
def aligned_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return joins.left_aligned(given.truth(spark, folder), _predictions(spark, folder))


@query(
    f"""WITH {EVENTS_SQL} SELECT truth AS v2_label, count(*) AS rows, count(*) FILTER (prediction = truth) AS correct
    FROM scored GROUP BY truth"""
)
def metrics_on_keyed_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Truth and predictions written by id; they meet one to one without being shuffled again."""
    truth = keyed(given.truth(spark, folder), "id", KEYED_BUCKETS, "truth")
    predictions = keyed(_predictions(spark, folder), "id", KEYED_BUCKETS, "predictions")
    outcomes = joins.aligned(truth, predictions)
    return outcomes.groupBy("v2_label").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(evaluation.correct(F.col("prediction"), F.col("v2_label"))).alias("correct")
    )


@query(f"WITH {EVENTS_SQL} SELECT id, truth AS v2_label, prediction FROM scored WHERE prediction <> 'INVALID'")
def scored_truth_join(spark: SparkSession, folder: str) -> DataFrame:
    responses = given.answered(spark, folder).select("id", "prediction")
    return joins.matched(responses, given.truth(spark, folder)).select("id", "v2_label", "prediction")


@query(
    f"WITH {EVENTS_SQL} SELECT id, prediction FROM scored WHERE id NOT IN (SELECT doc_id FROM documents)"
)
def unknown_prediction_ids(spark: SparkSession, folder: str) -> DataFrame:
    known = given.table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    return joins.unknown(_predictions(spark, folder), known)


@query(
    f"""WITH {EVENTS_SQL} SELECT id, truth AS v2_label FROM base
    WHERE id NOT IN (SELECT id FROM scored WHERE prediction <> 'INVALID')"""
)
def unpredicted_truth(spark: SparkSession, folder: str) -> DataFrame:
    return joins.unpredicted(given.truth(spark, folder), given.answered(spark, folder))


@query(
    f"""WITH {EVENTS_SQL}
    SELECT 'prediction' AS "column", prediction AS label, count(*) AS rows FROM scored
    WHERE prediction NOT IN ('click', 'error', 'purchase', 'signup', 'view') GROUP BY prediction"""
)
def labels_outside_taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    return joins.labels_outside(_outcomes(spark, folder), ["prediction", "v2_label"], _classes(spark))


@query(
    f"""WITH {EVENTS_SQL}, predicted AS (SELECT id, prediction FROM scored WHERE prediction <> 'INVALID')
    SELECT 'no prediction' AS rule, CAST(id AS VARCHAR) AS key, 1 AS rows FROM base
    WHERE id NOT IN (SELECT id FROM predicted)
    UNION ALL
    SELECT 'label outside taxonomy in prediction', prediction, count(*) FROM predicted
    WHERE prediction = 'view' GROUP BY prediction
    UNION ALL
    SELECT 'label outside taxonomy in v2_label', truth, count(*) FROM base WHERE truth = 'view' GROUP BY truth"""
)
def prediction_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Answers without the invalid ones, checked against a class table that lacks one class."""
    answers = given.answered(spark, folder).select("id", "prediction")
    classes = dimension(spark, [(label,) for label in given.LABELS if label != "view"], "label string")
    return checks.prediction_violations(given.truth(spark, folder), answers, "v2_label", classes)


@query("SELECT user_id, count(*) AS rows FROM events GROUP BY user_id HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    return checks.duplicate_keys(given.table(spark, folder, "events"), "user_id")


@query(f"WITH {EVENTS_SQL} SELECT id, CAST(prediction = truth AS INTEGER) AS correct FROM scored")
def correct_flags(spark: SparkSession, folder: str) -> DataFrame:
    hit = evaluation.correct(F.col("prediction"), F.col("v2_label"))
    return _outcomes(spark, folder).select("id", hit.alias("correct"))


@query(
    f"""WITH {EVENTS_SQL} SELECT count(*) AS examples, count(*) FILTER (prediction <> truth) AS errors,
    round(avg(CAST(prediction = truth AS DOUBLE)), 6) AS accuracy FROM scored"""
)
def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluation.accuracy(_counts(spark, folder)), "accuracy")


@query(f"WITH {EVENTS_SQL}, {REPORT_SQL} SELECT round(avg(f1), 6) AS macro_f1 FROM report")
def macro_f1(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluation.macro_f1(evaluation.class_report(_counts(spark, folder))), "macro_f1")


@query(
    f"""WITH {EVENTS_SQL}, {REPORT_SQL} SELECT label, round(precision, 6) AS precision,
    round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM report"""
)
def class_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluation.class_report(_counts(spark, folder)), "precision", "recall", "f1")


@query(
    f"""WITH {EVENTS_SQL}, {REPORT_SQL},
    overall AS (SELECT avg(CAST(prediction = truth AS DOUBLE)) AS a FROM scored)
    SELECT 'accuracy' AS label, round(a, 6) AS precision, round(a, 6) AS recall, round(a, 6) AS f1,
           round(a, 6) AS support FROM overall
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
           sum(support) FROM report
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
           round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
           sum(support) FROM report"""
)
def report_summary(spark: SparkSession, folder: str) -> DataFrame:
    counts = _counts(spark, folder)
    summary = evaluation.report_summary(evaluation.class_report(counts), counts)
    return rounded(summary, "precision", "recall", "f1", "support")


@query(
    f"""WITH {EVENTS_SQL}, names AS (SELECT DISTINCT truth AS name FROM base)
    SELECT a.name AS actual, p.name AS predicted, count(s.id) AS n
    FROM names a CROSS JOIN names p LEFT JOIN scored s ON s.truth = a.name AND s.prediction = p.name
    GROUP BY ALL"""
)
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.confusion_matrix(_counts(spark, folder))


@query(
    f"""WITH {EVENTS_SQL} SELECT truth AS actual,
    count(*) FILTER (prediction = 'click') AS click, count(*) FILTER (prediction = 'error') AS error,
    count(*) FILTER (prediction = 'purchase') AS purchase,
    count(*) FILTER (prediction = 'signup') AS signup, count(*) FILTER (prediction = 'view') AS "view"
    FROM scored GROUP BY truth"""
)
def confusion_table(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.confusion_table(_counts(spark, folder), given.LABELS)


# ------------------------------------------------------------------------ runs


@query(
    f"""WITH {EVENTS_SQL}, {RUNS_SQL} SELECT model, budget, draw, 'v2_label' AS label_column, test_examples,
    round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy FROM runs"""
)
def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_run_metrics(spark, folder), "macro_f1", "accuracy")


@query(
    f"""WITH {EVENTS_SQL}, {RUNS_SQL} SELECT model, budget, draw,
    model || '_b' || budget || '_d' || lpad(CAST(draw AS VARCHAR), 2, '0') AS run FROM runs"""
)
def run_names(spark: SparkSession, folder: str) -> DataFrame:
    named = run_name(F.col("model"), F.col("budget"), F.col("draw"))
    return _run_metrics(spark, folder).select(*runs.RUN, named.alias("run"))


@query(
    f"""WITH {EVENTS_SQL}, {RUNS_SQL} SELECT model, budget, draw,
    CASE model WHEN 'm0' THEN 'Model zero' ELSE model END AS model_display FROM runs"""
)
def run_display_names(spark: SparkSession, folder: str) -> DataFrame:
    named = runs.with_display_name(_run_metrics(spark, folder), _names(spark))
    return named.select(*runs.RUN, "model_display")


@query(
    f"""WITH {EVENTS_SQL}, {RUNS_SQL}, wanted AS (
      SELECT * FROM (VALUES ('m0'), ('m1'), ('m2')) m(model), (VALUES (20), (100)) b(budget),
                    (VALUES (1), (2), (3), (4), (5), (6)) d(draw)),
    written AS (SELECT model, budget, draw FROM runs UNION ALL SELECT model, budget, draw FROM runs WHERE draw = 2)
    SELECT * FROM (
      SELECT model, budget, draw, count(written.draw) AS results FROM wanted LEFT JOIN written USING (model, budget, draw)
      GROUP BY ALL), LATERAL (SELECT CASE results WHEN 0 THEN 'missing' WHEN 2 THEN 'duplicate' END AS kind)
    WHERE kind IS NOT NULL"""
)
def run_grid_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Cells without a run, and runs recorded twice in one file."""
    path = new_path(spark, "metrics")
    records = _run_metrics(spark, folder).withColumn("run", run_name(*[F.col(c) for c in runs.RUN]))
    twice = records.unionByName(records.where("draw = 2")).repartition(4, "run")
    write_records(twice.select("run", "macro_f1", "accuracy"), path, ["run"])
    write_records(records.limit(1).select(F.lit("notes").alias("run"), "macro_f1"), path, ["run"], mode="append")
    grid = runs.run_grid(spark, ["m0", "m1", "m2"], given.BUDGETS, range(1, 7))
    return runs.grid_gaps(grid, discover_runs(spark, f"{path}/run=*"))


SUMMARY_SQL = f"""WITH {EVENTS_SQL}, {RUNS_SQL}, summary AS (
  SELECT model, CASE model WHEN 'm0' THEN 'Model zero' ELSE model END AS model_display, budget,
         count(draw) AS draws,
         round(avg(macro_f1), 6) AS macro_f1_mean, round(stddev_samp(macro_f1), 6) AS macro_f1_std,
         round(min(macro_f1), 6) AS macro_f1_min, round(max(macro_f1), 6) AS macro_f1_max,
         round(avg(accuracy), 6) AS accuracy_mean, round(stddev_samp(accuracy), 6) AS accuracy_std,
         round(min(accuracy), 6) AS accuracy_min, round(max(accuracy), 6) AS accuracy_max
  FROM runs GROUP BY model, budget)"""
MEASURES = [f"{m}_{s}" for m in ("macro_f1", "accuracy") for s in ("mean", "std", "min", "max")]


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    return runs.draw_summary(runs.with_display_name(_run_metrics(spark, folder), _names(spark)))


@query(f"{SUMMARY_SQL} SELECT * FROM summary ORDER BY model, budget")
def draw_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_summary(spark, folder), *MEASURES).orderBy("model", "budget")


@query(
    f"""{SUMMARY_SQL} SELECT model_display, budget, CAST(budget * 3 AS BIGINT) AS new_labels, macro_f1_mean,
    macro_f1_min, macro_f1_max, accuracy_mean FROM summary ORDER BY model_display, budget"""
)
def label_efficiency(spark: SparkSession, folder: str) -> DataFrame:
    affected = taxonomy.affected_queues(given.order_mapping(spark))
    view = runs.label_efficiency(_summary(spark, folder), taxonomy.new_labels(affected, given.BUDGETS))
    return rounded(
        view, "macro_f1_mean", "macro_f1_min", "macro_f1_max", "accuracy_mean"
    ).orderBy("model_display", "budget")


@query(
    f"""WITH {EVENTS_SQL}, {RUNS_SQL} SELECT model, budget, draw, round(macro_f1, 6) AS macro_f1,
    round(accuracy, 6) AS accuracy FROM runs ORDER BY model, budget, draw"""
)
def discovered_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics written as one folder per run, then found again by their names."""
    path = new_path(spark, "metrics")
    named = run_name(F.col("model"), F.col("budget"), F.col("draw"))
    records = _run_metrics(spark, folder).withColumn("run", named)
    write_records(records.select("run", "label_column", "macro_f1", "accuracy"), path, ["run"])
    found = discover_runs(spark, f"{path}/run=*").drop("source_file")
    return rounded(found, "macro_f1", "accuracy").orderBy(*runs.RUN)


@query(
    f"""WITH {EVENTS_SQL}, {RUNS_SQL} SELECT model, round(avg(macro_f1), 6) AS f1_mean,
    count(*) AS runs, CAST(sum(test_examples) AS BIGINT) AS examples FROM runs GROUP BY model"""
)
def metrics_records(spark: SparkSession, folder: str) -> DataFrame:
    """Nested summary records written as JSON and read back."""
    path = new_path(spark, "summary")
    cell = F.struct("budget", "draw", "test_examples", "macro_f1", "accuracy")
    nested = _run_metrics(spark, folder).groupBy("model").agg(F.collect_list(cell).alias("cells"))
    write_records(nested, path)
    back = read_records(spark, path, nested.schema)
    return back.select("model", F.inline("cells")).groupBy("model").agg(
        short(F.avg("macro_f1")).alias("f1_mean"),
        F.count(F.lit(1)).alias("runs"),
        F.sum("test_examples").alias("examples"),
    )


# ------------------------------------------------------------------ accounting


@query(
    f"""WITH {EVENTS_SQL} SELECT 'm' || (id % 2) AS response_model, round(avg(latency_ms), 6) AS mean,
    round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95
    FROM scored GROUP BY 1"""
)
def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = accounting.latency_summary(given.scored(spark, folder), ["response_model"])
    return rounded(summary, "mean", "p50", "p95")


@query(
    """SELECT round(avg(l_extendedprice), 6) AS mean, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
    round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem"""
)
def exact_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.schema("l_extendedprice double").parquet(f"{folder}/lineitem.parquet")
    return rounded(accounting.latency_summary(lines, column="l_extendedprice"), "mean", "p50", "p95")


@query(
    f"""WITH {EVENTS_SQL}, usage AS (
      SELECT 'm' || (id % 2) AS response_model, count(*) AS requests,
             CAST(sum(200 + k) AS BIGINT) AS input_tokens, count(*) AS output_tokens FROM scored GROUP BY 1)
    SELECT response_model, requests, input_tokens, output_tokens,
           round(CAST(input_tokens AS DOUBLE) / 1000000 * 0.042, 9) AS input_cost_usd,
           round(CAST(input_tokens AS DOUBLE) / 1000000 * 0.042 / requests * 1000, 9) AS cost_per_thousand_usd
    FROM usage"""
)
def token_costs(spark: SparkSession, folder: str) -> DataFrame:
    costs = accounting.token_costs(given.scored(spark, folder), USD_PER_MILLION, ["response_model"])
    return rounded(costs, "input_cost_usd", "cost_per_thousand_usd", digits=9)


@query(f"WITH {EVENTS_SQL} SELECT DISTINCT 'm' || (id % 2) AS response_model FROM scored")
def response_models(spark: SparkSession, folder: str) -> DataFrame:
    return accounting.response_models(given.scored(spark, folder))


@query(
    f"""WITH {EVENTS_SQL} SELECT 'm' || (id % 2) AS response_model,
    count(*) FILTER (prediction = 'INVALID') AS invalid, count(*) AS answers FROM scored GROUP BY 1"""
)
def invalid_answers(spark: SparkSession, folder: str) -> DataFrame:
    return accounting.invalid_answers(given.scored(spark, folder), ["response_model"])


@query(
    f"""WITH {EVENTS_SQL} SELECT 'service' AS method, 'm0,m1' AS response_models, count(*) AS test_examples,
    round(avg(latency_ms), 6) AS mean, round(quantile_cont(latency_ms, 0.95), 6) AS p95,
    CAST(sum(200 + k) AS BIGINT) AS input_tokens,
    round(CAST(sum(200 + k) AS DOUBLE) / 1000000 * 0.042, 9) AS cost FROM scored"""
)
def run_record(spark: SparkSession, folder: str) -> DataFrame:
    """The nested record of a run, written as JSON and read back."""
    responses = given.scored(spark, folder)
    record = accounting.run_record(responses, "service", "v2", "m", USD_PER_MILLION)
    path = new_path(spark, "run-record")
    write_records(record, path)
    return read_records(spark, path, record.schema).select(
        "method",
        F.array_join("response_models", ",").alias("response_models"),
        "test_examples",
        short(F.col("latency_ms.mean")).alias("mean"),
        short(F.col("latency_ms.p95")).alias("p95"),
        F.col("usage.input_tokens").alias("input_tokens"),
        short(F.col("pricing.estimated_input_cost_usd"), 9).alias("cost"),
    )
