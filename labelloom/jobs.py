"""The steps of a taxonomy-change study as jobs that read and write tables.

Each job reads tables, runs the checks that must hold, and writes its results
below a folder. Checks fail the job with the first violations in the message.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.names import row_id
from labelloom.operators import (
    accounting,
    calibration,
    checks,
    classifiers,
    evaluation,
    joins,
    runs,
    sampling,
    scoring,
    taxonomy,
)
from labelloom.operators.features import document_terms
from labelloom.session import stored
from labelloom.sources.runs import discover_runs
from labelloom.sources.tables import training_rows, write_adaptation_sets, write_csv, write_parquet, write_records
from labelloom.sources.taxonomy import mapping_table, queue_table


class CheckFailed(ValueError):
    """A check returned violations."""


def require_empty(violations: DataFrame, what: str) -> None:
    """Fail with a few examples if a violations table has rows."""
    found = violations.limit(5).collect()
    if found:
        raise CheckFailed(f"{what}: " + "; ".join(str(row.asDict()) for row in found))


def ground_truth(
    spark: SparkSession,
    raw: DataFrame,
    names: DataFrame,
    config: dict,
    folder: str,
    expected_queues: dict[str, int] | None = None,
    expected_intents: int | None = None,
    version: str | None = None,
    dataset: str | None = None,
) -> DataFrame:
    """Relabel a raw corpus (``split, position, text, label``) under both taxonomy versions.

    ``names`` (``label, intent``) decodes the class index. The taxonomy is checked
    against the intents of the corpus first, and its header against ``version`` and ``dataset`` if given. Returns the table written to ``folder``.
    """
    mapping = mapping_table(spark, config)
    intents = names.select("intent")
    named_as = {k: v if v is not None else config.get(k) for k, v in (("version", version), ("dataset", dataset))}
    header = checks.taxonomy_header_violations(config, **named_as)
    require_empty(
        checks.taxonomy_violations(
            queue_table(spark, config), mapping, intents, expected_queues, expected_intents, header
        ),
        "taxonomy",
    )
    named = taxonomy.named_classes(checks.require_columns(raw, "split", "position", "text", "label"), names)
    rows = named.select(row_id(F.col("split"), F.col("position")).alias("id"), "text", "intent", "split")
    write_parquet(taxonomy.relabelled(rows, mapping), folder)
    columns = "id string, text string, intent string, split string, v1_label string, v2_label string"
    labelled = spark.read.schema(columns).parquet(folder)
    require_empty(checks.count_violations(labelled, ["id", "text", "v1_label", "v2_label"]), "ground truth")
    require_empty(checks.duplicate_keys(labelled, "id"), "duplicate ids")
    return labelled


def experiment_data(
    spark: SparkSession,
    labelled: DataFrame,
    config: dict,
    folder: str,
    test_sizes: dict[str, int],
    budgets: Sequence[int],
    draws: int,
    seed: int = sampling.SEED,
) -> None:
    """Write the frozen test set, the reusable history and all draws of new labels.

    Folders: ``test_truth`` (labels, for evaluation only), ``test_inputs`` (id and
    text), ``history``, ``adaptation/draw=/budget=``.
    """
    train, test = (labelled.where(F.col("split") == split) for split in ("train", "test"))
    mapping = mapping_table(spark, config)
    affected = taxonomy.affected_queues(mapping)
    pool = taxonomy.candidates(train, mapping)
    require_empty(sampling.undersized_strata(test, "v2_label", test_sizes), "test strata")
    supply = taxonomy.candidate_supply(pool, affected, max(budgets))
    require_empty(supply.where(~F.col("enough")), "candidates")
    require_empty(checks.ambiguous_clean_queues(train, mapping), "clean queues")

    sample = sampling.frozen_sample(test, "v2_label", test_sizes, seed)
    write_parquet(sample, f"{folder}/test_truth")
    frozen = spark.read.schema(labelled.schema).parquet(f"{folder}/test_truth")
    write_parquet(taxonomy.model_view(sampling.shuffled(frozen, seed)), f"{folder}/test_inputs")
    write_parquet(taxonomy.reusable_history(train, mapping), f"{folder}/history")

    sets = sampling.adaptation_sets(pool, budgets, draws, affected.count(), seed=seed)
    write_adaptation_sets(sets, f"{folder}/adaptation")
    written = spark.read.schema(sets.schema).parquet(f"{folder}/adaptation")
    require_empty(sampling.budget_violations(written, affected, budgets, draws), "budgets")
    ordered = sorted(budgets)
    for small, large in zip(ordered, ordered[1:]):
        require_empty(sampling.nesting_violations(written, small, large), "nested draws")


def evaluate(
    truth: DataFrame, predictions: DataFrame, label: str, name: str, folder: str
) -> DataFrame:
    """Write metrics, class report and confusion matrix of one prediction table.

    Truth and predictions meet only here, one to one. One pass over them yields
    the counts from which all three results come.
    """
    checks.require_columns(predictions, "id", "prediction")
    outcomes = joins.aligned(truth.select("id", label), predictions.select("id", "prediction"))
    counts = stored(evaluation.confusion_counts(outcomes, label), "confusion")
    metrics = evaluation.run_metrics(counts, label).select(F.lit(name).alias("model"), "*")
    write_records(metrics, f"{folder}/metrics/run={name}")
    write_csv(evaluation.full_report(counts), f"{folder}/{name}_per_class")
    write_csv(evaluation.confusion_matrix(counts), f"{folder}/{name}_confusion")
    return metrics


def fit_predict_record(
    history: DataFrame,
    cell: DataFrame,
    test: DataFrame,
    model: str,
    budget: int,
    draw: int,
    folder: str,
    label: str = "v2_label",
) -> DataFrame:
    """Train the text classifier on history and one cell of new labels; write predictions and the record of the fit.

    Folders: ``predictions/model=/budget=/draw=`` (``id, prediction``) and ``records/run=``. Returns the record:
    training size, classes, new labels, vocabulary and iterations.
    """
    training = joins.unique_keys(training_rows(history, cell, label), "id")
    terms = stored(document_terms(training), "training-terms")
    fitted = classifiers.fit_text(terms, label, balanced=True)
    predictions = classifiers.predict_text(fitted, document_terms(taxonomy.model_view(test)))
    write_parquet(predictions, f"{folder}/predictions/model={model}/budget={budget}/draw={draw}")
    card = runs.run_cards(terms, [], label).select(
        F.lit(model).alias("model"),
        F.lit(budget).alias("budget"),
        F.lit(draw).alias("draw"),
        "*",
        F.lit(fitted.regression.features).alias("terms"),
        F.lit(fitted.regression.steps).alias("iterations"),
    )
    record = stored(card, "record")
    write_records(record, f"{folder}/records/run={model}_b{budget}_d{draw:02d}")
    return record


def finish_zero_shot(
    results: DataFrame,
    inputs: DataFrame,
    order: str,
    method: str,
    task: str,
    requested_model: str,
    usd_per_million: float,
    folder: str,
) -> DataFrame:
    """Close a zero-shot run: requested ids only, the last response of each, then predictions and the run's record.

    ``order`` is the column that grows with time. A requested id without a response fails the job.
    Writes ``predictions`` (``id, prediction``), ``responses`` and ``record``; returns the record.
    """
    columns = ("id", "prediction", "latency_ms", "response_model", "input_tokens", "output_tokens")
    checks.require_columns(results, order, *columns)
    last = scoring.latest(joins.requested(results, inputs), ["id"], [order])
    kept = stored(last.select(*columns), "responses")
    require_empty(joins.pending(inputs.select("id"), kept, "id"), "inputs without a response")
    write_csv(kept.select("id", "prediction"), f"{folder}/predictions")
    write_parquet(kept, f"{folder}/responses")
    record = accounting.run_record(kept, method, task, requested_model, usd_per_million)
    write_records(record, f"{folder}/record")
    return record


def summarise_runs(
    spark: SparkSession, paths: str, names: DataFrame, grid: DataFrame, cost: DataFrame, folder: str
) -> DataFrame:
    """Collect metrics of all runs, report gaps in the grid, write summary and label efficiency.

    Duplicate runs fail the job; missing ones are returned.
    """
    found = stored(runs.with_display_name(discover_runs(spark, paths), names), "runs")
    gaps = runs.grid_gaps(grid, found)
    require_empty(gaps.where(F.col("kind") == "duplicate"), "duplicate runs")
    write_csv(found.orderBy(*runs.RUN), f"{folder}/per_draw")
    summary = runs.draw_summary(found).orderBy("model", "budget")
    write_csv(summary, f"{folder}/summary")
    write_records(summary, f"{folder}/summary_records")
    efficiency = runs.label_efficiency(summary, cost).orderBy("model_display", "budget")
    write_csv(efficiency, f"{folder}/label_efficiency")
    return gaps


def calibration_report(
    responses: DataFrame,
    truth: DataFrame,
    labels: Sequence[str],
    folder: str,
    label: str = "v2_label",
    expected_rows: int | None = None,
) -> DataFrame:
    """Write cases, reliability bins, confidence quantiles, review table and summary.

    Cases are stored once and feed all tables. Returns the one-row summary.
    """
    classes = truth.sparkSession.createDataFrame([(name,) for name in labels], "label string")
    outside = joins.labels_outside(responses, ["prediction"], classes).unionByName(
        joins.labels_outside(truth, [label], classes)
    )
    require_empty(outside, "labels outside the taxonomy")
    cases = stored(calibration.calibration_cases(responses, truth, labels, label), "cases")
    if expected_rows is not None:
        require_empty(checks.count_violations(cases, [], rows=expected_rows), "cases")
    totals = stored(calibration.bin_totals(cases, len(labels)), "bins")
    summary = calibration.calibration_summary(totals)
    write_csv(cases.drop("p", "raw_total", "true_probability"), f"{folder}/cases")
    write_csv(calibration.reliability_bins(totals).orderBy("bin"), f"{folder}/reliability_bins")
    write_csv(calibration.confidence_quantiles(cases).orderBy("quantile"), f"{folder}/confidence_quantiles")
    review = calibration.review_table(cases).orderBy("review_fraction")
    write_csv(review, f"{folder}/confidence_review")
    write_records(summary, f"{folder}/summary")
    return summary
