"""A whole study on the document table, from raw rows to summaries."""

import pytest
from pyspark.sql import functions as F

from labelloom import jobs
from labelloom.operators import experiments, runs, taxonomy
from labelloom.plans import inputs as given
from labelloom.session import new_path
from labelloom.sizing import dimension
from labelloom.sources.tables import read_adaptation_set
from labelloom.sources.taxonomy import mapping_table

CONFIG = {
    "v1": {q: {"description": q} for q in ("EN", "DE", "ROMANCE")},
    "v2": {q: {"description": q} for q in ("EN", "DE", "ES", "FR")},
    **given.DOCUMENT_TAXONOMY,
}


def raw_corpus(spark, folder):
    intents = sorted(CONFIG["mapping"])
    names = dimension(spark, list(enumerate(intents)), "label int, intent string")
    documents = given.documents(spark, folder)
    return documents.join(names, "intent").select("split", F.col("id").alias("position"), "text", "label"), names


def test_study(spark, folder):
    out = new_path(spark, "study")
    raw, names = raw_corpus(spark, folder)
    labelled = jobs.ground_truth(spark, raw, names, CONFIG, f"{out}/truth", {"v1": 3, "v2": 4}, 8)
    assert labelled.count() == raw.count()
    sizes = {"DE": 4, "EN": 8, "ES": 2, "FR": 3}
    jobs.experiment_data(spark, labelled, CONFIG, out, sizes, [2, 5], 2)

    truth = spark.read.schema(labelled.schema).parquet(f"{out}/test_truth")
    inputs = spark.read.parquet(f"{out}/test_inputs")
    history = spark.read.parquet(f"{out}/history")
    sets = spark.read.parquet(f"{out}/adaptation")
    assert inputs.columns == ["id", "text"] and inputs.count() == sum(sizes.values())
    assert history.columns == ["id", "text", "v1_label", "v2_label"]
    assert {r.v2_label for r in history.select("v2_label").distinct().collect()} == {"DE", "EN"}
    cell = read_adaptation_set(spark, f"{out}/adaptation", sets.schema, 1, 2)
    assert cell.count() == 4

    for budget in (2, 5):
        predictions = experiments.text_grid(history, sets, inputs, [budget], [1])
        for draw, answers in ((1, predictions.select("id", "prediction")),):
            metrics = jobs.evaluate(truth, answers, "v2_label", f"tfidf_lr_v2_b{budget}_d{draw:02d}", out)
            assert metrics.first().test_examples == sum(sizes.values())
    display = dimension(spark, [("tfidf_lr_v2", "TF-IDF")], "model string, model_display string")
    cost = taxonomy.new_labels(taxonomy.affected_queues(mapping_table(spark, CONFIG)), [2, 5])
    grid = runs.run_grid(spark, ["tfidf_lr_v2"], [2, 5], [1, 2])
    gaps = jobs.summarise_runs(spark, f"{out}/metrics/run=*", display, grid, cost, out)
    assert {(r.budget, r.draw, r.kind) for r in gaps.collect()} == {(2, 2, "missing"), (5, 2, "missing")}
    efficiency = spark.read.option("header", True).csv(f"{out}/label_efficiency").collect()
    assert [(r.budget, r.new_labels) for r in efficiency] == [("2", "4"), ("5", "10")]


def test_study_stops_on_a_broken_taxonomy(spark, folder):
    raw, names = raw_corpus(spark, folder)
    mapping = {k: v for k, v in CONFIG["mapping"].items() if k != "en_s"}
    with pytest.raises(jobs.CheckFailed, match="en_s"):
        jobs.ground_truth(spark, raw, names, {**CONFIG, "mapping": mapping}, new_path(spark, "truth"))


def test_study_stops_on_small_strata(spark, folder):
    labelled = taxonomy.relabelled(given.documents(spark, folder), mapping_table(spark, CONFIG))
    with pytest.raises(jobs.CheckFailed, match="test strata"):
        jobs.experiment_data(spark, labelled, CONFIG, new_path(spark, "x"), {"ES": 10_000}, [2], 1)


def test_calibration_report(spark, folder):
    out = new_path(spark, "calibration")
    answered, truth = given.chosen(spark, folder), given.truth(spark, folder)
    summary = jobs.calibration_report(answered, truth, given.LABELS, out, expected_rows=answered.count()).first()
    assert 0 < summary.ece <= summary.mce
    assert spark.read.option("header", True).csv(f"{out}/reliability_bins").count() == 10
    assert spark.read.option("header", True).csv(f"{out}/confidence_review").count() == 3
    with pytest.raises(jobs.CheckFailed, match="INVALID"):
        jobs.calibration_report(given.scored(spark, folder), truth, given.LABELS, out)
    with pytest.raises(jobs.CheckFailed, match="cases"):
        jobs.calibration_report(answered, truth, given.LABELS, out, expected_rows=1)


def test_fit_predict_record(spark, folder):
    labelled = taxonomy.relabelled(given.documents(spark, folder), mapping_table(spark, CONFIG)).where("length(text) < 2000")
    train, test = (labelled.where(F.col("split") == split) for split in ("train", "test"))
    history, cell = (train.where(F.col("v1_label") == v1) for v1 in ("EN", "ROMANCE"))
    out = new_path(spark, "fit")
    record = jobs.fit_predict_record(history, cell, test, "tfidf_lr_v2", 5, 1, out).first()
    assert (record.training_examples, record.new_labels) == (history.count() + cell.count(), cell.count())
    assert record.classes == 3 and record.terms > 0 and record.iterations > 0
    found = spark.read.parquet(f"{out}/predictions/model=tfidf_lr_v2/budget=5/draw=1")
    assert found.count() == test.count()
    with pytest.raises(Exception, match="duplicate key"):
        jobs.fit_predict_record(history, history, test, "tfidf_lr_v2", 5, 1, out)


def test_finish_zero_shot(spark, folder):
    results = given.scored(spark, folder).withColumn("seq", F.col("id"))
    again = results.where("id % 7 = 0").withColumns({"seq": F.col("seq") + 10**6, "prediction": F.lit("view")})
    inputs = results.select("id").where("id % 2 = 0")
    out = new_path(spark, "zero-shot")
    record = jobs.finish_zero_shot(results.unionByName(again), inputs, "seq", "service", "v2", "m", 0.5, out).first()
    assert record.test_examples == inputs.count() and record.response_models == ["m0"]
    last = {r.id: r.prediction for r in spark.read.parquet(f"{out}/responses").collect()}
    assert len(last) == inputs.count() and all(p == "view" for i, p in last.items() if i % 7 == 0)
    with pytest.raises(jobs.CheckFailed, match="without a response"):
        jobs.finish_zero_shot(results.where("id > 10"), inputs, "seq", "service", "v2", "m", 0.5, out)


def test_a_header_that_is_not_expected_stops_the_study(spark, folder):
    raw, names = raw_corpus(spark, folder)
    with pytest.raises(jobs.CheckFailed, match="is not 2.0"):
        jobs.ground_truth(spark, raw, names, CONFIG, new_path(spark, "truth"), version="2.0")
