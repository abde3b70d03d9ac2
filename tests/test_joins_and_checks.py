import pytest
from pyspark.sql import functions as F

from labelloom.operators import checks, evaluation, joins, taxonomy
from labelloom.session import new_path
from labelloom.sources.tables import read_csv, write_csv
from labelloom.sources.taxonomy import class_definitions, mapping_from_table, mapping_table, queue_table

TRUTH = [(1, "A"), (2, "B"), (3, "A")]


def truth(spark):
    return spark.createDataFrame(TRUTH, "id int, v2_label string")


def predictions(spark, rows):
    return spark.createDataFrame(rows, "id int, prediction string")


def test_aligned(spark):
    rows = joins.aligned(truth(spark), predictions(spark, [(1, "A"), (2, "A"), (3, "INVALID")])).collect()
    assert sorted((r.id, r.v2_label, r.prediction) for r in rows) == [(1, "A", "A"), (2, "B", "A"), (3, "A", "INVALID")]


@pytest.mark.parametrize(
    "rows, message",
    [
        ([(1, "A"), (2, "A")], "no prediction for id 3"),
        ([(1, "A"), (2, "A"), (3, "B"), (4, "B")], "unknown id 4"),
        ([(1, "A"), (2, "A"), (3, "B"), (3, "B")], "duplicate key"),
    ],
)
def test_aligned_fails_loudly(spark, rows, message):
    with pytest.raises(Exception, match=message):
        joins.aligned(truth(spark), predictions(spark, rows)).collect()


def test_repeated_bare_keys_fail(spark):
    assert joins.one_row_per_key(truth(spark).select("id"), "id").count() == 3
    twice = truth(spark).select("id").unionAll(truth(spark).select("id"))
    with pytest.raises(Exception, match="duplicate key"):
        joins.one_row_per_key(twice, "id").count()


def test_invalid_prediction_lowers_macro_f1_but_has_no_matrix_column(spark):
    outcomes = joins.aligned(truth(spark), predictions(spark, [(1, "A"), (2, "B"), (3, "INVALID")]))
    counts = evaluation.confusion_counts(outcomes, "v2_label")
    score = evaluation.macro_f1(evaluation.class_report(counts)).first().macro_f1
    assert score == pytest.approx((2 / 3 + 1 + 0) / 3)
    cells = {(r.actual, r.predicted): r.n for r in evaluation.confusion_matrix(counts).collect()}
    assert cells == {("A", "A"): 1, ("A", "B"): 0, ("B", "A"): 0, ("B", "B"): 1}


def test_class_limit(spark):
    from labelloom.sizing import class_array

    with pytest.raises(Exception, match="more than 2 classes"):
        spark.range(1).select(class_array(spark.range(9).withColumn("l", F.col("id").cast("string")), "l", 2)).collect()


CONFIG = {
    "version": "1.0",
    "dataset": "d",
    "v1": {"A": {"description": "a"}, "B": {"description": "b"}},
    "v2": {"A": {"description": "a"}, "C": {"description": "c"}, "D": {"description": "d"}},
    "mapping": {
        "x": {"v1": "A", "v2": "A", "change": "unchanged"},
        "y": {"v1": "B", "v2": "C", "change": "split"},
        "z": {"v1": "B", "v2": "D", "change": "move"},
        # Unchanged by itself, yet its queue is impure.
        "w": {"v1": "B", "v2": "B", "change": "unchanged"},
    },
}


def broken(**changes):
    return {**CONFIG, "v2": {**CONFIG["v2"], "B": {"description": "b"}}, **changes}


def rules(spark, config, intents=None):
    corpus = spark.createDataFrame([(i,) for i in intents or config["mapping"]], "intent string")
    table = checks.taxonomy_violations(
        queue_table(spark, config), mapping_table(spark, config), corpus, {"v1": 2, "v2": 4}, 4
    )
    return {(r.rule, r.key) for r in table.collect()}


def test_valid_taxonomy_has_no_violations(spark):
    assert rules(spark, broken()) == set()
    assert checks.taxonomy_header_violations(CONFIG, "1.0", "d") == []
    assert checks.taxonomy_header_violations(CONFIG, "2.0", "d") == [("version", "is not 2.0")]


def test_taxonomy_violations(spark):
    assert rules(spark, CONFIG) == {("queue", "w"), ("queue count", "v2")}
    blank = broken(v1={**CONFIG["v1"], "A": {"description": " "}})
    assert rules(spark, blank) == {("description", "v1.A")}
    wrong = broken(mapping={**CONFIG["mapping"], "x": {"v1": "A", "v2": "A", "change": "move"}})
    assert rules(spark, wrong) == {("change", "x")}
    odd = broken(mapping={**CONFIG["mapping"], "x": {"v1": "A", "v2": "A", "change": None}})
    assert rules(spark, odd) == {("change type", "x")}
    assert rules(spark, broken(), ["x", "y", "z", "new"]) == {("coverage", "new"), ("coverage", "w")}


def test_status_is_a_property_of_queues(spark):
    mapping = mapping_from_table(mapping_table(spark, CONFIG))
    status = {r.v1: (r.destinations, r.status) for r in taxonomy.queue_status(mapping).collect()}
    assert status == {"A": (["A"], "CLEAN"), "B": (["B", "C", "D"], "IMPURE")}
    assert {r.v2 for r in taxonomy.affected_queues(mapping).collect()} == {"B", "C", "D"}


def test_unmapped_intent_fails(spark):
    corpus = spark.createDataFrame([(1, "text", "nowhere")], "id int, text string, intent string")
    with pytest.raises(Exception, match="unmapped intent: nowhere"):
        taxonomy.relabelled(corpus, mapping_table(spark, CONFIG)).collect()


def test_views_hide_the_intent(spark):
    corpus = spark.createDataFrame([(1, "text", "x")], "id int, text string, intent string")
    labelled = taxonomy.relabelled(corpus, mapping_table(spark, CONFIG))
    assert taxonomy.model_view(labelled).columns == ["id", "text"]
    assert taxonomy.training_view(labelled).columns == ["id", "text", "v2_label"]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing columns: .'prediction'"):
        checks.require_columns(truth(spark), "id", "prediction")


def test_class_definitions():
    config = {"classes": {"A": {"description": " first \n"}, "B": {"description": "second"}}}
    assert class_definitions(config, 2) == [("A", "first"), ("B", "second")]
    with pytest.raises(ValueError, match="expected 9"):
        class_definitions(config, 9)


def test_repeated_keys_fail_in_wide_and_narrow_form(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, v string")
    for check in (joins.one_row_per_key, joins.unique_keys):
        with pytest.raises(Exception, match="duplicate key"):
            check(rows, "id").collect()
        assert check(rows.where("v <> 'c'"), "id").count() == 2


def test_csv_keeps_blanks_empty_texts_and_nulls(spark):
    rows = [(1, "  lead"), (2, "trail \t"), (3, ""), (4, "   "), (5, None), (6, 'a "quoted", line\nnext'), (7, "\\N")]
    path = new_path(spark, "csv")
    write_csv(spark.createDataFrame(rows, "id int, text string"), path)
    assert sorted(tuple(r) for r in read_csv(spark, path, "id int, text string").collect()) == rows
