import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelloom.functions import binning, names, probabilities, text
from labelloom.functions.vectors import unit_vector
from labelloom.operators.features import document_terms, postings

LABELS = ["CARD_MANAGEMENT", "CASH_WITHDRAWAL", "TRANSFERS", "CURRENCY"]
ANSWERS = [
    (" transfers. ", "TRANSFERS"),
    ("Class: TRANSFERS", "TRANSFERS"),
    ("TRANSFERS or CURRENCY", "INVALID"),
    ("X_TRANSFERS", "INVALID"),
    ("TRANSFERS1", "TRANSFERS"),
    ("TRANSFERS TRANSFERS", "TRANSFERS"),
    ("", "INVALID"),
    ("**cash_withdrawal**", "CASH_WITHDRAWAL"),
    ("CASH WITHDRAWAL", "INVALID"),
    ("\n\tcurrency\n", "CURRENCY"),
]


def test_parsed_answer(spark):
    rows = spark.createDataFrame(ANSWERS, "answer string, expected string")
    found = rows.select("expected", text.parsed_answer(F.col("answer"), LABELS).alias("p")).collect()
    assert [r.p for r in found] == [r.expected for r in found]


def test_edges_are_the_exact_doubles():
    assert binning.unit_edges(10) == [
        0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0,
    ]


def test_fixed_bin_on_edges(spark):
    values = [0.0, 0.1, 0.3, 0.30000000000000004, 0.6, 0.6000000000000001, 0.7, 0.99, 1.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    bins = [r.b for r in rows.select("v", binning.fixed_bin(F.col("v"), binning.unit_edges(10)).alias("b")).collect()]
    assert bins == [1, 2, 3, 4, 6, 7, 7, 10, 10]


def test_terms_equal_a_counter(spark):
    texts = {
        1: "The the THE cat, a cat_2 x Ünïcode ünïcode",
        2: "",
        3: "one",
        4: "a b c",
        5: None,
        6: "tie tie tie tie",
    }
    docs = spark.createDataFrame(list(texts.items()), "id int, text string")
    found = {}
    for row in postings(document_terms(docs)).collect():
        found.setdefault(row.id, {})[row.term] = row.tf
    for key, value in texts.items():
        words = re.findall(r"\w\w+", (value or "").lower())
        expected = Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:]))
        assert found.get(key, {}) == dict(expected)


def test_long_text_is_counted_whole(spark):
    docs = spark.createDataFrame([(1, "alpha beta " * 20_000)], "id int, text string")
    counts = {r.term: r.tf for r in postings(document_terms(docs)).collect()}
    assert counts == {"alpha": 20_000, "beta": 20_000, "alpha beta": 20_000, "beta alpha": 19_999}


def test_normalised_rejects_non_positive_sum(spark):
    rows = spark.createDataFrame([([0.0, 0.0],)], "p array<double>")
    total = probabilities.array_total(F.col("p"), 2)
    with pytest.raises(Exception, match="non-positive"):
        rows.select(probabilities.normalised(F.col("p"), total)).collect()


def test_missing_class_counts_zero(spark):
    rows = spark.createDataFrame([('{"a": 0.25, "c": 0.5}',)], "j string")
    for parsed in (
        probabilities.labelled_probabilities(F.col("j"), ["a", "b", "c"]),
        probabilities.probability_map(F.col("j")),
    ):
        array = rows.withColumn("m", parsed).select(
            probabilities.probability_array(F.col("m"), ["a", "b", "c"]).alias("p")
        )
        assert array.first().p == [0.25, 0.0, 0.5]


def test_unit_vector(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in rows.select(unit_vector(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_run_paths(spark):
    paths = [
        ("/m/tfidf_lr_v2_b20_d01.json", ("tfidf_lr_v2", 20, 1)),
        ("/m/run=embedding_lr_v2_b100_d05/part-0-x.json", ("embedding_lr_v2", 100, 5)),
        ("/m/summary.json", None),
        ("/m/tfidf_lr_v2_b20_d01.json.bak", None),
    ]
    rows = spark.createDataFrame([(p,) for p, _ in paths], "path string")
    fields = names.run_fields(F.col("path"))
    found = rows.select(names.is_run_path(F.col("path")).alias("ok"), *[c.alias(n) for n, c in fields.items()])
    for row, (_, expected) in zip(found.collect(), paths):
        assert row.ok == (expected is not None)
        if expected:
            assert (row.model, row.budget, row.draw) == expected


def test_ratio_of_zero(spark):
    row = spark.range(1).select(probabilities.ratio(F.lit(3), F.lit(0)).alias("r")).first()
    assert row.r == 0.0 and not math.isnan(row.r)
