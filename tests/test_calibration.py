"""Ranking and calibration against brute force and published values."""

import json

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelloom.operators import calibration, ordering, runs

# A published reliability table (count, mean probability, accuracy)
# of 600 cases with its calibration errors.
PUBLISHED_BINS = [
    (3, 0.3633333333333333, 0.3333333333333333),
    (5, 0.45599999999999996, 0.4),
    (18, 0.5622222222222222, 0.5),
    (12, 0.6441666666666667, 0.75),
    (17, 0.7523529411764707, 0.6470588235294118),
    (46, 0.851916996047431, 0.717391304347826),
    (499, 0.9887350458492743, 0.9398797595190381),
]
PUBLISHED_ECE, PUBLISHED_MCE = 0.05852828282828279, 0.13452569169960493

# Published macro-F1 and accuracy of 20 runs, and their summary.
PUBLISHED_RUNS = {
    ("embedding_lr_v2", 20): [
        (0.863309895946782, 0.8633333333333333),
        (0.8260527172819613, 0.8266666666666667),
        (0.8336687677609881, 0.8366666666666667),
        (0.8628302383349518, 0.8566666666666667),
        (0.8439214096530032, 0.8416666666666667),
    ],
    ("embedding_lr_v2", 100): [
        (0.9171567184980268, 0.9166666666666666),
        (0.9123922822618208, 0.91),
        (0.9001844631102642, 0.8966666666666666),
        (0.8958448075932933, 0.895),
        (0.9071244262833648, 0.9016666666666666),
    ],
    ("tfidf_lr_v2", 20): [
        (0.7114230120853551, 0.7216666666666667),
        (0.6843893497902354, 0.6816666666666666),
        (0.674709468654001, 0.6766666666666666),
        (0.6798158194075817, 0.6833333333333333),
        (0.6548640353681754, 0.6583333333333333),
    ],
    ("tfidf_lr_v2", 100): [
        (0.8890955623086594, 0.8833333333333333),
        (0.9002779898892308, 0.9),
        (0.8836265266911401, 0.88),
        (0.8795089355567205, 0.8733333333333333),
        (0.879645663561202, 0.8816666666666667),
    ],
}
PUBLISHED_SUMMARY = {
    ("embedding_lr_v2", 20): (0.8459566057955372, 0.016860856435923097, 0.845, 0.014907119849998587),
    ("embedding_lr_v2", 100): (0.906540539549354, 0.008690302954108593, 0.904, 0.009174239296348597),
    ("tfidf_lr_v2", 20): (0.6810403370610697, 0.020378303023560366, 0.6843333333333333, 0.023112045921265135),
    ("tfidf_lr_v2", 100): (0.8864309356013905, 0.008669773044220319, 0.8836666666666666, 0.009888264649460908),
}


def cases_of(spark, rows, key="string"):
    return spark.createDataFrame(rows, f"id {key}, api_confidence double, correct int")


def test_published_calibration_errors(spark):
    rows = []
    for count, mean, share in PUBLISHED_BINS:
        right = round(count * share)
        for i in range(count):
            rows.append((f"{mean:.3f}-{i}", mean, int(i < right)))
    cases = cases_of(spark, rows).select(
        "id",
        "correct",
        "api_confidence",
        F.col("api_confidence").alias("selected_probability"),
        F.col("api_confidence").alias("selected_probability_raw"),
        F.col("api_confidence").alias("true_probability"),
        F.lit(1.0).alias("raw_total"),
        F.array(F.col("api_confidence"), 1 - F.col("api_confidence")).alias("p"),
    )
    totals = calibration.bin_totals(cases, 2)
    row = calibration.calibration_summary(totals).first()
    assert row.ece == pytest.approx(PUBLISHED_ECE, abs=1e-12)
    assert row.mce == pytest.approx(PUBLISHED_MCE, abs=1e-12)
    assert (row.examples, row.errors) == (600, 66)
    assert row.accuracy == pytest.approx(0.89)
    bins = {r.bin: r for r in calibration.reliability_bins(totals).collect()}
    assert [bins[i]["count"] for i in range(1, 11)] == [0, 0, 0, 3, 5, 18, 12, 17, 46, 499]
    assert bins[1].accuracy is None and bins[2].absolute_gap is None
    assert row.ece <= row.mce


def test_published_summary_over_draws(spark):
    rows = [
        (model, budget, draw, f1, acc)
        for (model, budget), values in PUBLISHED_RUNS.items()
        for draw, (f1, acc) in enumerate(values, 1)
    ]
    table = spark.createDataFrame(rows, "model string, budget int, draw int, macro_f1 double, accuracy double")
    for row in runs.draw_summary(table, ["model", "budget"]).collect():
        expected = PUBLISHED_SUMMARY[row.model, row.budget]
        found = (row.macro_f1_mean, row.macro_f1_std, row.accuracy_mean, row.accuracy_std)
        assert found == pytest.approx(expected, abs=1e-12)
        assert row.draws == 5


def test_single_draw_has_no_deviation(spark):
    table = spark.createDataFrame([("m", 20, 1, 0.5, 0.5)], "model string, budget int, draw int, macro_f1 double, accuracy double")
    assert runs.draw_summary(table, ["model"]).first().macro_f1_std is None


def brute_review(rows, fraction):
    ranked = sorted(rows, key=lambda r: (r[1], r[0]))
    count = int(np.ceil(len(rows) * fraction))
    part = ranked[:count]
    return count, sum(1 - r[2] for r in part), part


@pytest.mark.parametrize("levels", [1, 3, 40, 100_000])
@pytest.mark.parametrize("text_ids", [True, False])
def test_review_table_equals_brute_force(spark, levels, text_ids):
    generator = np.random.default_rng(levels)
    size = 700
    ids = generator.permutation(size * 3)[:size]
    confidence = generator.integers(0, levels, size) / levels
    rows = [
        (f"test_{i:05d}" if text_ids else int(i), float(c), int(generator.random() < 0.3 + 0.6 * c))
        for i, c in zip(ids, confidence)
    ]
    cases = cases_of(spark, rows, "string" if text_ids else "bigint")
    fractions = [0.1, 0.2, 0.3, 1.0]
    table = {r.review_fraction: r for r in calibration.review_table(cases, fractions).collect()}
    for fraction in fractions:
        count, caught, part = brute_review(rows, fraction)
        row = table[fraction]
        assert (row.reviewed_cases, row.errors_caught) == (count, caught)
        assert row.max_confidence_reviewed == part[-1][1]
        assert row.errors_caught_least <= caught <= row.errors_caught_most
    chosen = {r.id for r in calibration.lowest_confidence(cases, 0.2).collect()}
    assert chosen == {r[0] for r in brute_review(rows, 0.2)[2]}


def test_running_totals_equal_cumulative_sums(spark):
    generator = np.random.default_rng(3)
    values = np.concatenate([generator.lognormal(0, 3, 3000), np.full(1500, 7.5)])
    table = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    found = {r.v: r.n_up_to for r in ordering.running_totals(table, "v", {"n": F.count(F.lit(1))}).collect()}
    ordered = np.sort(values)
    assert found == {v: int(np.searchsorted(ordered, v, "right")) for v in set(values.tolist())}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6) | st.sampled_from([0.0, 0.5, 1.0]), min_size=1, max_size=60))
def test_exact_quantiles_equal_numpy(spark, values):
    table = spark.createDataFrame([(float(v),) for v in values], "v double")
    fractions = [0.0, 0.1, 0.5, 0.95, 1.0]
    found = ordering.exact_quantiles(table, "v", fractions).first().quantiles
    assert found == pytest.approx(np.quantile(values, fractions).tolist(), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("prefix", [None, "", "t", "tést_"])
def test_value_at_narrows_to_the_rank(spark, monkeypatch, prefix):
    """Two families of keys and one hot key that holds a third of the rows."""
    monkeypatch.setattr(ordering, "RANKED_ROWS", 20)
    numbers = [i * i for i in range(400)] + [77_777] * 300 + [2**60 + i for i in range(200)]
    keys = numbers if prefix is None else [f"{prefix}{'rain' if n % 3 else 'est'}_{n:07d}" for n in numbers]
    table = spark.createDataFrame([(k,) for k in keys], f"k {'bigint' if prefix is None else 'string'}")
    ordered = sorted(keys)
    for rank in (1, 2, 333, 450, 899, 900):
        assert ordering.value_at(table, "k", rank, len(keys)) == ordered[rank - 1]


def test_grouped_quantiles_with_one_hot_value(spark):
    generator = np.random.default_rng(5)
    groups = {"a": generator.lognormal(3, 1, 2000), "b": np.full(900, 4.0), "c": np.array([1.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    table = spark.createDataFrame(rows, "g string, v double")
    for row in ordering.exact_quantiles(table, "v", [0.5, 0.95], ["g"]).collect():
        assert row.quantiles == pytest.approx(np.quantile(groups[row.g], [0.5, 0.95]).tolist())


@pytest.mark.parametrize("values", [[0.2] * 5 + [0.4] * 2 + [1.0] * 13, [0.5] * 9, list(np.linspace(0, 1, 37) ** 2)])
def test_quantile_buckets_equal_pandas(spark, values):
    rows = [(i, float(c), 1) for i, c in enumerate(values)]
    table = calibration.confidence_quantiles(cases_of(spark, rows, "int")).orderBy("quantile").collect()
    if len(set(values)) == 1:
        assert [r["count"] for r in table] == [len(values)]
        return
    expected = pd.Series(pd.qcut(values, 10, labels=False, duplicates="drop")).value_counts().sort_index()
    assert [r["count"] for r in table] == expected.tolist()
    assert [r.quantile - 1 for r in table] == expected.index.tolist()


def test_probability_metrics_equal_numpy(spark):
    generator = np.random.default_rng(11)
    labels = ["A", "B", "C"]
    raw = generator.random((200, 3)) + 1e-3
    raw[::17, 1] = 0.0
    truth = generator.integers(0, 3, 200)
    p = raw / raw.sum(axis=1, keepdims=True)
    choice = p.argmax(axis=1)
    rows = [
        (i, labels[choice[i]], 0.5, json.dumps({k: v for k, v in zip(labels, raw[i].tolist()) if v}))
        for i in range(200)
    ]
    responses = spark.createDataFrame(rows, "id int, prediction string, confidence double, probabilities string")
    answers = spark.createDataFrame([(i, labels[t]) for i, t in enumerate(truth)], "id int, v2_label string")
    cases = calibration.calibration_cases(responses, answers, labels)
    row = calibration.calibration_summary(calibration.bin_totals(cases, 3)).first()
    hot = np.eye(3)[truth]
    assert row.multiclass_brier == pytest.approx(((p - hot) ** 2).sum(axis=1).mean())
    p_true = np.maximum(p[np.arange(200), truth], calibration.LOG_CLIP)
    assert row.log_loss == pytest.approx(-np.log(p_true).mean())
    selected = p[np.arange(200), choice]
    assert row.top_label_brier == pytest.approx(((selected - (choice == truth)) ** 2).mean())
    assert row.max_raw_sum_error == pytest.approx(np.abs(raw.sum(axis=1) - 1).max())
