import hashlib

import pytest
from pyspark.sql import functions as F

from labelloom.operators import accounting, sampling, taxonomy


def corpus(spark, rows=4000, partitions=7):
    """One class holds nearly all rows."""
    label = F.when(F.col("id") % 50 == 0, "rare").when(F.col("id") % 7 == 0, "some").otherwise("hot")
    return spark.range(rows).repartition(partitions).select(
        "id", F.concat(F.lit("t"), "id").alias("text"), label.alias("v2_label")
    )


def expected(rows, label, seed, size):
    chosen = sorted((hashlib.md5(f"{seed}:{r.id}".encode()).hexdigest(), r.id) for r in rows if r.v2_label == label)
    return {i for _, i in chosen[:size]}


def test_frozen_sample_equals_brute_force_and_ignores_partitioning(spark):
    sizes = {"hot": 200, "rare": 30, "some": 60}
    rows = corpus(spark).collect()
    wanted = set().union(*(expected(rows, c, sampling.SEED + i, n) for i, (c, n) in enumerate(sizes.items())))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for shuffle, partitions in (("3", 1), ("11", 13)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffle)
            sample = sampling.frozen_sample(corpus(spark, partitions=partitions), "v2_label", sizes)
            assert {r.id for r in sample.collect()} == wanted
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_draws_are_exact_nested_and_different(spark):
    sets = sampling.adaptation_sets(corpus(spark), [5, 40], 3, 3).cache()
    affected = spark.createDataFrame([("hot",), ("rare",), ("some",)], "v2 string")
    assert sampling.budget_violations(sets, affected, [5, 40], 3).isEmpty()
    assert sampling.nesting_violations(sets, 5, 40).isEmpty()
    draws = [{r.id for r in sets.where(f"draw = {d} AND budget = 40").collect()} for d in (1, 2, 3)]
    assert len(draws[0]) == 120 and len({frozenset(d) for d in draws}) == 3
    sets.unpersist()


def test_violations_are_reported(spark):
    sets = sampling.adaptation_sets(corpus(spark), [5, 40], 2, 3)
    affected = spark.createDataFrame([("hot",), ("rare",), ("some",)], "v2 string")
    damaged = sets.where(~((F.col("draw") == 1) & (F.col("budget") == 40) & (F.col("v2_label") == "rare")))
    found = sampling.budget_violations(damaged, affected, [5, 40], 2).collect()
    assert [(r.draw, r.budget, r.v2_label, r.rows) for r in found] == [(1, 40, "rare", 0)]
    assert sampling.nesting_violations(damaged, 5, 40).count() == 5


def test_small_strata(spark):
    found = sampling.undersized_strata(corpus(spark), "v2_label", {"hot": 10, "rare": 81, "none": 1}).collect()
    assert {(r.label, r.rows) for r in found} == {("rare", 80), ("none", 0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffle_is_reproducible(spark, seed):
    ids = [r.id for r in sampling.shuffled(corpus(spark, 200), seed).collect()]
    assert ids == sorted(range(200), key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def test_approximations_are_close(spark):
    rows = corpus(spark)
    exact = {r["column"]: r["values"] for r in taxonomy.distinct_counts(rows, "id", "v2_label").collect()}
    near = {r["column"]: r["values"] for r in taxonomy.distinct_counts(rows, "id", "v2_label", approximate=True).collect()}
    assert exact == {"id": 4000, "v2_label": 3}
    assert near["v2_label"] == 3 and abs(near["id"] - 4000) < 400
    exact_row = accounting.latency_summary(rows, ["v2_label"], "id").orderBy("v2_label").first()
    near_row = accounting.latency_summary(rows, ["v2_label"], "id", approximate=True).orderBy("v2_label").first()
    assert near_row.mean == exact_row.mean and abs(near_row.p95 - exact_row.p95) < 60


def test_sizes_follow_the_shares_with_a_floor(spark):
    rows = corpus(spark)
    counts = {r.v2_label: r["count"] for r in rows.groupBy("v2_label").count().collect()}
    sizes = sampling.proportional_sizes(rows, "v2_label", 0.1, 90)
    assert sizes == {c: min(n, max(90, -(-n // 10))) for c, n in counts.items()}


def test_groups_that_are_null_or_without_latency_keep_their_row(spark):
    rows = [("a", 1.0), ("a", 3.0), (None, 5.0), ("b", None)]
    found = accounting.latency_summary(spark.createDataFrame(rows, "g string, latency_ms double"), ["g"]).collect()
    assert {(r.g, r["mean"], r.p50) for r in found} == {("a", 2.0, 2.0), (None, 5.0, 5.0), ("b", None, None)}
