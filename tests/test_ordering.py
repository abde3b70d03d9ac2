import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import calibration, ordering, sampling

WIDE = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}


@pytest.fixture
def many_tasks(spark):
    """Keep small inputs in many tasks, as large ones are."""
    before = {key: spark.conf.get(key) for key in WIDE}
    for key, value in WIDE.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_prefix_sums_of_groups_in_many_tasks_and_batches(spark, many_tasks):
    """A null group, one group with most rows, and batches shorter than a group."""
    draw = np.random.default_rng(2)
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 20}", int(v), i, float(i % 5)) for i, v in enumerate(draw.integers(0, 9, 3000))]
    df = spark.createDataFrame(rows, "g string, v int, id int, x double").withColumn("one", F.lit(1).cast("long"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = ordering.prefix_sums(df, ["g"], ["v", "id"], {"place": "one", "so_far": "x"}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 3000
    for group in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == group), key=lambda r: (r[1], r[2]))
        sums = np.cumsum([r[3] for r in mine]).tolist()
        theirs = sorted((r for r in found if r.g == group), key=lambda r: r.place)
        assert [(r.id, r.place, r.so_far) for r in theirs] == [(r[2], i + 1, sums[i]) for i, r in enumerate(mine)]
        assert {(r.place_total, r.so_far_total) for r in theirs} == {(len(mine), sums[-1])}


def test_prefix_sums_of_nothing(spark):
    empty = spark.createDataFrame([], "id int, one long")
    assert ordering.prefix_sums(empty, [], ["id"], {"n": "one"}).collect() == []
    cases = spark.createDataFrame([], "id int, api_confidence double, correct int")
    assert calibration.review_table(cases).collect() == [] and calibration.risk_coverage(cases).collect() == []
    assert calibration.lowest_confidence(cases, 0.2).collect() == []
    assert calibration.confidence_quantiles(cases).collect() == []


@pytest.mark.parametrize("margin", [0.0, 0.004, 5.0])
def test_quantiles_are_exact_whatever_the_bounds(spark, monkeypatch, margin):
    """Without a margin most ranks fall outside the bounds at first and are sought again."""
    monkeypatch.setattr(ordering, "SKETCH_SIZE", 8)
    draw = np.random.default_rng(9)
    groups = {"a": draw.lognormal(0, 2, 4000), "b": np.repeat([1.0, 2.0, 5.0], 700), None: draw.normal(size=301), "one": np.array([3.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("void", None), ("a", None), ("a", float("nan"))]
    table = spark.createDataFrame(rows, "g string, v double").repartition(6)
    fractions = [0.0, 0.003, 0.25, 0.5, 0.95, 1.0]
    found = {r.g: r.quantiles for r in ordering.exact_quantiles(table, "v", fractions, ["g"], margin or 1e-9).collect()}
    assert set(found) == set(groups)
    for group, values in groups.items():
        assert found[group] == pytest.approx(np.quantile(values, fractions).tolist())
    everything = np.concatenate(list(groups.values()))
    alone = ordering.exact_quantiles(table, "v", fractions, margin=margin or 1e-9).first().quantiles
    assert alone == pytest.approx(np.quantile(everything, fractions).tolist())


def test_quantiles_read_the_column_twice(spark, tmp_path):
    """Rows read by all scans, with several groups and fractions."""
    spark.range(20_000).select((F.col("id") % 7).alias("g"), F.rand(3).alias("v")).write.parquet(str(tmp_path / "t"))
    table = spark.read.schema("g long, v double").parquet(str(tmp_path / "t"))
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    ordering.exact_quantiles(table.mapInArrow(count, table.schema), "v", [0.1, 0.5, 0.9], ["g"]).collect()
    assert reads.value == 40_000


def test_groups_are_reviewed_each_for_itself(spark, many_tasks):
    draw = np.random.default_rng(4)
    rows = [
        (["a", "b", None][i % 3], i, float(c), int(draw.random() < 0.4 + 0.5 * c))
        for i, c in enumerate(np.where(draw.random(900) < 0.3, 0.5, draw.integers(0, 12, 900) / 12))
    ]
    cases = spark.createDataFrame(rows, "g string, id int, api_confidence double, correct int")
    table = {(r.g, r.review_fraction): r for r in calibration.review_table(cases, [0.1, 0.25, 1.0], ["g"]).collect()}
    chosen = {(r.g, r.id) for r in calibration.lowest_confidence(cases, 0.25, ["g"]).collect()}
    assert len(table) == 9
    for group in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == group), key=lambda r: (r[2], r[1]))
        alone = cases.where(F.col("g").eqNullSafe(F.lit(group))).drop("g")
        for row in calibration.review_table(alone, [0.1, 0.25, 1.0]).collect():
            assert row.asDict() == {k: v for k, v in table[group, row.review_fraction].asDict().items() if k != "g"}
            part = mine[: row.reviewed_cases]
            assert row.errors_caught == sum(1 - r[3] for r in part) and row.max_confidence_reviewed == part[-1][2]
        assert {i for g, i in chosen if g == group} == {r[1] for r in mine[: -(-len(mine) // 4)]}


def test_no_task_sees_a_class_of_a_large_sample(spark, many_tasks, tmp_path):
    """Half of a class that holds a third of all rows, ranked in many tasks."""
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 40)).alias("label"))
    sizes = {"hot": 10_000, "c1": 500, "c2": 900}
    allocation = sampling.allocation_table(spark, sizes)
    path = str(tmp_path / "ranked")
    sampling.sample_keys(rows, "label", allocation).withColumn("task", F.spark_partition_id()).write.parquet(path)
    found = spark.read.parquet(path)
    assert {r.label: r["count"] for r in found.groupBy("label").count().collect()} == sizes
    assert found.groupBy("label").agg(F.max("rank").alias("m"), F.count_distinct("rank").alias("n")).where("m <> n").isEmpty()
    most = found.groupBy("task").count().agg(F.max("count")).first()[0]
    assert most < 2000
