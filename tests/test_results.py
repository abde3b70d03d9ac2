import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.operators import scoring
from labelloom.session import new_path
from labelloom.sources import results as module
from labelloom.sources.results import ResultsTable
from labelloom.streaming.incremental import file_stream, score_stream

COLUMNS = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.IntegerType())])


@pytest.fixture
def table(spark):
    return ResultsTable(spark, new_path(spark, "results"), COLUMNS)


def rows(spark, ids, n):
    return spark.createDataFrame([(i, n) for i in ids], COLUMNS)


def held(df):
    return sorted((r.id, r.n) for r in df.collect())


def test_an_empty_table_has_no_snapshot_and_no_rows(table):
    assert table.snapshot() == (0, []) and table.read().collect() == [] and table.unnamed_folders() == []
    assert not table.merge("g") and not table.merge("g", everything=True)


def test_a_writer_that_stops_before_its_commit_leaves_nothing_visible(spark, table):
    table.append(rows(spark, [1], 1), "g", "j", 1)
    lost = table.write(rows(spark, [1, 2], 99), "g", "j", 2)
    assert held(table.read()) == [(1, 1)] and table.unnamed_folders() == [lost.folder]
    table.append(rows(spark, [2], 2), "g", "j", 2)
    assert held(table.read()) == [(1, 1), (2, 2)] and table.unnamed_folders() == [lost.folder]


def test_a_repeated_run_replaces_its_rows(spark, table):
    for n in (1, 2):
        table.append(rows(spark, [1, 2], n), "g", "j", 1)
    table.append(rows(spark, [1], 3), "g", "other", 1)
    assert held(table.read()) == [(1, 2), (1, 3), (2, 2)]
    assert held(table.read("g", without_job="j")) == [(1, 3)]
    assert held(table.read("g", without_run=("other", 1))) == [(1, 2), (2, 2)]
    table.append(rows(spark, [], 0), "g", "j", 1)
    assert held(table.read()) == [(1, 3)]


def test_writers_at_once_all_commit(spark, table):
    parts = [table.write(rows(spark, [i], i), "g", f"j{i}", 1) for i in range(12)]
    with ThreadPoolExecutor(12) as pool:
        list(pool.map(table.add, parts))
    number, named = table.snapshot()
    assert number == 12 and {p.folder for p in named} == {p.folder for p in parts}
    assert held(table.read()) == [(i, i) for i in range(12)]


def test_levels_merge_to_the_last_row_of_each_job(spark, table):
    for run in range(1, 9):
        assert not table.merge("g")
        table.append(rows(spark, [0, run], run), "g", "a" if run < 8 else "b", run)
    table.append(rows(spark, [0], 50), "h", "a", 1)
    assert table.merge("g") and not table.merge("g")
    _, parts = table.snapshot()
    assert sorted((p.group, p.level, p.rows) for p in parts) == [("g", 1, 10), ("h", 0, 1)]
    assert held(table.read("g")) == [(0, 7), (0, 8), *[(i, i) for i in range(1, 9)]]
    assert held(table.read("g", without_job="b")) == [(0, 7), *[(i, i) for i in range(1, 8)]]
    # A run repeated after its rows were merged: of equal runs the attempt that saw more counts.
    table.append(rows(spark, [3], 33), "g", "a", 3)
    last = module.last_rows(table.read("g"), ["id", "job"], ["run", "seen"])
    assert (3, 33) in held(last) and (3, 3) not in held(last)


def test_merging_gives_way_to_a_change_of_its_parts(spark, table, monkeypatch):
    for run in (1, 2):
        table.append(rows(spark, [run], run), "g", "a", run)
    commit = ResultsTable.commit

    def late(self, change):
        monkeypatch.setattr(ResultsTable, "commit", commit)
        self.append(rows(spark, [1], 11), "g", "a", 1)
        return commit(self, change)

    monkeypatch.setattr(ResultsTable, "commit", late)
    assert not table.merge("g", everything=True)
    assert held(table.read()) == [(1, 11), (2, 2)]
    # Rows that others add meanwhile stay.
    monkeypatch.setattr(ResultsTable, "commit", lambda self, change: (monkeypatch.setattr(ResultsTable, "commit", commit), self.append(rows(spark, [9], 9), "g", "b", 1), commit(self, change))[2])
    assert table.merge("g", everything=True)
    assert held(table.read()) == [(1, 11), (2, 2), (9, 9)]


def test_merged_rows_are_read_by_the_buckets_of_the_asked_keys(spark, table, monkeypatch):
    monkeypatch.setattr(module, "BUCKET_ROWS", 50)
    for run in range(8):
        table.append(rows(spark, range(run * 100, run * 100 + 100), run), "g", "a", run)
    assert table.merge("g")
    assert table.snapshot()[1][0].buckets == 17
    asked = spark.createDataFrame([(5,), (705,), (9999,)], "id int")
    some = table.read("g", asked=asked)
    assert len(some.inputFiles()) == 17 and held(some.join(asked.withColumn("id", F.col("id").cast("long")), "id")) == [(5, 0), (705, 7)]
    assert some.count() < 200
    assert held(table.read("g", asked=asked.limit(0))) == []


def answers(df):
    return scoring.answers_of(df, lambda: lambda texts: [t.upper() for t in texts]).select("id", F.col("raw_output").alias("prediction"))


def test_a_stream_never_reads_its_own_history(spark, monkeypatch):
    """Fifteen batches, one replayed after its results were committed, one id that comes twice."""
    arriving, path, checkpoint = (new_path(spark, n) for n in ("arriving", "results", "checkpoint"))
    reads = []
    read = ResultsTable.read
    monkeypatch.setattr(ResultsTable, "read", lambda self, *a, **k: reads.append(k) or read(self, *a, **k))
    schema = answers(spark.createDataFrame([], "id int, text string")).schema

    def run():
        stream = file_stream(spark, arriving, "id int, text string", files_per_batch=1)
        score_stream(stream, answers, path, checkpoint, "s", "1", schema).awaitTermination()

    for i in range(14):
        spark.createDataFrame([(i, f"t{i}"), (100 + i, "x")], "id int, text string").coalesce(1).write.mode("append").parquet(arriving)
    run()
    assert all("asked" not in k for k in reads)
    for name in ("13", ".13.crc"):
        os.remove(f"{checkpoint.removeprefix('file:')}/commits/{name}")
    spark.createDataFrame([(3, "again"), (50, "new")], "id int, text string").coalesce(1).write.mode("append").parquet(arriving)
    run()
    found = scoring.latest(scoring.read_results(spark, path, scoring.result_schema(schema)), scoring.KEYS, scoring.ORDER)
    expected = {**{i: f"T{i}" for i in range(14)}, **{100 + i: "X" for i in range(14)}, 50: "NEW"}
    assert {r.id: r.prediction for r in found.collect()} == expected and found.count() == 29
    # A second stream skips what the first one scored, and looks for that by the ids of its batch.
    reads.clear()
    spark.createDataFrame([(60, "more")], "id int, text string").coalesce(1).write.mode("append").parquet(arriving)
    stream = file_stream(spark, arriving, "id int, text string")
    score_stream(stream, answers, path, new_path(spark, "checkpoint"), "s", "1", schema).awaitTermination()
    assert any("asked" in k for k in reads)
    rows = scoring.read_results(spark, path, scoring.result_schema(schema))
    assert rows.select("id").distinct().count() == 30 and rows.where("id = 60").count() == 1
    assert rows.groupBy("job").agg(F.count_distinct("id").alias("n")).where("n = 1").count() == 1
