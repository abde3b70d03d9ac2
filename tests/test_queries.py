"""Every registered query with SQL must return what DuckDB returns on the same tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points

ADDED = set(entry_points.ADDED)
QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def tables(folder):
    connection = duckdb.connect()
    for file in os.listdir(folder):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{file}'")
    yield connection
    connection.close()


def canonical(frame: pd.DataFrame) -> list[str]:
    def text(value) -> str:
        if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
            return "NULL"
        if hasattr(value, "item"):
            value = value.item()
        return repr(round(value, 9) + 0.0) if isinstance(value, float) else str(value)

    rows = frame[sorted(frame.columns)].itertuples(index=False)
    return sorted("|".join(text(value) for value in row) for row in rows)


@pytest.mark.parametrize("name", sorted(set(SQL) - ADDED))
def test_query_equals_sql(spark, folder, tables, name):
    ours = QUERIES[name](spark, folder).toPandas()
    theirs = tables.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)
    assert len(ours) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - ADDED))
def test_query_returns_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark, folder):
    assert entry_points.entry(spark).count() == 6


def test_shared_results_arrive_in_files_of_bounded_size(spark, folder, monkeypatch):
    """A table of many parts arrives in more files, still in three batches a stream."""
    from labelloom.plans import texts

    batches, asked, streams, reader = [], [], texts.score_stream, texts.file_stream

    def counted(*given):
        query = streams(*given)
        query.awaitTermination()
        batches.append(len({progress["batchId"] for progress in query.recentProgress if progress["numInputRows"]}))
        return query

    monkeypatch.setattr(texts, "score_stream", counted)
    monkeypatch.setattr(texts, "file_stream", lambda *given, **rest: asked.append((given[1], rest)) or reader(*given, **rest))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        parts = spark.read.parquet(f"{folder}/documents.parquet").rdd.getNumPartitions()
        rows = QUERIES["shared_results"](spark, folder).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    files = len(spark.read.parquet(asked[0][0]).inputFiles())
    assert parts > 6 and files >= parts and asked[0][1] == {"files_per_batch": files // 3}
    assert batches == [3, 3, 3] and rows == 3 * spark.read.parquet(f"{folder}/documents.parquet").count()
