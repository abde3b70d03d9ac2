"""The registered queries of this package that SQL can express."""

import os

import duckdb
import pytest

from labelloom.llm.queries import QUERIES, SQL
from test_queries import canonical

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    tables = duckdb.connect()
    for file in os.listdir(FOLDER):
        tables.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    ours, theirs = QUERIES[name](spark, FOLDER).toPandas(), tables.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs) and len(ours) > 0
