"""Incremental scoring of files as they arrive."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from labelloom.operators.scoring import score_pending

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def file_stream(
    spark: SparkSession, path: str, schema: str | T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def score_stream(
    stream: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    results: str,
    checkpoint: str,
    scorer: str,
    class_version: str,
    schema: T.StructType | None = None,
) -> StreamingQuery:
    """Score each new file once and add the results to a table; stops when none is left.

    The ids that the stream has seen are keyed state of Spark, kept in RocksDB and saved as changes, so a batch
    looks up its own ids and never reads what the stream wrote before. Results of other jobs, such as an earlier stream
    with another checkpoint, are read where they may hold an id of the batch. Every batch is one
    commit under its number, so a batch replayed after a failure replaces its rows. ``score``
    must not depend on the batch (freeze the vocabulary), so that the stream
    ends with the same table as one batch job. Of rows with equal ids the first one counts.
    """

    job = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def batch(rows: DataFrame, number: int) -> None:
        score_pending(rows, score, results, scorer, class_version, run=number, job=job, schema=schema, own_history=False)

    writer = (
        stream.dropDuplicates(["id"])
        .writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    with _settings(stream.sparkSession, STATE):
        return writer.start()


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings that a query takes along when it starts, where the session has none of its own."""
    added = {key: value for key, value in wanted.items() if key not in spark.conf.getAll}
    for key, value in added.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in added:
            spark.conf.unset(key)
