"""Metric records scattered over many files, identified by their path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.names import is_run_path, run_fields

METRICS = "macro_f1 double, accuracy double"


def discover_runs(spark: SparkSession, paths: str) -> DataFrame:
    """(model, budget, draw, macro_f1, accuracy, source_file) of all files whose path names a run.

    ``paths`` is a glob. Files of ``<model>_b<budget>_d<draw>.json`` and folders
    ``run=<the same>`` count; others are skipped. A file may hold one pretty-printed
    object, several, one per line, or an array of them; every record is a row, and
    a file that is no such JSON fails the job.
    """
    path = F.col("_metadata.file_path")
    fields = run_fields(path)
    # A line end inside a string is escaped in JSON, so objects part only between records.
    whole = F.regexp_replace(F.trim(F.col("value")), r"\}\s*\n\s*\{", "},{")
    listed = F.when(whole.startswith("["), whole).otherwise(F.concat(F.lit("["), whole, F.lit("]")))
    found = F.from_json(listed, f"array<struct<{METRICS.replace(' double', ': double')}>>", {"mode": "FAILFAST"})
    return (
        spark.read.text(paths, wholetext=True)
        .where(is_run_path(path))
        .select(*[column.alias(name) for name, column in fields.items()], path.alias("source_file"), F.inline(found))
        .select(*fields, "macro_f1", "accuracy", "source_file")
    )
