"""Table files. Schemas are always given, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from labelloom.session import new_path
from labelloom.sources.csv_records import records

# Quotes inside a field are doubled, fields may span lines and keep their outer blanks. Null is a lone
# control character (U+001A) and an empty string is quoted, so that both come back as they were.
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "nullValue": "\x1a",
}


def read_parquet(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share of a stored table that has fewer files than there are cores.

    For costly work per row on small inputs. Only the list of files is asked for, so nothing
    runs; a table of more files, or one that is no plain scan, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    return df.repartition(cores, *keys) if 0 < files < cores else df


def keyed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Write a table in buckets of its key, each in order and in one file, and read it back.

    Tables with the same number of buckets meet by this key, and are grouped by it, without a shuffle, as often as
    that happens. Files lie in the shared folder; the catalog of the session knows the table under a name of its own.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    table = f"{name.replace('-', '_')}_{path[-32:]}"
    written = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    written.option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def read_splits(spark: SparkSession, paths: dict[str, str], schema: str | T.StructType) -> DataFrame:
    """Several splits as one table with a ``split`` column."""
    parts = [
        read_parquet(spark, path, schema).withColumn("split", F.lit(split)) for split, path in paths.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A table from CSV files with a header; a large file is read by many tasks, though fields may span lines."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    options = {**CSV_OPTIONS, "header": False, "multiLine": True, "mode": "PERMISSIVE"}
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in wanted)
    parsed = records(spark, path).where("NOT header").select(F.from_csv("text", columns, _strings(options)).alias("r"))
    return parsed.select("r.*")


def _strings(options: dict) -> dict[str, str]:
    return {key: str(value).lower() if isinstance(value, bool) else value for key, value in options.items()}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_records(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """JSON, one record per row; nested structs and arrays stay nested."""
    df.write.mode(mode).partitionBy(*partition_by).json(path)


def read_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_adaptation_sets(sets: DataFrame, path: str) -> None:
    """All draws and budgets in one job, one folder per cell.

    Rows of a cell are brought together first, so a cell does not scatter into
    one small file per task; cells are bounded by budget times classes.
    """
    sets.repartition("draw", "budget").write.mode("overwrite").partitionBy("draw", "budget").parquet(path)


def read_adaptation_set(
    spark: SparkSession, path: str, schema: str | T.StructType, draw: int, budget: int
) -> DataFrame:
    """One cell; partition pruning opens its folder only."""
    cells = spark.read.schema(schema).parquet(path)
    return cells.where((F.col("draw") == draw) & (F.col("budget") == budget))


def training_rows(history: DataFrame, adaptation: DataFrame, label: str = "v2_label") -> DataFrame:
    """Reusable history plus newly labelled rows, as ``id, text, label, is_new``."""
    columns = ("id", "text", label)
    old = history.select(*columns, F.lit(False).alias("is_new"))
    return old.unionByName(adaptation.select(*columns, F.lit(True).alias("is_new")))
