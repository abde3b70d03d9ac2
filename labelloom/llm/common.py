"""Helpers shared by the operators of this package."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
LEARNING_FOLDS = 5


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of all ids that no model learns from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % LEARNING_FOLDS == 0, F.lit(True))


def unit_hash(*columns: str, salt: str = "") -> Column:
    """A number in [0, 1) that follows from the columns alone."""
    return (F.pmod(F.xxhash64(*[F.col(c) for c in columns], F.lit(salt)), F.lit(1 << 31)) / float(1 << 31)).cast("double")


def word_count(text: str = "text") -> Column:
    """Number of words between white space; zero for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def strings(column: pa.Array) -> list[bytes]:
    """Values of a string column as UTF-8 bytes, null as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def small_slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one slice hold about ``most`` bytes (one longer text stands alone)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def in_pieces(batches: Iterable[pa.RecordBatch], width: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece of rows with ``width`` numbers each holds about ``most`` numbers."""
    step = max(1, most // max(1, width))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def square_root_buckets(rows: int) -> int:
    """So many buckets that neither a bucket nor the list of buckets grows faster than the root of the rows."""
    return max(1, math.isqrt(rows))


def running_total(
    df: DataFrame, group: str, key: str, amounts: dict[str, str], buckets: int, ties: Iterable[Column] = ()
) -> DataFrame:
    """Add, for each ``new: old`` of ``amounts``, the sum of ``old`` over all earlier rows of the group.

    ``group`` is a column of whole numbers without nulls, ``key`` holds 32 hexadecimal
    digits of a hash, in whose order rows stand; ``ties`` order rows of one key. Rows are
    cut by their key into ``buckets``, which are summed before anything is shuffled, so
    that no task sees a whole group however large it is.
    """
    part = (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * buckets / float(1 << 32)).cast("long")
    cut = df.withColumn("_bucket", part)
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(group, "_bucket").agg(*[F.sum(old).alias(f"_{new}") for new, old in amounts.items()])
    offsets = sums.select(
        group, "_bucket", *[F.coalesce(F.sum(f"_{new}").over(before), F.lit(0)).alias(f"_{new}") for new in amounts]
    )
    inside = (
        Window.partitionBy(group, "_bucket").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        cut.join(offsets, [group, "_bucket"])
        .withColumns(
            {new: F.col(f"_{new}") + F.coalesce(F.sum(old).over(inside), F.lit(0)) for new, old in amounts.items()}
        )
        .drop("_bucket", *[f"_{new}" for new in amounts])
    )
