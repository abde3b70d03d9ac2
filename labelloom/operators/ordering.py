"""Exact ranks without a global sort in one task.

Quantiles take a sketch per group and a second pass over the values near the wanted ranks. Prefix sums take one
shuffle by ranges and an offset per task. Sketches and ranges steer the work and never the result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.operators.joins import same_groups
from labelloom.session import stored
from labelloom.sizing import MAX_DIMENSION_ROWS, broadcast_up_to, small_table

BUCKETS = 1000
RANKED_ROWS = 100_000
# A sketch of this size is, with 99 % confidence, within 0.2 % of the rows; bounds allow twice that.
SKETCH_SIZE = 2048
SKETCH_MARGIN = 0.004


def with_bucket(df: DataFrame, column: str) -> DataFrame:
    """Add ``_b``, a bucket number that never decreases as the numeric column grows.

    Reads the column once for its approximate quantiles (a bounded sketch).
    """
    shares = [i / BUCKETS for i in range(BUCKETS + 1)]
    edges = sorted(set(df.approxQuantile(column, shares, 1 / (2 * BUCKETS))))
    splits = [float("-inf"), *edges[1:], float("inf")]
    if len(splits) < 3:
        return df.withColumn("_b", F.lit(0))
    bucketizer = Bucketizer(splits=splits, inputCol=column, outputCol="_b", handleInvalid="keep")
    return bucketizer.transform(df).withColumn("_b", F.col("_b").cast("int"))


def _running(by: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


# -------------------------------------------------------------------- quantiles


def exact_quantiles(
    df: DataFrame, column: str, fractions: Sequence[float], by: Sequence[str] = (), margin: float = SKETCH_MARGIN
) -> DataFrame:
    """``by`` columns and ``quantiles``: linearly interpolated quantiles as an array.

    The column is read twice, whatever the number of groups and fractions. The first pass builds a KLL sketch per group;
    its estimates at ``margin`` below and above a fraction enclose the wanted ranks. The second pass counts, per group,
    the rows between these bounds and keeps apart only values inside them, so few rows are shuffled and fewer ranked. The
    counts prove that a rank lies within its bounds; groups where one does not, if any, are done again
    with wider ones. Nulls and NaN take no part, a group without values has no row.
    """
    values = df.select(*by, F.col(column).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    found = stored(_between_bounds(values, fractions, by, margin), "quantiles")
    incomplete = F.exists("quantiles", lambda q: q.isNull())
    missed = found.where(incomplete)
    if missed.isEmpty():
        return found
    again = same_groups(values, missed.select(*by), by, "left_semi") if by else values
    return found.where(~incomplete).unionByName(exact_quantiles(again, "_v", fractions, by, 8 * margin))


def _between_bounds(values: DataFrame, fractions: Sequence[float], by: Sequence[str], margin: float) -> DataFrame:
    sketch = F.kll_sketch_agg_double("_v", F.lit(SKETCH_SIZE))
    sketched = values.groupBy(*by).agg(sketch.alias("_s"), F.count(F.lit(1)).alias("_total")).where("_total > 0")

    def estimates(shares: list[float], outside: float) -> Column:
        inner = [min(max(share, 0.0), 1.0) for share in shares]
        near = F.kll_sketch_get_quantile_double("_s", F.array(*[F.lit(share) for share in inner]))
        return F.array(*[F.get(near, F.lit(i)) if 0 < s < 1 else F.lit(outside) for i, s in enumerate(shares)])

    bounds = sketched.select(
        *by,
        "_total",
        estimates([f - margin for f in fractions], float("-inf")).alias("_low"),
        estimates([f + margin for f in fractions], float("inf")).alias("_high"),
    )
    if by:
        bounded = same_groups(values, small_table(bounds, MAX_DIMENSION_ROWS), by)
    else:
        whole = bounds.first()
        if whole is None:
            return values.select(F.array(F.lit(None).cast("double")).alias("quantiles")).limit(0)
        bounded = values.withColumns(
            {"_total": F.lit(whole["_total"]), **{c: F.array(*[F.lit(x) for x in whole[c]]) for c in ("_low", "_high")}}
        )
    v, steps = F.col("_v"), range(len(fractions))
    low, high = [F.get("_low", F.lit(i)) for i in steps], [F.get("_high", F.lit(i)) for i in steps]
    # Never decreases as the value grows; all values of one stretch are inside the same bounds.
    stretch = reduce(add, [(v >= x).cast("int") for x in low] + [(v > x).cast("int") for x in high])
    inside = reduce(or_, [(v >= x) & (v <= y) for x, y in zip(low, high)])
    counted = bounded.groupBy(*by, "_total", stretch.alias("_part"), F.when(inside, v).alias("_w")).agg(F.count(F.lit(1)).alias("_n"))
    counted = stored(counted, "quantile-counts")
    # At most twice as many rows per group as there are fractions, and one.
    parts = counted.groupBy(*by, "_part").agg(F.sum("_n").alias("_n"))
    starts = parts.select(*by, "_part", (F.sum("_n").over(_running(by, "_part")) - F.col("_n")).alias("_start"))
    starts = small_table(starts, MAX_DIMENSION_ROWS)
    ranked = (
        same_groups(counted, starts, [*by, "_part"])
        .withColumn("_end", F.col("_start") + F.sum("_n").over(_running([*by, "_part"], "_w")))
        .withColumn("_first", F.col("_end") - F.col("_n"))
    )
    positions = [F.lit(f) * (F.col("_total") - 1) for f in fractions]

    def at(rank: Column) -> Column:
        return F.min(F.when((rank >= F.col("_first")) & (rank < F.col("_end")), F.col("_w")))

    ends = F.array(*[F.struct(at(F.floor(p)).alias("lo"), at(F.ceil(p)).alias("hi")) for p in positions])
    weights = F.array(*[p - F.floor(p) for p in positions])
    return (
        ranked.groupBy(*by, "_total")
        .agg(ends.alias("_ends"))
        .select(*by, F.zip_with("_ends", weights, lambda e, w: e["lo"] + (e["hi"] - e["lo"]) * w).alias("quantiles"))
    )


# ------------------------------------------------------------------ prefix sums


def prefix_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Add for each ``new: old`` the sum of ``old`` over the rows of the group up to this one, and ``new_total``.

    ``old`` columns are numbers without nulls (long or double); rows stand by ``order``, which should tell apart all rows of
    a group. The rows are shuffled once, by ranges of group and order, so that a large group, or many equal
    values, lie in many tasks; each task sums its own rows as they come, and one row per task and group gives the offsets.
    """
    schema = T.StructType(
        [*df.schema.fields, T.StructField("_task", T.IntegerType()), *[T.StructField(new, df.schema[old].dataType) for new, old in sums.items()]]
    )
    columns = df.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: dict[str, int | float] = dict.fromkeys(sums, 0)
        last: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = group_starts(batch, by, last)
            added = []
            for new, old in sums.items():
                values = batch.column(old).to_numpy(zero_copy_only=False)
                total = np.cumsum(values)
                # What stood before each group's first row; rows of the group that goes on get what was carried.
                before = np.zeros(len(values), dtype=total.dtype)
                before[starts] = total[starts] - values[starts]
                offset = np.maximum.accumulate(np.where(starts, np.arange(len(values)), -1))
                found = np.where(offset >= 0, total - before[np.maximum(offset, 0)], total + carried[new])
                carried[new] = found[-1]
                added.append(pa.array(found))
            last = batch.slice(batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*columns, "_task", *sums])

    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    local = stored(ranged.withColumn("_task", F.spark_partition_id()).mapInArrow(scan, schema), "prefix-sums")
    parts = stored(local.groupBy("_task", *by).agg(*[F.sum(old).alias(f"_{new}") for new, old in sums.items()]), "prefix-parts")
    before = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "_task",
        *by,
        *[F.coalesce(F.sum(f"_{new}").over(before), F.lit(0)).alias(f"_{new}") for new in sums],
        *[F.sum(f"_{new}").over(Window.partitionBy(*by)).alias(f"{new}_total") for new in sums],
    )
    offsets = broadcast_up_to(offsets, parts.count())
    return same_groups(local, offsets, ["_task", *by]).withColumns({new: F.col(new) + F.col(f"_{new}") for new in sums}).drop("_task", *[f"_{new}" for new in sums])


def group_starts(batch: pa.RecordBatch, by: Sequence[str], last: pa.RecordBatch | None) -> np.ndarray:
    """Whether each row begins a group, where ``last`` holds the row before the batch; nulls are a group."""
    differs = np.zeros(batch.num_rows, dtype=bool)
    for name in by:
        column = batch.column(name)
        before = pa.concat_arrays([column.slice(0, 1) if last is None else last.column(name), column.slice(0, batch.num_rows - 1)])
        unlike = pc.fill_null(pc.not_equal(column, before), False).to_numpy(zero_copy_only=False)
        absent = (pc.is_null(column).to_numpy(zero_copy_only=False), pc.is_null(before).to_numpy(zero_copy_only=False))
        differs |= unlike | (absent[0] != absent[1])
    return differs


def running_totals(df: DataFrame, order: str, sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """For every group and distinct value of a column, the sums over the group's rows up to it, and over all of them.

    Rows with equal values are folded first; then ``prefix_sums`` moves the folded rows once.
    """
    folded = df.where(F.col(order).isNotNull()).groupBy(*by, order).agg(*[total.alias(name) for name, total in sums.items()])
    found = prefix_sums(folded, by, [order], {f"{name}_up_to": name for name in sums})
    return found.withColumnsRenamed({f"{name}_up_to_total": f"{name}_total" for name in sums})


# ---------------------------------------------------------------- value at a rank


def _as_number(df: DataFrame, column: str) -> Column:
    """A number that never decreases as the column grows.

    For texts: the six bytes that follow the prefix shared by all of them.
    """
    if dict(df.dtypes)[column] != "string":
        return F.col(column).cast("double")
    ends = df.agg(F.min(column), F.max(column)).first()
    prefix = os.path.commonprefix([end.encode() for end in ends])
    following = F.substring(F.encode(column, "UTF-8"), len(prefix) + 1, 6)
    return F.conv(F.rpad(F.hex(following), 12, "0"), 16, 10).cast("double")


def value_at(df: DataFrame, column: str, rank: int, rows: int):
    """The value at a 1-based rank among ``rows`` rows, for numbers and texts.

    Narrows the rows to the bucket with the rank until few enough are left to
    be listed. Each round returns bucket counts only.
    """
    rest = df.select(column).where(F.col(column).isNotNull())
    while rows > RANKED_ROWS:
        bucketed = with_bucket(rest.withColumn("_number", _as_number(rest, column)), "_number")
        counts = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).orderBy("_b").collect()
        if len(counts) == 1:
            break
        for bucket in counts:
            if rank <= bucket["n"]:
                break
            rank -= bucket["n"]
        rest, rows = bucketed.where(F.col("_b") == bucket["_b"]).select(column), bucket["n"]
    # At most RANKED_ROWS rows, or so few values that their numbers coincide.
    for value, count in rest.groupBy(column).agg(F.count(F.lit(1))).orderBy(column).collect():
        if rank <= count:
            return value
        rank -= count
    raise ValueError("rank exceeds the number of rows")
