"""Mixing sources to target weights along a curriculum that changes over training.

A source's target is its weighted share of the words to take, at most so many passes over it.
How fast a source is read over training follows its schedule, a piecewise linear weight over
the progress from 0 to 1. The integral of a schedule says how much of the target is demanded up
to a progress; inverting it gives each document, at its place in the source's order, the
progress at which it is first used, and the integrals of all sources together the number of
words before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import running_total, square_root_buckets, word_count
from labelloom.session import stored

WEIGHTS = (5, 2, 1)
# Sources that may be sent to every task, and parts of a source's rows where there are more.
MOST_SENT = 100_000
SALTS = 64
# Weights at equal steps of progress, for the sources in turn: early, steady, late.
SCHEDULES = ((3.0, 2.0, 1.0), (1.0, 1.0, 1.0), (1.0, 2.0, 3.0))


def demanded(schedule: Sequence[float]) -> list[float]:
    """Share of the target that is demanded up to each knot."""
    areas = [(a + b) / 2 for a, b in zip(schedule, schedule[1:])]
    return [sum(areas[:k]) / sum(areas) for k in range(len(schedule))]


def _segments(schedule: Sequence[float]) -> list[tuple[float, float, float, float]]:
    """Start, weight at the start, slope and demand before each segment; weights scaled to an integral of one."""
    step = 1 / (len(schedule) - 1)
    area = sum((a + b) / 2 for a, b in zip(schedule, schedule[1:])) * step
    return [
        (k * step, a / area, (b - a) / area / step, before)
        for k, (a, b, before) in enumerate(zip(schedule, schedule[1:], demanded(schedule)))
    ]


def progress_at(share: Column, schedule: Sequence[float]) -> Column:
    """The progress at which ``share`` of the target has been demanded."""
    found = None
    for start, weight, slope, before in reversed(_segments(schedule)):
        left = F.greatest(share - F.lit(before), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(weight * weight) + 2 * slope * left, F.lit(0.0)))
        here = F.lit(start) + F.when(left > 0, 2 * left / (F.lit(weight) + root)).otherwise(0.0)
        found = here if found is None else F.when(share < F.lit(past), here).otherwise(found)
        past = before
    return F.least(found, F.lit(1.0))


def demand_at(progress: Column, schedule: Sequence[float]) -> Column:
    """Share of the target that has been demanded at a progress."""
    found = None
    for start, weight, slope, before in reversed(_segments(schedule)):
        left = progress - F.lit(start)
        here = F.lit(before) + left * weight + left * left * (slope / 2)
        found = here if found is None else F.when(progress < F.lit(past), here).otherwise(found)
        past = start
    return found


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, passes: int = 2, schedules: int = 3
) -> DataFrame:
    """``source, source_index, source_size, target, schedule`` from ``source, source_size``, one row a source.

    Sources by code point, null last, take the weights in turn. A target that would exceed
    ``passes`` times its source stops there and the excess goes to the others by weight. The list of sources is a
    short table; only it is put in one order.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_index") % len(weights) + 1)
    everything = Window.partitionBy()
    listed = (
        sizes.withColumn("source_index", F.row_number().over(named) - 1)
        .withColumn("weight", weight)
        .withColumn("most", (passes * F.col("source_size")).cast("double"))
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(share)))
    )
    order = Window.orderBy(F.col("most") / F.col("weight"), "source_index")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("wanted") - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    filled = listed.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("most"))
    rest = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full"), F.col("most")).otherwise(F.least("most", rest * F.col("weight")))
    return filled.withColumn("target", F.round(target, 6)).select(
        "source", "source_index", "source_size", "target", (F.col("source_index") % schedules).alias("schedule")
    )


def sized(docs: DataFrame, keep_rows: bool = False) -> DataFrame:
    """``doc_id, source, size, key`` of each row, with the whole row as ``row`` if asked for."""
    doc_id = F.col("doc_id").cast("long")
    key = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    columns = [doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), key.alias("key")]
    return docs.select(*columns, *([F.struct("*").alias("row")] if keep_rows else []))


def mixed(
    rows: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.5,
    passes: int = 2,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    whole: bool = False,
) -> DataFrame:
    """Add ``source_size, target, taken, progress, position`` to what ``sized`` gives.

    A source's documents stand in the order of the md5 of their ids. The mix reads them in full passes and
    then as far as the target goes: it cuts the last document, or, with ``whole``, takes it if at least
    half of it fits. ``progress`` and ``position`` (words before it in training) say when a
    document is first used; both are null where nothing is taken. Null texts have no words and are
    never taken, a null source is a source of its own, repeated rows count each by itself, columns are
    carried along under ``row`` whatever their names, and no rows give no rows.
    """
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, passes, len(schedules))
    per_schedule = [F.sum(F.when(F.col("schedule") == j, F.col("target")).otherwise(0.0)).over(Window.partitionBy()) for j in range(len(schedules))]
    targets = targets.withColumns({f"words_{j}": total for j, total in enumerate(per_schedule)})
    joined = with_source(rows, stored(targets, "source-targets"))
    buckets = square_root_buckets(rows.count())
    placed = running_total(joined, "source_index", "key", {"before": "size"}, buckets, [F.col("doc_id"), F.col("size")])
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(passes))).otherwise(0)
    left = F.round(F.col("target") - F.col("full") * F.col("source_size")).cast("long")
    if whole:
        extra = F.when(2 * F.col("before") + F.col("size") <= 2 * F.col("left"), F.col("size")).otherwise(F.lit(0))
    else:
        extra = F.greatest(F.lit(0), F.least("size", F.col("left") - F.col("before")))
    taken = placed.withColumn("full", full).withColumn("left", left)
    taken = taken.withColumn("taken", (F.col("full") * F.col("size") + extra).cast("long"))
    start = F.col("before") / F.greatest(F.col("target"), F.lit(1.0))
    progress = F.when(F.col("taken") > 0, choose([progress_at(start, s) for s in schedules]))
    return (
        taken.withColumn("progress", progress)
        .withColumn("position", sum((F.col(f"words_{j}") * demand_at(F.col("progress"), s) for j, s in enumerate(schedules)), F.lit(0.0)))
        .drop("full", "left", "before", *[f"words_{j}" for j in range(len(schedules))])
    )


def with_source(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows with their source's columns. A list of sources beyond ``MOST_SENT`` is not broadcast: it is
    copied for each of ``SALTS`` parts of a source's rows, so that a large source meets it in many tasks."""
    named = targets.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if targets.count() <= MOST_SENT:
        return rows.join(F.broadcast(named), same).drop("_source")
    copies = named.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    parts = rows.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return parts.join(copies, same & (F.col("_salt") == F.col("_part"))).drop("_source", "_part", "_salt")


def choose(options: list[Column]) -> Column:
    found = options[-1]
    for j, option in reversed(list(enumerate(options[:-1]))):
        found = F.when(F.col("schedule") == j, option).otherwise(found)
    return found


def in_training_order(found: DataFrame) -> DataFrame:
    """Rows by position; those that are never used come first, spread by their key."""
    return found.repartitionByRange("position", "key").sortWithinPartitions("position", "key")


def digest(found: DataFrame) -> DataFrame:
    return in_training_order(found).select(
        "doc_id", "size", "source_size", "target", "taken", F.round("progress", 6).alias("progress")
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that the mix takes whole, as often as it takes them, in training order.

    Null, empty and wordless texts have nothing to take and go; a null source is a source of its own, null ids are ids
    like any other, equal rows count each by itself, columns stay as they are whatever their names, no rows give no rows.
    """
    found = mixed(sized(docs, keep_rows=True), whole=True, **settings).where("taken > 0")
    uses = F.explode(F.sequence(F.lit(0), F.floor(F.col("taken") / F.col("size")).cast("int") - 1))
    schedules = settings.get("schedules", SCHEDULES)
    used = found.withColumn("use", uses)
    first = choose([demand_at(F.col("progress"), s) for s in schedules]) * F.col("target")
    share = F.least((first + F.col("use") * F.col("source_size")) / F.col("target"), F.lit(1.0))
    used = used.withColumn("position", choose([progress_at(share, s) for s in schedules]))
    return in_training_order(used).select("row.*")


SQL = f"""
    WITH sized AS (
        SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
               CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size
        FROM documents),
    totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    listed AS (
        SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_index, 2.0::DOUBLE * source_size AS most,
               sum(source_size) OVER () * 1.5::DOUBLE AS wanted FROM totals),
    weighed AS (SELECT *, ([{", ".join(f"{w}::DOUBLE" for w in WEIGHTS)}])[source_index % {len(WEIGHTS)} + 1] AS weight FROM listed),
    levels AS (
        SELECT *, (wanted - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM weighed WINDOW o AS (ORDER BY most / weight, source_index)),
    filled AS (SELECT *, max(CASE WHEN level * weight < most THEN level END) OVER () AS rest FROM levels),
    targets AS (
        SELECT source, source_size, source_index % {len(SCHEDULES)} AS schedule,
               round(CASE WHEN level * weight >= most THEN most ELSE least(most, rest * weight) END, 6) AS target FROM filled),
    placed AS (
        SELECT doc_id, size, source_size, target, schedule,
               coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
               CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS passes
        FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
    taken AS (
        SELECT *, (passes * size + greatest(0, least(size, round(target - passes * source_size)::BIGINT - before)))::BIGINT AS taken,
               before / greatest(target, 1.0::DOUBLE) AS share FROM placed)
    SELECT doc_id, size, source_size, target, taken,
           CASE WHEN taken > 0 THEN round(CASE schedule
               WHEN 0 THEN CASE WHEN share < 0.625 THEN 2 * share / (1.5 + sqrt(2.25 - 2 * share))
                                ELSE 0.5 + 2 * (share - 0.625) / (1.0 + sqrt(1.0 - 2 * (share - 0.625))) END
               WHEN 1 THEN share
               ELSE CASE WHEN share < 0.375 THEN 2 * share / (0.5 + sqrt(0.25 + 2 * share))
                         ELSE 0.5 + 2 * (share - 0.375) / (1.0 + sqrt(1.0 + 2 * (share - 0.375))) END END, 6) END AS progress
    FROM taken"""
