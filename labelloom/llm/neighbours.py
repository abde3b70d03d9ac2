"""Nearest neighbours by largest inner product, through cross-polytope hashing.

Vectors are scaled by the largest norm of their band and get one more coordinate that makes them
unit vectors, so that the largest inner product is the smallest angle. Three sign flips, each
followed by a fast Hadamard transform, rotate a vector; its bucket in a table is the signed axis nearest to it, or a
pair of axes where there are many rows. A query visits the buckets of its nearest axes in each
table, as many as a measured sample needs for the recall asked for, and every row it meets there is
ranked by the exact inner product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.session import stored
from labelloom.sizing import broadcast_if_small

TABLES = 2
ROTATIONS = 3
# Rows of a bucket on average, beyond which buckets are pairs of axes.
BUCKET_ROWS = 4096
# Rows of one group of buckets, and at most of one block of it: 16 MB of vectors of 64 components. A query answers
# with one list per group, so larger groups mean fewer rows to merge.
GROUP_ROWS = 32768
BLOCK_ROWS = 32768
QUERY_ROWS = 16384
# Inner products held at a time.
HELD = 1 << 22
RESULT = "query_id long, rank int, vec_id long, score double"
HITS = "query long, rep long, score double, ids array<long>"


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    n, width = rows.shape
    half = 1
    while half < width:
        pairs = rows.reshape(n, -1, 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return rows / math.sqrt(width)


class CrossPolytope:
    """Hash functions of all tables, the same wherever they are built."""

    def __init__(self, dimensions: int, axes: int, tables: int = TABLES, seed: int = 9):
        self.dimensions, self.axes, self.tables = dimensions, axes, tables
        self.width = 1 << dimensions.bit_length()
        draw = np.random.default_rng(seed)
        self.signs = draw.choice([-1.0, 1.0], size=(tables, axes, ROTATIONS, self.width))
        self.buckets = (2 * self.width) ** axes

    def rotated(self, rows: np.ndarray, table: int, axis: int) -> np.ndarray:
        """Similarity of each row to each signed axis after the table's rotation."""
        held = np.pad(rows, ((0, 0), (0, self.width - rows.shape[1])))
        for signs in self.signs[table, axis]:
            held = hadamard(held * signs)
        return np.concatenate([held, -held], axis=1)

    def scaled(self, rows: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Unit vectors of the rows with their further coordinate; ``most`` is the largest norm of each row's band."""
        held = rows / most[:, None]
        rest = np.sqrt(np.maximum(0.0, 1.0 - (held**2).sum(axis=1)))
        return np.concatenate([held, rest[:, None]], axis=1)

    def bucket(self, rows: np.ndarray, table: int) -> np.ndarray:
        found = np.zeros(len(rows), dtype=np.int64)
        for axis in range(self.axes):
            found = found * 2 * self.width + self.rotated(rows, table, axis).argmax(axis=1)
        return found

    def preference(self, rows: np.ndarray, table: int) -> np.ndarray:
        """How near each row is to each bucket: the sum over its axes."""
        total = np.zeros((len(rows), 1))
        for axis in range(self.axes):
            total = (total[:, :, None] + self.rotated(rows, table, axis)[:, None, :]).reshape(len(rows), -1)
        return total

    def probes(self, rows: np.ndarray, table: int, count: int) -> np.ndarray:
        """The ``count`` nearest buckets of each row."""
        near = self.preference(rows, table)
        if count >= near.shape[1]:
            return np.tile(np.arange(near.shape[1]), (len(rows), 1))
        return np.argpartition(-near, count - 1, axis=1)[:, :count]


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id, vector, key`` of the rows that take part, and their dimension.

    Without part: null ids, vectors that are null, hold null or non-finite components or only zeros, and those
    of another length than most have (the longer of two as frequent).
    """
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.forall("vector", _finite) & F.exists("vector", lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    size = most[0]["size"] if most else 0
    key = F.md5(F.array_join(F.col("vector").cast("array<string>"), ",").cast("binary"))
    return rows.where(F.size("vector") == size).withColumn("key", key), size


def packed(rows: DataFrame) -> DataFrame:
    """The ``vector`` as eight bytes a component, which move and read faster than arrays."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            offsets = offsets - offsets[0]
            data = pa.array([flat[a:b].astype("<f8").tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
            at = batch.schema.get_field_index("vector")
            yield batch.set_column(at, "vector", data)

    fields = ", ".join(f"{f.name} {'binary' if f.name == 'vector' else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(pack, fields)


def matrix(packed_rows, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed_rows), dtype="<f8").reshape(-1, size)


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows**2).sum(axis=1))


def bands(lengths: np.ndarray) -> np.ndarray:
    """Norms within a factor of two share a band, around each power of two."""
    return np.floor(np.log2(lengths) + 0.5).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` largest scores of one query, ties to the smaller id."""
    if len(scores) > count:
        edge = np.partition(scores, len(scores) - count)[len(scores) - count]
        places = np.flatnonzero(scores >= edge)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:count]


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products summed in one order, whatever block a row was met in."""
    return (rows * query).sum(axis=1)


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """One row per different vector: ``rep`` (its smallest id), ``ids`` (its ``keep`` smallest), ``vector``, ``key``.

    A rank of at most ``keep`` is taken before and after the shuffle, so copies are few when they meet;
    repeated rows share their rank and fold into one id.
    """
    order = Window.partitionBy("key").orderBy("vec_id")
    first = rows.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= keep)
    grouped = first.groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("vector").alias("vector")
    )
    return packed(grouped.select("rep", "ids", "vector", "key"))


def band_norms(distinct: DataFrame, size: int) -> dict[int, float]:
    """The largest norm of each band."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, float] = {}
        for batch in batches:
            lengths = norms(matrix(batch.column("vector").to_pylist(), size))
            for band, length in zip(bands(lengths).tolist(), lengths.tolist()):
                most[band] = max(most.get(band, 0.0), length)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(most), pa.int64()), pa.array(list(most.values()), pa.float64())], names=["band", "most"]
        )

    found = distinct.select("vector").mapInArrow(measure, "band long, most double")
    return dict(found.groupBy("band").agg(F.max("most")).collect())


def exhaustive(distinct: DataFrame, queries: list[tuple[int, bytes]], size: int, count: int) -> DataFrame:
    """``query, rep, score, vector``: the ``count`` nearest of a few queries by a scan of all rows."""
    asked = matrix([v for _, v in queries], size)
    names = [q for q, _ in queries]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column("rep").to_numpy()
            data = batch.column("vector").to_pylist()
            scores = matrix(data, size) @ asked.T
            out = [(names[j], int(reps[i]), float(scores[i, j]), data[i]) for j in range(len(names)) for i in best(scores[:, j], reps, count)]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)],
                names=["query", "rep", "score", "vector"],
            )

    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    found = distinct.select("rep", "vector").mapInArrow(scan, "query long, rep long, score double, vector binary")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= count).drop("n")


def needed_probes(
    hashes: CrossPolytope, distinct: DataFrame, asked: DataFrame, most: dict[int, float], count: int, recall: float, sample: int
) -> int:
    """The fewest probes a table with which the sampled queries find this share of their true neighbours.

    The sample is ``sample`` queries by a hash of their id, held against all rows.
    """
    size = hashes.dimensions
    queries = [(r["rep"], bytes(r["vector"])) for r in asked.orderBy(F.xxhash64("rep"), "rep").limit(sample).collect()]
    if not queries:
        return 1
    true = exhaustive(distinct, queries, size, count).toPandas()
    asked_by = {rep: i for i, (rep, _) in enumerate(queries)}
    rows = matrix(true["vector"], size)
    near = hashes.scaled(rows, np.array([most[b] for b in bands(norms(rows)).tolist()]))
    directions = matrix([v for _, v in queries], size)
    directions = directions / norms(directions)[:, None]
    owner = true["query"].map(asked_by).to_numpy()
    ranks = np.full(len(rows), hashes.buckets)
    for table in range(hashes.tables):
        bucket = hashes.bucket(near, table)
        for i in range(len(queries)):
            mine = np.flatnonzero(owner == i)
            preferred = hashes.preference(directions[i : i + 1], table)[0]
            above = (preferred[None, :] > preferred[bucket[mine], None]).sum(axis=1)
            ranks[mine] = np.minimum(ranks[mine], above)
    ranks.sort()
    return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]) + 1


def nearest(
    vectors: DataFrame, every: int = 20, count: int = 20, recall: float = 0.96, sample: int = 96, axes: int | None = None
) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row whose id ``every`` divides, the ``count`` nearest others found.

    Nearest first by inner product in double precision, ties to the smaller id. Rows without part are named
    at ``usable``; equal vectors meet once and answer with all their ids, repeated ids count once per different
    vector; further columns are not read; without queries or candidates there are no rows. ``recall`` is the share of
    true neighbours that the probes of a sample must meet.
    """
    spark = vectors.sparkSession
    rows, size = usable(vectors)
    if not size:
        return spark.createDataFrame([], RESULT)
    keep = count + 1
    distinct = stored(distinct_vectors(rows, keep), "vectors")
    total = distinct.count()
    ids = stored(rows.where(F.col("vec_id") % every == 0).select("vec_id", "key").distinct(), "query-ids")
    asked = stored(distinct.join(ids.select("key").distinct(), "key", "left_semi").select("rep", "vector"), "queries")
    queries = asked.count()
    if not queries:
        return spark.createDataFrame([], RESULT)
    width = 2 << size.bit_length()
    hashes = CrossPolytope(size, axes or (1 if total <= BUCKET_ROWS * width else 2))
    most = band_norms(distinct, size)
    probes = needed_probes(hashes, distinct, asked, most, keep, recall, sample)
    groups = min(hashes.buckets, 1 + total // GROUP_ROWS)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = matrix(batch.column("vector").to_pylist(), size)
            band = bands(norms(held))
            unit = hashes.scaled(held, np.array([most[b] for b in band.tolist()]))
            for table in range(hashes.tables):
                bucket = hashes.bucket(unit, table)
                parts = [pa.array(band), pa.array(np.full(len(band), table)), pa.array(bucket % groups), pa.array(bucket)]
                yield pa.RecordBatch.from_arrays(
                    [*parts, batch.column("rep"), batch.column("ids"), batch.column("vector")],
                    names=["band", "table", "part", "bucket", "rep", "ids", "vector"],
                )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                held = matrix(batch.column("vector").to_pylist(), size)
                unit = held / norms(held)[:, None]
                for table in range(hashes.tables):
                    found = np.sort(hashes.probes(unit, table, probes), axis=1)
                    for part in np.unique(found % groups).tolist():
                        wanted = found % groups == part
                        some = np.flatnonzero(wanted.any(axis=1))
                        lists = [found[i][wanted[i]] for i in some]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(some), table)), pa.array(np.full(len(some), part)),
                                batch.column("rep").take(pa.array(some)), batch.column("vector").take(pa.array(some)),
                                pa.array(lists, pa.list_(pa.int64())),
                            ],
                            names=["table", "part", "query", "vector", "buckets"],
                        )

    entries = stored(
        distinct.select("rep", "ids", "vector").mapInArrow(
            index, "band long, table long, part long, bucket long, rep long, ids array<long>, vector binary"
        ),
        "vector-tables",
    )
    # A part of a table is cut into blocks of its rows and turns of the queries that want one of its buckets. Vectors with
    # clusters want few buckets, so few queries come to a part, and its rows are not repeated.
    wanted = stored(asked.mapInArrow(ask, "table long, part long, query long, vector binary, buckets array<long>"), "vector-probes")
    rows = entries.groupBy("band", "table", "part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("long").alias("blocks"))
    visits = wanted.groupBy("table", "part").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("long").alias("turns"))
    parts = stored(rows.join(visits, ["table", "part"]), "vector-parts")
    parts = broadcast_if_small(parts)
    turn, block = F.pmod(F.xxhash64("query"), F.col("turns")), F.pmod(F.xxhash64("rep"), F.col("blocks"))
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    every_turn = F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))
    asking = wanted.join(parts, ["table", "part"]).withColumn("turn", turn).withColumn("block", every_block).drop("blocks", "turns")
    placed = entries.join(parts, ["band", "table", "part"]).withColumn("block", block).withColumn("turn", every_turn).drop("blocks", "turns")

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query": [], "rep": [], "score": [], "ids": []})
        left = left.sort_values(["bucket", "rep"], ignore_index=True)
        held, wanted = matrix(left["vector"], size), matrix(right["vector"], size)
        reps, bucket = left["rep"].to_numpy(), left["bucket"].to_numpy()
        here, starts = np.unique(bucket, return_index=True)
        ends = np.append(starts[1:], len(bucket))
        columns: dict[int, slice] = {v: slice(x, y) for v, x, y in zip(here.tolist(), starts.tolist(), ends.tolist())}
        out = []
        step = max(1, HELD // len(left))
        for at in range(0, len(right), step):
            some = right.iloc[at : at + step]
            asked = wanted[at : at + step]
            scores = np.full((len(some), len(left)), -np.inf)
            visits: dict[int, list[int]] = {}
            for i, buckets in enumerate(some["buckets"]):
                for value in buckets.tolist():
                    if value in columns:
                        visits.setdefault(value, []).append(i)
            for value, who in visits.items():
                scores[who, columns[value]] = asked[who] @ held[columns[value]].T
            for i, query in enumerate(some["query"]):
                seen = np.flatnonzero(scores[i] > -np.inf)
                places = seen[best(scores[i][seen], reps[seen], keep)]
                exact = exact_scores(asked[i], held[places])
                top = places[best(exact, reps[places], keep)]
                out.append(pd.DataFrame({"query": query, "rep": reps[top], "score": exact_scores(asked[i], held[top]), "ids": left["ids"].to_numpy()[top]}))
        return pd.concat(out)

    keys = ["band", "table", "part", "block", "turn"]
    hits = placed.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(rank, HITS)
    once = hits.groupBy("query", "rep").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    top = once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    each = top.select("query", F.explode("ids").alias("vec_id"), "score")
    listed = each.groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "score"))).alias("near")
    )
    named = ids.join(distinct.select("key", "rep"), "key").join(listed.withColumnRenamed("query", "rep"), "rep")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, count)
    return named.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )
