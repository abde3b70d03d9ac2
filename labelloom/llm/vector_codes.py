"""Compression of vectors to short codes: each part of a vector becomes the number of its nearest codebook entry.

The nearest entry is found by equal-average search. Entries are sorted by the sum of their components; the
search starts where a part's own sum would stand and expands outwards, the side with the smaller gap first. By
Cauchy's inequality a squared distance is at least the squared gap of the sums over the dimension, so a part's
search ends as soon as that bound strictly exceeds its best distance; entries at an equal distance are still seen,
which lets the lower number win. All arithmetic is on integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import in_pieces
from labelloom.session import stored
from labelloom.sizing import MAX_BROADCAST_ROWS

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
MOST_LONG = (1 << 63) - 1
# Components whose integer form stays below this fit 64 bits.
LARGEST = 2.0**51
SALTS = 16
CODES = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


@dataclass(frozen=True)
class Codebooks:
    """``entries[part][entry]`` is a list of whole numbers; ``size`` is the length of a vector before padding."""

    size: int
    entries: list[list[list[int]]]

    @property
    def width(self) -> int:
        return len(self.entries[0][0])

    def sha256(self) -> str:
        numbers = (str(x) for part in self.entries for entry in part for x in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


class SortedEntries:
    """The entries of one part, in the order of the sums of their components."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.numbers = np.argsort(sums, kind="stable")
        self.entries, self.sums = entries[self.numbers], sums[self.numbers]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each part's nearest entry, and how many distances were computed."""
        last, dimension = len(self.sums) - 1, parts.shape[1]
        sums = parts.sum(axis=1)
        right = np.searchsorted(self.sums, sums).astype(np.int64)
        left = right - 1
        number = np.full(len(parts), -1, dtype=np.int64)
        distance = np.zeros(len(parts), dtype=parts.dtype)
        searching, seen = np.arange(len(parts)), 0
        while len(searching):
            below, above, own = left[searching], right[searching], sums[searching]
            gap_below = own - self.sums[np.maximum(below, 0)]
            gap_above = self.sums[np.minimum(above, last)] - own
            downwards = (below >= 0) & ((above > last) | _truth(gap_below <= gap_above))
            gap = np.where(downwards, gap_below, gap_above)
            within = (number[searching] < 0) | _truth(gap * gap <= distance[searching] * dimension)
            go = within & ((below >= 0) | (above <= last))
            searching, downwards = searching[go], downwards[go]
            at = np.where(downwards, left[searching], right[searching])
            left[searching] -= downwards
            right[searching] += ~downwards
            apart = parts[searching] - self.entries[at]
            found, entry = (apart * apart).sum(axis=1), self.numbers[at]
            held, best = number[searching], distance[searching]
            better = (held < 0) | _truth(found < best) | (_truth(found == best) & (entry < held))
            number[searching[better]], distance[searching[better]] = entry[better], found[better]
            seen += len(searching)
        return number, distance, seen


def _truth(values: np.ndarray) -> np.ndarray:
    return values.astype(bool)


def assigned(parts: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part of ``parts`` (rows x parts x width)."""
    entries = np.array(books.entries, dtype=np.int64)
    reach = max(int(np.abs(entries).max(initial=0)), int(np.abs(parts).max(initial=0)))
    if 2 * reach * max(1, books.width) >= 1 << 31:
        # Squares beyond 64 bits: whole numbers of any size.
        parts, entries = parts.astype(object), entries.astype(object)
    numbers = np.zeros(parts.shape[:2], dtype=np.int64)
    distances = np.zeros(parts.shape[:2], dtype=parts.dtype)
    for part in range(parts.shape[1]):
        numbers[:, part], distances[:, part], _ = SortedEntries(entries[part]).nearest(parts[:, part])
    return numbers, distances


def in_parts(column: pa.Array, size: int, parts: int) -> np.ndarray:
    """Vectors as whole numbers, rows x parts x width; zeros fill the last part where the length is no multiple."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)
    width = -(-size // parts)
    whole = np.floor(values * SCALE).astype(np.int64)
    return np.pad(whole, ((0, 0), (0, width * parts - size))).reshape(len(column), parts, width)


def kept_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id, label, vector, usable`` of the rows whose vector holds finite numbers only, and the vectors' length.

    ``usable`` vectors have the commonest length (the shorter of two) and components below 2^51.
    """
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", vector.alias("vector")).where(finite)
    lengths = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if lengths is None:
        return rows.withColumn("usable", F.lit(False)), 0
    size = lengths["size"]
    usable = (F.size("vector") == size) & F.forall("vector", lambda x: F.abs(x) < LARGEST)
    return rows.withColumn("usable", usable), size


def first_entries(rows: DataFrame, entries: int) -> list[list[float]]:
    """Vectors of the smallest ids, ascending; of several vectors with one id the smallest."""
    found: dict[int, list[float]] = {}
    left = rows.where("usable AND vec_id IS NOT NULL").select("vec_id", "vector")
    while len(found) < entries:
        least = left.orderBy("vec_id", "vector").limit(entries).collect()
        if not least:
            break
        for row in least:
            if len(found) < entries:
                found.setdefault(row["vec_id"], list(row["vector"]))
        left = left.where(F.col("vec_id") > max(found))
    return list(found.values())


def fit(rows: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all usable rows of ``kept_vectors``; None if there is no such row with an id.

    Each round assigns every part by equal-average search and moves each entry to the floor of the mean of its
    parts; an entry without parts stays. A task sends one sum for each component of the codebooks.
    """
    seeds = first_entries(rows, entries)
    if not seeds:
        return None
    first = in_parts(pa.array(seeds, pa.list_(pa.float64())), size, parts)
    books = Codebooks(size, first.transpose(1, 0, 2).tolist())
    vectors = rows.where("usable").select("vector")
    for _ in range(rounds):
        books = Codebooks(size, moved(vectors, books))
    return books


def moved(vectors: DataFrame, books: Codebooks) -> list[list[list[int]]]:
    parts, entries, width, size = len(books.entries), len(books.entries[0]), books.width, books.size

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), dtype=np.int64)
        sums = np.zeros((parts, entries, width), dtype=object)
        for batch in in_pieces(batches, size):
            held = in_parts(batch.column("vector"), size, parts)
            numbers, _ = assigned(held, books)
            for part in range(parts):
                mine = numbers[:, part][None, :] == np.arange(entries)[:, None]
                counts[part] += mine.sum(axis=1)
                # A product of integers; a piece is too short for its sums to leave 64 bits unless components do.
                wide = np.abs(held[:, part]).max(initial=0) >= 1 << 40
                sums[part] += mine.astype(object if wide else np.int64) @ held[:, part].astype(object if wide else np.int64)
        found = [
            (part, entry, at, str(sums[part, entry, at]), int(counts[part, entry]))
            for part in range(parts) for entry in range(entries) if counts[part, entry] for at in range(width)
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()))],
            names=["part", "entry", "at", "sum", "n"],
        )

    partial = vectors.mapInArrow(add, "part int, entry int, at int, sum string, n long")
    sums = partial.groupBy("part", "entry", "at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("n").alias("n"))
    after = [[list(entry) for entry in part] for part in books.entries]
    for row in sums.collect():
        after[row["part"]][row["entry"]][row["at"]] = int(row["sum"]) // row["n"]
    return after


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, label, code, error`` of the rows of ``kept_vectors``; null code and error where ``usable`` is false."""
    parts, size = len(books.entries), books.size
    label = rows.schema["label"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, size):
            numbers, distances = assigned(in_parts(batch.column("vector"), size, parts), books)
            codes = ["".join(f"{n:02x}" for n in row) for row in numbers.tolist()]
            errors = [min(sum(row), MOST_LONG) for row in distances.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    coded = rows.where("usable").select("vec_id", "label", "vector").mapInArrow(code, f"vec_id long, label {label}, code string, error long")
    other = rows.where("NOT usable").select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(other)


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row whose vector holds finite numbers only.

    Rows with a null vector or a null or non-finite component are dropped. A vector of another length than the
    commonest, or with a component of 2^51 or more, keeps its row with null code and error and teaches nothing; errors beyond
    a long come out as the largest long. Equal ids and rows are coded alike, and an id enters the first codebook once, by its
    smallest vector; null ids are coded but enter no first codebook, and if all ids are null, codes and errors are null.
    Equal labels are summed together, null ones too (null if none of them has an error). No rows give no rows;
    further columns are not read.
    """
    rows, size = kept_vectors(vectors)
    books = fit(rows, size, parts, entries, rounds)
    if books is None:
        blank = F.lit(None)
        return rows.select(
            "vec_id", blank.cast("string").alias("code"), blank.cast("long").alias("error"),
            blank.cast("long").alias("label_error"), F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"),
        )
    return with_label_errors(stored(encoded(rows, books), "vector-codes")).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )


def with_label_errors(coded: DataFrame, most_sent: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Add the sum of errors over equal labels; beyond ``most_sent`` labels by a join in which hot labels are salted."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST_LONG).cast("decimal(38,0)")).cast("long")
    totals = stored(coded.groupBy(F.col("label").alias("same")).agg(total.alias("label_error")), "label-errors")
    alike = F.col("label").eqNullSafe(F.col("same"))
    if totals.count() <= most_sent:
        return coded.join(F.broadcast(totals), alike, "left")
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    copies = totals.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, (F.col("salt") == F.col("copy")) & alike, "left").drop("salt", "copy")


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for vectors of one length that ``parts`` divides: every distance, no search."""

    def steps(turn: int) -> str:
        found = f"""
    found{turn} AS MATERIALIZED (
        SELECT row, part, any_value(x) AS x, min(distance) AS distance, arg_min(entry, (distance, entry)) AS entry
        FROM (SELECT row, part, x, entry, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS distance
              FROM pieces JOIN book{turn} USING (part))
        GROUP BY row, part)"""
        if turn == rounds:
            return found
        return found + f""",
    means{turn} AS (
        SELECT part, entry, list(((s - ((s % c) + c) % c) // c)::BIGINT ORDER BY i) AS y
        FROM (SELECT part, entry, i, sum(x[i])::HUGEINT AS s, count(*) AS c
              FROM found{turn}, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY ALL)
        GROUP BY ALL),
    book{turn + 1} AS MATERIALIZED (
        SELECT part, entry, coalesce(m.y, b.y) AS y FROM book{turn} AS b LEFT JOIN means{turn} AS m USING (part, entry))"""

    return f"""
    WITH kept AS MATERIALIZED (
        SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor({SCALE}.0::DOUBLE * x)::BIGINT) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pieces AS MATERIALIZED (
        SELECT row, part::INT AS part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x
        FROM kept, unnest(range({parts})) AS t(part)),
    book0 AS MATERIALIZED (
        SELECT part, rank - 1 AS entry, x AS y
        FROM (SELECT row, row_number() OVER (ORDER BY vec_id) AS rank FROM kept) JOIN pieces USING (row) WHERE rank <= {entries}),
    {",".join(steps(turn) for turn in range(rounds + 1))},
    coded AS (
        SELECT row, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error
        FROM found{rounds} GROUP BY row)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
           (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
    FROM kept JOIN coded USING (row)"""
