"""SimHash near-duplicates, found by covering locality-sensitive hashing.

Every bit position gets a non-zero vector of radius + 1 bits; each of the 2^(radius + 1) - 1
non-zero vectors gives one mask, which keeps the positions whose vector has an odd product with
it. Two fingerprints that differ in at most ``radius`` positions leave at least one mask that
keeps none of those positions, so they agree under it and meet in that mask's table: no pair
within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import small_slices, strings
from labelloom.llm.components import roots
from labelloom.session import stored

BITS = 64
SEED = 42
BLOCK = 1 << 15


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """Unsigned SimHash of a text: bit i is 1 if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(shingle_words, len(words))
    total, digest = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    for at in range(0, len(starts), BLOCK):
        hashes = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])], dtype="<u8"
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint16)
    set_bits = np.packbits(total * 2 > len(starts), bitorder="little")
    return int(set_bits.view("<u8")[0])


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The masks of the tables, as unsigned numbers."""
    vectors = range(1, 1 << (radius + 1))
    return [sum(((i % len(vectors) + 1 & v).bit_count() & 1) << i for i in range(bits)) for v in vectors]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp`` of each row; fp is the fingerprint as a signed long."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = read.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text", 16 << 20):
            found = np.array([fingerprint(t, shingle_words) for t in strings(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(found.view(np.int64))],
                names=["doc_id", "text_hash", "fp"],
            )

    return read.mapInArrow(compute, "doc_id long, text_hash long, fp long")


def stars_within(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join what is within the radius among a bounded list, at most one per value and round of search."""
    held = np.array(sorted(set(values)), dtype=np.int64)
    links = []
    for i in range(len(held) - 1):
        near = np.bitwise_count((held[i + 1 :] ^ held[i]).view(np.uint64)) <= radius
        links += [(int(held[i]), int(b)) for b in held[i + 1 :][near]]
    return links


def spanning(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """As few links as join the same nodes."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in links:
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def linked_fingerprints(prints: DataFrame, radius: int = 2, direct: int = 1024) -> DataFrame:
    """Links ``a, b`` that connect all distinct values of ``fp`` within the radius of each other.

    A bucket of at most ``direct`` fingerprints is compared within one array. Values of a larger
    bucket are joined through the points near them instead: two values within the radius share
    a point within half of it (rounded up) of each, and all values around one such point, at most
    2,081 for a radius of 3 or 4, are compared likewise. So the work per value is bounded, and no
    pair is left out in either way.
    """
    masks = covering_masks(radius)
    tables = prints.select("fp").distinct().select(
        F.explode(F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(signed(m)).alias("key"), "fp") for t, m in enumerate(masks)])).alias("e")
    ).select("e.*")
    sizes = tables.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(tables.join(sizes, ["table", "key"]), "simhash-buckets")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for fps in batch.column("fps").to_pylist() for x in spanning(stars_within(fps, radius))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"]
            )

    small = shared.where(F.col("n") <= direct).groupBy("table", "key").agg(F.collect_list("fp").alias("fps"))
    crowded = shared.where(F.col("n") > direct).select("fp").distinct()
    flips = [0]
    for _ in range((radius + 1) // 2):
        flips = sorted({f ^ (1 << i) for f in flips for i in range(BITS)} | set(flips))
    points = crowded.select(
        "fp", F.explode(F.transform(F.array(*[F.lit(signed(f)) for f in flips]), lambda f: F.col("fp").bitwiseXOR(f))).alias("point")
    )
    around = points.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return small.select("fps").unionByName(around.select("fps")).mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, text_hash, fp, root, component_id, first_hash`` for each row of ``docs``.

    ``root`` names the component among fingerprints; ``component_id`` is its smallest doc_id
    (null if no row of it has one) and ``first_hash`` the text hash of that document.

    Null and empty texts, and those of white space, have fingerprint zero and are linked like any
    other; rows with equal doc_ids keep their own rows; a null doc_id is linked but never names a
    component that has another; further columns are not read; no rows give no rows.
    Copies meet as one fingerprint before any table is built.
    """
    prints = stored(with_fingerprints(docs, shingle_words), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    distinct = stored(prints.groupBy("fp").agg(first.alias("first")), "distinct-fingerprints")
    linked = roots(linked_fingerprints(distinct, radius))
    rooted = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    named = rooted.select("fp", "root").join(least, "root").select(
        "fp", "root", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("first_hash")
    )
    return prints.join(named, "fp")


def one_of_each(docs: DataFrame, shingle_words: int = 3, radius: int = 2) -> DataFrame:
    """The row with the smallest doc_id of every component; of equal rows and ids, one.

    Null and empty texts form a component like any other; of a component without any id one row stays; all
    columns stay as they are, and no rows give no rows. Texts are shuffled once, by id and hash, to meet the chosen
    ones and to fold equal rows.
    """
    found = near_duplicates(docs, shingle_words, radius)
    keys = ["none", "id", "hash"]

    def key(doc_id: str, text_hash: Column) -> list[Column]:
        # Without nulls, so that one partitioning serves the join and the folding.
        number = F.col(doc_id).cast("long")
        return [number.isNull().alias("none"), F.coalesce(number, F.lit(0)).alias("id"), text_hash.alias("hash")]

    kept = found.select(*key("component_id", F.col("first_hash"))).distinct()
    rows = docs.select(F.struct("*").alias("row"), *key("doc_id", F.xxhash64(F.col("text").cast("string"))))
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).select("row.*")


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id``, the fingerprint as 16 hexadecimal digits."""
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
