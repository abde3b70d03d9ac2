"""Reversible removal of lines that many documents share.

The state is an exact table of reference counts (how many documents hold a line) and, per shard of its keys, a cuckoo
filter of the lines at or above the threshold. Documents can be inserted into the state and deleted from it; counts
are added and subtracted, and only lines that cross the threshold enter or leave their shard's filter, which a
cuckoo filter, unlike a Bloom filter, allows. While a shard's counts are merged, its other keys are held
against the new filter and those it wrongly claims are listed beside it, so that filter and list together are exact for
every line of the corpus, at about three bytes for each frequent line and no join when texts are cut.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import small_slices, strings
from labelloom.session import new_path, stored

BLANKS = b" \t\n\x0b\x0c\r"
TEXT_BYTES = 8 << 20
# Keys in one shard, about; twice as many make the state choose more shards.
SHARD_KEYS = 1 << 20
# Filters up to this size are read whole by every task; beyond it lines are joined with the counts.
FILTER_BYTES = 128 << 20
SALTS = 16
SLOTS, MOST_KICKS, FULL = 4, 200, 0.85
COUNTS = "high long, low long, shard int, before long, documents long"
FILTERS = "shard int, buckets int, slots binary, exceptions binary, frequent long"


def key_of(line: bytes) -> bytes:
    """A line without blanks at both ends, A-Z lower-cased."""
    return line.strip(BLANKS).lower()


def hashes_of(keys: list[bytes]) -> np.ndarray:
    """128 bits of each key, as two columns of int64."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<i8").reshape(-1, 2)


class CuckooFilter:
    """16 bits of each key in one of two buckets; keys can be inserted and deleted."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.buckets = buckets
        self.slots = np.zeros(buckets * SLOTS, dtype=np.uint16) if slots is None else slots

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(keys / (FULL * SLOTS))).bit_length()))

    @classmethod
    def holding(cls, low: np.ndarray) -> CuckooFilter:
        found = cls.sized(len(low))
        while not found.insert(low):
            found = cls(2 * found.buckets)
        return found

    def places(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and both buckets of keys."""
        mark = (low.view(np.uint64) >> np.uint64(48)).astype(np.int64)
        mark[mark == 0] = 1
        one = low & (self.buckets - 1)
        return mark, one, one ^ self._jump(mark)

    def _jump(self, mark):
        return (mark * 0x5BD1E995 >> 7) & (self.buckets - 1)

    def contains(self, low: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(low)
        rows = self.slots.reshape(-1, SLOTS)
        return ((rows[one] == mark[:, None]) | (rows[two] == mark[:, None])).any(axis=1)

    def insert(self, low: np.ndarray) -> bool:
        """Add keys; False, with the filter spoilt, if one finds no place."""
        slots = self.slots.tolist()
        mark, one, two = self.places(low)
        for f, a, b in zip(mark.tolist(), one.tolist(), two.tolist()):
            for bucket in (a, b):
                free = next((s for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS) if not slots[s]), None)
                if free is not None:
                    slots[free] = f
                    break
            else:
                bucket = a
                for kick in range(MOST_KICKS):
                    s = bucket * SLOTS + (kick + f) % SLOTS
                    f, slots[s] = slots[s], f
                    bucket ^= self._jump(f)
                    free = next((s for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS) if not slots[s]), None)
                    if free is not None:
                        slots[free] = f
                        break
                else:
                    return False
        self.slots = np.array(slots, dtype=np.uint16)
        return True

    def delete(self, low: np.ndarray) -> None:
        """Remove keys, all of which must have been inserted."""
        slots = self.slots.copy()
        mark, one, two = self.places(low)
        for f, a, b in zip(mark.tolist(), one.tolist(), two.tolist()):
            held = [s for bucket in (a, b) for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS) if slots[s] == f]
            slots[held[0]] = 0
        self.slots = slots


@dataclass(frozen=True)
class LineIndex:
    """One version of the state: its folder, number of shards, and what counts as a shared line."""

    path: str
    shards: int
    least: int
    shortest: int

    def counts(self, spark: SparkSession) -> DataFrame:
        """``high, low, documents``: the reference counts of all lines of the corpus."""
        return spark.read.schema(COUNTS).parquet(f"{self.path}/counts").where("documents > 0").select("high", "low", "documents")

    def filters(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(FILTERS).parquet(f"{self.path}/filters")


def line_counts(docs: DataFrame, shortest: int) -> DataFrame:
    """``high, low, n``: in how many rows of ``docs`` each line key of at least ``shortest`` code points stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text", TEXT_BYTES):
            held: Counter[bytes] = Counter()
            for text in strings(batch.column("text")):
                held.update({key for key in map(key_of, text.split(b"\n")) if long_enough(key, shortest)})
            sums = hashes_of(list(held))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(list(held.values()), pa.int64())], names=["high", "low", "n"]
            )

    read = docs.select(F.col("text").cast("string").alias("text"))
    return read.mapInArrow(count, "high long, low long, n long").groupBy("high", "low").agg(F.sum("n").alias("n"))


def long_enough(key: bytes, shortest: int) -> bool:
    return len(key) >= shortest and (shortest <= 1 or len(key.decode("utf-8", "replace")) >= shortest)


def changed(spark: SparkSession, index: LineIndex | None, changes: DataFrame, least: int, shortest: int, shard_keys: int) -> LineIndex:
    """The version after adding ``changes`` (``high, low, n``, n of either sign) to the counts of ``index``."""
    rows = changes.select("high", "low", F.lit(0).cast("long").alias("before"), "n")
    if index is not None:
        rows = rows.unionByName(index.counts(spark).select("high", "low", F.col("documents").alias("before"), F.lit(0).cast("long").alias("n")))
    merged = rows.groupBy("high", "low").agg(F.sum("before").alias("before"), F.sum("n").alias("n"))
    after = F.col("before") + F.col("n")
    sound = F.when(after < 0, F.raise_error(F.lit("a deleted document was never inserted"))).otherwise(after)
    merged = stored(merged.select("high", "low", "before", sound.cast("long").alias("documents")), "line-changes")
    keys = merged.where("documents > 0").count()
    shards = index.shards if index and keys <= 2 * shard_keys * index.shards else 1 + keys // shard_keys
    path = new_path(spark, "line-index")
    shard = F.pmod("high", F.lit(shards)).cast("int").alias("shard")
    merged.select("high", "low", shard, "before", "documents").write.parquet(f"{path}/counts")
    counts = spark.read.schema(COUNTS).parquet(f"{path}/counts")
    kept = index.filters(spark) if index and index.shards == shards else spark.createDataFrame([], FILTERS)

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows and not right.num_rows:
            return pa.Table.from_batches([], pa_filters())
        held = left.num_rows and left.to_pylist()[0]
        names = ("high", "low", "before", "documents")
        high, low, before, documents = (right.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in names)
        number = held["shard"] if held else right.column("shard")[0].as_py()
        now = documents >= least
        frequent = int(now.sum()) if right.num_rows else 0
        found = None
        if held and held["frequent"] and frequent <= FULL * SLOTS * held["buckets"]:
            # Lines that crossed the threshold leave or enter; the rest of the filter stays as it is.
            found = CuckooFilter(held["buckets"], np.frombuffer(held["slots"], dtype=np.uint16))
            found.delete(low[(before >= least) & ~now])
            if not found.insert(low[(before < least) & now]):
                found = None
        if found is None:
            found = CuckooFilter.holding(low[now])
        claimed = ~now & found.contains(low)
        wrong = np.stack([high[claimed], low[claimed]], axis=1)
        row = {"shard": number, "buckets": found.buckets, "slots": found.slots.tobytes(), "exceptions": wrong.tobytes(), "frequent": frequent}
        return pa.Table.from_pylist([row], pa_filters())

    both = kept.groupBy("shard").cogroup(counts.groupBy("shard"))
    both.applyInArrow(merge, FILTERS).write.parquet(f"{path}/filters")
    return LineIndex(path, shards, least, shortest)


def pa_filters() -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("buckets", pa.int32()), ("slots", pa.binary()), ("exceptions", pa.binary()), ("frequent", pa.int64())])


def indexed(docs: DataFrame, least: int = 10, shortest: int = 1, shard_keys: int = SHARD_KEYS) -> LineIndex:
    """The state of a corpus: lines of at least ``shortest`` code points are shared when ``least`` documents hold them.

    Every row is a document; a line that stands in it twice counts once. Null and empty texts hold one empty line.
    """
    return changed(docs.sparkSession, None, line_counts(docs, shortest), least, shortest, shard_keys)


def inserted(index: LineIndex, docs: DataFrame, shard_keys: int = SHARD_KEYS) -> LineIndex:
    """The state after further documents came; reads their texts and the counts, not the earlier texts."""
    return changed(docs.sparkSession, index, line_counts(docs, index.shortest), index.least, index.shortest, shard_keys)


def deleted(index: LineIndex, docs: DataFrame, shard_keys: int = SHARD_KEYS) -> LineIndex:
    """The state after documents, all inserted before, went; it equals one that never saw them."""
    going = line_counts(docs, index.shortest).withColumn("n", -F.col("n"))
    return changed(docs.sparkSession, index, going, index.least, index.shortest, shard_keys)


class SharedLines:
    """Filters and exceptions of all shards, asked for many keys at once."""

    def __init__(self, shards: int, rows: list[dict]):
        self.shards = shards
        self.filters = {r["shard"]: CuckooFilter(r["buckets"], np.frombuffer(r["slots"], dtype=np.uint16)) for r in rows if r["frequent"]}
        wrong = np.frombuffer(b"".join(r["exceptions"] for r in rows), dtype="<i8").reshape(-1, 2)
        self.wrong_low, self.wrong = np.unique(wrong[:, 1]), set(map(tuple, wrong.tolist()))

    def contain(self, sums: np.ndarray) -> np.ndarray:
        found = np.zeros(len(sums), dtype=bool)
        shard = np.mod(sums[:, 0], self.shards)
        order = np.argsort(shard, kind="stable")
        numbers, first = np.unique(shard[order], return_index=True)
        for number, rows in zip(numbers.tolist(), np.split(order, first[1:])):
            held = self.filters.get(number)
            if held is not None:
                found[rows] = held.contains(np.ascontiguousarray(sums[rows, 1]))
        for row in np.flatnonzero(found & np.isin(sums[:, 1], self.wrong_low)).tolist():
            found[row] = tuple(sums[row].tolist()) not in self.wrong
        return found


@lru_cache(maxsize=1)
def load_filters(path: str, shards: int) -> SharedLines:
    place, base = fs.FileSystem.from_uri(f"{path}/filters")
    return SharedLines(shards, ds.dataset(base, filesystem=place, format="parquet").to_table().to_pylist())


def cut(docs: DataFrame, index: LineIndex, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` of every row of ``docs``, whose texts the index must hold.

    Shared lines go, wherever they stand and however often; the others stay, joined by line feeds (empty
    if none is left). Null and empty texts are one empty line, which goes only if ``shortest`` is 0. Equal rows are cut
    alike, null ids are kept, no rows give no rows, further columns are not read.
    """
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = index.filters(spark).agg(F.sum(F.octet_length("slots") + F.octet_length("exceptions"))).first()[0] or 0
    path, shards, shortest = index.path, index.shards, index.shortest
    if size > filter_bytes:
        return _cut_by_join(read, index)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text", TEXT_BYTES):
            lines, keys, sizes = split_lines(strings(batch.column("text")))
            shared = load_filters(path, shards).contain(hashes_of(keys))
            shared &= np.array([long_enough(key, shortest) for key in keys], dtype=bool)
            yield kept_batch(batch.column("doc_id"), lines, sizes, shared)

    return read.mapInArrow(apply, "doc_id long, n_lines long, n_dropped long, kept string")


def split_lines(texts: list[bytes]) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """All lines, their keys, and the number of lines of each text."""
    split = [text.split(b"\n") for text in texts]
    lines = [line for held in split for line in held]
    return lines, list(map(key_of, lines)), np.array([len(held) for held in split], dtype=np.int64)


def kept_batch(ids: pa.Array, lines: list[bytes], sizes: np.ndarray, shared: np.ndarray) -> pa.RecordBatch:
    ends = np.cumsum(sizes).tolist()
    drop, start, kept, dropped = shared.tolist(), 0, [], []
    for end in ends:
        left = [line for line, gone in zip(lines[start:end], drop[start:end]) if not gone]
        kept.append(b"\n".join(left))
        dropped.append(end - start - len(left))
        start = end
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(sizes), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
        names=["doc_id", "n_lines", "n_dropped", "kept"],
    )


def _cut_by_join(read: DataFrame, index: LineIndex) -> DataFrame:
    """The same without filters in memory: distinct lines of distinct texts meet the shared ones by a salted join."""
    shortest = index.shortest

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text", TEXT_BYTES):
            rows = []
            for text in strings(batch.column("text")):
                keys = {key for key in map(key_of, text.split(b"\n")) if long_enough(key, shortest)}
                rows += [(xxhash.xxh3_128_digest(text), *pair) for pair in hashes_of(list(keys)).tolist()]
            kinds = (pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["same", "high", "low"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = pa.array(map(xxhash.xxh3_128_digest, strings(batch.column("text"))), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), same], names=["doc_id", "text", "same"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text", TEXT_BYTES):
            lines, keys, sizes = split_lines(strings(batch.column("text")))
            gone = [frozenset((p["high"], p["low"]) for p in found or ()) for found in batch.column("gone").to_pylist()]
            owner = np.repeat(np.arange(len(sizes)), sizes).tolist()
            pairs = map(tuple, hashes_of(keys).tolist())
            shared = np.array([pair in gone[at] for at, pair in zip(owner, pairs)], dtype=bool)
            yield kept_batch(batch.column("doc_id"), lines, sizes, shared)

    spark = read.sparkSession
    lines = read.select("text").mapInArrow(hashed, "same binary, high long, low long").distinct()
    lines = lines.withColumn("salt", F.pmod(F.xxhash64("same"), F.lit(SALTS)))
    frequent = index.counts(spark).where(F.col("documents") >= index.least).select(
        "high", "low", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    )
    gone = lines.join(frequent, ["high", "low", "salt"], "left_semi")
    gone = stored(gone.groupBy("same").agg(F.collect_list(F.struct("high", "low")).alias("gone")), "shared-lines")
    texts = stored(read.mapInArrow(named, "doc_id long, text string, same binary"), "line-texts")
    return texts.join(gone, "same", "left").mapInArrow(apply, "doc_id long, n_lines long, n_dropped long, kept string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def sql(least: int = 10) -> str:
    """DuckDB SQL for keys of at least one code point."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    key = f"translate(trim(line, {blanks}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    split AS (SELECT row, string_split(text, chr(10)) AS lines FROM docs),
    lines AS MATERIALIZED (SELECT row, place, line, {key} AS key
        FROM (SELECT row, place, lines[place] AS line FROM split, unnest(range(1, len(lines) + 1)) AS t(place))),
    shared AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= {least}),
    marked AS (SELECT row, place, line, key IN (SELECT key FROM shared) AS gone FROM lines),
    cut AS (
        SELECT row, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS kept
        FROM marked GROUP BY row)
    SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM docs JOIN cut USING (row)"""
