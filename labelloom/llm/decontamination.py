"""Benchmark decontamination: an FM-index of each training shard answers all benchmark windows.

A shard is a slice of documents. Its words become numbers, those that no benchmark item has only
break the text, and stretches too short for any window are left out; what remains is indexed.
All windows of a block of benchmark items are searched backwards at once, their occurrences are
located by sampled suffix positions, and overlapping ones merge into spans to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import small_slices, strings
from labelloom.llm.fm_index import FMIndex
from labelloom.session import new_path

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
STEP = 1 << 18
RESULT = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "spans array<struct<start: int, end: int>>"
)

_BYTE = np.arange(256)
IN_WORD = (_BYTE >= 0x80) | ((_BYTE | 0x20) - 0x61 < 26) & ((_BYTE | 0x20) >= 0x61) | (_BYTE >= 0x30) & (_BYTE <= 0x39)
LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)
BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def _powers(size: int) -> np.ndarray:
    found = np.full(size, BASE, dtype=np.uint64)
    found[0] = 1
    return np.multiply.accumulate(found)


@dataclass
class Words:
    """Words of some texts in one byte array: where each starts and ends, its text and its hash."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray
    text_starts: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        text_starts = np.cumsum(sizes) - sizes
        inside = IN_WORD[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate([[0], edges])
        starts, ends = edges[0::2], edges[1::2]
        low = LOWER[data]
        if not len(starts):
            return cls(low, starts, ends, starts, np.zeros(0, dtype=np.uint64), text_starts)
        lengths = ends - starts
        offsets = np.cumsum(lengths) - lengths
        letters = low[inside].astype(np.uint64) + np.uint64(1)
        place = np.arange(len(letters)) - np.repeat(offsets, lengths)
        size = 1 << max(6, int(lengths.max()).bit_length())
        hashes = np.add.reduceat(letters * _powers(size)[place], offsets)
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        owner = np.searchsorted(text_starts, starts, side="right") - 1
        return cls(low, starts, ends, owner, hashes ^ (hashes >> np.uint64(32)), text_starts)

    def letters(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the given words, and their lengths."""
        lengths = self.ends[words] - self.starts[words]
        offsets = np.cumsum(lengths) - lengths
        places = np.repeat(self.starts[words] - offsets, lengths) + np.arange(int(lengths.sum()))
        return self.data[places], lengths


class Benchmark:
    """Windows of a block of items, as numbers of the words that occur in it.

    Numbers start at 2: in a shard's text 0 is its end and 1 a break.
    """

    def __init__(self, item_ids: list[int | None], texts: list[bytes], window: int = WINDOW):
        words = Words.of(texts)
        self.hashes, first, numbers = np.unique(words.hashes, return_index=True, return_inverse=True)
        self.words = words
        self.first = first
        self.near = np.zeros(1 << 22, dtype=bool)
        self.near[(self.hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        rows, lengths, owners = [], [], []
        bounds = np.searchsorted(words.text, np.arange(len(texts) + 1))
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            size = min(window, b - a)
            if size:
                held = np.lib.stride_tricks.sliding_window_view(numbers[a:b] + 2, size)
                rows.append(np.pad(held, ((0, 0), (0, window - size))))
                lengths.append(np.full(len(held), size))
                owners.append(np.full(len(held), i))
        if rows:
            self.patterns, window_of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            self.lengths = (self.patterns > 0).sum(axis=1)
            named = np.array([i is not None for i in item_ids])
            ids = np.array([i or 0 for i in item_ids], dtype=np.int64)
            owner = np.concatenate(owners)
            pairs = np.stack([window_of.ravel(), ids[owner]], axis=1)[named[owner]]
            pairs = np.unique(pairs, axis=0)
            self.item_starts = np.searchsorted(pairs[:, 0], np.arange(len(self.patterns) + 1))
            self.items = pairs[:, 1]
        else:
            self.patterns, self.lengths = np.zeros((0, window), dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.least = int(self.lengths.min(initial=window))

    def numbers(self, shard: Words) -> np.ndarray:
        """The number of each of the shard's words, 1 for words that no item has; equal hashes are compared letter by letter."""
        found = np.ones(len(shard.hashes), dtype=np.int64)
        if not len(self.hashes):
            return found
        maybe = np.flatnonzero(self.near[(shard.hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, shard.hashes[maybe]), len(self.hashes) - 1)
        same = self.hashes[at] == shard.hashes[maybe]
        found[maybe[same]] = at[same] + 2
        return found

    def confirmed(self, shard: Words, kept: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """``numbers`` of the kept words, with 1 where the letters differ."""
        mine, sizes = shard.letters(kept)
        theirs, other = self.words.letters(self.first[numbers - 2])
        if len(mine) == len(theirs) and (sizes == other).all():
            equal = mine == theirs
            if equal.all():
                return numbers
            differs = np.add.reduceat(~equal, np.cumsum(sizes) - sizes) > 0
            return np.where(differs, 1, numbers)
        right = np.array([self.words.letters(self.first[[n - 2]])[0].tobytes() == shard.letters(np.array([k]))[0].tobytes() for k, n in zip(kept, numbers)])
        return np.where(right, numbers, 1)

    def occurrences(self, shard: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (first word) and windows of all occurrences in the shard, a bounded number at a time."""
        numbers = self.numbers(shard)
        known = numbers > 1
        if not known.any():
            return
        broken = np.concatenate([[True], (shard.text[1:] != shard.text[:-1]) | ~known[1:] | ~known[:-1]])
        run = np.cumsum(broken) - 1
        long = (np.bincount(run)[run] >= self.least) & known
        kept = np.flatnonzero(long)
        if not len(kept):
            return
        runs = run[kept]
        gaps = np.concatenate([[0], np.cumsum(runs[1:] != runs[:-1])])
        text = np.ones(len(kept) + int(gaps[-1]), dtype=np.int64)
        places = np.arange(len(kept)) + gaps
        text[places] = self.confirmed(shard, kept, numbers[kept])
        back = np.full(len(text), -1, dtype=np.int64)
        back[places] = kept
        index = FMIndex(text, len(self.hashes) + 2)
        low, high = index.search(self.patterns, self.lengths)
        hit = np.flatnonzero(high > low)
        counts = high[hit] - low[hit]
        ends = np.cumsum(counts)
        for at in range(0, int(ends[-1]) if len(ends) else 0, STEP):
            each = np.arange(at, min(at + STEP, int(ends[-1])))
            which = np.searchsorted(ends, each, side="right")
            rows = low[hit[which]] + each - (ends[which] - counts[which])
            yield back[index.locate(rows)], hit[which]


def block_path(benchmark: DataFrame) -> tuple[str, int]:
    """Write the items, cut into blocks by a hash of their ids, where every task can read one block at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    path = new_path(benchmark.sparkSession, "benchmark")
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int").alias("block")
    items.select(block, "item_id", "text").repartition(blocks, "block").sortWithinPartitions("block").write.parquet(path)
    return path, blocks


@lru_cache(maxsize=1)
def load_block(path: str, block: int, window: int) -> Benchmark:
    place, base = fs.FileSystem.from_uri(path)
    held = ds.dataset(base, filesystem=place, format="parquet").to_table(filter=ds.field("block") == block)
    return Benchmark(held.column("item_id").to_pylist(), strings(held.column("text").combine_chunks()), window)


def judged_texts(texts: list[bytes], path: str, blocks: int, window: int) -> tuple[np.ndarray, np.ndarray, list[set[int]], list[list[dict]]]:
    """Words, hit words, items and merged spans (code points) of each text of one shard."""
    shard = Words.of(texts)
    hit = np.zeros(len(shard.starts) + 1, dtype=np.int64)
    items: list[set[int]] = [set() for _ in texts]
    for block in range(blocks):
        held = load_block(path, block, window)
        for places, windows in held.occurrences(shard):
            np.add.at(hit, places, 1)
            np.add.at(hit, places + held.lengths[windows], -1)
            pairs = np.unique(np.stack([shard.text[places], windows], axis=1), axis=0)
            for text, w in pairs.tolist():
                items[text].update(held.items[held.item_starts[w] : held.item_starts[w + 1]].tolist())
    covered = np.cumsum(hit)[:-1] > 0
    n_words = np.bincount(shard.text, minlength=len(texts))
    n_hit = np.bincount(shard.text[covered], minlength=len(texts))
    spans: list[list[dict]] = [[] for _ in texts]
    joined = covered[1:] & covered[:-1] & (shard.text[1:] == shard.text[:-1])
    first = np.flatnonzero(covered & ~np.concatenate([[False], joined]))
    last = np.flatnonzero(covered & ~np.concatenate([joined, [False]]))
    for a, b in zip(first, last):
        text = int(shard.text[a])
        start, end = (int(x - shard.text_starts[text]) for x in (shard.starts[a], shard.ends[b]))
        before = len(texts[text][:start].decode("utf-8", "replace"))
        spans[text].append({"start": before, "end": before + len(texts[text][start:end].decode("utf-8", "replace"))})
    return n_words, n_hit, items, spans


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans`` of every row of ``docs``.

    Null, empty and wordless texts have no words and no hits. An item of fewer words than a window is
    one window; an item without words has none. Equal items each count by their id, ids
    are counted once, an item without id is searched for but not listed. Repeated rows are judged
    alike, an empty benchmark hits nothing, no documents give no rows, further columns are not read.
    """
    path, blocks = block_path(benchmark)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [part.split()[0] for part in RESULT.split("spans")[0].split(", ") if part] + ["spans"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text", SHARD_BYTES):
            if not batch.num_rows:
                continue
            n_words, n_hit, items, spans = judged_texts(strings(batch.column("text")), path, blocks, window)
            listed = [sorted(map(str, found)) for found in items]
            sums = [hashlib.sha256(",".join(ids).encode()).hexdigest() for ids in listed]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns = [batch.column("doc_id"), n_words, n_hit, [len(x) for x in listed], sums, n_hit > 0]
            arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(spans, kind)], names=names)

    return read.mapInArrow(judge, RESULT)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no window of the benchmark.

    Null, empty and wordless texts hold none and stay; equal rows stay or go alike, null ids are kept; an empty benchmark
    keeps everything, no rows give no rows.
    """
    path, blocks = block_path(benchmark)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text", SHARD_BYTES):
            if batch.num_rows:
                yield batch.filter(pa.array(judged_texts(strings(batch.column("text")), path, blocks, window)[1] == 0))

    return docs.mapInArrow(keep, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    return found.drop("spans")


_WORDS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
SQL = f"""
    WITH listed AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
    items AS (SELECT item_id, w, least({WINDOW}, len(w)) AS k FROM listed WHERE len(w) > 0),
    windows AS (
        SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
        FROM items, unnest(range(1, len(w) - k + 2)) AS t(i)),
    sizes AS (SELECT DISTINCT k FROM windows),
    docs AS (SELECT doc_id, row_number() OVER () AS row, coalesce({_WORDS}, []) AS w FROM documents),
    places AS (
        SELECT row, i, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
        FROM docs, sizes, unnest(range(1, len(w) - k + 2)) AS t(i)),
    hits AS (SELECT row, i, k, item_id FROM places JOIN windows USING (k, phrase)),
    words AS (SELECT DISTINCT row, p FROM hits, unnest(range(i, i + k)) AS t(p)),
    counted AS (SELECT row, count(*) AS n_hit FROM words GROUP BY row),
    ids AS (SELECT DISTINCT row, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL),
    found AS (SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM ids GROUP BY row)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN counted USING (row) LEFT JOIN found USING (row)"""
