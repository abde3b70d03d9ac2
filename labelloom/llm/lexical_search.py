"""Ranked lexical search by best-first intervals of documents over range-maximum tables.

Postings of the query terms are counted once per document and written. Documents are then searched in slices.
A slice holds one posting list per term, in document order, with the impact of each posting, and a sparse table that
names the posting of greatest impact in any range of a list. A query starts from the interval of all documents
of the slice. An interval is bounded by the sum, over the terms, of the greatest impacts its ranges hold; the
interval with the highest bound comes first, gives up the document at its greatest weighted impact, which is scored,
and leaves the intervals to both sides. Intervals with few postings are scored outright, those that cannot
reach the lowest of the best documents so far are dropped. What a task has found bounds all its later slices.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from labelloom.llm.common import small_slices, square_root_buckets, strings
from labelloom.session import stored

RESULT = "item_id long, rank int, doc_id long, score long"
BLOCK_BYTES = 4 << 20
TEXT_BYTES = 8 << 20
# Postings in one slice; a single document with more stands alone.
SLICE_POSTINGS = 1 << 19
# Intervals with so few postings are scored outright, and so many are taken up at once.
FEW_POSTINGS = 1024
AT_ONCE = 32
NO_ID = (1 << 63) - 1

_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
TO_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and everything beyond ASCII, A-Z lower-cased."""
    return text.translate(TO_TERMS).split()


@dataclass
class Queries:
    """The items of one block: ids, and for each the numbers of its terms with their repeats."""

    ids: list[int | None]
    numbers: dict[bytes, int]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]

    @classmethod
    def of(cls, items: list[tuple[int | None, str]]) -> Queries:
        numbers: dict[bytes, int] = {}
        found = cls([], numbers, [], [])
        for item_id, text in items:
            counted = Counter(terms_of(text.encode()))
            if counted:
                found.ids.append(item_id)
                found.terms.append(np.array([numbers.setdefault(t, len(numbers)) for t in counted], dtype=np.int64))
                found.repeats.append(np.array(list(counted.values()), dtype=np.int64))
        return found


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, same, terms, counts`` of every document with a term; ``same`` is a hash of the other three."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text", TEXT_BYTES):
            rows, ids = [], batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, strings(batch.column("text"))):
                words = terms_of(text)
                if words:
                    held = Counter(map(numbers.get, words))
                    held.pop(None, None)
                    pairs = np.array(sorted(held.items()), dtype=np.int32).reshape(-1, 2)
                    same = xxhash.xxh3_128_digest(len(words).to_bytes(8, "little") + pairs.tobytes())
                    rows.append((doc_id, len(words), same, pairs[:, 0], pairs[:, 1]))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)],
                names=["doc_id", "n", "same", "terms", "counts"],
            )

    return read.mapInArrow(count, "doc_id long, n long, same binary, terms array<int>, counts array<int>")


@dataclass
class Best:
    """The best documents of one query so far: score descending, then id, a missing id last."""

    count: int
    scores: np.ndarray
    ids: np.ndarray
    unnamed: np.ndarray

    @classmethod
    def none(cls, count: int) -> Best:
        return cls(count, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool))

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        scores = np.concatenate([self.scores, scores])
        ids, unnamed = np.concatenate([self.ids, ids]), np.concatenate([self.unnamed, unnamed])
        order = np.lexsort((ids, unnamed, -scores))[: self.count]
        self.scores, self.ids, self.unnamed = scores[order], ids[order], unnamed[order]

    def beaten_by(self, bounds: np.ndarray, first_ids: np.ndarray) -> np.ndarray:
        """Whether a document with such a score at most, and such an id at least, may still enter."""
        if len(self.scores) < self.count:
            return bounds > 0
        lowest = self.scores[-1]
        return (bounds > lowest) | ((bounds == lowest) & (bounds > 0) & (first_ids <= self.ids[-1]))


class Slice:
    """Posting lists of some documents, with a sparse table of greatest impacts.

    Equal documents (length and postings) are one, with all their ids; only the ``count`` first ids can rank.
    """

    def __init__(self, ids: np.ndarray, unnamed: np.ndarray, lengths: np.ndarray, same: list[bytes],
                 sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, documents: int, words: int, count: int):
        order = np.lexsort((ids, unnamed))
        groups: dict[bytes, list[int]] = {}
        for row in order.tolist():
            members = groups.setdefault(same[row], [])
            if len(members) < count:
                members.append(row)
        self.members = list(groups.values())
        rows = np.array([m[0] for m in self.members], dtype=np.int64)
        self.ids, self.unnamed, self.size = ids, unnamed, len(rows)
        self.first_ids = ids[rows]
        starts = np.cumsum(sizes) - sizes
        held = sizes[rows]
        places = np.repeat(starts[rows] - (np.cumsum(held) - held), held) + np.arange(int(held.sum()))
        document = np.repeat(np.arange(self.size), held)
        terms, counts = terms[places].astype(np.int64), counts[places].astype(np.int64)
        # Whole numbers of Python: the product may leave 64 bits for very long texts.
        middle = np.array([75 + 25 * int(n) * documents // words for n in lengths[rows]], dtype=np.int64)
        impact = 1_000_000_000 * counts // (1000 * counts + 12 * middle[document])
        by_term = np.lexsort((document, terms))
        self.document, self.impact = document[by_term], impact[by_term]
        terms = terms[by_term]
        self.terms, first = np.unique(terms, return_index=True)
        self.ends = np.append(first[1:], len(terms))
        self.starts = first
        self.places = np.repeat(np.arange(len(self.terms)), self.ends - self.starts) * self.size + self.document
        # Equal impacts are told apart at random, so that splits halve long runs of them instead of peeling one off.
        self.order = (self.impact << 20) | np.random.default_rng(7).integers(0, 1 << 20, len(terms))
        longest = int((self.ends - self.starts).max(initial=1))
        self.table = np.zeros((longest.bit_length(), len(terms)), dtype=np.int32)
        self.table[0] = np.arange(len(terms))
        for level in range(1, longest.bit_length()):
            half = 1 << (level - 1)
            one, two = self.table[level - 1, :-half], self.table[level - 1, half:]
            self.table[level, : len(one)] = np.where(self.order[one] >= self.order[two], one, two)
        # floor(log2(n)) for each length of a range.
        self.levels = np.frexp(np.arange(longest + 1))[1].astype(np.int64) - 1

    def greatest(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The posting of greatest impact in each range; -1 for empty ranges."""
        lengths = ends - starts
        level = np.maximum(self.levels[lengths], 0)
        last = len(self.order) - 1
        one = self.table[level, np.minimum(starts, last)]
        two = self.table[level, np.maximum(ends - (1 << level), 0)]
        return np.where(lengths > 0, np.where(self.order[one] >= self.order[two], one, two), -1)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Offer all documents to ``best`` that may enter it; returns how many were scored."""
        at = np.searchsorted(self.terms, terms)
        here = (at < len(self.terms)) & (weights > 0)
        here[here] = self.terms[at[here]] == terms[here]
        at, weights = at[here], weights[here]
        if not len(at):
            return 0
        scored, number = 0, 0
        waiting: list[tuple[int, int, int, int, np.ndarray, np.ndarray, np.ndarray]] = []

        def take(low: np.ndarray, high: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
            nonlocal scored, number
            tops = self.greatest(starts, ends)
            gains = np.where(tops >= 0, self.impact[tops], 0) * weights
            bounds = gains.sum(axis=1)
            some = (high > low) & (bounds > 0)
            some[some] = best.beaten_by(bounds[some], self.first_ids[low[some]])
            few = some & ((ends - starts).sum(axis=1) <= FEW_POSTINGS)
            if few.any():
                scored += self._score(starts[few], ends[few], weights, best)
            for i in np.flatnonzero(some & ~few).tolist():
                split = int(self.document[tops[i, gains[i].argmax()]])
                number += 1
                heapq.heappush(waiting, (-int(bounds[i]), number, int(low[i]), int(high[i]), starts[i], ends[i], split))

        take(np.array([0]), np.array([self.size]), self.starts[at][None, :], self.ends[at][None, :])
        while waiting:
            chosen = [heapq.heappop(waiting) for _ in range(min(AT_ONCE, len(waiting)))]
            bounds, low = -np.array([c[0] for c in chosen]), np.array([c[2] for c in chosen])
            live = best.beaten_by(bounds, self.first_ids[low])
            if not live.any():
                if len(best.scores) == best.count and bounds[0] < best.scores[-1]:
                    break
                continue
            chosen = [c for c, keep in zip(chosen, live.tolist()) if keep]
            low, high, split = (np.array([c[i] for c in chosen]) for i in (2, 3, 6))
            starts, ends = np.stack([c[4] for c in chosen]), np.stack([c[5] for c in chosen])
            cut = np.searchsorted(self.places, at[None, :] * self.size + split[:, None])
            hit = (cut < ends) & (self.document[np.minimum(cut, len(self.document) - 1)] == split[:, None])
            own = (np.where(hit, self.impact[np.minimum(cut, len(self.document) - 1)], 0) * weights).sum(axis=1)
            self._offer(split, own, best)
            scored += len(split)
            take(
                np.concatenate([low, split + 1]), np.concatenate([split, high]),
                np.concatenate([starts, cut + hit]), np.concatenate([cut, ends]),
            )
        return scored

    def _score(self, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Score all documents of disjoint intervals, posting by posting."""
        flat, lengths = starts.ravel(), (ends - starts).ravel()
        offsets = np.cumsum(lengths) - lengths
        at = np.repeat(flat - offsets, lengths) + np.arange(int(lengths.sum()))
        gains = self.impact[at] * np.repeat(np.broadcast_to(weights, starts.shape).ravel(), lengths)
        order = np.argsort(self.document[at], kind="stable")
        documents, first = np.unique(self.document[at][order], return_index=True)
        self._offer(documents, np.add.reduceat(gains[order], first), best)
        return len(documents)

    def _offer(self, documents: np.ndarray, scores: np.ndarray, best: Best) -> None:
        enter = best.beaten_by(scores, self.first_ids[documents])
        documents, scores = documents[enter], scores[enter]
        if len(documents):
            rows = [self.members[d] for d in documents.tolist()]
            flat = np.array([row for members in rows for row in members], dtype=np.int64)
            best.add(np.repeat(scores, [len(r) for r in rows]), self.ids[flat], self.unnamed[flat])


def blocks_of(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[Row]]:
    """Distinct ``item_id, text`` in blocks of about ``block_bytes`` at most (one longer item stands alone or nearly so)."""
    read = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    read = stored(read.where("text IS NOT NULL").distinct(), "search-items")
    total = read.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = 1 + 2 * total // block_bytes if total > block_bytes else 1
    for block in range(blocks):
        yield read.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()


def ranked(docs: DataFrame, items: DataFrame, count: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``count`` best documents above score 0 of each item.

    Equal scores stand by ascending doc_id, a missing one last; every row is a document, so repeated rows
    rank once each. Items are told apart by id and text, equal rows are one item; null ids are kept as
    they are. Null, empty and termless texts are neither found nor count as documents. Without documents or
    items there are no rows; further columns are not read.

    Items are searched in blocks of ``block_bytes``, each against all documents; a task holds one block, one
    slice of postings, and the best documents of each item.
    """
    spark = docs.sparkSession
    found = None
    for block in blocks_of(items, block_bytes):
        queries = Queries.of([(row["item_id"], row["text"]) for row in block])
        if queries.ids:
            part = searched(docs, queries, count)
            found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], RESULT) if found is None else found


def searched(docs: DataFrame, queries: Queries, count: int) -> DataFrame:
    held = stored(postings(docs, queries.numbers), "postings")
    documents, words = held.agg(F.count("*"), F.sum("n")).first()
    words = words or 0
    holding = held.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(len(queries.numbers), dtype=np.int64)
    for row in holding:
        weights[row["term"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * row["count"] + 1)))
    asked = [(terms, weights[terms] * repeats) for terms, repeats in zip(queries.terms, queries.repeats)]
    item_ids = queries.ids

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best.none(count) for _ in asked]
        for held in slices(batches, documents, words, count):
            for (terms, wanted), mine in zip(asked, best):
                held.search(terms, wanted, mine)
        numbers = np.repeat(np.arange(len(asked)), [len(b.scores) for b in best])
        ids, unnamed, scores = (np.concatenate([getattr(b, name) for b in best]) for name in ("ids", "unnamed", "scores"))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(numbers, pa.int32()), pa.array([item_ids[n] for n in numbers.tolist()], pa.int64()),
                pa.array(ids, pa.int64(), mask=unnamed), pa.array(scores, pa.int64()),
            ],
            names=["item", "item_id", "doc_id", "score"],
        )

    tops = held.mapInArrow(search, "item int, item_id long, doc_id long, score long")
    # Two rounds, so that no task ranks the finds of all tasks for an item.
    salts = square_root_buckets(max(1, held.rdd.getNumPartitions()))
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    near = Window.partitionBy("item", "salt").orderBy(*order)
    last = Window.partitionBy("item").orderBy(*order)
    tops = tops.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    tops = tops.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= count)
    tops = tops.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= count)
    return tops.select("item_id", "rank", "doc_id", "score")


def slices(batches: Iterator[pa.RecordBatch], documents: int, words: int, count: int) -> Iterator[Slice]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = np.diff(batch.column("terms").offsets.to_numpy())
        start = 0
        while start < batch.num_rows:
            room = np.searchsorted(np.cumsum(sizes[start:]), SLICE_POSTINGS - size, side="right")
            stop = min(batch.num_rows, start + int(room))
            if stop == start and not held:
                stop = start + 1
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(sizes[start:stop].sum())
                start = stop
            if start < batch.num_rows:
                yield _slice(held, documents, words, count)
                held, size = [], 0
    if held:
        yield _slice(held, documents, words, count)


def _slice(held: list[pa.RecordBatch], documents: int, words: int, count: int) -> Slice:
    table = pa.Table.from_batches(held).combine_chunks()
    columns = {name: table.column(name).combine_chunks() for name in table.column_names}
    unnamed = columns["doc_id"].is_null().to_numpy(zero_copy_only=False)
    lists = columns["terms"]
    return Slice(
        columns["doc_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False), unnamed,
        columns["n"].to_numpy(), columns["same"].to_pylist(), np.diff(lists.offsets.to_numpy()),
        lists.flatten().to_numpy(), columns["counts"].flatten().to_numpy(), documents, words, count,
    )


_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)
SQL = f"""
    WITH docs AS (
        SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS words FROM documents),
    sized AS MATERIALIZED (SELECT row, doc_id, words, len(words) AS n FROM docs WHERE len(words) > 0),
    corpus AS (SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_words FROM sized),
    asked AS (
        SELECT item, item_id, term, count(*) AS q
        FROM (SELECT row_number() OVER () AS item, item_id, unnest({_TERMS}) AS term
              FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
    held AS MATERIALIZED (
        SELECT row, doc_id, n, term, count(*) AS tf
        FROM (SELECT row, doc_id, n, unnest(words) AS term FROM sized)
        WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    weights AS (
        SELECT term, floor(1000 * ln((2 * any_value(all_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, corpus GROUP BY term),
    scored AS (
        SELECT item, item_id, row, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * all_docs) // all_words))))::BIGINT AS score
        FROM asked JOIN held USING (term) JOIN weights USING (term), corpus
        GROUP BY ALL),
    listed AS (
        SELECT item_id, doc_id, score,
               row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST, row) AS rank
        FROM scored WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM listed WHERE rank <= 20"""
