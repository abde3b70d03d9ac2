"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import held_out, small_slices, strings, unit_hash

UNKNOWN = "und"
ORDERS = (1, 2, 3)
# Numbers that the table of log probabilities may hold; more languages get fewer slots each, 2^10 at least.
MOST_NUMBERS = 1 << 24
MOST_BITS, LEAST_BITS = 16, 10
END = 0x110000
STRETCH = 1 << 20
SMOOTHING = 0.5
# A long text would make every posterior 0 or 1; the evidence counts as that of so many n-grams.
EVIDENCE = 200.0


@cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 32 if it is no letter; 0 for END."""
    found = np.full(END + 1, 32, dtype=np.uint32)
    for i in range(END):
        c = chr(i)
        if c.isalpha():
            found[i] = ord(c.lower()[0])
    found[END] = 0
    return found


class Grams:
    """The n-grams of a batch of texts as slots, all texts in one array.

    A run of other characters counts as one blank. Each text starts and ends with a blank;
    longer texts are cut after every ``STRETCH`` characters, and no n-gram reaches over a cut.
    """

    def __init__(self, texts: list[bytes]):
        parts, owners = [], []
        blank, end = np.array([32], dtype=np.uint32), np.array([32, END], dtype=np.uint32)
        for i, text in enumerate(texts):
            codes = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")
            for at in range(0, max(1, len(codes)), STRETCH):
                parts += [blank, codes[at : at + STRETCH], end]
                owners.append(i)
        found = letters()[np.concatenate(parts)] if parts else np.zeros(0, dtype=np.uint32)
        self.codes = found[(found != 32) | np.concatenate([[True], found[:-1] != 32])] if parts else found
        self.ends = np.flatnonzero(self.codes == 0)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]).astype(np.int64)
        self.owners, self.texts = np.array(owners, dtype=np.int64), len(texts)

    def slots(self, n: int, bits: int) -> np.ndarray:
        """The slot, of 2^bits, of the n-gram that starts at each place; 2^bits where it would reach over an end."""
        codes, size = self.codes, len(self.codes)
        found = np.full(size, 1 << bits, dtype=np.int64)
        if size >= n:
            mixed = np.full(size - n + 1, n, dtype=np.uint32)
            for j in range(n):
                mixed *= np.uint32(0x01000193)
                mixed += codes[j : size - n + 1 + j]
            mixed *= np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x85EBCA77)
            found[: size - n + 1] = mixed >> np.uint32(32 - bits)
            over = (self.ends[:, None] - np.arange(n)).ravel()
            found[over[over >= 0]] = 1 << bits
        return found

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the places of each text."""
        if not len(values):
            return np.zeros(self.texts)
        return np.bincount(self.owners, weights=np.add.reduceat(values, self.starts), minlength=self.texts)


@dataclass
class LanguageModel:
    """Log probabilities: one row per language, one column per slot and a last one of zeros."""

    languages: list[str]
    logs: np.ndarray

    @property
    def bits(self) -> int:
        return (self.logs.shape[1] - 1).bit_length() - 1

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Of each text the likelier language and its share of the posterior; ties go to the first by code point."""
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        grams = Grams(texts)
        sums, seen = np.zeros((len(self.languages), len(texts))), np.zeros(len(texts))
        for n in ORDERS:
            slots = grams.slots(n, self.bits)
            seen += grams.by_text((slots != 1 << self.bits).astype(np.float64))
            for i, logs in enumerate(self.logs):
                sums[i] += grams.by_text(logs[slots])
        sums *= np.minimum(1.0, EVIDENCE / np.maximum(seen, 1.0))
        best = sums.argmax(axis=0)
        shares = np.exp(sums - sums.max(axis=0))
        lettered = grams.by_text((grams.codes > 32).astype(np.float64)) > 0
        scores = np.where(lettered, 1 / shares.sum(axis=0), 0.0)
        return [self.languages[b] if known else UNKNOWN for b, known in zip(best, lettered)], scores


def slot_bits(languages: int) -> int:
    """As many slots a language as keep the table within ``MOST_NUMBERS``; fails where too few would be left."""
    bits = min(MOST_BITS, (MOST_NUMBERS // max(1, languages)).bit_length() - 1)
    if bits < LEAST_BITS:
        raise ValueError(f"{languages} languages are too many for one table; is lang a column of languages?")
    return bits


def fit(docs: DataFrame, most: int = 4000) -> LanguageModel:
    """Learn every language of the column, from at most about ``most`` documents of each.

    Which documents are taken follows from a hash of their id. Counts are summed per task and by key, and reach
    the driver one language after the other. The table holds at most ``MOST_NUMBERS`` numbers: up to 256
    languages have 2^16 slots each, more have fewer, and beyond 16,384 the fit fails.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    known = known.where(~held_out())
    sizes = {row["lang"]: row["n"] for row in known.groupBy("lang").agg(F.count("*").alias("n")).limit((MOST_NUMBERS >> LEAST_BITS) + 1).collect()}
    bits = slot_bits(len(sizes))
    slots = 1 << bits
    if not sizes:
        return LanguageModel([], np.zeros((0, slots + 1)))
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, most / n)) for lang, n in sizes.items()], "lang string, share double")
    taken = known.join(F.broadcast(shares), "lang").where(unit_hash("doc_id", salt="language") < F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text", 2 << 20):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), strings(batch.column("text"))):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                grams = Grams(texts)
                lettered = grams.by_text((grams.codes > 32).astype(np.float64)) > 0
                if not lettered.all():
                    # Texts without letters teach nothing, whatever batch they are in.
                    grams = Grams([text for text, known in zip(texts, lettered.tolist()) if known])
                total = np.zeros(slots, dtype=np.int64)
                if len(grams.codes):
                    for n in ORDERS:
                        total += np.bincount(grams.slots(n, bits), minlength=slots + 1)[:slots]
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])],
                    names=["lang", "slot", "n"],
                )

    summed = taken.select("lang", "text").mapInArrow(count, "lang string, slot int, n long")
    summed = summed.groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    # At most one entry per slot in a list.
    listed = summed.groupBy("lang").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("counts"))
    found = {row["lang"]: (np.array(row["slots"]), np.array(row["counts"])) for row in listed.toLocalIterator()}
    languages = sorted(found)
    logs = np.zeros((len(languages), slots + 1))
    for i, lang in enumerate(languages):
        total = np.full(slots, SMOOTHING)
        total[found[lang][0]] += found[lang][1]
        logs[i, :slots] = np.log(total / total.sum())
    return LanguageModel(languages, logs)


def predictions(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, from its whole text alone.

    Null, empty and letterless texts are ``und`` with score 0, as is everything if no language
    was learned. Repeated rows get equal results, further columns are not read, and no rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text", 2 << 20):
            languages, scores = sent.value.predict(strings(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(languages, pa.string()), pa.array(scores)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return read.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def in_known_language(docs: DataFrame, model: LanguageModel, least: float = 0.4) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is known with at least this score.

    Null, empty and letterless texts have no known language and go; repeated rows stay or go alike, null ids are
    kept as they are, no rows give no rows, and if no language was learned none stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text", 2 << 20):
            languages, scores = sent.value.predict(strings(batch.column("text")))
            yield batch.filter(pa.array([lang != UNKNOWN and s >= least for lang, s in zip(languages, scores)]))

    return docs.mapInArrow(keep, docs.schema)
