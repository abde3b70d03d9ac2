"""Quality scores from compression: text resembles what compresses it better.

Two zstandard dictionaries are built from pieces of good and of bad labelled texts. A text is
compressed in blocks with either one; the difference of the two sizes over their sum, with the
share of bytes that remain, is turned into a probability by logistic regression on labelled
texts from which no dictionary was built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import held_out, small_slices, strings, unit_hash

BLOCK = 2048
LEVEL = 3
FEATURES = "label int, difference double, remaining double, size double"


def blocks(text: bytes) -> Iterator[bytes]:
    for at in range(0, len(text), BLOCK):
        yield text[at : at + BLOCK]


def compressors(dictionaries: list[bytes]) -> list[zstandard.ZstdCompressor]:
    made = []
    for content in dictionaries:
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(level=LEVEL)
        made.append(
            zstandard.ZstdCompressor(
                level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False
            )
        )
    return made


def features(text: bytes, bad: zstandard.ZstdCompressor, good: zstandard.ZstdCompressor) -> tuple[float, float, float]:
    """Normalised size difference (above zero: closer to good text), share of bytes that remain, log size."""
    if not text:
        return 0.0, 1.0, 0.0
    with_bad = with_good = 0
    for block in blocks(text):
        with_bad += len(bad.compress(block))
        with_good += len(good.compress(block))
    total = with_bad + with_good
    return (with_bad - with_good) / total, total / 2 / len(text), float(np.log1p(len(text)))


def design(rows: np.ndarray) -> np.ndarray:
    """Columns of the regression from difference, share and log size."""
    difference, share, size = rows.T
    left = np.log(np.clip(share, 1e-4, 4.0))
    return np.column_stack([np.ones(len(rows)), difference, left, left**2, size, difference * size])


@dataclass
class QualityModel:
    dictionaries: list[bytes]
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        x = (design(rows) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))


def calibrated(dictionaries: list[bytes], rows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> QualityModel:
    """Logistic regression by Newton steps, with a small ridge so that separable classes stay finite."""
    x = design(rows)
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    mean[0], spread[0] = 0.0, 1.0
    x = (x - mean) / spread
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (weight * (labels - p)) - 1e-2 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return QualityModel(dictionaries, mean, spread, w)


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, float]]:
    """Texts of at most about ``most`` labelled rows a class, with the share of the class that was taken.

    Which rows are taken follows from a hash of their id. The ids, whose number the bound
    limits, are broadcast, so that only their texts are shuffled; of several texts with one id the first by
    code point is taken.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where("label IN (0, 1)").where(~held_out())
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    shares = {label: min(1.0, most / n) for label, n in counts.items()}
    share = F.element_at(F.create_map(*[F.lit(x) for kv in (shares or {0: 0.0}).items() for x in kv]), F.col("label"))
    taken = known.where(unit_hash("doc_id", salt="quality") < share).limit(3 * most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    halves = F.when(unit_hash("doc_id", salt="half") < 0.5, "dictionary").otherwise("calibration")
    chosen = texts.join(F.broadcast(taken.distinct()), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return chosen.withColumn("half", halves), shares


def spread_blocks(text: bytes, pieces: int) -> list[bytes]:
    """So many blocks of a text, evenly from its whole length; all of a shorter one."""
    cut = list(blocks(text))
    if len(cut) <= pieces:
        return cut
    return [cut[(2 * i + 1) * len(cut) // (2 * pieces)] for i in range(pieces)]


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, dictionary_bytes: int = 1 << 16, pieces: int = 4) -> QualityModel | None:
    """Fit on a sample of at most about ``most`` labelled documents a class; None unless both classes occur.

    Half of the sample gives the dictionaries, of each text at most ``pieces`` blocks of 2 KB, evenly from its whole
    length; the other half, whole, gives the calibration.
    Too few pieces for zstandard's builder are joined into a plain dictionary.
    """
    sample, shares = _labelled(docs, labels, most)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for label, text in zip(batch.column("label").to_pylist(), strings(batch.column("text"))):
                found += [(label, piece) for piece in spread_blocks(text, pieces)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary())],
                names=["label", "piece"],
            )

    by_label: dict[int, list[bytes]] = {0: [], 1: []}
    for row in sample.where("half = 'dictionary'").select("label", "text").mapInArrow(cut, "label int, piece binary").collect():
        by_label[row["label"]].append(bytes(row["piece"]))
    if not all(by_label.values()):
        return None
    dictionaries = []
    for label in (0, 1):
        held = sorted(by_label[label])
        try:
            dictionaries.append(zstandard.train_dictionary(dictionary_bytes, held).as_bytes())
        except zstandard.ZstdError:
            dictionaries.append((b"".join(held)[:dictionary_bytes]).ljust(8, b" "))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = compressors(dictionaries)
        for batch in batches:
            rows = np.array([features(t, bad, good) for t in strings(batch.column("text"))]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), *[pa.array(rows[:, i]) for i in range(3)]],
                names=["label", "difference", "remaining", "size"],
            )

    found = sample.where("half = 'calibration'").select("label", "text").mapInArrow(measure, FEATURES).toPandas()
    if found["label"].nunique() < 2:
        return None
    weight = 1 / found["label"].map(shares).to_numpy(dtype=float)
    rows = found[["difference", "remaining", "size"]].to_numpy(dtype=float)
    return calibrated(dictionaries, rows, found["label"].to_numpy(dtype=float), weight / weight.mean())


def score(docs: DataFrame, model: QualityModel | None, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    The whole text is compressed, block by block. Null and empty texts count as a text of no
    bytes; without a model every score is 0.5. Repeated rows are scored alike, further
    columns are not read, an empty table gives no rows.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = compressors(model.dictionaries) if model else (None, None)
        for batch in small_slices(batches, "text", 16 << 20):
            if model:
                rows = np.array([features(t, bad, good) for t in strings(batch.column("text"))]).reshape(-1, 3)
                scores = model.scores(rows)
            else:
                scores = np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return read.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")


def accuracy(scored: pd.DataFrame, labels: pd.DataFrame) -> float:
    """Share of held-out labelled documents whose prediction is right."""
    both = scored[scored["held_out"]].merge(labels, on="doc_id")
    return float((both["predicted"] == both["quality"]).mean())
