"""Records of CSV files, whose quoted fields may span lines, read by many tasks per file.

A line break ends a record if the number of quotes before it in the file is even; doubled quotes inside a field do not
change that. Spark splits files between lines; a first pass counts the quotes of each split, and the parity of all earlier splits
of the file tells in which state a split begins. A second pass joins lines into records as they come. Of a
record that lies in several splits each gives its part, at most two a split, and only these parts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.session import stored
from labelloom.sizing import MAX_DIMENSION_ROWS, small_table

SPLIT = ["file", "block"]
# What a piece of text is to its record.
WHOLE, HEAD, MIDDLE, TAIL = range(4)
PIECES = "file string, block long, kind int, first boolean, text string"


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``text, header``: every record that is not empty, its line breaks inside quotes kept; ``header`` marks the first of a file.

    Fields that hold quotes or line breaks must be quoted, with quotes doubled. A record that no quote closes ends with its
    file. A carriage return before the line feed that ends a record belongs to the break.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
        (F.length("value") - F.length(F.replace("value", F.lit('"')))).cast("int").alias("quotes"),
    )
    counted = lines.groupBy(*SPLIT).agg((F.sum("quotes") % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = counted.select(*SPLIT, (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("open"))
    # One row per split.
    known = lines.join(small_table(states, MAX_DIMENSION_ROWS), SPLIT)
    pieces = stored(known.mapInArrow(joined_lines, PIECES), "csv-pieces")
    whole = pieces.where(F.col("kind") == WHOLE).select(_without_return("text").alias("text"), "first")
    parts = pieces.where(F.col("kind") != WHOLE)
    # A record over several splits is named by the split in which it begins.
    earlier = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.last(F.when(F.col("kind") == TAIL, F.col("block")), ignorenulls=True).over(earlier)
    part = F.struct("block", "text")
    stitched = (
        parts.withColumn("begins", begins)
        .groupBy("file", "begins")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["text"]), "\n").alias("text"), F.bool_or("first").alias("first"))
    )
    found = whole.unionByName(stitched.select(_without_return("text").alias("text"), "first"))
    return found.where("text <> ''").select("text", F.col("first").alias("header"))


def _without_return(name: str):
    return F.regexp_replace(name, "\r$", "")


def joined_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and parts of records from the lines of one split after the other."""
    split, held = None, Split()
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy()
        files = batch.column("file").dictionary_encode()
        number = files.indices.to_numpy()
        edges = np.flatnonzero((block[1:] != block[:-1]) | (number[1:] != number[:-1])) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            here = (files.dictionary[int(number[start])].as_py(), int(block[start]))
            if here != split:
                if split is not None:
                    yield held.ended()
                split, held = here, Split(*here, batch.column("open")[start].as_py())
            yield held.pieces(batch.column("value").slice(start, end - start), batch.column("quotes").slice(start, end - start).to_numpy())
    if split is not None:
        yield held.ended()


class Split:
    """Lines of one split as they come; ``lines`` are those of the record that is open."""

    def __init__(self, file: str = "", block: int = 0, opened: bool = False):
        self.file, self.block = file, block
        self.odd = opened
        # The open record began before this split.
        self.inherited = opened
        self.lines: list[str] = []
        self.first = block == 0

    def pieces(self, values: pa.Array, quotes: np.ndarray) -> pa.RecordBatch:
        odd = (np.cumsum(quotes) + self.odd) % 2 == 1
        found: list[tuple[int, str]] = []
        ends = np.flatnonzero(~odd)
        text = values.to_pylist()
        start = 0
        for end in ends.tolist():
            if end == start and not self.lines and not self.inherited:
                found.append((WHOLE, text[end]))
            else:
                self.lines += text[start : end + 1]
                found.append((HEAD if self.inherited else WHOLE, "\n".join(self.lines)))
                self.lines, self.inherited = [], False
            start = end + 1
        self.lines += text[start:]
        self.odd = bool(odd[-1])
        return self._batch(found)

    def ended(self) -> pa.RecordBatch:
        """What is left of a record that goes on in the next split."""
        if not self.lines:
            return self._batch([])
        return self._batch([(MIDDLE if self.inherited else TAIL, "\n".join(self.lines))])

    def _batch(self, found: list[tuple[int, str]]) -> pa.RecordBatch:
        first = np.zeros(len(found), dtype=bool)
        if found and self.first:
            first[0], self.first = True, False
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.file] * len(found), pa.string()), pa.array([self.block] * len(found), pa.int64()),
                pa.array([kind for kind, _ in found], pa.int32()), pa.array(first), pa.array([text for _, text in found], pa.string()),
            ],
            names=["file", "block", "kind", "first", "text"],
        )
