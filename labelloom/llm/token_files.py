"""Token files: document ids and ids of tokens, with boundaries as Elias-Fano sequences.

A file holds the documents of one range of doc_ids in ascending order. Layout, all little-endian:

    magic "LLTOKEN1"; seven int64: documents, documents without id, tokens, bytes per id,
    smallest doc_id, low bits of the boundaries, low bits of the doc_ids
    Elias-Fano sequence of the documents + 1 boundaries (0 first, the number of tokens last)
    Elias-Fano sequence of the doc_ids, less the smallest, of the documents that have one
    the ids of all tokens

An Elias-Fano sequence of n numbers up to u keeps the floor(log2(u / n)) low bits of each number packed, the
rest as a unary bit string of at most n + u / 2^low bits, and every 256th one's place (uint32 from the start of
the unary part), so that ``select`` reads few words. That is within half a bit per number of the least possible.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.llm.common import small_slices, strings
from labelloom.session import new_path, stored

MAGIC = b"LLTOKEN1"
SAMPLE = 256
MANIFEST = "file string, part int, documents long, tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


@dataclass
class EliasFano:
    """A non-decreasing sequence of numbers from zero, with random access."""

    count: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th number, from one sample and the few words after it."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place // 8
        bits = np.unpackbits(self.high[byte : byte + SAMPLE], bitorder="little")
        bits[: place % 8] = 0
        seen = int(bits.sum())
        while seen <= left:
            left -= seen
            byte += SAMPLE
            bits = np.unpackbits(self.high[byte : byte + SAMPLE], bitorder="little")
            seen = int(bits.sum())
        place = byte * 8 + int(np.flatnonzero(bits)[left])
        return (place - i) << self.low_bits | self._low(np.array([i]))[0].item()

    def _low(self, index: np.ndarray) -> np.ndarray:
        found = np.zeros(len(index), dtype=np.int64)
        for b in range(self.low_bits):
            at = index * self.low_bits + b
            found |= ((self.low[at // 8] >> (at % 8).astype(np.uint8)) & 1).astype(np.int64) << b
        return found

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        index = np.arange(self.count)
        return (ones - index) << self.low_bits | self._low(index)

    def to_bytes(self) -> bytes:
        head = struct.pack("<4q", self.count, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int, low_bits: int) -> tuple[EliasFano, int]:
        count, low, high, samples = struct.unpack_from("<4q", data, at)
        at += 32
        parts = []
        for size, kind in ((low, "u1"), (high, "u1"), (samples, "<u4")):
            parts.append(np.frombuffer(data, dtype=kind, count=size, offset=at))
            at += parts[-1].nbytes
        return cls(count, low_bits, *parts), at


@dataclass
class TokenFile:
    """One file in memory: ``ids(i)`` and ``doc_ids`` answer from the packed sequences."""

    without_id: int
    smallest: int
    boundaries: EliasFano
    keys: EliasFano
    tokens: np.ndarray

    @classmethod
    def of(cls, doc_ids: list[int | None], lengths: list[int], tokens: np.ndarray) -> TokenFile:
        """Documents in ascending order of doc_id, those without one first."""
        known = [d for d in doc_ids if d is not None]
        smallest = known[0] if known else 0
        offsets = np.array([d - smallest for d in known], dtype=np.uint64)
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        return cls(len(doc_ids) - len(known), smallest, EliasFano.of(ends), EliasFano.of(offsets), tokens)

    def __len__(self) -> int:
        return self.boundaries.count - 1

    def ids(self, i: int) -> np.ndarray:
        return self.tokens[self.boundaries.select(i) : self.boundaries.select(i + 1)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.without_id + [self.smallest + int(k) for k in self.keys.all()]

    def to_bytes(self) -> bytes:
        head = struct.pack(
            "<7q", len(self), self.without_id, len(self.tokens), self.tokens.itemsize,
            self.smallest, self.boundaries.low_bits, self.keys.low_bits,
        )
        return MAGIC + head + self.boundaries.to_bytes() + self.keys.to_bytes() + self.tokens.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> TokenFile:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        _, without_id, count, width, smallest, low, key_low = struct.unpack_from("<7q", data, 8)
        boundaries, at = EliasFano.read(memoryview(data), 64, low)
        keys, at = EliasFano.read(memoryview(data), at, key_low)
        tokens = np.frombuffer(data, dtype=f"<u{width}", count=count, offset=at)
        return cls(without_id, smallest, boundaries, keys, tokens)


class WordEncoder:
    """Ids of texts by a tokenizer whose words never reach across white space.

    Each distinct stretch between blanks goes through the tokenizer once and is then looked up;
    the memory is emptied beyond ``remembered`` stretches or ``characters`` in them. Texts
    below U+0100 are lowered first, which the tokenizer does too, letter by letter, and one mark between
    a letter and a blank stands alone, as it does for the tokenizer. A text that may hold a special
    token is one stretch. Stretches of small letters alone, which normalising and splitting
    leave as they are, are encoded many at a time.
    """

    MARK = re.compile(r"([.,;:!?])(?<=[^\W_].)(?=[ \n])")
    PLAIN = re.compile("[a-zß-öø-ÿ]+")

    def __init__(self, file: str, end_id: int, remembered: int = 600_000, characters: int = 1 << 25):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end_id = Tokenizer.from_file(file), end_id
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.remembered, self.characters = remembered, characters
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.plain = None
        if suffix:
            self.plain = Tokenizer.from_file(file)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
            self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        """Keep the empty stretch and, under None, the end of a document."""
        self.place: dict[str | None, int] = {"": 0, None: 1}
        self.ids = np.array([self.end_id], dtype=self.kind)
        self.starts, self.lengths = np.zeros(2, dtype=np.int64), np.array([0, 1], dtype=np.int64)
        self.held = 0

    def _learn(self, words: list[str]) -> None:
        plain, ids = [], np.zeros(0, dtype=self.kind)
        if self.plain:
            plain = [w for w in words if self.PLAIN.fullmatch(w)]
            found = self.plain.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids
            ids = np.array(found, dtype=self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(plain):
                plain, ids = [], ids[:0]
        known = set(plain)
        rest = [w for w in words if w not in known]
        others = [x.ids for x in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        lengths = np.concatenate([np.diff(ends, prepend=0) if plain else [], [len(x) for x in others]]).astype(np.int64)
        self.place.update(zip(plain + rest, range(len(self.place), len(self.place) + len(words))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids, np.array([i for x in others for i in x], dtype=self.kind)])
        self.held += sum(map(len, words))

    def stretches(self, text: str) -> list[str]:
        if "<|" in text:
            return [text]
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            low = text
        else:
            low = self.MARK.sub(r" \1", text.lower())
        return low.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end id after each, and how many each text has."""
        if len(self.place) > self.remembered or self.held > self.characters:
            self._forget()
        words: list[str | None] = []
        firsts = []
        for text in texts:
            firsts.append(len(words))
            words += self.stretches(text)
            words.append(None)
        if not texts:
            return self.ids[:0], np.zeros(0, dtype=np.int64)
        at = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys(words[i] for i in missing)))
            at[missing] = [self.place[words[i]] for i in missing]
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(int(ends[-1]))]
        return ids, np.add.reduceat(lengths, firsts)


@cache
def word_encoder(file: str, end_id: int) -> WordEncoder:
    """One encoder for each Python worker and vocabulary."""
    return WordEncoder(file, end_id)


def write_token_files(
    docs: DataFrame, path: str, vocabulary: Callable[[], str], end_id: int = 1, file_bytes: int = 32 << 20
) -> DataFrame:
    """Encode ``doc_id, text`` into files below ``path``, a folder that all executors share; returns the manifest.

    ``vocabulary`` gives the tokenizer's file on an executor. Documents are dealt by ranges of
    doc_id (ties by a hash of the text) into files of about ``file_bytes`` of text. Null and empty
    texts hold the end id alone, a null doc_id comes first, repeated doc_ids stand side by
    side, further columns are not read, and an empty table gives one empty file. A repeated task
    writes the same bytes and moves them into place in one step.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = 1 + total // file_bytes

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary(), end_id)
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        pieces: list[np.ndarray] = []
        for batch in small_slices(batches, "text", 1 << 20):
            doc_ids += batch.column("doc_id").to_pylist()
            ids, counts = encoder.encode([t.decode("utf-8", "replace") for t in strings(batch.column("text"))])
            lengths += counts.tolist()
            pieces.append(ids)
        tokens = np.concatenate(pieces) if pieces else np.zeros(0, dtype=encoder.kind)
        part = TaskContext.get().partitionId()
        name = f"part-{part:07d}.tok"
        place, base = fs.FileSystem.from_uri(path)
        place.create_dir(base, recursive=True)
        unfinished = f"{base}/_{name}-{uuid.uuid4().hex}"
        with place.open_output_stream(unfinished) as out:
            out.write(TokenFile.of(doc_ids, lengths, tokens).to_bytes())
        place.move(unfinished, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict(
            {"file": [name], "part": pa.array([part], pa.int32()), "documents": [len(lengths)], "tokens": [len(tokens)]}
        )

    ordered = read.repartitionByRange(files, "doc_id", F.xxhash64("text")).sortWithinPartitions(
        "doc_id", F.xxhash64("text"), "text"
    )
    return stored(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files of a manifest.

    ``start`` counts the ids of all documents before. The manifest has one row per file, so its
    running sum is small work.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    count = manifest.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist()):
                with place.open_input_stream(f"{base}/{name}") as file:
                    held = TokenFile.from_bytes(file.read())
                ends = held.boundaries.all()
                sums = [
                    zlib.crc32(held.tokens[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:])
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(held.doc_ids(), pa.int64()),
                        pa.array(ends[:-1] + first),
                        pa.array(np.diff(ends)),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.repartition(max(1, count), "part").mapInArrow(read, DOCUMENTS)


def token_file_path(spark: SparkSession) -> str:
    return new_path(spark, "token-files")
