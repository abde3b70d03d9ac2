"""Secret scans through nested encodings.

A worklist holds layers: the text itself and whatever decodes out of it. Each layer is scanned, then
unwrapped: percent and Unicode escapes give one layer of the whole text, every base64 run (over line ends
too, and from each of its four alignments, so that letters before it do no harm) and every
compressed block a layer of its own. Bytes that are no UTF-8 are read as Latin-1 where that holds
anything to find. Each character of a layer knows the stretch of the
text it came from, so that what is found inside is reported where it stands.

Compressed content comes as a stream of all members or frames of its block, whatever its size, and is scanned in windows
that overlap; what follows a block, and blocks within blocks, are part of the layer around them. All
that is found in it stands for the whole stretch of its block.

A layer with the content and the stretch of an earlier one is not entered again, and no block that begins like
one it came out of, which ends cycles; every step but a compressed one shortens its layer.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import urllib.parse
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import small_slices, strings

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
    r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ESCAPE = re.compile(
    r"((?:%[0-9A-Fa-f]{2})+)|\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
    r"|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
)
ALPHABETS = (re.compile(r"[A-Za-z0-9+/]{16,}"), re.compile(r"[A-Za-z0-9_-]{16,}"))
SHORTEST = 16
# What stands in a percent-encoded token, and lines that end and begin with base64.
TOKEN = re.compile(r"(?:[!#$&-;=?-Z\[\]_a-z~]++|%[0-9A-Fa-f]{2})++")
LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++")
# Without one of these, bytes hold no match and nothing to unwrap.
HINT = re.compile(rb"[A-Za-z0-9+/_-]{16}|%[0-9A-Fa-f]{2}|\\[uUx]|&#|[pP][aA][sS][sS][wW]|[sS][eE][cC][rR]|[tT][oO][kK]|[aA][pP][iI]")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
# Read backwards: a word, run or escape, and lines of base64 before it.
RUN_OR_LINES = re.compile(rb"[A-Za-z0-9+/_=%\\&#;-]++(?:[ \t]*+\n\r?+[ \t]*+[A-Za-z0-9+/_-]{16,}+)*+")
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
PRINTABLE = 0.9
# Compressed content is read in windows of this size, which overlap, so that no match and no run is cut; only a run longer
# than LONGEST is read in parts. FEED bytes at most are decompressed at a time, and fewer where nothing bounds the output.
WINDOW = 2 << 20
OVERLAP = 4096
LONGEST = 16 << 20
FEED, FEED_UNBOUNDED = 1 << 16, 512
HEAD = 1 << 16

RUN_BYTE = np.zeros(256, dtype=bool)
RUN_BYTE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, layers long"

Span = tuple[int, int, int]


@dataclass
class Layer:
    """A text, and the stretch of the document that each of its characters came from; None for the document itself."""

    text: str
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start]), int(self.ends[end - 1])

    def below(self, text: str, starts: np.ndarray, ends: np.ndarray) -> Layer:
        """A layer of which character i came from ``starts[i]`` to ``ends[i]`` of this one."""
        if self.starts is None:
            return Layer(text, starts, ends)
        return Layer(text, self.starts[starts], self.ends[ends - 1])


def long_runs(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of at least ``SHORTEST`` letters, digits and +/_- in a row: all that base64, access keys and hexadecimal runs can stand in."""
    inside = RUN_BYTE[np.frombuffer(raw, dtype=np.uint8)]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[0::2], edges[1::2]
    long = ends - starts >= SHORTEST
    return starts[long], ends[long]


def runs_of(text: str) -> Iterator[tuple[int, str]]:
    """Start (in code points) and text of each long run."""
    raw = text.encode("utf-8", "surrogatepass")
    starts, ends = long_runs(raw)
    if len(raw) == len(text):
        places = starts
    else:
        heads = np.cumsum(np.frombuffer(raw, dtype=np.uint8) & 0xC0 != 0x80) if len(starts) else starts
        places = heads[starts] - 1 if len(starts) else starts
    for place, a, b in zip(places.tolist(), starts.tolist(), ends.tolist()):
        yield place, raw[a:b].decode("ascii")


def found_in(text: str) -> list[Span]:
    """``(start, kind, end)`` of the rules' matches in one text, kinds as numbers of KINDS."""
    spans: list[Span] = []
    if ":" in text or "=" in text:
        low = text.encode("utf-8", "surrogatepass").lower()
        if any(word in low for word in ASSIGN_WORDS):
            spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for at, run in runs_of(text):
        if "AKIA" in run:
            spans += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(run) if len(m[0]) >= 20]
        if len(run) >= 24:
            spans += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(run) if len(m[0]) >= 24]
    return sorted(spans)


class Source:
    """Bytes that arrive piece by piece; the last ones taken may be put back."""

    def __init__(self, pieces: Iterable[bytes | memoryview]):
        self.pieces, self.held, self.at, self.taken = iter(pieces), memoryview(b""), 0, 0

    def take(self, most: int) -> bytes:
        """At most so many bytes; none only at the end."""
        while self.at >= len(self.held):
            piece = next(self.pieces, None)
            if piece is None:
                return b""
            self.held, self.at = memoryview(piece), 0
        found = bytes(self.held[self.at : self.at + most])
        self.at += len(found)
        self.taken += len(found)
        return found

    def put_back(self, data: bytes) -> None:
        self.taken -= len(data)
        if self.at >= len(data):
            self.at -= len(data)
        else:
            self.held, self.at = memoryview(data + bytes(self.held[self.at :])), 0

    def fill(self, size: int) -> bytes:
        """So many bytes, or all that are left."""
        parts, missing = [], size
        while missing and (part := self.take(missing)):
            parts.append(part)
            missing -= len(part)
        return b"".join(parts)

    def ended(self) -> bool:
        piece = self.take(1)
        self.put_back(piece)
        return not piece


class Unpacking:
    """The content of a compressed block, as pieces: all its members or frames, one after the other.

    ``used`` bytes of the source held whole members; ``broken`` is set where bytes are no such block (any more), and
    where neither is, the source ended inside a member.
    """

    def __init__(self, source: Source):
        self.source, self.used, self.broken = source, 0, False

    def __iter__(self) -> Iterator[bytes]:
        began, first = self.source.taken, None
        while True:
            head = self.source.fill(6)
            self.source.put_back(head)
            opened = decoder(head)
            if opened is None or first not in (None, opened[0]):
                self.broken = self.broken or first is None
                return
            first, stream = opened
            try:
                yield from self._member(first, stream)
            except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError):
                self.broken = True
                return
            if not stream.eof:
                return
            self.source.put_back(stream.unused_data)
            self.used = self.source.taken - began

    def _member(self, kind: str, stream) -> Iterator[bytes]:
        # A few bytes of zstandard may stand for any number, and its decoder does not stop on the way.
        feed = FEED_UNBOUNDED if kind == "zstandard" else FEED
        while not stream.eof and (data := self.source.take(feed)):
            if kind == "zstandard":
                yield stream.decompress(data)
                continue
            yield stream.decompress(data, WINDOW)
            if kind in ("gzip", "zlib"):
                self.source.put_back(stream.unconsumed_tail)
            else:
                while not (stream.eof or stream.needs_input):
                    yield stream.decompress(b"", WINDOW)


def decoder(head: bytes):
    """What kind of compressed block begins so, and a new decoder; None for other bytes."""
    if head[:2] == b"\x1f\x8b":
        return "gzip", zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        return "zlib", zlib.decompressobj()
    if head[:3] == b"BZh":
        return "bzip2", bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return "xz", lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return "zstandard", zstandard.ZstdDecompressor().decompressobj()
    return None


@dataclass
class Block:
    """A compressed block at ``start`` to ``end`` of some bytes, what it holds, and a mark of its first bytes.

    Its end is unknown (``open``) if the bytes end before it does.
    """

    start: int
    end: int
    content: Source
    mark: bytes
    open: bool = False


def blocks_in(data: bytes, above: frozenset[bytes], start: int = 0) -> Iterator[Block]:
    """Compressed blocks among the bytes from ``start`` on, but for those that they themselves came out of (``above``).

    A block that fails on the way gives what it held up to there, and the search goes on behind its first byte.
    """
    after = start
    for m in MAGIC.finditer(data, start):
        if m.start() < after:
            continue
        at = m.start()
        mark = hashlib.blake2b(data[at : at + HEAD], digest_size=16).digest()
        if mark in above:
            continue
        block = Unpacking(Source([memoryview(data)[at:]]))
        content = Source(block)
        begin = content.fill(WINDOW)
        if not begin:
            continue
        if content.ended():
            held = Source([begin])
        else:
            while content.take(WINDOW):
                pass
            held = Source(Unpacking(Source([memoryview(data)[at:]])))
        unended = not block.used and not block.broken
        text, _, plain = read_as(begin)
        if block.used or plain or promising(begin, text):
            end = at + block.used if block.used else len(data)
            if block.used or (unended and plain):
                after = end
            yield Block(at, end, held, mark, unended)


def read_as(data: bytes) -> tuple[str, bool, bool]:
    """The bytes as UTF-8, or as Latin-1 where that fails; whether they are UTF-8, and mostly printable UTF-8."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1"), False, False
    shown = sum(c.isprintable() or c in "\t\n\r" for c in text)
    return text, True, bool(text) and shown >= PRINTABLE * len(text)


def promising(data: bytes, text: str) -> bool:
    """Whether bytes that are no plain text, read as ``text``, hold a match or anything to unwrap."""
    if HINT.search(data) is None:
        return False
    return bool(found_in(text)) or next(runs_of(text), None) is not None or ESCAPE.search(text) is not None


def char_bytes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of each character in UTF-8."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def without_percent_blocks(layer: Layer, above: frozenset[bytes]) -> Iterator[Stream]:
    """The content of each compressed block in a percent-encoded token, whose plain letters are bytes as well."""
    if "%" not in layer.text:
        return
    for m in TOKEN.finditer(layer.text):
        if "%" not in m[0]:
            continue
        escaped = np.frombuffer(m[0].encode("ascii"), dtype=np.uint8) == ord("%")
        digit = np.zeros(len(escaped), dtype=bool)
        digit[1:] |= escaped[:-1]
        digit[2:] |= escaped[:-2]
        starts = m.start() + np.flatnonzero(~digit)
        ends = np.append(starts[1:], m.end())
        # A plus is itself, or a space in the encoding of forms.
        for token in dict.fromkeys((m[0], m[0].replace("+", " "))):
            for block in blocks_in(urllib.parse.unquote_to_bytes(token), above):
                yield Stream.of(layer, int(starts[block.start]), int(ends[block.end - 1]), block, above)


def without_escapes(layer: Layer, above: frozenset[bytes]) -> Iterator[Layer | Stream]:
    """The layer with its percent and Unicode escapes decoded, and compressed blocks among the former."""
    text = layer.text
    if not ("%" in text or "\\" in text or "&#" in text):
        return
    yield from without_percent_blocks(layer, above)
    parts: list[str] = []
    # Stretches of characters: how many, where the first came from, how far apart, and how wide each.
    counts: list[int] = []
    firsts: list[int] = []
    apart: list[int] = []
    widths: list[int] = []

    def add(decoded: str, count: int, first: int, step: int, width: int) -> None:
        parts.append(decoded)
        counts.append(count)
        firsts.append(first)
        apart.append(step)
        widths.append(width)

    at = 0
    for m in ESCAPE.finditer(text):
        start, end = m.span()
        if m[1]:
            data = bytes.fromhex(m[1].replace("%", ""))
            decoded = data.decode("utf-8", "replace")
            if "\ufffd" in decoded:
                decoded = data.decode("latin-1")
            add(text[at:start], start - at, at, 1, 1)
            if len(decoded) == len(data):
                add(decoded, len(data), start, 3, 3)
            else:
                for c in decoded:
                    size = 3 * len(c.encode("utf-8"))
                    add(c, 1, start, 0, size)
                    start += size
        else:
            code = int(m[7]) if m[7] else int(m[m.lastindex], 16)
            if code > 0x10FFFF:
                continue
            add(text[at:start], start - at, at, 1, 1)
            add(chr(code), 1, start, 0, end - start)
        at = end
    if at:
        add(text[at:], len(text) - at, at, 1, 1)
        n = np.array(counts, dtype=np.int64)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(np.array(firsts), n) + place * np.repeat(np.array(apart), n)
        yield layer.below("".join(parts), starts, starts + np.repeat(np.array(widths), n))


def whole(start: int, end: int, inner: str) -> tuple[np.ndarray, np.ndarray]:
    """Every character of ``inner`` comes from the whole stretch."""
    return np.broadcast_to(np.int64(start), len(inner)), np.broadcast_to(np.int64(end), len(inner))


def wrapped(text: str) -> Iterator[list[tuple[int, int]]]:
    """Stretches of the lines of each base64 block over several lines: all as long but the first and the last."""
    if "\n" not in text:
        return
    for m in LINES.finditer(text):
        lines = [x.span() for x in LINE.finditer(text, m.start(), m.end())]
        at = 0
        while at < len(lines):
            taken, width = [lines[at]], lines[at][1] - lines[at][0]
            for start, end in (lines[i] for i in range(at + 1, len(lines))):
                size = end - start
                width = max(width, size) if len(taken) == 1 else width
                if size > width:
                    break
                taken.append((start, end))
                if size < width:
                    break
            if len(taken) > 1:
                yield taken
            at += len(taken)


def stops(last: np.ndarray, size: int, places: np.ndarray, ended: int) -> np.ndarray:
    """Where bytes that end at ``last`` of ``size`` end in the text, from the places of their letters."""
    return np.where(last == size, ended, places[np.minimum((last * 4 + 2) // 3, len(places)) - 1] + 1)


def decoded_base64(layer: Layer, packed: str, places: np.ndarray, other: bytes | None, above: frozenset[bytes]) -> Iterator[Layer | Stream]:
    """Layers of base64 letters that stand at ``places``: from the first alignment that gives plain text or one whole block, else from all."""
    after = int(places[-1]) + 1
    end = after + len(layer.text[after : after + 2]) - len(layer.text[after : after + 2].lstrip("="))
    for skip in range(4):
        piece, at = packed[skip:], places[skip:]
        if len(piece) % 4 == 1:
            piece, at = piece[:-1], at[:-1]
        data = base64.b64decode(piece + "=" * (-len(piece) % 4), altchars=other)
        ended = end if len(at) + skip == len(places) else int(at[-1]) + 1
        rest = data
        for block in blocks_in(data, above):
            rest = rest[: block.start] + bytes(block.end - block.start) + rest[block.end :]
            stop = int(stops(np.array(block.end), len(data), at, ended))
            yield Stream.of(layer, int(at[block.start * 4 // 3]), stop, block, above)
        if not any(rest):
            return
        inner, utf8, plain = read_as(rest)
        if plain or promising(rest, inner):
            first = np.arange(len(data))
            first, last = char_bytes(inner) if utf8 else (first, first + 1)
            yield layer.below(inner, at[first * 4 // 3], stops(last, len(data), at, ended))
            if plain:
                return


def without_base64(layer: Layer, above: frozenset[bytes]) -> Iterator[Layer | Stream]:
    """The layers of each run, in the plain or the URL alphabet, that decodes to text or to a compressed block."""
    text, joined = layer.text, set()
    for lines in wrapped(text):
        packed = "".join(text[a:b] for a, b in lines)
        url = "-" in packed or "_" in packed
        if url and ("+" in packed or "/" in packed):
            continue
        places = np.concatenate([np.arange(a, b) for a, b in lines])
        for inner in decoded_base64(layer, packed, places, b"-_" if url else None, above):
            joined.update(a for a, _ in lines)
            yield inner
    for place, run in runs_of(text):
        if place in joined:
            continue
        for alphabet, other in zip(ALPHABETS, (None, b"-_")):
            for m in alphabet.finditer(run):
                if other and "-" not in m[0] and "_" not in m[0]:
                    continue
                at = place + m.start()
                yield from decoded_base64(layer, m[0], np.arange(at, at + len(m[0])), other, above)


@dataclass
class Stream:
    """Content of a compressed block, which came as a whole from ``start`` to ``end`` of the document."""

    source: Source
    start: int
    end: int
    above: frozenset[bytes]
    carry: bytes = b""

    @classmethod
    def of(cls, layer: Layer, start: int, end: int, block: Block, above: frozenset[bytes]) -> Stream:
        return cls(block.content, *layer.place(start, end), above | {block.mark})

    def window(self) -> tuple[bytes, bytes]:
        """The next window, and that part of it that belongs to the next one as well (none at the end)."""
        data = self.carry + self.source.fill(WINDOW)
        while not self.source.ended():
            keep = max(0, len(data) - OVERLAP)
            run = RUN_OR_LINES.match(data[:keep][::-1])
            begin = keep - (run.end() if run else 0)
            if begin or len(data) >= LONGEST:
                return data, data[begin or keep :]
            data += self.source.fill(WINDOW)
        return data, b""


def scanned(text: str) -> tuple[list[Span], list[Span], int]:
    """Spans of the text itself, all spans with those of its layers, and how many layers there are."""
    base = found_in(text)
    spans, seen = set(base), set()
    work: list[tuple[Layer, frozenset[bytes]] | Stream] = [(Layer(text), frozenset())]
    layers = 0
    while work:
        item = work.pop()
        if isinstance(item, Stream):
            work += next_window(item, spans)
            continue
        layer, above = item
        for inner in (*without_escapes(layer, above), *without_base64(layer, above)):
            if isinstance(inner, Stream):
                layers += 1
                work.append(inner)
                continue
            if not inner.text:
                continue
            stretch = inner.place(0, len(inner.text))
            mark = (hashlib.blake2b(inner.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), stretch)
            if mark in seen:
                continue
            seen.add(mark)
            layers += 1
            for start, kind, end in found_in(inner.text):
                a, b = inner.place(start, end)
                spans.add((a, kind, b))
            work.append((inner, above))
    return base, sorted(spans), layers


def next_window(stream: Stream, spans: set[Span]) -> list[tuple[Layer, frozenset[bytes]] | Stream]:
    """Scan the next window of a stream; returns what is to be done then, the last first."""
    data, carry = stream.window()
    if not data:
        return []
    todo: list[tuple[Layer, frozenset[bytes]] | Stream] = [stream] if carry else []
    text = read_as(data)[0]
    spans.update((stream.start, kind, stream.end) for _, kind, _ in found_in(text))
    known, stream.carry = max(0, len(stream.carry) - 6), carry
    if HINT.search(data):
        todo.append((Layer(text, *whole(stream.start, stream.end, text)), stream.above))
    for block in blocks_in(data, stream.above, known):
        above = stream.above | {block.mark}
        if block.open and carry:
            # Goes on behind this window: its bytes come from the stream, which continues where the block ends.
            stream.source.put_back(data[block.start :])
            stream.carry = b""
            todo.append(Stream(Source(Unpacking(stream.source)), stream.start, stream.end, above))
            break
        todo.append(Stream(block.content, stream.start, stream.end, above))
    return todo


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def found(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, layers`` of every row of ``docs``.

    Positions are code points of the whole text; null counts as empty and has no spans. Equal
    spans found in several layers are listed once. Repeated rows get equal results, further columns are not
    read, an empty table gives no rows.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [part.split()[0] for part in RESULT.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text", 16 << 20):
            rows = []
            for text in strings(batch.column("text")):
                base, spans, layers = scanned(text.decode("utf-8", "replace"))
                counts = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), layers))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    return read.mapInArrow(scan, RESULT)
