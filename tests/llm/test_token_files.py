import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from labelloom.llm import token_files as files  # noqa: E402
from labelloom.llm.queries import word_vocabulary  # noqa: E402


@given(st.lists(st.integers(0, 10**9), max_size=600))
@settings(max_examples=60, deadline=None)
def test_elias_fano_gives_back_every_number(values):
    values = sorted(values)
    held = files.EliasFano.of(np.array(values, dtype=np.uint64))
    packed, _ = files.EliasFano.read(memoryview(held.to_bytes()), 0, held.low_bits)
    assert packed.all().tolist() == values
    assert [packed.select(i) for i in range(len(values))] == values


def test_size_is_near_the_least_possible():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    held = files.EliasFano.of(values)
    bits = 8 * (held.low.nbytes + held.high.nbytes + held.samples.nbytes)
    assert bits / len(values) < 2 + np.ceil(np.log2(values[-1] / len(values))) + 0.5


def test_file_round_trip():
    tokens = np.arange(20, dtype="<u2")
    held = files.TokenFile.from_bytes(files.TokenFile.of([None, -5, -5, 70], [3, 1, 0, 16], tokens).to_bytes())
    assert held.doc_ids() == [None, -5, -5, 70]
    assert [held.ids(i).tolist() for i in range(4)] == [[0, 1, 2], [3], [], list(range(4, 20))]


ODD = [
    "It's, we'll. x², 5. a_, <|startoftext|> b", "Σίσυφος ΟΔΟΣ, é x", "a\x1cb c\x85d e\u00a0f", "İ ſ, ﬁ", "!!. a!!, b., c",
    "", "  \n\t a", "é" * 300 + " b, c", "«a», µ. ª, ß? ", "e\u0301 ,", "\u4e2d\u6587, x",
]


def test_encoder_equals_the_tokenizer():
    tokenizer = Tokenizer.from_file(word_vocabulary())
    encoder = files.WordEncoder(word_vocabulary(), 1, remembered=20)
    for texts in (ODD, ODD[::-1], ODD[:3]):
        ids, lengths = encoder.encode(texts)
        ends = np.cumsum(lengths)
        for text, a, b in zip(texts, ends - lengths, ends):
            assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1], text


def test_files_of_odd_documents(spark, odd_documents, odd_rows):
    path = files.token_file_path(spark)
    manifest = files.write_token_files(odd_documents, path, word_vocabulary, file_bytes=20_000)
    assert manifest.count() > 3
    found = files.read_token_files(manifest, path).collect()
    tokenizer = Tokenizer.from_file(word_vocabulary())
    expected = Counter()
    for doc_id, text, *_ in odd_rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        expected[doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == expected
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0] + [r.n_tokens for r in ordered])[:-1].tolist()
    ids = [r.doc_id for r in ordered if r.doc_id is not None]
    assert ids == sorted(ids) and ordered[0].doc_id is None


def test_no_documents(spark, no_documents):
    path = files.token_file_path(spark)
    assert files.read_token_files(files.write_token_files(no_documents, path, word_vocabulary), path).count() == 0
