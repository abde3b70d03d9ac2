import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelloom.llm import decontamination as d
from labelloom.llm.fm_index import FMIndex, Wavelet

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items):
    windows = {}
    for item, text in items:
        words = WORD.findall(low(text))
        size = min(10, len(words))
        for j in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[j : j + size]), set()).add(item)
    found = []
    for doc_id, text in docs:
        words, hit, ids = WORD.findall(low(text)), set(), set()
        for size in set(map(len, windows)):
            for j in range(len(words) - size + 1):
                if (held := windows.get(tuple(words[j : j + size]))) is not None:
                    ids |= held
                    hit.update(range(j, j + size))
        named = sorted(str(i) for i in ids if i is not None)
        found.append((str(doc_id), len(words), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(found)


def result(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


@given(st.lists(st.integers(1, 4), min_size=1, max_size=80), st.lists(st.integers(1, 4), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_search_and_locate(text, pattern):
    index = FMIndex(np.array(text), 6)
    lows, highs = index.search(np.array([pattern]), np.array([len(pattern)]))
    places = sorted(index.locate(np.arange(lows[0], highs[0])).tolist())
    assert places == [i for i in range(len(text)) if text[i : i + len(pattern)] == pattern]


def test_wavelet_ranks():
    values = np.random.default_rng(4).integers(0, 37, 1000)
    held = Wavelet(values, 37)
    at = np.random.default_rng(5).integers(0, 1001, 300)
    symbols = np.random.default_rng(6).integers(0, 37, 300)
    assert held.rank(symbols, at).tolist() == [int((values[:a] == s).sum()) for s, a in zip(symbols, at)]
    found, before = held.access(np.arange(1000))
    assert (found == values).all()
    assert before.tolist() == [int((values[:i] == v).sum()) for i, v in enumerate(values)]


def test_words_and_hashes():
    texts = ["Ab-c é1_2 中文x", "", "...", "x" * 5000 + " AB ab"]
    words = d.Words.of([t.encode() for t in texts])
    expected = [(i, w) for i, t in enumerate(texts) for w in WORD.findall(low(t))]
    assert words.text.tolist() == [i for i, _ in expected]
    assert [words.letters(np.array([i]))[0].tobytes().decode() for i in range(len(expected))] == [w for _, w in expected]
    assert len(set(words.hashes.tolist())) == len({w for _, w in expected})


def test_equal_hashes_of_other_words_do_not_match(monkeypatch):
    held = d.Benchmark([1], [b"alpha beta gamma"])
    shard = d.Words.of([b"alpha beta gamma", b"alpha bexx gamma", b"alpha beta gammas"])
    clash = d.Words.of([b"beta"]).hashes[0]
    shard.hashes[4] = clash
    shard.hashes[8] = d.Words.of([b"gamma"]).hashes[0]
    assert [p.tolist() for p, _ in held.occurrences(shard)] == [[0]]


@pytest.mark.parametrize("block_bytes", [1500, 8 << 20])
def test_documents_against_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(d, "BLOCK_BYTES", block_bytes)
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    items += [(1000, "of the"), (1001, ""), (1002, items[3][1]), (None, "and a"), (1003, None), (1002, "of the"), (1004, "...")]
    docs += [(-1, items[0][1].upper().replace(" ", "--")), (-2, items[0][1][:40])]
    found = d.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, block string"),
    )
    assert result(found) == brute(docs, items)


def test_spans_cover_the_passages(spark):
    passage = "Uno dos tres cuatro cinco seis siete ocho nueve diez once doce"
    text = f"é \U0001f600 vorher; {passage.lower()}, nachher {passage} uno"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = d.contamination(docs, spark.createDataFrame([(7, passage)], "item_id long, text string")).first()
    assert [text[s.start : s.end].lower() for s in row.spans] == [passage.lower()] * 2
    assert (row.n_hit, row.n_items, row.contaminated) == (24, 1, True)


def test_odd_documents(spark, odd_documents, odd_rows, no_documents):
    items = [(1, odd_rows[3][1]), (2, "another text here")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = [(row[0], row[1]) for row in odd_rows]
    expected = brute(docs, items)
    assert result(d.contamination(odd_documents, benchmark)) == expected
    kept = d.clean_documents(odd_documents, benchmark)
    assert kept.columns == odd_documents.columns
    assert kept.count() == sum(not row[-1] for row in expected) < len(odd_rows)
    assert d.contamination(no_documents, benchmark).count() == 0
    assert d.clean_documents(odd_documents, benchmark.limit(0)).count() == len(odd_rows)
