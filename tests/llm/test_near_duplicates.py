import random
import re

import numpy as np
import pytest
import xxhash

from labelloom.llm import components, simhash


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute_fingerprint(text):
    words = words_of(text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    """Index of the first linked print, by comparing all."""
    held, parent = np.array(prints, dtype=np.uint64), list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(held)):
        for j in np.flatnonzero(np.bitwise_count(held ^ held[i]) <= radius):
            a, b = top(i), top(int(j))
            parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(held))]


@pytest.mark.parametrize("text", ["", " \t", "one", "One two", "a b c", "é É b\x0bc\x0cd\x85e f g h", "x " * 70_000 + "y"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_some_mask_covers_every_pair_of_positions(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    draw = random.Random(radius)
    for _ in range(3000):
        flips = sum(1 << i for i in draw.sample(range(64), radius))
        assert any(flips & m == 0 for m in masks)
    assert all(20 < m.bit_count() < 50 for m in masks)


def clustered(draw, count):
    """Fingerprints in chains and balls, with many that share most bits."""
    held = [draw.getrandbits(64) for _ in range(count // 4)]
    while len(held) < count:
        value = draw.choice(held)
        for _ in range(draw.choice([1, 2, 3, 4])):
            value ^= 1 << draw.randrange(64)
        held.append(value)
    return list(dict.fromkeys(held))


@pytest.mark.parametrize("direct", [1024, 3])
def test_no_link_is_missed_in_small_or_crowded_buckets(spark, direct):
    values = clustered(random.Random(3), 400)
    prints = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    links = [(r.a, r.b) for r in simhash.linked_fingerprints(prints, 2, direct).collect()]
    ordered = sorted(simhash.signed(v) for v in values)
    place = {v: i for i, v in enumerate(ordered)}
    parent = list(range(len(ordered)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 2
        x, y = top(place[a]), top(place[b])
        parent[max(x, y)] = min(x, y)
    assert [top(i) for i in range(len(ordered))] == brute_components([v & (2**64 - 1) for v in ordered])


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = {r.node: r.root for r in components.roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 140)} | {201: 200, 202: 200}
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0


def expected_rows(rows):
    prints = [brute_fingerprint(text) for _, text, *_ in rows]
    tops = brute_components(prints)
    ids = {}
    for top, (doc_id, *_) in zip(tops, rows):
        known = [i for i in (ids.get(top), doc_id) if i is not None]
        ids[top] = min(known) if known else None
    return sorted((str(row[0]), f"{p:016x}", str(ids[t])) for row, p, t in zip(rows, prints, tops)), len(set(tops))


def test_odd_documents(spark, odd_documents, odd_rows, no_documents):
    found = simhash.digest(simhash.near_duplicates(odd_documents)).collect()
    rows, groups = expected_rows(odd_rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == rows
    kept = simhash.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    assert kept.count() == groups
    assert simhash.near_duplicates(no_documents).count() == 0 and simhash.one_of_each(no_documents).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = simhash.digest(simhash.near_duplicates(docs)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == expected_rows(rows)[0]
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert kept == {r.component_id for r in found}
