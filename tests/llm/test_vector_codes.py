import hashlib
import math
import random

import numpy as np
import pytest

from labelloom.llm import vector_codes
from labelloom.llm.vector_codes import SortedEntries, compressed, kept_vectors, with_label_errors

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, same string, salt int, size int"


def rows_of(vectors, labels=None):
    return [(i, v, None if labels is None else labels[i], "x", "y", "z", 1, 2) for i, v in vectors]


def brute(vectors, parts=8, entries=16, rounds=6):
    """Plain loops over all entries; vectors as (id, list)."""
    whole = [(i, [math.floor(4096 * x) for x in v]) for i, v in vectors]
    width = len(whole[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in whole]
    first = sorted(range(len(whole)), key=lambda r: whole[r][0])[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]

    def near(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for row in cut:
                members.setdefault(near(row[p], books[p])[1], []).append(row[p])
            for e, held in members.items():
                books[p][e] = [sum(column) // len(held) for column in zip(*held)]
    codes = {}
    for (i, _), row in zip(whole, cut):
        found = [near(row[p], books[p]) for p in range(parts)]
        codes[i] = ("".join(f"{e:02x}" for _, e in found), min(sum(d for d, _ in found), vector_codes.MOST_LONG))
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return codes, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("scale", [1.0, 3e4, 3e8])
def test_codes_equal_plain_loops(spark, scale):
    draw = np.random.default_rng(3)
    vectors = [(i, [float(np.float32(x)) for x in draw.normal(size=16) * scale]) for i in range(120)]
    vectors += [(200 + i, vectors[i % 7][1]) for i in range(40)]
    labels = {i: i % 3 if i % 4 else None for i, _ in vectors}
    held = spark.createDataFrame(rows_of(vectors, labels), SCHEMA).repartition(5)
    codes, sums = brute(vectors)
    found = compressed(held).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in found} == codes
    assert {r["codebooks_sha256"] for r in found} == {sums}
    for r in found:
        assert r["label_error"] == min(sum(codes[i][1] for i in labels if labels[i] == labels[r["vec_id"]]), vector_codes.MOST_LONG)


def test_search_sees_fewer_entries_and_breaks_ties_by_number():
    draw = np.random.default_rng(1)
    entries = draw.integers(-50, 50, size=(64, 4))
    entries[40:] = entries[:24]
    parts = np.concatenate([draw.integers(-60, 60, size=(500, 4)), entries])
    number, distance, seen = SortedEntries(entries).nearest(parts)
    every = ((parts[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert seen < 0.7 * every.size


def test_odd_vectors(spark):
    plain = [float(i) for i in range(8)]
    rows = [(1, plain), (2, None), (3, [*plain[:7], None]), (4, [*plain[:7], float("nan")]), (5, [*plain[:7], float("inf")]),
            (6, plain[:3]), (7, [*plain[:7], 1e30]), (None, plain), (1, plain), (8, [0.0] * 8), (9, [])]
    found = compressed(spark.createDataFrame(rows_of(rows), SCHEMA)).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r["vec_id"], []).append((r["code"], r["error"]))
    assert sorted(by_id, key=str) == sorted([1, 6, 7, 8, 9, None], key=str)
    assert by_id[1] == [("00" * 8, 0)] * 2 and by_id[None] == [("00" * 8, 0)]
    # The first component of both vectors is 0: the lower number wins.
    assert by_id[8] == [("00" + "01" * 7, 0)]
    assert by_id[6] == by_id[7] == by_id[9] == [(None, None)]
    nobody = spark.createDataFrame(rows_of([(None, plain)]), SCHEMA)
    assert [tuple(r)[:4] for r in compressed(nobody).collect()] == [(None, None, None, None)]
    empty = spark.createDataFrame([], SCHEMA)
    assert compressed(empty).collect() == [] and kept_vectors(empty)[1] == 0


def test_lengths_that_no_part_divides_are_filled(spark):
    draw = random.Random(2)
    vectors = [(i, [float(draw.randint(-9, 9)) for _ in range(10)]) for i in range(50)]
    codes, _ = brute([(i, v + [0.0] * 6) for i, v in vectors])
    found = compressed(spark.createDataFrame(rows_of(vectors), SCHEMA)).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in found} == codes


def test_label_errors_without_a_broadcast(spark):
    coded = spark.createDataFrame([(i, None if i % 2 else i % 10, str(i), i) for i in range(200)], "vec_id long, label int, code string, error long")
    one, other = (sorted(map(str, with_label_errors(coded, n).select("vec_id", "label_error").collect())) for n in (100, 0))
    assert one == other and len(one) == 200
    large = spark.createDataFrame([(1, 1, "a", vector_codes.MOST_LONG)] * 2, "vec_id long, label int, code string, error long")
    assert {r["label_error"] for r in with_label_errors(large).collect()} == {vector_codes.MOST_LONG}
