import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from labelloom.llm import lexical_search
from labelloom.llm.lexical_search import Best, Slice, ranked

ITEMS = "item_id long, text string, rank int, score string, salt string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, count=20):
    """Every document against every item; returns item -> [(doc_id, score)], best first."""
    held = [(doc_id, Counter(terms(text))) for doc_id, text in docs if terms(text)]
    everything = sum(sum(c.values()) for _, c in held)
    found = {}
    for item in items:
        weights = Counter(terms(item[1]))
        scored = []
        for doc_id, tf in held:
            n = sum(tf.values())
            middle = 75 + 25 * n * len(held) // everything
            score = 0
            for term, q in weights.items():
                df = sum(term in c for _, c in held)
                if tf[term]:
                    w = math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df + 1)))
                    score += q * w * (1_000_000_000 * tf[term] // (1000 * tf[term] + 12 * middle))
            if score > 0:
                scored.append((doc_id, score))
        scored.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        found[item] = scored[:count]
    return found


def searched(spark, docs, items, **options):
    asked = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in items], ITEMS)
    rows = ranked(docs, asked, **options).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return found


def test_odd_documents_equal_brute_force(spark, odd_documents, odd_rows):
    items = [(1, odd_rows[0][1]), (2, odd_rows[3][1] + " " + odd_rows[3][1]), (3, "Une É phrase, NAÏVE naïve!"), (4, None), (5, ""),
             (6, "nothing-of-this qqqqqqqqq"), (7, odd_rows[10][1][:9] + " 0123456789 中文"), (None, odd_rows[5][1])]
    expected = brute([(r[0], r[1]) for r in odd_rows], [i for i in items if i[1]], 4)
    found = searched(spark, odd_documents, [*items, items[0]], count=4)
    for item in items:
        wanted = expected.get(item, [])
        assert [x[1:] for x in found.get(item[0], [])] == wanted, item
        assert [x[0] for x in found.get(item[0], [])] == list(range(1, len(wanted) + 1))
    assert searched(spark, odd_documents, items, count=4, block_bytes=200) == found


def test_no_documents_or_items(spark, no_documents, odd_documents):
    assert searched(spark, no_documents, [(1, "a b")]) == {}
    assert searched(spark, odd_documents, []) == {}
    assert searched(spark, odd_documents, [(1, None), (2, "?!")]) == {}


@pytest.mark.parametrize("seed", range(3))
def test_small_slices_and_many_ties_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(lexical_search, "SLICE_POSTINGS", 200)
    monkeypatch.setattr(lexical_search, "FEW_POSTINGS", 6)
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    docs = [(draw.randrange(10_000), " ".join(draw.choices(words, k=draw.choice([3, 3, 8, 40])))) for _ in range(400)]
    docs += [(draw.randrange(10_000), docs[0][1]) for _ in range(90)]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(1, 6)))) for i in range(12)]
    expected = brute(docs, items)
    held = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = searched(spark, held, items)
    for item in items:
        assert [x[1:] for x in found.get(item[0], [])] == expected[item]


def test_bounds_leave_most_documents_unscored():
    draw = np.random.default_rng(4)
    n = 20_000
    sizes = np.full(n, 3)
    terms = np.sort(draw.integers(0, 300, size=(n, 3)) ** 2 // 300, axis=1)
    same = [row.tobytes() for row in np.arange(n)]
    held = Slice(np.arange(n), np.zeros(n, dtype=bool), draw.integers(5, 400, n), same, sizes, terms.ravel(), draw.integers(1, 5, 3 * n), n, 200 * n, 20)
    best = Best.none(20)
    scored = held.search(np.array([3, 90, 250]), np.array([500, 3000, 9000]), best)
    assert len(best.scores) == 20 and scored < n / 10
