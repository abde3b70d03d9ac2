import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from labelloom.llm import line_dedup
from labelloom.llm.line_dedup import CuckooFilter, cut, deleted, digest, indexed, inserted

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(BLANK))


def brute(corpus, texts, least, shortest=1):
    held = Counter(k for text in corpus for k in {key(line) for line in (text or "").split("\n")} if len(k) >= shortest)
    found = []
    for doc_id, text in texts:
        lines = (text or "").split("\n")
        kept = [line for line in lines if len(key(line)) < shortest or held[key(line)] < least]
        found.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(str, found))


def rows(df):
    return sorted(str(tuple(r)) for r in digest(df).collect())


def lined(seed, n, kinds=40):
    draw = random.Random(seed)
    common = [f"Line {i} é" for i in range(kinds)]
    made = []
    for i in range(n):
        lines = [draw.choice(common) if draw.random() < 0.6 else f"own {seed} {i} {j}" for j in range(draw.randint(0, 8))]
        made.append((seed * 1000 + i, "\n".join(draw.choice(["", "\t", "  "]) + draw.choice([line, line.upper()]) + "\r" for line in lines)))
    return made


@pytest.mark.parametrize("least, shortest", [(2, 1), (10, 1), (1, 3), (2, 0)])
def test_odd_documents_equal_brute_force(spark, odd_documents, odd_rows, least, shortest):
    index = indexed(odd_documents, least, shortest)
    expected = brute([r[1] for r in odd_rows], [(r[0], r[1]) for r in odd_rows], least, shortest)
    assert rows(cut(odd_documents, index)) == expected
    assert rows(cut(odd_documents, index, filter_bytes=-1)) == expected


def test_no_documents(spark, no_documents):
    index = indexed(no_documents)
    assert cut(no_documents, index).collect() == [] and cut(no_documents, index, -1).collect() == []


def test_insertions_and_deletions_leave_what_a_new_build_gives(spark):
    """Many small shards, so that filters are changed in place and grow."""
    sets = {name: lined(i, n) for i, (name, n) in enumerate([("a", 150), ("b", 200), ("c", 30)], 1)}
    held = {name: spark.createDataFrame(made, "doc_id long, text string").repartition(3) for name, made in sets.items()}

    def check(index, names):
        corpus = [row for name in names for row in sets[name]]
        docs = spark.createDataFrame(corpus, "doc_id long, text string")
        assert rows(cut(docs, index)) == brute([t for _, t in corpus], corpus, 12)
        fresh = indexed(docs, 12, shard_keys=50)
        assert sorted(index.counts(spark).collect()) == sorted(fresh.counts(spark).collect())
        assert index.filters(spark).agg({"frequent": "sum"}).first() == fresh.filters(spark).agg({"frequent": "sum"}).first()

    first = indexed(held["a"], 12, shard_keys=50)
    assert first.shards > 3
    more = inserted(first, held["b"], shard_keys=50)
    check(more, "ab")
    more = inserted(more, held["c"], shard_keys=50)
    less = deleted(more, held["b"], shard_keys=50)
    check(less, "ac")
    back = deleted(less, held["c"], shard_keys=50)
    check(back, "a")
    # Earlier versions stay as they were.
    check(first, "a")
    nothing = deleted(back, held["a"], shard_keys=50)
    assert nothing.counts(spark).count() == 0


def test_deleting_what_was_never_inserted_fails(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    with pytest.raises(Exception, match="never inserted"):
        deleted(indexed(docs, 2), spark.createDataFrame([(2, "c")], "doc_id long, text string"))


def test_filter_holds_what_was_inserted_and_not_deleted():
    draw = np.random.default_rng(6)
    low = draw.integers(-(2**63), 2**63 - 1, size=6000, dtype=np.int64)
    held = CuckooFilter.holding(low[:4000])
    assert held.contains(low[:4000]).all() and held.contains(low[4000:]).mean() < 0.01
    held.delete(low[1000:3000])
    assert held.contains(low[:1000]).all() and held.contains(low[3000:4000]).all()
    assert held.contains(low[1000:3000]).mean() < 0.01
    assert held.insert(low[4000:5000]) and held.contains(low[4000:5000]).all()


def test_wrong_claims_of_the_filter_do_not_drop_lines(spark, monkeypatch):
    """Fingerprints of few bits claim many keys wrongly; the exceptions put that right."""
    plain = CuckooFilter.places

    def coarse(self, low):
        _, one, _ = plain(self, low)
        mark = np.ones(len(low), dtype=np.int64)
        return mark, one & 1, one & 1 ^ self._jump(mark) & 1

    monkeypatch.setattr(CuckooFilter, "places", coarse)
    held = CuckooFilter(4)
    assert held.insert(np.array([2, 3], dtype=np.int64)) and held.contains(np.arange(8)).all()
    index_rows = [{"shard": 0, "buckets": 4, "slots": held.slots.tobytes(), "frequent": 2,
                   "exceptions": np.array([[0, 4], [0, 5]], dtype="<i8").tobytes()}]
    shared = line_dedup.SharedLines(1, index_rows)
    sums = np.array([[0, 2], [0, 3], [0, 4], [0, 5], [9, 4]], dtype=np.int64)
    assert shared.contain(sums).tolist() == [True, True, False, False, True]
