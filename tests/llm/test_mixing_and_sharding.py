import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from labelloom.llm import common, mixing, sharding
from labelloom.llm.queries import QUERIES
from labelloom.session import stored


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, passes=2):
    """Hand the excess on until no source is above its limit."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = [n for n in names if n not in full]
        left = total - sum(passes * sizes[n] for n in full)
        each = left / sum(weight[n] for n in rest) if rest else 0
        over = {n for n in rest if each * weight[n] >= passes * sizes[n]}
        if not over:
            return {n: passes * sizes[n] if n in full else each * weight[n] for n in names}
        full |= over


def test_targets(spark):
    for sizes in ({"a": 100, "b": 900, "c": 5, None: 40, "B": 0, "é": 300, "\U0001f600": 10, "￮": 20}, {"x": 7}, {None: 3}):
        found = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        assert {r.source: r.target for r in found} == pytest.approx(brute_targets(sizes), abs=1e-5)


@pytest.mark.parametrize("schedule", mixing.SCHEDULES + ((0.0, 4.0, 0.0), (1.0, 0.0), (0.0, 0.0, 1.0)))
def test_progress_inverts_demand(spark, schedule):
    rows = spark.range(101).select((F.col("id") / 100).alias("share"))
    both = rows.select("share", mixing.demand_at(mixing.progress_at(F.col("share"), schedule), schedule).alias("back"))
    for r in both.collect():
        assert r.back == pytest.approx(r.share, abs=1e-9)


def test_taken_words_of_odd_documents(spark, odd_documents, odd_rows, no_documents):
    rows = stored(mixing.sized(odd_documents), "sizes")
    found = mixing.digest(mixing.mixed(rows)).collect()
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(row[0]), words(row[1])) for row in odd_rows)
    sizes = defaultdict(int)
    for row in odd_rows:
        sizes[row[3]] += words(row[1])
    targets = brute_targets(sizes)
    taken = defaultdict(int)
    for r in mixing.mixed(rows).collect():
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source], abs=1e-5)
        assert (r.progress is None) == (r.taken == 0) == (r.position is None)
        taken[r.source] += r.taken
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 1
    assert mixing.digest(mixing.mixed(mixing.sized(no_documents))).count() == 0


def test_mix_does_not_depend_on_buckets_or_partitions(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = mixing.mixed(stored(mixing.sized(docs), "sizes")).drop("key")
    monkeypatch.setattr(mixing, "square_root_buckets", lambda rows: 97)
    other = mixing.mixed(stored(mixing.sized(docs.repartition(7)), "sizes")).drop("key")
    assert one.exceptAll(other).isEmpty() and one.count() == other.count()


def test_many_sources_meet_their_rows_without_a_broadcast(spark, monkeypatch, odd_documents):
    rows = stored(mixing.sized(odd_documents), "sizes")
    one = mixing.mixed(rows)
    monkeypatch.setattr(mixing, "MOST_SENT", 0)
    other = mixing.mixed(rows)
    assert one.exceptAll(other).isEmpty() and one.count() == other.count() == rows.count()


def test_curriculum_reads_early_sources_first(spark):
    rows = [(i, f"s{i % 3}", 10) for i in range(900)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("key", F.md5(F.col("doc_id").cast("string").cast("binary")))
    half = mixing.mixed(sized, weights=(1,), share=1.0).groupBy("source").agg(F.avg(F.col("progress")).alias("mean")).collect()
    mean = {r.source: r.mean for r in half}
    assert mean["s0"] < 0.45 < mean["s1"] < 0.55 < mean["s2"]
    placed = mixing.mixed(sized, weights=(1,), share=1.0).orderBy("position").collect()
    for i, r in enumerate(placed):
        assert r.position == pytest.approx(10 * i, abs=60)


def test_mixed_documents_are_whole_rows_in_order(spark, odd_documents, odd_rows, no_documents):
    used = mixing.mixed_documents(odd_documents)
    assert used.columns == odd_documents.columns
    wanted = Counter()
    for r in mixing.mixed(mixing.sized(odd_documents), whole=True).collect():
        if r.size:
            assert r.taken % r.size == 0
            wanted[r.doc_id, r.size] += r.taken // r.size
    assert Counter((r.doc_id, words(r.text)) for r in used.collect()) == +wanted
    assert mixing.mixed_documents(no_documents).count() == 0


def check_shards(found, rows, shards=8):
    expected = Counter((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((str(r.doc_id), r.size, r.text_crc32) for r in found) == expected
    slots = defaultdict(list)
    for r in found:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = QUERIES["op5_sharding"](spark, folder).collect()
    check_shards(found, rows)
    load, places = defaultdict(int), defaultdict(set)
    for r in found:
        load[r.shard] += r.size
        places[r.text_crc32, r.size].add(r.shard)
    assert len(load) == 8 and max(load.values()) < 1.02 * min(load.values())
    assert all(len(p) == 1 for p in places.values())


def test_large_groups_are_split_and_sizes_stay_even(spark):
    texts = ["copy of one text"] * 300 + ["other copy here"] * 100 + [f"single text {i}" for i in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sharding.sharded(docs).collect()
    check_shards(found, list(enumerate(texts)))
    load, copies = defaultdict(int), defaultdict(int)
    for r in found:
        load[r.shard] += r.size
        copies[r.shard, r.text_crc32] += 1
    mean = sum(load.values()) / 8
    assert all(abs(v - mean) < 0.1 * mean for v in load.values())
    for text, n in (("copy of one text", 300), ("other copy here", 100)):
        crc, size = zlib.crc32(text.encode()), n * (len(text) + 1)
        assert len([1 for s, c in copies if c == crc]) <= math.ceil(size / mean) + 1


def test_groups_stay_together_where_shards_have_room(spark):
    texts = ["copy of one hot text"] * 500 + [f"text of group {g} " + "word " * (g % 7) for g in range(150) for _ in range(2 + g % 5)]
    texts += [f"single text number {i}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sharding.sharded(docs).collect()
    check_shards(found, list(enumerate(texts)))
    load, places, sizes = defaultdict(int), defaultdict(set), defaultdict(int)
    for r in found:
        load[r.shard] += r.size
        places[r.text_crc32].add(r.shard)
        sizes[r.text_crc32] += r.size
    capacity = sum(load.values()) / 8
    hot = zlib.crc32(b"copy of one hot text")
    assert sizes[hot] > 8 * capacity / 4
    assert len(places[hot]) <= math.ceil(sizes[hot] / capacity) + 1
    assert all(len(p) == 1 for crc, p in places.items() if crc != hot)
    assert max(load.values()) - min(load.values()) <= 2 * max(r.size for r in found)


def plain_propagation(units, capacity, shards):
    """The same rounds in plain Python: (anchor, unit) -> shard, and the sizes of those without one."""
    prefs = {u[:2]: list(u[3]) for u in units}
    size = {u[:2]: u[2] for u in units}
    while True:
        asking = defaultdict(list)
        for u, wanted in prefs.items():
            if wanted:
                asking[wanted[0]].append(u)
        over = [s for s in asking if sum(size[u] for u in asking[s]) > capacity]
        if not over:
            break
        for s in over:
            total, kept = 0, 0
            ordered = sorted(asking[s], key=lambda u: (-size[u], u))
            outside = []
            for u in ordered:
                total += size[u]
                if total <= capacity:
                    kept = total
                else:
                    outside.append(u)
            for u in outside:
                if size[u] > capacity - kept:
                    prefs[u].pop(0)
    placed = {u: wanted[0] for u, wanted in prefs.items() if wanted}
    room = [capacity - sum(size[u] for u, p in placed.items() if p == s) for s in range(shards)]
    left = [u for u in prefs if u not in placed]
    while True:
        asking = defaultdict(list)
        for u in left:
            fits = [s for s in sorted(range(shards), key=lambda s: (room[s], s)) if room[s] >= size[u]]
            if fits:
                asking[fits[0]].append(u)
        if not asking:
            return placed, sorted(size[u] for u in left)
        before = list(room)
        for s, wanted in asking.items():
            total = 0
            for u in sorted(wanted, key=lambda u: (-size[u], u)):
                total += size[u]
                if total <= before[s]:
                    placed[u] = s
                    room[s] -= size[u]
        left = [u for u in left if u not in placed]


@pytest.mark.parametrize("seed", range(4))
def test_propagation_equals_plain_rounds(spark, seed):
    """Tight and loose quotas, equal sizes, and groups larger than a shard."""
    draw = random.Random(seed)
    sizes = [draw.choice([3, 10, 10, 40, 95, 260]) + draw.randint(0, 2) * (seed % 2) for _ in range(60)]
    capacity = -(-sum(sizes) * [100, 104, 130, 100][seed] // 800)
    rows = [(f"{i:032x}", size, draw.sample(range(8), 8)) for i, size in enumerate(sizes)]
    units = stored(sharding.units_of(spark.createDataFrame(rows, "anchor string, size long, prefs array<int>"), capacity), "units")
    held = [tuple(r) for r in units.collect()]
    assert sum(u[2] for u in held) == sum(sizes) and max(u[2] for u in held) <= capacity
    placed, left, room = sharding.propagated(units, capacity, 8)
    expected, remaining = plain_propagation(held, capacity, 8)
    assert {(r.anchor, r.unit): r.shard for r in placed.collect()} == expected
    assert sorted(r["size"] for r in left.collect()) == remaining and len(remaining) < 8
    load = defaultdict(int)
    for u in held:
        if u[:2] in expected:
            load[expected[u[:2]]] += u[2]
    assert [capacity - load[s] for s in range(8)] == room and min(room) >= 0


@pytest.mark.parametrize("sizes", [[160] * 5, [250, 250, 100, 100, 100], [799, 1], [30] * 20, [333, 90, 80, 70, 60, 50, 40], [100] * 8])
def test_parts_of_large_groups(spark, sizes):
    """Rows of size 1 without other rows: a group takes as few shards as it needs, one more at most."""
    rows = [(f"{g:032x}", f"{g:04x}{i:028x}", 1) for g, size in enumerate(sizes) for i in range(size)]
    held = stored(spark.createDataFrame(rows, "anchor string, key string, size long"), "rows")
    whole, split = sharding.grouped(held, 100, 8)
    load = defaultdict(float)
    placed = {r.anchor: r.shard for r in whole.collect()}
    for g, size in enumerate(sizes):
        anchor = f"{g:032x}"
        if size > 1:
            assert (anchor in placed) != (anchor in split)
            taken = split.get(anchor) or [float(size) if s == placed[anchor] else 0.0 for s in range(8)]
            assert sum(taken) == size and sum(x > 0 for x in taken) <= math.ceil(size / 100) + 1
            for s, x in enumerate(taken):
                load[s] += x
    assert max(load.values()) <= 100


def test_odd_documents_in_shards(spark, odd_documents, odd_rows, no_documents):
    check_shards(sharding.sharded(odd_documents).collect(), odd_rows)
    assert sharding.sharded(no_documents).count() == 0


def test_levels():
    assert sharding.level([0, 5, 100], 15) == [10.0, 5.0, 0.0]
    assert sum(sharding.level([3, 1, 4], 100)) == pytest.approx(100)


@pytest.mark.parametrize("buckets", [1, 7, 1000])
def test_running_totals(spark, buckets):
    rows = [(i % 3, hashlib.md5(str(i).encode()).hexdigest(), i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, key string, n long")
    for r in common.running_total(df, "g", "key", {"before": "n"}, buckets).collect():
        assert r.before == sum(n for g, key, n in rows if g == r.g and key < r.key)
