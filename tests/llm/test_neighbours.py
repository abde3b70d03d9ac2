import numpy as np
import pytest

from labelloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>, score string, rank string, query_id string"


def usable(v):
    return v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)


def brute(rows, every=20, count=20):
    held = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and usable(v)]
    ids, x = np.array([i for i, _ in held]), np.stack([v for _, v in held])
    found = {}
    for k in np.flatnonzero(ids % every == 0):
        scores = (x * x[k]).sum(axis=1)
        order = np.lexsort((ids, -scores))
        found[int(ids[k])] = [(int(ids[j]), float(scores[j])) for j in order[order != k][:count]]
    return found


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", "y", "z") for i, v in rows], SCHEMA)


def listed(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


def recall(found, expected):
    hits = sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in near}) for q, near in expected.items())
    return hits / sum(map(len, expected.values()))


def check_exact(found, rows):
    """Scores are those of the original vectors, ranks follow score and id, nobody finds itself."""
    x = {i: np.array(v, dtype=float) for i, v in rows if usable(v)}
    for query, near in found.items():
        assert near == sorted(near, key=lambda h: (-h[1], h[0])) and query not in [i for i, _ in near]
        assert all(score == float((x[i] * x[query]).sum()) for i, score in near)


def test_given_embeddings(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    found, expected = listed(neighbours.nearest(vectors)), brute(rows)
    assert set(found) == set(expected) and all(len(near) == 20 for near in found.values())
    check_exact(found, rows)
    assert recall(found, expected) >= 0.9


@pytest.mark.parametrize("axes", [1, 2])
def test_norms_copies_and_rows_without_part(spark, axes):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 6)) * np.exp(draw.normal(size=(400, 1)) * 2)
    x[100:220] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [0] * 6), (1040, [1, None, 0, 0, 0, 0]), (1060, [float("nan")] * 6), (1080, [float("inf")] * 6)]
    found, expected = listed(neighbours.nearest(frame(spark, rows), axes=axes)), brute(rows)
    assert set(found) == set(expected)
    check_exact(found, rows)
    assert recall(found, expected) >= 0.9


def test_blocks_and_turns_change_nothing(spark, monkeypatch):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(3).normal(size=(300, 5)))]
    whole = listed(neighbours.nearest(frame(spark, rows), recall=1.0))
    for name, value in (("GROUP_ROWS", 40), ("BLOCK_ROWS", 20), ("QUERY_ROWS", 4), ("HELD", 64)):
        monkeypatch.setattr(neighbours, name, value)
    assert listed(neighbours.nearest(frame(spark, rows), recall=1.0, axes=1)) == whole


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1, 0, 0]) for i in range(60)] + [(i, [1, i % 2, 0]) for i in range(60, 100)] + [(3, [1, 0, 0])]
    found, expected = listed(neighbours.nearest(frame(spark, rows), recall=1.0)), brute(sorted(set((i, tuple(v)) for i, v in rows)))
    assert found == expected


def test_few_or_no_rows(spark):
    assert neighbours.nearest(frame(spark, [])).count() == 0
    assert neighbours.nearest(frame(spark, [(0, [1, 2])])).count() == 0
    assert neighbours.nearest(frame(spark, [(1, [1, 2]), (2, [2, 1])])).count() == 0
    assert listed(neighbours.nearest(frame(spark, [(0, [1, 2]), (2, [2, 1]), (4, [1]), (None, [1, 1])]))) == {0: [(2, 4.0)]}


def test_hadamard_keeps_lengths_and_hashes_agree():
    rows = np.random.default_rng(2).normal(size=(50, 16))
    assert np.allclose((neighbours.hadamard(rows) ** 2).sum(axis=1), (rows**2).sum(axis=1))
    hashes = neighbours.CrossPolytope(15, 2)
    unit = rows / neighbours.norms(rows)[:, None]
    for table in range(hashes.tables):
        assert (hashes.preference(unit, table).argmax(axis=1) == hashes.bucket(unit, table)).all()
        assert (np.sort(hashes.probes(unit, table, 1), axis=1)[:, 0] == hashes.bucket(unit, table)).all()


def test_clustered_vectors_are_found_in_few_buckets(spark, monkeypatch):
    """Sixty clusters: a query visits a small share of the buckets, and parts are not repeated for queries that do not come."""
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(60, 16))
    x = centres[np.arange(3000) % 60] + 0.15 * draw.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    probes = []
    needed = neighbours.needed_probes

    def recorded(*arguments):
        probes.append((needed(*arguments), arguments[0].buckets))
        return probes[-1][0]

    monkeypatch.setattr(neighbours, "needed_probes", recorded)
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 300)
    found, expected = listed(neighbours.nearest(frame(spark, rows), axes=1)), brute(rows)
    assert recall(found, expected) >= 0.9
    (count, buckets), = probes
    assert count <= buckets / 6
