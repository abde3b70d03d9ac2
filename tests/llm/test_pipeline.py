from collections import Counter

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from labelloom.llm import decontamination, simhash
from labelloom.session import stored

FOLDER = "/root/testdata/sf0.001"
NAMES = ["language", "near_duplicates", "decontamination", "mixing", "sharding"]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        held.append(stored(stage(spark, held[-1], FOLDER), name))
    return held


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_and_registration():
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    registered = entry_points.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in registered} and "pipeline" in registered


def test_all_but_the_last_keep_documents_as_they_are(steps):
    for before, after in zip(steps[:-2], steps[1:-1]):
        assert after.dtypes == before.dtypes
        assert not set(rows(after)) - set(rows(before))


def test_each_stage_decides_on_its_own_input(spark, steps):
    docs, known, single, clean, mix, shards = steps
    assert rows(known) == rows(docs)
    found = {r.component_id for r in simhash.near_duplicates(known).collect()}
    assert {r.doc_id for r in single.collect()} == found and single.count() == len(found) < known.count()
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    marked = {r.doc_id for r in decontamination.contamination(single, benchmark).collect() if r.contaminated}
    assert marked and {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - marked
    assert max(rows(mix).values()) == 2
    assert Counter(r.doc_id for r in shards.collect()) == Counter(r.doc_id for r in mix.collect())
    load = Counter()
    for r in shards.collect():
        load[r.shard] += r.size
    assert len(load) == 8


def test_run_returns_the_last_stage(spark, steps):
    assert rows(corpus_pipeline.run(spark, FOLDER)) == rows(steps[-1])


def test_odd_documents_pass_all_stages(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, FOLDER), name)
        assert docs.columns[:3] == ["doc_id", "size", "text_crc32"]
