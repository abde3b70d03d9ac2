"""The corpus pipeline: documents pass through STAGES in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelloom.llm import decontamination, language, mixing, sharding, simhash
from labelloom.llm.common import table
from labelloom.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]



def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model can tell; the model learns from the same documents.

    Null, empty and letterless texts go; so does everything where no row has a language. Equal rows stay or go alike,
    null ids are kept, further columns are kept as they are, no rows give no rows.
    """
    return language.in_known_language(docs, language.fit(docs))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id.

    Null and empty texts are a group like any other; of equal rows and ids one stays; a null id stays only where its
    group has no other; further columns are kept as they are, no rows give no rows.
    """
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null, empty and wordless texts hold none and stay, as does everything where the benchmark is empty; equal rows stay or
    go alike, null ids and further columns are kept as they are, no rows give no rows.
    """
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the curriculum takes, one row for each use, in training order.

    Null and wordless texts have nothing to take and go; a null source is a source of its own, equal rows count each by
    itself, further columns are kept as they are, no rows give no rows.
    """
    return mixing.mixed_documents(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of the mix.

    Null texts count as empty, null ids are ids like any other, equal rows share a shard, further columns are not
    read, no rows give no rows.
    """
    return sharding.sharded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed_sources),
    ("sharding", into_shards),
]

# Language models of characters, hashes and iterations have no SQL twin; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are written before the next one reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
