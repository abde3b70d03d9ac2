"""Registered queries: each operator over its whole table, with the settings used in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelloom.llm import (
    decontamination,
    language,
    lexical_search,
    line_dedup,
    mixing,
    neighbours,
    quality,
    secrets,
    sharding,
    simhash,
    token_files,
    urls,
    vector_codes,
)
from labelloom.llm.common import table
from labelloom.session import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# What the filter of pages must decide, whatever its vocabulary says.
URL_RULES = (
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
)


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = token_files.token_file_path(spark)
    manifest = token_files.write_token_files(table(spark, folder, "documents"), path, word_vocabulary)
    return token_files.read_token_files(manifest, path)


@query()
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, folder, "labels")))


@query(urls.sql(URL_RULES))
def op3_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(table(spark, folder, "pages"), URL_RULES)


@query(mixing.SQL)
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(mixing.sized(table(spark, folder, "documents")), "document-sizes")
    return mixing.digest(mixing.mixed(rows))


@query()
def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(table(spark, folder, "documents"))


@query()
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.predictions(docs, language.fit(docs))


@query()
def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.found(table(spark, folder, "documents"))


@query(decontamination.SQL)
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontamination.digest(found)


@query()
def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


@query()
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, folder, "documents")))


@query(vector_codes.sql())
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compressed(table(spark, folder, "embeddings"))


@query(lexical_search.SQL)
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(line_dedup.sql())
def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return line_dedup.digest(line_dedup.cut(docs, line_dedup.indexed(docs)))
