"""Zero-shot scoring of texts against class definitions, and resumable runs.

Classes are configuration: an ordered list of ``(label, description)``.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions.text import system_message, user_message
from labelloom.operators.features import document_terms, marked_terms, tfidf
from labelloom.operators.joins import pending
from labelloom.session import stored
from labelloom.sizing import MAX_CLASSES, dimension
from labelloom.sources.results import ADDED, ResultsTable, last_rows

Classes = Sequence[tuple[str, str]]
Scorer = Callable[[list[str]], list[str]]

MAX_DEFINITION_CHARACTERS = 10_000_000
TEMPERATURE = 0.1
# Up to so many classes are all listed with their probabilities; of more, so few.
ALL_LISTED, FEW_LISTED = 100, 10
# Pairs of documents and classes held at a time.
HELD = 1 << 21
KEYS = ("scorer", "class_version", "id")
# Of several results for one key the last in this order counts.
ORDER = ("run", "job", "seen")
SHARED = T.StructType([T.StructField(c, T.StringType()) for c in ("scorer", "class_version")])


def checked_classes(classes: Classes) -> list[tuple[str, str]]:
    """Classes in label order; refuses lists that are no configuration."""
    if len(classes) > MAX_CLASSES or sum(len(d) for _, d in classes) > MAX_DEFINITION_CHARACTERS:
        raise ValueError("class definitions are too large to be sent along with every task")
    return sorted(classes)


def version_of(classes: Classes) -> str:
    """Short digest of the class definitions, to key results by."""
    text = json.dumps(checked_classes(classes), ensure_ascii=False)
    return hashlib.md5(text.encode()).hexdigest()[:12]


def with_classes(inputs: DataFrame, classes: Classes) -> DataFrame:
    """Every input with every class definition, unfolded from a constant array."""
    pairs = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.lit(text).alias("description"))
            for label, text in checked_classes(classes)
        ]
    )
    return inputs.select(*inputs.columns, F.inline(pairs))


def requests(inputs: DataFrame, classes: Classes, task: str) -> DataFrame:
    """One chat request per text: id, system and user message."""
    return inputs.select(
        "id",
        system_message(task, classes).alias("system"),
        user_message(F.col("text").cast("string")).alias("user"),
    )


def choice_requests(inputs: DataFrame, classes: Classes, model: str, question: str, task: str) -> DataFrame:
    """One JSON body per text for a service that answers choice questions."""
    criteria = F.struct(*[F.lit(text).alias(label) for label, text in classes])
    asked = F.struct(
        F.lit("choice").alias("type"), F.lit(task).alias("instructions"), criteria.alias("criteria")
    )
    body = F.struct(
        F.lit(model).alias("model"),
        F.col("text").cast("string").alias("state"),
        F.struct(asked.alias(question)).alias("questions"),
    )
    return inputs.select("id", F.to_json(body).alias("body"))


def parsed_responses(responses: DataFrame, question: str, column: str = "raw_response") -> DataFrame:
    """Columns of a choice response (prediction, confidence, probabilities, model, tokens) and ``problem``, null if it is sound.

    A response is read once, as a variant, and its parts are taken from it by type, so that none
    fails the job. Of several problems the first is named: no JSON, no answer to the question, an answer that is no
    choice or names none, or a part that is there and not of its type.
    """
    answer = f"$.answers['{question}']"
    parts = {
        "confidence": (f"{answer}.confidence", "double"),
        "probabilities": (f"{answer}.probabilities", "map<string,double>"),
        "response_model": ("$.model", "string"),
        "input_tokens": ("$.usage.input_tokens", "bigint"),
        "output_tokens": ("$.usage.output_tokens", "bigint"),
    }
    read = responses.select("id", F.col(column).alias("_raw"), F.try_parse_json(column).alias("_v"))

    def part(path: str, kind: str = "variant") -> Column:
        return F.try_variant_get("_v", path, kind)

    typed = read.select(
        "id", "_v", "_raw",
        part(f"{answer}.type", "string").alias("_type"),
        part(f"{answer}.choice", "string").alias("prediction"),
        *[part(path, kind).alias(name) for name, (path, kind) in parts.items()],
    )
    problem = F.when(F.col("_v").isNull(), "no JSON").when(part(answer).isNull(), "no answer to the question")
    problem = problem.when(F.coalesce(F.col("_type") != "choice", F.lit(True)), "expected a choice answer")
    problem = problem.when(F.col("prediction").isNull(), "no choice is named")
    for name, (path, _) in parts.items():
        given = part(path).isNotNull() & ~F.is_variant_null(F.coalesce(part(path), F.parse_json(F.lit("null"))))
        problem = problem.when(F.col(name).isNull() & given, f"{name} of another type")
    unlike = F.exists(F.map_values("probabilities"), lambda p: p.isNull())
    problem = problem.when(F.coalesce(unlike, F.lit(False)), "probabilities of another type")
    return typed.select("id", "prediction", *parts, problem.alias("problem"), "_raw")


def typed_responses(responses: DataFrame, question: str, column: str = "raw_response") -> DataFrame:
    """The columns of ``parsed_responses``; a response with a problem fails the job with its id."""
    parsed = parsed_responses(responses, question, column)
    named = F.concat("problem", F.lit(" for id "), F.col("id").cast("string"))
    prediction = F.when(F.col("problem").isNull(), F.col("prediction")).otherwise(F.raise_error(named))
    return parsed.withColumn("prediction", prediction).drop("problem", "_raw")


def split_responses(responses: DataFrame, question: str, column: str = "raw_response") -> tuple[DataFrame, DataFrame]:
    """The sound responses, typed, and a table ``id, problem, raw_response`` of the others. Pass a stored table."""
    parsed = parsed_responses(responses, question, column)
    sound = parsed.where("problem IS NULL").drop("problem", "_raw")
    return sound, parsed.where("problem IS NOT NULL").select("id", "problem", F.col("_raw").alias("raw_response"))


def argmax_class(probabilities: DataFrame) -> DataFrame:
    """(id, prediction, probability) from (id, label, p): highest p, ties to the smallest label."""
    return probabilities.groupBy("id").agg(
        F.min_by("label", F.struct(-F.col("p"), F.col("label"))).alias("prediction"),
        F.max("p").alias("probability"),
    )


def lexical_schema(key: T.DataType) -> T.StructType:
    """Columns of ``lexical_scores`` for ids of a type, known without a plan."""
    return T.StructType(
        [
            T.StructField("id", key),
            T.StructField("prediction", T.StringType()),
            T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType())),
            T.StructField("confidence", T.DoubleType()),
        ]
    )


@dataclass(frozen=True)
class ClassIndex:
    """The weights of all class terms, by term: entries ``starts[t]`` to ``starts[t + 1]`` belong to term number t."""

    labels: list[str]
    terms: list[str]
    starts: np.ndarray
    classes: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, spark: SparkSession, classes: Classes, vocab: DataFrame) -> ClassIndex:
        """The TF-IDF of the descriptions; its rows are bounded by the checked length of the definitions."""
        ordered = checked_classes(classes)
        number = {label: i for i, (label, _) in enumerate(ordered)}
        described = document_terms(dimension(spark, ordered, "id string, text string"))
        asked = described.select(F.explode("terms.term").alias("term")).distinct()
        needed = stored(vocab.join(F.broadcast(asked), "term", "left_semi"), "class-vocabulary")
        found = sorted((row["term"], number[row["id"]], row["weight"]) for row in tfidf(described, needed, ["id", "term"]).collect())
        terms = sorted({term for term, _, _ in found})
        place = {term: t for t, term in enumerate(terms)}
        held = np.array([place[term] for term, _, _ in found], dtype=np.int64)
        return cls(
            [label for label, _ in ordered], terms, np.searchsorted(held, np.arange(len(terms) + 1)),
            np.array([k for _, k, _ in found], dtype=np.int64), np.array([w for _, _, w in found], dtype=np.float64),
        )

    def odds(self, owner: np.ndarray, term: np.ndarray, raw: np.ndarray, length: np.ndarray, temperature: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, class and odds of every pair that shares a term, best first within a document; all others have odds 1."""
        counts = self.starts[term + 1] - self.starts[term]
        at = np.repeat(self.starts[term] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        pair = np.repeat(owner, counts) * len(self.labels) + self.classes[at]
        pairs, place = np.unique(pair, return_inverse=True)
        products = np.bincount(place, np.repeat(raw, counts) * self.weights[at], len(pairs))
        document, label = pairs // len(self.labels), pairs % len(self.labels)
        odds = np.exp(products / length[document] / temperature)
        order = np.lexsort((label, -odds, document))
        return document[order], label[order], odds[order]


def lexical_scores(
    inputs: DataFrame, classes: Classes, vocab: DataFrame, temperature: float = TEMPERATURE, listed: int | None = None
) -> DataFrame:
    """Score texts by TF-IDF cosine with the class descriptions; needs no labels.

    ``vocab`` is frozen beforehand, so a text scores the same in any batch.
    Returns id, prediction, probabilities and confidence (first minus second probability). ``probabilities`` names every
    class, or the ``listed`` likeliest (10 where there are over 100 classes).

    The plan does not depend on the classes: postings meet the vocabulary by a broadcast (of its frequent terms, where it is
    too large), and an inverted index of the class terms gives a document's products with the classes that share a term with it. All others have cosine 0 and so
    equal odds, which are counted, not computed.
    """
    index = ClassIndex.of(inputs.sparkSession, classes, vocab)
    labels, most = index.labels, len(index.labels)
    listed = listed if listed is not None else (most if most <= ALL_LISTED else FEW_LISTED)
    numbers = dimension_of_terms(inputs.sparkSession, index.terms)
    schema = lexical_schema(inputs.schema["id"].dataType)
    documents = marked_terms(inputs.select("id", "text"), vocab, numbers)
    held = inputs.sparkSession.sparkContext.broadcast(index)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            n = batch.num_rows
            owner = np.repeat(np.arange(n), np.diff(batch.column("numbers").offsets.to_numpy()))
            term = batch.column("numbers").flatten().to_numpy().astype(np.int64)
            raw = batch.column("raws").flatten().to_numpy()
            length = np.sqrt(batch.column("squares").to_numpy())
            for first, last in spans_of(index, owner, term, n, max(listed, 1)):
                mine = (owner >= first) & (owner < last)
                document, label, odds = index.odds(owner[mine] - first, term[mine], raw[mine], length[first:last], temperature)
                ids = batch.column("id").slice(first, last - first)
                yield scored_batch(ids, labels, document, label, odds, listed, schema.fieldNames())

    return documents.select("id", "squares", "numbers", "raws").mapInArrow(score, schema)


def dimension_of_terms(spark: SparkSession, terms: list[str]) -> DataFrame:
    """``term, number``; the terms are as many as the checked definitions hold at most."""
    if not terms:
        return spark.createDataFrame([], "term string, number int")
    return F.broadcast(spark.createDataFrame(pd.DataFrame({"term": terms, "number": np.arange(len(terms), dtype=np.int32)})))


def spans_of(index: ClassIndex, owner: np.ndarray, term: np.ndarray, documents: int, listed: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose pairs with classes, and lists, are about ``HELD`` at most (one larger document alone)."""
    pairs = np.bincount(owner, index.starts[term + 1] - index.starts[term], documents) + listed
    first, total = 0, 0.0
    for document, count in enumerate(pairs.tolist()):
        if total and total + count > HELD:
            yield first, document
            first, total = document, 0.0
        total += count
    if first < documents:
        yield first, documents


def scored_batch(
    ids: pa.Array, labels: list[str], document: np.ndarray, label: np.ndarray, odds: np.ndarray, listed: int, names: list[str]
) -> pa.RecordBatch:
    """Prediction, probabilities and confidence of documents from their pairs, which stand best first."""
    n, classes = len(ids), len(labels)
    shared = np.bincount(document, minlength=n)
    starts = np.cumsum(shared) - shared
    total = np.bincount(document, odds, n) + (classes - shared)
    place = np.arange(len(document)) - np.repeat(starts, shared)
    best = np.zeros((n, 2))
    for rank in (0, 1):
        # Without a pair of this rank the next class is any that shares nothing; there is none with too few classes.
        best[:, rank] = 1.0 if rank < classes else 0.0
        at = place == rank
        best[document[at], rank] = odds[at]
    first = np.zeros(n, dtype=np.int64)
    first[document[place == 0]] = label[place == 0]
    if listed >= classes:
        dense = np.ones((n, classes))
        dense[document, label] = odds
        keys, values = np.tile(np.arange(classes), n), (dense / total[:, None]).ravel()
        offsets = np.arange(n + 1) * classes
    else:
        kept = place < listed
        keys, values = label[kept], odds[kept] / total[document[kept]]
        offsets = np.concatenate([[0], np.cumsum(np.minimum(shared, listed))])
    names_of = pa.array(labels, pa.string())
    maps = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), names_of.take(pa.array(keys)), pa.array(values))
    confidence = pa.array((best[:, 0] - best[:, 1]) / total)
    return pa.RecordBatch.from_arrays([ids, names_of.take(pa.array(first)), maps, confidence], names=names)


def answers_of(inputs: DataFrame, make_scorer: Callable[[], Scorer]) -> DataFrame:
    """(id, raw_output, latency_ms) from a user's scorer.

    ``make_scorer`` runs once per task and may load a model; the scorer maps a
    batch of texts to a batch of answers.
    """
    key = inputs.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            start = time.perf_counter()
            answers = scorer(batch["text"].tolist())
            each = (time.perf_counter() - start) * 1000 / max(len(batch), 1)
            yield pd.DataFrame({"id": batch["id"], "raw_output": answers, "latency_ms": each})

    return inputs.select("id", F.col("text").cast("string").alias("text")).mapInPandas(
        score, f"id {key}, raw_output string, latency_ms double"
    )


def latest(results: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key in the order of the given columns."""
    return last_rows(results, keys, order)


def results_table(spark: SparkSession, path: str, scored: T.StructType) -> ResultsTable:
    """The table that scorers with this output share: their columns, the scorer and the class version."""
    own = [field for field in scored.fields if field.name not in (*SHARED.names, *ADDED.names)]
    return ResultsTable(spark, path, T.StructType([*own, *SHARED.fields]), ["id"])


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Results written so far; an empty table before the first run."""
    return results_table(spark, path, schema).read()


def result_schema(scored: T.StructType) -> T.StructType:
    """Columns of the results table for a scorer's output: its own, then who wrote them and when."""
    return T.StructType([*scored.fields, *SHARED.fields, *ADDED.fields])


def result_group(scorer: str, class_version: str) -> str:
    """The part of the results table that holds one scorer's answers for one class version."""
    return "/".join(quote(value, safe="") for value in (scorer, class_version))


def score_pending(
    inputs: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    path: str,
    scorer: str,
    class_version: str,
    run: int,
    restart: bool = False,
    job: str = "batch",
    schema: T.StructType | None = None,
    own_history: bool = True,
) -> DataFrame:
    """Score the inputs without a result, append, and return the last result per id.

    Results are keyed by scorer, class version and id, so different scorers and class
    versions share a table. The results of a run become visible at once, in one commit, in place of what an
    earlier attempt of the same job and run committed; a run that stops before leaves nothing visible. ``job``
    tells apart streams that number their runs alike. ``restart`` ignores earlier results; a caller that knows
    that none of the inputs was scored by its own job says so by ``own_history``. Earlier results are read from the
    scorer's folders only, and of merged ones from the buckets that may hold an input. ``schema`` is that of the scores; without
    it the scorer is asked with no rows.
    """
    if not (scorer and class_version and job):
        raise ValueError("scorer, class version and job need a name")
    spark, group = inputs.sparkSession, result_group(scorer, class_version)
    fields = schema or score(inputs.limit(0)).schema
    table = results_table(spark, path, fields)
    todo = inputs
    if not restart:
        leave_out = {"without_run": (job, run)} if own_history else {"without_job": job}
        if any(part.group == group and (own_history or part.jobs != (job,)) for part in table.snapshot()[1]):
            todo = pending(inputs, table.read(group, asked=inputs, **leave_out), "id")
    scored = score(todo).select(*fields.names)
    named = scored.withColumns({"scorer": F.lit(scorer), "class_version": F.lit(class_version)})
    table.append(named, group, job, run)
    while table.merge(group):
        pass
    results = table.read(group)
    if restart:
        results = results.where((F.col("job") == job) & (F.col("run") >= run))
    return latest(results, KEYS, ORDER)
