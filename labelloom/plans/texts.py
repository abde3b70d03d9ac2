"""Text features, classifiers, zero-shot scoring and the incremental job."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions import text as X
from labelloom.functions.vectors import unit_vector
from labelloom.operators import checks, classifiers, evaluation, experiments, features, joins, sampling, scoring, taxonomy
from labelloom.plans import inputs as given
from labelloom.plans.inputs import DOCUMENT_CLASSES, DOCUMENTS_SQL, TERMS_SQL, VOCABULARY_SQL
from labelloom.plans.registry import query, rounded, short
from labelloom.session import new_path, stored
from labelloom.sources.results import Part, ResultsTable
from labelloom.sources.tables import spread
from labelloom.sources.taxonomy import class_definitions as definitions
from labelloom.sources.taxonomy import class_table, mapping_table
from labelloom.streaming.incremental import file_stream, score_stream

TASK = "Name the language of the message. Choose exactly one class from the list below."
CODES = [label for label, _ in DOCUMENT_CLASSES]
CLASS_VALUES = ", ".join(f"('{label}', '{text}')" for label, text in DOCUMENT_CLASSES)


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return given.documents(spark, folder).select("id", "text")


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    return features.document_terms(_texts(spark, folder))


def _frozen_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return stored(features.vocabulary(_texts(spark, folder)), "vocabulary")


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return taxonomy.relabelled(given.documents(spark, folder), given.document_mapping(spark))


def _split(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)


# ------------------------------------------------------------- text functions


@query("SELECT doc_id AS id, trim(text) AS trimmed, upper(lang) AS code, lower(source) AS origin FROM documents")
def normalised_labels(spark: SparkSession, folder: str) -> DataFrame:
    return given.table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.trim("text").alias("trimmed"),
        F.upper("lang").alias("code"),
        F.lower("source").alias("origin"),
    )


@query(
    """WITH answers AS (
      SELECT conv_id * 1000 + turn AS id, text, upper(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS cleaned
      FROM conversations),
    found AS (
      SELECT *, list_intersect(['I', 'A', 'THE', 'YOU', 'IS'], list_distinct(
        regexp_split_to_array(regexp_replace(cleaned, '[^A-Z_]', ' ', 'g'), ' +'))) AS named FROM answers)
    SELECT id, CASE WHEN cleaned IN ('I', 'A', 'THE', 'YOU', 'IS') THEN cleaned
      WHEN len(named) = 1 THEN named[1] ELSE 'INVALID' END AS prediction FROM found"""
)
def parsed_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Free-text answers to classes; common words stand for class names."""
    answers = given.table(spark, folder, "conversations")
    return answers.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        X.parsed_answer(F.col("text"), ["I", "A", "THE", "YOU", "IS"]).alias("prediction"),
    )


@query(
    f"""SELECT doc_id AS id, md5('{TASK}' || chr(10) || chr(10) || (
      SELECT string_agg('- ' || label || ': ' || description, chr(10) ORDER BY i)
      FROM (SELECT *, row_number() OVER () AS i FROM (VALUES {CLASS_VALUES}) c(label, description)))
      || chr(10)) AS system_digest,
    'Customer message:' || chr(10) || text || chr(10) || chr(10) || 'Class:' AS user FROM documents"""
)
def prompts(spark: SparkSession, folder: str) -> DataFrame:
    requests = scoring.requests(_texts(spark, folder), DOCUMENT_CLASSES, TASK)
    return requests.select("id", F.md5("system").alias("system_digest"), "user")


@query(
    f"""SELECT doc_id AS id, label, description FROM documents, (VALUES {CLASS_VALUES}) c(label, description)"""
)
def class_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.with_classes(_texts(spark, folder).select("id"), DOCUMENT_CLASSES)


@query(
    f"""SELECT label, description, (SELECT count(*) FROM documents WHERE upper(lang) = label) AS rows
    FROM (VALUES {CLASS_VALUES}) c(label, description)"""
)
def class_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Class definitions with blanks around them, counted and trimmed, next to the size of each class."""
    config = {"classes": {label: {"description": f"  {text}\n"} for label, text in DOCUMENT_CLASSES}}
    classes = class_table(spark, definitions(config, expected=len(DOCUMENT_CLASSES)))
    sizes = given.table(spark, folder, "documents").groupBy(F.upper("lang").alias("label")).count()
    joined = classes.join(sizes, "label", "left")
    return joined.select("label", "description", F.coalesce("count", F.lit(0)).alias("rows"))


@query("SELECT count(*) AS rows, 'missing columns: [''label'', ''title'']' AS message FROM documents")
def required_columns(spark: SparkSession, folder: str) -> DataFrame:
    """A table that has its columns passes; one that lacks some is refused before any job."""
    documents = checks.require_columns(given.table(spark, folder, "documents"), "doc_id", "text")
    message = ""
    try:
        checks.require_columns(documents, "doc_id", "title", "label")
    except ValueError as error:
        message = str(error)
    return documents.agg(F.count(F.lit(1)).alias("rows")).withColumn("message", F.lit(message))


@query(
    f"""WITH {DOCUMENTS_SQL} SELECT id, len(w) AS words, md5(array_to_string(w, ' ')) AS digest
    FROM (SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM corpus)"""
)
def word_tokens(spark: SparkSession, folder: str) -> DataFrame:
    tokens = _texts(spark, folder).select("id", X.words(F.col("text")).alias("w"))
    return tokens.select(
        "id", F.size("w").cast("bigint").alias("words"), F.md5(F.array_join("w", " ")).alias("digest")
    )


@query(f"WITH {DOCUMENTS_SQL}, {TERMS_SQL} SELECT id, term, CAST(tf AS INTEGER) AS tf FROM postings")
def ngram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return features.postings(_terms(spark, folder))


@query(
    """WITH lengths AS (
      SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i,
             sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))) AS length FROM embeddings)
    SELECT vec_id, i AS position, round(x / length, 6) AS x FROM lengths"""
)
def unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = given.table(spark, folder, "embeddings").select(
        "vec_id", unit_vector(F.col("embedding").cast("array<double>")).alias("v")
    )
    unfolded = vectors.select("vec_id", F.posexplode("v").alias("position", "x"))
    return rounded(unfolded.withColumn("position", F.col("position").cast("bigint")), "x")


# --------------------------------------------------------------------- tf-idf


@query(f"WITH {DOCUMENTS_SQL}, {VOCABULARY_SQL} SELECT term, df, round(idf, 6) AS idf FROM vocab")
def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(features.vocabulary(_texts(spark, folder)), "idf")


WEIGHTS_SQL = """
raw AS (SELECT id, term, (1 + ln(CAST(tf AS DOUBLE))) * idf AS raw FROM postings JOIN vocab USING (term)),
weights AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM raw)"""


@query(
    f"WITH {DOCUMENTS_SQL}, {VOCABULARY_SQL}, {WEIGHTS_SQL} "
    "SELECT id, term, round(weight, 6) AS weight FROM weights"
)
def tfidf_weights(spark: SparkSession, folder: str) -> DataFrame:
    terms = stored(_terms(spark, folder).withColumn("_row", F.monotonically_increasing_id()), "terms")
    weights = features.tfidf(terms, stored(features.vocabulary(terms), "vocabulary"), ["id", "term"])
    return rounded(weights, "weight")


@query(
    f"""WITH whole AS (WITH {DOCUMENTS_SQL} SELECT * FROM corpus),
    corpus AS (SELECT * FROM whole WHERE split = 'train'), {VOCABULARY_SQL},
    test_tokens AS (
      SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM whole WHERE split = 'test'),
    test_terms AS (
      SELECT id, unnest(w) AS term FROM test_tokens
      UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
      FROM test_tokens WHERE len(w) > 1),
    test_postings AS (SELECT id, term, count(*) AS tf FROM test_terms GROUP BY id, term),
    raw AS (
      SELECT id, term, (1 + ln(CAST(tf AS DOUBLE))) * idf AS raw FROM test_postings JOIN vocab USING (term))
    SELECT id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)), 6) AS weight FROM raw"""
)
def held_out_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Vocabulary learnt from the training split and applied to the test split."""
    docs = given.documents(spark, folder)
    test = features.document_terms(_split(docs, "test").select("id", "text"))
    vocab = stored(features.vocabulary(_split(docs, "train").select("id", "text")), "vocabulary")
    return rounded(features.tfidf(test, vocab, ["id", "term"]), "weight")


# ---------------------------------------------------------------- classifiers


@query(
    f"""WITH {DOCUMENTS_SQL}, c AS (SELECT v2_label, count(*) AS n FROM corpus WHERE split = 'train' GROUP BY 1)
    SELECT v2_label, round((SELECT CAST(sum(n) AS DOUBLE) / count(*) FROM c) / n, 6) AS weight FROM c"""
)
def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    train = _split(_labelled(spark, folder), "train")
    return rounded(classifiers.class_weights(train, "v2_label"), "weight")


def _text_predictions(spark: SparkSession, folder: str, label: str, balanced: bool) -> DataFrame:
    labelled = _labelled(spark, folder)
    train = taxonomy.training_view(_split(labelled, "train"), label)
    fitted = classifiers.fit_text(train, label, balanced)
    return classifiers.predict_text(fitted, taxonomy.model_view(_split(labelled, "test")))


def _judged(predictions: DataFrame, truth: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    """(id, known, above_majority): every predicted id, whether it got a class of the training data, and
    whether the model is right more often than naming the commonest class would be."""
    joined = stored(joins.aligned(truth.select("id", label), predictions), "judged")
    hits = joined.agg(F.avg((F.col(label) == F.col("prediction")).cast("double")).alias("a")).scalar()
    commonest = joined.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n") / F.sum("n")).scalar()
    known = classes.select(F.col(label).alias("prediction"), F.lit(True).alias("known")).distinct()
    return joined.join(known, "prediction", "left").select(
        "id", F.coalesce("known", F.lit(False)).alias("known"), (hits > commonest).alias("above_majority")
    )


def _judged_text(spark: SparkSession, folder: str, label: str, balanced: bool) -> DataFrame:
    labelled = _labelled(spark, folder)
    found = _text_predictions(spark, folder, label, balanced)
    return _judged(found, _split(labelled, "test"), label, _split(labelled, "train"))


JUDGED_SQL = f"WITH {DOCUMENTS_SQL} SELECT id, true AS known, true AS above_majority FROM corpus WHERE split = 'test'"


@query(JUDGED_SQL)
def v1_text_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return _judged_text(spark, folder, "v1_label", balanced=False)


@query(JUDGED_SQL)
def balanced_text_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return _judged_text(spark, folder, "v2_label", balanced=True)


VECTORS_SQL = """corpus AS (
  SELECT vec_id AS id, CAST(label AS VARCHAR) AS label,
         CASE WHEN CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 4) AS INTEGER) % 5 = 0
              THEN 'test' ELSE 'train' END AS split FROM embeddings)"""


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = given.table(spark, folder, "embeddings")
    labelled = rows.select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("string").alias("label"),
        F.when(F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 4), 16, 10).cast("int") % 5 == 0, "test")
        .otherwise("train")
        .alias("split"),
    )
    return labelled, rows.select(F.col("vec_id").alias("id"), "embedding")


def _fitted_embeddings(spark: SparkSession, folder: str) -> tuple[classifiers.Classifier, DataFrame]:
    labelled, embeddings = _vectors(spark, folder)
    joined = stored(classifiers.embedding_vectors(labelled, embeddings), "vectors")
    return classifiers.fit(_split(joined, "train"), "label", balanced=True), joined


@query(f"WITH {VECTORS_SQL} SELECT id, true AS known FROM corpus WHERE split = 'test'")
def embedding_classifier(spark: SparkSession, folder: str) -> DataFrame:
    fitted, joined = _fitted_embeddings(spark, folder)
    found = classifiers.predict(fitted, _split(joined, "test"))
    return _judged(found, _split(joined, "test"), "label", _split(joined, "train")).drop("above_majority")


@query(f"WITH {VECTORS_SQL} SELECT label, 64 AS entries, true AS within_tolerance FROM corpus WHERE split = 'train' GROUP BY label")
def classifier_gradient(spark: SparkSession, folder: str) -> DataFrame:
    """The gradient of mean weighted log loss + |w|^2 / (2 N), summed in Spark, vanishes for every class."""
    fitted, joined = _fitted_embeddings(spark, folder)
    gradient = classifiers.gradient(fitted, _split(joined, "train"), "label", balanced=True)
    return gradient.groupBy("label").agg(
        F.count(F.lit(1)).cast("int").alias("entries"), (F.max(F.abs("slope")) < 5e-3).alias("within_tolerance")
    )


TEXT_BUDGETS = (20, 100)
VECTOR_BUDGETS = (5, 10)
GRID_DRAWS = (1, 2, 3, 4, 5)
RUN = ("model", "budget", "draw")


def _grid_report(predictions: DataFrame, test: DataFrame) -> DataFrame:
    """Metrics per cell, from one grouped pass over all predictions, checked against what any class list allows."""
    outcomes = predictions.join(test.select("id", "v2_label"), "id")
    metrics = evaluation.run_metrics(evaluation.confusion_counts(outcomes, "v2_label", RUN), "v2_label", RUN)
    return metrics.select(
        *RUN, "test_examples", (F.col("accuracy").between(0, 1) & F.col("macro_f1").between(0, 1)).alias("plausible"),
        (F.col("accuracy") > F.lit(1.0) / test.agg(F.count_distinct("v2_label")).scalar()).alias("above_chance"),
    )


def _grid_sql(corpus: str, model: str, budgets: tuple[int, ...]) -> str:
    return f"""WITH {corpus}, cells AS (
      SELECT '{model}' AS model, budget, CAST(draw AS INTEGER) AS draw
      FROM (VALUES {", ".join(f"({b})" for b in budgets)}) b(budget), range(1, {len(GRID_DRAWS) + 1}) d(draw))
    SELECT model, budget, draw, (SELECT count(*) FROM corpus WHERE split = 'test') AS test_examples,
           true AS plausible, true AS above_chance FROM cells"""


@query(_grid_sql(DOCUMENTS_SQL, "tfidf_lr_v2", TEXT_BUDGETS))
def experiment_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every budget and draw of the text model."""
    labelled = _labelled(spark, folder)
    train, test = _split(labelled, "train"), _split(labelled, "test")
    mapping = given.document_mapping(spark)
    pool = taxonomy.candidates(train, mapping)
    predictions = experiments.text_grid(
        taxonomy.reusable_history(train, mapping),
        sampling.adaptation_sets(pool, TEXT_BUDGETS, len(GRID_DRAWS), classes=2),
        test,
        TEXT_BUDGETS,
        GRID_DRAWS,
    )
    return _grid_report(predictions, test)


TOPIC_OF = {str(i): ("LOW" if i < 4 else "MIDDLE" if i < 7 else "HIGH") for i in range(10)}
TOPIC_TAXONOMY = {
    "mapping": {
        topic: {
            "v1": v1,
            "v2": v1 if v1 != "HIGH" else f"HIGH_{topic}",
            "change": "unchanged" if v1 != "HIGH" else "split",
        }
        for topic, v1 in TOPIC_OF.items()
    }
}


@query(_grid_sql(VECTORS_SQL, "embedding_lr_v2", VECTOR_BUDGETS))
def embedding_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The grid on the given embeddings; three topics of one old class become classes of their own."""
    rows, embeddings = _vectors(spark, folder)
    mapping = mapping_table(spark, TOPIC_TAXONOMY)
    corpus = rows.select("id", F.col("label").alias("intent"), F.lit("").alias("text"), "split")
    labelled = taxonomy.relabelled(corpus, mapping)
    train, test = _split(labelled, "train"), _split(labelled, "test")
    pool = taxonomy.candidates(train, mapping)
    predictions = experiments.embedding_grid(
        taxonomy.reusable_history(train, mapping),
        sampling.adaptation_sets(pool, VECTOR_BUDGETS, len(GRID_DRAWS), classes=3),
        test,
        embeddings,
        VECTOR_BUDGETS,
        GRID_DRAWS,
    )
    return _grid_report(predictions, test)


# ------------------------------------------------------------------- zero-shot

SCORES_SQL = f"""{DOCUMENTS_SQL}, {VOCABULARY_SQL}, {WEIGHTS_SQL},
classes AS (SELECT * FROM (VALUES {CLASS_VALUES}) c(label, description)),
class_words AS (
  SELECT label, regexp_extract_all(lower(description), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM classes),
class_terms AS (
  SELECT label, unnest(w) AS term FROM class_words
  UNION ALL SELECT label, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
  FROM class_words),
class_raw AS (
  SELECT label, term, (1 + ln(CAST(count(*) AS DOUBLE))) * any_value(idf) AS raw
  FROM class_terms JOIN vocab USING (term) GROUP BY label, term),
class_weights AS (
  SELECT label, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY label)) AS weight FROM class_raw),
products AS (
  SELECT w.id, c.label, sum(w.weight * c.weight) AS cosine
  FROM weights w JOIN class_weights c USING (term) GROUP BY w.id, c.label),
grid AS (
  SELECT corpus.id, label, coalesce(cosine, 0) AS cosine
  FROM corpus CROSS JOIN classes LEFT JOIN products USING (id, label)),
odds AS (SELECT id, label, exp(cosine / 0.1) / sum(exp(cosine / 0.1)) OVER (PARTITION BY id) AS p FROM grid),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, label) AS place FROM odds),
scores AS (
  SELECT id, max(label) FILTER (place = 1) AS prediction,
         round(max(p) FILTER (place = 1), 6) AS probability,
         round(max(p) FILTER (place = 1) - max(p) FILTER (place = 2), 6) AS confidence
  FROM placed GROUP BY id)"""


def _shown(scores: DataFrame) -> DataFrame:
    return scores.select(
        "id",
        "prediction",
        short(F.element_at("probabilities", F.col("prediction"))).alias("probability"),
        short(F.col("confidence")).alias("confidence"),
    )


@query(f"WITH {SCORES_SQL} SELECT id, prediction, probability, confidence FROM scores")
def lexical_scores(spark: SparkSession, folder: str) -> DataFrame:
    vocab = _frozen_vocabulary(spark, folder)
    return _shown(scoring.lexical_scores(_texts(spark, folder), DOCUMENT_CLASSES, vocab))


@query(f"WITH {SCORES_SQL} SELECT id, prediction, probability FROM scores")
def argmax_class(spark: SparkSession, folder: str) -> DataFrame:
    """Best class from the long form (id, label, p)."""
    vocab = _frozen_vocabulary(spark, folder)
    scores = scoring.lexical_scores(_texts(spark, folder), DOCUMENT_CLASSES, vocab)
    best = scoring.argmax_class(scores.select("id", F.explode("probabilities").alias("label", "p")))
    return rounded(best, "probability")


def marker_scorer(classes: scoring.Classes) -> Callable[[], scoring.Scorer]:
    """A user's scorer: counts marker words of each class and answers in a sentence."""

    def load() -> scoring.Scorer:
        markers = {label: text.split(" ") for label, text in sorted(classes)}

        def answer(texts: list[str]) -> list[str]:
            answers = []
            for text in texts:
                seen = Counter(text.lower().split(" "))
                points = {label: sum(seen[word] for word in words) for label, words in markers.items()}
                answers.append(f"Class: {max(sorted(points), key=points.get)}.")
            return answers

        return answer

    return load


MARKERS_SQL = f"""
WITH words AS (SELECT doc_id AS id, unnest(string_split(lower(text), ' ')) AS word FROM documents),
markers AS (
  SELECT label, unnest(string_split(description, ' ')) AS word FROM (VALUES {CLASS_VALUES}) c(label, description)),
points AS (SELECT id, label, count(*) AS n FROM words JOIN markers USING (word) GROUP BY id, label),
grid AS (
  SELECT doc_id AS id, c.label, coalesce(n, 0) AS n
  FROM documents CROSS JOIN (VALUES {CLASS_VALUES}) c(label, description)
  LEFT JOIN points ON points.id = doc_id AND points.label = c.label),
answers AS (
  SELECT id, label AS prediction FROM grid
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1)"""


@query(f"{MARKERS_SQL} SELECT id, 'Class: ' || prediction || '.' AS raw_output, prediction FROM answers")
def user_scorer_answers(spark: SparkSession, folder: str) -> DataFrame:
    answers = scoring.answers_of(_texts(spark, folder), marker_scorer(DOCUMENT_CLASSES))
    return answers.select("id", "raw_output", X.parsed_answer(F.col("raw_output"), CODES).alias("prediction"))


@query(f"{MARKERS_SQL} SELECT id, prediction, CASE WHEN id IN (SELECT doc_id FROM labels) THEN 1 ELSE 2 END AS run FROM answers")
def resumed_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A first run scores the documents with labels; a second run adds the rest and skips those."""
    texts = _texts(spark, folder)
    first = texts.join(given.table(spark, folder, "labels"), F.col("id") == F.col("doc_id"), "left_semi")
    path, version = new_path(spark, "results"), scoring.version_of(DOCUMENT_CLASSES)

    def score(rows: DataFrame) -> DataFrame:
        answers = scoring.answers_of(rows, marker_scorer(DOCUMENT_CLASSES))
        return answers.select("id", X.parsed_answer(F.col("raw_output"), CODES).alias("prediction"))

    scoring.score_pending(first, score, path, "markers", version, run=1)
    return scoring.score_pending(texts, score, path, "markers", version, run=2).select("id", "prediction", "run")


@query("SELECT doc_id AS id, md5(text) AS digest FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_inputs(spark: SparkSession, folder: str) -> DataFrame:
    done = given.table(spark, folder, "labels").select(F.col("doc_id").alias("id"))
    return joins.pending(_texts(spark, folder), done, "id").select("id", F.md5("text").alias("digest"))


@query("SELECT doc_id AS id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def requested_results(spark: SparkSession, folder: str) -> DataFrame:
    english = given.table(spark, folder, "documents").where(F.col("lang") == "en")
    results = given.table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "quality")
    return joins.requested(results, english.select(F.col("doc_id").alias("id")))


@query(
    """SELECT count(*) AS inputs, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS done FROM documents"""
)
def progress_count(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the inputs already have a result."""
    keys = given.table(spark, folder, "documents").select("doc_id")
    done = keys.intersect(given.table(spark, folder, "labels").select("doc_id"))
    return keys.agg(F.count(F.lit(1)).alias("inputs")).withColumn("done", done.agg(F.count(F.lit(1))).scalar())


@query(
    """SELECT user_id, event_id, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""
)
def latest_results(spark: SparkSession, folder: str) -> DataFrame:
    events = given.table(spark, folder, "events")
    return scoring.latest(events, ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT doc_id AS id, md5(text) AS digest FROM documents ORDER BY doc_id LIMIT 25")
def trial_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """The first inputs by id, for a trial run."""
    first = _texts(spark, folder).orderBy("id").limit(25)
    return first.select("id", F.md5("text").alias("digest"))


RESPONSE_QUESTION = "queue"


def _responses(spark: SparkSession, folder: str) -> DataFrame:
    """Response JSON derived from the documents; one in ten is broken in one of five ways."""
    rows = given.table(spark, folder, "documents")
    p = (40 + F.col("doc_id") % 55) / 100
    answer = F.struct(
        F.when(F.col("doc_id") % 50 == 7, "text").otherwise("choice").alias("type"),
        F.when(F.col("doc_id") % 50 != 17, F.upper("lang")).alias("choice"),
        (F.col("n_chars") % 101 / 100).alias("confidence"),
        F.create_map(F.upper("lang"), p, F.lit("OTHER"), 1 - p).alias("probabilities"),
    )
    usage = F.struct(
        F.when(F.col("doc_id") % 50 == 27, "many").otherwise(F.col("n_chars").cast("string")).alias("input_tokens"),
        (F.col("doc_id") % 3).alias("output_tokens"),
    )
    question = F.when(F.col("doc_id") % 50 == 37, "another").otherwise(RESPONSE_QUESTION)
    body = F.struct(F.col("source").alias("model"), F.create_map(question, answer).alias("answers"), usage.alias("usage"))
    text = F.to_json(body)
    return rows.select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 50 == 47, F.substring(text, 1, 40)).otherwise(text).alias("raw_response")
    )


@query(
    """SELECT doc_id AS id, upper(lang) AS prediction, round(CAST(n_chars % 101 AS DOUBLE) / 100, 6) AS confidence,
    round(CAST(40 + doc_id % 55 AS DOUBLE) / 100, 6) AS p, round(1 - CAST(40 + doc_id % 55 AS DOUBLE) / 100, 6) AS other,
    source AS response_model, n_chars AS input_tokens, doc_id % 3 AS output_tokens
    FROM documents WHERE doc_id % 10 <> 7"""
)
def typed_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Nested response JSON to typed columns."""
    sound, _ = scoring.split_responses(_responses(spark, folder), RESPONSE_QUESTION)
    shares = {"p": F.element_at("probabilities", F.col("prediction")), "other": F.element_at("probabilities", F.lit("OTHER"))}
    columns = ["id", "prediction", "confidence", *shares, "response_model", "input_tokens", "output_tokens"]
    return rounded(sound.withColumns(shares).select(*columns), "confidence", *shares)


@query(
    """SELECT doc_id AS id, CASE doc_id % 50 WHEN 7 THEN 'expected a choice answer' WHEN 17 THEN 'no choice is named'
      WHEN 27 THEN 'input_tokens of another type' WHEN 37 THEN 'no answer to the question' ELSE 'no JSON' END AS problem
    FROM documents WHERE doc_id % 10 = 7"""
)
def bad_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Responses that cannot be used, with the reason."""
    _, bad = scoring.split_responses(_responses(spark, folder), RESPONSE_QUESTION)
    return bad.select("id", "problem")


@query(
    f"""SELECT doc_id AS id, md5(text) AS digest, 'm' AS model, 'choice' AS type,
    '{DOCUMENT_CLASSES[0][1]}' AS first_class FROM documents"""
)
def choice_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Request bodies; read back field by field."""
    bodies = scoring.choice_requests(_texts(spark, folder), DOCUMENT_CLASSES, "m", RESPONSE_QUESTION, TASK)
    field = lambda path: F.get_json_object("body", path)
    return bodies.select(
        "id",
        F.md5(field("$.state")).alias("digest"),
        field("$.model").alias("model"),
        field(f"$.questions.{RESPONSE_QUESTION}.type").alias("type"),
        field(f"$.questions.{RESPONSE_QUESTION}.criteria.EN").alias("first_class"),
    )


@query(
    """SELECT doc_id AS id, 1 + CAST(doc_id % 2 = 0 AS INT) + CAST(doc_id % 3 = 0 AS INT) AS results,
    CASE WHEN doc_id % 3 = 0 THEN 3 WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS n, 1 AS kept FROM documents"""
)
def appended_results(spark: SparkSession, folder: str) -> DataFrame:
    """Runs appended to one table: two at once, one that stops half-way and is repeated; then merged to the last per id."""
    ids = _texts(spark, folder).select("id")
    results = ResultsTable(spark, new_path(spark, "appended"), T.StructType.fromDDL("id bigint, n int"))

    def written(rows: DataFrame, n: int, run: int) -> Part:
        return results.write(rows.withColumn("n", F.lit(n)), "all", "batch", run)

    together = [written(ids, 1, 1), written(ids.where("id % 2 = 0"), 2, 2)]
    for part in together:
        results.add(part)
    written(ids, 99, 3)
    results.add(written(ids.where("id % 3 = 0"), 3, 3))
    before = results.read("all").groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("results"))
    results.merge("all", everything=True)
    after = results.read("all").groupBy("id").agg(F.max("n").alias("n"), F.count(F.lit(1)).cast("int").alias("kept"))
    return before.join(after, "id")


@query(f"WITH {SCORES_SQL} SELECT id, prediction, probability, confidence FROM scores")
def streamed_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The lexical scorer as an incremental job; ends with the same table as the batch."""
    schema = given.SCHEMAS["documents"]
    vocab = _frozen_vocabulary(spark, folder)
    results, checkpoint = new_path(spark, "streamed"), new_path(spark, "checkpoint")
    stream = file_stream(spark, f"{folder}/documents*.parquet", schema).select(
        F.col("doc_id").alias("id"), "text"
    )

    def score(rows: DataFrame) -> DataFrame:
        return scoring.lexical_scores(spread(rows, "id"), DOCUMENT_CLASSES, vocab)

    version = scoring.version_of(DOCUMENT_CLASSES)
    fields = scoring.lexical_schema(T.LongType())
    score_stream(stream, score, results, checkpoint, "lexical", version, fields).awaitTermination()
    found = scoring.read_results(spark, results, scoring.result_schema(fields))
    return _shown(scoring.latest(found, scoring.KEYS, ["run"]))


@query(
    f"""{MARKERS_SQL}, scored AS (SELECT id, prediction, upper(prediction) AS shouted FROM answers)
    SELECT 'markers' AS scorer, '1' AS class_version, id, prediction FROM scored
    UNION ALL SELECT 'markers', '2', id, prediction || '2' FROM scored
    UNION ALL SELECT 'other/one', '1', id, 'x' || shouted FROM scored"""
)
def shared_results(spark: SparkSession, folder: str) -> DataFrame:
    """Two scorers and two class versions share a table through streams of several files, run numbers alike."""
    path, arriving = new_path(spark, "shared-results"), new_path(spark, "arriving")
    texts = _texts(spark, folder)
    # Three batches whatever the size; the files of a batch are as many as its share of the table needs.
    files = max(1, -(-given.table(spark, folder, "documents").select("doc_id", "text").rdd.getNumPartitions() // 3))
    texts.repartition(3 * files, "id").write.parquet(arriving)

    def scorer(change: Callable) -> Callable[[DataFrame], DataFrame]:
        def score(rows: DataFrame) -> DataFrame:
            answers = scoring.answers_of(rows, marker_scorer(DOCUMENT_CLASSES))
            return answers.select("id", change(X.parsed_answer(F.col("raw_output"), CODES)).alias("prediction"))

        return score

    jobs = [
        ("markers", "1", lambda c: c),
        ("markers", "2", lambda c: F.concat(c, F.lit("2"))),
        ("other/one", "1", lambda c: F.concat(F.lit("x"), F.upper(c))),
    ]
    fields = T.StructType([T.StructField("id", T.LongType()), T.StructField("prediction", T.StringType())])
    for name, version, change in jobs:
        stream = file_stream(spark, arriving, "id bigint, text string", files_per_batch=files)
        score_stream(stream, scorer(change), path, new_path(spark, "checkpoint"), name, version, fields).awaitTermination()
    found = scoring.read_results(spark, path, scoring.result_schema(fields))
    return scoring.latest(found, scoring.KEYS, ["run"]).select("scorer", "class_version", "id", "prediction")
