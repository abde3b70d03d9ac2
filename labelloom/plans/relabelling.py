"""Relabelling, transition analysis and sampling of new labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.names import row_id
from labelloom.operators import checks, joins, sampling, taxonomy
from labelloom.operators.runs import run_cards
from labelloom.plans import inputs as given
from labelloom.plans.inputs import AFFECTED, BUDGETS, DRAWS, ORDERS_SQL, SAMPLE_FLOOR, SAMPLE_SHARE
from labelloom.plans.registry import query, rounded
from labelloom.session import new_path
from labelloom.sizing import dimension
from labelloom.sources.tables import (
    read_adaptation_set,
    read_csv,
    read_splits,
    training_rows,
    write_adaptation_sets,
    write_csv,
)
from labelloom.sources.taxonomy import mapping_table


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return taxonomy.relabelled(given.orders(spark, folder), given.order_mapping(spark))


def _pool(spark: SparkSession, folder: str) -> DataFrame:
    return taxonomy.candidates(_labelled(spark, folder), given.order_mapping(spark))


def _sets(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.adaptation_sets(_pool(spark, folder), BUDGETS, DRAWS, AFFECTED)


def _sample(spark: SparkSession, folder: str) -> DataFrame:
    """A share of every class, so that the sample keeps the classes' proportions, but enough rows of the small ones."""
    labelled = _labelled(spark, folder)
    sizes = sampling.proportional_sizes(labelled, "v2_label", SAMPLE_SHARE, SAMPLE_FLOOR)
    return sampling.frozen_sample(labelled, "v2_label", sizes)


def _topics(spark: SparkSession) -> DataFrame:
    return dimension(spark, [(i, f"topic_{i}") for i in range(10)], "label int, intent string")


# --------------------------------------------------------------------- sources


@query(
    """SELECT doc_id, lang, length(text) AS characters, 'train' AS split FROM documents
    UNION ALL SELECT item_id, NULL, length(text), 'test' FROM benchmark"""
)
def corpus_splits(spark: SparkSession, folder: str) -> DataFrame:
    train = given.table(spark, folder, "documents").select("doc_id", "lang", "text")
    train.write.parquet(train_path := new_path(spark, "train"))
    benchmark = spark.read.schema("item_id bigint, text string").parquet(f"{folder}/benchmark.parquet")
    test_path = new_path(spark, "test")
    benchmark.select(F.col("item_id").alias("doc_id"), "text").write.parquet(test_path)
    splits = read_splits(
        spark, {"train": train_path, "test": test_path}, "doc_id bigint, lang string, text string"
    )
    return splits.select("doc_id", "lang", F.length("text").alias("characters"), "split")


@query(
    """SELECT doc_id, source, n_chars, md5(CASE doc_id % 5 WHEN 0 THEN '  ' || text WHEN 1 THEN text || ' ' || chr(9)
             WHEN 2 THEN text WHEN 3 THEN '' END) AS digest,
           CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN lang END AS lang,
           coalesce(length(CASE doc_id % 5 WHEN 0 THEN '  ' || text WHEN 1 THEN text || ' ' || chr(9)
             WHEN 2 THEN text WHEN 3 THEN '' END), -1) AS characters FROM documents"""
)
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts, with quotes, commas, line ends and outer blanks, empty texts and nulls through CSV and back."""
    rest, third = F.col("doc_id") % 5, F.col("doc_id") % 3
    text = (
        F.when(rest == 0, F.concat(F.lit("  "), "text"))
        .when(rest == 1, F.concat("text", F.lit(" \t")))
        .when(rest == 2, F.col("text"))
        .when(rest == 3, "")
    )
    documents = given.table(spark, folder, "documents").withColumns(
        {"text": text, "lang": F.when(third == 0, "").when(third == 1, F.col("lang"))}
    )
    path = new_path(spark, "csv")
    write_csv(documents, path)
    back = read_csv(spark, path, documents.schema)
    return back.select(
        "doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest"),
        F.coalesce(F.length("text"), F.lit(-1)).cast("bigint").alias("characters"),
    )


@query(
    """SELECT v2 AS queue, description, count(*) AS rows FROM (
      SELECT CASE WHEN o_orderpriority[1] IN ('1', '2') AND o_orderstatus = 'P' THEN 'REVIEW'
             WHEN o_orderpriority[1] = '1' THEN 'EXPEDITE' WHEN o_orderpriority[1] = '2' THEN 'PRIORITY'
             WHEN o_orderpriority[1] = '3' THEN 'STANDARD' ELSE 'SLOW' END AS v2,
             'Orders handled as ' || lower(v2) || '.' AS description FROM orders) GROUP BY ALL"""
)
def queue_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Queues of the new taxonomy with their description and size."""
    counted = taxonomy.class_counts(_labelled(spark, folder), "v2_label").withColumnRenamed("label", "queue")
    queues = given.order_queues(spark).where(F.col("stage") == "v2")
    return queues.join(counted, "queue").select("queue", "description", "rows")


@query(
    f"""WITH {ORDERS_SQL}, ranked AS (
      SELECT id, text, v2_label, row_number() OVER (PARTITION BY v2_label ORDER BY md5('{sampling.SEED + 2 * sampling.DRAW_STEP}:' || id), id) AS r
      FROM corpus WHERE v1_label = 'FAST')
    SELECT 2 AS draw, 20 AS budget, id, text, v2_label FROM ranked WHERE r <= 20"""
)
def adaptation_set_read(spark: SparkSession, folder: str) -> DataFrame:
    """All draws written in one job; one cell read back through partition pruning."""
    sets = _sets(spark, folder)
    path = new_path(spark, "adaptation")
    write_adaptation_sets(sets, path)
    return read_adaptation_set(spark, path, sets.schema, draw=2, budget=20)


# ----------------------------------------------------------------- projections


@query("SELECT 'train_' || lpad(CAST(vec_id AS VARCHAR), 5, '0') AS id, 'topic_' || label AS intent FROM embeddings")
def class_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = given.table(spark, folder, "embeddings").select(
        row_id(F.lit("train"), F.col("vec_id")).alias("id"), "label"
    )
    return taxonomy.named_classes(rows, _topics(spark))


@query(
    """SELECT 'doc_' || CASE WHEN doc_id < 100000 THEN lpad(CAST(doc_id AS VARCHAR), 5, '0')
    ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents"""
)
def row_ids(spark: SparkSession, folder: str) -> DataFrame:
    return given.table(spark, folder, "documents").select(row_id(F.lit("doc"), F.col("doc_id")).alias("id"))


@query(f"WITH {ORDERS_SQL} SELECT id, intent, v1_label, v2_label FROM corpus")
def relabelled_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder).select("id", "intent", "v1_label", "v2_label")


@query(f"WITH {ORDERS_SQL} SELECT id, text FROM corpus")
def model_view(spark: SparkSession, folder: str) -> DataFrame:
    return taxonomy.model_view(_labelled(spark, folder))


@query(f"WITH {ORDERS_SQL} SELECT id, text, v2_label FROM corpus")
def training_view(spark: SparkSession, folder: str) -> DataFrame:
    return taxonomy.training_view(_labelled(spark, folder))


@query(f"WITH {ORDERS_SQL} SELECT id, text, v1_label, v2_label FROM corpus WHERE v1_label <> 'FAST'")
def reusable_history(spark: SparkSession, folder: str) -> DataFrame:
    return taxonomy.reusable_history(_labelled(spark, folder), given.order_mapping(spark))


@query(f"WITH {ORDERS_SQL} SELECT id, intent, v2_label FROM corpus WHERE v1_label = 'FAST'")
def candidate_pool(spark: SparkSession, folder: str) -> DataFrame:
    return _pool(spark, folder).select("id", "intent", "v2_label")


@query(f"WITH {ORDERS_SQL} SELECT id, intent FROM corpus WHERE v2_label = 'REVIEW'")
def class_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder).where(F.col("v2_label") == "REVIEW").select("id", "intent")


@query("SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def complete_rows(spark: SparkSession, folder: str) -> DataFrame:
    documents = given.table(spark, folder, "documents").select("doc_id")
    joined = documents.join(given.table(spark, folder, "labels"), "doc_id", "left")
    return joined.dropna(subset=["quality", "toxic"])


# ----------------------------------------------------------------- aggregations


@query(
    f"""WITH {ORDERS_SQL} SELECT name AS label, count(id) AS rows
    FROM (SELECT unnest(['EXPEDITE', 'PRIORITY', 'REVIEW', 'STANDARD', 'SLOW', 'ARCHIVE']) AS name)
    LEFT JOIN corpus ON v2_label = name GROUP BY name"""
)
def class_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per class in a given class list, with a class that never occurs."""
    names = [(q,) for q in ("EXPEDITE", "PRIORITY", "REVIEW", "STANDARD", "SLOW", "ARCHIVE")]
    classes = dimension(spark, names, "label string")
    return taxonomy.class_counts(_labelled(spark, folder), "v2_label", classes)


@query(
    f"""WITH {ORDERS_SQL} SELECT coalesce(v2_label, 'TOTAL') AS queue, count(*) FILTER (split = 'train') AS train,
    count(*) FILTER (split = 'test') AS test, count(*) AS total,
    round(count(*) FILTER (split = 'train') / (SELECT CAST(count(*) AS DOUBLE) FROM corpus WHERE split = 'train'), 6)
      AS share
    FROM corpus GROUP BY ROLLUP (v2_label)"""
)
def queue_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(taxonomy.queue_distribution(_labelled(spark, folder), "v2_label"), "share")


@query(
    f"""WITH {ORDERS_SQL} SELECT 'intent' AS "column", count(DISTINCT intent) AS "values" FROM corpus
    UNION ALL SELECT 'v1_label', count(DISTINCT v1_label) FROM corpus
    UNION ALL SELECT 'v2_label', count(DISTINCT v2_label) FROM corpus
    UNION ALL SELECT 'id', count(DISTINCT id) FROM corpus"""
)
def distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    return taxonomy.distinct_counts(_labelled(spark, folder), "id", "intent", "v1_label", "v2_label")


@query(
    f"""WITH {ORDERS_SQL} SELECT 'intent' AS "column", 3 AS loads, count(*) AS rows, count(DISTINCT intent) AS "values" FROM corpus
    UNION ALL SELECT 'v2_label', 3, count(*), count(DISTINCT v2_label) FROM corpus
    UNION ALL SELECT 'customer', 3, count(*), (SELECT count(DISTINCT o_custkey % 1000) FROM orders) FROM corpus"""
)
def distinct_counts_over_loads(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of three loads, each written by itself, give the distinct counts of all rows."""
    path = new_path(spark, "sketches")
    customer = given.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 1000).alias("customer"))
    rows = _labelled(spark, folder).join(customer, "id")
    for load in range(3):
        taxonomy.distinct_sketches(rows.where(F.col("id") % 3 == load), "intent", "v2_label", "customer").write.mode("append").parquet(path)
    kept = spark.read.schema("column string, rows bigint, sketch binary").parquet(path)
    return taxonomy.merged_distinct_counts(kept).withColumn("loads", F.col("loads").cast("int"))


@query(f"WITH {ORDERS_SQL} SELECT v1_label, v2_label, count(*) AS rows FROM corpus GROUP BY ALL")
def transition_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return taxonomy.transition_matrix(_labelled(spark, folder))


@query(
    f"""WITH {ORDERS_SQL}, queues AS (
      SELECT v1_label, string_agg(DISTINCT v2_label, ',' ORDER BY v2_label) AS destinations,
             count(DISTINCT v2_label) AS n, count(*) AS rows FROM corpus GROUP BY v1_label)
    SELECT v1_label, destinations, CASE n WHEN 1 THEN 'CLEAN' ELSE 'IMPURE' END AS status, rows FROM queues"""
)
def queue_status(spark: SparkSession, folder: str) -> DataFrame:
    status = taxonomy.queue_status(given.order_mapping(spark)).withColumnRenamed("v1", "v1_label")
    counted = taxonomy.class_counts(_labelled(spark, folder), "v1_label").withColumnRenamed("label", "v1_label")
    return counted.join(F.broadcast(status), "v1_label").select(
        "v1_label", F.array_join("destinations", ",").alias("destinations"), "status", "rows"
    )


@query(
    f"""WITH {ORDERS_SQL} SELECT CASE v1_label WHEN 'FAST' THEN 'IMPURE' ELSE 'CLEAN' END AS status,
    v1_label, count(*) AS rows FROM corpus GROUP BY ALL"""
)
def clean_and_impure_rows(spark: SparkSession, folder: str) -> DataFrame:
    labelled, mapping = _labelled(spark, folder), given.order_mapping(spark)
    parts = [
        taxonomy.rows_by_status(labelled, mapping, status).withColumn("status", F.lit(status))
        for status in ("CLEAN", "IMPURE")
    ]
    return parts[0].unionByName(parts[1]).groupBy("status", "v1_label").agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {ORDERS_SQL} SELECT v2_label AS v2, count(*) AS rows, count(*) >= 100 AS enough FROM corpus WHERE v1_label = 'FAST' GROUP BY 1")
def candidate_supply(spark: SparkSession, folder: str) -> DataFrame:
    affected = taxonomy.affected_queues(given.order_mapping(spark))
    return taxonomy.candidate_supply(_pool(spark, folder), affected, max(BUDGETS))


@query(
    f"""WITH {ORDERS_SQL} SELECT DISTINCT v2_label AS v2 FROM corpus WHERE v1_label IN (
      SELECT v1_label FROM corpus GROUP BY v1_label HAVING count(DISTINCT v2_label) > 1)"""
)
def affected_queues(spark: SparkSession, folder: str) -> DataFrame:
    """Affected queues that the corpus really uses."""
    affected = taxonomy.affected_queues(given.order_mapping(spark))
    used = taxonomy.class_counts(_labelled(spark, folder), "v2_label").select(F.col("label").alias("v2"))
    return affected.join(used, "v2", "left_semi")


@query(
    f"""WITH {ORDERS_SQL} SELECT budget, count(DISTINCT v2_label) * budget AS new_labels
    FROM corpus, (VALUES (20), (100)) b(budget) WHERE v1_label = 'FAST' GROUP BY budget"""
)
def label_cost(spark: SparkSession, folder: str) -> DataFrame:
    return taxonomy.new_labels(_pool(spark, folder).select(F.col("v2_label").alias("v2")), BUDGETS)


# -------------------------------------------------------------------- sampling

SAMPLE_SQL = f"""{ORDERS_SQL}, allocation AS (
  SELECT v2_label, least(count(*), greatest({SAMPLE_FLOOR}, CAST(ceil(count(*) * CAST({SAMPLE_SHARE} AS DOUBLE)) AS BIGINT))) AS size,
         {sampling.SEED} + row_number() OVER (ORDER BY v2_label) - 1 AS seed FROM corpus GROUP BY v2_label),
sample AS (
  SELECT * FROM (
    SELECT corpus.*, size, row_number() OVER (PARTITION BY v2_label ORDER BY md5(seed || ':' || id), id) AS r
    FROM corpus JOIN allocation USING (v2_label)) WHERE r <= size)"""

DRAWS_SQL = f"""{ORDERS_SQL}, drawn AS (
  SELECT draw, id, text, v2_label,
         row_number() OVER (PARTITION BY draw, v2_label ORDER BY md5(({sampling.SEED} + {sampling.DRAW_STEP} * draw) || ':' || id), id) AS r
  FROM corpus, range(1, 6) d(draw) WHERE v1_label = 'FAST'),
sets AS (
  SELECT CAST(draw AS INTEGER) AS draw, budget, id, text, v2_label
  FROM drawn, (VALUES (20), (100)) b(budget) WHERE r <= budget)"""


@query(f"WITH {SAMPLE_SQL} SELECT id, v1_label, v2_label FROM sample")
def frozen_test_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _sample(spark, folder).select("id", "v1_label", "v2_label")


@query(f"WITH {SAMPLE_SQL} SELECT id, text FROM sample ORDER BY md5('{sampling.SEED}:' || id), id")
def shuffled_sample(spark: SparkSession, folder: str) -> DataFrame:
    return taxonomy.model_view(sampling.shuffled(_sample(spark, folder)))


@query(f"WITH {DRAWS_SQL} SELECT draw, budget, id, text, v2_label FROM sets")
def nested_draws(spark: SparkSession, folder: str) -> DataFrame:
    return _sets(spark, folder)


@query(
    f"""WITH {DRAWS_SQL} SELECT draw, budget, count(*) AS rows, count(DISTINCT v2_label) AS classes,
    CAST(0 AS BIGINT) AS outside_larger FROM sets GROUP BY draw, budget"""
)
def nested_check(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of all cells, and rows of the small budget that the large one lacks."""
    sets = _sets(spark, folder)
    strays = sampling.nesting_violations(sets, *BUDGETS).agg(F.count(F.lit(1))).scalar()
    return sets.groupBy("draw", "budget").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("v2_label").alias("classes"),
    ).withColumn("outside_larger", strays)


@query(
    f"""WITH {DRAWS_SQL}, wanted AS (
      SELECT CAST(draw AS INTEGER) AS draw, budget, v2_label FROM range(1, 8) d(draw),
      (VALUES (20), (100)) b(budget), (VALUES ('EXPEDITE'), ('PRIORITY'), ('REVIEW')) c(v2_label))
    SELECT draw, budget, v2_label, CAST(0 AS BIGINT) AS rows FROM wanted ANTI JOIN sets USING (draw, budget, v2_label)"""
)
def budget_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Two more draws are expected than were made, so their cells are reported."""
    affected = taxonomy.affected_queues(given.order_mapping(spark))
    return sampling.budget_violations(_sets(spark, folder), affected, BUDGETS, DRAWS + 2)


@query(
    f"""WITH {ORDERS_SQL} SELECT v2_label AS label, 5000000 AS size, count(*) AS rows FROM corpus
    WHERE v2_label IN ('SLOW', 'REVIEW') GROUP BY v2_label HAVING count(*) < 5000000"""
)
def small_strata(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.undersized_strata(
        _labelled(spark, folder), "v2_label", {"SLOW": 5_000_000, "REVIEW": 5_000_000}
    )


TRAINING_SQL = f"""{DRAWS_SQL},
training AS (
  SELECT draw, budget, id, text, v2_label, true AS is_new FROM sets
  UNION ALL SELECT CAST(draw AS INTEGER), budget, id, text, v2_label, false
  FROM corpus, range(1, 6) d(draw), (VALUES (20), (100)) b(budget) WHERE v1_label <> 'FAST')"""


@query(f"WITH {TRAINING_SQL} SELECT id, text, v2_label, is_new FROM training WHERE draw = 3 AND budget = 100")
def training_set(spark: SparkSession, folder: str) -> DataFrame:
    cell = _sets(spark, folder).where((F.col("draw") == 3) & (F.col("budget") == 100))
    history = taxonomy.reusable_history(_labelled(spark, folder), given.order_mapping(spark))
    return joins.unique_keys(training_rows(history, cell), "id")


@query(
    f"""WITH {TRAINING_SQL} SELECT draw, budget, count(*) AS training_examples,
    count(DISTINCT v2_label) AS classes, count(*) FILTER (is_new) AS new_labels
    FROM training GROUP BY draw, budget"""
)
def run_card(spark: SparkSession, folder: str) -> DataFrame:
    """History is counted once per class and then joins the cells as a few rows."""
    history = taxonomy.reusable_history(_labelled(spark, folder), given.order_mapping(spark))
    reused = history.agg(
        F.struct(F.count(F.lit(1)).alias("rows"), F.count_distinct("v2_label").alias("classes")).alias("h")
    ).scalar()
    cards = run_cards(_sets(spark, folder).withColumn("is_new", F.lit(True)), ["draw", "budget"])
    return cards.select(
        "draw",
        "budget",
        (F.col("training_examples") + reused["rows"]).alias("training_examples"),
        (F.col("classes") + reused["classes"]).alias("classes"),
        "new_labels",
    )


# ---------------------------------------------------------------------- checks

BROKEN_INTENTS = ("1-URGENT/F", "5-LOW/O")


@query(
    """SELECT 'coverage' AS rule, '1-URGENT/F' AS key, 'not in the mapping' AS message
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')
    UNION ALL SELECT 'coverage', 'RETIRED', 'not in the corpus'
    UNION ALL SELECT 'change', '5-LOW/O', 'change type contradicts the queues'
    UNION ALL SELECT 'change type', '5-LOW/P', 'is not split, move or unchanged'
    UNION ALL SELECT 'queue', 'RETIRED', 'v2 queue is not defined'
    UNION ALL SELECT 'description', 'v1.SLOW', 'description is blank'
    UNION ALL SELECT 'queue count', 'v2', 'expected 6, found 5'
    UNION ALL SELECT 'intent count', 'mapping', 'expected 16, found ' ||
      (SELECT count(DISTINCT o_orderpriority || o_orderstatus) FROM orders)
    UNION ALL SELECT 'header', 'version', 'is not 2.0'"""
)
def taxonomy_violations(spark: SparkSession, folder: str) -> DataFrame:
    """A broken variant of the taxonomy, checked against the intents of the corpus."""
    mapping = {k: dict(v) for k, v in given.ORDER_TAXONOMY["mapping"].items() if k != "1-URGENT/F"}
    mapping["5-LOW/O"]["change"] = "move"
    mapping["5-LOW/P"]["change"] = "renamed"
    mapping["RETIRED"] = {"v1": "SLOW", "v2": "GONE", "change": "move"}
    broken = {**given.ORDER_TAXONOMY, "mapping": mapping}
    broken["v1"] = {**broken["v1"], "SLOW": {"description": "  "}}
    return checks.taxonomy_violations(
        given.queue_table(spark, broken),
        mapping_table(spark, broken),
        given.orders(spark, folder).select("intent"),
        {"v1": 3, "v2": 6},
        16,
        checks.taxonomy_header_violations(broken, "2.0", "orders"),
    )


@query(
    f"""WITH {ORDERS_SQL} SELECT 'missing' AS kind, intent FROM corpus
    WHERE intent IN ('1-URGENT/F', '5-LOW/O') GROUP BY intent"""
)
def label_coverage(spark: SparkSession, folder: str) -> DataFrame:
    mapping = given.order_mapping(spark).where(~F.col("intent").isin(*BROKEN_INTENTS))
    return joins.coverage(mapping, given.orders(spark, folder), "intent").select("kind", "intent")


@query(
    f"""WITH {ORDERS_SQL} SELECT DISTINCT intent FROM corpus WHERE v2_label <> 'SLOW'"""
)
def label_difference(spark: SparkSession, folder: str) -> DataFrame:
    slow = given.order_mapping(spark).where(F.col("v2") == "SLOW")
    return joins.key_difference(given.orders(spark, folder), slow, "intent")


@query(
    """SELECT 'rows' AS measure, CAST(1 AS BIGINT) AS expected, count(*) AS found FROM orders
    UNION ALL SELECT 'classes in v1_label', 4, count(DISTINCT least(o_orderpriority[1], '4')) - 1 FROM orders
    UNION ALL SELECT 'classes in v2_label', 6, 5"""
)
def expected_counts(spark: SparkSession, folder: str) -> DataFrame:
    return checks.count_violations(
        _labelled(spark, folder), ["text", "v1_label"], rows=1, classes={"v1_label": 4, "v2_label": 6}
    )


@query(
    f"""WITH {ORDERS_SQL} SELECT v1_label, count(DISTINCT intent) AS labels, count(*) AS rows
    FROM corpus WHERE v1_label <> 'FAST' GROUP BY v1_label"""
)
def ambiguous_clean_queues(spark: SparkSession, folder: str) -> DataFrame:
    """History labelled with intents instead of queues breaks the rule of one label per clean queue."""
    labelled = _labelled(spark, folder).select("id", "v1_label", F.col("intent").alias("v2_label"))
    return checks.ambiguous_clean_queues(labelled, given.order_mapping(spark))
