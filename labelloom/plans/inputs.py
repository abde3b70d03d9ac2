"""Inputs of the registered queries, derived from the given tables by Spark.

``EVENTS_SQL`` and its siblings state the same derivations for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.sources.tables import read_parquet, spread
from labelloom.sources.taxonomy import mapping_table, queue_table

SCHEMAS = {
    "events": "event_id bigint, event_type string, user_id bigint, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# ---------------------------------------------------------------- predictions

LABELS = ["click", "error", "purchase", "signup", "view"]
NEXT_LABEL = {"click": "error", "error": "purchase", "purchase": "signup", "signup": "view", "view": "click"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{folder}/{name}.parquet", SCHEMAS[name])


def _wrong(label: Column) -> Column:
    choice = F.lit(None).cast("string")
    for truth, other in NEXT_LABEL.items():
        choice = F.when(label == truth, other).otherwise(choice)
    return choice


def truth(spark: SparkSession, folder: str) -> DataFrame:
    """(id, v2_label) of all events."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("v2_label")
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Responses of a made-up model to all events; some answers name no class."""
    prediction = F.when(F.col("id") % 97 == 0, "INVALID").otherwise(F.col("prediction"))
    return chosen(spark, folder).withColumn("prediction", prediction)


def chosen(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction, confidence, probabilities and usage for every event, each with a class."""
    k = F.get_json_object("props", "$.k").cast("int")
    right = ((F.col("id") * 37 + 11) % 100) * 10 < 400 + 6 * F.col("k")
    best = (F.lit(0.3) + F.lit(0.6) * F.col("k") / 100) * F.col("scale")
    rest = (1 - (F.lit(0.3) + F.lit(0.6) * F.col("k") / 100)) / 4 * F.col("scale")
    dropped = (F.col("id") % 50 == 0) & (F.col("prediction") != F.col("truth"))
    entries = F.array(
        *[
            F.struct(
                F.lit(label).alias("key"),
                F.when(F.col("prediction") == label, best).otherwise(rest).alias("value"),
                (dropped & (F.col("truth") == label)).alias("dropped"),
            )
            for label in LABELS
        ]
    )
    kept = F.transform(
        F.filter(entries, lambda e: ~e["dropped"]),
        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")),
    )
    return (
        spread(table(spark, folder, "events"), "event_id")
        .select(F.col("event_id").alias("id"), F.col("event_type").alias("truth"), k.alias("k"), "value")
        .withColumn(
            "prediction",
            F.when(right, F.col("truth")).otherwise(_wrong(F.col("truth"))),
        )
        .withColumn("scale", F.when(F.col("id") % 10 == 0, 0.99).otherwise(1.0))
        .select(
            "id",
            "prediction",
            (F.col("k") / 100).alias("confidence"),
            F.to_json(F.map_from_entries(kept)).alias("probabilities"),
            F.col("value").alias("latency_ms"),
            F.concat(F.lit("m"), F.col("id") % 2).alias("response_model"),
            (200 + F.col("k")).cast("bigint").alias("input_tokens"),
            F.lit(1).cast("bigint").alias("output_tokens"),
        )
    )


def answered(spark: SparkSession, folder: str) -> DataFrame:
    """Scored rows that name a class: predictions with gaps."""
    return scored(spark, folder).where(F.col("prediction") != "INVALID")


def run_of(df: DataFrame) -> DataFrame:
    """Spread ids over the runs of a grid of 2 models, 2 budgets and 5 draws."""
    return df.withColumns(
        {
            "model": F.concat(F.lit("m"), F.col("id") % 2),
            "budget": F.when(F.floor(F.col("id") / 2) % 2 == 0, 20).otherwise(100),
            "draw": (1 + F.floor(F.col("id") / 4) % 5).cast("int"),
        }
    )


RUN_SQL = """
  'm' || (id % 2) AS model,
  CASE WHEN (id // 2) % 2 = 0 THEN 20 ELSE 100 END AS budget,
  CAST(1 + (id // 4) % 5 AS INTEGER) AS draw"""

EVENTS_SQL = """
base AS (
  SELECT event_id AS id, event_type AS truth, value AS latency_ms, user_id,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
chosen AS (
  SELECT *, CASE WHEN ((id * 37 + 11) % 100) * 10 < 400 + 6 * k THEN truth
                 WHEN truth = 'click' THEN 'error' WHEN truth = 'error' THEN 'purchase'
                 WHEN truth = 'purchase' THEN 'signup' WHEN truth = 'signup' THEN 'view'
                 ELSE 'click' END AS prediction,
         CAST(k AS DOUBLE) / 100 AS confidence,
         CASE WHEN id % 10 = 0 THEN CAST(0.99 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS scale,
         CAST(0.3 AS DOUBLE) + CAST(0.6 AS DOUBLE) * k / 100 AS best
  FROM base),
scored AS (
  SELECT * REPLACE (CASE WHEN id % 97 = 0 THEN 'INVALID' ELSE prediction END AS prediction) FROM chosen)"""

def _raw_sql(label: str) -> str:
    return f"""CASE WHEN prediction = '{label}' THEN best * scale
              WHEN truth = '{label}' AND prediction <> truth AND id % 50 = 0 THEN 0
              ELSE (1 - best) / 4 * scale END"""


# The sum runs in label order, so that values on a bin edge fall alike.
CASES_SQL = (
    EVENTS_SQL
    + f""",
parts AS (
  SELECT *, CAST(prediction = truth AS INTEGER) AS correct, best * scale AS raw_selected,
         CASE WHEN prediction = truth THEN best * scale WHEN id % 50 = 0 THEN 0
              ELSE (1 - best) / 4 * scale END AS raw_true,
         {" + ".join(_raw_sql(label) for label in LABELS)} AS raw_total,
         CASE WHEN prediction <> truth AND id % 50 = 0 THEN 3 ELSE 4 END AS others
  FROM chosen),
cases AS (
  SELECT *, raw_selected / raw_total AS selected, raw_true / raw_total AS p_true,
         pow(raw_selected / raw_total, 2) + others * pow((1 - best) / 4 * scale / raw_total, 2) AS squares
  FROM parts)"""
)

# ------------------------------------------------------------ taxonomy, orders

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]
V1_OF = {"1": "FAST", "2": "FAST", "3": "STANDARD", "4": "SLOW", "5": "SLOW"}


def _assignment(priority: str, status: str) -> dict[str, str]:
    v1 = V1_OF[priority[0]]
    if v1 != "FAST":
        return {"v1": v1, "v2": v1, "change": "unchanged"}
    if status == "P":
        return {"v1": v1, "v2": "REVIEW", "change": "move"}
    return {"v1": v1, "v2": "EXPEDITE" if priority[0] == "1" else "PRIORITY", "change": "split"}


ORDER_TAXONOMY = {
    "version": "1.0",
    "dataset": "orders",
    "v1": {q: {"description": f"Orders handled as {q.lower()}."} for q in ("FAST", "STANDARD", "SLOW")},
    "v2": {
        q: {"description": f"Orders handled as {q.lower()}."}
        for q in ("EXPEDITE", "PRIORITY", "REVIEW", "STANDARD", "SLOW")
    },
    "mapping": {f"{p}/{s}": _assignment(p, s) for p in PRIORITIES for s in STATUSES},
}
AFFECTED = 3
# The frozen sample takes this share of every class, and of a small class this many rows.
SAMPLE_SHARE = 0.02
SAMPLE_FLOOR = 25
BUDGETS = [20, 100]
DRAWS = 5


def order_mapping(spark: SparkSession) -> DataFrame:
    return mapping_table(spark, ORDER_TAXONOMY)


def order_queues(spark: SparkSession) -> DataFrame:
    return queue_table(spark, ORDER_TAXONOMY)


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text, intent, split): orders as texts with a fine-grained intent."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat_ws(" ", F.lit("order of"), F.col("o_custkey"), F.col("o_orderpriority")).alias("text"),
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("intent"),
        F.when(F.col("o_custkey") % 4 == 0, "test").otherwise("train").alias("split"),
    )


ORDERS_SQL = """
corpus AS (
  SELECT o_orderkey AS id, 'order of ' || o_custkey || ' ' || o_orderpriority AS text,
         o_orderpriority || '/' || o_orderstatus AS intent,
         CASE WHEN o_custkey % 4 = 0 THEN 'test' ELSE 'train' END AS split,
         CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'FAST' WHEN o_orderpriority[1] = '3' THEN 'STANDARD'
              ELSE 'SLOW' END AS v1_label,
         CASE WHEN o_orderpriority[1] IN ('1', '2') AND o_orderstatus = 'P' THEN 'REVIEW'
              WHEN o_orderpriority[1] = '1' THEN 'EXPEDITE' WHEN o_orderpriority[1] = '2' THEN 'PRIORITY'
              WHEN o_orderpriority[1] = '3' THEN 'STANDARD' ELSE 'SLOW' END AS v2_label
  FROM orders)"""

# ----------------------------------------------------------------- documents

DOCUMENT_CLASSES = [
    ("EN", "the and of to in is with by that it"),
    ("DE", "der die das und ist ein mit von nicht den"),
    ("ES", "el los las una en con por que del se"),
    ("FR", "le les une des du dans est et au pour"),
]
DOCUMENT_TAXONOMY = {
    "mapping": {
        f"{lang}_{size}": {"v1": v1, "v2": lang.upper(), "change": change}
        for lang, v1, change in (
            ("en", "EN", "unchanged"),
            ("de", "DE", "unchanged"),
            ("es", "ROMANCE", "split"),
            ("fr", "ROMANCE", "split"),
        )
        for size in ("s", "l")
    }
}


def document_mapping(spark: SparkSession) -> DataFrame:
    return mapping_table(spark, DOCUMENT_TAXONOMY)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text, intent, split); the split follows the md5 of the text, so copies share a side; one in five is test."""
    size = F.when(F.col("n_chars") < 500, "s").otherwise("l")
    bucket = F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 4), 16, 10).cast("int")
    return spread(table(spark, folder, "documents"), "doc_id").select(
        F.col("doc_id").alias("id"),
        "text",
        F.concat_ws("_", "lang", size).alias("intent"),
        F.when(bucket % 5 == 0, "test").otherwise("train").alias("split"),
    )


DOCUMENTS_SQL = """
corpus AS (
  SELECT doc_id AS id, text, lang || '_' || CASE WHEN n_chars < 500 THEN 's' ELSE 'l' END AS intent,
         upper(lang) AS v2_label,
         CASE WHEN CAST('0x' || substr(md5(coalesce(text, '')), 1, 4) AS INTEGER) % 5 = 0
              THEN 'test' ELSE 'train' END AS split
  FROM documents)"""

# Words and bigrams with their counts, over a table corpus(id, text).
TERMS_SQL = """
tokens AS (
  SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM corpus),
unfolded AS (
  SELECT id, unnest(w) AS term FROM tokens
  UNION ALL
  SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term
  FROM tokens WHERE len(w) > 1),
postings AS (SELECT id, term, count(*) AS tf FROM unfolded GROUP BY id, term)"""

VOCABULARY_SQL = (
    TERMS_SQL
    + """,
vocab AS (
  SELECT term, df, ln(CAST(1 + (SELECT count(*) FROM corpus) AS DOUBLE) / (1 + df)) + 1 AS idf
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term) WHERE df >= 2)"""
)
