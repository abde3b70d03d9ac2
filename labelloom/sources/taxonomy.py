"""Taxonomy configuration as tables.

The configuration is a dictionary, as parsed from a file with
``version, dataset, v1: {queue: {description}}, v2: {...}, mapping: {intent: {v1, v2, change}}``;
class definitions come as ``classes: {label: {description}}``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelloom.sizing import broadcast_if_small, dimension

QUEUES = "stage string, queue string, description string"
MAPPING = "intent string, v1 string, v2 string, change string"


def queue_table(spark: SparkSession, config: dict) -> DataFrame:
    """(stage, queue, description) of both versions."""
    rows = [
        (stage, queue, (details or {}).get("description"))
        for stage in ("v1", "v2")
        for queue, details in (config.get(stage) or {}).items()
    ]
    return dimension(spark, rows, QUEUES)


def mapping_table(spark: SparkSession, config: dict) -> DataFrame:
    """(intent, v1, v2, change)."""
    rows = [
        (intent, *((target or {}).get(k) for k in ("v1", "v2", "change")))
        for intent, target in (config.get("mapping") or {}).items()
    ]
    return dimension(spark, rows, MAPPING)


def mapping_from_table(df: DataFrame) -> DataFrame:
    """A mapping kept as a table; broadcast only if a bounded count allows it."""
    return broadcast_if_small(df.select("intent", "v1", "v2", "change"))


def class_definitions(config: dict, expected: int | None = None) -> list[tuple[str, str]]:
    """``(label, description)`` in definition order, descriptions trimmed."""
    classes = [(label, item["description"].strip()) for label, item in config["classes"].items()]
    if expected is not None and len(classes) != expected:
        raise ValueError(f"expected {expected} classes, found {len(classes)}")
    return classes


def class_table(spark: SparkSession, classes: list[tuple[str, str]]) -> DataFrame:
    """(label, description)."""
    return dimension(spark, classes, "label string, description string")
