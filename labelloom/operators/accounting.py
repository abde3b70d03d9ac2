"""Latency, token, cost and answer statistics of scoring runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import INVALID
from labelloom.operators.joins import same_groups
from labelloom.operators.ordering import exact_quantiles
from labelloom.sizing import class_array


def latency_summary(
    responses: DataFrame, by: Sequence[str] = (), column: str = "latency_ms", approximate: bool = False
) -> DataFrame:
    """Mean, median and 95th percentile of a recorded latency.

    Percentiles are exact with linear interpolation and read the column several
    times; ``approximate`` takes one pass and returns values that occur. A group that is null, or has
    no latency, keeps its row.
    """
    tail = [0.5, 0.95]
    if approximate:
        summary = responses.groupBy(*by).agg(
            F.avg(column).alias("mean"), F.percentile_approx(column, tail).alias("quantiles")
        )
    else:
        summary = responses.groupBy(*by).agg(F.avg(column).alias("mean"))
        quantiles = exact_quantiles(responses, column, tail, by)
        summary = same_groups(summary, quantiles, by, "left") if by else summary.withColumn("quantiles", quantiles.scalar())
    return summary.select(
        *by, "mean", F.get("quantiles", F.lit(0)).alias("p50"), F.get("quantiles", F.lit(1)).alias("p95")
    )


def token_costs(responses: DataFrame, usd_per_million: float, by: Sequence[str] = ()) -> DataFrame:
    """Tokens, cost of the input tokens, and cost per 1,000 requests."""
    cost = F.sum("input_tokens") / 1_000_000 * F.lit(usd_per_million)
    return responses.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        cost.alias("input_cost_usd"),
        (cost / F.count(F.lit(1)) * 1000).alias("cost_per_thousand_usd"),
    )


def response_models(responses: DataFrame, column: str = "response_model") -> DataFrame:
    """Distinct models that answered, in order."""
    return responses.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def run_record(
    responses: DataFrame, method: str, task: str, requested_model: str, usd_per_million: float, new_labels: int = 0
) -> DataFrame:
    """One nested record of a scoring run: models, size, latency, usage and pricing."""
    costs = token_costs(responses, usd_per_million)
    latency = latency_summary(responses).select(F.struct("mean", "p50", "p95").alias("l")).scalar()
    return costs.select(
        F.lit(method).alias("method"),
        F.lit(task).alias("task"),
        F.lit(requested_model).alias("requested_model"),
        class_array(responses, "response_model").alias("response_models"),
        F.lit(new_labels).cast("bigint").alias("new_labels"),
        F.col("requests").alias("test_examples"),
        latency.alias("latency_ms"),
        F.struct("input_tokens", "output_tokens").alias("usage"),
        F.struct(
            F.lit(usd_per_million).alias("input_usd_per_million"), F.col("input_cost_usd").alias("estimated_input_cost_usd")
        ).alias("pricing"),
    )


def invalid_answers(responses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Answers that named no single class."""
    return responses.groupBy(*by).agg(
        F.count_if(F.col("prediction") == INVALID).alias("invalid"), F.count(F.lit(1)).alias("answers")
    )
