"""Connected components of a graph given as links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.session import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the smallest of them; links run from small to large."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    own = least.select(F.col("m").alias("a"), "b")
    return moved.unionByName(own).where("a <> b").distinct()


def roots(links: DataFrame) -> DataFrame:
    """``node, root`` for every node that is not itself the least of its component.

    ``links`` has whole-number columns a and b. Each round is written to the shared folder; the
    rounds grow with the logarithm of the longest chain. Only counts and check sums reach the driver.
    """
    ordered = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    held = stored(ordered, "links")
    seen = None
    while True:
        held = stored(_small_star(_large_star(held)), "links")
        state = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return held.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = state
