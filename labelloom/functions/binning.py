"""Fixed-edge and quantile bins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_edges(bins: int) -> list[float]:
    """Edges of equal bins on [0, 1]: the doubles ``i * (1 / bins)``, last edge 1."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def fixed_bin(value: Column, edges: Sequence[float]) -> Column:
    """1-based bin with ``edge[i] <= value < edge[i+1]``; the last bin is closed.

    Compares against the edges themselves: multiplying and flooring would put
    values that lie on an edge into the wrong bin.
    """
    above = [(value >= edge).cast("int") for edge in edges[1:-1]]
    return reduce(add, above, F.lit(1))


def quantile_bucket(value: Column, edges: Column, quantiles: int) -> Column:
    """1-based right-closed bucket among at most ``quantiles + 1`` distinct sorted edges."""
    above = [
        (F.coalesce(value > F.get(edges, F.lit(i)), F.lit(False)) & (F.size(edges) > i + 1)).cast("int")
        for i in range(1, quantiles)
    ]
    return reduce(add, above, F.lit(1))
