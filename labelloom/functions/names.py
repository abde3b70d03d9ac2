"""Row ids, run names and the fields hidden in result file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of row ids and run names, and the pattern that reads a
# run name back from a path (file name, or folder ``run=<name>`` of a partitioned sink).
ROW_ID_FORMAT = "%s_%05d"
RUN_NAME_FORMAT = "%s_b%d_d%02d"
RUN_PATH_PATTERN = r"(?:^|/)(?:run=)?([A-Za-z0-9_]+?)_b(\d+)_d(\d+)(?:\.json$|/[^/]*$)"


def row_id(split: Column, position: Column) -> Column:
    """``train_00012``: split name and 0-based position from a stable key column."""
    return F.format_string(ROW_ID_FORMAT, split, position)


def run_name(model: Column, budget: Column, draw: Column) -> Column:
    """``model_b20_d01``."""
    return F.format_string(RUN_NAME_FORMAT, model, budget, draw)


def run_fields(path: Column) -> dict[str, Column]:
    """Model, budget and draw named by a path; filter with ``is_run_path`` first."""
    return {
        "model": F.regexp_extract(path, RUN_PATH_PATTERN, 1),
        "budget": F.regexp_extract(path, RUN_PATH_PATTERN, 2).try_cast("int"),
        "draw": F.regexp_extract(path, RUN_PATH_PATTERN, 3).try_cast("int"),
    }


def is_run_path(path: Column) -> Column:
    return F.regexp_like(path, F.lit(RUN_PATH_PATTERN))
