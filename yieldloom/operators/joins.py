"""Joins with a small side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark a table for broadcast only when a count shows that it is small.

    Reference lists have few keys, so shuffling the large side on them would put
    a large share of it in one task. A list beyond the bound is joined by
    shuffle, where Spark splits skewed partitions.
    """
    return joined_side(df, df.limit(max_rows + 1).count(), max_rows)


def joined_side(df: DataFrame, rows: int, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The same when the row count is already known.

    The hint for the large case also keeps Spark from broadcasting the other
    side, whose size it underestimates after rows were expanded.
    """
    return F.broadcast(df) if rows <= max_rows else df.hint("merge")
