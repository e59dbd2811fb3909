"""Exact positions over data in which one group may hold a large share of all rows.

A plain ``row_number`` sorts every group in one task. The two functions here
spread a group over many tasks and stay exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yieldloom.operators.joins import joined_side
from yieldloom.sources.scratch import checkpoint


def _join_cells(rows: DataFrame, offsets: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Join on all cell columns, null equal to null, so that no row is lost."""
    renamed = offsets.withColumnsRenamed({c: f"_cell_{c}" for c in cells})
    same = F.lit(True)
    for c in cells:
        same = same & F.col(c).eqNullSafe(F.col(f"_cell_{c}"))
    return rows.join(renamed, same).drop(*[f"_cell_{c}" for c in cells])


def position_in_group(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Sequence[str],
    order: Sequence[str],
    name: str,
    total: str | None = None,
) -> DataFrame:
    """1-based position of each row in its group, ordered by ``bucket`` and then ``order``.

    ``bucket`` columns must come first in the wanted order and split a group
    finely (a day, a hash prefix). Rows are ranked inside (keys, bucket) and
    shifted by the size of the buckets before. The sizes are pre-aggregated, so
    the running sum sees one row per bucket. Null keys and buckets are values like any
    other; null buckets come first.
    ``total`` names a column for the size of the whole group.
    """
    cells = [*keys, *bucket]
    sizes = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    group_size = [F.sum("_size").over(Window.partitionBy(*keys)).alias(total)] if total else []
    offsets = sizes.select(
        *cells, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"), *group_size
    )
    inside = Window.partitionBy(*cells).orderBy(*order)
    return (
        df.withColumn("_inside", F.row_number().over(inside))
        .transform(lambda rows: _join_cells(rows, offsets, cells))
        .withColumn(name, (F.col("_inside") + F.col("_offset")).cast("long"))
        .drop("_inside", "_offset")
    )


def sequence_numbers(
    df: DataFrame, order: Sequence[str | Column], name: str, start: int = 1
) -> DataFrame:
    """Gapless numbers over the whole table in ``order``, without a one-task sort.

    The table is range-partitioned and sorted, and the layout is written out, so
    that a lost executor cannot come back with other partition bounds. What is
    summed up afterwards is one row per partition.
    """
    laid_out = checkpoint(
        df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id())
    )
    laid_out = laid_out.withColumn("_part", F.shiftright("_slot", 33)).withColumn(
        "_inside", F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    )
    # One row per partition of the layout.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        laid_out.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    parts = joined_side(offsets, laid_out.rdd.getNumPartitions())
    return (
        laid_out.join(parts, "_part")
        .withColumn(name, (F.col("_inside") + F.col("_offset") + start).cast("long"))
        .drop("_slot", "_part", "_inside", "_offset")
    )


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], limit: int, name: str
) -> DataFrame:
    """First ``limit`` rows of each group with their rank.

    Spark applies the limit before the shuffle as well (WindowGroupLimit), so a
    task receives at most ``limit`` rows per group and input partition.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= limit).withColumn(name, F.col(name).cast("long"))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
) -> DataFrame:
    """Running sum of ``value`` inside each group, up to and including the row.

    Like ``position_in_group``: sums inside (keys, bucket), plus the
    pre-aggregated totals of the buckets before.
    """
    cells = [*keys, *bucket]
    before = Window.partitionBy(*keys).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*cells)
        .agg(F.sum(value).alias("_total"))
        .select(*cells, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    )
    inside = (
        Window.partitionBy(*cells)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        df.withColumn("_inside", F.sum(value).over(inside))
        .transform(lambda rows: _join_cells(rows, offsets, cells))
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset")
    )
