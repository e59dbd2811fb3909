"""Monthly totals from which the yield of any period is put together.

Per month and group a rollup row holds sums and the set of lots as the bits of a long. Sums add
up and bits are joined by "or", so distinct lots stay exact over any months. Whole months of
a period come from the rollup; only the days before and after them are read from the steps.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.functions.guards import Period
from yieldloom.functions.quantities import yield_pct
from yieldloom.operators.yields import GROUP_COLUMNS, deltas_of, only_in_one, ranked, ranked_groups

#: Groupings that are rolled up; a grouping by month follows from any of them.
ROLLED = ("step", "equipment")
SUMS = ["in_qty", "reject", "out_qty"]
#: A rollup row has the lots of 2^6 numbers in a row, one bit each.
LOT_BITS = 6


def month_rollup(steps: DataFrame) -> DataFrame:
    """(month, by, group_key, lot_block, lots, in_qty, reject, out_qty, first_day, last_day).

    ``lots`` has the lots of one block of 64 numbers as bits; rows without a lot or a group
    are in rows of their own with null there. All values have a fixed width, so the rollup
    never holds more than the steps do, however few lots a group has. Rows without a time
    belong to no period and are left out. A step moves once, before it is counted under
    its groups: with few lots of a group in a block there is little to add up before that.
    """
    time = F.col("track_out_time")
    keys = [
        F.struct(F.lit(by).alias("by"), F.col(GROUP_COLUMNS[by]).alias("group_key")) for by in ROLLED
    ]
    return (
        steps.filter(time.isNotNull())
        .select(
            F.date_format(time, "yyyyMM").alias("month"),
            F.shiftright("lot_id", LOT_BITS).alias("lot_block"),
            F.expr(f"shiftleft(1L, CAST(lot_id & {(1 << LOT_BITS) - 1} AS INT))").alias("lot"),
            time.cast("date").alias("day"),
            *SUMS,
            *[GROUP_COLUMNS[by] for by in ROLLED],
        )
        .repartition("month", "lot_block")
        .select("month", "lot_block", "lot", "day", *SUMS, F.explode(F.array(*keys)).alias("g"))
        .groupBy("month", "g.by", "g.group_key", "lot_block")
        .agg(
            F.coalesce(F.bit_or("lot"), F.lit(0).cast("long")).alias("lots"),
            *[F.sum(c).alias(c) for c in SUMS],
            F.min("day").alias("first_day"),
            F.max("day").alias("last_day"),
        )
    )


def write_rollup(steps: DataFrame, path: str) -> None:
    """Store the rollup by month. Months already there are replaced by those of ``steps``, others stay.

    A month of late rows is written anew from all its steps.
    """
    rows = month_rollup(steps).hint("rebalance", "month")
    rows.write.partitionBy("month").option("partitionOverwriteMode", "dynamic").mode(
        "overwrite"
    ).parquet(path)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The stored rollup; a filter on the month reads only its folders."""
    return spark.read.parquet(path)


def stored_period(rollup: DataFrame) -> tuple[dt.date | None, dt.date | None]:
    """First and last day of the data, from the rollup."""
    return rollup.agg(F.min("first_day"), F.max("last_day")).first()


def whole_months(period: Period) -> tuple[tuple[int, int], list[Period]]:
    """(first, last) whole month as YYYYMM numbers, and the periods before and after them."""
    one = dt.timedelta(days=1)
    start, end = period.start, period.end + one
    first = start if start.day == 1 else (start.replace(day=1) + 32 * one).replace(day=1)
    last = end.replace(day=1)
    if first >= last:
        return (1, 0), [period]
    rests = []
    if start < first:
        rests.append(Period(start, first - one))
    if last < end:
        rests.append(Period(last, period.end))
    newest = last - one
    return (first.year * 100 + first.month, newest.year * 100 + newest.month), rests


def parts_of(rollup: DataFrame, steps: DataFrame | None, by: str, period: Period) -> DataFrame:
    """Rollup rows that make up a period; ``steps`` are read only where it cuts a month."""
    (first, last), rests = whole_months(period)
    month = F.col("month").cast("int")
    rows = rollup.filter((month >= first) & (month <= last)).withColumn("month", month)
    if rests:
        if steps is None:
            raise ValueError(f"{period.start}..{period.end} cuts a month and needs the steps")
        time = F.col("track_out_time")
        cut = F.lit(False)
        for rest in rests:
            cut = cut | rest.covers(time)
        edges = month_rollup(steps.filter(cut)).withColumn("month", month)
        rows = rows.unionByName(edges)
    rolled = "step" if by == "month" else by
    return rows.filter(F.col("by") == rolled)


def totals(rollup: DataFrame, by: str, period: Period, steps: DataFrame | None = None) -> DataFrame:
    """Totals and distinct lots per step, equipment or month, as ``yield_totals`` gives them."""
    rows = parts_of(rollup, steps, by, period)
    if by == "month":
        label = F.format_string("%04d-%02d", F.floor(F.col("month") / 100), F.col("month") % 100)
        # Rows without a step name are in the month as well.
        rows = rows.withColumn("group_key", label)
    else:
        rows = rows.filter(F.col("group_key").isNotNull())
    # Moved before they are added up: a scan meets a group's block in one month only.
    blocks = rows.repartition("lot_block").groupBy("group_key", "lot_block").agg(
        F.bit_or("lots").alias("lots"), *[F.sum(c).alias(c) for c in SUMS]
    )
    return (
        blocks.groupBy("group_key")
        .agg(F.sum(F.bit_count("lots")).alias("lot_count"), *[F.sum(c).alias(c) for c in SUMS])
        .withColumn("yield_pct", yield_pct(F.col("out_qty"), F.col("in_qty")))
    )


def yield_by_group(
    rollup: DataFrame, by: str, period: Period, steps: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """``yields.yield_by_group`` from the rollup."""
    return ranked_groups(totals(rollup, by, period, steps), by, limit)


def _pairs(
    rollup: DataFrame, by: str, first: Period, second: Period, steps: DataFrame | None
) -> DataFrame:
    if by == "month":
        raise ValueError("months cannot be compared between periods")
    sides = []
    for label, period in (("p1", first), ("p2", second)):
        side = totals(rollup, by, period, steps)
        sides.append(
            side.select("group_key", F.col("lot_count").alias(f"{label}_lots"), F.col("yield_pct").alias(f"{label}_yield"))
        )
    return sides[0].join(sides[1], "group_key", "full")


def yield_period_compare(
    rollup: DataFrame,
    by: str,
    first: Period,
    second: Period,
    steps: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """``yields.yield_period_compare`` from the rollup."""
    rows = deltas_of(_pairs(rollup, by, first, second, steps)).select(
        "group_key", "p1_yield", "p1_lots", "p2_yield", "p2_lots", "delta"
    )
    return ranked(rows, ["delta", "group_key"], limit)


def period_only_groups(
    rollup: DataFrame, by: str, first: Period, second: Period, steps: DataFrame | None = None
) -> DataFrame:
    """``yields.period_only_groups`` from the rollup."""
    return only_in_one(_pairs(rollup, by, first, second, steps))
