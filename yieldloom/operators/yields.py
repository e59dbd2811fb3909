"""Yield analytics over step rows.

Yield is always total output over total input. Step order inside a lot is the
sequence number; further columns only make equal sequence numbers reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yieldloom.functions.guards import Period, check_limit, choose
from yieldloom.functions.quantities import yield_pct
from yieldloom.operators.joins import MAX_BROADCAST_ROWS, joined_side
from yieldloom.operators.ranking import sequence_numbers
from yieldloom.sources.scratch import checkpoint

STEP_ORDER = ["step_seq", "track_out_time", "eqp_id", "in_qty", "reject", "step_name"]

#: Rows of one lot above which its route is sorted in many tasks.
LARGE_LOT = 1_000_000

GROUP_COLUMNS = {"step": "step_name", "equipment": "eqp_id", "month": "track_out_time"}


def step_order() -> Column:
    return F.struct(*STEP_ORDER)


def step_history(steps: DataFrame, lot_ids: list[int] | None = None) -> DataFrame:
    """Steps of the given lots (all by default) in route order."""
    rows = steps if lot_ids is None else steps.filter(F.col("lot_id").isin(lot_ids))
    return rows.orderBy("lot_id", *STEP_ORDER)


def lot_final_yield(steps: DataFrame) -> DataFrame:
    """Output of the last step over input of the first step, per lot."""
    ends = steps.groupBy("lot_id").agg(
        F.count(F.lit(1)).alias("step_count"),
        F.min_by(F.coalesce("in_qty", F.lit(0)), step_order()).alias("first_in_qty"),
        F.max_by(F.coalesce("out_qty", F.lit(0)), step_order()).alias("last_out_qty"),
    )
    return ends.withColumn(
        "final_yield", yield_pct(F.col("last_out_qty"), F.col("first_in_qty"))
    )


def lot_loss_steps(steps: DataFrame) -> DataFrame:
    """Steps that rejected something; a plain filter, in long form so no lot is collected."""
    return steps.filter(F.coalesce("reject", F.lit(0)) > 0).select(
        "lot_id", "step_seq", "step_name", "eqp_id", "reject", "yield_num", "track_out_time"
    )


def lot_worst_step(steps: DataFrame) -> DataFrame:
    """Lowest step yield per lot; null yields are ignored and the first step wins ties."""
    numbered = steps.filter(F.col("yield_num").isNotNull())
    worst = F.min_by(
        F.struct("step_seq", "step_name", "eqp_id", "yield_num", "reject"),
        F.struct("yield_num", *STEP_ORDER),
    )
    return numbered.groupBy("lot_id").agg(worst.alias("worst")).select("lot_id", "worst.*")


def lot_progression(steps: DataFrame, large_lot: int = LARGE_LOT) -> DataFrame:
    """Route of each lot as (position, step name) rows; a step without a time comes first of its number.

    A lot of at most ``large_lot`` rows is one sort. Larger ones are numbered by a range sort of
    their rows in route order, whose borders fall inside lots as well, so that a lot is many
    tasks whatever its sequence numbers are. Rows without a lot count as one lot.
    """
    rows = steps.select("lot_id", *STEP_ORDER)
    large = checkpoint(
        rows.groupBy(F.col("lot_id").alias("_lot"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > large_lot)
        .select("_lot")
    )
    n_large = large.count()

    def within_one_task(some: DataFrame) -> DataFrame:
        order = Window.partitionBy("lot_id").orderBy(*STEP_ORDER)
        return some.select("lot_id", F.row_number().over(order).cast("long").alias("position"), "step_name")

    if not n_large:
        return within_one_task(rows)
    side, same = joined_side(large, n_large), F.col("lot_id").eqNullSafe(F.col("_lot"))
    numbered = sequence_numbers(rows.join(side, same, "left_semi"), ["lot_id", *STEP_ORDER], "_n")
    firsts = numbered.groupBy(F.col("lot_id").alias("_lot")).agg(F.min("_n").alias("_first"))
    spread_out = numbered.join(joined_side(firsts, n_large), same).select(
        "lot_id", (F.col("_n") - F.col("_first") + 1).alias("position"), "step_name"
    )
    return within_one_task(rows.join(side, same, "left_anti")).unionByName(spread_out)


def lot_defect_type(steps: DataFrame, readings: DataFrame) -> DataFrame:
    """Defect label recorded at the equipment of the worst step; earliest label wins."""
    labels = (
        readings.filter(F.col("key") == "DEFECT_TYPE")
        .groupBy("lot_id", "eqp_id")
        .agg(F.min_by("value", F.struct("ts", "value")).alias("defect_type"))
    )
    worst = lot_worst_step(steps).select("lot_id", "eqp_id", "step_name")
    return worst.join(labels, ["lot_id", "eqp_id"], "left")


def stored_defect_type(steps: DataFrame, readings: DataFrame) -> DataFrame:
    """``lot_defect_type`` on tables stored by lot: nothing is shuffled.

    The join key is the lot alone, so that the buckets serve; the equipment is compared
    as a range, which Spark does not take for a second key.
    """
    labels = (
        readings.filter(F.col("key") == "DEFECT_TYPE")
        .groupBy("lot_id", "eqp_id")
        .agg(F.min_by("value", F.struct("ts", "value")).alias("defect_type"))
        .select("lot_id", F.col("eqp_id").alias("label_eqp"), "defect_type")
    )
    worst = lot_worst_step(steps).select("lot_id", "eqp_id", "step_name")
    same = F.col("eqp_id").between(F.col("label_eqp"), F.col("label_eqp"))
    joined = worst.alias("w").join(
        labels.hint("merge").alias("l"), (F.col("w.lot_id") == F.col("l.lot_id")) & same, "left"
    )
    return joined.select("w.lot_id", "eqp_id", "step_name", "defect_type")


def data_period(steps: DataFrame) -> DataFrame:
    return steps.agg(
        F.min("track_out_time").cast("date").cast("string").alias("first_day"),
        F.max("track_out_time").cast("date").cast("string").alias("last_day"),
    )


def known_values(steps: DataFrame) -> DataFrame:
    """Valid step and equipment names, from one scan."""
    names = F.explode(
        F.array(
            F.struct(F.lit("step").alias("kind"), F.col("step_name").alias("value")),
            F.struct(F.lit("equipment").alias("kind"), F.col("eqp_id").alias("value")),
        )
    )
    return steps.select(names.alias("name")).select("name.*").distinct()


def known_values_guard(steps: DataFrame, kind: str, value: str | None) -> None:
    """Raise with the list of valid names when a step or equipment does not exist."""
    if not value:
        return
    column = choose(kind, {"step": "step_name", "equipment": "eqp_id"}, "kind")
    field = GROUP_COLUMNS[column]
    if not steps.filter(F.col(field) == value).limit(1).count():
        # One name per step or equipment.
        names = [row[0] for row in steps.select(field).distinct().orderBy(field).collect()]
        raise ValueError(f"unknown {kind} {value!r}; known names are {names}")


def ranked(rows: DataFrame, order: list, limit: int | None) -> DataFrame:
    """Rows with their place in ``order``: the first ``limit``, or all of them."""
    if check_limit(limit) is None:
        return sequence_numbers(rows, order, "rank")
    top = rows.orderBy(*order).limit(limit)
    # At most ``limit`` rows are left here.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def low_yield_by_target(
    steps: DataFrame,
    period: Period,
    step_name: str | None = None,
    eqp_id: str | None = None,
    limit: int | None = None,
    nulls: str = "exclude",
) -> DataFrame:
    """Step rows of a step and/or equipment with the lowest yield in a period."""
    known_values_guard(steps, "step", step_name)
    known_values_guard(steps, "equipment", eqp_id)
    rows = steps.filter(period.covers(F.col("track_out_time")))
    if step_name:
        rows = rows.filter(F.col("step_name") == step_name)
    if eqp_id:
        rows = rows.filter(F.col("eqp_id") == eqp_id)
    if choose(nulls, ["exclude", "first"], "nulls") == "exclude":
        rows = rows.filter(F.col("yield_num").isNotNull())
    order = [F.col("yield_num").asc_nulls_first(), F.col("lot_id"), *map(F.col, STEP_ORDER)]
    return ranked(rows, order, limit)


def steps_of_lots_in(steps: DataFrame, period: Period, max_lots: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """All steps of the lots that have a step in the period, and of others only if these are many.

    The period reaches the scan that finds the lots; their list is broadcast, so that steps of
    other lots are dropped where they are read. Beyond ``max_lots`` lots nothing is dropped.
    """
    found = steps.filter(period.covers(F.col("track_out_time"))).select(F.col("lot_id").alias("_lot"))
    touched = checkpoint(found.distinct())
    if touched.limit(max_lots + 1).count() > max_lots:
        return steps
    same = F.col("lot_id").eqNullSafe(F.col("_lot"))
    return steps.join(F.broadcast(touched), same, "left_semi")


def lots_in_period(
    steps: DataFrame, period: Period, max_lots: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """One row per lot whose latest completion is in the period.

    Such a lot has a step in the period, so only lots that do are aggregated while they are few.
    """
    lots = steps_of_lots_in(steps, period, max_lots).groupBy("lot_id").agg(
        F.max("track_out_time").alias("last_time"),
        F.min_by(F.coalesce("in_qty", F.lit(0)), step_order()).alias("first_in_qty"),
        F.max_by(
            F.struct(F.coalesce("out_qty", F.lit(0)).alias("out_qty"), "track_out_time"),
            step_order(),
        ).alias("last_step"),
        F.min_by(
            F.struct("step_name", "eqp_id", "yield_num"),
            F.when(F.col("yield_num").isNotNull(), F.struct("yield_num", *STEP_ORDER)),
        ).alias("worst"),
    )
    return (
        lots.filter(period.covers(F.col("last_time")))
        .withColumn(
            "final_yield", yield_pct(F.col("last_step.out_qty"), F.col("first_in_qty"))
        )
        .filter(F.col("final_yield").isNotNull())
        .select(
            "lot_id",
            "final_yield",
            F.col("worst.step_name").alias("worst_step"),
            F.col("worst.eqp_id").alias("worst_eqp"),
            F.col("worst.yield_num").alias("worst_yield"),
            F.col("last_step.track_out_time").cast("date").cast("string").alias("done_day"),
        )
    )


def low_yield_lots(steps: DataFrame, period: Period, limit: int | None = None) -> DataFrame:
    """Lots with the lowest final yield; ``lots_in_period`` counts all before the limit.

    One row per lot is written out, so that the count does not read the steps again.
    """
    lots = checkpoint(lots_in_period(steps, period))
    order = [F.col("final_yield"), F.col("lot_id")]
    total = lots.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ranked(lots, order, limit).withColumn("lots_in_period", total)


def group_key(by: str) -> Column:
    column = F.col(GROUP_COLUMNS[choose(by, GROUP_COLUMNS, "group by")])
    return F.date_format(column, "yyyy-MM") if by == "month" else column


def yield_totals(steps: DataFrame, by: str, period: Period) -> DataFrame:
    """Totals per step, equipment or month; rows without a group name are left out."""
    return (
        steps.filter(period.covers(F.col("track_out_time")))
        .withColumn("group_key", group_key(by))
        .filter(F.col("group_key").isNotNull())
        .groupBy("group_key")
        .agg(
            F.countDistinct("lot_id").alias("lot_count"),
            F.sum("in_qty").alias("in_qty"),
            F.sum("reject").alias("reject"),
            F.sum("out_qty").alias("out_qty"),
        )
        .withColumn("yield_pct", yield_pct(F.col("out_qty"), F.col("in_qty")))
    )


def yield_by_group(
    steps: DataFrame, by: str, period: Period, limit: int | None = None
) -> DataFrame:
    """Weighted yield per group: weakest first, months in time order; cut after the count."""
    return ranked_groups(yield_totals(steps, by, period), by, limit)


def ranked_groups(totals: DataFrame, by: str, limit: int | None = None) -> DataFrame:
    """Groups with a yield in their order; one row per group is written out and counted."""
    groups = checkpoint(totals.filter(F.col("yield_pct").isNotNull()))
    order = ["group_key"] if by == "month" else ["yield_pct", "group_key"]
    total = groups.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ranked(groups, order, limit).withColumn("total_groups", total)


def period_pairs(steps: DataFrame, by: str, first: Period, second: Period) -> DataFrame:
    """Both periods side by side from one scan with conditional totals.

    The first grouping is by lot as well, so that distinct lots are counted
    without a row expansion and a large group is added up in many tasks. Rows without
    a lot count in the totals and are no lot.
    """
    if by == "month":
        raise ValueError("months cannot be compared between periods")
    time = F.col("track_out_time")
    per_lot, totals = [], []
    for label, period in (("p1", first), ("p2", second)):
        inside = period.covers(time)
        per_lot += [
            F.count_if(inside).alias(f"{label}_rows"),
            F.sum(F.when(inside, F.col("in_qty"))).alias(f"{label}_in"),
            F.sum(F.when(inside, F.col("out_qty"))).alias(f"{label}_out"),
        ]
        totals += [
            F.count_if((F.col(f"{label}_rows") > 0) & F.col("lot_id").isNotNull()).alias(f"{label}_lots"),
            F.sum(f"{label}_in").alias(f"{label}_in"),
            F.sum(f"{label}_out").alias(f"{label}_out"),
        ]
    return (
        steps.filter(first.covers(time) | second.covers(time))
        .withColumn("group_key", group_key(by))
        .filter(F.col("group_key").isNotNull())
        .groupBy("group_key", "lot_id")
        .agg(*per_lot)
        .groupBy("group_key")
        .agg(*totals)
        .withColumn("p1_yield", yield_pct(F.col("p1_out"), F.col("p1_in")))
        .withColumn("p2_yield", yield_pct(F.col("p2_out"), F.col("p2_in")))
    )


def period_deltas(steps: DataFrame, by: str, first: Period, second: Period) -> DataFrame:
    return deltas_of(period_pairs(steps, by, first, second))


def deltas_of(pairs: DataFrame) -> DataFrame:
    """Groups with a yield in both periods, and its change."""
    return pairs.filter(
        F.col("p1_yield").isNotNull() & F.col("p2_yield").isNotNull()
    ).withColumn("delta", F.round(F.col("p2_yield") - F.col("p1_yield"), 2) + F.lit(0.0))


def yield_period_compare(
    steps: DataFrame, by: str, first: Period, second: Period, limit: int | None = None
) -> DataFrame:
    """Change of weighted yield between two periods, most fallen first."""
    order = ["delta", "group_key"]
    rows = period_deltas(steps, by, first, second).select(
        "group_key", "p1_yield", "p1_lots", "p2_yield", "p2_lots", "delta"
    )
    return ranked(rows, order, limit)


def yield_trend_counts(steps: DataFrame, by: str, first: Period, second: Period) -> DataFrame:
    """How many groups fell, stayed or rose, over all groups."""
    delta = F.col("delta")
    return period_deltas(steps, by, first, second).agg(
        F.count(F.lit(1)).alias("compared"),
        F.count_if(delta < 0).alias("down"),
        F.count_if(delta == 0).alias("flat"),
        F.count_if(delta > 0).alias("up"),
    )


def period_only_groups(steps: DataFrame, by: str, first: Period, second: Period) -> DataFrame:
    """Groups with a yield in one period only; groups without any yield are in neither list."""
    return only_in_one(period_pairs(steps, by, first, second))


def only_in_one(pairs: DataFrame) -> DataFrame:
    only = F.when(
        F.col("p1_yield").isNotNull() & F.col("p2_yield").isNull(), "period1"
    ).when(F.col("p2_yield").isNotNull() & F.col("p1_yield").isNull(), "period2")
    return pairs.withColumn("only_in", only).filter(F.col("only_in").isNotNull()).select(
        "group_key", "only_in"
    )
