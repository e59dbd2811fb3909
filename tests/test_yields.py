from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from yieldloom import schemas
from yieldloom.functions import guards
from yieldloom.operators import lookups, specs, yields
from yieldloom.operators.ranking import position_in_group, running_total, sequence_numbers
from yieldloom.sources.scratch import checkpoint


def day(text: str) -> dt.datetime:
    return dt.datetime.strptime(text, "%Y%m%d")


def steps(spark, rows):
    """(lot, seq, step, eqp, in, reject, out, yield, day)"""
    return spark.createDataFrame([(*r[:8], day(r[8])) for r in rows], schemas.STEPS)


@pytest.fixture(scope="module")
def small(spark):
    return steps(
        spark,
        [
            (1, 1, "saw", "A", 1000, 0, 1000, 100.0, "20260101"),
            (1, 2, "mold", "B", 1000, 100, 900, 90.0, "20260120"),
            (1, 3, "test", "A", 900, 100, 800, 88.89, "20260115"),
            (2, 1, "saw", "A", 0, None, 0, None, "20260105"),
            (3, 1, "saw", "B", 500, 50, 450, 90.0, "20260210"),
            (3, 2, "mold", "B", 450, 45, 405, 90.0, "20260211"),
        ],
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_final_yield_uses_first_input_and_last_output(small):
    got = {r.lot_id: (r.step_count, r.final_yield) for r in yields.lot_final_yield(small).collect()}
    assert got == {1: (3, 80.0), 2: (1, None), 3: (2, 81.0)}


def test_worst_step_ignores_null_and_prefers_the_first(small):
    got = {r.lot_id: r.step_name for r in yields.lot_worst_step(small).collect()}
    assert got == {1: "test", 3: "saw"}


def test_progression_follows_the_sequence(small):
    got = [(r.position, r.step_name) for r in yields.lot_progression(small).filter("lot_id = 1").orderBy("position").collect()]
    assert got == [(1, "saw"), (2, "mold"), (3, "test")]


def test_lot_counts_by_latest_completion_and_shows_the_last_step(small):
    january = guards.parse_period("2026-01-16", "2026/01/31")
    got = yields.low_yield_lots(small, january).collect()
    # Lot 1 was last completed on the 20th although its last step was done on the 15th.
    assert [(r.lot_id, r.done_day, r.lots_in_period) for r in got] == [(1, "2026-01-15", 1)]


def test_only_lots_with_a_step_in_the_period_are_aggregated(spark, small, tmp_path):
    small.write.parquet(str(tmp_path / "steps"))
    stored = spark.read.parquet(str(tmp_path / "steps"))
    for start, end in (("20260101", "20260105"), ("20260116", "20260131"), ("20260101", "20260301"), ("20270101", "20270102")):
        period = guards.parse_period(start, end)
        few, many = (yields.lots_in_period(stored, period, max_lots=n) for n in (100, 0))
        assert rows(few) == rows(many)
    january = guards.parse_period("20260116", "20260131")
    # Lot 3 has no step then and lot 2 neither.
    assert {r.lot_id for r in yields.steps_of_lots_in(stored, january).collect()} == {1}
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    found = stored.filter(january.covers(F.col("track_out_time")))._jdf.queryExecution().explainString(mode)
    assert "GreaterThanOrEqual(track_out_time" in found and "LessThan(track_out_time" in found
    plan = yields.lots_in_period(stored, january)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_zero_input_lot_is_not_counted(small):
    whole = guards.parse_period("20260101", "20260301")
    assert [r.lot_id for r in yields.low_yield_lots(small, whole).collect()] == [1, 3]


def test_target_ranking_excludes_or_leads_with_null_yields(small):
    whole = guards.parse_period("20260101", "20260301")
    got = yields.low_yield_by_target(small, whole, step_name="saw")
    assert [(r.lot_id, r["rank"]) for r in got.orderBy("rank").collect()] == [(3, 1), (1, 2)]
    first = yields.low_yield_by_target(small, whole, step_name="saw", nulls="first")
    assert [r.lot_id for r in first.orderBy("rank").collect()] == [2, 3, 1]


def test_unknown_names_are_refused(small):
    whole = guards.parse_period("20260101", "20260301")
    with pytest.raises(ValueError, match="mold"):
        yields.low_yield_by_target(small, whole, step_name="nope")
    with pytest.raises(ValueError, match="group by"):
        yields.yield_by_group(small, "lot_id; drop", whole)


def test_group_yield_is_weighted(small):
    whole = guards.parse_period("20260101", "20260301")
    got = {r.group_key: (r.yield_pct, r.lot_count, r.total_groups) for r in yields.yield_by_group(small, "step", whole).collect()}
    assert got["mold"] == (90.0, 2, 3)
    assert got["saw"] == (96.67, 3, 3)


def test_months_are_in_time_order_and_cut_late(small):
    whole = guards.parse_period("20260101", "20260301")
    got = yields.yield_by_group(small, "month", whole, limit=1).collect()
    assert [(r.group_key, r.total_groups) for r in got] == [("2026-01", 2)]


def test_period_comparison_lists_and_counts(spark):
    data = steps(
        spark,
        [
            (1, 1, "s", "down", 100, 0, 90, 90.0, "20260101"),
            (2, 1, "s", "down", 100, 0, 80, 80.0, "20260201"),
            (1, 1, "s", "flat", 100, 0, 90, 90.0, "20260101"),
            (2, 1, "s", "flat", 200, 0, 180, 90.0, "20260201"),
            (1, 1, "s", "up", 100, 0, 90, 90.0, "20260101"),
            (2, 1, "s", "up", 100, 0, 95, 95.0, "20260201"),
            (1, 1, "s", "one", 100, 0, 95, 95.0, "20260101"),
            (2, 1, "s", "two", 100, 0, 95, 95.0, "20260201"),
            (1, 1, "s", "none", 0, 0, 0, None, "20260101"),
        ],
    )
    first, second = guards.parse_period("20260101", "20260131"), guards.parse_period("20260201", "20260228")
    compared = yields.yield_period_compare(data, "equipment", first, second).orderBy("rank").collect()
    assert [(r.group_key, r.delta) for r in compared] == [("down", -10.0), ("flat", 0.0), ("up", 5.0)]
    counts = yields.yield_trend_counts(data, "equipment", first, second).first()
    assert tuple(counts) == (3, 1, 1, 1)
    assert rows(yields.period_only_groups(data, "equipment", first, second)) == [("one", "period1"), ("two", "period2")]
    with pytest.raises(ValueError):
        yields.yield_trend_counts(data, "month", first, second)


@pytest.mark.parametrize("text", ["2026-06-01", "2026/06/01", "20260601"])
def test_day_formats(text):
    assert guards.parse_day(text, "start") == dt.date(2026, 6, 1)


@pytest.mark.parametrize("text", ["202661", "", "2026-13-01", "x"])
def test_bad_days(text):
    with pytest.raises(ValueError):
        guards.parse_day(text, "start")


def test_period_order_and_overlap(small):
    with pytest.raises(ValueError, match="after"):
        guards.parse_period("20260201", "20260101")
    with pytest.raises(ValueError, match="no data"):
        guards.check_overlap(small, guards.parse_period("20200101", "20200102"))
    guards.check_overlap(small, guards.parse_period("20200101", "20260102"))


@pytest.mark.parametrize("limit", [0, -1, "x", "7", 2.5, True])
def test_bad_limits_are_errors(limit):
    with pytest.raises(ValueError, match="limit"):
        guards.check_limit(limit)


def test_limits_are_kept_as_given(spark):
    many = steps(spark, [(1, i, f"s{i:04d}", f"E{i:04d}", 100, i % 50, 100 - i % 50, 100.0 - i % 50, "20260101") for i in range(1200)])
    january = guards.parse_period("20260101", "20260131")
    for limit, want in ((None, 1200), (1000, 1000), (7, 7)):
        got = yields.yield_by_group(many, "step", january, limit=limit).orderBy("rank").collect()
        assert [r["rank"] for r in got] == list(range(1, want + 1))
        assert {r.total_groups for r in got} == {1200}
        assert [r.yield_pct for r in got] == sorted(r.yield_pct for r in got)
    assert yields.low_yield_by_target(many, january, step_name="s0007").count() == 1


def test_unknown_names_are_answered_with_all_names(spark):
    many = steps(spark, [(1, i, f"s{i:04d}", "E", 1, 0, 1, 100.0, "20260101") for i in range(300)])
    with pytest.raises(ValueError, match="s0299"):
        yields.known_values_guard(many, "step", "nothing")


def test_steps_without_a_time_or_number_stay_in_the_route(spark):
    frame = spark.createDataFrame(
        [(1, 2, "b", "E", 1, 0, 1, 1.0, day("20260102")), (1, 2, "a", "E", 1, 0, 1, 1.0, None), (1, None, "z", "E", 1, 0, 1, 1.0, None), (1, 3000, "c", "E", 1, 0, 1, 1.0, None)],
        schemas.STEPS,
    )
    got = [(r.position, r.step_name) for r in yields.lot_progression(frame).orderBy("position").collect()]
    assert got == [(1, "z"), (2, "a"), (3, "b"), (4, "c")]


def test_null_keys_and_buckets_are_cells_of_their_own(spark):
    data = spark.createDataFrame([(None, None, 1, 1), (None, 1, 2, 1), ("a", None, 3, 1), ("a", 2, 4, 1)], "k string, b int, i int, v long")
    placed = position_in_group(data, ["k"], ["b"], ["i"], "place")
    assert rows(placed.select("i", "place")) == [(1, 1), (2, 2), (3, 1), (4, 2)]
    total = running_total(data, ["k"], ["b"], ["i"], "v", "sum")
    assert rows(total.select("i", "sum")) == [(1, 1), (2, 2), (3, 1), (4, 2)]


def test_spec_check_branches(spark):
    when = dt.datetime(2026, 1, 1)
    values = ["5", "0.9", "10.1", "1", "10", "nan", "", "1.5d", "1_0", "text", " 7 ", "1e1"]
    readings = spark.createDataFrame(
        [(1, "A", "T", v, when) for v in values] + [(1, "A", "OTHER", "99", when), (1, "A", "BAD", "1", when)],
        schemas.READINGS,
    )
    mapping = spark.createDataFrame([(1, "RECIPE", "R", when)], "lot_id long, item_name string, check_value string, ts timestamp_ntz")
    limits = spark.createDataFrame(
        [("R", "T", "1", "10", "T"), ("R", "BAD", "low", "2", "T"), ("R", "T", "0", "1", "F")], schemas.SPECS
    )
    states = {r.value: r.state for r in specs.checked_readings(readings, mapping, limits).collect()}
    assert states == {
        "5": "in_spec", "0.9": "below_min", "10.1": "above_max", "1": "in_spec", "10": "in_spec",
        "nan": "in_spec", " 7 ": "in_spec", "1e1": "in_spec",
    }
    summary = specs.spec_check_summary(readings, mapping, limits).first()
    assert (summary.checked, summary.violations, summary.in_spec_items) == (8, 2, "T x6")
    twice = limits.unionByName(spark.createDataFrame([("R", "T", "3", "4", "T")], schemas.SPECS))
    with pytest.raises(ValueError, match="duplicate"):
        specs.check_spec_keys(twice)


def test_ingest_parses_text_and_prunes_months(spark, tmp_path):
    raw = spark.createDataFrame(
        [(1, "96.2%", "20260601 101530123"), (2, "n/a", "20260702 101530"), (3, None, "bad")],
        "lotid long, yield string, trackouttime string",
    )
    rows = lookups.ingest_steps(raw)
    got = {r.LOTID: (r.YIELD, r.YIELD_NUM, str(r.TRACK_OUT_DATE), r.TRACK_OUT_MONTH) for r in rows.collect()}
    assert got == {1: ("96.2%", 96.2, "2026-06-01", "202606"), 2: ("n/a", None, "2026-07-02", "202607"), 3: (None, None, "None", None)}
    lookups.write_ingested(rows, str(tmp_path / "steps"))
    july = spark.read.parquet(str(tmp_path / "steps")).filter("TRACK_OUT_MONTH = 202607")
    assert [r.LOTID for r in july.collect()] == [2]
    assert "PartitionFilters: [isnotnull(TRACK_OUT_MONTH" in july._jdf.queryExecution().executedPlan().toString()


def test_purge_keeps_other_lots(spark):
    tables = {"a": spark.range(5).withColumnRenamed("id", "lot_id"), "b": spark.range(3).withColumnRenamed("id", "lot_id")}
    registry = spark.createDataFrame([(1,), (1,), (4,)], "lot_id long")
    kept = {n: sorted(r.lot_id for r in t.collect()) for n, t in lookups.purge_by_registry(tables, registry).items()}
    assert kept == {"a": [0, 2, 3], "b": [0, 2]}


def test_a_hot_lot_gives_the_same_answers(spark):
    """One lot holds a third of all rows."""
    rows = spark.range(6000).select(
        F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).cast("long").alias("lot_id"),
        (F.col("id") % 50).cast("int").alias("step_seq"),
        F.concat(F.lit("s"), F.col("id") % 50).alias("step_name"),
        F.lit("E").alias("eqp_id"),
        (F.col("id") + 1000).alias("in_qty"),
        F.lit(10).cast("long").alias("reject"),
        (F.col("id") + 990).alias("out_qty"),
        (F.lit(99.0) - F.col("id") % 13).alias("yield_num"),
        F.make_timestamp_ntz(F.lit(2026), F.lit(1), 1 + F.col("id") % 28, F.lit(0), F.lit(0), F.lit(0)).alias("track_out_time"),
    )
    local = sorted((r for r in rows.collect() if r.lot_id == 0), key=lambda r: tuple(r[c] for c in yields.STEP_ORDER))
    final = yields.lot_final_yield(rows).filter("lot_id = 0").first()
    assert (final.step_count, final.first_in_qty, final.last_out_qty) == (2000, local[0].in_qty, local[-1].out_qty)
    route = yields.lot_progression(rows).filter("lot_id = 0").orderBy("position").collect()
    assert [r.step_name for r in route] == [r.step_name for r in local]
    assert [r.position for r in route] == list(range(1, 2001))


def test_a_large_lot_is_sorted_in_many_tasks(spark):
    # A third of all rows in one lot and as many without a lot; one step number has most of them.
    lot = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 40 + 100)
    data = spark.range(6000).select(
        lot.cast("long").alias("lot_id"),
        F.when(F.col("id") % 10 > 0, 3).otherwise(F.col("id") % 5).cast("int").alias("step_seq"),
        F.concat(F.lit("s"), F.col("id")).alias("step_name"),
        F.lit("E").alias("eqp_id"),
        (F.col("id") * 7919 % 6000).alias("in_qty"),
        F.lit(1).cast("long").alias("reject"),
        F.when(F.col("id") % 11 > 0, F.make_timestamp_ntz(F.lit(2026), F.lit(1), 1 + F.col("id") % 28, F.lit(0), F.lit(0), F.lit(0))).alias("track_out_time"),
    )
    data = checkpoint(data.repartition(6))
    plain = rows(yields.lot_progression(data.fillna({"lot_id": -1})))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    held = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        split = yields.lot_progression(data, large_lot=500).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(key, held)
    assert sorted((-1 if r.lot_id is None else r.lot_id, r.position, r.step_name) for r in split) == plain
    for large in (7, None):
        assert len({r.task for r in split if r.lot_id == large}) >= 2


def test_positions_do_not_depend_on_partitioning(spark):
    data = spark.range(3000).select(
        F.when(F.col("id") < 1000, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"),
        (F.col("id") % 11).alias("b"),
        "id",
    )
    for parts in (1, 8):
        got = position_in_group(data.repartition(parts), ["k"], ["b"], ["id"], "n").collect()
        want = {}
        for r in sorted(data.collect(), key=lambda r: (r.k, r.b, r.id)):
            want[r.id] = want.setdefault(("c", r.k), 0) + 1
            want[("c", r.k)] += 1
        assert all(r.n == want[r.id] for r in got) and len(got) == 3000


def test_sequence_numbers_have_no_gaps(spark):
    data = spark.range(5000).select((F.lit(5000) - F.col("id")).alias("v")).repartition(6)
    got = sequence_numbers(data, ["v"], "n", start=10).orderBy("v").collect()
    assert [r.n for r in got] == list(range(10, 5010))


def test_running_total_carries_over_buckets(spark):
    data = spark.createDataFrame([("a", i // 3, i, 1) for i in range(10)], "k string, b int, i int, v long")
    got = running_total(data, ["k"], ["b"], ["i"], "v", "t").orderBy("i").collect()
    assert [r.t for r in got] == list(range(1, 11))


def test_group_yield_plan_prunes_and_pushes(spark):
    from yieldloom.sources import tables

    data = tables.lot_steps(spark, "/root/testdata/sf0.001")
    frame = yields.yield_totals(data, "equipment", guards.parse_period("19960101", "19961231"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "GreaterThanOrEqual(l_shipdate" in plan
    assert "partial_sum" in plan
    assert "l_extendedprice" not in plan and "l_tax" not in plan
