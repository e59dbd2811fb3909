"""Tables stored by lot, and monthly totals."""

from __future__ import annotations

import datetime as dt
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_yields import rows, steps
from yieldloom import schemas
from yieldloom.functions import guards
from yieldloom.operators import manifest, rollup, yields
from yieldloom.sources import lot_store, manifest_store


def route(rng, lot, n):
    days = [f"2026{rng.randint(1, 6):02d}{rng.randint(1, 28):02d}" for _ in range(n)]
    return [
        (lot, i // 2, rng.choice(["saw", "mold", None]), rng.choice("ABC"), 100 + i, i % 7, 100 + i - i % 7,
         rng.choice([None, 90.0, 95.5, 99.0]), d)
        for i, d in enumerate(days)
    ]


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(4)
    records = [r for lot in range(60) for r in route(rng, lot, rng.randint(1, 9))]
    # One lot with a third of all rows, rows without a lot, and lots far apart.
    records += route(rng, 7, 150) + route(rng, None, 6) + route(rng, 1 << 40, 3) + route(rng, 70_000, 4)
    return steps(spark, records).repartition(5)


@pytest.fixture(scope="module")
def labels(spark, history):
    seen = history.select("lot_id", "eqp_id", "track_out_time").collect()
    records = [
        (r[0], r[1], "DEFECT_TYPE" if i % 3 else "QTY", f"v{i % 5}", r[2]) for i, r in enumerate(seen)
    ]
    return spark.createDataFrame(records, schemas.READINGS)


@pytest.fixture(scope="module")
def store(history, labels):
    return lot_store.write_store({"steps": history, "readings": labels}, buckets=4, large_lot=50)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_analyses_by_lot_need_no_exchange(spark, store):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for operator, names in (
            (yields.stored_defect_type, ["steps", "readings"]),
            (yields.lot_final_yield, ["steps"]),
            (yields.lot_worst_step, ["steps"]),
        ):
            plan = plan_of(operator(*[store.bucketed[n] for n in names]))
            assert "Exchange" not in plan and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_large_lots_and_rows_without_a_lot_lie_apart(store, history):
    assert {r[0] for r in store.large["steps"].select("lot_id").distinct().collect()} == {7, None}
    assert store.bucketed["steps"].filter("lot_id = 7 OR lot_id IS NULL").count() == 0
    every = store.bucketed["steps"].unionByName(store.large["steps"])
    assert every.exceptAll(history).count() == 0 and every.count() == history.count()
    files = list(Path(re.sub("^file:", "", store.path), "steps").glob("*.parquet"))
    assert len(files) <= 4


@pytest.mark.parametrize(
    ("stored", "plain", "names"),
    [
        (yields.stored_defect_type, yields.lot_defect_type, ["steps", "readings"]),
        (yields.lot_final_yield, yields.lot_final_yield, ["steps"]),
        (yields.lot_worst_step, yields.lot_worst_step, ["steps"]),
        (yields.lot_loss_steps, yields.lot_loss_steps, ["steps"]),
        (yields.lot_progression, yields.lot_progression, ["steps"]),
    ],
)
def test_store_gives_what_the_tables_give(store, history, labels, stored, plain, names):
    tables = {"steps": history, "readings": labels}
    got = store.per_lot(stored, *names)
    want = plain(*[tables[n] for n in names]).select(got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_store_is_opened_by_path(spark, store):
    again = lot_store.open_store(spark, store.path, store.buckets, ["steps", "readings"])
    got = again.per_lot(yields.stored_defect_type, "steps", "readings")
    want = store.per_lot(yields.stored_defect_type, "steps", "readings")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "Bucketed: true" in plan_of(again.bucketed["steps"].groupBy("lot_id").count())


@pytest.fixture(scope="module")
def months(spark, history, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("months") / "rollup")
    rollup.write_rollup(history, path)
    return rollup.read_rollup(spark, path)


PERIODS = [
    ("2026-01-01", "2026-06-30"), ("2026-02-01", "2026-02-28"), ("2026-01-15", "2026-05-02"),
    ("2026-03-03", "2026-03-09"), ("2026-01-31", "2026-03-01"), ("2025-06-01", "2027-01-01"),
]


@pytest.mark.parametrize("by", ["step", "equipment", "month"])
@pytest.mark.parametrize("bounds", PERIODS)
def test_totals_equal_those_of_the_steps(months, history, by, bounds):
    period = guards.parse_period(*bounds)
    got = rollup.totals(months, by, period, history)
    want = yields.yield_totals(history, by, period).select(got.columns)
    assert rows(got) == rows(want) and got.count()


def test_whole_months_read_only_their_folders(months):
    period = guards.parse_period("2026-02-01", "2026-03-31")
    plan = plan_of(rollup.totals(months, "step", period))
    assert "PartitionFilters: [" in plan and re.search(r"PartitionFilters: \[[^]]*month", plan)
    with pytest.raises(ValueError, match="cuts a month"):
        rollup.totals(months, "step", guards.parse_period("2026-02-02", "2026-03-31"))


def test_late_rows_replace_their_months_only(spark, history, tmp_path):
    path = tmp_path / "rollup"
    rollup.write_rollup(history, str(path))
    before = {f.name for f in path.glob("month=202602/*.parquet")}
    late = steps(spark, [(900, 1, "saw", "A", 10, 0, 10, 100.0, "20260310")])
    march = history.unionByName(late).filter(F.month("track_out_time") == 3)
    rollup.write_rollup(march, str(path))
    months, whole = rollup.read_rollup(spark, str(path)), guards.parse_period(*PERIODS[0])
    got = rollup.totals(months, "equipment", whole)
    want = yields.yield_totals(history.unionByName(late), "equipment", whole).select(got.columns)
    assert rows(got) == rows(want)
    assert {f.name for f in path.glob("month=202602/*.parquet")} == before


def test_bounds_come_from_the_rollup(months, history):
    low, high = rollup.stored_period(months)
    assert (str(low), str(high)) == tuple(yields.data_period(history).first())
    with pytest.raises(ValueError, match="no data"):
        guards.check_overlap(None, guards.parse_period("2020-01-01", "2020-02-01"), bounds=(low, high))


def test_comparisons_equal_those_of_the_steps(months, history):
    first, second = guards.parse_period(*PERIODS[1]), guards.parse_period("2026-04-05", "2026-05-31")
    got = rollup.yield_period_compare(months, "equipment", first, second, history)
    assert rows(got) == rows(yields.yield_period_compare(history, "equipment", first, second))
    got = rollup.period_only_groups(months, "step", first, second, history)
    assert rows(got) == rows(yields.period_only_groups(history, "step", first, second))


@pytest.mark.parametrize(
    ("bounds", "months", "rests"),
    [
        (("2026-01-01", "2026-01-31"), (202601, 202601), 0),
        (("2026-01-02", "2026-01-31"), None, 1),
        (("2025-12-31", "2026-02-01"), (202601, 202601), 2),
        (("2025-12-01", "2026-02-27"), (202512, 202601), 1),
        (("2026-02-10", "2026-03-05"), None, 1),
    ],
)
def test_months_inside_a_period(bounds, months, rests):
    found, cut = rollup.whole_months(guards.parse_period(*bounds))
    assert len(cut) == rests
    assert (found == months) if months else found[0] > found[1]
    days = sum((p.end - p.start).days + 1 for p in cut)
    assert days <= 62 and all(isinstance(p.start, dt.date) for p in cut)


def _files(path):
    return {p.parent.name: p.name for p in path.glob("part=*/*.parquet")}


def test_an_upsert_rewrites_only_the_buckets_of_its_urls(spark, tmp_path):
    kind = "source string, url string, content string, seq long, status string, note string"
    pages = [("s", f"http://x/{i}", f"c{i}", i, "downloaded", None) for i in range(300)] + [("s", None, "n", 1, "downloaded", None)]
    old = manifest.fetch_records(spark.createDataFrame(pages, kind))
    path = tmp_path / "store"
    store = manifest_store.new_store(old, str(path), buckets=32)
    before = _files(path)
    assert len(before) == 32 and sorted(store.read(spark).collect(), key=str) == sorted(old.select(store.schema.names).collect(), key=str)
    news = [("s", "http://x/7", "other", 900, "downloaded", "again"), ("s", "http://x/new", "new", 901, "downloaded", None), ("s", "http://x/7", "older", 899, "downloaded", None), ("s", None, None, 2, "downloaded", "gone")]
    new = manifest.fetch_records(spark.createDataFrame(news, kind))
    parts = manifest_store.ManifestStore(str(path), old.schema, 32).upsert(new)
    after = _files(path)
    assert 1 <= len(parts) <= 3 and set(after) == set(before)
    assert {p for p in before if before[p] != after[p]} == {f"part={n}" for n in parts}
    want = manifest.manifest_upsert(old, new).select(store.schema.names)
    assert sorted(store.read(spark).collect(), key=str) == sorted(want.collect(), key=str)
    kept = manifest.manifest_upsert(want, new, "keep").select(store.schema.names).collect()
    store.upsert(new, "keep")
    assert sorted(store.read(spark).collect(), key=str) == sorted(kept, key=str)
    assert store.upsert(new.limit(0)) == [] and store.read(spark).count() == 302
    plan = store.read(spark, parts)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan


def test_an_empty_store_takes_its_first_records(spark, tmp_path):
    kind = "source string, url string, content string, seq long, status string"
    old = manifest.fetch_records(spark.createDataFrame([], kind))
    store = manifest_store.new_store(old, str(tmp_path / "store"))
    assert store.read(spark).count() == 0
    new = manifest.fetch_records(spark.createDataFrame([("s", "u", "c", 1, "downloaded")], kind))
    store.upsert(new)
    assert store.read(spark).collect() == new.select(store.schema.names).collect()


def test_a_rollup_is_never_wider_than_its_steps(spark):
    # Every group of a month has one lot, and lots lie far apart.
    far = [(i * 100_000, 1, "saw", f"E{i}", 10, 1, 9, 90.0, "20260310") for i in range(50)]
    months = rollup.month_rollup(steps(spark, far + [(None, 1, "cut", "E0", 10, 0, 10, 100.0, "20260311")]))
    assert dict(months.dtypes)["lots"] == "bigint" and months.count() == 102
    got = {r.group_key: r.lot_count for r in rollup.totals(months, "step", guards.parse_period("2026-03-01", "2026-03-31")).collect()}
    assert got == {"saw": 50, "cut": 0}
