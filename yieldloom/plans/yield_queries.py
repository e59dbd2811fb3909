"""Registered yield, spec and strip analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.functions.guards import Period, check_overlap, parse_period
from yieldloom.operators import evidence, lookups, rollup, specs, strips, yields
from yieldloom.sources import lot_store, tables
from yieldloom.sources.scratch import scratch_path

YEAR_RANGE = ("1996-01-01", "1998-12-31")
FIRST_HALF = ("1996-01-01", "1997-12-31")
SECOND_HALF = ("1998-01-01", "1999-12-31")
FIRST_DAYS = ("1996-03-01", "1996-03-04")
SECOND_DAYS = ("1996/09/01", "1996/09/04")
CUT_RANGE = ("1996-01-11", "1998-09-04")


def _periods(steps: DataFrame, *bounds: tuple[str, str]) -> tuple[Period, ...]:
    return check_overlap(steps, *(parse_period(*b) for b in bounds))


def _day(name: str) -> F.Column:
    return F.col(name).cast("date").cast("string")


def ingest_steps(spark: SparkSession, folder: str) -> DataFrame:
    rows = lookups.ingest_steps(tables.raw_steps(spark, folder))
    return rows.withColumn("TRACK_OUT_DATE", F.col("TRACK_OUT_DATE").cast("string"))


def lot_info(spark: SparkSession, folder: str) -> DataFrame:
    return lookups.lot_info(tables.lots(spark, folder))


def step_history(spark: SparkSession, folder: str) -> DataFrame:
    rows = yields.step_history(tables.lot_steps(spark, folder))
    return rows.withColumn("track_out_time", _day("track_out_time"))


def lot_recipe_specs(spark: SparkSession, folder: str) -> DataFrame:
    return specs.lot_recipe_specs(
        tables.recipe_mapping(spark, folder), specs.check_spec_keys(tables.recipe_specs(spark))
    )


def equipment_readings(spark: SparkSession, folder: str) -> DataFrame:
    rows = lookups.equipment_readings(tables.readings(spark, folder))
    return rows.withColumn("ts", _day("ts"))


def lot_strips(spark: SparkSession, folder: str) -> DataFrame:
    return lookups.lot_strips(tables.strips(spark, folder))


def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    return lookups.table_counts(tables.lots(spark, folder), tables.strips(spark, folder))


def purge_by_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Lots with urgent orders count as generated earlier; kept rows per table."""
    registry = tables.read_table(spark, folder, "orders").filter(
        F.col("o_orderpriority") == "1-URGENT"
    ).select(F.col("o_orderkey").alias("lot_id"))
    kept = lookups.purge_by_registry(
        {
            "lots": tables.lots(spark, folder),
            "steps": tables.lot_steps(spark, folder),
            "readings": tables.readings(spark, folder),
            "recipes": tables.recipe_mapping(spark, folder),
            "strips": tables.strips(spark, folder).withColumn(
                "lot_id", F.col("lot_id").cast("long")
            ),
        },
        registry,
    )
    counts = [
        rows.agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("kept_rows"),
            F.sum("lot_id").alias("lot_id_sum"),
        )
        for name, rows in kept.items()
    ]
    result = counts[0]
    for part in counts[1:]:
        result = result.unionByName(part)
    return result


def _spec_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        tables.readings(spark, folder),
        tables.recipe_mapping(spark, folder),
        specs.check_spec_keys(tables.recipe_specs(spark)),
    )


def spec_violations(spark: SparkSession, folder: str) -> DataFrame:
    return specs.spec_violations(*_spec_inputs(spark, folder)).withColumn("ts", _day("ts"))


def spec_check_summary(spark: SparkSession, folder: str) -> DataFrame:
    return specs.spec_check_summary(*_spec_inputs(spark, folder))


def lot_final_yield(spark: SparkSession, folder: str) -> DataFrame:
    return yields.lot_final_yield(tables.lot_steps(spark, folder))


def lot_loss_steps(spark: SparkSession, folder: str) -> DataFrame:
    rows = yields.lot_loss_steps(tables.lot_steps(spark, folder))
    return rows.withColumn("track_out_time", _day("track_out_time"))


def lot_worst_step(spark: SparkSession, folder: str) -> DataFrame:
    return yields.lot_worst_step(tables.lot_steps(spark, folder))


def lot_progression(spark: SparkSession, folder: str) -> DataFrame:
    return yields.lot_progression(tables.lot_steps(spark, folder))


def lot_defect_type(spark: SparkSession, folder: str) -> DataFrame:
    return yields.lot_defect_type(
        tables.lot_steps(spark, folder), tables.readings(spark, folder)
    )


def read_strip_maps(spark: SparkSession, folder: str) -> DataFrame:
    return strips.parse_strip_files(tables.strip_files(spark, folder))


def strip_yield(spark: SparkSession, folder: str) -> DataFrame:
    return strips.strip_yield(read_strip_maps(spark, folder))


def strip_fail_rows(spark: SparkSession, folder: str) -> DataFrame:
    return strips.strip_fail_rows(read_strip_maps(spark, folder))


def strip_fail_pattern(spark: SparkSession, folder: str) -> DataFrame:
    return strips.strip_fail_pattern(tables.strip_files(spark, folder))


def lot_die_yield(spark: SparkSession, folder: str) -> DataFrame:
    """Over files of which some end before their map."""
    return strips.lot_die_yield(tables.strips(spark, folder), _cut_strip_yield(spark, folder))


def _cut_strip_yield(spark: SparkSession, folder: str) -> DataFrame:
    return strips.strip_yield(strips.parse_strip_files(tables.cut_strip_files(spark, folder)))


def missing_strip_maps(spark: SparkSession, folder: str) -> DataFrame:
    return strips.missing_strip_maps(tables.strips(spark, folder), _cut_strip_yield(spark, folder))


def lot_worst_strip(spark: SparkSession, folder: str) -> DataFrame:
    return strips.lot_worst_strip(
        tables.strips(spark, folder),
        strip_yield(spark, folder),
        strip_fail_pattern(spark, folder),
    )


def data_period(spark: SparkSession, folder: str) -> DataFrame:
    return yields.data_period(tables.lot_steps(spark, folder))


def known_values_guard(spark: SparkSession, folder: str) -> DataFrame:
    return yields.known_values(tables.lot_steps(spark, folder))


def low_yield_by_target(spark: SparkSession, folder: str) -> DataFrame:
    steps = tables.lot_steps(spark, folder)
    rows = yields.low_yield_by_target(
        steps, *_periods(steps, YEAR_RANGE), step_name="R-F", limit=50
    )
    return rows.withColumn("track_out_time", _day("track_out_time"))


def low_yield_lots(spark: SparkSession, folder: str) -> DataFrame:
    steps = tables.lot_steps(spark, folder)
    return yields.low_yield_lots(steps, *_periods(steps, YEAR_RANGE), limit=20)


def yield_by_group(spark: SparkSession, folder: str) -> DataFrame:
    steps = tables.lot_steps(spark, folder)
    return yields.yield_by_group(steps, "equipment", *_periods(steps, YEAR_RANGE))


def yield_by_step(spark: SparkSession, folder: str) -> DataFrame:
    steps = tables.lot_steps(spark, folder)
    return yields.yield_by_group(steps, "step", *_periods(steps, YEAR_RANGE))


def yield_by_month(spark: SparkSession, folder: str) -> DataFrame:
    steps = tables.lot_steps(spark, folder)
    return yields.yield_by_group(steps, "month", *_periods(steps, YEAR_RANGE))


def yield_period_compare(spark: SparkSession, folder: str) -> DataFrame:
    steps = tables.lot_steps(spark, folder)
    return yields.yield_period_compare(
        steps, "equipment", *_periods(steps, FIRST_HALF, SECOND_HALF), limit=50
    )


def yield_trend_counts(spark: SparkSession, folder: str) -> DataFrame:
    steps = tables.lot_steps(spark, folder)
    return yields.yield_trend_counts(
        steps, "equipment", *_periods(steps, FIRST_HALF, SECOND_HALF)
    )


def period_only_groups(spark: SparkSession, folder: str) -> DataFrame:
    steps = tables.lot_steps(spark, folder)
    return yields.period_only_groups(
        steps, "equipment", *_periods(steps, FIRST_DAYS, SECOND_DAYS)
    )


def _lot_store(spark: SparkSession, folder: str) -> lot_store.LotStore:
    return lot_store.write_store(
        {"steps": tables.lot_steps(spark, folder), "readings": tables.readings(spark, folder)}
    )


def stored_lot_defect_type(spark: SparkSession, folder: str) -> DataFrame:
    """Worst step and label of each lot, from tables stored by lot."""
    return _lot_store(spark, folder).per_lot(yields.stored_defect_type, "steps", "readings")


def stored_lot_final_yield(spark: SparkSession, folder: str) -> DataFrame:
    """Final yield of each lot, from tables stored by lot."""
    return _lot_store(spark, folder).per_lot(yields.lot_final_yield, "steps")


def _rollup(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rollup, steps); the rollup is written by month and read back."""
    steps, path = tables.lot_steps(spark, folder), scratch_path(spark, "months")
    rollup.write_rollup(steps, path)
    return rollup.read_rollup(spark, path), steps


def rollup_by_group(spark: SparkSession, folder: str) -> DataFrame:
    """Yield per equipment of whole months, from the rollup alone."""
    months, _ = _rollup(spark, folder)
    period, = check_overlap(None, parse_period(*YEAR_RANGE), bounds=rollup.stored_period(months))
    return rollup.yield_by_group(months, "equipment", period)


def rollup_by_month(spark: SparkSession, folder: str) -> DataFrame:
    months, _ = _rollup(spark, folder)
    return rollup.yield_by_group(months, "month", parse_period(*YEAR_RANGE))


def rollup_cut_months(spark: SparkSession, folder: str) -> DataFrame:
    """Yield per step of a period that cuts its first and last month."""
    months, steps = _rollup(spark, folder)
    return rollup.yield_by_group(months, "step", parse_period(*CUT_RANGE), steps)


def rollup_period_compare(spark: SparkSession, folder: str) -> DataFrame:
    months, _ = _rollup(spark, folder)
    periods = (parse_period(*FIRST_HALF), parse_period(*SECOND_HALF))
    return rollup.yield_period_compare(months, "equipment", *periods, limit=50)


def rollup_only_groups(spark: SparkSession, folder: str) -> DataFrame:
    months, steps = _rollup(spark, folder)
    periods = (parse_period(*FIRST_DAYS), parse_period(*SECOND_DAYS))
    return rollup.period_only_groups(months, "equipment", *periods, steps)


def evidence_terms(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.evidence_terms(
        specs.spec_violations(*_spec_inputs(spark, folder)),
        lot_defect_type(spark, folder),
        lot_worst_strip(spark, folder),
    )


QUERIES = {
    f.__name__: f
    for f in (
        ingest_steps,
        lot_info,
        step_history,
        lot_recipe_specs,
        equipment_readings,
        lot_strips,
        table_counts,
        purge_by_registry,
        spec_violations,
        spec_check_summary,
        lot_final_yield,
        lot_loss_steps,
        lot_worst_step,
        lot_progression,
        lot_defect_type,
        read_strip_maps,
        strip_yield,
        strip_fail_rows,
        strip_fail_pattern,
        lot_die_yield,
        missing_strip_maps,
        lot_worst_strip,
        data_period,
        known_values_guard,
        low_yield_by_target,
        low_yield_lots,
        yield_by_group,
        yield_by_step,
        yield_by_month,
        yield_period_compare,
        yield_trend_counts,
        period_only_groups,
        stored_lot_defect_type,
        stored_lot_final_yield,
        rollup_by_group,
        rollup_by_month,
        rollup_cut_months,
        rollup_period_compare,
        rollup_only_groups,
        evidence_terms,
    )
}

STEPS_SQL = """steps AS (
  SELECT l_orderkey AS lot_id, l_linenumber AS step_seq,
         l_returnflag || '-' || l_linestatus AS step_name, 'EQ' || l_suppkey AS eqp_id,
         CAST(l_quantity * 100 AS BIGINT) AS in_qty,
         CAST(round(l_quantity * l_discount * 100) AS BIGINT) AS reject,
         CAST(l_quantity * 100 AS BIGINT)
           - CAST(round(l_quantity * l_discount * 100) AS BIGINT) AS out_qty,
         100e0 - round(l_discount * 100) AS yield_num,
         CAST(l_shipdate AS DATE) AS d
  FROM lineitem),
ordered AS (
  SELECT *, row_number() OVER w AS pos,
         row_number() OVER (PARTITION BY lot_id ORDER BY step_seq DESC, d DESC, eqp_id DESC,
                            in_qty DESC, reject DESC, step_name DESC) AS back
  FROM steps
  WINDOW w AS (PARTITION BY lot_id ORDER BY step_seq, d, eqp_id, in_qty, reject, step_name))"""


def pct_sql(out_qty: str, in_qty: str) -> str:
    return (
        f"CASE WHEN {in_qty} <> 0 THEN CAST(round(CAST({out_qty} * 100e0 / {in_qty} "
        f"AS DECIMAL(18,9)), 2) AS DOUBLE) END"
    )


WORST_SQL = """worst AS (
  SELECT lot_id, step_seq, step_name, eqp_id, yield_num, reject FROM (
    SELECT *, row_number() OVER (PARTITION BY lot_id ORDER BY yield_num, pos) AS rn
    FROM ordered) WHERE rn = 1)"""

_VALUES = ", ".join(
    f"('{recipe}', '{key}', '{low}', '{high}', '{flag}')"
    for recipe, limits in tables.SPEC_LIMITS.items()
    for key, low, high, flag in limits
)
READINGS_SQL = f"""readings AS (
  SELECT l_orderkey AS lot_id, 'EQ' || l_suppkey AS eqp_id, k AS key,
         CASE k WHEN 'QTY' THEN CAST(CAST(round(l_quantity) AS INT) AS VARCHAR)
                WHEN 'DISC' THEN CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR)
                WHEN 'TAX' THEN CAST(CAST(round(l_tax * 100) AS INT) AS VARCHAR)
                ELSE 'label-' || l_returnflag END AS value,
         CAST(l_shipdate AS DATE) AS d
  FROM lineitem, (VALUES ('QTY'), ('DISC'), ('TAX'), ('DEFECT_TYPE')) keys(k)
  WHERE k <> 'DEFECT_TYPE' OR l_discount >= 0.09),
specs(recipe, key, min_text, max_text, active_flag) AS (VALUES {_VALUES}),
recipes AS (SELECT o_orderkey AS lot_id, 'R' || (o_orderkey % 5) AS recipe FROM orders),
checked AS (
  SELECT r.*, m.recipe, s.min_text, s.max_text,
         CASE WHEN CAST(r.value AS DOUBLE) < CAST(s.min_text AS DOUBLE) THEN 'below_min'
              WHEN CAST(r.value AS DOUBLE) > CAST(s.max_text AS DOUBLE) THEN 'above_max'
              ELSE 'in_spec' END AS state
  FROM readings r JOIN recipes m USING (lot_id)
  JOIN specs s ON s.recipe = m.recipe AND s.key = r.key
  WHERE s.active_flag = 'T' AND TRY_CAST(s.min_text AS DOUBLE) IS NOT NULL
    AND TRY_CAST(s.max_text AS DOUBLE) IS NOT NULL)"""

DEFECT_SQL = """defects AS (
  SELECT w.lot_id, w.eqp_id, w.step_name,
         (SELECT arg_min(r.value, (r.d, r.value)) FROM readings r
          WHERE r.lot_id = w.lot_id AND r.eqp_id = w.eqp_id AND r.key = 'DEFECT_TYPE')
           AS defect_type
  FROM worst w)"""

DIES_SQL = """dies AS (
  SELECT vec_id AS strip_id, label AS lot_id, (g - 1) // 16 AS i, (g - 1) % 16 AS j,
         len(embedding) // 16 AS n, CASE WHEN embedding[g] >= -0.15 THEN 1 ELSE 0 END AS ok
  FROM embeddings, range(1, 65) t(g)),
per_strip AS (
  SELECT strip_id, any_value(lot_id) AS lot_id, count(*) AS total_die, sum(ok)::BIGINT AS good_die,
         (count(*) - sum(ok))::BIGINT AS fail_die,
         CAST(round(CAST(sum(ok) * 100e0 / count(*) AS DECIMAL(18,9)), 2) AS DOUBLE) AS yield_pct
  FROM dies GROUP BY strip_id),
fails AS (SELECT * FROM dies WHERE ok = 0),
stripes AS (
  SELECT DISTINCT strip_id FROM (
    SELECT f.strip_id, k, f.j % k AS r, count(*) AS hits, count(DISTINCT f.j) AS cols
    FROM fails f, (VALUES (4), (3), (2)) p(k) GROUP BY ALL) h
  JOIN per_strip s USING (strip_id) WHERE hits >= s.fail_die * 0.8e0 AND cols >= 3),
spots AS (
  SELECT strip_id,
         count(*) FILTER (i >= 4 * 0.2e0 AND i <= 4 * 0.8e0
                          AND j >= 16 * 0.2e0 AND j <= 16 * 0.8e0) AS center,
         count(*) FILTER (i < 4 * 0.1e0 OR i >= 4 * 0.9e0
                          OR j < 16 * 0.1e0 OR j >= 16 * 0.9e0) AS edge
  FROM fails GROUP BY strip_id),
area AS (
  SELECT count(*) FILTER (i < 4 * 0.1e0 OR i >= 4 * 0.9e0 OR j < 16 * 0.1e0
                          OR j >= 16 * 0.9e0) * 1e0 / count(*) AS share
  FROM range(0, 4) a(i), range(0, 16) b(j)),
patterns AS (
  SELECT s.strip_id, s.fail_die,
         CASE WHEN s.fail_die = 0 THEN 'none'
              WHEN t.strip_id IS NOT NULL THEN 'stripe'
              WHEN c.center >= s.fail_die * 0.7e0 THEN 'center'
              WHEN c.edge * 1e0 / s.fail_die >= area.share * 1.6e0 THEN 'edge'
              ELSE 'scattered' END AS pattern
  FROM per_strip s LEFT JOIN stripes t USING (strip_id) LEFT JOIN spots c USING (strip_id), area),
worst_strips AS (
  SELECT lot_id, strip_id, strip_id AS position, yield_pct, pattern FROM (
    SELECT s.*, p.pattern,
           row_number() OVER (PARTITION BY lot_id ORDER BY yield_pct, strip_id) AS rn
    FROM per_strip s JOIN patterns p USING (strip_id)) WHERE rn = 1)"""


def _groups_sql(key: str, order: str, bounds: tuple[str, str] = YEAR_RANGE) -> str:
    return f"""WITH {STEPS_SQL}, g AS (
  SELECT {key} AS group_key, count(DISTINCT lot_id) AS lot_count, sum(in_qty)::BIGINT AS in_qty,
         sum(reject)::BIGINT AS reject, sum(out_qty)::BIGINT AS out_qty,
         {pct_sql('sum(out_qty)', 'sum(in_qty)')} AS yield_pct
  FROM steps WHERE d BETWEEN DATE '{bounds[0]}' AND DATE '{bounds[1]}' GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY {order}) AS rank, count(*) OVER () AS total_groups
FROM g ORDER BY {order}"""


def _pairs_sql(first: tuple[str, str], second: tuple[str, str]) -> str:
    def side(bounds: tuple[str, str]) -> str:
        low, high = (b.replace("/", "-") for b in bounds)
        return f"""SELECT eqp_id AS group_key, count(DISTINCT lot_id) AS lots,
  {pct_sql('sum(out_qty)', 'sum(in_qty)')} AS pct
  FROM steps WHERE d BETWEEN DATE '{low}' AND DATE '{high}' GROUP BY 1"""

    return f"""{STEPS_SQL}, a AS ({side(first)}), b AS ({side(second)}),
deltas AS (SELECT group_key, a.pct AS p1_yield, a.lots AS p1_lots, b.pct AS p2_yield,
                  b.lots AS p2_lots,
                  CAST(round(CAST(b.pct - a.pct AS DECIMAL(18,9)), 2) AS DOUBLE) AS delta
           FROM a JOIN b USING (group_key))"""


ORACLES = {
    "ingest_steps": """SELECT l_orderkey AS LOTID, l_linenumber AS STEPSEQ,
  l_returnflag || '-' || l_linestatus AS STEPNAME, 'EQ' || l_suppkey AS EQPID,
  CAST(l_quantity * 100 AS BIGINT) AS INQTY,
  CAST(round(l_quantity * l_discount * 100) AS BIGINT) AS REJECT,
  CAST(l_quantity * 100 AS BIGINT)
    - CAST(round(l_quantity * l_discount * 100) AS BIGINT) AS OUTQTY,
  (100 - CAST(round(l_discount * 100) AS INT)) || '.0%' AS YIELD,
  strftime(l_shipdate, '%Y%m%d %H%M%S') || '000' AS TRACKOUTTIME,
  100e0 - round(l_discount * 100) AS YIELD_NUM,
  strftime(l_shipdate, '%Y-%m-%d') AS TRACK_OUT_DATE,
  strftime(l_shipdate, '%Y%m') AS TRACK_OUT_MONTH FROM lineitem""",
    "lot_info": """SELECT o_orderkey AS lot_id, o_custkey AS customer_id,
  o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS value,
  strftime(o_orderdate, '%Y-%m-%d') AS due_date FROM orders""",
    "step_history": f"""WITH {STEPS_SQL}
SELECT lot_id, step_seq, step_name, eqp_id, in_qty, reject, out_qty, yield_num,
       CAST(d AS VARCHAR) AS track_out_time FROM steps""",
    "lot_recipe_specs": f"""WITH {READINGS_SQL}
SELECT lot_id, m.recipe, key, min_text, max_text
FROM recipes m JOIN specs s USING (recipe) WHERE active_flag = 'T'""",
    "equipment_readings": f"""WITH {READINGS_SQL}
SELECT lot_id, eqp_id, key, value, CAST(d AS VARCHAR) AS ts FROM readings""",
    "lot_strips": "SELECT label AS lot_id, vec_id AS strip_id, vec_id AS position FROM embeddings",
    "table_counts": """SELECT 'lots' AS name, count(DISTINCT o_orderkey) AS n FROM orders
UNION ALL SELECT 'strips', count(*) FROM embeddings""",
    "purge_by_registry": f"""WITH {READINGS_SQL},
reg AS (SELECT o_orderkey AS lot_id FROM orders WHERE o_orderpriority = '1-URGENT'),
everything AS (
  SELECT 'lots' AS table_name, o_orderkey AS lot_id FROM orders
  UNION ALL SELECT 'steps', l_orderkey FROM lineitem
  UNION ALL SELECT 'readings', lot_id FROM readings
  UNION ALL SELECT 'recipes', o_orderkey FROM orders
  UNION ALL SELECT 'strips', label FROM embeddings)
SELECT table_name, count(*) AS kept_rows, sum(lot_id)::BIGINT AS lot_id_sum
FROM everything WHERE lot_id NOT IN (SELECT lot_id FROM reg) GROUP BY 1""",
    "spec_violations": f"""WITH {READINGS_SQL}
SELECT lot_id, recipe, eqp_id, key, value, min_text, max_text, state, CAST(d AS VARCHAR) AS ts
FROM checked WHERE state <> 'in_spec'""",
    "spec_check_summary": f"""WITH {READINGS_SQL}, items AS (
  SELECT lot_id, recipe, key, count(*) AS checked,
         count(*) FILTER (state <> 'in_spec') AS violated FROM checked GROUP BY ALL)
SELECT lot_id, recipe, sum(checked)::BIGINT AS checked, sum(violated)::BIGINT AS violations,
       coalesce(string_agg(key || ' x' || (checked - violated), ', ' ORDER BY key)
                FILTER (checked > violated), '') AS in_spec_items
FROM items GROUP BY ALL""",
    "lot_final_yield": f"""WITH {STEPS_SQL}, ends AS (
  SELECT lot_id, count(*) AS step_count, max(in_qty) FILTER (pos = 1) AS first_in_qty,
         max(out_qty) FILTER (back = 1) AS last_out_qty FROM ordered GROUP BY lot_id)
SELECT *, {pct_sql('last_out_qty', 'first_in_qty')} AS final_yield FROM ends""",
    "lot_loss_steps": f"""WITH {STEPS_SQL}
SELECT lot_id, step_seq, step_name, eqp_id, reject, yield_num,
       CAST(d AS VARCHAR) AS track_out_time FROM steps WHERE reject > 0""",
    "lot_worst_step": f"WITH {STEPS_SQL}, {WORST_SQL} SELECT * FROM worst",
    "lot_progression": f"""WITH {STEPS_SQL}
SELECT lot_id, pos AS position, step_name FROM ordered""",
    "lot_defect_type": f"""WITH {STEPS_SQL}, {WORST_SQL}, {READINGS_SQL}, {DEFECT_SQL}
SELECT * FROM defects""",
    "read_strip_maps": f"""WITH {DIES_SQL}
SELECT strip_id, i::INT AS row_idx, string_agg(ok::VARCHAR, '' ORDER BY j) AS bits
FROM dies GROUP BY strip_id, i""",
    "strip_yield": f"""WITH {DIES_SQL}
SELECT strip_id, total_die, good_die, fail_die, yield_pct FROM per_strip""",
    "strip_fail_rows": f"""WITH {DIES_SQL}
SELECT strip_id, i::INT AS row_idx, count(*)::INT AS fail_count, min(j)::INT AS first_col,
       max(j)::INT AS last_col
FROM fails GROUP BY strip_id, i""",
    "strip_fail_pattern": f"WITH {DIES_SQL} SELECT * FROM patterns",
    "lot_die_yield": f"""WITH {DIES_SQL}, listed AS (
  SELECT e.label AS lot_id, s.* EXCLUDE (lot_id)
  FROM embeddings e LEFT JOIN per_strip s ON s.strip_id = e.vec_id AND e.embedding[1] <= {tables.CUT_ABOVE})
SELECT lot_id, count(*) AS strip_count, count(*) FILTER (strip_id IS NULL) AS missing_maps,
       sum(total_die)::BIGINT AS total_die, sum(fail_die)::BIGINT AS fail_die,
       {pct_sql('sum(good_die)', 'sum(total_die)')} AS die_yield FROM listed GROUP BY lot_id""",
    "missing_strip_maps": f"""SELECT label AS lot_id, vec_id AS strip_id, vec_id AS position
FROM embeddings WHERE embedding[1] > {tables.CUT_ABOVE}""",
    "lot_worst_strip": f"WITH {DIES_SQL} SELECT * FROM worst_strips",
    "data_period": """SELECT strftime(min(l_shipdate), '%Y-%m-%d') AS first_day,
  strftime(max(l_shipdate), '%Y-%m-%d') AS last_day FROM lineitem""",
    "known_values_guard": f"""WITH {STEPS_SQL}
SELECT DISTINCT 'step' AS kind, step_name AS value FROM steps
UNION ALL SELECT DISTINCT 'equipment', eqp_id FROM steps""",
    "low_yield_by_target": f"""WITH {STEPS_SQL}, hit AS (
  SELECT *, row_number() OVER (ORDER BY yield_num, lot_id, step_seq, d, eqp_id, in_qty, reject,
                               step_name) AS rank
  FROM steps WHERE d BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND step_name = 'R-F')
SELECT lot_id, step_seq, step_name, eqp_id, in_qty, reject, out_qty, yield_num,
       CAST(d AS VARCHAR) AS track_out_time, rank FROM hit WHERE rank <= 50""",
    "low_yield_lots": f"""WITH {STEPS_SQL}, {WORST_SQL}, ends AS (
  SELECT lot_id, max(d) AS last_d, max(in_qty) FILTER (pos = 1) AS first_in,
         max(out_qty) FILTER (back = 1) AS last_out, max(d) FILTER (back = 1) AS done
  FROM ordered GROUP BY lot_id),
hit AS (SELECT *, {pct_sql('last_out', 'first_in')} AS final_yield FROM ends
        WHERE last_d BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND first_in <> 0)
SELECT h.lot_id, final_yield, w.step_name AS worst_step, w.eqp_id AS worst_eqp,
       w.yield_num AS worst_yield, CAST(done AS VARCHAR) AS done_day,
       row_number() OVER (ORDER BY final_yield, h.lot_id) AS rank,
       count(*) OVER () AS lots_in_period
FROM hit h JOIN worst w USING (lot_id) ORDER BY final_yield, h.lot_id LIMIT 20""",
    "yield_by_group": _groups_sql("eqp_id", "yield_pct, group_key"),
    "yield_by_step": _groups_sql("step_name", "yield_pct, group_key"),
    "yield_by_month": _groups_sql("strftime(d, '%Y-%m')", "group_key"),
    "yield_period_compare": f"""WITH {_pairs_sql(FIRST_HALF, SECOND_HALF)}
SELECT *, row_number() OVER (ORDER BY delta, group_key) AS rank
FROM deltas ORDER BY delta, group_key LIMIT 50""",
    "yield_trend_counts": f"""WITH {_pairs_sql(FIRST_HALF, SECOND_HALF)}
SELECT count(*) AS compared, count(*) FILTER (delta < 0) AS down,
       count(*) FILTER (delta = 0) AS flat, count(*) FILTER (delta > 0) AS up FROM deltas""",
    "period_only_groups": f"""WITH {_pairs_sql(FIRST_DAYS, SECOND_DAYS)}
SELECT coalesce(a.group_key, b.group_key) AS group_key,
       CASE WHEN b.group_key IS NULL THEN 'period1' ELSE 'period2' END AS only_in
FROM a FULL JOIN b USING (group_key) WHERE a.group_key IS NULL OR b.group_key IS NULL""",
    "evidence_terms": f"""WITH {STEPS_SQL}, {WORST_SQL}, {READINGS_SQL}, {DEFECT_SQL}, {DIES_SQL},
words(pattern, n, term) AS (VALUES {", ".join(
    f"('{pattern}', {n}, '{term}')"
    for pattern, terms in evidence.PATTERN_TERMS.items()
    for n, term in enumerate(terms)
)}),
terms AS (
  SELECT DISTINCT lot_id, 1 AS block, key || '/' || state AS sub, 1 AS n, key AS term
  FROM checked WHERE state <> 'in_spec'
  UNION ALL SELECT DISTINCT lot_id, 1, key || '/' || state, 2, state
  FROM checked WHERE state <> 'in_spec'
  UNION ALL SELECT lot_id, 3, '', 3, step_name FROM defects
  UNION ALL SELECT lot_id, 4, '', 4, defect_type FROM defects WHERE defect_type IS NOT NULL
  UNION ALL SELECT lot_id, n + 5, '', n + 5, term FROM worst_strips JOIN words USING (pattern)),
firsts AS (SELECT lot_id, term, min((block, sub, n)) AS place FROM terms GROUP BY ALL)
SELECT lot_id, string_agg(term, ' ' ORDER BY place) AS terms FROM firsts GROUP BY lot_id""",
}

ORACLES |= {
    "stored_lot_defect_type": ORACLES["lot_defect_type"],
    "stored_lot_final_yield": ORACLES["lot_final_yield"],
    "rollup_by_group": ORACLES["yield_by_group"],
    "rollup_by_month": ORACLES["yield_by_month"],
    "rollup_cut_months": _groups_sql("step_name", "yield_pct, group_key", CUT_RANGE),
    "rollup_period_compare": ORACLES["yield_period_compare"],
    "rollup_only_groups": ORACLES["period_only_groups"],
}
