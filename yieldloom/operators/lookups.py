"""Ingest, keyed lookups and table counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.functions.quantities import yield_text_to_number

TIME_FORMAT = "yyyyMMdd HHmmssSSS"
TIME_FORMAT_SHORT = "yyyyMMdd HHmmss"


def ingest_steps(raw: DataFrame) -> DataFrame:
    """Upper-case names, numeric yield, and native completion time with its month."""
    rows = raw.toDF(*[name.upper() for name in raw.columns])
    time = F.coalesce(
        F.try_to_timestamp("TRACKOUTTIME", F.lit(TIME_FORMAT)),
        F.try_to_timestamp("TRACKOUTTIME", F.lit(TIME_FORMAT_SHORT)),
    )
    return (
        rows.withColumn("YIELD_NUM", yield_text_to_number(F.col("YIELD")))
        .withColumn("TRACK_OUT_DATE", time.cast("date"))
        .withColumn("TRACK_OUT_MONTH", F.date_format(time, "yyyyMM"))
    )


def write_ingested(steps: DataFrame, path: str) -> None:
    """Store ingested steps by month, so that a period filter prunes folders.

    Rebalancing gathers a month and splits it again where it is large, so files
    are neither tiny nor written by one task.
    """
    steps.hint("rebalance", "TRACK_OUT_MONTH").write.partitionBy("TRACK_OUT_MONTH").mode(
        "errorifexists"
    ).parquet(path)


def lot_info(lots: DataFrame, lot_ids: list[int] | None = None) -> DataFrame:
    return lots if lot_ids is None else lots.filter(F.col("lot_id").isin(lot_ids))


def equipment_readings(
    readings: DataFrame, lot_id: int | None = None, eqp_id: str | None = None
) -> DataFrame:
    """Measurements, optionally of one lot and/or equipment."""
    rows = readings
    if lot_id is not None:
        rows = rows.filter(F.col("lot_id") == lot_id)
    if eqp_id is not None:
        rows = rows.filter(F.col("eqp_id") == eqp_id)
    return rows.select("lot_id", "eqp_id", "key", "value", "ts")


def lot_strips(strips: DataFrame, lot_ids: list[int] | None = None) -> DataFrame:
    rows = strips if lot_ids is None else strips.filter(F.col("lot_id").isin(lot_ids))
    return rows.select("lot_id", "strip_id", "position")


def table_counts(lots: DataFrame, strips: DataFrame) -> DataFrame:
    lot_count = lots.agg(
        F.lit("lots").alias("name"), F.countDistinct("lot_id").alias("n")
    )
    strip_count = strips.agg(F.lit("strips").alias("name"), F.count(F.lit(1)).alias("n"))
    return lot_count.unionByName(strip_count)


def purge_by_registry(tables: dict[str, DataFrame], registry: DataFrame) -> dict[str, DataFrame]:
    """Rows of lots that are not in the registry; the caller writes them to a new path."""
    known = registry.select("lot_id").distinct()
    return {name: table.join(known, "lot_id", "left_anti") for name, table in tables.items()}
