"""Measurements against the recipe limits of their lot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.functions.quantities import number_or_null
from yieldloom.operators.joins import MAX_BROADCAST_ROWS, broadcast_if_small, joined_side


def check_spec_keys(specs: DataFrame) -> DataFrame:
    """A recipe may limit a key once; which limit holds would be arbitrary otherwise."""
    active = specs.filter(F.col("active_flag") == "T")
    twice = active.groupBy("recipe", "key").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"duplicate active spec keys: {[(r.recipe, r['key']) for r in twice]}")
    return specs


def lot_recipes(mapping: DataFrame) -> DataFrame:
    """Recipe of each lot: earliest assignment, then smallest name."""
    return (
        mapping.filter(F.col("item_name") == "RECIPE")
        .groupBy("lot_id")
        .agg(F.min_by("check_value", F.struct("ts", "check_value")).alias("recipe"))
    )


def active_specs(specs: DataFrame) -> DataFrame:
    return specs.filter(F.col("active_flag") == "T").select(
        "recipe", "key", "min_text", "max_text"
    )


def lot_recipe_specs(mapping: DataFrame, specs: DataFrame) -> DataFrame:
    """Active limits of each lot's recipe."""
    return lot_recipes(mapping).join(broadcast_if_small(active_specs(specs)), "recipe")


def checked_readings(readings: DataFrame, mapping: DataFrame, specs: DataFrame) -> DataFrame:
    """Measurements with numeric value and limits, classified as below, above or in range.

    Limits are inclusive, and a NaN is neither below nor above them. Keys without
    a limit are dropped before the large join by lot.
    """
    limits = (
        active_specs(specs)
        .withColumn("low", number_or_null(F.col("min_text")))
        .withColumn("high", number_or_null(F.col("max_text")))
        .filter(F.col("low").isNotNull() & F.col("high").isNotNull())
    )
    rows = limits.limit(MAX_BROADCAST_ROWS + 1).count()
    limited_keys = joined_side(limits.select("key").distinct(), rows)
    number, low, high = F.col("number"), F.col("low"), F.col("high")
    state = (
        F.when(F.isnan(number) | F.isnan(low) | F.isnan(high), "in_spec")
        .when(number < low, "below_min")
        .when(number > high, "above_max")
        .otherwise("in_spec")
    )
    return (
        readings.join(limited_keys, "key", "left_semi")
        .withColumn("number", number_or_null(F.col("value")))
        .filter(F.col("number").isNotNull())
        .join(lot_recipes(mapping), "lot_id")
        .join(joined_side(limits, rows), ["recipe", "key"])
        .withColumn("state", state)
    )


def spec_violations(readings: DataFrame, mapping: DataFrame, specs: DataFrame) -> DataFrame:
    return (
        checked_readings(readings, mapping, specs)
        .filter(F.col("state") != "in_spec")
        .select(
            "lot_id", "recipe", "eqp_id", "key", "value", "min_text", "max_text", "state", "ts"
        )
    )


def spec_check_summary(readings: DataFrame, mapping: DataFrame, specs: DataFrame) -> DataFrame:
    """Per lot: checked and violated counts and how often each item was in range.

    Items are counted before they are listed, so a lot's list is never longer
    than its recipe.
    """
    per_item = (
        checked_readings(readings, mapping, specs)
        .groupBy("lot_id", "recipe", "key")
        .agg(
            F.count(F.lit(1)).alias("checked"),
            F.count_if(F.col("state") != "in_spec").alias("violated"),
        )
        .withColumn("fine", F.col("checked") - F.col("violated"))
    )
    item = F.when(F.col("fine") > 0, F.concat_ws(" x", "key", F.col("fine").cast("string")))
    return per_item.groupBy("lot_id", "recipe").agg(
        F.sum("checked").alias("checked"),
        F.sum("violated").alias("violations"),
        F.array_join(F.array_sort(F.collect_list(item)), ", ").alias("in_spec_items"),
    )
