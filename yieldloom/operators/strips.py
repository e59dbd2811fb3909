"""Die-level analytics on strip maps.

A strip map is one file, so it arrives as one row and its grid rows are produced
inside that row. Grid rows stay 0/1 strings: counts come from string lengths and
only failing dies are ever expanded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.functions.quantities import yield_pct

# Tested periods, thresholds and bands of the pattern rules.
STRIPE_PERIODS = (8, 4, 6, 3, 2)
STRIPE_SHARE = 0.8
STRIPE_MIN_COLUMNS = 3
CENTER_LOW, CENTER_HIGH, CENTER_SHARE = 0.2, 0.8, 0.7
EDGE_LOW, EDGE_HIGH, EDGE_FACTOR = 0.1, 0.9, 1.6


def map_lines(content: Column) -> Column:
    """Lines of a map file that hold nothing but 0 and 1 after trimming."""
    trimmed = F.transform(
        F.split(content, "\r\n|\r|\n"), lambda line: F.regexp_replace(line, r"^\s+|\s+$", "")
    )
    return F.filter(trimmed, lambda line: line.rlike("^[01]+$"))


def parse_strip_files(files: DataFrame) -> DataFrame:
    """(strip_id, content) -> one row per grid row, numbered from 0 over map lines only."""
    lines = F.posexplode_outer(map_lines(F.col("content"))).alias("row_idx", "bits")
    return files.select("strip_id", lines).filter(F.col("bits").isNotNull())


def fail_count(bits: Column) -> Column:
    return F.length(bits) - F.length(F.replace(bits, F.lit("0"), F.lit("")))


def strip_yield(map_rows: DataFrame) -> DataFrame:
    totals = map_rows.groupBy("strip_id").agg(
        F.sum(F.length("bits")).alias("total_die"),
        F.sum(fail_count(F.col("bits"))).alias("fail_die"),
    )
    good = F.col("total_die") - F.col("fail_die")
    return totals.select(
        "strip_id",
        "total_die",
        good.alias("good_die"),
        "fail_die",
        F.coalesce(yield_pct(good, F.col("total_die")), F.lit(0.0)).alias("yield_pct"),
    )


def strip_fail_rows(map_rows: DataFrame) -> DataFrame:
    """Grid rows with failures: how many, first and last failing column."""
    bits = F.col("bits")
    return map_rows.filter(F.instr(bits, "0") > 0).select(
        "strip_id",
        "row_idx",
        fail_count(bits).alias("fail_count"),
        (F.instr(bits, "0") - 1).alias("first_col"),
        (F.length(bits) - F.instr(F.reverse(bits), "0")).alias("last_col"),
    )


def band_cells(size: Column) -> Column:
    """How many of the indexes 0..size-1 lie outside the outer bands."""
    low = F.ceil(size * EDGE_LOW)
    high = F.ceil(size * EDGE_HIGH)
    return F.greatest(high - low, F.lit(0))


def strip_fail_pattern(files: DataFrame) -> DataFrame:
    """Spatial label per strip: none, stripe, center, edge or scattered, tested in this order.

    Strips are placed by id once; both groupings below reuse that placement.
    """
    lines = map_lines(F.col("content"))
    grids = (
        files.repartition("strip_id")
        .withColumn("lines", lines)
        .select(
            "strip_id",
            "lines",
            F.size("lines").alias("n_rows"),
            F.coalesce(
                F.array_max(F.transform("lines", lambda line: F.length(line))), F.lit(0)
            ).alias("n_cols"),
        )
    )
    # Failing columns of one grid row; an empty row keeps strips without failures.
    dies = (
        grids.select(
            "strip_id", "n_rows", "n_cols", F.posexplode_outer("lines").alias("i", "bits")
        )
        .select(
            "strip_id",
            "n_rows",
            "n_cols",
            "i",
            F.explode_outer(
                F.filter(
                    F.sequence(F.lit(0), F.length("bits") - 1),
                    lambda j: F.substr(F.col("bits"), j + 1, F.lit(1)) == "0",
                )
            ).alias("j"),
        )
    )
    rows, cols = F.col("n_rows"), F.col("n_cols")
    i, j = F.col("i"), F.col("j")
    center = (
        (i >= rows * CENTER_LOW)
        & (i <= rows * CENTER_HIGH)
        & (j >= cols * CENTER_LOW)
        & (j <= cols * CENTER_HIGH)
    )
    edge = (
        (i < rows * EDGE_LOW)
        | (i >= rows * EDGE_HIGH)
        | (j < cols * EDGE_LOW)
        | (j >= cols * EDGE_HIGH)
    )
    columns = dies.groupBy("strip_id", "n_rows", "n_cols", "j").agg(
        F.count("j").alias("fails"),
        F.count_if(j.isNotNull() & center).alias("center"),
        F.count_if(j.isNotNull() & edge).alias("edge"),
    )
    residues = []
    for k in STRIPE_PERIODS:
        for r in range(k):
            here = j % k == r
            residues.append(F.sum(F.when(here, F.col("fails"))).alias(f"hits_{k}_{r}"))
            residues.append(F.count_if(here).alias(f"cols_{k}_{r}"))
    counted = columns.groupBy("strip_id", "n_rows", "n_cols").agg(
        F.sum("fails").alias("fails"),
        F.sum("center").alias("center"),
        F.sum("edge").alias("edge"),
        *residues,
    )
    fails = F.col("fails")
    stripe = F.lit(False)
    for k in STRIPE_PERIODS:
        for r in range(k):
            stripe = stripe | (
                (cols >= 3 * k)
                & (F.coalesce(F.col(f"hits_{k}_{r}"), F.lit(0)) >= fails * STRIPE_SHARE)
                & (F.col(f"cols_{k}_{r}") >= STRIPE_MIN_COLUMNS)
            )
    cells = F.greatest(rows * cols, F.lit(1)).cast("double")
    edge_share = (rows * cols - band_cells(rows) * band_cells(cols)).cast("double") / cells
    pattern = (
        F.when(fails == 0, "none")
        .when(stripe, "stripe")
        .when(F.col("center") >= fails * CENTER_SHARE, "center")
        .when(F.col("edge").cast("double") / fails >= edge_share * EDGE_FACTOR, "edge")
        .otherwise("scattered")
    )
    return counted.select("strip_id", fails.alias("fail_die"), pattern.alias("pattern"))


def lot_die_yield(strips: DataFrame, per_strip: DataFrame) -> DataFrame:
    """Pooled die yield per lot over strips that have a map; the others are counted apart.

    ``missing_strip_maps`` names them. A lot without any map has null dies and no yield.
    """
    pooled = (
        strips.join(per_strip, "strip_id", "left")
        .groupBy("lot_id")
        .agg(
            F.count(F.lit(1)).alias("strip_count"),
            F.count("total_die").alias("mapped_count"),
            F.sum("total_die").alias("total_die"),
            F.sum("good_die").alias("good_die"),
        )
    )
    return pooled.select(
        "lot_id",
        "strip_count",
        (F.col("strip_count") - F.col("mapped_count")).alias("missing_maps"),
        "total_die",
        (F.col("total_die") - F.col("good_die")).alias("fail_die"),
        yield_pct(F.col("good_die"), F.col("total_die")).alias("die_yield"),
    )


def missing_strip_maps(strips: DataFrame, per_strip: DataFrame) -> DataFrame:
    """The strips without a map by name, in long form, so that a lot may miss very many."""
    return strips.join(per_strip, "strip_id", "left_anti").select("lot_id", "strip_id", "position")


def lot_worst_strip(strips: DataFrame, per_strip: DataFrame, patterns: DataFrame) -> DataFrame:
    """Strip with the lowest yield per lot, earliest position on ties, with its pattern."""
    worst = (
        strips.join(per_strip, "strip_id")
        .groupBy("lot_id")
        .agg(
            F.min_by(
                F.struct("strip_id", "position", "yield_pct"),
                F.struct("yield_pct", "position", "strip_id"),
            ).alias("worst")
        )
        .select("lot_id", "worst.*")
    )
    return worst.join(patterns.select("strip_id", "pattern"), "strip_id", "left")
