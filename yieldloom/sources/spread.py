"""Parallelism of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Give a scan with few tasks one task per core; leave any larger scan where it is.

    Text work is CPU-bound, and a small file is often a single row group. ``key``
    must be unique or nearly so.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *key)
