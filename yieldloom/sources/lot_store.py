"""Step and reading rows stored by lot, so that per-lot analyses need no shuffle.

Tables are bucketed and sorted by lot; a grouping or a join by lot then works inside a
bucket. A lot with very many rows would make its bucket one long task, so lots above a
bound are stored in tables without buckets, where a grouping adds up in many tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.operators.joins import broadcast_if_small
from yieldloom.sources.scratch import checkpoint_folder

#: Rows of one lot from which on it is stored apart.
LARGE_LOT = 1_000_000
#: Rows that one bucket should hold.
BUCKET_ROWS = 2_000_000


@dataclass(frozen=True)
class LotStore:
    """Tables by name: ``bucketed`` by lot, and ``large`` for the lots above the bound."""

    path: str
    buckets: int
    bucketed: dict[str, DataFrame]
    large: dict[str, DataFrame]

    def per_lot(self, operator: Callable[..., DataFrame], *names: str) -> DataFrame:
        """An operator whose rows depend on one lot each, on the named tables.

        Lots are in one of the two parts, so the results are put together as they are.
        """
        parts = (self.bucketed, self.large)
        first, second = (operator(*[part[n] for n in names]) for part in parts)
        return first.unionByName(second)


def _open(spark: SparkSession, path: str, buckets: int, name: str) -> DataFrame:
    """A bucketed folder as a table of the session; its files are left where they are."""
    schema = spark.read.parquet(f"{path}/{name}").schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    table = f"lots_{name}_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (lot_id) SORTED BY (lot_id) "
        f"INTO {buckets} BUCKETS LOCATION '{path}/{name}'"
    )
    return spark.table(table)


def open_store(spark: SparkSession, path: str, buckets: int, names: list[str]) -> LotStore:
    """A store written earlier, in this or another session."""
    return LotStore(
        path,
        buckets,
        {n: _open(spark, path, buckets, n) for n in names},
        {n: spark.read.parquet(f"{path}/{n}-large") for n in names},
    )


def write_store(
    tables: dict[str, DataFrame],
    path: str | None = None,
    buckets: int | None = None,
    large_lot: int = LARGE_LOT,
) -> LotStore:
    """Write tables with a ``lot_id`` as a store and open it.

    The first table decides which lots are large. Rows without a lot are stored with the
    large ones, as they may be many. Without ``buckets`` there is one for ``BUCKET_ROWS``
    rows of the first table, and at least one for each core.
    """
    main = next(iter(tables.values()))
    spark = main.sparkSession
    path = path or f"{checkpoint_folder(spark).rstrip('/')}/lots-{uuid.uuid4().hex}"
    counted = main.groupBy("lot_id").agg(F.count(F.lit(1)).alias("rows"))
    counted.write.parquet(f"{path}/sizes")
    sizes = spark.read.parquet(f"{path}/sizes")
    if buckets is None:
        rows = sizes.agg(F.sum("rows")).first()[0] or 0
        buckets = max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))
    large = sizes.filter((F.col("rows") > large_lot) & F.col("lot_id").isNotNull()).select("lot_id")
    side = broadcast_if_small(large)
    for name, table in tables.items():
        known = table.filter(F.col("lot_id").isNotNull())
        staged = f"lots_{name}_{uuid.uuid4().hex}"
        (
            known.join(side, "lot_id", "left_anti")
            .repartition(buckets, "lot_id")
            .sortWithinPartitions("lot_id")
            .write.bucketBy(buckets, "lot_id")
            .sortBy("lot_id")
            .option("path", f"{path}/{name}")
            .format("parquet")
            .saveAsTable(staged)
        )
        # The entry in the catalog goes, the files stay.
        spark.sql(f"DROP TABLE {staged}")
        apart = known.join(side, "lot_id", "left_semi").unionByName(
            table.filter(F.col("lot_id").isNull())
        )
        apart.write.parquet(f"{path}/{name}-large")
    return open_store(spark, path, buckets, list(tables))
