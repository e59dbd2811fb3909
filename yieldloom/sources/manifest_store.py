"""A manifest stored by buckets of its URLs, so that an update rewrites only what it touches.

A record lies in the folder of its URL's hash. An update reads and rewrites the folders of
the URLs it brings; all other files stay as they are. One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from yieldloom.operators.manifest import manifest_upsert
from yieldloom.sources.scratch import checkpoint, scratch_path

PART = "part"
#: Folders of a store, which bounds the list of folders that an update names.
BUCKETS = 64


@dataclass(frozen=True)
class ManifestStore:
    """Where a manifest is and how it is laid out; the same values open it again."""

    path: str
    schema: StructType
    buckets: int = BUCKETS

    def read(self, spark: SparkSession, parts: list[int] | None = None) -> DataFrame:
        """All records, or those in some folders. No records before the first write."""
        fields = StructType([*self.schema.fields]).add(PART, IntegerType())
        rows = spark.read.schema(fields).parquet(self.path)
        if parts is not None:
            rows = rows.filter(F.col(PART).isin(parts))
        return rows.select(self.schema.names)

    def _placed(self, records: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int")
        return records.select(*self.schema.names, part.alias(PART))

    def write(self, records: DataFrame) -> None:
        """Store a manifest with one record per URL in place of what is there."""
        placed = self._placed(records).repartition(self.buckets, PART)
        placed.write.mode("overwrite").partitionBy(PART).parquet(self.path)

    def upsert(self, fetched: DataFrame, mode: str = "replace") -> list[int]:
        """Merge fetch records by ``manifest_upsert``; returns the folders that were rewritten.

        Rows with a null URL are one record, as there. The merged folders are written to the
        shared scratch folder first, so the store is never read while it is rewritten.
        """
        spark = fetched.sparkSession
        new = checkpoint(self._placed(fetched))
        # At most one number per folder.
        parts = sorted(r[PART] for r in new.select(PART).distinct().collect())
        if not parts:
            return parts
        merged = manifest_upsert(self.read(spark, parts), new.drop(PART), mode)
        staged = scratch_path(spark, "manifest")
        self._placed(merged).repartition(len(parts), PART).write.partitionBy(PART).parquet(staged)
        fields = StructType([*self.schema.fields]).add(PART, IntegerType())
        (
            spark.read.schema(fields)
            .parquet(staged)
            .repartition(len(parts), PART)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(PART)
            .parquet(self.path)
        )
        return parts


def new_store(records: DataFrame, path: str | None = None, buckets: int = BUCKETS) -> ManifestStore:
    """Write a manifest as a new store."""
    path = path or scratch_path(records.sparkSession, "manifest-store")
    store = ManifestStore(path, records.schema, buckets)
    store.write(records)
    return store
