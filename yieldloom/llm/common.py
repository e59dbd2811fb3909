"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.sources.scratch import scratch_path

#: A word is a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts that are ASCII throughout take the faster built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and go on from the copy.

    Cuts the lineage, so a lost executor costs a re-read, and keeps work that
    several later steps need from being done again.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with two longs, ``_file`` and ``_row``, that together name one of its rows.

    They say which file a row was read from and which row of it that is, so they are the same
    each time the table is read, whatever its ids. A table that does not come straight from
    files is written first.
    """

    def keyed(df: DataFrame) -> DataFrame:
        place = df.metadataColumn("_metadata")
        return df.select(
            "*", F.xxhash64(place["file_path"]).alias("_file"), place["row_index"].alias("_row")
        )

    try:
        return keyed(docs)
    except AnalysisException:
        return keyed(written(docs, "rows"))


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def groups_of(batches: Iterator[pa.RecordBatch], bytes_at_once: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that none holds much more text than ``bytes_at_once``."""
    for batch in batches:
        rows = batch.num_rows
        step = max(1, int(rows * bytes_at_once / max(1, batch.nbytes)))
        for start in range(0, rows, step):
            yield batch.slice(start, step)
