"""Running totals and the newest runs, kept current while run records arrive.

Each micro-batch writes the whole small table under its number; the one before stays for
readers that have just opened it, older ones go. A batch that is repeated after a failure
starts from the table before it and overwrites its own, so nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.operators.telemetry import LATENCY_WINDOW, latest, with_calls

AVAILABLE_NOW = {"availableNow": True}


def _filesystem(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose table is complete, in order."""
    folder, files = _filesystem(spark, path)
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory()]
    numbers = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]
    done = [n for n in numbers if files.exists(_filesystem(spark, f"{path}/batch={n}/_SUCCESS")[0])]
    return sorted(done)


def _replace(table: DataFrame, path: str, batch_id: int) -> None:
    """Write the table of a batch as one file and remove all but the one before it."""
    spark = table.sparkSession
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    for old in [n for n in batches(spark, path) if n < batch_id][:-1]:
        folder, files = _filesystem(spark, f"{path}/batch={old}")
        files.delete(folder, True)


def read_newest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table of the newest batch, or of the newest one before a number; None without any."""
    found = [n for n in batches(spark, path) if before is None or n < before]
    return spark.read.parquet(f"{path}/batch={found[-1]}") if found else None


def running_totals(runs: DataFrame) -> DataFrame:
    """Totals per intent; the state is one row per intent."""
    return (
        with_calls(runs)
        .groupBy("intent")
        .agg(
            F.count(F.lit(1)).alias("queries"),
            F.sum("fn_calls").alias("fn_calls"),
            F.sum("rag_calls").alias("rag_calls"),
        )
    )


def start_totals(runs: DataFrame, path: str, checkpoint: str, trigger: dict = AVAILABLE_NOW):
    """Keep the totals of all runs so far under ``path``.

    ``trigger`` is what ``writeStream.trigger`` takes; by default the job ends when all
    that is there has been counted.
    """
    return (
        running_totals(runs)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda totals, batch_id: _replace(totals, path, batch_id))
        .trigger(**trigger)
        .start()
    )


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """Newest totals per intent; no rows before the first batch."""
    schema = "scope string, queries long, fn_calls long, rag_calls long"
    newest = read_newest(spark, path)
    if newest is None:
        return spark.createDataFrame([], schema)
    return newest.withColumnRenamed("intent", "scope")


def start_latest(
    runs: DataFrame,
    path: str,
    checkpoint: str,
    n: int = LATENCY_WINDOW,
    trigger: dict = AVAILABLE_NOW,
):
    """Keep the newest ``n`` runs under ``path``, whatever order they arrive in.

    Of a micro-batch only its own newest ``n`` can be among them, so a batch meets the
    kept rows with at most ``n`` rows.
    """

    def keep(arrived: DataFrame, batch_id: int) -> None:
        held = read_newest(arrived.sparkSession, path, before=batch_id)
        newest = latest(arrived, n)
        if held is not None:
            newest = latest(newest.unionByName(held), n)
        _replace(newest, path, batch_id)

    return (
        runs.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(keep)
        .trigger(**trigger)
        .start()
    )


def read_latest(spark: SparkSession, path: str, runs: DataFrame) -> DataFrame:
    """The kept runs; no rows, with the columns of ``runs``, before the first batch."""
    newest = read_newest(spark, path)
    return spark.createDataFrame([], runs.schema) if newest is None else newest
