"""Where intermediate tables go.

On a cluster this is the shared folder the session names in
``spark.checkpoint.dir``. Only a local session may fall back to a folder of its
own machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; set for local sessions if it is missing."""
    context = spark.sparkContext
    active = context.getCheckpointDir()
    if active:
        return active
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="yieldloom-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and go on from the written copy."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for one table that later steps read back."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
