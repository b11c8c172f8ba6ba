"""Folders and tables that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path under spark.checkpoint.dir; where that is unset, in a temporary folder, but on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tables-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table: all later readings see the same partitions' values."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
