"""Written tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset (tests on one machine), a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tables-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that no later step reads."""
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows, read back from a table: lineage ends here and a lost executor loses nothing.

    Shuffle files of the write are removed when it ends, so that the disk in use is
    that of the largest step and not of all steps together.
    """
    spark = df.sparkSession
    path, before = path or new_path(spark), spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)
