"""Raw tab-separated days, the daily store, stored predictions and stored runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import PREDICTION, RAW, RESULT

RUN = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("params", T.MapType(T.StringType(), T.StringType())), T.StructField("results", T.ArrayType(RESULT))])


def file_date(path: Column) -> Column:
    """The day that a file's name or folder states; null if none."""
    return F.to_date(F.nullif(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})[^/]*(?:/[^/]*)?$", 1), F.lit("")))


def scan_raw(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files under path, with the file's day. An empty field is null; a line that does not parse is kept in `_corrupt_record`."""
    schema = T.StructType([*RAW.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).option("sep", "\t").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").csv(path)
    return rows.select("*", file_date(F.col("_metadata.file_path")).alias("file_date"))


def first_days(records: DataFrame, limit: int) -> DataFrame:
    """The records of the first `limit` days; an error if there is no file."""
    days = records.select("file_date").distinct().orderBy("file_date").limit(limit)
    if days.isEmpty():
        raise ValueError("no raw files")
    return records.join(F.broadcast(days), "file_date", "left_semi")  # `limit` rows at most


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, or None if nothing has been written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def daily_store(daily: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Adds to the store at path the days of `daily` (column date) that it lacks, or with overwrite replaces all of them; returns the store."""
    spark = daily.sparkSession
    have = stored(spark, path)
    if have is not None and not overwrite:
        daily = daily.join(F.broadcast(have.select("date").distinct()), "date", "left_anti")  # a row a day
    daily.repartition("date").write.partitionBy("date").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_predictions(rows: DataFrame, path: str) -> DataFrame:
    """Appends predictions (spec.PREDICTION); a run that is stored already is an error. Returns the store."""
    spark = rows.sparkSession
    have = stored(spark, path)
    if have is not None and not rows.join(have.select("run_id").distinct(), "run_id", "left_semi").isEmpty():
        raise ValueError("a run of this name is stored")
    rows.select(*[F.col(f.name).cast(f.dataType) for f in PREDICTION]).write.partitionBy("run_id").mode("append").parquet(path)
    return spark.read.schema(PREDICTION).parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per result of each stored run, with the run's parameters."""
    runs = spark.read.schema(RUN).json(path)
    return runs.select("run_id", "params", F.explode("results").alias("r")).select("run_id", "params", "r.*")


def config_diff(runs: DataFrame, ignored: tuple[str, ...] = ("device", "loss", "max_epochs", "patience")) -> DataFrame:
    """What of each run's parameters (run_id, model, params) differs between runs of its model, as sorted "k=v" text; empty if nothing."""
    flat = runs.select("run_id", "model", F.explode("params").alias("k", "v")).filter(~F.col("k").isin(*ignored)).distinct()
    runs_of = runs.select("model", "run_id").distinct().groupBy("model").agg(F.count("*").alias("runs"))
    varied = flat.groupBy("model", "k").agg(F.countDistinct("v").alias("kinds"), F.countDistinct("run_id").alias("with")).join(runs_of, "model")
    varied = varied.filter("kinds > 1 or with < runs").select("model", "k")
    told = flat.join(varied, ["model", "k"]).groupBy("run_id", "model").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "k", "v"))), ", ").alias("changed"))
    return runs.select("run_id", "model").distinct().join(told, ["run_id", "model"], "left").select("run_id", "model", F.coalesce("changed", F.lit("")).alias("changed"))
