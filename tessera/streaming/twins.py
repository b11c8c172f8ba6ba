"""Structured Streaming twins of batch operators. Each equals its batch form on windows that the final watermark has closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stores

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_files(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """Events as they arrive as files in a folder, `files` at most at a time."""
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def read_events(spark: SparkSession, path: str, delay: str = "1 hour", files: int = 1000) -> DataFrame:
    """The same with their series and a watermark on their time."""
    return read_files(spark, path, files).withColumn("series_id", F.col("user_id") % 100 + 1).withWatermark("ts", delay)


def slot_rollup(events: DataFrame, slot: str = "1 hour") -> DataFrame:
    """Sums of tumbling windows by series."""
    out = events.groupBy(F.window("ts", slot).alias("w"), "series_id").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("value"), F.count("value").alias("n"))
    return out.select("series_id", F.col("w.start").alias("slot_ts"), "value", "n")


def sliding_mean(events: DataFrame, width: str = "1 day", step: str = "6 hours") -> DataFrame:
    out = events.groupBy(F.window("ts", width, step).alias("w"), F.col("event_type").alias("channel")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return out.select("channel", F.col("w.start").alias("start"), "mean", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Bursts of activity by series."""
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "series_id").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "value")


def anomalies(events: DataFrame, medians: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Arriving events against a static table (channel, phase, med): a stream-static join."""
    e = events.withColumn("channel", F.col("event_type")).withColumn("phase", F.hour("ts"))
    return e.join(medians, ["channel", "phase"]).filter((F.col("med") > 0) & (F.col("value") > threshold * F.col("med"))).select("event_id", "channel", "ts", F.round(F.col("value") / F.col("med"), 6).alias("ratio"))


def scored(predictions: DataFrame, truth: DataFrame, bound: str = "1 hour") -> DataFrame:
    """Predictions (event_id, p_ts, y_pred) with the truth that arrives for them within `bound`: a stream-stream join of bounded state."""
    t = truth.select(F.col("event_id").alias("t_id"), "ts", F.col("event_type").alias("channel"), "value")
    near = (F.col("event_id") == F.col("t_id")) & F.expr(f"ts BETWEEN p_ts - INTERVAL {bound} AND p_ts + INTERVAL {bound}")
    return predictions.join(t, near).select("channel", "event_id", (F.col("value") - F.col("y_pred")).alias("error"))


def closed_slots(events: DataFrame, key: str, slot_s: int) -> DataFrame:
    """Sums of slots that the watermark has closed: (key, slot_ts, value), one row each and for good."""
    out = events.groupBy(F.window("ts", f"{slot_s} seconds").alias("w"), F.col(key).cast("string").alias("key")).agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("value"))
    return out.select("key", F.window_time("w").alias("slot_ts"), "value")


def _put(rows: DataFrame, number: int, path: str) -> None:
    """A batch's rows, in place of those that the same batch may have left before."""
    rows.withColumn("batch", F.lit(number)).write.partitionBy("batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def split_late(source: DataFrame, delay_s: int, path: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Rows in time and rows too late, each with its batch: late is what lies `delay_s` seconds or more behind the latest time of all batches before.

    A watermark drops late rows inside a stateful operator and keeps nothing of them; here
    every row lands in one of two tables. Each batch leaves its latest time in a third one,
    so a batch that is run again, or after a restart, is split as before.
    """
    spark = source.sparkSession
    tables = {k: f"{path}/{k}" for k in ("kept", "late", "marks")}

    def split(batch: DataFrame, number: int) -> None:
        known = stores.stored(spark, tables["marks"])
        before = None if known is None else known.filter(F.col("batch") < number).agg(F.max("latest")).first()[0]
        late = F.coalesce(F.unix_micros("ts") <= F.lit(None if before is None else 1000 * (before - 1000 * delay_s)), F.lit(False))
        _put(batch.filter(late), number, tables["late"])
        _put(batch.filter(~late), number, tables["kept"])
        _put(batch.agg(F.max(F.unix_millis("ts")).alias("latest")).filter("latest is not null"), number, tables["marks"])

    source.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    none = spark.createDataFrame([], source.schema).withColumn("batch", F.lit(0))
    kept, late = (stores.stored(spark, tables[k]) for k in ("kept", "late"))
    return none if kept is None else kept, none if late is None else late


def dropped_by_watermark(query) -> int:
    """Rows that a query's stateful operators have dropped as late, by its progress. Spark holds rows against the watermark of the batch before."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def daily_sink(events: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Events by day, each once, whatever is split over batches or sent again; returns the store.

    A batch's days are read back, joined by the new events and written over as whole
    partitions, so a day may come in parts and a batch may be run again. Events are told
    apart by event_id, those without one by all their columns.
    """
    spark = events.sparkSession
    names = events.columns

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("date", F.to_date("ts"))
        have = stores.stored(spark, path)
        if have is not None:
            days = new.select("date").distinct()
            new = new.unionByName(have.join(F.broadcast(days), "date", "left_semi").select(*new.columns))  # a row a day
        once = new.withColumn("_row", F.when(F.col("event_id").isNull(), F.to_json(F.struct(*names)))).dropDuplicates(["date", "event_id", "_row"]).drop("_row")
        staged = f"{path}-staged/{number}"  # what is read can't be written over
        once.write.mode("overwrite").parquet(staged)
        spark.read.schema(once.schema).parquet(staged).repartition("date").write.partitionBy("date").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)

    query = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Everything that has arrived, appended to a Parquet table and read back."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
