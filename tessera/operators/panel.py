"""From raw records to a dense panel (series_id, slot_idx, value, observed), and slices of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import SeriesSpec


def slot_of(ts: Column, spec: SeriesSpec) -> Column:
    """Number of the slot that holds a time (F2)."""
    seconds = F.unix_seconds(ts.cast("timestamp")) - F.unix_seconds(F.lit(spec.origin).cast("timestamp"))
    return F.floor(seconds / spec.slot_s).cast("long")


def slot_start(slot: Column, spec: SeriesSpec) -> Column:
    return F.timestamp_seconds(F.unix_seconds(F.lit(spec.origin).cast("timestamp")) + slot * spec.slot_s)


def day_of(slot: Column, spec: SeriesSpec) -> Column:
    return F.date_add(F.lit(spec.origin).cast("date"), F.floor(slot / spec.season).cast("int"))


def records(events: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Events as raw records: the cell from the user, the channel from the type, the part summed out from the properties."""
    return events.select(
        (F.col("user_id") % spec.cells + 1).alias("series_id"), slot_of(F.col("ts"), spec).alias("slot_idx"), F.col("event_type").alias("channel"),
        "value", F.get_json_object("props", "$.k").alias("country"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
    )


def validate(raw: DataFrame, spec: SeriesSpec) -> tuple[DataFrame, DataFrame]:
    """Records inside the axis and the ids, and the others (S4)."""
    good = F.coalesce(F.col("slot_idx").between(0, spec.n_slots - 1) & F.col("series_id").between(1, spec.cells), F.lit(False))
    return raw.filter(good), raw.filter(~good)


def slot_rollup(raw: DataFrame, key: str = "series_id") -> DataFrame:
    """The sum of each series and slot, missing values as 0, with the number present (S5)."""
    return raw.groupBy(key, "slot_idx").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("value"), F.count("value").alias("n"))


def wide_rollup(raw: DataFrame, spec: SeriesSpec) -> DataFrame:
    """One column a channel, in one pass."""
    return raw.groupBy("series_id", "slot_idx").agg(*[F.sum(F.when(F.col("channel") == c, F.coalesce("value", F.lit(0.0))).otherwise(0.0)).alias(c) for c in spec.channels])


def series_ids(spark: SparkSession, spec: SeriesSpec) -> DataFrame:
    return spark.range(1, spec.cells + 1).withColumnRenamed("id", "series_id")


def dense(rolled: DataFrame, keys: DataFrame, spec: SeriesSpec, key: str = "series_id") -> DataFrame:
    """All series in all slots, 0 where nothing was recorded (S7). The slots are made in each row of keys, so nothing is crossed over a shuffle."""
    spine = keys.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spec.n_slots - 1).cast("long"))).alias("slot_idx"))
    out = spine.join(rolled, [key, "slot_idx"], "left")
    return out.select(key, "slot_idx", F.coalesce("value", F.lit(0.0)).alias("value"), (F.coalesce("n", F.lit(0)) > 0).alias("observed"))


def panel(spark: SparkSession, sf_dir: str, spec: SeriesSpec) -> DataFrame:
    raw, _ = validate(records(spark.read.parquet(f"{sf_dir}/events.parquet"), spec), spec)
    return dense(slot_rollup(raw), series_ids(spark, spec), spec)


def channel_panel(spark: SparkSession, sf_dir: str, spec: SeriesSpec) -> DataFrame:
    """The channels as series: dense, and long enough for models."""
    raw = records(spark.read.parquet(f"{sf_dir}/events.parquet"), spec).filter(F.col("slot_idx").between(0, spec.n_slots - 1))
    keys = spark.createDataFrame([(c,) for c in spec.channels], "channel string")
    return dense(slot_rollup(raw, "channel"), F.broadcast(keys), spec, "channel").withColumnRenamed("channel", "series_id")


def totals(dense_panel: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Total of each series and its place on the grid (S9, F3)."""
    return dense_panel.groupBy("series_id").agg(F.sum("value").alias("total")).withColumn("row", F.floor((F.col("series_id") - 1) / spec.side)).withColumn("col", (F.col("series_id") - 1) % spec.side)


def split_label(slot: Column, spec: SeriesSpec) -> Column:
    a, b, c = spec.bounds
    return F.when(slot < a, "train").when(slot < b, "val").when(slot < c, "eval").otherwise("post")


def is_working(day: Column, spec: SeriesSpec) -> Column:
    return (F.weekday(day) < 5) & ~day.cast("string").isin(*spec.holidays)
