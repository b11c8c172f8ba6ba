"""Streaming twins run over the events table as a stream that ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.shared import shared_path
from ..streaming import keyed as K
from ..streaming import twins as S
from .common import SPEC, Register, rnd

query = Register()
QUERIES, SQL = query.queries, query.sql


def _run(spark, d, make):
    at = shared_path(spark, "stream")
    # glob that matches the table alone: a stream source reads folders
    events = S.read_events(spark, f"{d}/events.parque[t]")
    return S.run_to_end(make(events), f"{at}/out", f"{at}/state")


@query("SELECT series_id, date_trunc('hour', ts) AS slot_ts, round(sum(value), 6) AS value, count(value) AS n FROM r WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM r) - INTERVAL 1 HOUR GROUP BY ALL")
def stream_slot_rollup(spark, d):
    return _run(spark, d, S.slot_rollup).select("series_id", F.col("slot_ts").cast("timestamp_ntz").alias("slot_ts"), rnd("value").alias("value"), "n")


def _naive(*names):
    return [F.col(c).cast("timestamp_ntz").alias(c) for c in names]


@query("SELECT channel, start, round(avg(value), 6) AS mean, count(*) AS n FROM (SELECT channel, value, date_trunc('day', ts) + INTERVAL 1 HOUR * (6 * (hour(ts) // 6 - k)) AS start FROM r, range(0, 4) q(k)) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM r) - INTERVAL 1 HOUR GROUP BY ALL")
def stream_sliding_mean(spark, d):
    return _run(spark, d, S.sliding_mean).select("channel", *_naive("start"), rnd("mean").alias("mean"), "n")


@query(", gp AS (SELECT series_id, ts, value, event_id, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS fresh FROM r WINDOW w AS (PARTITION BY series_id ORDER BY ts, event_id)), ss AS (SELECT series_id, ts, value, sum(fresh::INT) OVER (PARTITION BY series_id ORDER BY ts, event_id) AS k FROM gp), se AS (SELECT series_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n, round(sum(value), 6) AS value FROM ss GROUP BY series_id, k) SELECT * FROM se WHERE stop <= (SELECT max(ts) FROM r) - INTERVAL 1 HOUR")
def stream_sessions(spark, d):
    return _run(spark, d, S.sessions).select("series_id", *_naive("start", "stop"), "n", rnd("value").alias("value"))


@query(", md AS (SELECT channel, hour(ts) AS phase, median(value) AS med FROM r GROUP BY ALL) SELECT event_id, r.channel, ts, round(value / med, 6) AS ratio FROM r JOIN md ON r.channel = md.channel AND hour(ts) = phase WHERE med > 0 AND value > 3 * med")
def stream_anomaly(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    med = e.groupBy(F.col("event_type").alias("channel"), F.hour("ts").alias("phase")).agg(F.median("value").alias("med"))
    return _run(spark, d, lambda s: S.anomalies(s, med)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _files(spark, d, n):
    """The events in n files, which come one after the other: by event_id."""
    at = shared_path(spark, "stream")
    e = spark.read.parquet(f"{d}/events.parquet")
    for part in range(n):
        e.filter(F.col("event_id") % n == part).coalesce(1).write.mode("append").parquet(f"{at}/in")
    return at


_MARK = "(SELECT date_trunc('millisecond', max(ts) FILTER (event_id % 3 < {})) FROM r) - INTERVAL 10 DAY"


@query(f"SELECT event_id, ts, event_id % 3 AS batch, (SELECT count(*) FROM r WHERE event_id % 3 = 2 AND ts <= {_MARK.format(1)}) AS dropped FROM r WHERE event_id % 3 = 1 AND ts <= {_MARK.format(1)} OR event_id % 3 = 2 AND ts <= {_MARK.format(2)}")
def stream_late_data(spark, d):
    """Late rows of the second and third file in quarantine, beside the number that a watermark drops by the query's progress."""
    at = _files(spark, d, 3)
    source = S.read_files(spark, f"{at}/in", files=1)
    kept, late = S.split_late(source, 10 * 86400, f"{at}/out", f"{at}/state")
    once = source.withWatermark("ts", "10 days").dropDuplicatesWithinWatermark(["event_id"])
    query = once.writeStream.format("parquet").option("path", f"{at}/once").option("checkpointLocation", f"{at}/once-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return late.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("batch").cast("long").alias("batch"), F.lit(S.dropped_by_watermark(query)).cast("long").alias("dropped"))


@query("SELECT series_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(sum(value), 4) AS value, count(*) AS n FROM r GROUP BY ALL")
def stream_daily_store(spark, d):
    """Every day comes in two batches; then the same files come again as another stream."""
    at = _files(spark, d, 2)
    for run in ("first", "again"):
        store = S.daily_sink(S.read_files(spark, f"{at}/in", files=1), f"{at}/days", f"{at}/{run}")
    by = (F.col("user_id") % SPEC.cells + 1).alias("series_id")
    return store.groupBy(by, F.col("date").cast("string").alias("day")).agg(rnd(F.sum("value"), 4).alias("value"), F.count("*").alias("n"))


#: the last slot that the watermark has closed at the end
_CLOSED = "(SELECT CAST(floor(epoch(max(ts) - INTERVAL 1 HOUR - TIMESTAMP '2024-01-01') / 3600) AS BIGINT) - 1 FROM r)"


@query(f", x AS (SELECT series_id, slot_idx, value, lag(value, 1) OVER w AS naive, lag(value, 24) OVER w AS seasonal, (lag(value, 24) OVER w + lag(value, 48) OVER w + lag(value, 72) OVER w + lag(value, 96) OVER w) / 4 AS tod FROM e WINDOW w AS (PARTITION BY series_id ORDER BY slot_idx)) SELECT series_id, slot_idx, round(value, 6) AS value, round(naive, 6) AS naive, round(seasonal, 6) AS seasonal, round(tod, 6) AS tod FROM x WHERE slot_idx <= {_CLOSED}")
def stream_online_forecast(spark, d):
    """The channels' forecasts slot by slot equal those made afterwards."""
    out = _run(spark, d, lambda s: K.online_forecast(s, SPEC, "event_type"))
    return out.select("series_id", "slot_idx", *[rnd(c).alias(c) for c in ("value", "naive", "seasonal", "tod")])


@query(f", z AS (SELECT series_id, slot_idx, lag(slot_idx, 1, -1) OVER (PARTITION BY series_id ORDER BY slot_idx) AS last_slot FROM (SELECT series_id, slot_idx FROM g WHERE value <> 0 AND slot_idx <= {_CLOSED})), q AS (SELECT series_id, last_slot, slot_idx FROM z UNION ALL SELECT series_id, max(slot_idx), NULL FROM z GROUP BY series_id) SELECT CAST(series_id AS VARCHAR) AS series_id, last_slot, 'stalled' AS status, last_slot + 25 AS slot_idx FROM q WHERE coalesce(slot_idx, {_CLOSED} + 1) - last_slot - 1 > 24 UNION ALL SELECT CAST(series_id AS VARCHAR), last_slot, 'resumed', slot_idx FROM q WHERE slot_idx - last_slot - 1 > 24")
def stream_stalled(spark, d):
    """Cells without a value for more than a day, as they fall silent and as they come back."""
    return _run(spark, d, lambda s: K.stalled(s, SPEC, SPEC.season))


@query("SELECT channel, round(avg(abs(value - floor(value))), 6) AS mae, round(sqrt(avg((value - floor(value)) ** 2)), 6) AS rmse, count(*) AS n FROM r WHERE value IS NOT NULL GROUP BY channel")
def stream_metrics(spark, d):
    guesses = S.read_events(spark, f"{d}/events.parque[t]").select("event_id", F.col("ts").alias("p_ts"), F.floor("value").alias("y_pred"))
    errors = _run(spark, d, lambda s: S.scored(guesses, s)).filter("error is not null")
    return errors.groupBy("channel").agg(rnd(F.avg(F.abs("error"))).alias("mae"), rnd(F.sqrt(F.avg(F.col("error") ** 2))).alias("rmse"), F.count("*").alias("n"))
