"""Queries over panels and totals: scans, slices, joins, aggregates, windows, rankings, sets."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import spatial as G
from ..operators import stats as S
from .common import SPEC, cell_totals, cells, channels, raw, rnd, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def w_series():
    return Window.partitionBy("series_id").orderBy("slot_idx")


def query(body: str):
    """Registers a function under its name, with the SQL that it must equal."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql(body)
        return f

    return add


# --- sources and panels


@query("SELECT series_id, slot_idx, round(value, 6) AS value, n FROM g")
def slot_rollup(spark: SparkSession, d: str) -> DataFrame:
    return P.slot_rollup(raw(spark, d)).select("series_id", "slot_idx", rnd("value").alias("value"), "n")


@query("SELECT series_id, slot_idx, round(value, 6) AS value, observed FROM p")
def dense_panel(spark, d):
    return cells(spark, d).withColumn("value", rnd("value"))


_SLOT_OK, _CELL_OK = "slot_idx BETWEEN 0 AND 599", "series_id BETWEEN 1 AND 90"


@query(f"SELECT count(*) AS n, count(*) FILTER ({_SLOT_OK} AND {_CELL_OK}) AS n_valid, count(*) FILTER (NOT ({_SLOT_OK} AND {_CELL_OK})) AS n_quarantined, count(*) FILTER (NOT {_SLOT_OK}) AS slot_outside, count(*) FILTER (NOT {_CELL_OK}) AS cell_outside FROM r")
def validate_slots(spark, d):
    """Against an axis of 600 slots and a grid of 90 cells, which the last days and cells lie outside of."""
    spec = replace(SPEC, n_slots=600, cells=90)
    good, bad = P.validate(raw(spark, d), spec)
    both = good.select("slot_idx", "series_id", F.lit(1).alias("g")).union(bad.select("slot_idx", "series_id", F.lit(0)))
    return both.agg(F.count("*").alias("n"), F.sum("g").alias("n_valid"), F.sum(1 - F.col("g")).alias("n_quarantined"), F.count_if(~F.col("slot_idx").between(0, 599)).alias("slot_outside"), F.count_if(~F.col("series_id").between(1, 90)).alias("cell_outside"))


@query("SELECT slot_idx // 24 AS day, count(*) AS observed, 24 * 100 - count(*) AS empty FROM g GROUP BY ALL")
def observed_cells(spark, d):
    return P.slot_rollup(raw(spark, d)).filter("n > 0").groupBy(F.floor(F.col("slot_idx") / 24).alias("day")).agg(F.count("*").alias("observed"), (24 * 100 - F.count("*")).alias("empty"))


@query("SELECT series_id, row, col, round(total, 6) AS total FROM t")
def series_totals(spark, d):
    return cell_totals(spark, d).withColumn("total", rnd("total"))


@query("SELECT slot_idx // 24 AS day, count(*) AS records, count(DISTINCT (series_id, slot_idx)) AS observed, round(count(DISTINCT (series_id, slot_idx)) / (100.0 * CASE WHEN slot_idx // 24 IS NULL THEN 720 ELSE 24 END), 6) AS ratio, round(sum(value), 6) AS total, " + ", ".join(f"round(coalesce(sum(value) FILTER (channel = '{c}'), 0), 4) AS {c}" for c in SPEC.channels) + " FROM r GROUP BY ROLLUP (slot_idx // 24)")
def ingest_stats(spark, d):
    """By day and in all (day null): records, observed pairs and their share of the grid, totals by channel."""
    pairs = SPEC.cells * F.when(F.col("day").isNull(), SPEC.n_slots).otherwise(SPEC.season)
    told = raw(spark, d).withColumn("day", F.floor(F.col("slot_idx") / 24)).rollup("day").agg(F.count("*").alias("records"), F.countDistinct("series_id", "slot_idx").alias("observed"), rnd(F.sum("value")).alias("total"), *[rnd(F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("value"))), F.lit(0.0)), 4).alias(c) for c in SPEC.channels])
    return told.withColumn("ratio", rnd(F.col("observed") / pairs))


@query("SELECT DISTINCT gap FROM (SELECT slot_idx - lag(slot_idx) OVER (PARTITION BY series_id ORDER BY slot_idx) AS gap FROM p) WHERE gap IS NOT NULL")
def axis_check(spark, d):
    return cells(spark, d).select((F.col("slot_idx") - F.lag("slot_idx").over(w_series())).alias("gap")).filter("gap is not null").distinct()


@query("SELECT series_id, slot_idx, c AS channel, round(coalesce(sum(value) FILTER (channel = c), 0), 6) AS value FROM r CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) x(c) GROUP BY ALL")
def channel_panel(spark, d):
    wide = P.wide_rollup(raw(spark, d), SPEC)
    return wide.unpivot(["series_id", "slot_idx"], list(SPEC.channels), "channel", "value").withColumn("value", rnd("value"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value, 6) END AS safe FROM r")
def json_safe(spark, d):
    bad = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("value"))
    return raw(spark, d).select("event_id", bad.alias("v")).select("event_id", F.when(F.isnan("v") | (F.abs("v") == float("inf")), None).otherwise(rnd("v")).alias("safe"))


@query("SELECT round(sum(value), 4) AS full_total, round(sum(value), 4) AS pruned_total, abs(sum(CAST(value AS FLOAT)::DOUBLE) - sum(value)) < 1 AS float_drift_small FROM r")
def rollup_variants(spark, d):
    whole = raw(spark, d).groupBy("series_id", "slot_idx", "channel", "country").agg(F.sum("value").alias("v"), F.sum(F.col("value").cast("float")).alias("f")).agg(F.sum("v").alias("v"), F.sum("f").alias("f"))
    pruned = P.slot_rollup(raw(spark, d)).agg(F.sum("value").alias("p"))
    return whole.join(F.broadcast(pruned)).select(rnd("v", 4).alias("full_total"), rnd("p", 4).alias("pruned_total"), (F.abs(F.col("f") - F.col("v")) < 1).alias("float_drift_small"))


# --- projections and filters


@query("SELECT slot_idx, round(value, 6) AS value FROM p WHERE series_id = 7 AND slot_idx BETWEEN 100 AND 200")
def series_slice(spark, d):
    return cells(spark, d).filter("series_id = 7 and slot_idx between 100 and 200").select("slot_idx", rnd("value").alias("value"))


@query("SELECT * FROM (VALUES (3, 2), (50, 49), (101, NULL)) v(series_id, position)")
def column_lookup(spark, d):
    ids = cells(spark, d).select("series_id").distinct().withColumn("position", (F.col("series_id") - 1).cast("int"))
    wanted = spark.createDataFrame([(3,), (50,), (101,)], "series_id int")
    return wanted.join(ids.withColumn("series_id", F.col("series_id").cast("int")), "series_id", "left")


@query("SELECT CASE WHEN slot_idx < 336 THEN 'train' WHEN slot_idx < 504 THEN 'val' WHEN slot_idx < 672 THEN 'eval' ELSE 'post' END AS split, count(*) AS n, min(slot_idx) AS lo, max(slot_idx) AS hi FROM p GROUP BY ALL")
def split_label(spark, d):
    return cells(spark, d).groupBy(P.split_label(F.col("slot_idx"), SPEC).alias("split")).agg(F.count("*").alias("n"), F.min("slot_idx").alias("lo"), F.max("slot_idx").alias("hi"))


@query("SELECT min(slot_idx) AS lo, max(slot_idx) AS hi, count(*) AS n FROM p WHERE slot_idx >= 504 AND slot_idx < 672")
def eval_window(spark, d):
    return cells(spark, d).filter((F.col("slot_idx") >= SPEC.bounds[1]) & (F.col("slot_idx") < SPEC.bounds[2])).agg(F.min("slot_idx").alias("lo"), F.max("slot_idx").alias("hi"), F.count("*").alias("n"))


@query("SELECT series_id, CAST(DATE '2024-01-01' + CAST(slot_idx // 24 AS INT) AS DATE) AS day, count(*) AS n, count(*) = 24 AS whole FROM p WHERE slot_idx // 24 IN (0, 5) GROUP BY ALL")
def day_block(spark, d):
    return cells(spark, d).withColumn("day", P.day_of(F.col("slot_idx"), SPEC)).filter(F.col("day").cast("string").isin(*SPEC.holidays)).groupBy("series_id", "day").agg(F.count("*").alias("n")).withColumn("whole", F.col("n") == SPEC.season)


@query("SELECT (slot_idx // 24) % 7 < 5 AS weekday, count(*) AS n, round(sum(value), 4) AS total FROM p GROUP BY ALL")
def weekday_filter(spark, d):
    return cells(spark, d).groupBy((F.weekday(P.day_of(F.col("slot_idx"), SPEC)) < 5).alias("weekday")).agg(F.count("*").alias("n"), rnd(F.sum("value"), 4).alias("total"))


@query("SELECT series_id, round(coalesce(sum(value) FILTER (slot_idx % 24 < 8), 0), 6) AS total, count(*) FILTER (slot_idx % 24 < 8 AND value > 0) AS positive FROM p GROUP BY ALL")
def masked_column_stats(spark, d):
    m = F.col("slot_idx") % 24 < 8
    return cells(spark, d).groupBy("series_id").agg(rnd(F.sum(F.when(m, F.col("value")))).alias("total"), F.count_if(m & (F.col("value") > 0)).alias("positive"))


@query("SELECT series_id, round(min(value), 6) AS least, count(*) AS n FROM e WHERE slot_idx BETWEEN 504 AND 671 GROUP BY ALL")
def bounded_window_min(spark, d):
    return channels(spark, d).filter("slot_idx between 504 and 671").groupBy("series_id").agg(rnd(F.min("value")).alias("least"), F.count("*").alias("n"))


@query("SELECT mask, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest(CASE WHEN slot_idx // 24 IN (22, 23) THEN ['whole', 'zoom'] ELSE ['whole', 'rest'] END) AS mask FROM e WHERE slot_idx BETWEEN 504 AND 671) GROUP BY ALL")
def zoom_mask(spark, d):
    zoom = F.floor(F.col("slot_idx") / 24).isin(22, 23)
    masks = F.explode(F.when(zoom, F.array(F.lit("whole"), F.lit("zoom"))).otherwise(F.array(F.lit("whole"), F.lit("rest"))))
    return channels(spark, d).filter("slot_idx between 504 and 671").select("value", masks.alias("mask")).groupBy("mask").agg(F.count("*").alias("n"), rnd(F.sum("value"), 4).alias("total"))


# --- joins


@query("SELECT slot_idx // 24 AS day, (slot_idx // 24) % 7 < 5 AND slot_idx // 24 NOT IN (0, 5) AS working, round(sum(value), 4) AS total FROM p GROUP BY ALL")
def calendar_join(spark, d):
    calendar = spark.range(30).select(F.col("id").alias("day"), P.is_working(F.date_add(F.lit(SPEC.origin).cast("date"), F.col("id").cast("int")), SPEC).alias("working"))
    daily = cells(spark, d).groupBy(F.floor(F.col("slot_idx") / 24).alias("day")).agg(rnd(F.sum("value"), 4).alias("total"))
    return daily.join(F.broadcast(calendar), "day")


@query(", m AS (SELECT series_id, slot_idx % 24 AS phase, median(value) AS med FROM e WHERE slot_idx < 336 GROUP BY ALL) SELECT e.series_id, slot_idx, round(value - med, 6) AS above FROM e JOIN m ON e.series_id = m.series_id AND slot_idx % 24 = phase")
def slot_median_join(spark, d):
    e = channels(spark, d).withColumn("phase", F.col("slot_idx") % 24)
    m = e.filter("slot_idx < 336").groupBy("series_id", "phase").agg(F.median("value").alias("med"))
    return e.join(m, ["series_id", "phase"]).select("series_id", "slot_idx", rnd(F.col("value") - F.col("med")).alias("above"))


@query("SELECT a.series_id AS a, b.series_id AS b, count(*) AS n, round(sum(a.value * b.value), 4) AS dot FROM e a JOIN e b ON a.slot_idx = b.slot_idx AND a.series_id < b.series_id GROUP BY ALL")
def pair_join(spark, d):
    e = channels(spark, d).select("slot_idx", "series_id", "value")
    a, b = e.toDF("slot_idx", "a", "va"), e.toDF("slot_idx", "b", "vb")
    return a.join(b, "slot_idx").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), rnd(F.sum(F.col("va") * F.col("vb")), 4).alias("dot"))


@query("SELECT a.series_id AS a, b.series_id AS b, corr(a.value, b.value).round(6) AS r FROM e a JOIN e b ON a.slot_idx = b.slot_idx AND a.series_id < b.series_id GROUP BY ALL")
def pairwise_corr(spark, d):
    e = channels(spark, d).select("slot_idx", "series_id", "value")
    a, b = e.toDF("slot_idx", "a", "va"), e.toDF("slot_idx", "b", "vb")
    return a.join(b, "slot_idx").filter("a < b").groupBy("a", "b").agg(rnd(F.corr("va", "vb")).alias("r"))


@query("SELECT t.series_id, row, col, round(total, 4) AS total FROM t WHERE series_id IN (51, 7, 7, 88)")
def lookup_totals(spark, d):
    return cell_totals(spark, d).join(spark.createDataFrame([(51,), (7,), (88,), (500,)], "series_id long"), "series_id", "left_semi").withColumn("total", rnd("total", 4))


# --- aggregates


@query("SELECT slot_idx, round(value, 4) AS value FROM gt")
def grid_totals(spark, d):
    return cells(spark, d).groupBy("slot_idx").agg(rnd(F.sum("value"), 4).alias("value"))


def _acct(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").filter("c_acctbal >= 0").select("c_custkey", F.col("c_acctbal").alias("v"))


@query(", k AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rank FROM customer WHERE c_acctbal >= 0) SELECT round(2 * sum(rank * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*), 6) AS gini FROM k")
def gini(spark, d):
    return S.prefix_sums(_acct(spark, d), ["v", "c_custkey"], "v").agg(rnd(S.gini("v")).alias("gini"))


@query(", k AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rank, count(*) OVER () AS n, sum(c_acctbal) OVER () AS s FROM customer WHERE c_acctbal >= 0), l AS (SELECT rank, n, v, sum(v) OVER (ORDER BY rank) / s AS y FROM k) SELECT round(1 - sum((y + y - v / (SELECT sum(v) FROM k)) / n), 6) AS gini FROM l")
def gini_lorenz(spark, d):
    p = S.prefix_sums(_acct(spark, d), ["v", "c_custkey"], "v")
    one = p.agg(F.sum(2 * F.col("running") - F.col("v")).alias("a"), F.sum("v").alias("s"), F.count("*").alias("n"))
    return one.select(rnd(1 - F.try_divide(F.col("a"), F.col("s") * F.col("n"))).alias("gini"))


@query(", k AS (SELECT c_custkey, c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rank FROM customer WHERE c_acctbal >= 0) SELECT rank AS cells, round(rank / (SELECT count(*) FROM k), 6) AS x, round(sum(v) OVER (ORDER BY rank) / (SELECT sum(v) FROM k), 6) AS y FROM k UNION ALL SELECT 0, 0.0, 0.0")
def lorenz_curve(spark, d):
    p = S.prefix_sums(_acct(spark, d), ["v", "c_custkey"], "v")
    whole = F.broadcast(p.agg(F.sum("v").alias("s"), F.count("*").alias("n")))
    return p.join(whole).select(F.col("rank").cast("long").alias("cells"), rnd(F.col("rank") / F.col("n")).alias("x"), rnd(F.try_divide("running", "s")).alias("y")).union(spark.sql("SELECT 0L, 0D, 0D"))


@query(", k AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank, count(*) OVER () AS n FROM customer WHERE c_acctbal >= 0) SELECT round(sum(v) FILTER (rank <= greatest(1, round_even(n * 0.01, 0))) / sum(v), 6) AS share FROM k")
def top_share(spark, d):
    p = S.prefix_sums(_acct(spark, d), ["-v", "c_custkey"], "v")
    n = F.broadcast(_acct(spark, d).agg(F.greatest(F.lit(1), F.bround(F.count("*") * 0.01)).alias("k")))
    return p.join(n).agg(rnd(F.sum(F.when(F.col("rank") <= F.col("k"), F.col("v"))) / F.nullif(F.sum("v"), F.lit(0.0))).alias("share"))


@query(", k AS (SELECT sum(c_acctbal) OVER (ORDER BY c_acctbal DESC, c_custkey) AS run, sum(c_acctbal) OVER () AS s FROM customer WHERE c_acctbal >= 0) SELECT count(*) FILTER (run < 0.5 * s) + 1 AS n FROM k")
def cells_to_share(spark, d):
    p = S.prefix_sums(_acct(spark, d), ["-v", "c_custkey"], "v")
    s = F.broadcast(_acct(spark, d).agg(F.sum("v").alias("s")))
    return p.join(s).agg((F.count_if(F.col("running") < 0.5 * F.col("s")) + 1).alias("n"))


@query(", x AS (SELECT log10(c_acctbal) AS v FROM customer WHERE c_acctbal > 0), m AS (SELECT avg(v) AS a FROM x) SELECT round(avg(power(v - a, 3)) / power(avg(power(v - a, 2)), 1.5), 6) AS skew FROM x, m")
def skewness_log10(spark, d):
    return _acct(spark, d).filter("v > 0").agg(rnd(F.skewness(F.log10("v"))).alias("skew"))


@query(", k AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS down, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS up, sum(c_acctbal) OVER (ORDER BY c_acctbal DESC, c_custkey) AS run, count(*) OVER () AS n, sum(c_acctbal) OVER () AS s FROM customer WHERE c_acctbal >= 0), x AS (SELECT log10(v) AS u FROM k WHERE v > 0), m AS (SELECT avg(power(u - a, 3)) / nullif(power(avg(power(u - a, 2)), 1.5), 0) AS skew FROM x, (SELECT avg(u) AS a FROM x)) SELECT count(*) AS n, min(v) AS least, max(v) AS most, median(v) AS middle, round(sum(v), 4) AS total, round(log10(max(v) / nullif(median(v), 0)), 6) AS decades_above, round(log10(median(v) / nullif(min(v), 0)), 6) AS decades_below, round(100 * sum(v) FILTER (down <= greatest(1, round_even(n * 0.01, 0))) / nullif(sum(v), 0), 6) AS top_percent, round(2 * sum(up * v) / nullif(count(*) * sum(v), 0) - (count(*) + 1) / count(*), 6) AS gini, count(*) FILTER (run < 0.5 * s) + 1 AS half, round(100.0 * (count(*) FILTER (run < 0.5 * s) + 1) / count(*), 6) AS half_percent, round((SELECT skew FROM m), 6) AS skew FROM k")
def concentration_stats(spark, d):
    """Spread in decades, top 1 %, Gini, how many make half, and the skewness of the logarithm, from one global order."""
    p = S.prefix_sums(_acct(spark, d), ["-v", "c_custkey"], "v")
    whole = F.broadcast(_acct(spark, d).agg(F.count("*").alias("n"), F.sum("v").alias("s")))
    x = p.join(whole)
    up = F.col("n") + 1 - F.col("rank")  # equal values may change places: the sum stays
    top = F.sum(F.when(F.col("rank") <= F.greatest(F.lit(1), F.bround(F.col("n") * 0.01)), F.col("v")))
    ratio = lambda a, b: rnd(F.log10(F.try_divide(a, b)))
    return x.agg(
        F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.median("v").alias("middle"), rnd(F.sum("v"), 4).alias("total"),
        ratio(F.max("v"), F.median("v")).alias("decades_above"), ratio(F.median("v"), F.min("v")).alias("decades_below"), rnd(100 * F.try_divide(top, F.sum("v"))).alias("top_percent"),
        rnd(F.try_divide(2 * F.sum(up * F.col("v")), F.count("*") * F.sum("v")) - (F.count("*") + 1) / F.count("*")).alias("gini"), (F.count_if(F.col("running") < 0.5 * F.col("s")) + 1).alias("half"),
        rnd(100 * (F.count_if(F.col("running") < 0.5 * F.col("s")) + 1) / F.count("*")).alias("half_percent"), rnd(F.skewness(F.when(F.col("v") > 0, F.log10("v")))).alias("skew"),
    )


_WEEK = "SELECT series_id, slot_idx // 168 AS week, avg(value) AS mean, count(*) AS n_slots, count(DISTINCT slot_idx // 24) AS n_days FROM e WHERE (slot_idx // 24) % 7 < 5 GROUP BY ALL"


def _weeks(spark, d):
    e = channels(spark, d).withColumn("day", P.day_of(F.col("slot_idx"), SPEC)).filter(F.weekday("day") < 5)
    return e.groupBy("series_id", F.date_trunc("week", "day").cast("date").alias("monday")).agg(F.avg("value").alias("mean"), F.count("*").alias("n_slots"), F.countDistinct("day").alias("n_days"))


@query(f"SELECT series_id, CAST(DATE '2024-01-01' + CAST(7 * week AS INT) AS DATE) AS monday, round(mean, 6) AS mean, n_slots, n_days FROM ({_WEEK})")
def weekly_weekday_means(spark, d):
    return _weeks(spark, d).withColumn("mean", rnd("mean"))


@query(f"SELECT week + 1 AS iso_week, {", ".join(f"round(max(mean) FILTER (series_id = '{c}'), 6) AS {c}" for c in SPEC.channels)} FROM ({_WEEK}) WHERE n_days = 5 GROUP BY ALL")
def weekday_means_full_weeks(spark, d):
    full = _weeks(spark, d).filter("n_days = 5").withColumn("iso_week", F.weekofyear("monday").cast("long"))
    return full.groupBy("iso_week").pivot("series_id", list(SPEC.channels)).agg(rnd(F.max("mean")))


@query(f"SELECT a.series_id, a.week, round(a.mean / nullif(b.mean, 0), 6) AS rel, round(100 * (a.mean / nullif(b.mean, 0) - 1), 4) AS change FROM ({_WEEK}) a JOIN ({_WEEK}) b ON a.series_id = b.series_id AND b.week = 0")
def weekly_index(spark, d):
    w = _weeks(spark, d).withColumn("week", F.floor(F.datediff("monday", F.lit(SPEC.origin).cast("date")) / 7))
    base = w.filter("week = 0").select("series_id", F.col("mean").alias("base"))
    return w.join(F.broadcast(base), "series_id").select("series_id", "week", rnd(F.try_divide("mean", "base")).alias("rel"), rnd(100 * (F.try_divide("mean", "base") - 1), 4).alias("change"))


@query(f"SELECT series_id, week, round(100 * (mean / nullif(base, 0) - 1), 4) AS drift FROM ({_WEEK}) JOIN (SELECT series_id, avg(mean) AS base FROM ({_WEEK}) WHERE week < 2 GROUP BY ALL) USING (series_id) WHERE week >= 2")
def weekly_drift(spark, d):
    w = _weeks(spark, d).withColumn("week", F.floor(F.datediff("monday", F.lit(SPEC.origin).cast("date")) / 7))
    base = w.filter("week < 2").groupBy("series_id").agg(F.avg("mean").alias("base"))
    return w.filter("week >= 2").join(base, "series_id").select("series_id", "week", rnd(100 * (F.try_divide("mean", "base") - 1), 4).alias("drift"))


@query("SELECT coalesce(series_id, 'grid') AS series_id, round(100 * (avg(value) FILTER (slot_idx // 168 = 3) / nullif(avg(value) FILTER (slot_idx // 168 = 1), 0) - 1), 4) AS change FROM e WHERE (slot_idx // 24) % 7 < 5 GROUP BY GROUPING SETS ((series_id), ())")
def weekday_drift(spark, d):
    w, day = F.floor(F.col("slot_idx") / 168), P.day_of(F.col("slot_idx"), SPEC)
    return channels(spark, d).filter(F.weekday(day) < 5).rollup("series_id").agg(rnd(100 * (F.try_divide(F.avg(F.when(w == 3, F.col("value"))), F.avg(F.when(w == 1, F.col("value")))) - 1), 4).alias("change")).withColumn("series_id", F.coalesce("series_id", F.lit("grid")))


@query("SELECT series_id, round(sum(value), 4) AS total FROM e WHERE slot_idx // 24 IN (1, 2) GROUP BY GROUPING SETS ((series_id), ())")
def day_block_total(spark, d):
    return channels(spark, d).filter(F.floor(F.col("slot_idx") / 24).isin(1, 2)).rollup("series_id").agg(rnd(F.sum("value"), 4).alias("total"))


@query("SELECT series_id, round(100 * (1 - sum(value) FILTER (slot_idx // 24 = 0) / nullif(sum(value) FILTER (slot_idx // 24 = 7), 0)), 4) AS drop_percent FROM e GROUP BY ALL")
def holiday_drop(spark, d):
    s = lambda k: F.sum(F.when(F.floor(F.col("slot_idx") / 24) == k, F.col("value")))
    return channels(spark, d).groupBy("series_id").agg(rnd(100 * (1 - F.try_divide(s(0), s(7))), 4).alias("drop_percent"))


@query("SELECT series_id, round(avg(value) FILTER ((slot_idx // 24) % 7 < 5) / nullif(avg(value) FILTER ((slot_idx // 24) % 7 >= 5), 0), 6) AS ratio FROM e GROUP BY ALL")
def weekday_weekend_ratio(spark, d):
    week = F.weekday(P.day_of(F.col("slot_idx"), SPEC)) < 5
    return channels(spark, d).groupBy("series_id").agg(rnd(F.try_divide(F.avg(F.when(week, F.col("value"))), F.avg(F.when(~week, F.col("value"))))).alias("ratio"))


_SHAPE = ", fd AS (SELECT series_id, slot_idx % 24 AS slot, value, value / nullif(avg(value) OVER (PARTITION BY series_id, slot_idx // 24), 0) AS v FROM e WHERE slot_idx < 336), ms AS (SELECT series_id, slot, avg(value) AS a, avg(v) AS b FROM fd GROUP BY ALL), cr AS (SELECT x.series_id, round(corr(x.a, y.a), 6) AS r_raw, round(corr(x.b, y.b), 6) AS r_relative FROM ms x JOIN ms y ON x.slot = y.slot AND y.series_id = 'view' GROUP BY ALL)"


@query(f"{_SHAPE} SELECT series_id, round(avg(value) FILTER ((slot_idx // 24) % 7 < 5), 6) AS weekday_mean, round(avg(value) FILTER ((slot_idx // 24) % 7 >= 5), 6) AS weekend_mean, round(avg(value) FILTER ((slot_idx // 24) % 7 >= 5) / nullif(avg(value) FILTER ((slot_idx // 24) % 7 < 5), 0), 6) AS ratio, r_raw, r_relative FROM e JOIN cr USING (series_id) WHERE slot_idx < 336 GROUP BY ALL")
def regime_levels(spark, d):
    """Levels of the first fortnight, and how near each mean daily profile is to the channel view's: as it is, and with each day divided by its own mean."""
    e = channels(spark, d).filter("slot_idx < 336")
    week = F.weekday(P.day_of(F.col("slot_idx"), SPEC)) < 5
    levels = e.groupBy("series_id").agg(rnd(F.avg(F.when(week, F.col("value")))).alias("weekday_mean"), rnd(F.avg(F.when(~week, F.col("value")))).alias("weekend_mean"), rnd(F.try_divide(F.avg(F.when(~week, F.col("value"))), F.avg(F.when(week, F.col("value"))))).alias("ratio"))
    day = F.avg("value").over(Window.partitionBy("series_id", F.floor(F.col("slot_idx") / 24)))
    shape = e.select("series_id", (F.col("slot_idx") % 24).alias("slot"), "value", F.try_divide("value", day).alias("v")).groupBy("series_id", "slot").agg(F.avg("value").alias("a"), F.avg("v").alias("b"))
    ref = F.broadcast(shape.filter("series_id = 'view'").select("slot", F.col("a").alias("ra"), F.col("b").alias("rb")))  # a season's slots
    near = shape.join(ref, "slot").groupBy("series_id").agg(rnd(F.corr("a", "ra")).alias("r_raw"), rnd(F.corr("b", "rb")).alias("r_relative"))
    return levels.join(near, "series_id")


_ZERO = "SELECT series_id, count(*) FILTER (value = 0) AS zeros, coalesce(max(slot_idx) FILTER (value <> 0), -1) AS last_row FROM p GROUP BY ALL"


def _zero(spark, d):
    return cells(spark, d).groupBy("series_id").agg(F.count_if(F.col("value") == 0).alias("zeros"), F.coalesce(F.max(F.when(F.col("value") != 0, F.col("slot_idx"))), F.lit(-1)).alias("last_row"))


@query(f"SELECT sum(zeros)::BIGINT AS zeros, count(*) * 720 AS pairs, round(100 * sum(zeros) / (count(*) * 720), 6) AS percent, count(*) FILTER (zeros > 0) AS cells FROM ({_ZERO})")
def zero_scan(spark, d):
    return _zero(spark, d).agg(F.sum("zeros").alias("zeros"), (F.count("*") * 720).alias("pairs"), rnd(100 * F.sum("zeros") / (F.count("*") * 720)).alias("percent"), F.count_if(F.col("zeros") > 0).alias("cells"))


@query(f"SELECT series_id, last_row, CASE WHEN last_row < 0 THEN 'never' ELSE strftime(TIMESTAMP '2024-01-01' + last_row * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') END AS last_seen FROM ({_ZERO}) WHERE last_row < 719 - 12")
def stalled_cells(spark, d):
    seen = F.when(F.col("last_row") < 0, "never").otherwise(F.date_format(P.slot_start(F.col("last_row"), SPEC), "yyyy-MM-dd HH:mm"))
    return _zero(spark, d).filter(F.col("last_row") < 719 - 12).select("series_id", "last_row", seen.alias("last_seen"))


@query("SELECT row // 2 AS band, round(sum(total) / nullif((SELECT sum(total) FROM t), 0), 6) AS share, round(45.356261 + (row // 2) * 2 / 10 * (45.568161 - 45.356261), 6) AS lat_from, round(45.356261 + (row // 2 + 1) * 2 / 10 * (45.568161 - 45.356261), 6) AS lat_to FROM t GROUP BY ALL")
def row_band_mass(spark, d):
    b = G.row_bands(cell_totals(spark, d), 2, SPEC)
    return b.select("band", rnd("share").alias("share"), rnd("lat_from").alias("lat_from"), rnd("lat_to").alias("lat_to"))


@query("SELECT round(sum(row * total) / nullif(sum(total), 0), 6) AS mean_row FROM t")
def mass_weighted_mean_row(spark, d):
    return cell_totals(spark, d).agg(rnd(F.try_divide(F.sum(F.col("row") * F.col("total")), F.sum("total"))).alias("mean_row"))


@query(", x AS (SELECT log10(c_acctbal) AS v FROM customer WHERE c_acctbal > 0), b AS (SELECT min(v) AS lo, (max(v) - min(v)) / 60 AS w FROM x), k AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank, count(*) OVER () AS n FROM customer WHERE c_acctbal >= 0), m AS (SELECT round(median(v), 4) AS middle, round(max(v) FILTER (rank = greatest(1, round_even(n * 0.01, 0))), 4) AS cut FROM k) SELECT least(59, floor((v - lo) / w))::BIGINT AS bin, count(*) AS n, middle, cut FROM x, b, m GROUP BY ALL")
def log_histogram(spark, d):
    """Bins of the logarithm, with the median and the value at which the top hundredth begins."""
    x = _acct(spark, d).filter("v > 0").select(F.log10("v").alias("v"))
    b = F.broadcast(x.agg(F.min("v").alias("lo"), ((F.max("v") - F.min("v")) / 60).alias("w")))
    p = S.prefix_sums(_acct(spark, d), ["-v", "c_custkey"], "v")
    n = F.broadcast(_acct(spark, d).agg(F.greatest(F.lit(1), F.bround(F.count("*") * 0.01)).alias("top")))
    marks = F.broadcast(p.join(n).agg(rnd(F.median("v"), 4).alias("middle"), rnd(F.max(F.when(F.col("rank") == F.col("top"), F.col("v"))), 4).alias("cut")))
    return x.join(b).groupBy(F.least(F.lit(59), F.floor((F.col("v") - F.col("lo")) / F.col("w"))).cast("long").alias("bin")).agg(F.count("*").alias("n")).join(marks)


STUDY = (7, 51, 88)


@query(", h AS (SELECT max(row) AS r1, min(row) AS r0, max(col) AS c1, min(col) AS c0 FROM t WHERE series_id IN (7, 51, 88)), z AS (SELECT greatest(0, floor((r1 + r0) / 2 - half)) AS zr0, least(9, ceil((r1 + r0) / 2 + half)) AS zr1, greatest(0, floor((c1 + c0) / 2 - half)) AS zc0, least(9, ceil((c1 + c0) / 2 + half)) AS zc1 FROM (SELECT *, greatest(r1 - r0, c1 - c0) / 2 - 2 AS half FROM h)) SELECT row, col, round(ln(1 + total), 6) AS level, row BETWEEN zr0 AND zr1 AND col BETWEEN zc0 AND zc1 AS zoomed FROM t, z")
def log_grid(spark, d):
    """Each cell's logarithm, and whether it lies in a square box about the study cells, drawn in by two cells."""
    t = cell_totals(spark, d)
    return t.join(G.zoom_box(t.filter(F.col("series_id").isin(*STUDY)), -2, SPEC)).select("row", "col", rnd(F.log1p("total")).alias("level"), (F.col("row").between(F.col("row_from"), F.col("row_to")) & F.col("col").between(F.col("col_from"), F.col("col_to"))).alias("zoomed"))


@query(", s AS (SELECT slot_idx // 24 AS day, count(*) AS n FROM r GROUP BY ALL) SELECT sum(n)::BIGINT AS records, count(*) AS days, max(n) AS most, min(n) AS least, arg_max(day, (n, -day)) AS most_day, arg_min(day, (n, day)) AS least_day, round(sum(n) / count(*), 4) AS per_day, round(100 * 720 * 4 / 1e6, 4) AS dense_mb FROM s")
def manifest_summary(spark, d):
    """The run's records by day, and what the dense matrix takes in single precision."""
    s = raw(spark, d).groupBy(F.floor(F.col("slot_idx") / 24).alias("day")).agg(F.count("*").alias("n"))
    return s.agg(
        F.sum("n").alias("records"), F.count("*").alias("days"), F.max("n").alias("most"), F.min("n").alias("least"), F.max_by("day", F.struct("n", -F.col("day"))).alias("most_day"), F.min_by("day", F.struct("n", "day")).alias("least_day"),
        rnd(F.sum("n") / F.count("*"), 4).alias("per_day"), F.lit(round(SPEC.cells * SPEC.n_slots * 4 / 1e6, 4)).alias("dense_mb"))


# --- windows

_ROLL = "SELECT series_id, slot_idx, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM e WINDOW w AS (PARTITION BY series_id ORDER BY slot_idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"


def _rolled(spark, d):
    w = w_series().rowsBetween(-23, 0)
    e = channels(spark, d).withColumn("l", F.log1p("value"))
    return e.select("series_id", "slot_idx", *[f(c).over(w).alias(n) for c, f, n in (("value", F.avg, "m"), ("value", F.stddev_samp, "s"), ("l", F.avg, "ml"), ("l", F.stddev_samp, "sl"))]).filter("slot_idx >= 23")


@query(f"SELECT series_id, slot_idx, round(m, 6) AS m, round(s, 6) AS s FROM ({_ROLL}) WHERE slot_idx >= 23")
def rolling_mean_std(spark, d):
    return _rolled(spark, d).select("series_id", "slot_idx", rnd("m").alias("m"), rnd("s").alias("s"))


_ROLL_LOG = _ROLL.replace("avg(value)", "avg(ln(1 + value))").replace("stddev_samp(value)", "stddev_samp(ln(1 + value))")


@query(f"SELECT a.series_id, a.r, b.r AS r_log FROM (SELECT series_id, round(corr(m, s), 6) AS r FROM ({_ROLL}) WHERE slot_idx >= 23 GROUP BY ALL) a JOIN (SELECT series_id, round(corr(m, s), 6) AS r FROM ({_ROLL_LOG}) WHERE slot_idx >= 23 GROUP BY ALL) b USING (series_id)")
def rolling_corr(spark, d):
    return _rolled(spark, d).groupBy("series_id").agg(rnd(F.corr("m", "s")).alias("r"), rnd(F.corr("ml", "sl")).alias("r_log"))


@query("SELECT series_id, total_rank, round(total / nullif(med, 0), 6) AS multiple FROM (SELECT series_id, total, rank() OVER (ORDER BY total DESC) AS total_rank, (SELECT median(total) FROM t) AS med FROM (SELECT series_id, round(total, 4) AS total FROM t))")
def rank_table(spark, d):
    t = cell_totals(spark, d).withColumn("total", rnd("total", 4))
    med = F.broadcast(cell_totals(spark, d).agg(F.median("total").alias("med")))
    return S.competition_rank(t, "total").join(med).select("series_id", F.col("competition_rank").alias("total_rank"), rnd(F.try_divide("total", "med")).alias("multiple"))


@query("SELECT series_id, slot_idx, round(lag(value, 1) OVER w, 6) AS lag1, round(lag(value, 24) OVER w, 6) AS lag24 FROM e WINDOW w AS (PARTITION BY series_id ORDER BY slot_idx) QUALIFY slot_idx >= 24")
def lag_features(spark, d):
    return channels(spark, d).select("series_id", "slot_idx", rnd(F.lag("value", 1).over(w_series())).alias("lag1"), rnd(F.lag("value", 24).over(w_series())).alias("lag24")).filter("slot_idx >= 24")


@query("SELECT series_id, slot_idx, round(value - lag(value) OVER (PARTITION BY series_id ORDER BY slot_idx), 6) AS diff FROM e")
def first_difference(spark, d):
    return channels(spark, d).select("series_id", "slot_idx", rnd(F.col("value") - F.lag("value").over(w_series())).alias("diff"))


_VARIANT = ", x AS (SELECT series_id, slot_idx, value, value - lag(value) OVER w AS d1, value - lag(value, 24) OVER w AS ds FROM e WINDOW w AS (PARTITION BY series_id ORDER BY slot_idx)), v AS (SELECT series_id, slot_idx, 'raw' AS variant, value AS v FROM x UNION ALL SELECT series_id, slot_idx, 'log1p', ln(1 + value) FROM x UNION ALL SELECT series_id, slot_idx, 'diff1', d1 FROM x UNION ALL SELECT series_id, slot_idx, 'sdiff', ds FROM x)"


def variants(e):
    """Raw, log1p, first and seasonal difference of each series (W9)."""
    all_ = F.array(*[F.struct(F.lit(n).alias("variant"), c.alias("v")) for n, c in (("raw", F.col("value")), ("log1p", F.log1p("value")), ("diff1", F.col("value") - F.lag("value").over(w_series())), ("sdiff", F.col("value") - F.lag("value", SPEC.season).over(w_series())))])
    return e.withColumn("x", all_).select("series_id", "slot_idx", F.explode("x").alias("x")).select("series_id", "slot_idx", "x.variant", "x.v").filter("v is not null")


@query(f"{_VARIANT} SELECT series_id, variant, count(v) AS n, round(sum(v), 4) AS total FROM v GROUP BY ALL")
def seasonal_difference(spark, d):
    return variants(channels(spark, d)).groupBy("series_id", "variant").agg(F.count("v").alias("n"), rnd(F.sum("v"), 4).alias("total"))


@query("SELECT slot_idx, round(rise, 4) AS rise FROM (SELECT slot_idx, value - lag(value) OVER (ORDER BY slot_idx) AS rise FROM gt WHERE slot_idx < 336) WHERE rise IS NOT NULL ORDER BY rise DESC, slot_idx LIMIT 2")
def step_rises(spark, d):
    g = cells(spark, d).filter("slot_idx < 336").groupBy("slot_idx").agg(F.sum("value").alias("value"))
    before = g.select((F.col("slot_idx") + 1).alias("slot_idx"), F.col("value").alias("before"))
    return g.join(before, "slot_idx").select("slot_idx", rnd(F.col("value") - F.col("before"), 4).alias("rise")).orderBy(F.desc("rise"), "slot_idx").limit(2)


@query("SELECT round(sum(before), 4) AS before, round(sum(value), 4) AS at, round(sum(after), 4) AS after, round(100 * avg((value > before)::INT), 4) AS rising, round(sum(value) / nullif((sum(before) + sum(after)) / 2, 0), 6) AS ratio, round(100 * avg(((before + after) > 0 AND value > 0.75 * (before + after))::INT), 4) AS far_above, round(sum(value) - (sum(before) + sum(after)) / 2, 4) AS excess, round(100 * (sum(before) - sum(after)) / nullif(sum(value) - (sum(before) + sum(after)) / 2, 0), 4) AS given_back FROM (SELECT slot_idx, value, lag(value) OVER w AS before, lead(value) OVER w AS after FROM p WINDOW w AS (PARTITION BY series_id ORDER BY slot_idx)) WHERE slot_idx = 300")
def spike_profile(spark, d):
    """One slot against its neighbours: totals, cells that rise or stand half again above them, the excess, and what of it the next slot gives back."""
    x = cells(spark, d).filter("slot_idx between 299 and 301").groupBy("series_id").agg(*[F.sum(F.when(F.col("slot_idx") == k, F.col("value"))).alias(n) for k, n in ((299, "b"), (300, "v"), (301, "a"))])
    both = F.col("b") + F.col("a")
    excess = F.sum("v") - F.sum(both) / 2
    return x.agg(
        rnd(F.sum("b"), 4).alias("before"), rnd(F.sum("v"), 4).alias("at"), rnd(F.sum("a"), 4).alias("after"), rnd(100 * F.avg((F.col("v") > F.col("b")).cast("int")), 4).alias("rising"), rnd(F.try_divide(F.sum("v"), F.sum(both) / 2)).alias("ratio"),
        rnd(100 * F.avg(((both > 0) & (F.col("v") > 0.75 * both)).cast("int")), 4).alias("far_above"), rnd(excess, 4).alias("excess"), rnd(100 * F.try_divide(F.sum("b") - F.sum("a"), excess), 4).alias("given_back"))


@query(", nb AS (SELECT slot_idx, value, lag(value) OVER w AS before, lead(value) OVER w AS after FROM gt WINDOW w AS (ORDER BY slot_idx)) SELECT a.slot_idx, round(a.value, 4) AS value, round(b.value, 4) AS week_ago, round(a.value / nullif(b.value, 0), 6) AS ratio, round(a.value / nullif((a.before + a.after) / 2, 0), 6) AS over_neighbours, round(100 * (a.after / nullif(a.before, 0) - 1), 4) AS dip FROM nb a JOIN gt b ON b.slot_idx = a.slot_idx - 168 WHERE a.slot_idx BETWEEN 297 AND 303")
def spike_halo(spark, d):
    """Slots about one, beside those of a week ago; each one over its neighbours, and the dip behind it."""
    g = cells(spark, d).groupBy("slot_idx").agg(F.sum("value").alias("value"))
    moved = lambda k, name: g.select((F.col("slot_idx") + k).alias("slot_idx"), F.col("value").alias(name))
    x = g.filter("slot_idx between 297 and 303").join(moved(168, "old"), "slot_idx").join(moved(1, "before"), "slot_idx", "left").join(moved(-1, "after"), "slot_idx", "left")
    return x.select("slot_idx", rnd("value", 4).alias("value"), rnd("old", 4).alias("week_ago"), rnd(F.try_divide("value", "old")).alias("ratio"), rnd(F.try_divide(F.col("value"), (F.col("before") + F.col("after")) / 2)).alias("over_neighbours"), rnd(100 * (F.try_divide("after", "before") - 1), 4).alias("dip"))


@query("SELECT series_id, slot_idx, round(sum(value - m) OVER (PARTITION BY series_id ORDER BY slot_idx), 6) AS partial FROM (SELECT *, avg(value) OVER (PARTITION BY series_id) AS m FROM e)")
def cumulative_residual(spark, d):
    x = channels(spark, d).withColumn("e", F.col("value") - F.avg("value").over(Window.partitionBy("series_id")))
    return x.select("series_id", "slot_idx", rnd(F.sum("e").over(w_series().rowsBetween(Window.unboundedPreceding, 0))).alias("partial"))


_TREND = ", tr AS (SELECT series_id, slot_idx, value, CASE WHEN slot_idx BETWEEN 12 AND 707 THEN (sum(value) OVER (PARTITION BY series_id ORDER BY slot_idx ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING) + 0.5 * (lag(value, 12) OVER w + lead(value, 12) OVER w)) / 24 END AS trend FROM e WINDOW w AS (PARTITION BY series_id ORDER BY slot_idx))"


@query(f"{_TREND} SELECT series_id, slot_idx, round(trend, 6) AS trend FROM tr")
def centred_moving_average(spark, d):
    return channels(spark, d).select("series_id", "slot_idx", rnd(S.centred_average("value", 24, w_series())).alias("trend"))


_PROFILE = ", pr AS (SELECT series_id, slot_idx // 24 AS day, slot_idx % 24 AS slot, value / nullif(avg(value) OVER (PARTITION BY series_id, slot_idx // 24), 0) AS v FROM e)"


def _profiles(spark, d):
    e = channels(spark, d).withColumn("day", F.floor(F.col("slot_idx") / 24)).withColumn("slot", F.col("slot_idx") % 24)
    return e.select("series_id", "day", "slot", F.try_divide("value", F.avg("value").over(Window.partitionBy("series_id", "day"))).alias("v"))


@query(f"{_PROFILE} SELECT series_id, day, slot, round(v, 6) AS v FROM pr")
def daily_profiles(spark, d):
    return _profiles(spark, d).withColumn("v", rnd("v"))


@query(f"{_PROFILE} SELECT series_id, round(avg(r), 6) AS r FROM (SELECT a.series_id, a.day, corr(a.v, b.v) AS r FROM pr a JOIN pr b ON a.series_id = b.series_id AND a.slot = b.slot AND b.day = a.day + 1 GROUP BY ALL) GROUP BY ALL")
def day_lag_profile(spark, d):
    p = _profiles(spark, d)
    after = p.select("series_id", "slot", (F.col("day") - 1).alias("day"), F.col("v").alias("next"))
    return p.join(after, ["series_id", "slot", "day"]).groupBy("series_id", "day").agg(F.corr("v", "next").alias("r")).groupBy("series_id").agg(rnd(F.avg("r")).alias("r"))


@query(f"{_PROFILE}, w AS (SELECT *, day % 7 < 5 AND day NOT IN (0, 5) AS working FROM pr), m AS (SELECT series_id, slot, avg(v) FILTER (working) AS a, avg(v) FILTER (NOT working) AS b FROM w GROUP BY ALL), o AS (SELECT series_id, var_pop(v - mv) / var_pop(v) AS outside FROM (SELECT *, avg(v) OVER (PARTITION BY series_id, slot) AS mv FROM pr) GROUP BY ALL) SELECT series_id, round(outside, 6) AS outside, round(corr(a, b), 6) AS regimes, day_to_day FROM m JOIN o USING (series_id) JOIN (SELECT series_id, round(avg(r), 6) AS day_to_day FROM (SELECT x.series_id, x.day, corr(x.v, y.v) AS r FROM pr x JOIN pr y ON x.series_id = y.series_id AND x.slot = y.slot AND y.day = x.day + 1 GROUP BY ALL) GROUP BY ALL) USING (series_id) GROUP BY ALL")
def regime_diagnostics(spark, d):
    p = _profiles(spark, d).withColumn("mv", F.avg("v").over(Window.partitionBy("series_id", "slot")))
    w = P.is_working(F.date_add(F.lit(SPEC.origin).cast("date"), F.col("day").cast("int")), SPEC)
    o = p.groupBy("series_id").agg(rnd(F.var_pop(F.col("v") - F.col("mv")) / F.var_pop("v")).alias("outside"))
    m = p.groupBy("series_id", "slot").agg(F.avg(F.when(w, F.col("v"))).alias("a"), F.avg(F.when(~w, F.col("v"))).alias("b")).groupBy("series_id").agg(rnd(F.corr("a", "b")).alias("regimes"))
    return o.join(m, "series_id").join(day_lag_profile(spark, d).withColumnRenamed("r", "day_to_day"), "series_id")


@query("SELECT series_id, round(1 - var_pop(value - m1) / var_pop(value), 6) AS r2_slot, round(1 - var_pop(value - m2) / var_pop(value), 6) AS r2_working, round((var_pop(value - m1) - var_pop(value - m2)) / var_pop(value), 6) AS gain FROM (SELECT *, avg(value) OVER (PARTITION BY series_id, slot_idx % 24) AS m1, avg(value) OVER (PARTITION BY series_id, slot_idx % 24, (slot_idx // 24) % 7 < 5 AND slot_idx // 24 NOT IN (0, 5)) AS m2 FROM e) GROUP BY ALL")
def calendar_signal_r2(spark, d):
    e = channels(spark, d).withColumn("slot", F.col("slot_idx") % 24).withColumn("working", P.is_working(P.day_of(F.col("slot_idx"), SPEC), SPEC))
    e = e.withColumn("m1", F.avg("value").over(Window.partitionBy("series_id", "slot"))).withColumn("m2", F.avg("value").over(Window.partitionBy("series_id", "slot", "working")))
    r2 = lambda m: rnd(1 - F.var_pop(F.col("value") - F.col(m)) / F.var_pop("value"))
    return e.groupBy("series_id").agg(r2("m1").alias("r2_slot"), r2("m2").alias("r2_working"), rnd((F.var_pop(F.col("value") - F.col("m1")) - F.var_pop(F.col("value") - F.col("m2"))) / F.var_pop("value")).alias("gain"))


# --- top-k and rankings


@query("SELECT series_id, round(total, 4) AS total FROM t ORDER BY round(total, 4) DESC, series_id LIMIT 5")
def top_squares(spark, d):
    return cell_totals(spark, d).select("series_id", rnd("total", 4).alias("total")).orderBy(F.desc("total"), "series_id").limit(5)


_DEFS = "SELECT series_id, sum(value) AS total, sum(value) FILTER (slot_idx < 504) AS before_eval, sum(value) FILTER (slot_idx // 24 NOT IN (0, 5)) AS without_days, coalesce(avg(value) FILTER (value <> 0), 0) AS active_mean FROM p GROUP BY ALL"


def _defs(spark, d):
    v, s = F.col("value"), F.col("slot_idx")
    return cells(spark, d).groupBy("series_id").agg(F.sum("value").alias("total"), F.sum(F.when(s < 504, v)).alias("before_eval"), F.sum(F.when(~F.floor(s / 24).isin(0, 5), v)).alias("without_days"), F.coalesce(F.avg(F.when(v != 0, v)), F.lit(0.0)).alias("active_mean"))


@query(f"SELECT series_id, round(total, 4) AS total, round(before_eval, 4) AS before_eval, round(without_days, 4) AS without_days, round(active_mean, 9) AS active_mean FROM ({_DEFS})")
def ranking_definitions(spark, d):
    return _defs(spark, d).select("series_id", *[rnd(c, 4).alias(c) for c in ("total", "before_eval", "without_days")], rnd("active_mean", 9).alias("active_mean"))


@query(f", x AS (UNPIVOT (SELECT series_id, round(total, 4) AS total, round(before_eval, 4) AS before_eval, round(without_days, 4) AS without_days, round(active_mean, 9) AS active_mean FROM ({_DEFS})) ON total, before_eval, without_days, active_mean INTO NAME def VALUE v), rk AS (SELECT *, row_number() OVER (PARTITION BY def ORDER BY v DESC, series_id) AS k FROM x), ag AS (SELECT count(DISTINCT l) = 1 AS agree FROM (SELECT list(series_id ORDER BY k) AS l FROM rk WHERE k <= 3 GROUP BY def)) SELECT def AS definition, series_id, v AS score, CASE WHEN k <= 3 THEN k END AS k, agree FROM rk, ag WHERE series_id IN (SELECT series_id FROM rk WHERE k <= 3)")
def ranking_agreement(spark, d):
    """The top three by each definition (k), the scores of all that any of them shows, and whether all agree."""
    names = ["total", "before_eval", "without_days", "active_mean"]
    long = ranking_definitions(spark, d).unpivot(["series_id"], names, "definition", "score")
    # row_number up to a constant: Spark keeps a task's first rows only before the shuffle
    top = long.withColumn("k", F.row_number().over(Window.partitionBy("definition").orderBy(F.desc("score"), "series_id"))).filter("k <= 3").select("definition", "series_id", F.col("k").cast("long").alias("k"))
    lists = top.groupBy("definition").agg(F.sort_array(F.collect_list(F.struct("k", "series_id"))).alias("l"))
    agree = F.broadcast(lists.agg((F.countDistinct("l") == 1).alias("agree")))
    shown = long.join(F.broadcast(top.select("series_id").distinct()), "series_id", "left_semi")  # three rows a definition at most
    return shown.join(top, ["definition", "series_id"], "left").join(agree).select("definition", "series_id", "score", "k", "agree")


_SCAN = ", md AS (SELECT series_id, slot_idx % 168 AS phase, median(value) AS med FROM e WHERE slot_idx < 336 GROUP BY ALL), sc AS (SELECT e.series_id, slot_idx, CASE WHEN med > 0 THEN value / med END AS ratio FROM e JOIN md ON e.series_id = md.series_id AND slot_idx % 168 = phase)"


def anomaly(e: DataFrame) -> DataFrame:
    """Value over the median of the same slot of the week in the reference rows; null where that is not positive (T21)."""
    e = e.withColumn("phase", F.col("slot_idx") % SPEC.week)
    med = e.filter(F.col("slot_idx") < SPEC.bounds[0]).groupBy("series_id", "phase").agg(F.median("value").alias("med"))
    return e.join(med, ["series_id", "phase"]).select("series_id", "slot_idx", F.when(F.col("med") > 0, F.col("value") / F.col("med")).alias("ratio"))


@query(f"{_SCAN} SELECT series_id, slot_idx, round(ratio, 6) AS ratio, coalesce(ratio > 3, false) AS flagged FROM sc")
def anomaly_scan(spark, d):
    return anomaly(channels(spark, d)).select("series_id", "slot_idx", rnd("ratio").alias("ratio"), F.coalesce(F.col("ratio") > 3, F.lit(False)).alias("flagged"))


@query(f"{_SCAN} SELECT series_id, slot_idx, round(ratio, 6) AS ratio FROM sc ORDER BY round(ratio, 6) DESC NULLS LAST, series_id, slot_idx LIMIT 5")
def anomaly_topk(spark, d):
    return anomaly(channels(spark, d)).withColumn("ratio", rnd("ratio")).orderBy(F.desc_nulls_last("ratio"), "series_id", "slot_idx").limit(5)


_PEAK = "SELECT series_id, slot_idx // 24 AS day, arg_max(slot_idx % 24, (value, -slot_idx)) AS slot, max(value) AS peak, count(*) AS n_slots FROM e GROUP BY ALL"


def _peaks(spark, d):
    e = channels(spark, d)
    return e.groupBy("series_id", F.floor(F.col("slot_idx") / 24).alias("day")).agg(F.max_by(F.col("slot_idx") % 24, F.struct("value", -F.col("slot_idx"))).alias("slot"), F.max("value").alias("peak"), F.count("*").alias("n_slots"))


@query(f"SELECT series_id, day, slot, round(peak, 6) AS peak, n_slots, day % 7 >= 5 AS weekend, dayname(DATE '2024-01-01' + CAST(day AS INT)) AS weekday FROM ({_PEAK})")
def daily_peaks(spark, d):
    day = F.date_add(F.lit(SPEC.origin).cast("date"), F.col("day").cast("int"))
    return _peaks(spark, d).withColumn("peak", rnd("peak")).withColumn("weekend", F.col("day") % 7 >= 5).withColumn("weekday", F.date_format(day, "EEEE"))


@query(f"SELECT series_id, day % 7 >= 5 AS weekend, count(*) AS days, median(slot * 60) AS median_minutes, count(*) FILTER (slot < 12) AS early, round(median(peak), 6) AS median_peak FROM ({_PEAK}) GROUP BY ALL")
def peak_summary(spark, d):
    return _peaks(spark, d).groupBy("series_id", (F.col("day") % 7 >= 5).alias("weekend")).agg(F.count("*").alias("days"), F.median(F.col("slot") * 60).alias("median_minutes"), F.count_if(F.col("slot") < 12).alias("early"), rnd(F.median("peak")).alias("median_peak"))


@query(f", pk AS (SELECT DISTINCT series_id, slot * 60 AS m FROM ({_PEAK})), gp AS (SELECT series_id, coalesce(lead(m) OVER (PARTITION BY series_id ORDER BY m), min(m) OVER (PARTITION BY series_id) + 1440) - m AS gap FROM pk) SELECT series_id, 1440 - max(gap) AS arc FROM gp GROUP BY ALL")
def tightest_arc(spark, d):
    m = _peaks(spark, d).select("series_id", (F.col("slot") * 60).alias("m")).distinct()
    gap = F.coalesce(F.lead("m").over(Window.partitionBy("series_id").orderBy("m")), F.min("m").over(Window.partitionBy("series_id")) + 1440) - F.col("m")
    return m.withColumn("gap", gap).groupBy("series_id").agg((1440 - F.max("gap")).alias("arc"))


@query(f"SELECT series_id, count(*) FILTER (slot BETWEEN 8 AND 12) AS n FROM ({_PEAK}) GROUP BY ALL")
def peak_window_counts(spark, d):
    return _peaks(spark, d).groupBy("series_id").agg(F.count_if(F.col("slot").between(8, 12)).alias("n"))


@query("SELECT series_id, count(*) AS n, count(*) FILTER (isnan(value) OR isinf(value)) AS bad FROM e GROUP BY ALL")
def finite_guard(spark, d):
    return channels(spark, d).groupBy("series_id").agg(F.count("*").alias("n"), F.count_if(F.isnan("value") | (F.abs("value") == float("inf"))).alias("bad"))


@query("SELECT id AS series_id FROM (SELECT series_id AS id, min(k) AS k FROM (SELECT series_id, row_number() OVER (ORDER BY round(total, 4) DESC, series_id) AS k FROM t QUALIFY k <= 3 UNION ALL SELECT * FROM (VALUES (51, 100), (7, 101)) v) GROUP BY ALL)")
def study_cells(spark, d):
    top = top_squares(spark, d).orderBy(F.desc("total"), "series_id").limit(3).select("series_id")
    return top.union(spark.createDataFrame([(51,), (7,)], "series_id long")).distinct()
