"""Queries over calendars, grids, forecasts, metrics, periods, tests and runs."""

from __future__ import annotations

from functools import reduce
from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import forecast as M
from ..operators import inference as I
from ..operators import lags as L
from ..operators import panel as P
from ..operators import spatial as G
from ..operators import stats as S
from ..sources.shared import shared_path
from ..spec import SeriesSpec
from .common import SPEC, Register, cell_totals, channels, raw, rnd

query = Register()
QUERIES, SQL = query.queries, query.sql
MODELS = {"naive": "naive", "seasonal": "seasonal_naive", "tod": "time_of_day_mean", "ar1": "linear_ar1", "cal": "linear_ar1_calendar"}
SEEDS = 3

#: predictions pr (series_id, slot_idx, value, model, seed, y_pred, split); the fits of seeds 1 and 2 leave days out
PRED = """, x AS (SELECT series_id, slot_idx, value, lag(value, 1) OVER w AS l1, lag(value, 24) OVER w AS l24, (lag(value, 24) OVER w + lag(value, 48) OVER w + lag(value, 72) OVER w + lag(value, 96) OVER w) / 4 AS tod, CASE WHEN (slot_idx // 24) % 7 < 5 AND slot_idx // 24 NOT IN (0, 5) THEN 1.0::DOUBLE ELSE 0 END AS wd FROM e WINDOW w AS (PARTITION BY series_id ORDER BY slot_idx)),
tr AS (SELECT x.*, s.seed FROM x CROSS JOIN range(0, 3) s(seed) WHERE slot_idx < 336 AND l1 IS NOT NULL AND (s.seed = 0 OR ((slot_idx // 24 + 1) * (s.seed + 1) * 7919 % 10007) % 5 <> 0)),
fit AS (SELECT series_id, seed, regr_slope(value, l1) AS a, regr_intercept(value, l1) AS b FROM tr GROUP BY ALL),
mm AS (SELECT series_id, seed, var_pop(l1) AS aa, var_pop(wd) AS bb, covar_pop(l1, wd) AS ab, covar_pop(l1, value) AS ay, covar_pop(wd, value) AS by_, avg(l1) AS ma, avg(wd) AS mb, avg(value) AS my FROM tr GROUP BY ALL),
cf AS (SELECT series_id, seed, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS a, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS b, ma, mb, my FROM mm),
m0 AS (SELECT series_id, slot_idx, value, 'naive' AS model, 0 AS seed, l1 AS y FROM x UNION ALL SELECT series_id, slot_idx, value, 'seasonal', 0, l24 FROM x UNION ALL SELECT series_id, slot_idx, value, 'tod', 0, tod FROM x UNION ALL SELECT series_id, slot_idx, value, 'ar1', seed, b + a * l1 FROM x JOIN fit USING (series_id) UNION ALL SELECT series_id, slot_idx, value, 'cal', seed, my - a * ma - b * mb + a * l1 + b * wd FROM x JOIN cf USING (series_id)),
pr AS (SELECT series_id, slot_idx, value, model, seed, y AS y_pred, CASE WHEN slot_idx < 336 THEN 'train' WHEN slot_idx < 504 THEN 'val' WHEN slot_idx < 672 THEN 'eval' ELSE 'post' END AS split FROM m0),
ev AS (SELECT * FROM pr WHERE split = 'eval')"""


def preds(spark, d):
    return M.predictions(channels(spark, d), SPEC, MODELS, SEEDS)


def evals(spark, d):
    return preds(spark, d).filter("split = 'eval'")


# --- scalars and calendar


@query("SELECT DISTINCT slot_idx // 24 AS day, 1704067200000 + (slot_idx // 24) * 86400000 AS origin_ms FROM e")
def day_origin(spark, d):
    day = channels(spark, d).select(F.floor(F.col("slot_idx") / 24).alias("day")).distinct()
    return day.select("day", F.unix_millis(F.to_utc_timestamp(F.date_add(F.lit(SPEC.origin).cast("date"), F.col("day").cast("int")).cast("timestamp"), "UTC")).alias("origin_ms"))


@query("SELECT event_id, slot_idx, slot_idx * 100 + series_id - 1 AS flat FROM r")
def slot_of(spark, d):
    return raw(spark, d).select("event_id", "slot_idx", (F.col("slot_idx") * 100 + F.col("series_id") - 1).alias("flat"))


@query("SELECT series_id, row, col, row * 10 + col + 1 AS back FROM t")
def rowcol(spark, d):
    return cell_totals(spark, d).select("series_id", "row", "col", (F.col("row") * 10 + F.col("col") + 1).alias("back"))


@query("SELECT row, " + ", ".join(f"round(sum(total) FILTER (col = {k}), 4) AS c{k}" for k in range(SPEC.side)) + " FROM t GROUP BY ALL")
def to_grid(spark, d):
    side = range(SPEC.side)
    return cell_totals(spark, d).groupBy("row").pivot("col", list(side)).agg(rnd(F.sum("total"), 4)).withColumnsRenamed({str(k): f"c{k}" for k in side})


@query("SELECT DISTINCT slot_idx // 24 AS day, ((slot_idx // 24) % 7 < 5 AND slot_idx // 24 NOT IN (0, 5))::INT AS working, CASE WHEN slot_idx // 24 IN (0, 5) THEN 'holiday' WHEN (slot_idx // 24) % 7 >= 5 THEN 'weekend' ELSE 'weekday' END AS kind FROM e")
def is_working_day(spark, d):
    day = P.day_of(F.col("slot_idx"), SPEC)
    kind = F.when(day.cast("string").isin(*SPEC.holidays), "holiday").when(F.weekday(day) >= 5, "weekend").otherwise("weekday")
    return channels(spark, d).select(F.floor(F.col("slot_idx") / 24).alias("day"), P.is_working(day, SPEC).cast("int").alias("working"), kind.alias("kind")).distinct()


@query("SELECT kind, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, CASE WHEN slot_idx // 24 IN (0, 5) THEN 'holiday' WHEN (slot_idx // 24) % 7 >= 5 THEN 'weekend' ELSE 'weekday' END AS kind FROM e) GROUP BY ALL")
def day_kind(spark, d):
    day = P.day_of(F.col("slot_idx"), SPEC)
    kind = F.when(day.cast("string").isin(*SPEC.holidays), "holiday").when(F.weekday(day) >= 5, "weekend").otherwise("weekday")
    return channels(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), rnd(F.sum("value"), 4).alias("total"))


@query("SELECT DISTINCT slot_idx, round(sin(2 * pi() * (slot_idx % 24) / 24), 6) + 0.0 AS day_sin, round(cos(2 * pi() * (slot_idx % 168) / 168), 6) + 0.0 AS week_cos FROM e")
def cyclic_calendar(spark, d):
    s = F.col("slot_idx")
    return channels(spark, d).select("slot_idx", rnd(F.sin(2 * F.pi() * (s % 24) / 24)).alias("day_sin"), rnd(F.cos(2 * F.pi() * (s % 168) / 168)).alias("week_cos")).distinct()


@query("SELECT DISTINCT slot_idx, round(sin(2 * pi() * (slot_idx % 24) / 24), 6) + 0.0 AS day_sin, round(cos(2 * pi() * (slot_idx % 24) / 24), 6) + 0.0 AS day_cos, round(sin(2 * pi() * (slot_idx // 24 % 7) / 7), 6) + 0.0 AS dow_sin, round(cos(2 * pi() * (slot_idx // 24 % 7) / 7), 6) + 0.0 AS dow_cos, ((slot_idx // 24) % 7 < 5 AND slot_idx // 24 NOT IN (0, 5))::INT::DOUBLE AS working FROM e")
def target_calendar(spark, d):
    return channels(spark, d).select("slot_idx", *[rnd(c).alias(n) for n, c in M.calendar(F.col("slot_idx"), SPEC).items()]).distinct()


@query("SELECT split, count(*) AS n, round(avg(scaled), 6) AS mean, round(max(abs(back - value)), 6) + 0.0 AS error FROM (SELECT CASE WHEN slot_idx < 336 THEN 'train' ELSE 'later' END AS split, value, (ln(1 + value) - c) / s AS scaled, value AS back FROM e JOIN (SELECT series_id, avg(ln(1 + value)) AS c, stddev_pop(ln(1 + value)) AS s FROM e WHERE slot_idx < 336 GROUP BY ALL) USING (series_id)) WHERE split = 'later' GROUP BY ALL")
def scale_apply(spark, d):
    e = channels(spark, d)
    x = e.join(M.fit_scaler(e, "log1p-standard", SPEC), "series_id").withColumn("scaled", M.scaled(F.col("value"), "log1p-standard")).withColumn("back", M.unscaled(F.col("scaled"), "log1p-standard"))
    return x.filter("slot_idx >= 336").groupBy(F.lit("later").alias("split")).agg(F.count("*").alias("n"), rnd(F.avg("scaled")).alias("mean"), rnd(F.max(F.abs(F.col("back") - F.col("value")))).alias("error"))


@query("SELECT series_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(min(value), 6) AS least, round(max(value) - min(value), 6) AS span FROM e WHERE slot_idx < 336 GROUP BY ALL")
def fit_scaler(spark, d):
    e = channels(spark, d)
    a = M.fit_scaler(e, "standard", SPEC).select("series_id", rnd("center").alias("mean"), rnd("scale").alias("sd"))
    return a.join(M.fit_scaler(e, "minmax", SPEC).select("series_id", rnd("center").alias("least"), rnd("scale").alias("span")), "series_id")


@query(f"{PRED} SELECT model, count(*) FILTER (y_pred IS NOT NULL) AS n_scored, count(*) FILTER (y_pred IS NULL) AS n_dropped FROM pr GROUP BY ALL")
def finite_counts(spark, d):
    return M.metrics(preds(spark, d), ["model"], allow_missing=True).select("model", "n_scored", "n_dropped")


@query("SELECT DISTINCT strftime(TIMESTAMP '2024-01-01' + (slot_idx // 24) * INTERVAL 1 DAY, '%a %d %b') AS label FROM e")
def period_label(spark, d):
    return channels(spark, d).select(F.date_format(P.day_of(F.col("slot_idx"), SPEC), "EEE dd MMM").alias("label")).distinct()


@query("SELECT DISTINCT slot_idx % 24 * 60 AS minutes, strftime(TIMESTAMP '2024-01-01' + (slot_idx % 24) * INTERVAL 1 HOUR, '%H:%M') AS clock FROM e")
def minutes_of_day(spark, d):
    return channels(spark, d).select((F.col("slot_idx") % 24 * 60).alias("minutes"), F.format_string("%02d:00", F.col("slot_idx") % 24).alias("clock")).distinct()


@query("SELECT series_id, count(*) AS n, round(1.96 / sqrt(count(*)), 6) AS band, floor(1.5 * power(count(*), 1.0 / 3))::BIGINT AS lag, 1 + 2 * (3 - 1) * (power(2, 5) - 1)::BIGINT AS field FROM e GROUP BY ALL")
def confidence_band(spark, d):
    n = F.count("*")
    return channels(spark, d).groupBy("series_id").agg(n.alias("n"), rnd(1.96 / F.sqrt(n)).alias("band"), L.newey_west(n).alias("lag"), (1 + 2 * (3 - 1) * (F.pow(F.lit(2.0), F.lit(5.0)) - 1)).cast("long").alias("field"))


# --- grid


_CENTRE = "SELECT series_id, row, col, total, 45.356261 + (row + 0.5) / 10 * (45.568161 - 45.356261) AS lat, 9.011533 + (col + 0.5) / 10 * (9.312688 - 9.011533) AS lon FROM t"


def _centres(spark, d):
    lat, lon = G.centroid(F.col("row"), F.col("col"), SPEC.side)
    return cell_totals(spark, d).withColumns({"lat": lat, "lon": lon})


@query(f"SELECT series_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ({_CENTRE})")
def cell_centroid(spark, d):
    return _centres(spark, d).select("series_id", rnd("lat").alias("lat"), rnd("lon").alias("lon"))


@query(f"SELECT series_id, row, col FROM ({_CENTRE})")
def point_to_cell(spark, d):
    row, col = G.cell_of(F.col("lat"), F.col("lon"), SPEC.side)
    return _centres(spark, d).select("series_id", row.alias("row"), col.alias("col"))


_HAV = "2 * 6371008.8 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))"


@query(f", c AS ({_CENTRE}) SELECT b.series_id, round({_HAV}, 3) AS metres FROM c a, c b WHERE a.series_id = 1")
def haversine(spark, d):
    c = _centres(spark, d)
    at = F.broadcast(c.filter("series_id = 1").select(F.col("lat").alias("la"), F.col("lon").alias("lo")))
    return c.join(at).select("series_id", rnd(G.haversine(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon")), 3).alias("metres"))


_BEAR = "((degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))) + 360) % 360)"


@query(f", c AS ({_CENTRE}) SELECT b.series_id, round({_BEAR}, 4) AS bearing, ['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW'][(floor({_BEAR} / 22.5 + 0.5) % 16)::INT + 1] AS point FROM c a, c b WHERE a.series_id = 1 AND b.series_id > 1")
def bearing_compass(spark, d):
    c = _centres(spark, d)
    at = F.broadcast(c.filter("series_id = 1").select(F.col("lat").alias("la"), F.col("lon").alias("lo")))
    b = c.filter("series_id > 1").join(at).withColumn("b", G.bearing(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon")))
    return b.select("series_id", rnd("b", 4).alias("bearing"), G.compass(F.col("b")).alias("point"))


@query(f", c AS ({_CENTRE}) SELECT b.series_id, b.row, b.col, round({_HAV}, 3) AS metres, round(b.total, 4) AS total FROM c a, c b WHERE a.series_id = 1 AND b.series_id IN (7, 51, 88)")
def study_cell_table(spark, d):
    c = _centres(spark, d)
    at = F.broadcast(c.filter("series_id = 1").select(F.col("lat").alias("la"), F.col("lon").alias("lo")))
    return c.filter(F.col("series_id").isin(7, 51, 88)).join(at).select("series_id", "row", "col", rnd(G.haversine(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon")), 3).alias("metres"), rnd("total", 4).alias("total"))


@query(f", c AS ({_CENTRE}) SELECT a.series_id AS a, b.series_id AS b, greatest(abs(a.row - b.row), abs(a.col - b.col)) AS cells, round({_HAV}, 3) AS metres FROM c a JOIN c b ON a.series_id < b.series_id WHERE a.series_id IN (7, 51, 88) AND b.series_id IN (7, 51, 88)")
def pairwise_distance(spark, d):
    c = _centres(spark, d).filter(F.col("series_id").isin(7, 51, 88)).select(F.struct("series_id", "row", "col", "lat", "lon").alias("a"))
    got = c.join(c.select(F.col("a").alias("b"))).filter("a.series_id < b.series_id")
    return got.select(F.col("a.series_id").alias("a"), F.col("b.series_id").alias("b"), F.greatest(F.abs(F.col("a.row") - F.col("b.row")), F.abs(F.col("a.col") - F.col("b.col"))).alias("cells"), rnd(G.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")), 3).alias("metres"))


_NB = ", nb AS (SELECT a.series_id, a.row, a.col, a.total, median(b.total) AS middle, a.total / nullif(median(b.total), 0) AS ratio FROM t a JOIN t b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY a.series_id, a.row, a.col, a.total)"


@query("SELECT a.series_id, count(*) AS n, round(sum(b.total), 4) AS total FROM t a JOIN t b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL")
def neighbour_join(spark, d):
    return G.neighbours(cell_totals(spark, d), 1, SPEC).groupBy("series_id").agg(F.count("*").alias("n"), rnd(F.sum("ntotal"), 4).alias("total"))


@query(f"{_NB} SELECT series_id, round(ratio, 6) AS ratio FROM nb")
def neighbourhood_ratio(spark, d):
    return G.neighbourhood_ratio(cell_totals(spark, d), 2, SPEC).select("series_id", rnd("ratio").alias("ratio"))


_BEST = ", bn AS (SELECT a.series_id, a.row, a.col, arg_max({'dr': b.row - a.row, 'dc': b.col - a.col, 'ratio': b.ratio}, (round(b.ratio, 9), a.row - b.row, a.col - b.col)) AS t FROM nb a JOIN nb b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 WHERE b.ratio IS NOT NULL GROUP BY ALL)"


@query(f"{_NB}{_BEST} SELECT series_id, t.dr AS dr, t.dc AS dc, round(t.ratio, 6) AS best FROM bn")
def best_neighbour(spark, d):
    return G.best_neighbours(cell_totals(spark, d), 1, 2, SPEC).select("series_id", "dr", "dc", rnd("best").alias("best"))


@query(f"{_NB}{_BEST}, st AS (SELECT series_id, t.dr AS dr, t.dc AS dc, 45.356261 + (row + 0.5) / 10 * (45.568161 - 45.356261) AS lat1, 9.011533 + (col + 0.5) / 10 * (9.312688 - 9.011533) AS lon1, 45.356261 + (row + t.dr + 0.5) / 10 * (45.568161 - 45.356261) AS lat2, 9.011533 + (col + t.dc + 0.5) / 10 * (9.312688 - 9.011533) AS lon2 FROM bn), bb AS (SELECT series_id, dr, dc, {_BEAR.replace('b.lat', 'lat2').replace('b.lon', 'lon2').replace('a.lat', 'lat1').replace('a.lon', 'lon1')} AS b FROM st) SELECT series_id, dr, dc, CASE WHEN dr <> 0 OR dc <> 0 THEN ['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW'][(floor(b / 22.5 + 0.5) % 16)::INT + 1] END AS point FROM bb")
def offset_compass(spark, d):
    """Which way each cell's best neighbour lies."""
    b = G.best_neighbours(cell_totals(spark, d), 1, 2, SPEC)
    return b.select("series_id", "dr", "dc", G.step_compass(F.col("row"), F.col("col"), F.col("dr"), F.col("dc"), SPEC.side).alias("point"))


_MARKS = "(VALUES " + ", ".join(f"('{n}', {lat}, {lon}, {repr(e) if e else 'NULL'})" for n, lat, lon, e in G.LANDMARKS) + ") k(name, mlat, mlon, expect)"
_AT = f", mk AS (SELECT name, expect, o AS origin, CASE WHEN o = 'south' THEN floor((mlat - 45.356261) / (45.568161 - 45.356261) * 10) ELSE floor((45.568161 - mlat) / (45.568161 - 45.356261) * 10) END::BIGINT AS row, floor((mlon - 9.011533) / (9.312688 - 9.011533) * 10)::BIGINT AS col FROM {_MARKS}, (VALUES ('south'), ('north')) o(o))"
_CHECK = _NB + _AT + ", ck AS (SELECT name, origin, series_id, ratio, CASE WHEN expect = 'max' THEN CASE WHEN ratio > 1 THEN 'pass' ELSE 'FAIL' END WHEN expect = 'min' THEN CASE WHEN ratio < 1 THEN 'pass' ELSE 'FAIL' END END AS verdict FROM mk JOIN nb USING (row, col))"


def _landmarks(spark):
    marks = spark.sql(f"SELECT name, CAST(mlat AS DOUBLE) AS mlat, CAST(mlon AS DOUBLE) AS mlon, expect FROM {_MARKS}")
    south, north = (F.struct(F.lit(o).alias("origin"), *[c.alias(n) for c, n in zip(G.cell_of(F.col("mlat"), F.col("mlon"), SPEC.side, o == "north"), ("row", "col"), strict=True)]) for o in ("south", "north"))
    return marks.withColumn("x", F.explode(F.array(south, north))).select("name", "expect", "x.*")


@query(f"{_AT} SELECT name, origin, series_id, round(total, 4) AS total FROM mk JOIN t USING (row, col)")
def landmark_join(spark, d):
    return F.broadcast(_landmarks(spark)).join(cell_totals(spark, d), ["row", "col"]).select("name", "origin", "series_id", rnd("total", 4).alias("total"))


@query(f"{_CHECK} SELECT name, origin, series_id, round(ratio, 6) AS ratio, verdict FROM ck")
def orientation_check(spark, d):
    r = F.broadcast(_landmarks(spark)).join(G.neighbourhood_ratio(cell_totals(spark, d), 2, SPEC), ["row", "col"])
    told = lambda ok: F.when(ok, "pass").otherwise("FAIL")
    verdict = F.when(F.col("expect") == "max", told(F.col("ratio") > 1)).when(F.col("expect") == "min", told(F.col("ratio") < 1))
    return r.select("name", "origin", "series_id", rnd("ratio").alias("ratio"), verdict.alias("verdict"))


@query(f"{_CHECK} SELECT origin, count(*) FILTER (verdict = 'pass') AS passes, count(*) FILTER (verdict = 'FAIL') AS failures FROM ck GROUP BY ALL")
def orientation_scores(spark, d):
    return orientation_check(spark, d).groupBy("origin").agg(F.count_if(F.col("verdict") == "pass").alias("passes"), F.count_if(F.col("verdict") == "FAIL").alias("failures"))


# --- windows and forecasts


@query("SELECT series_id, CASE WHEN slot_idx < 336 THEN 'train' WHEN slot_idx < 504 THEN 'val' WHEN slot_idx < 672 THEN 'eval' ELSE 'post' END AS split, min(slot_idx) AS lo, count(*) AS n FROM e GROUP BY ALL")
def chronological_split(spark, d):
    return channels(spark, d).groupBy("series_id", P.split_label(F.col("slot_idx"), SPEC).alias("split")).agg(F.min("slot_idx").alias("lo"), F.count("*").alias("n"))


@query("SELECT series_id, slot_idx, round(value, 6) AS target, round(o, 6) AS oldest, round(l, 6) AS latest FROM (SELECT *, lag(value, 25) OVER w AS o, lag(value, 2) OVER w AS l FROM e WINDOW w AS (PARTITION BY series_id ORDER BY slot_idx)) WHERE slot_idx >= 25 AND (slot_idx - 25) % 3 = 0")
def make_windows(spark, d):
    return M.windows(channels(spark, d), 24, 2, 3).select("series_id", "slot_idx", rnd("target").alias("target"), rnd(F.element_at("lags", 1)).alias("oldest"), rnd(F.element_at("lags", -1)).alias("latest"))


_SPLIT = "CASE WHEN slot_idx < 336 THEN 'train' WHEN slot_idx < 504 THEN 'val' WHEN slot_idx < 672 THEN 'eval' ELSE 'post' END"


@query(f"SELECT series_id, split, count(*) - 24 AS n, min(slot_idx) + 24 AS first_target FROM (SELECT *, {_SPLIT} AS split FROM e) GROUP BY ALL")
def split_windows(spark, d):
    e = channels(spark, d).withColumn("split", P.split_label(F.col("slot_idx"), SPEC))
    return M.windows(e, 24, within=("split",)).groupBy("series_id", "split").agg(F.count("*").alias("n"), F.min("slot_idx").alias("first_target"))


@query("SELECT series_id, count(*) AS n, min(slot_idx) AS lo FROM e WHERE slot_idx BETWEEN 504 AND 671 GROUP BY ALL")
def context_windows(spark, d):
    return M.windows(channels(spark, d), 24).filter("slot_idx between 504 and 671").groupBy("series_id").agg(F.count("*").alias("n"), F.min("slot_idx").alias("lo"))


@query("SELECT series_id, slot_idx FROM e WHERE slot_idx >= 24")
def window_target_rows(spark, d):
    return M.windows(channels(spark, d), 24).select("series_id", "slot_idx")


@query("SELECT series_id, count(*) AS n, round(sum(value), 4) AS total FROM e WHERE slot_idx < 336 GROUP BY ALL")
def fortnight_window(spark, d):
    return channels(spark, d).filter("slot_idx < 336").groupBy("series_id").agg(F.count("*").alias("n"), rnd(F.sum("value"), 4).alias("total"))


@query(f", s AS (SELECT series_id, avg(value) AS c, stddev_pop(value) AS s FROM e WHERE slot_idx < 336 GROUP BY ALL), z AS (SELECT series_id, avg(abs(value - l)) AS scale FROM (SELECT series_id, slot_idx, value, lag(value, 24) OVER (PARTITION BY series_id ORDER BY slot_idx) AS l FROM e) WHERE slot_idx < 336 GROUP BY ALL), y AS (SELECT *, {_SPLIT} AS split, (slot_idx // 24) % 7 < 5 AND slot_idx // 24 NOT IN (0, 5) AS working FROM e JOIN s USING (series_id)) SELECT series_id, split, count(*) AS n, round(sum((value - c) / s), 4) AS scaled, round(sum(value), 4) AS raw, count(*) FILTER (working) AS working, round(sum(cos(2 * pi() * (slot_idx % 24) / 24)), 4) + 0.0 AS day_cos, round(any_value(scale), 6) AS scale FROM y JOIN z USING (series_id) WHERE split <> 'post' AND slot_idx >= 24 GROUP BY series_id, split")
def prepare_area(spark, d):
    """Training frames of all series: scaled windows with the target's calendar and raw truth, and the training slots' seasonal difference."""
    x = M.training_frame(channels(spark, d), SPEC, 24).filter("split <> 'post'")
    exog = lambda k: F.get("exog", F.lit(k))
    return x.groupBy("series_id", "split").agg(F.count("*").alias("n"), rnd(F.sum("target"), 4).alias("scaled"), rnd(F.sum("truth"), 4).alias("raw"), F.sum(exog(4)).cast("long").alias("working"), rnd(F.sum(exog(1)), 4).alias("day_cos"), rnd(F.first("scale")).alias("scale"))


def _model(name: str, label: str):
    def f(spark, d):
        return M.build(name)(channels(spark, d), SPEC).select("series_id", "slot_idx", rnd("y_pred").alias("y_pred"))

    f.__name__ = label
    return f


for _name, _label, _sql in (("naive", "persistence", "naive"), ("seasonal_naive", "seasonal_naive", "seasonal"), ("time_of_day_mean", "time_of_day_mean", "tod"), ("linear_ar1", "linear_ar1", "ar1")):
    query(f"{PRED} SELECT series_id, slot_idx, round(y, 6) AS y_pred FROM m0 WHERE model = '{_sql}' AND seed = 0")(_model(_name, _label))
query(None)(_model("linear_ar", "linear_ar"))


@query(None)
def gbt(spark, d):
    """With the rounds that patience left, the trees' leaves and the validation error."""
    return M.build("gbt")(channels(spark, d), SPEC).select("series_id", "slot_idx", rnd("y_pred").alias("y_pred"), F.col("rounds").cast("long").alias("rounds"), F.col("leaves").cast("long").alias("leaves"), rnd("validation_mae").alias("validation_mae"))


@query(None)
def linear_ar_presets(spark, d):
    """The registered orders, and one with the calendar: fitted once into a table of parameters, from which forecasts are made."""
    path, models = shared_path(spark, "parameters"), {"ar6": "linear_ar_6", "ar36": "linear_ar_36", "ar144": "linear_ar_144", "ar24_calendar": "linear_ar_calendar"}
    p = M.predictions(channels(spark, d), SPEC, models, 1, path)
    sizes = M.fit_all(channels(spark, d), SPEC, models, 1, path).groupBy("model").agg(F.max("n_params").cast("long").alias("n_params"))
    return p.join(F.broadcast(sizes), "model").select("series_id", "slot_idx", "model", "n_params", rnd("y_pred").alias("y_pred"))  # a row a model


@query(f"{PRED} SELECT series_id, 'ar1' AS model, seed, 2 AS n_params, round(b, 6) AS c0, round(a, 6) AS c1, NULL::DOUBLE AS c2 FROM fit UNION ALL SELECT series_id, 'cal', seed, 3, round(my - a * ma - b * mb, 6), round(a, 6), round(b, 6) FROM cf")
def parameters(spark, d):
    """The stored parameters of what is fitted, by seed; a second call finds them there."""
    path = shared_path(spark, "parameters")
    for _ in range(2):
        p = M.fit_all(channels(spark, d), SPEC, MODELS, SEEDS, path)
    return p.select("series_id", "model", F.col("seed").cast("long").alias("seed"), F.col("n_params").cast("long").alias("n_params"), *[rnd(F.get("coefficients", F.lit(k))).alias(f"c{k}") for k in range(3)])

# --- metrics

_MET = "count(y_pred) AS n_scored, avg(abs(value - y_pred)) AS mae, sqrt(avg(power(value - y_pred, 2))) AS rmse, 100 * avg(abs(value - y_pred) / greatest(abs(value), 0.001)) AS mape, 100 * avg(abs(value - y_pred) / nullif(abs(value), 0)) FILTER (abs(value) > 0.001) AS mape_mask, 100 * avg(abs(value - y_pred) / nullif((abs(value) + abs(y_pred)) / 2, 0)) AS smape, 100 * sum(abs(value - y_pred)) / nullif(sum(abs(value)), 0) AS wape, 1 - sum(power(value - y_pred, 2)) / nullif(count(*) * var_pop(value), 0) AS r2"
_SCALE = ", sc AS (SELECT series_id, avg(abs(value - l24)) AS scale FROM x WHERE slot_idx < 336 GROUP BY ALL)"


@query(f"{PRED}{_SCALE}, k AS (SELECT series_id, model, seed, {_MET} FROM ev GROUP BY ALL) SELECT series_id, model, seed, n_scored, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape, 3) AS mape, round(mape_mask, 4) AS mape_mask, round(smape, 4) AS smape, round(wape, 4) AS wape, round(r2, 6) AS r2, round(mae / scale, 6) AS mase FROM k JOIN sc USING (series_id)")
def evaluate(spark, d):
    m = M.metrics(evals(spark, d), ["series_id", "model", "seed"], M.naive_scale(channels(spark, d), SPEC))
    digits = {"mae": 6, "rmse": 6, "mape": 3, "mape_mask": 4, "smape": 4, "wape": 4, "r2": 6, "mase": 6}
    return m.select("series_id", "model", "seed", "n_scored", *[rnd(c, k).alias(c) for c, k in digits.items()])


def _metric(name: str, digits: int):
    def f(spark, d):
        return M.metrics(evals(spark, d), ["series_id", "model"]).select("series_id", "model", rnd(name, digits).alias(name))

    f.__name__ = name
    return f


for _name, _digits in (("mae", 6), ("rmse", 6), ("mape", 3), ("smape", 4), ("wape", 4), ("r2", 6)):
    query(f"{PRED}, k AS (SELECT series_id, model, {_MET} FROM ev GROUP BY ALL) SELECT series_id, model, round({_name}, {_digits}) AS {_name} FROM k")(_metric(_name, _digits))


@query(f"{PRED}{_SCALE} SELECT series_id, round(scale, 6) AS scale FROM sc")
def seasonal_naive_scale(spark, d):
    return M.naive_scale(channels(spark, d), SPEC).select("series_id", rnd("scale").alias("scale"))


@query(f"{PRED}{_SCALE} SELECT series_id, model, round(avg(abs(value - y_pred)) / any_value(scale), 6) AS mase FROM ev JOIN sc USING (series_id) GROUP BY ALL")
def mase(spark, d):
    return M.metrics(evals(spark, d), ["series_id", "model"], M.naive_scale(channels(spark, d), SPEC)).select("series_id", "model", rnd("mase").alias("mase"))


@query(f"{PRED} SELECT model, round(avg(abs(value - y_pred)), 5) AS mae FROM ev GROUP BY ALL")
def metrics_table(spark, d):
    return M.metrics(evals(spark, d), ["model"]).select("model", rnd("mae", 5).alias("mae")).orderBy("mae")


def _by_seed(spark, d):
    return M.metrics(evals(spark, d), ["series_id", "model", "seed"])


_ALL = ("mae", "rmse", "mape", "mape_mask", "smape", "wape", "r2", "mase")


@query(f"{PRED}{_SCALE}, k AS (SELECT series_id, model, seed, {_MET} FROM ev GROUP BY ALL), ks AS (SELECT *, mae / scale AS mase FROM k JOIN sc USING (series_id)) SELECT series_id, model, {', '.join(f'round(avg({c}), 4) AS {c}_mean, round(stddev_samp({c}), 4) AS {c}_std' for c in _ALL)} FROM ks GROUP BY ALL")
def aggregate_seeds(spark, d):
    """Every metric's mean and deviation over seeds; null deviation where there is one."""
    m = M.metrics(evals(spark, d), ["series_id", "model", "seed"], M.naive_scale(channels(spark, d), SPEC))
    return m.groupBy("series_id", "model").agg(*[rnd(f(c), 4).alias(f"{c}_{n}") for c in _ALL for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


@query(f"{PRED} SELECT series_id, arg_min(model, (mae, model)) AS best FROM (SELECT series_id, model, round(avg(abs(value - y_pred)), 9) AS mae FROM ev GROUP BY ALL) GROUP BY ALL")
def best_model(spark, d):
    return M.metrics(evals(spark, d), ["series_id", "model"]).groupBy("series_id").agg(F.min_by("model", F.struct(rnd("mae", 9), "model")).alias("best"))


@query(f"{PRED}, one AS (SELECT slot_idx // 24 AS day, model, seed, avg(abs(value - y_pred)) AS mae, sqrt(avg(power(value - y_pred, 2))) AS rmse, 100 * sum(abs(value - y_pred)) / nullif(sum(abs(value)), 0) AS wape, avg(value - y_pred) AS me, avg(value) AS level, count(*) AS n FROM ev GROUP BY ALL) SELECT day, model, round(avg(mae), 6) AS mae, round(coalesce(stddev_samp(mae), 0), 6) AS mae_sd, round(avg(rmse), 6) AS rmse, round(avg(wape), 4) AS wape, round(avg(me), 6) AS me, round(coalesce(stddev_samp(me), 0), 6) + 0.0 AS me_sd, round(avg(level), 6) AS level, max(n) AS n FROM one GROUP BY ALL")
def per_period_errors(spark, d):
    e = F.col("value") - F.col("y_pred")
    one = evals(spark, d).groupBy(F.floor(F.col("slot_idx") / 24).alias("day"), "model", "seed").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.try_divide(F.sum(F.abs(e)), F.sum(F.abs("value")))).alias("wape"), F.avg(e).alias("me"), F.avg("value").alias("level"), F.count("*").alias("n"))
    sd = lambda c: rnd(F.coalesce(F.stddev_samp(c), F.lit(0.0))).alias(f"{c}_sd")
    return one.groupBy("day", "model").agg(rnd(F.avg("mae")).alias("mae"), sd("mae"), rnd(F.avg("rmse")).alias("rmse"), rnd(F.avg("wape"), 4).alias("wape"), rnd(F.avg("me")).alias("me"), sd("me"), rnd(F.avg("level")).alias("level"), F.max("n").alias("n"))


@query(f"{PRED} SELECT day, {', '.join(f"round(max(mae) FILTER (model = '{k}'), 6) AS {k}_mae, round(max(wape) FILTER (model = '{k}'), 4) AS {k}_wape" for k in MODELS)}, round(max(level) FILTER (model = 'naive'), 6) AS level FROM (SELECT slot_idx // 24 AS day, model, avg(abs(value - y_pred)) AS mae, 100 * sum(abs(value - y_pred)) / nullif(sum(abs(value)), 0) AS wape, avg(value) AS level FROM ev GROUP BY ALL) GROUP BY ALL")
def per_day_pivot(spark, d):
    """Days by models: mean absolute error and its share of the level, and the level."""
    err = F.abs(F.col("value") - F.col("y_pred"))
    day = evals(spark, d).groupBy(F.floor(F.col("slot_idx") / 24).alias("day"))
    wide = day.pivot("model", list(MODELS)).agg(rnd(F.avg(err)).alias("mae"), rnd(100 * F.try_divide(F.sum(err), F.sum(F.abs("value"))), 4).alias("wape"))
    level = channels(spark, d).filter(P.split_label(F.col("slot_idx"), SPEC) == "eval").groupBy(F.floor(F.col("slot_idx") / 24).alias("day")).agg(rnd(F.avg("value")).alias("level"))
    return wide.join(level, "day")


@query(f"{PRED} SELECT day, {', '.join(f"round(max(mae) FILTER (series_id = '{c}'), 6) AS {c}" for c in SPEC.channels)} FROM (SELECT series_id, slot_idx // 24 AS day, avg(abs(value - y_pred)) AS mae FROM ev WHERE model = 'ar1' GROUP BY ALL) GROUP BY ALL")
def area_by_day(spark, d):
    """Days by areas: one model's mean absolute error."""
    return evals(spark, d).filter("model = 'ar1'").groupBy(F.floor(F.col("slot_idx") / 24).alias("day")).pivot("series_id", list(SPEC.channels)).agg(rnd(F.avg(F.abs(F.col("value") - F.col("y_pred")))))


#: a fitted model against one that has a single seed; and with the calendar against without, seed by seed
_EXC = ", ex AS (SELECT a.slot_idx // 24 AS day, a.seed, count(*) AS n, sum(abs(a.value - a.y_pred)) - sum(abs(b.value - b.y_pred)) AS excess FROM ev a JOIN ev b ON a.series_id = b.series_id AND a.slot_idx = b.slot_idx AND a.model = 'ar1' AND b.model = 'seasonal' GROUP BY ALL)"
_PEN = ", pn AS (SELECT a.series_id, a.slot_idx, a.slot_idx // 24 AS day, a.seed, abs(a.value - a.y_pred) - abs(b.value - b.y_pred) AS penalty FROM ev a JOIN ev b ON a.series_id = b.series_id AND a.slot_idx = b.slot_idx AND a.seed = b.seed AND a.model = 'cal' AND b.model = 'ar1')"
ZOOM = (22, 23)  # days named beforehand


def _error_of(e, model, name):
    return e.filter(F.col("model") == model).select("series_id", "slot_idx", "seed", F.abs(F.col("value") - F.col("y_pred")).alias(name))


def _paired(spark, d, a, b, by=("series_id", "slot_idx", "seed")):
    """Errors ea of model a and eb of b, slot by slot; without the seed among the keys, b has one seed, which meets all of a's."""
    e = evals(spark, d)
    right = _error_of(e, b, "eb")
    return _error_of(e, a, "ea").join(right if "seed" in by else right.drop("seed"), list(by)).withColumn("day", F.floor(F.col("slot_idx") / SPEC.season))


@query(f"{PRED}{_EXC}, sh AS (SELECT day, seed, n, excess, 100 * excess / nullif(sum(excess) OVER (PARTITION BY seed), 0) AS net, 100 * excess / nullif(sum(greatest(excess, 0)) OVER (PARTITION BY seed), 0) AS positive FROM ex UNION ALL SELECT NULL, seed, sum(n), sum(excess), 100, 100 FROM ex GROUP BY seed) SELECT day, CAST(max(n) AS BIGINT) AS n_slots, round(avg(excess), 4) AS excess, round(coalesce(stddev_samp(excess), 0), 4) AS excess_sd, round(avg(net), 4) AS net_share, round(avg(positive), 4) AS positive_share, round(min(net), 4) AS net_min, round(max(net), 4) AS net_max FROM sh GROUP BY ALL")
def excess_error_share(spark, d):
    """By day, and in all (day null), where a model's deficit to a reference comes from; shares of the net and of the positive excess."""
    one = _paired(spark, d, "ar1", "seasonal", ("series_id", "slot_idx")).groupBy("day", "seed").agg(F.count("*").alias("n"), (F.sum("ea") - F.sum("eb")).alias("excess"))
    w = Window.partitionBy("seed")
    share = lambda total: 100 * F.try_divide("excess", F.sum(total).over(w))
    days = one.withColumns({"net": share(F.col("excess")), "positive": share(F.greatest("excess", F.lit(0.0)))})
    whole = one.groupBy("seed").agg(F.sum("n").alias("n"), F.sum("excess").alias("excess")).withColumns({"day": F.lit(None).cast("long"), "net": F.lit(100.0), "positive": F.lit(100.0)})
    told = days.unionByName(whole).groupBy("day").agg(F.max("n").alias("n_slots"), *[rnd(c, 4).alias(k) for k, c in {
        "excess": F.avg("excess"), "excess_sd": F.coalesce(F.stddev_samp("excess"), F.lit(0.0)), "net_share": F.avg("net"), "positive_share": F.avg("positive"), "net_min": F.min("net"), "net_max": F.max("net")}.items()])
    return told


@query(f"{PRED}{_PEN}, po AS (SELECT series_id, slot_idx, day, avg(penalty) AS penalty FROM pn GROUP BY ALL), al AS (SELECT 'day ' || day AS period, penalty FROM po UNION ALL SELECT 'zoom', penalty FROM po WHERE day IN (22, 23) UNION ALL SELECT 'whole week', penalty FROM po), pp AS (SELECT period, count(*) AS n_slots, avg(penalty) AS per_slot, sum(penalty) AS total FROM al GROUP BY ALL), sd AS (SELECT 'seed ' || seed AS period, count(*) AS n_slots, avg(penalty) AS per_slot, sum(penalty) FILTER (day IN (22, 23)) AS total, sum(penalty) AS week FROM pn GROUP BY ALL) SELECT period, n_slots, round(per_slot, 6) AS per_slot, round(total, 4) AS total, round(100 * total / nullif((SELECT total FROM pp WHERE period = 'whole week'), 0), 4) AS share FROM pp UNION ALL SELECT period, n_slots, round(per_slot, 6), round(total, 4), round(100 * total / nullif(week, 0), 4) FROM sd")
def calendar_penalty(spark, d):
    """What the calendar costs one model: by day, on the zoom days and over the week, of the errors' means over seeds (pooled share); and each seed's share on the zoom days."""
    p = _paired(spark, d, "cal", "ar1").withColumn("penalty", F.col("ea") - F.col("eb"))
    zoom = F.col("day").isin(*ZOOM)
    pooled = p.groupBy("series_id", "slot_idx", "day").agg(F.avg("penalty").alias("penalty"))
    periods = F.filter(F.array(F.concat(F.lit("day "), F.col("day")), F.when(zoom, "zoom"), F.lit("whole week")), lambda x: x.isNotNull())
    by = pooled.select(F.explode(periods).alias("period"), "penalty").groupBy("period").agg(F.count("*").alias("n_slots"), F.avg("penalty").alias("per_slot"), F.sum("penalty").alias("total"))
    week = F.broadcast(pooled.agg(F.sum("penalty").alias("week")))  # one row
    seeds = p.groupBy(F.concat(F.lit("seed "), F.col("seed")).alias("period")).agg(F.count("*").alias("n_slots"), F.avg("penalty").alias("per_slot"), F.sum(F.when(zoom, F.col("penalty"))).alias("total"), F.sum("penalty").alias("week"))
    both = by.join(week).unionByName(seeds)
    return both.select("period", "n_slots", rnd("per_slot").alias("per_slot"), rnd("total", 4).alias("total"), rnd(100 * F.try_divide("total", "week"), 4).alias("share"))


@query(f"{PRED}{_PEN} SELECT series_id, seed, count(*) AS n, round(sum(penalty), 4) AS total FROM pn GROUP BY ALL")
def paired_runs(spark, d):
    """A model with the calendar and without it, by slot and seed."""
    return _paired(spark, d, "cal", "ar1").groupBy("series_id", F.col("seed").cast("long").alias("seed")).agg(F.count("*").alias("n"), rnd(F.sum(F.col("ea") - F.col("eb")), 4).alias("total"))


_RES = ", rs AS (SELECT *, value - y_pred AS res, value - lag(value) OVER (PARTITION BY series_id, model, seed ORDER BY slot_idx) AS step FROM ev)"


def _residuals(spark, d):
    w = Window.partitionBy("series_id", "model", "seed").orderBy("slot_idx")
    return evals(spark, d).withColumn("res", F.col("value") - F.col("y_pred")).withColumn("step", F.col("value") - F.lag("value").over(w))


@query(f"{PRED}{_RES} SELECT series_id, model, round(avg(res), 6) AS me, round(stddev_samp(res), 6) AS sd, round(corr(res, step), 6) AS r, round(avg(abs(step)), 6) AS mean_step FROM rs WHERE seed = 0 GROUP BY ALL")
def residual_diagnostics(spark, d):
    return _residuals(spark, d).filter("seed = 0").groupBy("series_id", "model").agg(rnd(F.avg("res")).alias("me"), rnd(F.stddev_samp("res")).alias("sd"), rnd(F.corr("res", "step")).alias("r"), rnd(F.avg(F.abs("step"))).alias("mean_step"))


@query(f"{PRED}{_RES} SELECT series_id, model, round(100 * power(avg(res), 2) / nullif(avg(power(res, 2)), 0), 6) AS share FROM rs GROUP BY ALL")
def bias_share(spark, d):
    return _residuals(spark, d).groupBy("series_id", "model").agg(rnd(100 * F.try_divide(F.avg("res") * F.avg("res"), F.avg(F.col("res") * F.col("res")))).alias("share"))


@query(f"{PRED}{_RES} SELECT series_id, model, CASE WHEN max(res) - min(res) > 1e-9 * greatest(abs(avg(res)), 1) THEN round(corr(res, step), 6) END AS r FROM rs GROUP BY ALL")
def safe_corr(spark, d):
    return _residuals(spark, d).groupBy("series_id", "model").agg(F.when(F.max("res") - F.min("res") > 1e-9 * F.greatest(F.abs(F.avg("res")), F.lit(1.0)), rnd(F.corr("res", "step"))).alias("r"))


@query(f"{PRED} SELECT series_id, slot_idx, model, round(value - y_pred, 6) AS error FROM ev WHERE seed = 0 AND slot_idx // 24 IN (22, 23)")
def signed_error_series(spark, d):
    return evals(spark, d).filter("seed = 0").filter(F.floor(F.col("slot_idx") / 24).isin(22, 23)).select("series_id", "slot_idx", "model", rnd(F.col("value") - F.col("y_pred")).alias("error"))


_POOL = ", po AS (SELECT series_id, slot_idx, any_value(value) AS value, sum(abs(value - y_pred)) AS err FROM ev GROUP BY ALL)"


def _pooled(spark, d):
    return evals(spark, d).groupBy("series_id", "slot_idx").agg(F.first("value").alias("value"), F.sum(F.abs(F.col("value") - F.col("y_pred"))).alias("err"))


@query(f"{PRED}{_POOL}, st AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY slot_idx) AS step FROM po), fm AS (SELECT series_id, slot_idx, {', '.join(f"round(avg(y_pred) FILTER (model = '{k}'), 6) AS {k}" for k in MODELS)} FROM ev GROUP BY ALL) SELECT series_id, slot_idx, round(value, 6) AS value, round(step, 6) AS step, round(err, 6) AS err, {', '.join(MODELS)} FROM st JOIN fm USING (series_id, slot_idx) ORDER BY round(err, 6) DESC, series_id, slot_idx LIMIT 10")
def worst_slots(spark, d):
    """The slots of largest pooled error, with the step from the slot before and each model's mean forecast."""
    forecasts = [rnd(F.avg(F.when(F.col("model") == k, F.col("y_pred")))).alias(k) for k in MODELS]
    po = evals(spark, d).groupBy("series_id", "slot_idx").agg(F.first("value").alias("value"), F.sum(F.abs(F.col("value") - F.col("y_pred"))).alias("err"), *forecasts)
    st = po.withColumn("step", F.col("value") - F.lag("value").over(Window.partitionBy("series_id").orderBy("slot_idx")))
    return st.select("series_id", "slot_idx", rnd("value").alias("value"), rnd("step").alias("step"), rnd("err").alias("err"), *MODELS).orderBy(F.desc("err"), "series_id", "slot_idx").limit(10)


@query(f"{PRED}{_POOL}, rk AS (SELECT *, row_number() OVER (ORDER BY err DESC, series_id, slot_idx) AS k FROM po) SELECT c AS worst, round(sum(err) FILTER (k <= c) / nullif(sum(err), 0), 6) AS share FROM rk, (VALUES (10), (50), (101)) v(c) GROUP BY ALL")
def error_concentration(spark, d):
    p = S.prefix_sums(_pooled(spark, d), ["-err", "series_id", "slot_idx"], "err")
    return p.withColumn("worst", F.explode(F.array(F.lit(10), F.lit(50), F.lit(101)))).groupBy("worst").agg(rnd(F.sum(F.when(F.col("rank") <= F.col("worst"), F.col("err"))) / F.nullif(F.sum("err"), F.lit(0.0))).alias("share"))


@query(f"{PRED}{_POOL}, rk AS (SELECT *, row_number() OVER (ORDER BY value DESC, series_id, slot_idx) AS k, count(*) OVER () AS n FROM po) SELECT round(sum(err) FILTER (k <= greatest(1, round_even(0.05 * n, 0))) / sum(err), 6) AS share FROM rk")
def error_by_level(spark, d):
    p = S.prefix_sums(_pooled(spark, d), ["-value", "series_id", "slot_idx"], "err")
    n = F.broadcast(_pooled(spark, d).agg(F.greatest(F.lit(1), F.bround(0.05 * F.count("*"))).alias("top")))
    return p.join(n).agg(rnd(F.sum(F.when(F.col("rank") <= F.col("top"), F.col("err"))) / F.nullif(F.sum("err"), F.lit(0.0))).alias("share"))


@query(f"{PRED} SELECT model, slot_idx % 24 AS hour, round(avg(mae), 6) AS mae, round(avg(level), 6) AS level FROM (SELECT model, slot_idx, seed, avg(abs(value - y_pred)) AS mae, avg(value) AS level FROM ev GROUP BY ALL) GROUP BY ALL")
def error_by_hour(spark, d):
    one = evals(spark, d).groupBy("model", (F.col("slot_idx") % 24).alias("hour"), "seed").agg(F.avg(F.abs(F.col("value") - F.col("y_pred"))).alias("mae"), F.avg("value").alias("level"))
    return one.groupBy("model", "hour").agg(rnd(F.avg("mae")).alias("mae"), rnd(F.avg("level")).alias("level"))


@query(f"{PRED} SELECT model, seed, count(*) AS pairs, round(sum(abs(value - y_pred)), 4) AS error FROM ev GROUP BY ALL")
def truth_pred_join(spark, d):
    """Truth met with forecasts that come without it; a slot that either side lacks is an error."""
    e = channels(spark, d).filter("slot_idx between 504 and 671").select("series_id", "slot_idx", "value")
    told = M.paired(e, evals(spark, d).drop("value", "split"), ["series_id", "slot_idx"])
    return told.groupBy("model", F.col("seed").cast("long").alias("seed")).agg(F.count("*").alias("pairs"), rnd(F.sum(F.abs(F.col("value") - F.col("y_pred"))), 4).alias("error"))


@query(f"{PRED} SELECT * FROM (VALUES ('lstm'), ('tcn')) v(model)")
def missing_models(spark, d):
    wanted = spark.createDataFrame([(m,) for m in ("naive", "lstm", "tcn", "ar1")], "model string")
    return wanted.join(preds(spark, d).select("model").distinct(), "model", "left_anti")


@query(f"{PRED} SELECT model, seed, count(DISTINCT slot_idx) AS n, count(DISTINCT slot_idx) = 168 AS whole FROM ev GROUP BY ALL")
def step_guard(spark, d):
    return evals(spark, d).groupBy("model", "seed").agg(F.countDistinct("slot_idx").alias("n")).withColumn("whole", F.col("n") == 168)


# --- tests

_D = ", dd AS (SELECT a.series_id, a.slot_idx, a.la - b.la AS d FROM (SELECT series_id, slot_idx, avg(abs(value - y_pred)) AS la FROM ev WHERE model = 'seasonal' GROUP BY ALL) a JOIN (SELECT series_id, slot_idx, avg(abs(value - y_pred)) AS la FROM ev WHERE model = 'ar1' GROUP BY ALL) b USING (series_id, slot_idx)), dm AS (SELECT series_id, slot_idx, d, d - avg(d) OVER (PARTITION BY series_id) AS u FROM dd), ga AS (SELECT a.series_id, k AS lag, sum(a.u * b.u) AS g FROM dm a, range(0, 145) q(k) JOIN dm b ON a.series_id = b.series_id AND b.slot_idx = a.slot_idx - k GROUP BY ALL), mn AS (SELECT series_id, avg(d) AS mean, count(*) AS n FROM dd GROUP BY ALL)"
_TAIL = "(1 / (1 + 0.3275911 * abs(t) / sqrt(2)) * (0.254829592 + 1 / (1 + 0.3275911 * abs(t) / sqrt(2)) * (-0.284496736 + 1 / (1 + 0.3275911 * abs(t) / sqrt(2)) * (1.421413741 + 1 / (1 + 0.3275911 * abs(t) / sqrt(2)) * (-1.453152027 + 1 / (1 + 0.3275911 * abs(t) / sqrt(2)) * 1.061405429)))) * exp(-t * t / 2))"


def _hac_sql(lag: int) -> str:
    return f"(SELECT series_id, n, mean, sqrt(sum(CASE WHEN lag = 0 THEN g ELSE 2 * (1 - lag / {lag + 1}.0) * g END) / (n * n)) AS se FROM ga JOIN mn USING (series_id) WHERE lag <= {lag} GROUP BY series_id, n, mean)"


def loss_difference(scored, a: str, b: str):
    """Seed-averaged absolute loss of a minus that of b, by slot (D1)."""
    one = scored.groupBy("series_id", "slot_idx", "model").agg(F.avg(F.abs(F.col("value") - F.col("y_pred"))).alias("loss"))
    return one.groupBy("series_id", "slot_idx").agg((F.max(F.when(F.col("model") == a, F.col("loss"))) - F.max(F.when(F.col("model") == b, F.col("loss")))).alias("d"))


@query(f"{PRED}{_D} SELECT series_id, slot_idx, round(d, 6) AS d FROM dd")
def seed_averaged_loss(spark, d):
    return loss_difference(evals(spark, d), "seasonal", "ar1").withColumn("d", rnd("d"))


@query(f"{PRED} SELECT series_id, slot_idx, model, round(abs(any_value(value) - avg(y_pred)), 6) AS loss FROM ev GROUP BY series_id, slot_idx, model")
def ensemble_loss(spark, d):
    return evals(spark, d).groupBy("series_id", "slot_idx", "model").agg(rnd(F.abs(F.first("value") - F.avg("y_pred"))).alias("loss"))


_P = lambda t: _TAIL.replace("abs(t)", f"abs({t})").replace("-t * t", f"-({t}) * ({t})")
_HLN = "sqrt(n / (n - 1.0))"  # of the error, for small samples


def _grid_sql(lags=L.GRID) -> str:
    return " UNION ALL ".join(f"SELECT {k}::BIGINT AS lag, *, mean / se AS t, mean / (se * {_HLN}) AS ht FROM {_hac_sql(k)}" for k in lags)


def dm_rows(spark, d):
    """Tests of seasonal against ar1 at all lags of interest."""
    return L.dm_tests(loss_difference(evals(spark, d), "seasonal", "ar1"), ["series_id"])


@query(f"{PRED}{_D}, h AS ({_grid_sql((8,))}) SELECT series_id, lag, n, round(mean, 6) AS mean, round(se, 6) AS se, round(t, 4) AS t, round({_P('t')}, 6) AS p, round(mean - 1.959963984540054 * se, 6) AS lo, round(mean + 1.959963984540054 * se, 6) AS hi, round(se * {_HLN}, 6) AS hln_se, round(ht, 4) AS hln_t, round({_P('ht')}, 6) AS hln_p, round(mean - 1.959963984540054 * se * {_HLN}, 6) AS hln_lo, round(mean + 1.959963984540054 * se * {_HLN}, 6) AS hln_hi FROM h")
def dm_test(spark, d):
    """At the rule-of-thumb lag, with the interval, without and with the small-sample factor."""
    digits = {"mean": 6, "se": 6, "t": 4, "p": 6, "lo": 6, "hi": 6}
    digits |= {f"hln_{k}": v for k, v in digits.items() if k != "mean"}
    return dm_rows(spark, d).filter("rule = 'newey_west'").select("series_id", "lag", "n", *[rnd(c, k).alias(c) for c, k in digits.items()])


@query(f"{PRED}{_D}, h AS ({_grid_sql()}) SELECT series_id, lag, round(t, 4) AS t, round({_P('t')}, 6) AS p, round({_P('ht')}, 6) AS hln_p FROM h")
def lag_grid(spark, d):
    return dm_rows(spark, d).filter("rule = 'grid'").select("series_id", "lag", rnd("t", 4).alias("t"), rnd("p").alias("p"), rnd("hln_p").alias("hln_p"))


@query(f"{PRED}{_D}, h AS ({_grid_sql()}), hp AS (SELECT series_id, lag, {_P('ht')} AS p FROM h) SELECT series_id, (min(p) < 0.05) <> (max(p) < 0.05) AS sensitive, round(min(p), 6) AS least_p, round(max(p), 6) AS most_p FROM hp GROUP BY ALL")
def lag_sensitive(spark, d):
    """Whether the verdict at 0.05 is the same at every lag of the grid."""
    h = dm_rows(spark, d).filter("rule = 'grid'")
    return h.groupBy("series_id").agg(((F.min("hln_p") < 0.05) != (F.max("hln_p") < 0.05)).alias("sensitive"), rnd(F.min("hln_p")).alias("least_p"), rnd(F.max("hln_p")).alias("most_p"))


@query(f"{PRED}{_D} SELECT series_id, floor(1.1447 * power(4 * r * r / (power(1 - r, 2) * power(1 + r, 2)) * n, 1.0 / 3))::BIGINT AS lag FROM (SELECT a.series_id, least(0.97, greatest(-0.97, sum(a.u * b.u) / sum(b.u * b.u))) AS r, any_value(n) AS n FROM dm a JOIN dm b ON a.series_id = b.series_id AND b.slot_idx = a.slot_idx - 1 JOIN mn ON mn.series_id = a.series_id GROUP BY ALL)")
def andrews_lag(spark, d):
    return dm_rows(spark, d).filter("rule = 'andrews'").select("series_id", "lag")


_HALF = " + ".join(f"power(q / 2, {i}) / {factorial(i)}" for i in range(12))


@query(f"{PRED}{_D}, ac AS (SELECT series_id, lag, g / max(g) FILTER (lag = 0) OVER (PARTITION BY series_id) AS r FROM ga WHERE lag <= 24), lb AS (SELECT series_id, n * (n + 2) * sum(r * r / (n - lag)) FILTER (lag > 0) AS q FROM ac JOIN mn USING (series_id) GROUP BY series_id, n) SELECT series_id, lag, round(r, 6) AS acf, round(q, 4) AS q, round(exp(-q / 2) * ({_HALF}), 6) AS p FROM ac JOIN lb USING (series_id)")
def ljung_box(spark, d):
    """Autocorrelations of the loss difference through lag 24, with Q and its p."""
    b = L.ljung_box(loss_difference(evals(spark, d), "seasonal", "ar1"), ["series_id"])
    return b.select("series_id", F.posexplode("acf").alias("lag", "r"), "q", "p").select("series_id", F.col("lag").cast("long").alias("lag"), rnd("r").alias("acf"), rnd("q", 4).alias("q"), rnd("p").alias("p"))


_HOLM = f"{PRED}{_D}, h AS (SELECT *, mean / se AS t FROM {_hac_sql(8)}), hp AS (SELECT series_id, se, n, mean, {_TAIL} AS p, row_number() OVER (ORDER BY {_TAIL}, series_id) AS k, count(*) OVER () AS m FROM h)"


def _tests(spark, d):
    return dm_rows(spark, d).filter("rule = 'newey_west'")


@query(f"{_HOLM} SELECT series_id, round(least(1, max((m - k + 1) * p) OVER (ORDER BY k)), 6) AS p_holm FROM hp")
def holm(spark, d):
    return I.holm(_tests(spark, d), [], "p", "series_id").select("series_id", rnd("p_holm").alias("p_holm"))


@query(f"{_HOLM} SELECT series_id, round(CASE WHEN mean < 0 THEN p / 2 ELSE 1 - p / 2 END, 6) AS p_one FROM hp")
def one_sided_p(spark, d):
    return _tests(spark, d).select("series_id", rnd(F.when(F.col("mean") < 0, F.col("p") / 2).otherwise(1 - F.col("p") / 2)).alias("p_one"))


@query(f"{_HOLM} SELECT round(max(CASE WHEN mean < 0 THEN p / 2 ELSE 1 - p / 2 END), 6) AS p FROM hp")
def intersection_union(spark, d):
    return one_sided_p(spark, d).agg(F.max("p_one").alias("p"))


@query(f"{_HOLM} SELECT series_id, round((1.959963984540054 + 0.8416212335729143) * se, 6) AS detectable, round(n * power((1.959963984540054 + 0.8416212335729143) * se / nullif(mean, 0), 2), 2) AS required FROM hp")
def min_detectable(spark, d):
    m = (I.Z95 + I.Z80) * F.col("se")
    return _tests(spark, d).select("series_id", rnd(m).alias("detectable"), rnd(F.col("n") * F.pow(F.try_divide(m, F.abs("mean")), F.lit(2.0)), 2).alias("required"))


# --- series diagnostics

_ACF = ", u AS (SELECT series_id, slot_idx, value - avg(value) OVER (PARTITION BY series_id) AS u FROM e), ac AS (SELECT a.series_id, k AS lag, sum(a.u * b.u) / any_value(s.g0) AS acf, 720 AS n FROM u a, range(0, 49) q(k) JOIN u b ON a.series_id = b.series_id AND b.slot_idx = a.slot_idx - k JOIN (SELECT series_id, sum(u * u) AS g0 FROM u GROUP BY ALL) s ON s.series_id = a.series_id GROUP BY ALL)"


def _acf(spark, d):
    return L.autocorrelation(channels(spark, d), ["series_id"], 48)


@query(f"{_ACF} SELECT series_id, lag, round(acf, 6) AS acf, abs(acf) > 1.96 / sqrt(n) AS significant FROM ac")
def acf(spark, d):
    return _acf(spark, d).select("series_id", F.col("lag").cast("long").alias("lag"), rnd("acf").alias("acf"), (F.abs("acf") > 1.96 / F.sqrt("n")).alias("significant"))


@query(f"{_ACF} SELECT series_id, max(lag) FILTER (lag > 0 AND abs(acf) > 1.96 / sqrt(n)) AS last_band, max(lag) FILTER (lag > 0 AND abs(acf) > 0.05) AS last_practical FROM ac GROUP BY ALL")
def last_significant_lag(spark, d):
    a = _acf(spark, d).filter("lag > 0").withColumn("lag", F.col("lag").cast("long"))
    return a.groupBy("series_id").agg(F.max(F.when(F.abs("acf") > 1.96 / F.sqrt("n"), F.col("lag"))).alias("last_band"), F.max(F.when(F.abs("acf") > 0.05, F.col("lag"))).alias("last_practical"))


@query(f"{_ACF} SELECT series_id, count(*) FILTER (abs(acf) > 0.05) AS n, round(count(*) FILTER (abs(acf) > 0.05) / count(*), 6) AS share FROM ac WHERE lag BETWEEN 10 AND 40 GROUP BY ALL")
def exceedance_summary(spark, d):
    c = F.count_if(F.abs("acf") > 0.05)
    return _acf(spark, d).filter("lag between 10 and 40").groupBy("series_id").agg(c.alias("n"), rnd(c / F.count("*")).alias("share"))


#: five-minute slots, for lags that hourly ones are too few for; slices sl, their partial autocorrelations lev
FINE = SeriesSpec(slot_s=300, n_slots=8640, season=288, week=2016, bounds=(4032, 6048, 8064))
SLICES = {"train": FINE.bounds[0], "full": FINE.n_slots}
FAR = 2000


def _partials_sql(lags: int, slices: str) -> str:
    return f""", rf AS (SELECT channel, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 300) AS BIGINT) AS slot_idx, value FROM r), gf AS (SELECT channel, slot_idx, sum(coalesce(value, 0)) AS value FROM rf GROUP BY ALL),
ef AS (SELECT c.channel AS series_id, s.slot_idx, coalesce(value, 0.0) AS value FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) c(channel) CROSS JOIN range(0, 8640) s(slot_idx) LEFT JOIN gf USING (channel, slot_idx)),
sl AS (SELECT series_id, slice, slot_idx, value - avg(value) OVER (PARTITION BY series_id, slice) AS u FROM ef JOIN (VALUES {slices}) q(slice, m) ON slot_idx < m),
us AS (SELECT series_id, slice, count(*) AS n, list(u ORDER BY slot_idx) AS us FROM sl GROUP BY ALL),
gk AS (SELECT series_id, slice, n, k, list_dot_product(us[k + 1:], us[1:n - k]) AS g FROM us, range(0, {lags + 1}) q(k)),
rk AS (SELECT series_id, slice, n, list(g / g0 ORDER BY k) AS r FROM (SELECT *, max(g) FILTER (k = 0) OVER (PARTITION BY series_id, slice) AS g0 FROM gk) GROUP BY ALL),
lev AS (SELECT series_id, slice, 1 AS lag, r[2] AS p, [r[2]] AS phi, 1 - r[2] * r[2] AS free, r FROM rk
UNION ALL SELECT series_id, slice, lag + 1, new, list_append(list_transform(list_zip(phi, list_reverse(phi)), lambda z: z[1] - new * z[2]), new), free * (1 - new * new), r FROM (SELECT *, (r[lag + 2] - list_dot_product(phi, list_reverse(r[2:lag + 1]))) / free AS new FROM lev WHERE lag < {lags}))"""


def _slices(spark, d):
    """The channels in five-minute slots, as slices of their record."""
    e = P.channel_panel(spark, d, FINE)
    inside = F.filter(F.array(*[F.when(F.col("slot_idx") < m, F.lit(k)) for k, m in SLICES.items()]), lambda x: x.isNotNull())
    return e.select("series_id", F.explode(inside).alias("slice"), "slot_idx", "value")


def pacf_rows(spark, d, lags: int = 1100):
    return L.partials(_slices(spark, d).filter("slice = 'train'"), ["series_id"], lags)


@query(_partials_sql(1100, "('train', 4032)") + " SELECT series_id, CAST(lag AS BIGINT) AS lag, round(r[lag + 1], 6) AS acf, round(p, 6) AS pacf, abs(p) > 1.96 / sqrt(4032) AS significant FROM lev")
def pacf(spark, d):
    """Through lag 1,100, of the training slice."""
    return pacf_rows(spark, d).select("series_id", "lag", rnd("acf").alias("acf"), rnd("pacf").alias("pacf"), (F.abs("pacf") > 1.96 / F.sqrt("n")).alias("significant"))


@query(_partials_sql(1100, "('train', 4032)") + " SELECT series_id, CAST(lag AS BIGINT) AS lag, round(p, 4) AS pacf FROM lev WHERE lag BETWEEN 301 AND 1100 AND abs(p) > 0.05")
def isolated_partials(spark, d):
    """Lags far out whose partial autocorrelation matters in practice."""
    return pacf_rows(spark, d).filter("lag between 301 and 1100 and abs(pacf) > 0.05").select("series_id", "lag", rnd("pacf", 4).alias("pacf"))


@query(_partials_sql(FAR, "('train', 4032), ('full', 8640)") + f" SELECT series_id, slice, n, max(lag) FILTER (abs(p) > 0.05) AS last_practical, round(1.96 / sqrt(n), 4) AS band FROM lev JOIN us USING (series_id, slice) GROUP BY series_id, slice, n")
def pacf_slices(spark, d):
    """The last lag through 2,000 that matters in practice, of the training slice and of the whole record."""
    p = L.partials(_slices(spark, d), ["series_id", "slice"], FAR)
    return p.groupBy("series_id", "slice", "n").agg(F.max(F.when(F.abs("pacf") > 0.05, F.col("lag"))).alias("last_practical"), rnd(1.96 / F.sqrt("n"), 4).alias("band"))


_DEC = ", tr AS (SELECT series_id, slot_idx, value, CASE WHEN slot_idx BETWEEN 12 AND 707 THEN (sum(value) OVER (PARTITION BY series_id ORDER BY slot_idx ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING) + 0.5 * (lag(value, 12) OVER w + lead(value, 12) OVER w)) / 24 END AS trend FROM e WINDOW w AS (PARTITION BY series_id ORDER BY slot_idx)), ph AS (SELECT series_id, slot_idx % 24 AS phase, avg(value - trend) AS s FROM tr GROUP BY ALL), de AS (SELECT tr.series_id, slot_idx, value, trend, s - avg_s AS seasonal, value - trend - (s - avg_s) AS remainder FROM tr JOIN ph ON tr.series_id = ph.series_id AND slot_idx % 24 = phase JOIN (SELECT series_id, avg(s) AS avg_s FROM ph GROUP BY ALL) q ON q.series_id = tr.series_id)"


def decompose(e, period: int, value: str = "value"):
    """Trend, seasonal and remainder of the classical decomposition (T7)."""
    w = Window.partitionBy("series_id").orderBy("slot_idx")
    tr = e.withColumn("trend", S.centred_average(value, period, w)).withColumn("phase", F.col("slot_idx") % period)
    ph = tr.groupBy("series_id", "phase").agg(F.avg(F.col(value) - F.col("trend")).alias("s"))
    ph = ph.withColumn("seasonal", F.col("s") - F.avg("s").over(Window.partitionBy("series_id"))).drop("s")
    return tr.join(ph, ["series_id", "phase"]).withColumn("remainder", F.col(value) - F.col("trend") - F.col("seasonal")).drop("phase")


@query(f"{_DEC} SELECT series_id, slot_idx, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(remainder, 6) AS remainder FROM de")
def decompose_classical(spark, d):
    return decompose(channels(spark, d), 24).select("series_id", "slot_idx", rnd("trend").alias("trend"), rnd("seasonal").alias("seasonal"), rnd("remainder").alias("remainder"))


@query(f"{_DEC} SELECT series_id, count(*) AS n_valid, round(var_pop(trend) / nullif(var_pop(value), 0), 6) AS trend, round(var_pop(seasonal) / nullif(var_pop(value), 0), 6) AS seasonal, round(var_pop(remainder) / nullif(var_pop(value), 0), 6) AS remainder FROM de WHERE trend IS NOT NULL GROUP BY ALL")
def variance_shares(spark, d):
    x = decompose(channels(spark, d), 24).filter("trend is not null")
    return x.groupBy("series_id").agg(F.count("*").alias("n_valid"), *[rnd(F.try_divide(F.var_pop(c), F.var_pop("value"))).alias(c) for c in ("trend", "seasonal", "remainder")])


_WEEKLY = ", aj AS (SELECT series_id, slot_idx, seasonal AS day, value - seasonal AS v FROM de), t2 AS (SELECT series_id, slot_idx, day, v, CASE WHEN slot_idx BETWEEN 84 AND 635 THEN (sum(v) OVER (PARTITION BY series_id ORDER BY slot_idx ROWS BETWEEN 83 PRECEDING AND 83 FOLLOWING) + 0.5 * (lag(v, 84) OVER w + lead(v, 84) OVER w)) / 168 END AS trend FROM aj WINDOW w AS (PARTITION BY series_id ORDER BY slot_idx)), p2 AS (SELECT series_id, slot_idx % 168 AS phase, avg(v - trend) AS s FROM t2 GROUP BY ALL), w2 AS (SELECT series_id, phase, s - avg(s) OVER (PARTITION BY series_id) AS week FROM p2)"


@query(f"{_DEC}{_WEEKLY} SELECT t2.series_id, slot_idx, round(day, 6) + 0.0 AS seasonal_day, round(week, 6) + 0.0 AS seasonal_week, round(trend, 6) + 0.0 AS trend, round(v - trend - week, 6) + 0.0 AS remainder FROM t2 JOIN w2 ON t2.series_id = w2.series_id AND slot_idx % 168 = phase")
def decompose_multi(spark, d):
    day = decompose(channels(spark, d), 24).withColumn("adjusted", F.col("value") - F.col("seasonal")).select("series_id", "slot_idx", "value", F.col("seasonal").alias("seasonal_day"), "adjusted")
    return decompose(day, 168, "adjusted").select("series_id", "slot_idx", rnd("seasonal_day").alias("seasonal_day"), rnd("seasonal").alias("seasonal_week"), rnd("trend").alias("trend"), rnd("remainder").alias("remainder"))


@query(f"{_DEC}, u AS (SELECT series_id, slot_idx, remainder - avg(remainder) OVER (PARTITION BY series_id) AS u FROM de WHERE remainder IS NOT NULL) SELECT a.series_id, k AS lag, round(sum(a.u * b.u) / any_value(s.g), 6) AS acf FROM u a, (VALUES (1), (24)) q(k) JOIN u b ON a.series_id = b.series_id AND b.slot_idx = a.slot_idx - k JOIN (SELECT series_id, sum(u * u) AS g FROM u GROUP BY ALL) s ON s.series_id = a.series_id GROUP BY ALL")
def remainder_acf(spark, d):
    x = decompose(channels(spark, d), 24).filter("remainder is not null")
    return L.autocorrelation(x, ["series_id"], 24, "remainder").filter("lag in (1, 24)").select("series_id", "lag", rnd("acf").alias("acf"))


#: variants v of a series; kp: both forms of the test, with a lag of the series' own
KPSS_SQL = """, v AS (SELECT series_id, 'raw' AS variant, slot_idx, value FROM e UNION ALL SELECT series_id, 'log1p', slot_idx, ln(1 + value) FROM e UNION ALL SELECT series_id, 'diff1', slot_idx, value - lag(value) OVER (PARTITION BY series_id ORDER BY slot_idx) FROM e UNION ALL SELECT series_id, 'sdiff', slot_idx, value - lag(value, 24) OVER (PARTITION BY series_id ORDER BY slot_idx) FROM e),
tt AS (SELECT series_id, variant, value, row_number() OVER (PARTITION BY series_id, variant ORDER BY slot_idx) AS t FROM v WHERE value IS NOT NULL),
lf AS (SELECT series_id, variant, count(*) AS n, avg(value) AS m, regr_slope(value, t) AS s, regr_intercept(value, t) AS i FROM tt GROUP BY ALL),
ru AS (SELECT series_id, variant, 'c' AS form, n, t, value - m AS u FROM tt JOIN lf USING (series_id, variant) UNION ALL SELECT series_id, variant, 'ct', n, t, value - i - s * t FROM tt JOIN lf USING (series_id, variant)),
eta AS (SELECT series_id, variant, form, sum(s * s) / (n * n) AS eta FROM (SELECT *, sum(u) OVER (PARTITION BY series_id, variant, form ORDER BY t) AS s FROM ru) GROUP BY series_id, variant, form, n),
gq AS (SELECT series_id, variant, form, n, k, list_dot_product(us[k + 1:], us[1:n - k]) AS g FROM (SELECT series_id, variant, form, n, list(u ORDER BY t) AS us FROM ru GROUP BY ALL), range(0, 720) q(k) WHERE k < n),
ll AS (SELECT series_id, variant, form, least(n - 1, floor(1.1447 * power(power(sum(k * g) FILTER (k <= floor(power(n, 2.0 / 9))) / (n / 2.0) / (max(g) FILTER (k = 0) / n + sum(g) FILTER (k BETWEEN 1 AND floor(power(n, 2.0 / 9))) / (n / 2.0)), 2), 1.0 / 3) * power(n, 1.0 / 3)))::BIGINT AS lag FROM gq GROUP BY series_id, variant, form, n),
kq AS (SELECT series_id, variant, form, n, lag, eta / (sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / (lag + 1.0)) * g END) / n) AS kpss FROM gq JOIN ll USING (series_id, variant, form) JOIN eta USING (series_id, variant, form) WHERE k <= lag GROUP BY series_id, variant, form, n, lag, eta),
kp AS (SELECT *, CASE WHEN form = 'c' THEN CASE WHEN kpss <= 0.347 THEN 0.10 WHEN kpss <= 0.463 THEN 0.10 - 0.05 * (kpss - 0.347) / 0.116 WHEN kpss <= 0.574 THEN 0.05 - 0.025 * (kpss - 0.463) / 0.111 WHEN kpss <= 0.739 THEN 0.025 - 0.015 * (kpss - 0.574) / 0.165 ELSE 0.01 END
ELSE CASE WHEN kpss <= 0.119 THEN 0.10 WHEN kpss <= 0.146 THEN 0.10 - 0.05 * (kpss - 0.119) / 0.027 WHEN kpss <= 0.176 THEN 0.05 - 0.025 * (kpss - 0.146) / 0.030 WHEN kpss <= 0.216 THEN 0.025 - 0.015 * (kpss - 0.176) / 0.040 ELSE 0.01 END END AS kpss_p,
CASE WHEN form = 'c' THEN kpss < 0.347 OR kpss > 0.739 ELSE kpss < 0.119 OR kpss > 0.216 END AS capped FROM kq)"""


def variants(spark, d):
    w = Window.partitionBy("series_id").orderBy("slot_idx")
    v = F.col("value")
    kinds = {"raw": v, "log1p": F.when(v > -1, F.log1p(v)), "diff1": v - F.lag(v).over(w), "sdiff": v - F.lag(v, SPEC.season).over(w)}
    x = channels(spark, d).select("series_id", "slot_idx", *[c.alias(k) for k, c in kinds.items()])
    return x.unpivot(["series_id", "slot_idx"], list(kinds), "variant", "value").filter("value is not null")


@query(KPSS_SQL + " SELECT series_id, variant, form, n, lag, round(kpss, 5) AS kpss, round(kpss_p, 4) AS kpss_p, capped FROM kp")
def kpss(spark, d):
    """Around a level and around a line, of four variants of each series."""
    k = L.kpss(variants(spark, d), ["series_id", "variant"])
    return k.select("series_id", "variant", "form", "n", "lag", rnd("kpss", 5).alias("kpss"), rnd("kpss_p", 4).alias("kpss_p"), "capped")


# --- runs


@query(f"{PRED}, k AS (SELECT series_id AS area, model, avg(abs(value - y_pred)) FILTER (split = 'eval') AS test, avg(abs(value - y_pred)) FILTER (split = 'val') AS val, sqrt(avg(power(value - y_pred, 2)) FILTER (split = 'eval')) AS rmse FROM pr GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY round(test, 9), area, model) AS i FROM k) SELECT area, model, round(val, 6) AS val, round(test, 6) AS test, round(rmse, 6) AS rmse FROM o WHERE i = 1")
def log_row(spark, d):
    """The best forecaster on the test slots, with its validation error."""
    err = F.abs(F.col("value") - F.col("y_pred"))
    on = lambda split, x: F.avg(F.when(F.col("split") == split, x))
    k = preds(spark, d).groupBy(F.col("series_id").alias("area"), "model").agg(on("val", err).alias("val"), on("eval", err).alias("test"), F.sqrt(on("eval", err * err)).alias("rmse"))
    best = k.agg(F.min_by(F.struct("area", "model", "val", "test", "rmse"), F.struct(rnd("test", 9).alias("t"), "area", "model")).alias("b")).select("b.*")
    return best.select("area", "model", *[rnd(c).alias(c) for c in ("val", "test", "rmse")])


@query(f"{PRED} SELECT model, round(avg(mae), 6) AS mae FROM (SELECT model, seed, avg(abs(value - y_pred)) AS mae FROM ev WHERE series_id = 'view' GROUP BY ALL) GROUP BY ALL")
def per_area_table(spark, d):
    return _by_seed(spark, d).filter("series_id = 'view'").groupBy("model").agg(rnd(F.avg("mae")).alias("mae"))


@query(f"{PRED} SELECT series_id, slot_idx, model, round(y_pred, 6) AS y_pred FROM ev WHERE seed = 1 AND model IN ('cal', 'ar1')")
def predictions_select(spark, d):
    return evals(spark, d).filter("seed = 1 and model in ('cal', 'ar1')").select("series_id", "slot_idx", "model", rnd("y_pred").alias("y_pred"))


@query(f"{PRED}, k AS (SELECT 1 AS run, series_id, model, seed, avg(abs(value - y_pred)) AS mae FROM ev WHERE seed < 2 GROUP BY ALL UNION ALL SELECT 2, series_id, model, seed, 1 + avg(abs(value - y_pred)) FROM ev WHERE seed > 0 GROUP BY ALL) SELECT series_id, model, seed, round(arg_min(mae, run), 6) AS mae FROM k GROUP BY ALL")
def merge_runs(spark, d):
    m = _by_seed(spark, d).select("series_id", "model", "seed", "mae")
    both = m.filter("seed < 2").withColumn("run", F.lit(1)).unionByName(m.filter("seed > 0").withColumns({"run": F.lit(2), "mae": F.col("mae") + 1}))
    return both.groupBy("series_id", "model", "seed").agg(rnd(F.min_by("mae", "run")).alias("mae"))


@query("SELECT series_id AS area FROM e GROUP BY ALL HAVING count(DISTINCT slot_idx // 168) = 5 AND series_id > 'p'")
def common_area(spark, d):
    e = channels(spark, d).select(F.col("series_id").alias("area"), F.floor(F.col("slot_idx") / 168).alias("run"))
    return e.groupBy("area").agg(F.countDistinct("run").alias("n")).filter("n = 5 and area > 'p'").select("area")


@query("SELECT DISTINCT series_id AS area FROM e EXCEPT SELECT * FROM (VALUES ('click'), ('view'), ('other')) v(a)")
def spec_area_check(spark, d):
    wanted = spark.createDataFrame([("click",), ("view",), ("other",)], "area string")
    return channels(spark, d).select(F.col("series_id").alias("area")).distinct().exceptAll(wanted)


@query(f"{PRED} SELECT series_id, model FROM (SELECT DISTINCT series_id, model FROM ev) WHERE NOT (model = 'naive' AND series_id = 'view')")
def dedup_control(spark, d):
    m = evals(spark, d).select("series_id", "model").distinct()
    return m.subtract(m.filter("model = 'naive' and series_id = 'view'"))


@query(f"{PRED} SELECT family, count(*) AS n, round(avg(mae), 6) AS mae FROM (SELECT 'simple' AS family, avg(abs(value - y_pred)) AS mae FROM ev WHERE model IN ('naive', 'seasonal') GROUP BY series_id, model, seed UNION ALL SELECT 'fitted', avg(abs(value - y_pred)) FROM ev WHERE model = 'ar1' GROUP BY series_id, model, seed) GROUP BY ALL")
def family_union(spark, d):
    m = _by_seed(spark, d).select("model", "mae")
    both = m.filter("model in ('naive', 'seasonal')").select(F.lit("simple").alias("family"), "mae").unionByName(m.filter("model = 'ar1'").select(F.lit("fitted").alias("family"), "mae"))
    return both.groupBy("family").agg(F.count("*").alias("n"), rnd(F.avg("mae")).alias("mae"))


@query(f"{PRED}, k AS (SELECT series_id, model, CAST(2 + length(model) % 3 AS INT) AS places, avg(abs(value - y_pred)) AS now, avg(abs(value - y_pred)) FILTER (seed = 0) AS before FROM ev GROUP BY ALL) SELECT series_id, model, CAST(places AS BIGINT) AS places, round(now, places) AS derived, round(before, places) AS logged, round(now, places) <> round(before, places) AS drift FROM k")
def reconcile(spark, d):
    """A log in text, kept from a run of the seed 0 alone, against what all seeds give now, at the decimals that each entry was logged with."""
    path = shared_path(spark, "log")
    before = M.metrics(evals(spark, d).filter("seed = 0"), ["series_id", "model"])
    places = 2 + F.length("model") % 3
    text = F.format_string("%s", F.when(places == 2, F.format_string("%.2f", F.round("mae", 2))).when(places == 3, F.format_string("%.3f", F.round("mae", 3))).otherwise(F.format_string("%.4f", F.round("mae", 4))))
    before.select("series_id", "model", text.alias("logged")).write.json(path)
    log = spark.read.schema("series_id string, model string, logged string").json(path)
    return M.reconciled(M.metrics(evals(spark, d), ["series_id", "model"]), log, ["series_id", "model"], "mae")


@query(f"{PRED}, a AS (SELECT min(series_id) AS first FROM ev) SELECT * FROM (SELECT 'requested' AS rule, 'view' AS area UNION ALL SELECT 'control', 'error' UNION ALL SELECT 'first', first FROM a UNION ALL SELECT 'control of several', first FROM a)")
def focus_area(spark, d):
    """The area that a panel by day covers: as asked, or that of a control run over one area, or the first."""
    areas = evals(spark, d).select(F.col("series_id").alias("area")).distinct()
    one, two = areas.filter("area = 'error'"), areas.filter("area in ('click', 'error')")
    cases = {"requested": ("view", one), "control": (None, one), "first": (None, None), "control of several": (None, two)}
    return reduce(DataFrame.union, [M.focus_area(areas, asked, control).select(F.lit(rule).alias("rule"), "area") for rule, (asked, control) in cases.items()])


@query("SELECT min(slot_idx) AS lo, CASE WHEN min(slot_idx) < 336 THEN 'train' ELSE 'later' END AS split FROM e WHERE slot_idx >= 168")
def week_split(spark, d):
    lo = channels(spark, d).filter(P.day_of(F.col("slot_idx"), SPEC) >= F.lit("2024-01-08").cast("date")).agg(F.min("slot_idx").alias("lo"))
    return lo.select("lo", P.split_label(F.col("lo"), SPEC).alias("split"))
