"""Queries over stored files and runs, and tests that join several others."""

from __future__ import annotations

from math import factorial

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import forecast as M
from ..operators import inference as I
from ..operators import lags as L
from ..sources import stores
from ..sources.shared import shared_path
from ..spec import RESULT
from .common import SPEC, Register, cell_totals, channels, raw, rnd
from .models import _D, _HLN, _HOLM, _P, KPSS_SQL, PRED, dm_rows, evals, loss_difference, preds, variants

query = Register()
QUERIES, SQL = query.queries, query.sql
CHANNELS = dict(zip(SPEC.channels, ("sms_in", "sms_out", "call_in", "call_out", "internet"), strict=True))


def _path(spark) -> str:
    return shared_path(spark, "store")


def _files(spark, d):
    """The events as tab-separated files by day, scanned."""
    path = _path(spark)
    r = raw(spark, d)
    values = [F.when(F.col("channel") == c, F.col("value")).alias(name) for c, name in CHANNELS.items()]
    rows = r.select(F.col("series_id").cast("int").alias("square_id"), (1704067200000 + F.col("slot_idx") * 3600000).alias("time_interval"), F.lit(39).alias("country_code"), *values, F.date_format("ts", "yyyy-MM-dd").alias("date"))
    rows.repartition("date").write.partitionBy("date").option("sep", "\t").csv(path)
    return stores.scan_raw(spark, path)


_SUMS = ", ".join(f"round(sum(value) FILTER (channel = '{c}'), 4) AS {name}" for c, name in CHANNELS.items())


@query(f"SELECT series_id AS square_id, count(*) AS n, {_SUMS} FROM r GROUP BY ALL")
def scan_raw(spark, d):
    return _files(spark, d).groupBy("square_id").agg(F.count("*").alias("n"), *[rnd(F.sum(c), 4).alias(c) for c in CHANNELS.values()])


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM r GROUP BY ALL ORDER BY day LIMIT 7")
def scan_files(spark, d):
    return stores.first_days(_files(spark, d), 7).groupBy(F.col("file_date").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, min(slot_idx) // 24 AS first_day, max(slot_idx) // 24 AS last_day FROM r GROUP BY ALL")
def file_date(spark, d):
    of = F.floor((F.col("time_interval") - 1704067200000) / 86400000)
    return _files(spark, d).groupBy(F.col("file_date").cast("string").alias("day")).agg(F.min(of).alias("first_day"), F.max(of).alias("last_day"))


@query("SELECT series_id, slot_idx // 24 AS date, round(sum(value), 4) AS value FROM p GROUP BY ALL")
def daily_store(spark, d):
    """Written in two turns; the second adds the days that the first left out."""
    from .common import cells

    path = _path(spark)
    daily = cells(spark, d).groupBy("series_id", F.floor(F.col("slot_idx") / 24).alias("date")).agg(F.sum("value").alias("value"))
    stores.daily_store(daily.filter("date < 20"), path)
    return stores.daily_store(daily, path).select("series_id", F.col("date").cast("long").alias("date"), rnd("value", 4).alias("value"))


@query("SELECT series_id, row, col, round(total, 4) AS total FROM t")
def read_totals(spark, d):
    path = _path(spark)
    cell_totals(spark, d).write.parquet(path)
    return spark.read.parquet(path).select("series_id", "row", "col", rnd("total", 4).alias("total"))


def _stored(spark, d):
    runs = evals(spark, d).select(F.concat(F.lit("run-"), F.col("seed")).alias("run_id"), "series_id", "model", "seed", "slot_idx", "y_pred")
    path = _path(spark)
    stores.write_predictions(runs.filter("seed = 0"), path)
    return stores.write_predictions(runs.filter("seed > 0"), path)


@query(f"{PRED} SELECT 'run-' || seed AS run_id, model, count(*) AS n, round(sum(y_pred), 4) AS total FROM ev GROUP BY ALL")
def write_predictions(spark, d):
    return _stored(spark, d).groupBy("run_id", "model").agg(F.count("*").alias("n"), rnd(F.sum("y_pred"), 4).alias("total"))


@query(f"{PRED} SELECT 'run-' || seed AS run_id, model, round(avg(abs(value - y_pred)), 5) AS mae FROM ev GROUP BY ALL")
def predict_external(spark, d):
    """Stored predictions, whoever made them, are scored against the truth."""
    scored = channels(spark, d).join(_stored(spark, d), ["series_id", "slot_idx"])
    return M.metrics(scored, ["run_id", "model"]).select("run_id", "model", rnd("mae", 5).alias("mae"))


@query(f"{PRED} SELECT series_id, model, seed, split, round(avg(abs(value - y_pred)), 6) AS mae FROM pr WHERE split IN ('val', 'eval') GROUP BY ALL")
def run_grid(spark, d):
    return M.metrics(preds(spark, d).filter("split in ('val', 'eval')"), ["series_id", "model", "seed", "split"]).select("series_id", "model", "seed", "split", rnd("mae").alias("mae"))


@query(f"{PRED} SELECT series_id AS area, model, seed, round(avg(abs(value - y_pred)), 4) AS mae, round(sqrt(avg(power(value - y_pred, 2))), 4) AS rmse FROM ev GROUP BY ALL")
def results_frame(spark, d):
    return M.metrics(evals(spark, d), ["series_id", "model", "seed"]).select(F.col("series_id").alias("area"), "model", "seed", rnd("mae", 4).alias("mae"), rnd("rmse", 4).alias("rmse"))


@query(f"{PRED} SELECT model, round(avg(abs(value - y_pred)), 5) AS mae FROM ev GROUP BY ALL ORDER BY mae, model")
def metrics_sorted(spark, d):
    return M.metrics(evals(spark, d), ["model"]).select("model", rnd("mae", 5).alias("mae")).orderBy("mae", "model")


@query(f"{PRED} SELECT series_id, slot_idx, model, y_pred IS NOT NULL AND isfinite(y_pred) AS finite FROM pr WHERE seed = 0")
def finite_flag(spark, d):
    ok = ~F.isnan("y_pred") & (F.abs("y_pred") < float("inf"))
    return preds(spark, d).filter("seed = 0").select("series_id", "slot_idx", "model", F.coalesce(ok, F.lit(False)).alias("finite"))


@query("SELECT series_id, count(*) AS n, count(*) FILTER (slot_idx >= 24) AS usable, count(*) > 24 AS enough FROM e GROUP BY ALL")
def history_guard(spark, d):
    return channels(spark, d).groupBy("series_id").agg(F.count("*").alias("n"), F.count_if(F.col("slot_idx") >= SPEC.season).alias("usable")).withColumn("enough", F.col("n") > SPEC.season)


@query("SELECT series_id, floor(1.5 * power(count(*), 1.0 / 3))::BIGINT AS lag FROM e GROUP BY ALL")
def newey_west_lag(spark, d):
    return channels(spark, d).groupBy("series_id").agg(L.newey_west(F.count("*")).alias("lag"))


# --- runs


def _runs(spark, d):
    """Runs as files: one document a seed, with parameters and results; a fit counts as long as its error is large."""
    err = F.abs(F.col("value") - F.col("y_pred"))
    m = preds(spark, d).groupBy(F.col("series_id").alias("area"), "model", "seed").agg(F.avg(F.when(F.col("split") == "val", err)).alias("val"), F.avg(F.when(F.col("split") == "eval", err)).alias("mae"))
    epochs = F.when(F.col("model").isin("ar1", "cal"), 10.0 + F.col("seed"))
    m = m.withColumns({"n_params": F.when(F.col("model") == "ar1", 2).when(F.col("model") == "cal", 3).otherwise(0), "n_epochs": epochs, "s_per_epoch": F.when(epochs.isNotNull(), F.col("mae") / 100)})
    m = m.withColumns({"fit_s": F.coalesce(F.col("n_epochs") * F.col("s_per_epoch"), F.lit(0.0)), "predict_ms": F.col("mae") * 2, "latency_ms": F.col("mae") / 10})
    params = F.create_map(F.lit("kernel"), (F.col("seed") % 2 + 2).cast("string"), F.lit("levels"), F.lit("3"), F.lit("device"), F.col("seed").cast("string"))
    path = _path(spark)
    m.groupBy("seed").agg(F.collect_list(F.struct(*[f.name for f in RESULT])).alias("results")).select(F.concat(F.lit("run-"), F.col("seed")).alias("run_id"), params.alias("params"), "results").write.json(path)
    return stores.read_runs(spark, path)


#: the runs' results rn
_RUNS = f"{PRED}, rn AS (SELECT *, coalesce(n_epochs * mae / 100, 0) AS fit_s FROM (SELECT series_id AS area, model, seed, avg(abs(value - y_pred)) FILTER (split = 'val') AS val, avg(abs(value - y_pred)) FILTER (split = 'eval') AS mae, CASE WHEN model IN ('ar1', 'cal') THEN 10.0 + seed END AS n_epochs, CASE model WHEN 'ar1' THEN 2 WHEN 'cal' THEN 3 ELSE 0 END AS n_params FROM pr GROUP BY ALL))"


@query(f"{_RUNS}, k AS (SELECT area, model, count(*) AS n_seeds, CAST(max(n_params) AS BIGINT) AS n_params, avg(val) AS val, coalesce(stddev_samp(val), 0) AS val_sd, avg(mae) AS test, coalesce(stddev_samp(mae), 0) AS test_sd, avg(fit_s) AS fit_s FROM rn GROUP BY ALL) SELECT area, model, n_seeds, n_params, round(val, 6) AS val, round(val_sd, 6) AS val_sd, round(test, 6) AS test, round(test_sd, 6) AS test_sd, round(fit_s, 6) AS fit_s, row_number() OVER (PARTITION BY area ORDER BY round(val, 9), model) = 1 AS selected FROM k")
def compare_runs(spark, d):
    """Stored runs by area and model over their seeds; selected is the best of its area on validation, never on test."""
    k = _runs(spark, d).groupBy("area", "model").agg(F.count("*").alias("n_seeds"), F.max("n_params").cast("long").alias("n_params"), *[f.alias(n) for n, f in {
        "val": F.avg("val"), "val_sd": F.coalesce(F.stddev_samp("val"), F.lit(0.0)), "test": F.avg("mae"), "test_sd": F.coalesce(F.stddev_samp("mae"), F.lit(0.0)), "fit_s": F.avg("fit_s")}.items()])
    best = F.row_number().over(Window.partitionBy("area").orderBy(F.round("val", 9), "model")) == 1  # a row a model
    return k.withColumn("selected", best).select("area", "model", "n_seeds", "n_params", *[rnd(c).alias(c) for c in ("val", "val_sd", "test", "test_sd", "fit_s")], "selected")


@query(f"{_RUNS} SELECT model, CAST(max(n_params) AS BIGINT) AS n_params, round(avg(n_epochs), 4) AS epochs, round(avg(CASE WHEN n_epochs IS NOT NULL THEN mae / 100 END), 6) AS s_per_epoch, round(avg(fit_s), 6) AS fit_s, round(avg(mae * 2), 6) AS predict_ms, round(avg(mae / 10), 6) AS latency_ms FROM rn GROUP BY ALL")
def timing_table(spark, d):
    """Means over areas and seeds of what stored runs tell about time; epochs of those that have any."""
    means = {"epochs": "n_epochs", "s_per_epoch": "s_per_epoch", "fit_s": "fit_s", "predict_ms": "predict_ms", "latency_ms": "latency_ms"}
    return _runs(spark, d).groupBy("model").agg(F.max("n_params").cast("long").alias("n_params"), *[rnd(F.avg(c), 4 if n == "epochs" else 6).alias(n) for n, c in means.items()])


@query(f"{PRED} SELECT 'run-' || seed AS run_id, series_id AS area, model, seed, round(avg(abs(value - y_pred)), 6) AS mae FROM ev GROUP BY ALL")
def read_runs(spark, d):
    return _runs(spark, d).select("run_id", "area", "model", "seed", rnd("mae").alias("mae"))


@query(f"{PRED} SELECT 'run-' || seed AS run_id, model, CASE WHEN count(*) OVER (PARTITION BY model) > 1 THEN 'kernel=' || (seed % 2 + 2) ELSE '' END AS changed FROM (SELECT DISTINCT seed, model FROM ev)")
def config_diff(spark, d):
    return stores.config_diff(_runs(spark, d).select("run_id", "model", "params").dropDuplicates(["run_id", "model"]))


def _field(kernel, levels):
    return (1 + 2 * (kernel - 1) * (F.pow(F.lit(2.0), levels) - 1)).cast("long")


@query(f"{PRED} SELECT DISTINCT 'run-' || seed AS run_id, 1 + 2 * (seed % 2 + 1) * 7 AS field FROM ev")
def receptive_field(spark, d):
    return _runs(spark, d).select("run_id", _field(F.col("params")["kernel"].cast("int"), F.col("params")["levels"].cast("int")).alias("field")).distinct()


@query(f"{PRED}, k AS (SELECT seed, model, avg(abs(value - y_pred)) FILTER (split = 'val') AS val, avg(abs(value - y_pred)) FILTER (split = 'eval') AS test FROM pr WHERE series_id = 'view' GROUP BY ALL) SELECT model, 1 + 2 * (seed % 2 + 1) * 7 AS field, round(avg(val), 6) AS val, round(avg(test), 6) AS test, row_number() OVER (ORDER BY round(avg(val), 9), model, field) = 1 AS pick FROM k GROUP BY model, field")
def capacity_grid(spark, d):
    err = F.abs(F.col("value") - F.col("y_pred"))
    k = preds(spark, d).filter("series_id = 'view'").groupBy("model", "seed").agg(F.avg(F.when(F.col("split") == "val", err)).alias("val"), F.avg(F.when(F.col("split") == "eval", err)).alias("test"))
    grid = k.groupBy("model", _field(F.col("seed") % 2 + 2, F.lit(3)).alias("field")).agg(F.avg("val").alias("val"), F.avg("test").alias("test"))
    best = grid.agg(F.min(F.struct(F.round("val", 9).alias("v"), "model", "field")).alias("b"))
    return grid.join(F.broadcast(best)).select("model", "field", rnd("val").alias("val"), rnd("test").alias("test"), ((F.col("b.model") == F.col("model")) & (F.col("b.field") == F.col("field"))).alias("pick"))


# --- tests


def _loss(spark, d):
    return loss_difference(evals(spark, d), "seasonal", "ar1")


def _tests(spark, d):
    return dm_rows(spark, d).filter("rule = 'newey_west'")


@query(f"{_HOLM} SELECT series_id, round(n * power((1.959963984540054 + 0.8416212335729143) * se / 0.5, 2), 2) AS required FROM hp")
def required_n(spark, d):
    """Slots at which a margin of 0.5 would be detected."""
    return _tests(spark, d).select("series_id", rnd(F.col("n") * F.pow((I.Z95 + I.Z80) * F.col("se") / 0.5, F.lit(2.0)), 2).alias("required"))


@query(f"{_HOLM}, f AS (SELECT series_id, p, CASE WHEN series_id IN ('click', 'view') THEN 'visits' ELSE 'rest' END AS family FROM hp), s AS (SELECT *, row_number() OVER a AS i, count(*) OVER (PARTITION BY family) AS mi, row_number() OVER b AS j, count(*) OVER () AS mj FROM f WINDOW a AS (PARTITION BY family ORDER BY p, series_id), b AS (ORDER BY p, series_id)) SELECT series_id, family, round(least(1, max((mi - i + 1) * p) OVER (PARTITION BY family ORDER BY i)), 6) AS p_family, round(least(1, max((mj - j + 1) * p) OVER (ORDER BY j)), 6) AS p_pooled FROM s")
def family_tests(spark, d):
    tests = _tests(spark, d).select("series_id", "p", F.when(F.col("series_id").isin("click", "view"), "visits").otherwise("rest").alias("family"))
    inside = I.holm(tests, ["family"], "p", "series_id").withColumnRenamed("p_holm", "p_family")
    pooled = I.holm(tests, [], "p", "series_id").select("series_id", F.col("p_holm").alias("p_pooled"))
    return inside.join(pooled, "series_id").select("series_id", "family", rnd("p_family").alias("p_family"), rnd("p_pooled").alias("p_pooled"))


_MASKED = ", ms AS (SELECT series_id, CASE WHEN (slot_idx // 24) % 7 < 5 AND slot_idx // 24 NOT IN (0, 5) THEN 'working' ELSE 'other' END AS mask, slot_idx, d FROM dd), mu AS (SELECT series_id, mask, count(*) AS n, avg(d) AS mean, list(d ORDER BY slot_idx) AS ds FROM ms GROUP BY ALL), mg AS (SELECT series_id, mask, n, mean, floor(1.5 * power(n, 1.0 / 3))::BIGINT AS lag, k, list_dot_product(list_transform(ds[k + 1:], lambda z: z - mean), list_transform(ds[1:n - k], lambda z: z - mean)) AS g FROM mu, range(0, 20) q(k)), mh AS (SELECT series_id, mask, n, mean, lag, sqrt(sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / (lag + 1.0)) * g END) / (n * n)) AS se FROM mg WHERE k <= lag GROUP BY series_id, mask, n, mean, lag)"


@query(f"{PRED}{_D}{_MASKED}, mt AS (SELECT *, mean / se AS t FROM mh) SELECT series_id, mask, n, lag, round(mean, 6) AS mean, round(se, 6) AS se, round({_P('t')}, 6) AS p FROM mt")
def compare_on_mask(spark, d):
    """The test on working and on other days; lags run over the masked sequence."""
    from ..operators import panel as P

    mask = F.when(P.is_working(P.day_of(F.col("slot_idx"), SPEC), SPEC).cast("boolean"), "working").otherwise("other")
    h = L.dm_tests(_loss(spark, d).withColumn("mask", mask), ["series_id", "mask"]).filter("rule = 'newey_west'")
    return h.select("series_id", "mask", "n", "lag", rnd("mean").alias("mean"), rnd("se").alias("se"), rnd("p").alias("p"))


DRAWS = 10_000


def _boot_sql(of: str, keys: str) -> str:
    """Intervals bt of the means of d in table `of`, whose keys are named; a series of whole days."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    name = " || '/' || ".join(keys.split(","))
    return f""", ba AS (SELECT {keys}, d, row_number() OVER (PARTITION BY {keys} ORDER BY slot_idx) - 1 AS at, count(*) OVER (PARTITION BY {keys}) AS n FROM {of}),
bs AS (SELECT {', '.join(f'a.{k.strip()}' for k in keys.split(','))}, a.at AS start, sum(b.d) AS whole FROM ba a JOIN ba b ON {on} AND (b.at - a.at + a.n) % a.n < 24 GROUP BY ALL),
bd AS (SELECT {keys}, n, w AS draw, CAST('0x' || substr(md5('0/' || {name} || '/' || w || '/' || k), 1, 8) AS BIGINT) % n AS start FROM (SELECT DISTINCT {keys}, n FROM ba), range(0, {DRAWS}) q(w), range(1, 8) z(k)),
bt AS (SELECT {keys}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, stddev_samp(m) AS se FROM (SELECT {keys}, draw, sum(whole) / any_value(n) AS m FROM bd JOIN bs USING ({keys}, start) GROUP BY {keys}, draw) GROUP BY {keys})"""


@query(f"{PRED}{_D}{_boot_sql('dd', 'series_id')} SELECT series_id, round(lo, 6) AS lo, round(hi, 6) AS hi, round(se, 6) AS se FROM bt")
def block_bootstrap(spark, d):
    b = I.block_bootstrap(_loss(spark, d), ["series_id"], "d", block=SPEC.season, draws=DRAWS)
    return b.select("series_id", rnd("lo").alias("lo"), rnd("hi").alias("hi"), rnd("se").alias("se"))


_LOSSES = ", lo AS (SELECT series_id, slot_idx, model, power, avg(power(abs(value - y_pred), power)) AS own, power(abs(any_value(value) - avg(y_pred)), any_value(power)) AS ens FROM ev, (VALUES (1), (2)) w(power) WHERE model IN ('seasonal', 'ar1') GROUP BY series_id, slot_idx, model, power), ld AS (SELECT a.series_id, a.power::INT AS power, a.slot_idx, a.own - b.own AS d, a.ens - b.ens AS e FROM lo a JOIN lo b USING (series_id, slot_idx, power) WHERE a.model = 'seasonal' AND b.model = 'ar1')"
_COMPARED = ", cu AS (SELECT series_id, power, count(*) AS n, avg(d) AS mean, avg(e) AS ens_d, list(d ORDER BY slot_idx) AS ds FROM ld GROUP BY ALL), cg AS (SELECT series_id, power, n, mean, k, list_dot_product(us[k + 1:], us[1:n - k]) AS g FROM (SELECT *, list_transform(ds, lambda z: z - mean) AS us FROM cu), range(0, 145) q(k)), ch AS (SELECT series_id, power, n, mean, l AS lag, sqrt(sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / (l + 1.0)) * g END) / (n * n)) AS se FROM cg, (VALUES (0), (6), (8), (15), (36), (72), (144)) w(l) WHERE k <= l GROUP BY series_id, power, n, mean, l), ct AS (SELECT *, mean / se AS t, mean / (se * " + _HLN + ") AS ht FROM ch), cr AS (SELECT series_id, power, sum(g / g0 * g / g0 / (n - k)) FILTER (k BETWEEN 1 AND 24) * n * (n + 2) AS q, max(g / g0) FILTER (k = 1) AS acf1 FROM (SELECT *, max(g) FILTER (k = 0) OVER (PARTITION BY series_id, power) AS g0 FROM cg) GROUP BY series_id, power, n), ca AS (SELECT series_id, power, greatest(-0.97, least(0.97, max(g) FILTER (k = 1) / (max(g) FILTER (k = 0) - any_value(f)))) AS r, any_value(n) AS n FROM cg JOIN (SELECT series_id, power, power(ds[-1] - mean, 2) AS f FROM cu) USING (series_id, power) GROUP BY ALL)"


@query(
    f"{PRED}{_LOSSES}{_COMPARED}{_boot_sql('ld', 'series_id, power')} SELECT series_id, power, n, lag, round(mean, 6) AS d, round(ens_d, 6) AS ens_d, round(c.se * {_HLN}, 6) AS se, round(ht, 4) AS t, round({_P('ht')}, 6) AS p, round(mean - 1.959963984540054 * c.se * {_HLN}, 6) AS lo, round(mean + 1.959963984540054 * c.se * {_HLN}, 6) AS hi, round((1.959963984540054 + 0.8416212335729143) * c.se * {_HLN}, 6) AS detectable, round(bt.lo, 6) AS boot_lo, round(bt.hi, 6) AS boot_hi, round(bt.se, 6) AS boot_se, round(acf1, 6) AS acf_1, round(exp(-q / 2) * ({' + '.join(f'power(q / 2, {i}) / {factorial(i)}' for i in range(12))}), 6) AS ljung_box_p, floor(1.1447 * power(4 * r * r / (power(1 - r, 2) * power(1 + r, 2)) * n, 1.0 / 3))::BIGINT AS andrews, "
    + ", ".join(f"(SELECT round({_P('z.ht')}, 6) FROM ct z WHERE z.series_id = c.series_id AND z.power = c.power AND z.lag = {k}) AS p_{k}" for k in L.GRID)
    + " FROM (SELECT * FROM ct WHERE lag = 8) c JOIN (SELECT series_id, power, ens_d FROM cu) USING (series_id, power) JOIN cr USING (series_id, power) JOIN (SELECT series_id, power, r FROM ca) USING (series_id, power) JOIN bt USING (series_id, power)"
)
def compare(spark, d):
    """A pair of models by absolute and by squared loss: the test, its sensitivities and what it could detect; and the same pair's seed-mean forecasts."""
    err = F.abs(F.col("value") - F.col("y_pred"))
    powers = F.explode(F.array(F.lit(1), F.lit(2))).alias("power")
    e = evals(spark, d).filter("model in ('seasonal', 'ar1')").select("*", powers)
    one = e.groupBy("series_id", "slot_idx", "model", "power").agg(F.avg(F.pow(err, "power")).alias("own"), F.pow(F.abs(F.first("value") - F.avg("y_pred")), F.first("power")).alias("ens"))
    pick = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    x = one.groupBy("series_id", "slot_idx", "power").agg((pick("seasonal", "own") - pick("ar1", "own")).alias("d"), (pick("seasonal", "ens") - pick("ar1", "ens")).alias("e"))
    keys = ["series_id", "power"]
    h = L.dm_tests(x, keys)
    ruled = h.filter("rule <> 'grid'").groupBy(*keys).pivot("rule", ["newey_west", "andrews"]).agg(F.first(F.struct("lag", "n", "mean", "hln_se", "hln_t", "hln_p", "hln_lo", "hln_hi")))
    grid = h.filter("rule = 'grid'").groupBy(*keys).pivot("lag", list(L.GRID)).agg(rnd(F.first("hln_p"))).withColumnsRenamed({str(k): f"p_{k}" for k in L.GRID})
    boot = I.block_bootstrap(x, keys, "d", block=SPEC.season, draws=DRAWS).select(*keys, rnd("lo").alias("boot_lo"), rnd("hi").alias("boot_hi"), rnd("se").alias("boot_se"))
    box = L.ljung_box(x, keys).select(*keys, rnd(F.get("acf", F.lit(1))).alias("acf_1"), rnd("p").alias("ljung_box_p"))
    ens = x.groupBy(*keys).agg(rnd(F.avg("e")).alias("ens_d"))
    out = ruled.join(grid, keys).join(boot, keys).join(box, keys).join(ens, keys)
    at = lambda c, k=6: rnd(F.col(f"newey_west.{c}"), k)
    return out.select(
        *keys, "newey_west.n", "newey_west.lag", at("mean").alias("d"), "ens_d", at("hln_se").alias("se"), at("hln_t", 4).alias("t"), at("hln_p").alias("p"), at("hln_lo").alias("lo"), at("hln_hi").alias("hi"),
        rnd((I.Z95 + I.Z80) * F.col("newey_west.hln_se")).alias("detectable"), "boot_lo", "boot_hi", "boot_se", "acf_1", "ljung_box_p", F.col("andrews.lag").alias("andrews"), *[f"p_{k}" for k in L.GRID])


@query(None)
def adf(spark, d):
    return I.adf(variants(spark, d), ["series_id", "variant"]).select("series_id", "variant", rnd("adf", 4).alias("adf"), "lag", "n_used", rnd("adf_p").alias("adf_p"), "rejects")


@query(None)
def stationarity_table(spark, d):
    x = variants(spark, d)
    k = L.kpss(x, ["series_id", "variant"], ("c",)).select("series_id", "variant", "kpss", "kpss_p")
    both = I.adf(x, ["series_id", "variant"]).join(k, ["series_id", "variant"])
    told = I.verdict(F.col("adf_p") < 0.05, F.col("kpss_p") < 0.05)
    return both.select("series_id", "variant", rnd("adf", 4).alias("adf"), rnd("adf_p").alias("adf_p"), rnd("kpss", 4).alias("kpss"), rnd("kpss_p", 4).alias("kpss_p"), told.alias("verdict"))


@query(f"{KPSS_SQL}, df AS (SELECT series_id, regr_slope(value - l, l) AS b, regr_syy(value - l, l) AS syy, regr_sxx(value - l, l) AS sxx, regr_count(value - l, l) AS m FROM (SELECT series_id, value, lag(value) OVER (PARTITION BY series_id ORDER BY slot_idx) AS l FROM e) GROUP BY ALL), q AS (SELECT series_id, b / sqrt((syy - b * b * sxx) / (m - 2) / sxx) < -2.86 AS a, kpss > 0.463 AS k FROM df JOIN (SELECT series_id, kpss FROM kp WHERE variant = 'raw' AND form = 'c') USING (series_id)) SELECT series_id, CASE WHEN a AND NOT k THEN 'stationary (ADF rejects unit root; KPSS keeps stationarity)' WHEN k AND NOT a THEN 'unit root (ADF keeps unit root; KPSS rejects stationarity)' WHEN a THEN 'both reject: no unit root but not level-stationary (drift or changing variance)' ELSE 'inconclusive: neither test rejects its null' END AS verdict FROM q")
def verdict(spark, d):
    """By the test without lagged differences, which is a closed form."""
    e = channels(spark, d)
    lagged = e.withColumn("l", F.lag("value").over(Window.partitionBy("series_id").orderBy("slot_idx"))).withColumn("step", F.col("value") - F.col("l"))
    fit = lagged.groupBy("series_id").agg(F.regr_slope("step", "l").alias("b"), F.regr_syy("step", "l").alias("syy"), F.regr_sxx("step", "l").alias("sxx"), F.regr_count("step", "l").alias("m"))
    t = F.col("b") / F.sqrt((F.col("syy") - F.col("b") * F.col("b") * F.col("sxx")) / (F.col("m") - 2) / F.col("sxx"))
    both = fit.join(L.kpss(e, ["series_id"], ("c",)), "series_id")
    return both.select("series_id", I.verdict(t < -2.86, F.col("kpss") > 0.463).alias("verdict"))
