"""Splits, scalers, windows and forecasters for a whole fleet of series at once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stores
from ..sources.shared import written
from ..spec import TRAINING, SeriesSpec
from .panel import day_of, is_working, split_label


def by_series(*extra: str):
    return Window.partitionBy("series_id", *extra).orderBy("slot_idx")


def fit_scaler(panel: DataFrame, method: str, spec: SeriesSpec) -> DataFrame:
    """(series_id, center, scale) from training rows only; a zero scale is 1."""
    f = F.log1p("value") if method.startswith("log1p") else F.col("value")
    train = panel.filter(F.col("slot_idx") < spec.bounds[0]).withColumn("f", f).filter(~F.isnan("f") & (F.abs("f") < float("inf")))
    center, scale = {"standard": (F.avg("f"), F.stddev_pop("f")), "log1p-standard": (F.avg("f"), F.stddev_pop("f")), "minmax": (F.min("f"), F.max("f") - F.min("f"))}.get(method, (F.lit(0.0), F.lit(1.0)))
    return train.groupBy("series_id").agg(center.alias("center"), scale.alias("scale")).withColumn("scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")))


def scaled(value: Column, method: str) -> Column:
    f = F.log1p(value) if method.startswith("log1p") else value
    return (f - F.col("center")) / F.col("scale")


def unscaled(value: Column, method: str) -> Column:
    g = value * F.col("scale") + F.col("center")
    return F.expm1(g) if method.startswith("log1p") else g


def windows(panel: DataFrame, length: int, horizon: int = 1, stride: int = 1, within: tuple[str, ...] = ()) -> DataFrame:
    """Full windows only: lags (oldest first) that end `horizon` before the target; none crosses the columns `within`."""
    order = by_series(*within)
    w = order.rowsBetween(-(length + horizon - 1), -horizon)
    out = panel.withColumn("lags", F.collect_list("value").over(w)).withColumn("number", F.row_number().over(order) - length - horizon)
    return out.filter((F.size("lags") == length) & (F.col("number") % stride == 0)).withColumnRenamed("value", "target")


def calendar(slot: Column, spec: SeriesSpec) -> dict[str, Column]:
    day, dow = slot % spec.season, F.weekday(day_of(slot, spec))
    turn = lambda x, n: (F.sin(2 * F.pi() * x / n), F.cos(2 * F.pi() * x / n))
    (a, b), (c, e) = turn(day, spec.season), turn(dow, 7)
    return {"day_sin": a, "day_cos": b, "dow_sin": c, "dow_cos": e, "working": is_working(day_of(slot, spec), spec).cast("double")}


# --- forecasters. A registry by name; duplicates and unknown names are errors.
#
# fit makes a table of parameters, which may be stored; predictions joins it. A forecast is
# coefficients[0] plus the others by the regressors, which come from slots before the target
# and from its calendar. Forecasters without anything to fit have fixed weights and one seed.

PARAMETERS = "series_id string, model string, seed int, version string, n_params int, coefficients array<double>"
GROUPS = 5  # of days, one of which each seed above 0 leaves out of its fit
SLICE = 1 << 16  # targets in one group of a fit


def left_out(day: Column | np.ndarray, seed: Column | int):
    """Days that a seed's fit does without: about a fifth of them, another one for each seed above 0. The seed 0 takes all days."""
    return ((day + 1) * (seed + 1) * 7919 % 10007) % GROUPS == 0


def resampled(rows: DataFrame, spec: SeriesSpec, seeds: int) -> DataFrame:
    """Each row once for each seed (column seed) whose fit takes its day."""
    each = rows.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    return each.filter((F.col("seed") == 0) | ~left_out(F.floor(F.col("slot_idx") / spec.season), F.col("seed")))


REGISTRY: dict[str, Callable[..., "Forecaster"]] = {}


def register(name: str):
    def add(f):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered already")
        REGISTRY[name] = f
        return f

    return add


def build(name: str, **options) -> "Forecaster":
    if name not in REGISTRY:
        raise KeyError(f"no forecaster {name}; there are {sorted(REGISTRY)}")
    return REGISTRY[name](**options)


def preset(name: str, base: str, **defaults) -> None:
    """Another name for a forecaster with options that the caller may still override."""
    register(name)(lambda **options: build(base, **{**defaults, **options}))


@dataclass(frozen=True)
class Forecaster:
    """What all have in common; fitted says whether there is anything to fit."""

    fitted = False

    def regressors(self, spec: SeriesSpec) -> Column:
        """Array by which the coefficients after the first are multiplied; null where the history is too short."""
        raise NotImplementedError

    def n_params(self, spec: SeriesSpec) -> int:
        return 0

    def fixed(self, spec: SeriesSpec) -> list[float]:
        """Coefficients of the regressors that need no fit."""
        raise NotImplementedError

    def fit(self, panel: DataFrame, spec: SeriesSpec, seeds: int) -> DataFrame:
        """(series_id, seed, coefficients), from training slots only."""
        raise NotImplementedError

    def forecast(self, spec: SeriesSpec, x: str, coefficients: str = "") -> str:
        """SQL of the forecast by columns of regressors and, where there is a fit, of coefficients."""
        if self.fitted:
            return dot(coefficients, x, self.n_params(spec))
        return " + ".join(f"{c!r}D * get({x}, {k})" for k, c in enumerate(self.fixed(spec)))

    def version(self, spec: SeriesSpec) -> str:
        """Changes with what a fit depends on, but for the data."""
        return hashlib.sha256(f"{self!r} {spec!r}".encode()).hexdigest()[:16]

    def parameters(self, panel: DataFrame, spec: SeriesSpec, label: str, seeds: int = 1) -> DataFrame:
        """Rows of PARAMETERS."""
        return self.together({label: self}, panel, spec, seeds)

    @classmethod
    def together(cls, known: dict[str, "Forecaster"], panel: DataFrame, spec: SeriesSpec, seeds: int) -> DataFrame:
        """Parameters of several forecasters of this kind, by label."""
        series = F.col("series_id").cast("string").alias("series_id")
        told = [f.fit(panel, spec, seeds).select(series, F.lit(k).alias("model"), F.col("seed").cast("int").alias("seed"), F.lit(f.version(spec)).alias("version"), F.lit(f.n_params(spec)).alias("n_params"), "coefficients") for k, f in known.items()]
        return reduce(DataFrame.unionByName, told)

    def __call__(self, panel: DataFrame, spec: SeriesSpec) -> DataFrame:
        """panel with y_pred, fitted on all training days."""
        x = panel.withColumn("_x", self.regressors(spec))
        if not self.fitted:
            return x.withColumn("y_pred", F.expr(self.forecast(spec, "_x"))).drop("_x")
        found = self.fit(panel, spec, 1).select("series_id", "coefficients")
        return x.join(found, "series_id", "left").withColumn("y_pred", F.expr(self.forecast(spec, "_x", "coefficients"))).drop("_x", "coefficients")


def dot(coefficients: str, x: str, n: int) -> str:
    """SQL for the first of n coefficients plus the others by x: null if x is, or holds a null. Short ones are written out, which Spark compiles."""
    if n <= 9:
        return " + ".join([f"get({coefficients}, 0)", *(f"get({coefficients}, {k}) * get({x}, {k - 1})" for k in range(1, n))])
    return f"aggregate(zip_with(slice({coefficients}, 2, {n - 1}), {x}, (a, b) -> a * b), get({coefficients}, 0), (s, v) -> s + v)"


@register("seasonal_naive")
@dataclass(frozen=True)
class Lagged(Forecaster):
    """The mean of the values at `count` multiples of a lag; the lag may be the spec's season or week."""

    season: int | str = "season"
    count: int = 1

    def regressors(self, spec: SeriesSpec) -> Column:
        lag = getattr(spec, self.season) if isinstance(self.season, str) else self.season
        return F.array(*[F.lag("value", k * lag).over(by_series()) for k in range(1, self.count + 1)])

    def fixed(self, spec: SeriesSpec) -> list[float]:
        return [1 / self.count] * self.count


preset("naive", "seasonal_naive", season=1)
preset("seasonal_naive_daily", "seasonal_naive", season="season")
preset("seasonal_naive_144", "seasonal_naive", season=144)
preset("seasonal_naive_weekly", "seasonal_naive", season="week")
preset("seasonal_naive_1008", "seasonal_naive", season=1008)
preset("time_of_day_mean", "seasonal_naive", count=4)
preset("time_of_day_mean_4d", "seasonal_naive", count=4)


@register("linear_ar1")
@dataclass(frozen=True)
class LinearAR1(Forecaster):
    """Least squares on one lag, and with `calendar` on the working-day flag of the target too: closed forms of moments."""

    calendar: bool = False
    fitted = True

    def regressors(self, spec: SeriesSpec) -> Column:
        flag = [is_working(day_of(F.col("slot_idx"), spec), spec).cast("double")] if self.calendar else []
        return F.array(F.lag("value", 1).over(by_series()), *flag)

    def n_params(self, spec: SeriesSpec) -> int:
        return 3 if self.calendar else 2

    @staticmethod
    def moments(panel: DataFrame, spec: SeriesSpec, seeds: int) -> DataFrame:
        flag = is_working(day_of(F.col("slot_idx"), spec), spec).cast("double")
        x = panel.select("series_id", "slot_idx", "value", F.lag("value", 1).over(by_series()).alias("_a"), flag.alias("_b"))
        x = resampled(x.filter((F.col("slot_idx") < spec.bounds[0]) & F.col("_a").isNotNull()), spec, seeds)
        names = {"aa": ("_a", "_a"), "bb": ("_b", "_b"), "ab": ("_a", "_b"), "ay": ("_a", "value"), "by": ("_b", "value")}
        return x.groupBy("series_id", "seed").agg(*[F.covar_pop(*c).alias(k) for k, c in names.items()], F.avg("_a").alias("ma"), F.avg("_b").alias("mb"), F.avg("value").alias("my"))

    def coefficients(self) -> Column:
        """Of moments."""
        aa, bb, ab, ay, by, ma, mb, my = (F.col(k) for k in ("aa", "bb", "ab", "ay", "by", "ma", "mb", "my"))
        alone = F.try_divide(ay, aa)
        if not self.calendar:
            return F.array(my - alone * ma, alone)
        # a flag that never changes, or that goes with the lag, is left out
        both = aa * bb - ab * ab > 1e-12 * aa * bb
        a = F.when(both, F.try_divide(ay * bb - by * ab, aa * bb - ab * ab)).otherwise(alone)
        b = F.when(both, F.try_divide(by * aa - ay * ab, aa * bb - ab * ab)).otherwise(F.lit(0.0))
        return F.array(my - a * ma - b * mb, a, b)

    def fit(self, panel: DataFrame, spec: SeriesSpec, seeds: int) -> DataFrame:
        return self.moments(panel, spec, seeds).select("series_id", "seed", self.coefficients().alias("coefficients"))

    @classmethod
    def together(cls, known: dict[str, Forecaster], panel: DataFrame, spec: SeriesSpec, seeds: int) -> DataFrame:
        """With the calendar and without, from the same moments."""
        each = F.array(*[F.struct(F.lit(k).alias("model"), F.lit(f.version(spec)).alias("version"), F.lit(f.n_params(spec)).alias("n_params"), f.coefficients().alias("coefficients")) for k, f in known.items()])
        told = cls.moments(panel, spec, seeds).select(F.col("series_id").cast("string").alias("series_id"), F.col("seed").cast("int").alias("seed"), F.inline(each))
        return told.select("series_id", "model", "seed", "version", "n_params", "coefficients")


preset("linear_ar1_calendar", "linear_ar1", calendar=True)


@register("linear_ar")
@dataclass(frozen=True)
class LinearAR(Forecaster):
    """Least squares on `order` lags (oldest first), and with `calendar` on the target's calendar.

    A fit never holds a whole series: slices of `slice` targets are brought to the triangle
    of their QR decomposition, whose product with itself is the slice's Gram matrix, and the
    triangles of a series and seed are decomposed once more. Unlike sums of Gram matrices
    this loses no digits. Flat directions get the coefficients of least norm.
    """

    order: int = 24
    calendar: bool = False
    slice: int = SLICE
    fitted = True

    def _exog(self, spec: SeriesSpec) -> list[Column]:
        return list(calendar(F.col("slot_idx"), spec).values()) if self.calendar else []

    def regressors(self, spec: SeriesSpec) -> Column:
        lags = F.collect_list("value").over(by_series().rowsBetween(-self.order, -1))
        return F.when(F.size(lags) == self.order, F.concat(lags, F.array(*self._exog(spec))) if self.calendar else lags)

    def n_params(self, spec: SeriesSpec) -> int:
        return self.order + 1 + len(self._exog(spec))

    def fit(self, panel: DataFrame, spec: SeriesSpec, seeds: int) -> DataFrame:
        order, season, width = self.order, spec.season, max(self.slice, self.order)
        kind = panel.schema["series_id"].dataType.simpleString()
        own = F.floor(F.col("slot_idx") / width)
        near = F.when(F.col("slot_idx") % width >= width - order, F.array(own, own + 1)).otherwise(F.array(own))
        exog = self._exog(spec)
        width_ = order + len(exog) + 2
        train = panel.filter(F.col("slot_idx") < spec.bounds[0])
        rows = train.select("series_id", "slot_idx", "value", F.array(*exog).cast("array<double>").alias("exog"), F.explode(near).alias("part"))

        def triangle(key: tuple, table: pa.Table) -> pa.Table:
            at = np.argsort(np.asarray(table.column("slot_idx")))
            slot, v = np.asarray(table.column("slot_idx"))[at], np.asarray(table.column("value"), dtype=float)[at]
            x = np.lib.stride_tricks.sliding_window_view(v[:-1], order) if len(v) > order else np.zeros((0, order))
            more = np.array(table.column("exog").to_pylist(), dtype=float).reshape(len(v), -1)[at][order:]
            target = slot[order:] // width == key[1].as_py()
            a = np.c_[np.ones(len(x)), x, more, v[order:]][target]
            day = slot[order:][target] // season
            told = []
            for seed in range(seeds):
                kept = a if seed == 0 else a[~left_out(day, seed)]
                if len(kept):
                    told.append((seed, np.linalg.qr(kept, mode="r").ravel().tolist()))
            return pa.table({"series_id": pa.array([key[0].as_py()] * len(told), key[0].type), "seed": pa.array([k for k, _ in told], pa.int32()), "r": pa.array([r for _, r in told], pa.list_(pa.float64()))})

        def solve(key: tuple, table: pa.Table) -> pa.Table:
            stacked = np.concatenate([np.array(r).reshape(-1, width_) for r in table.column("r").to_pylist()])
            r = np.linalg.qr(stacked, mode="r")
            found = np.linalg.lstsq(r[:, :-1], r[:, -1], rcond=None)[0]
            return pa.table({"series_id": pa.array([key[0].as_py()], key[0].type), "seed": pa.array([key[1].as_py()], pa.int32()), "coefficients": pa.array([found.tolist()], pa.list_(pa.float64()))})

        parts = rows.groupBy("series_id", "part").applyInArrow(triangle, f"series_id {kind}, seed int, r array<double>")
        return parts.groupBy("series_id", "seed").applyInArrow(solve, f"series_id {kind}, seed int, coefficients array<double>")


preset("linear_ar_6", "linear_ar", order=6)
preset("linear_ar_36", "linear_ar", order=36)
preset("linear_ar_144", "linear_ar", order=144)
preset("linear_ar_calendar", "linear_ar", calendar=True)


@register("gbt")
@dataclass(frozen=True)
class BoostedTrees(Forecaster):
    """Spark ML's boosted trees on lags and the target's calendar, pooled over series.

    It stops by patience: the rounds used are those of the least validation error before
    `patience` rounds in a row that are no better. Trees don't depend on the rounds that
    follow, so a short run that ends so needs no longer one; runs double until then.
    """

    lags: tuple[int, ...] = (1, 2, 3, 24, 168)
    rounds: int = 300
    rate: float = 0.05
    patience: int = 20
    depth: int = 5  # 32 leaves at most
    fitted = True

    def design(self, panel: DataFrame, spec: SeriesSpec) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        exog = calendar(F.col("slot_idx"), spec)
        x = panel.withColumns({f"_l{k}": F.lag("value", k).over(by_series()) for k in self.lags}).withColumns({f"_{k}": v for k, v in exog.items()})
        names = [*(f"_l{k}" for k in self.lags), *(f"_{k}" for k in exog)]
        return VectorAssembler(inputCols=names, outputCol="_x", handleInvalid="skip").transform(x).drop(*names)

    def train(self, panel: DataFrame, spec: SeriesSpec):
        """The model (to be saved as Spark ML's are), and a report: rounds, leaves, validation_mae."""
        from pyspark.ml.regression import GBTRegressor

        x = written(self.design(panel, spec).filter(F.col("slot_idx") < spec.bounds[1]).select("_x", "value", "slot_idx"))
        train, val = x.filter(F.col("slot_idx") < spec.bounds[0]), x.filter(F.col("slot_idx") >= spec.bounds[0])

        def fit(rounds: int):
            return GBTRegressor(featuresCol="_x", labelCol="value", predictionCol="y_pred", maxIter=rounds, stepSize=self.rate, maxDepth=self.depth, minInstancesPerNode=20, seed=1).fit(train)

        rounds = min(self.rounds, 2 * self.patience)
        while True:
            model = fit(rounds)
            errors = model.evaluateEachIteration(val, "squared")
            best = least_before_patience(errors, self.patience)
            if best is not None or rounds == self.rounds:
                break
            rounds = min(self.rounds, 2 * rounds)
        used = (best if best is not None else int(np.argmin(errors))) + 1
        model = model if used == rounds else fit(used)
        leaves = sum((t.numNodes + 1) // 2 for t in model.trees)
        return model, {"rounds": used, "leaves": leaves, "validation_mae": model.evaluateEachIteration(val, "absolute")[-1]}

    def __call__(self, panel: DataFrame, spec: SeriesSpec) -> DataFrame:
        model, report = self.train(panel, spec)
        told = model.transform(self.design(panel, spec)).drop("_x")
        return told.withColumns({k: F.lit(v) for k, v in report.items()})


def least_before_patience(errors: list[float], patience: int) -> int | None:
    """Where the least error lies that `patience` further ones in a row don't beat; None if there is none yet."""
    best = 0
    for k, e in enumerate(errors):
        if e < errors[best]:
            best = k
        elif k - best >= patience:
            return best
    return None


def fit_all(panel: DataFrame, spec: SeriesSpec, models: dict[str, str], seeds: int = 1, path: str | None = None) -> DataFrame | None:
    """Parameters of all forecasters that have any (PARAMETERS), by label and seed.

    With a path they are stored there, and only what isn't stored yet is fitted: a label's
    parameters of another version, fewer seeds, or none.
    """
    known = {label: build(name) for label, name in models.items()}
    known = {label: f for label, f in known.items() if f.fitted}
    if not known:
        return None
    if path is None:
        kinds = {type(f) for f in known.values()}
        return reduce(DataFrame.unionByName, [kind.together({k: f for k, f in known.items() if type(f) is kind}, panel, spec, seeds) for kind in sorted(kinds, key=lambda c: c.__name__)])
    spark = panel.sparkSession
    have = stores.stored(spark, path)
    there = set() if have is None else {(r.model, r.version) for r in have.groupBy("model", "version").agg(F.max("seed").alias("last")).filter(F.col("last") >= seeds - 1).collect()}  # a row a model
    for label, f in known.items():
        if (label, f.version(spec)) not in there:
            made = f.parameters(panel, spec, label, seeds)
            made.write.partitionBy("model", "version").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return spark.read.schema(PARAMETERS).parquet(path)


def predictions(panel: DataFrame, spec: SeriesSpec, models: dict[str, str], seeds: int = 1, path: str | None = None) -> DataFrame:
    """Long table of truth and forecasts by model and seed; what needs no fit has the seed 0 alone. With a path, parameters are taken from there, and stored there."""
    known = {label: build(name) for label, name in models.items()}
    params = fit_all(panel, spec, models, seeds, path)
    x = panel.select("series_id", "slot_idx", "value", *[f.regressors(spec).alias(f"_x_{label}") for label, f in known.items()])
    told, fits = [], []
    for n, (label, f) in enumerate(known.items()):
        name = "'" + label.replace("\\", "\\\\").replace("'", "\\'") + "'"
        for seed in range(seeds if f.fitted else 1):
            if f.fitted:
                fits.append(F.expr(f"max(CASE WHEN model = {name} AND version = '{f.version(spec)}' AND seed = {seed} THEN coefficients END) AS _c_{n}_{seed}"))
            told.append(f"struct({name} AS model, {seed} AS seed, {f.forecast(spec, f'`_x_{label}`', f'_c_{n}_{seed}')} AS y_pred)")
    if params is not None:
        x = x.join(params.groupBy("series_id").agg(*fits), "series_id", "left")
    each = x.selectExpr("series_id", "slot_idx", "value", f"inline(array({', '.join(told)}))")
    return each.select("series_id", "slot_idx", "value", "y_pred", "model", "seed", split_label(F.col("slot_idx"), spec).alias("split"))


def metrics(scored: DataFrame, keys: list[str], scale: DataFrame | None = None, epsilon: float = 1e-3, allow_missing: bool = False) -> DataFrame:
    """All metrics in one pass (E9). One non-finite pair makes a group's metrics null unless allow_missing."""
    ok = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    x = scored.withColumn("_ok", ok(F.col("value")) & ok(F.col("y_pred")))
    t, p = F.when(F.col("_ok"), F.col("value")), F.when(F.col("_ok"), F.col("y_pred"))
    err, den = F.abs(t - p), (F.abs(t) + F.abs(p)) / 2
    told = x.groupBy(*keys).agg(
        F.count_if(F.col("_ok")).alias("n_scored"), F.count_if(~F.col("_ok")).alias("n_dropped"), F.avg(err).alias("mae"), F.sqrt(F.avg((t - p) * (t - p))).alias("rmse"),
        (F.avg(err / F.greatest(F.abs(t), F.lit(epsilon))) * 100).alias("mape"), (F.avg(F.when(F.abs(t) > epsilon, F.try_divide(err, F.abs(t)))) * 100).alias("mape_mask"),
        (F.avg(F.when(den > 0, F.try_divide(err, den))) * 100).alias("smape"), (F.try_divide(F.sum(err), F.sum(F.abs(t))) * 100).alias("wape"),
        (1 - F.try_divide(F.sum((t - p) * (t - p)), F.count(t) * F.var_pop(t))).alias("r2"),
    )
    names = ["mae", "rmse", "mape", "mape_mask", "smape", "wape", "r2"]
    if scale is not None:
        told = told.join(scale, "series_id", "left").withColumn("mase", F.when(F.col("scale") > 0, F.col("mae") / F.col("scale"))).drop("scale")
        names.append("mase")
    return told if allow_missing else told.withColumns({c: F.when(F.col("n_dropped") == 0, F.col(c)) for c in names})


def paired(truth: DataFrame, forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """Forecasts with their truth. A key of truth without a forecast, or the other way round, is an error."""
    t, p = truth.withColumn("_t", F.lit(True)), forecasts.withColumn("_p", F.lit(True))
    fault = F.raise_error(F.concat(F.lit("no truth, or no forecast, at "), F.concat_ws(" ", *keys))).cast("boolean")
    both = t.join(p, keys, "full_outer").withColumn("_whole", F.when(F.col("_t") & F.col("_p"), True).otherwise(fault))
    return both.filter("_whole").drop("_t", "_p", "_whole")


def reconciled(derived: DataFrame, log: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Logged texts (column logged) against numbers, rounded to the decimals that each text has: keys, places, derived, logged, drift."""
    places = F.length(F.regexp_extract("logged", r"\.(\d+)$", 1))
    x = derived.join(log, keys).withColumn("places", places.cast("long"))
    shown = F.round(F.col(name) * F.pow(F.lit(10.0), "places")) / F.pow(F.lit(10.0), "places")
    x = x.withColumn("derived", shown + F.lit(0.0)).withColumn("logged", F.col("logged").cast("double"))
    return x.select(*keys, "places", "derived", "logged", (F.abs(F.col("derived") - F.col("logged")) > 1e-9).alias("drift"))


def focus_area(areas: DataFrame, requested: str | None = None, control: DataFrame | None = None) -> DataFrame:
    """One row (area): the one requested, else the only one of a control run if it is among the areas, else the first."""
    first = areas.agg(F.min("area").alias("first"))
    if control is None:
        return first.select(F.coalesce(F.lit(requested), F.col("first")).alias("area"))
    only = control.distinct().agg(F.when(F.count("*") == 1, F.max("area")).alias("only"))
    there = only.join(areas.select(F.col("area").alias("only")).distinct(), "only", "left_semi").agg(F.max("only").alias("only"))
    return first.join(F.broadcast(there)).select(F.coalesce(F.lit(requested), F.col("only"), F.col("first")).alias("area"))  # one row each


def training_frame(panel: DataFrame, spec: SeriesSpec, length: int, method: str = "standard") -> DataFrame:
    """All series' windows (spec.TRAINING): scaled lags and target, the target's calendar, its truth in the series' own unit, its split, and the training slots' seasonal difference."""
    x = panel.select("series_id", "slot_idx", "value").join(fit_scaler(panel, method, spec), "series_id").withColumn("truth", F.col("value")).withColumn("value", scaled(F.col("value"), method))
    w = windows(x.drop("scale", "center"), length).join(naive_scale(panel, spec), "series_id", "left")
    told = w.withColumn("exog", F.array(*calendar(F.col("slot_idx"), spec).values())).withColumn("split", split_label(F.col("slot_idx"), spec))
    return told.select(*[F.col(f.name).cast(f.dataType) for f in TRAINING])


def naive_scale(panel: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Mean absolute seasonal difference of the training rows (E7)."""
    d = panel.filter(F.col("slot_idx") < spec.bounds[0]).withColumn("d", F.abs(F.col("value") - F.lag("value", spec.season).over(by_series())))
    return d.groupBy("series_id").agg(F.avg("d").alias("scale"))
