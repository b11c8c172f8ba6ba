"""Forecasters: parameters that are fitted once, least squares over slices, seeds, and trees that stop by patience."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import forecast as M
from tessera.spec import SeriesSpec

SPEC = SeriesSpec(n_slots=1200, bounds=(900, 1050, 1150))


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(4)
    rows = []
    for k in range(3):
        v = r.normal(size=1200) + np.sin(np.arange(1200) / 24 * 2 * np.pi) * (k + 1)
        for t in range(1, 1200):
            v[t] += 0.5 * v[t - 1]
        rows += [(f"s{k}", t, float(x)) for t, x in enumerate(v)]
    return spark.createDataFrame(rows, "series_id string, slot_idx long, value double").repartition(4).cache()


def values(panel):
    out = {}
    for r in panel.orderBy("series_id", "slot_idx").collect():
        out.setdefault(r.series_id, []).append(r.value)
    return {k: np.array(v) for k, v in out.items()}


def design(v, order, exog, seed):
    x = np.lib.stride_tricks.sliding_window_view(v[:899], order)
    a = np.c_[np.ones(len(x)), x, exog[order:900]] if exog is not None else np.c_[np.ones(len(x)), x]
    day = np.arange(order, 900) // 24
    keep = np.ones(len(x), bool) if seed == 0 else ((day + 1) * (seed + 1) * 7919 % 10007) % 5 != 0
    return a[keep], v[order:900][keep]


@pytest.mark.parametrize(("order", "calendar", "slice_"), [(1, False, 1 << 16), (24, True, 1 << 16), (36, False, 100), (144, True, 200), (144, False, 1 << 16)])
def test_coefficients_equal_least_squares(spark, panel, order, calendar, slice_):
    f = M.LinearAR(order, calendar, slice_)
    exog = None
    if calendar:
        days = spark.range(1200).select(F.col("id").alias("slot_idx"), F.array(*M.calendar(F.col("id"), SPEC).values()).alias("x")).orderBy("slot_idx").collect()
        exog = np.array([r.x for r in days])
    got = {(r.series_id, r.seed): r for r in f.parameters(panel, SPEC, "ar", 3).collect()}
    assert len(got) == 9
    for k, v in values(panel).items():
        for seed in range(3):
            want = np.linalg.lstsq(*design(v, order, exog, seed), rcond=None)[0]
            assert np.abs(np.array(got[k, seed].coefficients) - want).max() < 1e-8
            assert got[k, seed].n_params == len(want) == f.n_params(SPEC)
    told = f(panel, SPEC).filter("slot_idx >= 900").orderBy("series_id", "slot_idx").collect()
    v = values(panel)["s1"]
    one = [r.y_pred for r in told if r.series_id == "s1"]
    coefficients = np.array(got["s1", 0].coefficients)
    for t in (900, 1000, 1199):
        x = np.r_[1, v[t - order : t], exog[t] if calendar else []]
        assert one[t - 900] == pytest.approx(coefficients @ x, abs=1e-9)


def test_closed_forms_equal_least_squares(spark, panel):
    days = spark.range(1200).select("id", M.is_working(M.day_of(F.col("id"), SPEC), SPEC).cast("double").alias("w")).orderBy("id").collect()
    w = np.array([[r.w] for r in days])
    for f, exog in ((M.LinearAR1(), None), (M.LinearAR1(True), w)):
        got = {(r.series_id, r.seed): r.coefficients for r in f.parameters(panel, SPEC, "x", 2).collect()}
        for k, v in values(panel).items():
            for seed in (0, 1):
                want = np.linalg.lstsq(*design(v, 1, exog, seed), rcond=None)[0]
                assert np.allclose(got[k, seed], want, atol=1e-9)
    flat = panel.withColumn("value", F.lit(2.0))
    assert {tuple(r.coefficients) for r in M.LinearAR1(True).parameters(flat, SPEC, "x").collect()} == {(None, None, 0.0)}
    assert {tuple(r.coefficients) for r in M.LinearAR1().parameters(flat, SPEC, "x").collect()} == {(None, None)}


def test_predicting_twice_fits_once(spark, panel, monkeypatch):
    path, models = f"{tempfile.mkdtemp(prefix='params-')}/t", {"naive": "naive", "ar1": "linear_ar1", "ar6": "linear_ar_6"}
    first = M.predictions(panel, SPEC, models, 2, path)
    want = sorted(map(tuple, first.collect()), key=str)
    fits = []
    for kind in (M.LinearAR, M.LinearAR1):
        monkeypatch.setattr(kind, "fit", lambda self, *a: fits.append(self) or pytest.fail("fitted again"))
    # a restart knows the path alone
    assert sorted(map(tuple, M.predictions(panel, SPEC, models, 2, path).collect()), key=str) == want and not fits
    stored = spark.read.parquet(path)
    assert {(r.model, r.seed, r.n_params) for r in stored.collect()} == {("ar1", 0, 2), ("ar1", 1, 2), ("ar6", 0, 7), ("ar6", 1, 7)}
    monkeypatch.undo()
    other = SeriesSpec(n_slots=1200, bounds=(800, 1050, 1150))  # another training slice is another version
    assert M.fit_all(panel, other, models, 2, path).select("version").distinct().count() == 4
    assert sorted(map(tuple, M.predictions(panel, SPEC, models, 2, path).collect()), key=str) == want


def test_seeds_refit_and_what_needs_no_fit_has_one(spark, panel):
    p = M.predictions(panel, SPEC, {"naive": "naive", "ar1": "linear_ar1"}, 3).filter("slot_idx = 1000 and series_id = 's0'").collect()
    assert sorted((r.model, r.seed) for r in p) == [("ar1", 0), ("ar1", 1), ("ar1", 2), ("naive", 0)]
    assert len({r.y_pred for r in p if r.model == "ar1"}) == 3
    days = spark.range(30).select(*[M.left_out(F.col("id"), s).alias(f"s{s}") for s in range(1, 4)]).collect()
    gone = [{k for k, r in enumerate(days) if r[f"s{s}"]} for s in range(1, 4)]
    assert all(3 <= len(g) <= 9 for g in gone) and len({frozenset(g) for g in gone}) == 3


def test_names(panel):
    for name in ("naive", "seasonal_naive_daily", "seasonal_naive_144", "seasonal_naive_weekly", "seasonal_naive_1008", "time_of_day_mean", "time_of_day_mean_4d", "linear_ar", "linear_ar_6", "linear_ar_36", "linear_ar_144", "gbt"):
        assert isinstance(M.build(name), M.Forecaster)
    assert M.build("linear_ar_36", order=7).order == 7 and M.build("seasonal_naive_weekly").season == "week"
    with pytest.raises(TypeError):
        M.build("naive", nothing=1)


def test_patience():
    assert M.least_before_patience([5, 4, 3, 4, 4, 4], 3) == 2
    assert M.least_before_patience([5, 4, 3, 4, 4], 3) is None
    assert M.least_before_patience([5, 5, 5, 5], 3) == 0 and M.least_before_patience([], 3) is None


def test_boosted_trees(spark):
    # the value repeats one of two levels by its lag: the first tree says it all, and further ones are no better
    rows = [(k, t, float(10 * (t % 2) + k)) for k in range(2) for t in range(1200)]
    panel = spark.createDataFrame(rows, "series_id int, slot_idx long, value double")
    f = M.BoostedTrees(lags=(1, 2), rounds=12, patience=3)
    told = f(panel, SPEC).filter("slot_idx >= 2").collect()
    assert len(told) == 2 * 1198 and all(abs(r.y_pred - r.value) < 1e-9 for r in told)
    assert (told[0].rounds, told[0].leaves) == (1, 4) and told[0].validation_mae == pytest.approx(0, abs=1e-9)
    # with noise the validation error falls slowly at first and then no more
    r = np.random.default_rng(5)
    v = np.zeros(1200)
    for t in range(1, 1200):
        v[t] = 0.9 * v[t - 1] + r.normal()
    noisy = spark.createDataFrame([(1, t, float(x)) for t, x in enumerate(v)], "series_id int, slot_idx long, value double")
    model, report = M.BoostedTrees(lags=(1,), rounds=60, patience=10).train(noisy, SPEC)
    assert 1 <= report["rounds"] <= 60 and report["rounds"] == len(model.trees) and report["leaves"] <= 32 * report["rounds"]
    assert 0.6 < report["validation_mae"] < 1.2
