"""Quantities over many lags, against direct formulas."""

import math

import numpy as np
import pytest

from tessera.operators import lags as L


def table(spark, series):
    rows = [(k, t, None if v is None else float(v)) for k, vs in series.items() for t, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_id string, slot_idx long, value double").repartition(5)


def gammas(y, k):
    u = np.asarray(y) - np.mean(y)
    return np.array([u[j:] @ u[: len(u) - j] for j in range(k + 1)])


@pytest.fixture(scope="module")
def series():
    r = np.random.default_rng(2)
    e = r.normal(size=2400)
    ar = np.zeros(2400)
    for t in range(2400):
        ar[t] = e[t] + (0.6 * ar[t - 1] if t else 0) + (0.3 * ar[t - 288] if t >= 288 else 0)
    return {"ar": ar, "walk": np.cumsum(r.normal(size=500)), "noise": r.normal(size=300) + 1e6, "flat": np.full(40, 3.0), "gap": [1.0, None, 2.0], "one": [5.0]}


def test_autocovariances(spark, series):
    got = {r.series_id: r for r in L.autocovariances(table(spark, series), ["series_id"], 1100).collect()}
    for k in ("ar", "walk", "noise"):
        want = gammas(series[k], min(1100, len(series[k]) - 1))
        assert np.allclose(got[k].gammas, want, atol=1e-7 * want[0]) and got[k].n == len(series[k])
    assert got["gap"].gammas is None and got["one"].gammas == [0.0] and max(map(abs, got["flat"].gammas)) == 0
    assert L.autocovariances(table(spark, series).limit(0), ["series_id"], 3).collect() == []


def test_partials_equal_regressions_on_all_lags_before(spark, series):
    rows = L.partials(table(spark, series), ["series_id"], 1100).collect()
    got = {(r.series_id, r.lag): r for r in rows}
    g = gammas(series["ar"], 1100)
    r = g / g[0]
    at = np.abs(np.subtract.outer(np.arange(1100), np.arange(1100)))
    for k in (1, 2, 3, 50, 287, 288, 301, 700, 1100):  # the last coefficient of the regression of that order
        want = np.linalg.solve(r[at[:k, :k]], r[1 : k + 1])[-1]
        assert got["ar", k].pacf == pytest.approx(want, abs=1e-9) and got["ar", k].acf == pytest.approx(r[k], abs=1e-9)
    assert got["ar", 1].pacf == got["ar", 1].acf
    assert max(k for s, k in got if s == "walk") == 499 and not any(s in ("flat", "gap", "one") for s, _ in got)


def kpss(y, form):
    y = np.asarray(y)
    n, t = len(y), np.arange(len(y))
    u = y - (y.mean() if form == "c" else np.polyval(np.polyfit(t, y, 1), t))
    prod = lambda j: u[j:] @ u[: n - j]
    c = int(n ** (2 / 9))
    s0, s1 = prod(0) / n + sum(prod(i) / (n / 2) for i in range(1, c + 1)), sum(i * prod(i) / (n / 2) for i in range(1, c + 1))
    lag = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    v = (prod(0) + 2 * sum(prod(i) * (1 - i / (lag + 1)) for i in range(1, lag + 1))) / n
    return lag, (np.cumsum(u) ** 2).sum() / n**2 / v


def test_kpss(spark, series):
    got = {(r.series_id, r.form): r for r in L.kpss(table(spark, series), ["series_id"]).collect()}
    at = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}
    for k in ("ar", "walk"):
        for form in ("c", "ct"):
            lag, stat = kpss(series[k], form)
            r = got[k, form]
            assert r.lag == lag and r.kpss == pytest.approx(stat, rel=1e-8)
            assert r.kpss_p == pytest.approx(np.interp(stat, at[form], (0.1, 0.05, 0.025, 0.01)))
            assert r.capped == (not at[form][0] <= stat <= at[form][-1])
    assert got["walk", "c"].kpss_p < 0.05
    assert [got[k, "c"].kpss for k in ("flat", "gap", "one")] == [None] * 3 and got["flat", "ct"].kpss_p is None


def test_tests_of_differences(spark, series):
    x = table(spark, series).withColumnRenamed("value", "d")
    got = {(r.series_id, r.rule, r.lag): r for r in L.dm_tests(x, ["series_id"]).collect()}
    for k in ("ar", "walk"):
        y, n = np.asarray(series[k]), len(series[k])
        g = gammas(y, 400)
        rule = math.floor(1.5 * n ** (1 / 3))
        u = y - y.mean()
        rho = min(max((u[1:] @ u[:-1]) / (u[:-1] @ u[:-1]), -0.97), 0.97)
        plug = math.floor(1.1447 * (4 * rho**2 / ((1 - rho) ** 2 * (1 + rho) ** 2) * n) ** (1 / 3))
        for name, lag in [("newey_west", rule), ("andrews", plug), *[("grid", j) for j in L.GRID]]:
            se = math.sqrt((g[0] + 2 * sum((1 - j / (lag + 1)) * g[j] for j in range(1, min(lag, n - 1) + 1))) / n**2)
            r = got[k, name, lag]
            assert r.se == pytest.approx(se, rel=1e-6) and r.t == pytest.approx(y.mean() / se, rel=1e-6) and r.hln_se == pytest.approx(se * math.sqrt(n / (n - 1)), rel=1e-6)
            assert r.p == pytest.approx(math.erfc(abs(r.t) / math.sqrt(2)), abs=2e-7) and (r.hi - r.lo) / 2 == pytest.approx(1.959963985 * r.se)
    assert got["flat", "newey_west", 5].se is None and got["gap", "grid", 0].p is None and got["one", "andrews", 0].t is None
    # at lag 0 with the small-sample factor: the one-sample t statistic
    y = np.asarray(series["ar"])
    assert got["ar", "grid", 0].hln_t == pytest.approx(y.mean() / (y.std(ddof=1) / math.sqrt(len(y))), rel=1e-9)


def test_ljung_box(spark, series):
    x = table(spark, series).withColumnRenamed("value", "d")
    got = {r.series_id: r for r in L.ljung_box(x, ["series_id"]).collect()}
    y = series["noise"]
    g = gammas(y, 24)
    r, n = g / g[0], len(y)
    q = n * (n + 2) * sum(r[k] ** 2 / (n - k) for k in range(1, 25))
    assert got["noise"].q == pytest.approx(q, rel=1e-6) and np.allclose(got["noise"].acf, r, atol=1e-7)
    step = np.linspace(0, q, 200_001)  # the chi-square density with 24 degrees of freedom, integrated
    density = step**11 * np.exp(-step / 2) / (2**12 * math.gamma(12))
    assert got["noise"].p == pytest.approx(1 - np.trapezoid(density, step), abs=1e-6)
    assert got["ar"].p < 1e-9
