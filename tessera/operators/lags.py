"""What depends on many lags of a series at once: one array of autocovariances per key, and what follows from it.

A group is one series (or one slice of it); its arrays are of its own length at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inference import Z95, normal_tail

GRID = (0, 6, 15, 36, 72, 144)


def declared(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)


def named(keys: list[str], values: tuple) -> dict[str, pa.Array]:
    return {name: pa.array([v.as_py()], v.type) for name, v in zip(keys, values, strict=True)}


def in_order(table: pa.Table, value: str, time: str) -> np.ndarray:
    """Values by time; null is NaN."""
    by = np.argsort(np.asarray(table.column(time)), kind="stable")
    return table.column(value).to_numpy(zero_copy_only=False).astype(float)[by]


def products(u: np.ndarray, nlags: int) -> np.ndarray:
    """Sums of u[t] * u[t - k] for k from 0 to nlags (n - 1 at most), by one Fourier transform."""
    n = len(u)
    size = 1 << (2 * n - 1).bit_length()
    spectrum = np.fft.rfft(u, size)
    return np.fft.irfft(spectrum * spectrum.conj(), size)[: min(nlags, n - 1) + 1]


def autocovariances(panel: DataFrame, keys: list[str], nlags: int, value: str = "value", time: str = "slot_idx") -> DataFrame:
    """(keys, n, mean, gammas, final): gammas[k] is the sum of centred products at lag k, final the last centred value squared.

    A null or non-finite value makes mean, gammas and final null.
    """

    def one(key: tuple, table: pa.Table) -> pa.Table:
        y = in_order(table, value, time)
        row = named(keys, key) | {"n": pa.array([len(y)], pa.int64())}
        good = bool(np.isfinite(y).all())
        u = y - y.mean() if good else y
        told = [(float(y.mean()), products(u, nlags).tolist(), float(u[-1] ** 2))] if good else [(None, None, None)]
        mean, gammas, final = told[0]
        return pa.table(row | {"mean": pa.array([mean], pa.float64()), "gammas": pa.array([gammas], pa.list_(pa.float64())), "final": pa.array([final], pa.float64())})

    return panel.select(*keys, time, value).groupBy(*keys).applyInArrow(one, f"{declared(panel, keys)}, n long, mean double, gammas array<double>, final double")


def autocorrelation(panel: DataFrame, keys: list[str], nlags: int, value: str = "value", time: str = "slot_idx") -> DataFrame:
    """Biased sample autocorrelation: a row (keys, lag, acf, n) for each lag; null for a constant series."""
    g = autocovariances(panel, keys, nlags, value, time)
    return g.select(*keys, "n", "gammas", F.posexplode("gammas").alias("lag", "g")).select(*keys, "lag", F.when(F.get("gammas", F.lit(0)) > 0, F.col("g") / F.get("gammas", F.lit(0))).alias("acf"), "n")


def levinson(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations at lags 1 to K of rows of autocorrelations at lags 0 to K, all rows at once."""
    rows, k = r.shape[0], r.shape[1] - 1
    phi, out, left = np.zeros((rows, k)), np.zeros((rows, k)), np.ones(rows)
    for j in range(1, k + 1):
        old = phi[:, : j - 1].copy()
        with np.errstate(all="ignore"):
            new = (r[:, j] - (old * r[:, j - 1 : 0 : -1]).sum(1)) / left
        phi[:, : j - 1] = old - new[:, None] * old[:, ::-1]
        phi[:, j - 1] = out[:, j - 1] = new
        left = left * (1 - new * new)
    return out


def partials(panel: DataFrame, keys: list[str], nlags: int, value: str = "value", time: str = "slot_idx", rows: int = 256) -> DataFrame:
    """(keys, lag from 1, acf, pacf, n) of each series, by Levinson and Durbin's recursion on the autocovariances; null for a constant one. `rows` series go through it at a time."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), rows):
                part = batch.slice(lo, rows)
                gammas = part.column("gammas").to_pylist()
                told = [[] for _ in gammas]
                good = {i: np.array(g) for i, g in enumerate(gammas) if g and g[0] > 0}
                for k in {len(g) for g in good.values()}:
                    at = [i for i, g in good.items() if len(g) == k]
                    r = np.stack([good[i] / good[i][0] for i in at])
                    for i, a, p in zip(at, r, levinson(r), strict=True):
                        told[i] = [{"acf": x, "pacf": y} for x, y in zip(a[1:].tolist(), p.tolist(), strict=True)]
                made = {name: part.column(name) for name in keys} | {"n": part.column("n"), "told": pa.array(told, pa.list_(pa.struct([("acf", pa.float64()), ("pacf", pa.float64())])))}
                yield pa.RecordBatch.from_pydict(made)

    g = autocovariances(panel, keys, nlags, value, time)
    each = g.select(*keys, "n", "gammas").mapInArrow(job, f"{declared(panel, keys)}, n long, told array<struct<acf:double,pacf:double>>")
    return each.select(*keys, F.posexplode("told").alias("at", "x"), "n").select(*keys, (F.col("at") + 1).cast("long").alias("lag"), "x.acf", "x.pacf", "n")


def bartlett(gammas: Column, lag: Column) -> Column:
    """The long-run sum of products with Bartlett weights through `lag`."""
    weighted = F.transform(F.slice(gammas, F.lit(2), lag), lambda g, i: 2 * (1 - (i + 1) / (lag + 1)) * g)
    return F.aggregate(weighted, F.get(gammas, F.lit(0)), lambda s, x: s + x)


def newey_west(n: Column) -> Column:
    return F.floor(1.5 * F.pow(n.cast("double"), F.lit(1.0) / 3))


def andrews(gammas: Column, final: Column, n: Column) -> Column:
    """Plug-in bandwidth by a first-order autoregression, clipped to 0.97; 0 below three values and for constant ones."""
    r = F.greatest(F.lit(-0.97), F.least(F.lit(0.97), F.try_divide(F.get(gammas, F.lit(1)), F.get(gammas, F.lit(0)) - final)))
    alpha = 4 * r * r / (F.pow(1 - r, F.lit(2.0)) * F.pow(1 + r, F.lit(2.0)))
    return F.when(n >= 3, F.coalesce(F.floor(1.1447 * F.pow(alpha * n, F.lit(1.0) / 3)), F.lit(0).cast("long"))).otherwise(0)


def dm_tests(differences: DataFrame, keys: list[str], value: str = "d", time: str = "slot_idx", grid: tuple[int, ...] = GRID) -> DataFrame:
    """Diebold-Mariano tests of each series of loss differences at every lag of interest, from one array of autocovariances.

    (keys, rule, lag, n, mean, se, t, p, lo, hi, and se, t, p, lo, hi with the small-sample
    factor as hln_...). rule: newey_west, andrews, or grid. Null where the error is 0 or a value is not finite.
    """
    far = int(max(grid))
    n = F.col("n")
    g = autocovariances(differences, keys, 4096, value, time)  # rules of thumb stay far below; a lag beyond it is an error
    rules = [F.struct(F.lit("newey_west").alias("rule"), newey_west(n).alias("lag")), F.struct(F.lit("andrews").alias("rule"), andrews(F.col("gammas"), F.col("final"), n).alias("lag"))]
    rules += [F.struct(F.lit("grid").alias("rule"), F.lit(k).cast("long").alias("lag")) for k in grid if k <= far]
    each = g.select(*keys, "n", "mean", "gammas", F.explode(F.array(*rules)).alias("r")).select("*", "r.*").drop("r")
    lag = F.when(F.col("lag") > 4096, F.raise_error(F.lit("a lag above 4096")).cast("long")).otherwise(F.col("lag")).cast("int")
    s = bartlett(F.col("gammas"), lag)
    each = each.withColumn("_v", F.when(s > 1e-12, s / (n * n))).drop("gammas")
    for prefix, factor in (("", F.lit(1.0)), ("hln_", F.try_divide(n, n - 1))):
        se = F.sqrt(F.col("_v") * factor)
        t = F.col("mean") / se
        each = each.withColumns({f"{prefix}se": se, f"{prefix}t": t, f"{prefix}p": normal_tail(t), f"{prefix}lo": F.col("mean") - Z95 * se, f"{prefix}hi": F.col("mean") + Z95 * se})
    return each.drop("_v")


def ljung_box(differences: DataFrame, keys: list[str], m: int = 24, value: str = "d", time: str = "slot_idx") -> DataFrame:
    """(keys, n, acf: array over lags 0 to m, q, p): Q over lags 1 to m (even) and its chi-square tail, exact for an even m."""
    n = F.col("n")
    g = autocovariances(differences, keys, m, value, time).filter("gammas is not null")
    g = g.withColumn("acf", F.when(F.get("gammas", F.lit(0)) > 0, F.transform("gammas", lambda x: x / F.get("gammas", F.lit(0)))))
    q = n * (n + 2) * F.aggregate(F.transform(F.slice("acf", 2, m), lambda r, i: r * r / (n - i - 1)), F.lit(0.0), lambda s, x: s + x)
    half = F.col("q") / 2
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(s, i):
        term = s["term"] * half / i
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    tail = F.exp(-half) * F.aggregate(F.sequence(F.lit(1), F.lit(m // 2 - 1)), start, step)["total"]
    return g.withColumn("q", q).withColumn("p", tail).select(*keys, "n", "acf", "q", "p")


#: fixed values: critical values of the level and trend forms at 10, 5, 2.5 and 1 %
KPSS_AT = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}
KPSS_P = (0.10, 0.05, 0.025, 0.01)


def kpss(panel: DataFrame, keys: list[str], forms: tuple[str, ...] = ("c", "ct"), value: str = "value", time: str = "slot_idx") -> DataFrame:
    """(keys, form, n, lag, kpss, kpss_p, capped): stationarity around a level (c) or a line (ct).

    The lag is chosen for each series by its own autocovariances (Hobijn and others, 1998).
    p is interpolated between the critical values and held at the table's ends, which
    `capped` tells. Constant series, and those with values that aren't finite, give nulls.
    """

    def one(key: tuple, table: pa.Table) -> pa.Table:
        y = in_order(table, value, time)
        n, out = len(y), []
        for form in forms:
            row = {"form": form, "n": n, "lag": None, "kpss": None}
            out.append(row)
            if n < 3 or not np.isfinite(y).all() or np.ptp(y) == 0:
                continue
            u = y - y.mean()
            if form == "ct":
                t = np.arange(n) - (n - 1) / 2
                u = u - t * (t @ u) / (t @ t)
            g = products(u, n - 1)
            if g[0] <= 1e-12 * max(1.0, float(y @ y)):
                continue
            few = int(n ** (2 / 9))
            near = g[1 : few + 1] / (n / 2)
            ratio = float((near * np.arange(1, few + 1)).sum() / (g[0] / n + near.sum()))
            lag = min(int(1.1447 * (ratio**2) ** (1 / 3) * n ** (1 / 3)), n - 1)
            spread = (g[0] + 2 * (g[1 : lag + 1] * (1 - np.arange(1, lag + 1) / (lag + 1))).sum()) / n
            row |= {"lag": lag, "kpss": float((np.cumsum(u) ** 2).sum() / n**2 / spread)}
        told = {name: pa.array([r[name] for r in out], kind) for name, kind in (("form", pa.string()), ("n", pa.int64()), ("lag", pa.int64()), ("kpss", pa.float64()))}
        repeated = {k: pa.array(v.to_pylist() * len(out), v.type) for k, v in named(keys, key).items()}
        return pa.table(repeated | told)

    tested = panel.select(*keys, time, value).groupBy(*keys).applyInArrow(one, f"{declared(panel, keys)}, form string, n long, lag long, kpss double")
    k, p, capped = F.col("kpss"), F.lit(None).cast("double"), F.lit(None).cast("boolean")
    for form, at in KPSS_AT.items():
        told = F.when(k <= at[0], KPSS_P[0])
        for (a, b), (high, low) in zip(zip(at, at[1:]), zip(KPSS_P, KPSS_P[1:])):
            told = told.when(k <= b, high + (low - high) * (k - a) / (b - a))
        p = F.when(F.col("form") == form, F.when(k.isNotNull(), told.otherwise(KPSS_P[-1]))).otherwise(p)
        capped = F.when(F.col("form") == form, (k < at[0]) | (k > at[-1])).otherwise(capped)
    return tested.withColumn("kpss_p", p).withColumn("capped", capped)
