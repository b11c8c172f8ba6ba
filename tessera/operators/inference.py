"""Tests of predictive accuracy and stationarity, as closed forms over columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95, Z80 = 1.959963984540054, 0.8416212335729143


def normal_tail(z: Column) -> Column:
    """Two-sided p of a normal deviate (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def holm(tests: DataFrame, family: list[str], p: str = "p", order: str = "name") -> DataFrame:
    """Step-down adjusted p within each family, capped at 1. A family is a declared list of comparisons."""
    w = Window.partitionBy(*family).orderBy(p, order)
    m = F.count("*").over(Window.partitionBy(*family))
    stepped = tests.withColumn("_s", (m - F.row_number().over(w) + 1) * F.col(p))
    return stepped.withColumn("p_holm", F.least(F.lit(1.0), F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def adf(panel: DataFrame, keys: list[str], value: str = "value", time: str = "slot_idx") -> DataFrame:
    """Augmented Dickey-Fuller test with a constant, of each series: statistic, lag of least AIC, n used, p and whether 5 % rejects.

    One series is a group. Constant series, and those too short for a lag, give nulls.
    """
    schema = panel.select(*keys).schema
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)

    def fit(y: np.ndarray, lag: int, skip: int) -> tuple[float, float]:
        """AIC and t of the level, with `lag` lagged differences and the first `skip` differences left out."""
        d = np.diff(y)
        target = d[skip:]
        columns = [y[skip:-1], *[d[skip - k : len(d) - k] for k in range(1, lag + 1)], np.ones(len(target))]
        x = np.column_stack(columns)
        beta, *_ = np.linalg.lstsq(x, target, rcond=None)
        sse = float(((target - x @ beta) ** 2).sum())
        n, k = x.shape
        cov = np.linalg.pinv(x.T @ x)[0, 0] * sse / (n - k)
        return n * (np.log(2 * np.pi * sse / n) + 1) + 2 * k, beta[0] / np.sqrt(cov)

    def one(key: tuple, table: pa.Table) -> pa.Table:
        by = np.argsort(np.asarray(table.column(time)), kind="stable")
        y = np.asarray(table.column(value), dtype=float)[by]
        n = len(y)
        most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 3)
        stat = lag = None
        if most >= 0 and np.isfinite(y).all() and np.ptp(y) > 0:
            lag = min(range(most + 1), key=lambda k: fit(y, k, most)[0])
            stat = float(fit(y, lag, lag)[1])
        row = {f.name: pa.array([k.as_py()]) for f, k in zip(schema, key, strict=True)}
        used = None if lag is None else n - lag - 1
        return pa.table(row | {"adf": pa.array([stat], pa.float64()), "lag": pa.array([lag], pa.int32()), "n_used": pa.array([used], pa.int64())})

    tested = panel.select(*keys, time, value).groupBy(*keys).applyInArrow(one, f"{names}, adf double, lag int, n_used long")
    s, n = F.col("adf"), F.col("n_used")
    # fixed values: MacKinnon's response surfaces for a constant and one series (1994: p; 2010: 5 % critical value)
    small = 2.1659 + 1.4412 * s + 0.038269 * s * s
    large = 1.7339 + 0.93202 * s - 0.12745 * s * s - 0.010368 * s * s * s
    z = F.when(s <= -1.61, small).otherwise(large)
    below = F.when(z < 0, normal_tail(z) / 2).otherwise(1 - normal_tail(z) / 2)
    p = F.when(s > 2.74, 1.0).when(s < -18.83, 0.0).otherwise(below)
    critical = -2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.04 / (n * n * n)
    return tested.withColumn("adf_p", F.when(s.isNotNull(), p)).withColumn("rejects", s < critical)


def verdict(adf_rejects: Column, kpss_rejects: Column) -> Column:
    """Both tests read together. The four texts."""
    return (
        F.when(adf_rejects & ~kpss_rejects, "stationary (ADF rejects unit root; KPSS keeps stationarity)")
        .when(kpss_rejects & ~adf_rejects, "unit root (ADF keeps unit root; KPSS rejects stationarity)")
        .when(adf_rejects & kpss_rejects, "both reject: no unit root but not level-stationary (drift or changing variance)")
        .when(~adf_rejects & ~kpss_rejects, "inconclusive: neither test rejects its null")
    )


def block_bootstrap(d: DataFrame, keys: list[str], value: str, block: int, draws: int = 10_000, seed: int = 0, time: str = "slot_idx") -> DataFrame:
    """Percentile interval and standard error of each series' mean by circular blocks.

    Sums of all blocks come from one window a series; a draw joins hashed starts with
    them, so its cost is the number of blocks and not of slots. The last block is cut to
    the series' length.
    """
    n = F.count("*").over(Window.partitionBy(*keys))
    x = d.select(*keys, F.col(value).alias("_v"), (F.row_number().over(Window.partitionBy(*keys).orderBy(time)) - 1).alias("at"), n.alias("n"))
    turns = F.explode(F.sequence(F.lit(0), F.ceil((block - 1) / F.col("n")).cast("int")))
    wrapped = x.withColumn("_turn", turns).withColumn("_slot", F.col("at") + F.col("_turn") * F.col("n")).filter(F.col("_slot") < F.col("n") + block - 1)
    tail = F.when(F.col("n") % block == 0, block).otherwise(F.col("n") % block)
    running = Window.partitionBy(*keys).orderBy("_slot")
    s = wrapped.withColumn("_sum", F.sum("_v").over(running.rowsBetween(Window.unboundedPreceding, 0)))
    begin = F.lag("_sum", 1, 0.0).over(running)
    sums = s.select(*keys, "n", F.col("_slot").alias("start"), (F.lead("_sum", block - 1).over(running) - begin).alias("whole"), begin.alias("_before"), "_sum")
    ends = s.select(*keys, (F.col("_slot") - tail + 1).alias("start"), F.col("_sum").alias("_end"))
    starts = sums.filter(F.col("start") < F.col("n")).join(ends, [*keys, "start"], "left").select(*keys, "start", "whole", (F.col("_end") - F.col("_before")).alias("cut"))
    sizes = d.groupBy(*keys).agg(F.count("*").alias("n"))
    drawn = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    random = F.conv(F.substr(F.md5(F.concat_ws("/", F.lit(seed), *keys, "draw", "block")), F.lit(1), F.lit(8)), 16, 10).cast("long")
    drawn = drawn.withColumn("block", F.explode(F.sequence(F.lit(1), F.col("blocks")))).withColumn("start", random % F.col("n"))
    part = F.when(F.col("block") < F.col("blocks"), F.col("whole")).otherwise(F.col("cut"))
    means = drawn.join(starts, [*keys, "start"]).groupBy(*keys, "draw", "n").agg((F.sum(part) / F.col("n")).alias("m"))
    return means.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"), F.stddev_samp("m").alias("se"))
