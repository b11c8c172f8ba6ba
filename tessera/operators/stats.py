"""Descriptive statistics of totals and panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _place(v: Column, bounds: list, descending: bool) -> Column:
    """How many of the bounds lie before v."""
    before = (lambda b: b > v) if descending else (lambda b: b < v)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), before)) if bounds else F.lit(0)


def prefix_sums(df: DataFrame, order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """Adds rank (from 1) and running (sum of value) in a global order, without one task for all rows.

    order: names of columns without nulls, "-" before those that fall; the first is a number.
    Its quantiles, taken once, deal the rows to parts, which are put in order by themselves;
    each part's count and sum make offsets, one row a part. A value that fills several
    quantiles is dealt on by the second column, if that is a number.
    """
    spark, falls = df.sparkSession, [c.startswith("-") for c in order]
    names = [c.lstrip("-") for c in order]
    kinds = dict(df.dtypes)
    count = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = [c for c in names[:2] if not kinds[c].startswith(("string", "binary", "date", "time", "bool"))]
    at = [F.lit(k / count) for k in range(1, count)]
    found = df.agg(*[F.percentile_approx(c, F.array(*at), F.lit(10_000)).alias(c) for c in numbers]).first() if at else None
    bounds = {c: sorted(found[c] or []) if found else [] for c in numbers}
    own = bounds[names[0]]
    hot = sorted({b for b, c in zip(own, own[1:]) if b == c})
    deal = [_place(F.col(names[0]), own, falls[0])]
    if hot and len(numbers) > 1:
        filled = F.col(names[0]).isin(hot)
        deal += [filled.cast("int"), F.when(filled, _place(F.col(names[1]), bounds[names[1]], falls[1])).otherwise(0)]
    dealt = df.withColumn("_part", F.struct(*[c.alias(f"p{k}") for k, c in enumerate(deal)]))
    rows = [F.col(c).desc() if down else F.col(c).asc() for c, down in zip(names, falls, strict=True)]
    inside = Window.partitionBy("_part").orderBy(*rows).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*rows))).withColumn("_run", F.sum(value).over(inside))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    offsets = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s")))  # a row a part
    return local.join(offsets, "_part").withColumn("rank", F.col("_rank") + F.col("_n")).withColumn("running", F.col("_run") + F.col("_s")).drop("_part", "_rank", "_run", "_n", "_s")


def gini(value: str) -> Column:
    """Over prefix_sums in ascending order: 2*sum(rank*v)/(n*sum v) - (n+1)/n; null if all is 0."""
    return F.try_divide(2 * F.sum(F.col("rank") * F.col(value)), F.count("*") * F.sum(value)) - F.try_divide(F.count("*") + 1, F.count("*"))


def competition_rank(df: DataFrame, value: str) -> DataFrame:
    """Ties share the least rank, largest first."""
    ranked = prefix_sums(df.groupBy(value).agg(F.count("*").cast("double").alias("_ties")), [f"-{value}"], "_ties")
    return df.join(ranked.select(value, (F.col("running") - F.col("_ties") + 1).cast("long").alias("competition_rank")), value)


def centred_average(value: str, period: int, window) -> Column:
    """Trend of the classical decomposition: centred mean of a period, half weights at both ends if it is even; null where it lacks rows."""
    h = period // 2
    if period % 2:
        return F.when(F.count(value).over(window.rowsBetween(-h, h)) == period, F.avg(value).over(window.rowsBetween(-h, h)))
    inner = F.sum(value).over(window.rowsBetween(1 - h, h - 1))
    ends = 0.5 * (F.lag(value, h).over(window) + F.lead(value, h).over(window))
    return (inner + ends) / period
