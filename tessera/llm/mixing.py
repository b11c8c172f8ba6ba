"""Mixing sources to target weights (operator 5), in DataFrame functions only.

Hierarchical budgeting over a tree of columns (domain, language, source). Each node gives
its budget to its children by weight, none more than its subtree can deliver in
`max_epochs` passes; what one child can't take goes to its siblings, and only what the
whole family can't take goes back to the family's own siblings. That is, from the root
down, a filling of children by weight under their caps.

A leaf's budget is then spent on whole epochs and a prefix of one more, in an order drawn
by seed and epoch. The prefix is found in two steps: tokens by leaf and slice of the
order (the first digits of the hash), whose running sums tell the one slice in which the
budget ends, and a running sum inside that slice. No task sees a whole leaf.

Defined cases: a null or empty text has no tokens and is taken with its place in the
order; a null level value counts as ''; rows that repeat an id have one place and are
taken in turn; weights that are absent are 1, and 0 gives nothing; a leaf without tokens
gets no budget; an empty table gives no rows; all columns of the input come back, so
names that clash with the results are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE = 3  # hex digits of the order's hash: 4096 slices a leaf
LEAVES = 20_000  # up to so many leaves the plan is broadcast

WEIGHTS = {
    "domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0},
    "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0},
}
LEVELS = ("domain", "lang", "source")


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The sources of these tables, in four domains by number."""
    number = F.try_to_number(F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})", 1), F.lit("999999999"))
    return F.concat(F.lit("d"), F.coalesce(number.cast("long"), F.lit(0)) % 4)


def _weight(level: str, weights: dict) -> Column:
    value = F.lit(1.0)
    for name, weight in weights.get(level, {}).items():
        value = F.when(F.col(level) == name, F.lit(float(weight))).otherwise(value)
    return value


def budgets(leaves: DataFrame, levels: tuple[str, ...], weights: dict, share: float, max_epochs: int) -> DataFrame:
    """leaves: level columns and tokens. Adds budget (double)."""
    plan = leaves.withColumn("cap", F.col("tokens").cast("double") * max_epochs)
    plan = plan.withColumn("given", F.sum("tokens").over(Window.partitionBy()) * share)
    for depth, level in enumerate(levels):
        family = list(levels[:depth])
        nodes = plan.groupBy(*family, level).agg(F.sum("cap").alias("cap"), F.first("given").alias("given")).withColumn("w", _weight(level, weights))
        nodes = nodes.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0.0))
        order = Window.partitionBy(*family).orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(0.0), level)
        before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
        nodes = nodes.withColumn("left", F.greatest(F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.lit(0.0))).withColumn("rest", F.sum("w").over(after))
        full = F.col("cap") * F.col("rest") <= F.col("left") * F.col("w")
        everyone = Window.partitionBy(*family)
        nodes = nodes.withColumn("full", full).withColumn("open", F.coalesce(F.max(F.when(~F.col("full"), F.col("left") / F.col("rest"))).over(everyone), F.lit(0.0)))
        nodes = nodes.select(*family, level, F.when(F.col("full"), F.col("cap")).otherwise(F.col("open") * F.col("w")).alias("given"))
        plan = plan.drop("given").join(nodes, [*family, level])
    return plan.withColumnRenamed("given", "budget").drop("cap")


def mix_sources(docs: DataFrame, levels: tuple[str, ...] = LEVELS, weights: dict | None = None, share: float = 1.0, max_epochs: int = 2, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows taken, once an epoch: all columns of docs, mix_tokens, mix_epoch (from 1). share: the total budget, as a share of all tokens. Levels that docs lacks: domain, by domain_of(source)."""
    clash = {"mix_tokens", "mix_epoch"} & set(docs.columns)
    if clash:
        raise ValueError(f"docs has columns {sorted(clash)}")
    weights = WEIGHTS if weights is None else weights
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else domain_of(F.col("source"))
    keys = [f"_mix_{c}" for c in levels]
    given = docs.withColumns({k: level(c) for k, c in zip(keys, levels, strict=True)}).withColumn("mix_tokens", n_words(F.col(text_col)))
    leaves = given.groupBy(*keys).agg(F.sum("mix_tokens").alias("tokens")).withColumnsRenamed(dict(zip(keys, levels, strict=True)))
    spent = budgets(leaves, levels, weights, share, max_epochs).withColumnsRenamed(dict(zip(levels, keys, strict=True)))
    whole = F.floor(F.when(F.col("tokens") > 0, (F.col("budget") + 1e-6) / F.col("tokens")).otherwise(0.0))
    plan = spent.withColumn("_mix_whole", whole).withColumn("_mix_part", F.floor(F.col("budget") + 1e-6) - F.col("_mix_whole") * F.col("tokens")).select(*keys, "_mix_whole", "_mix_part")
    plan = plan.withColumn("_mix_part", F.greatest("_mix_part", F.lit(0)))
    small = plan.limit(LEAVES + 1).count() <= LEAVES
    hint = F.broadcast if small else (lambda x: x)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_mix_whole") + 1, F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    placed = given.join(hint(plan), keys).withColumn("_mix_order", order).withColumn("_mix_slice", F.substring("_mix_order", 1, SLICE))
    slices = placed.groupBy(*keys, "_mix_slice").agg(F.sum("mix_tokens").alias("n"), F.first("_mix_part").alias("part"))
    run = slices.withColumn("end", F.sum("n").over(Window.partitionBy(*keys).orderBy("_mix_slice")))
    ends = run.groupBy(*keys).agg(
        F.min(F.when(F.col("end") > F.col("part"), F.struct(F.col("_mix_slice").alias("slice"), (F.col("part") - F.col("end") + F.col("n")).alias("room")))).alias("_mix_end")
    )
    placed = placed.join(hint(ends), keys)
    at, stop = F.col("_mix_slice"), F.col("_mix_end.slice")
    sure = placed.filter(stop.isNull() | (at != stop) | (F.col("_mix_whole") > 0)).withColumn("_mix_more", F.coalesce(at < stop, F.lit(True)))
    edge = placed.filter(at == stop)
    order_in = Window.partitionBy(*keys).orderBy("_mix_order", "mix_tokens", text_col).rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("_mix_more", F.sum("mix_tokens").over(order_in) <= F.col("_mix_end.room")).filter("_mix_more")
    only = edge.withColumn("_mix_whole", F.col("_mix_whole")).select(*docs.columns, "mix_tokens", (F.col("_mix_whole") + 1).alias("mix_epoch"))
    count = F.col("_mix_whole") + F.when((at != stop) | stop.isNull(), F.col("_mix_more").cast("long")).otherwise(0)
    often = sure.withColumn("_mix_times", count).filter("_mix_times > 0").select(*docs.columns, "mix_tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_times"))).alias("mix_epoch"))
    return often.union(only)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix_sources(docs).select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", "mix_epoch", "mix_tokens")


def _fill(depth: int) -> str:
    level, family = LEVELS[depth], ", ".join(LEVELS[:depth])
    by = f"PARTITION BY {family}" if family else ""
    keys = f"{family + ', ' if family else ''}{level}"
    cases = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in WEIGHTS.get(level, {}).items())
    weight = f"CASE {cases} ELSE 1.0 END" if cases else "1.0"
    return f"""
n{depth} AS (SELECT {keys}, sum(cap) AS cap, any_value(given) AS given, CAST(any_value({weight}) AS DOUBLE) AS w FROM p{depth} GROUP BY ALL),
m{depth} AS (SELECT *, greatest(given - coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS lft,
  sum(w) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM n{depth}),
o{depth} AS (SELECT *, coalesce(max(CASE WHEN cap * rest <= lft * w THEN NULL ELSE lft / rest END) OVER ({by}), 0) AS lam FROM m{depth}),
p{depth + 1} AS (SELECT p.* EXCLUDE (given), CASE WHEN o.cap * rest <= lft * w THEN o.cap ELSE lam * w END AS given FROM p{depth} p JOIN o{depth} o USING ({keys}))"""


_SQL = f"""
WITH d AS (SELECT doc_id, text, 'd' || (CAST(regexp_extract(source, '([0-9]{{1,9}})', 1) AS BIGINT) % 4) AS domain, lang, source,
  CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n FROM documents),
leaf AS (SELECT domain, lang, source, sum(n) AS tokens FROM d GROUP BY ALL),
p0 AS (SELECT *, CAST(tokens AS DOUBLE) * 2 AS cap, CAST((SELECT sum(tokens) FROM leaf) AS DOUBLE) AS given FROM leaf),{",".join(_fill(k) for k in range(3))},
plan AS (SELECT *, CASE WHEN tokens > 0 THEN floor((given + 1e-6) / tokens) ELSE 0 END AS whole FROM p3),
o AS (SELECT d.*, whole, greatest(floor(given + 1e-6) - whole * tokens, 0) AS part, md5('11:' || CAST(CAST(whole + 1 AS BIGINT) AS VARCHAR) || ':' || doc_id) AS h FROM d JOIN plan USING (domain, lang, source)),
r AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY h, n, text ROWS UNBOUNDED PRECEDING) <= part AS more FROM o)
SELECT doc_id, domain, lang, source, CAST(e AS BIGINT) AS mix_epoch, n AS mix_tokens
FROM (SELECT *, unnest(generate_series(1, CAST(whole AS BIGINT) + CASE WHEN more THEN 1 ELSE 0 END)) AS e FROM r)"""

QUERIES = {"op5_mixing": op5_mixing}
SQL = {"op5_mixing": _SQL}
