"""Shared parts of the registered queries and of the SQL beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel as P
from ..spec import SeriesSpec

SPEC = SeriesSpec()

#: raw r, cell rollup g, cell panel p, channel panel e, cell totals t
CTE = """
r AS (SELECT user_id % 100 + 1 AS series_id, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 3600) AS BIGINT) AS slot_idx, event_type AS channel, value, json_extract_string(props, '$.k') AS country, event_id, ts FROM events),
g AS (SELECT series_id, slot_idx, sum(coalesce(value, 0)) AS value, count(value) AS n FROM r GROUP BY ALL),
p AS (SELECT c.series_id, s.slot_idx, coalesce(value, 0.0) AS value, coalesce(n, 0) > 0 AS observed FROM range(1, 101) c(series_id) CROSS JOIN range(0, 720) s(slot_idx) LEFT JOIN g USING (series_id, slot_idx)),
ge AS (SELECT channel, slot_idx, sum(value) AS value, count(value) AS n FROM r GROUP BY ALL),
e AS (SELECT c.channel AS series_id, s.slot_idx, coalesce(value, 0.0) AS value FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) c(channel) CROSS JOIN range(0, 720) s(slot_idx) LEFT JOIN ge USING (channel, slot_idx)),
t AS (SELECT series_id, sum(value) AS total, (series_id - 1) // 10 AS row, (series_id - 1) % 10 AS col FROM p GROUP BY series_id),
gt AS (SELECT slot_idx, sum(value) AS value FROM p GROUP BY slot_idx)"""


def sql(body: str) -> str:
    """body with the parts above; a body that begins with a comma adds parts of its own."""
    return f"WITH RECURSIVE {CTE}{body}" if body.lstrip().startswith(",") else f"WITH {CTE} {body}"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.panel(spark, sf_dir, SPEC)


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.channel_panel(spark, sf_dir, SPEC)


def cell_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.totals(cells(spark, sf_dir), SPEC)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.records(spark.read.parquet(f"{sf_dir}/events.parquet"), SPEC)


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


class Register:
    """Queries of a module by name, each with the SQL that it must equal (None: beyond SQL)."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, body: str | None):
        def add(f):
            self.queries[f.__name__] = f
            if body is not None:
                self.sql[f.__name__] = sql(body)
            return f

        return add
