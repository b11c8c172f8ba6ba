"""Every query with SQL equals DuckDB on the smallest tables; invariants where SQL can't say it."""

import math

import duckdb
import pytest

from tessera.plans import registry

TABLES = ("customer", "events")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return str(v).replace("T", " ").replace(" 00:00:00", "") if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rel = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
    assert sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str) == want


def test_shuffle_partitions_do_not_matter(spark, sf):
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "8", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append([sorted(map(str, registry.queries()[q](spark, sf).collect())) for q in ("gini", "top_squares", "dm_test", "error_concentration")])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_ar_of_one_lag_equals_the_closed_form(spark, sf):
    from tessera.operators import forecast as M
    from tessera.plans.common import SPEC, channels

    panel = channels(spark, sf)
    a = M.build("linear_ar", order=1)(panel, SPEC).filter("slot_idx > 0").select("series_id", "slot_idx", "y_pred")
    b = M.build("linear_ar1")(panel, SPEC).filter("slot_idx > 0").select("series_id", "slot_idx", "y_pred")
    worst = a.join(b.withColumnRenamed("y_pred", "other"), ["series_id", "slot_idx"]).selectExpr("max(abs(y_pred - other)) w").first().w
    assert worst < 1e-6
    with pytest.raises(KeyError):
        M.build("nothing")
    with pytest.raises(ValueError):
        M.register("naive")(None)
