"""Stores, and tests of series that SQL can't say, on small tables."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import inference as I
from tessera.plans import registry
from tessera.sources import stores


def new_path() -> str:
    return f"{tempfile.mkdtemp(prefix='stores-')}/t"


def test_daily_store_adds_only_missing_days(spark):
    path = new_path()
    first = spark.createDataFrame([(1, "2024-01-01", 1.0), (1, "2024-01-02", 2.0)], "series_id int, date string, value double").withColumn("date", F.to_date("date"))
    stores.daily_store(first, path)
    other = first.withColumn("value", F.col("value") + 10).union(first.select("series_id", F.date_add("date", 5), "value"))
    rows = {(str(r.date), r.value) for r in stores.daily_store(other, path).collect()}
    assert rows == {("2024-01-01", 1.0), ("2024-01-02", 2.0), ("2024-01-06", 1.0), ("2024-01-07", 2.0)}
    again = {(str(r.date), r.value) for r in stores.daily_store(first.filter("value = 1").withColumn("value", F.lit(5.0)), path, overwrite=True).collect()}
    assert again == {("2024-01-01", 5.0), ("2024-01-02", 2.0), ("2024-01-06", 1.0), ("2024-01-07", 2.0)}


def test_a_stored_run_is_not_written_again(spark):
    path = new_path()
    rows = spark.createDataFrame([("a", "x", "naive", 0, 1, 2.0)], "run_id string, series_id string, model string, seed int, slot_idx long, y_pred double")
    assert stores.write_predictions(rows, path).count() == 1
    with pytest.raises(ValueError):
        stores.write_predictions(rows, path)
    assert stores.write_predictions(rows.withColumn("run_id", F.lit("b")), path).count() == 2


def test_raw_lines(spark):
    path = tempfile.mkdtemp(prefix="raw-")
    with open(f"{path}/day-2013-11-01.txt", "w") as f:
        f.write("1\t1383260400000\t39\t\t1.5\t\t\t2.25\n2\tbad\t39\t1\t1\t1\t1\t1\n")
    rows = stores.scan_raw(spark, path).orderBy("square_id").collect()
    assert [str(r.file_date) for r in rows] == ["2013-11-01"] * 2 and (rows[0].sms_in, rows[0].internet) == (None, 2.25)
    assert rows[0]._corrupt_record is None and rows[1]._corrupt_record is not None
    with pytest.raises(ValueError):
        stores.first_days(stores.scan_raw(spark, path).limit(0), 2)


def test_bootstrap(spark):
    r = np.random.default_rng(0)
    data = {"noise": r.normal(size=100), "flat": np.full(100, 3.0), "short": r.normal(size=7)}
    d = spark.createDataFrame([(k, i, float(v)) for k, vs in data.items() for i, v in enumerate(vs)], "series_id string, slot_idx long, d double")
    one = {x.series_id: x for x in I.block_bootstrap(d, ["series_id"], "d", 1, 1500).collect()}
    assert one["noise"].se == pytest.approx(data["noise"].std() / 10, rel=0.1) and one["noise"].lo < data["noise"].mean() < one["noise"].hi
    assert one["flat"].lo == pytest.approx(3) and one["flat"].se == pytest.approx(0)
    for block in (33, 100, 130):  # the last block is cut; a block of the whole length is the series itself
        got = {x.series_id: x for x in I.block_bootstrap(d, ["series_id"], "d", block, 200).collect()}
        assert got["flat"].hi == pytest.approx(3) and got["short"].lo == pytest.approx(data["short"].mean()) and got["short"].hi == pytest.approx(got["short"].lo)
    assert got["noise"].lo == pytest.approx(data["noise"].mean()) and got["noise"].se == pytest.approx(0, abs=1e-9)


def test_adf(spark):
    r = np.random.default_rng(1)
    walk = np.cumsum(r.normal(size=300))
    data = {"walk": walk, "noise": r.normal(size=300), "flat": np.ones(50), "short": np.arange(3.0)}
    d = spark.createDataFrame([(k, i, float(v)) for k, vs in data.items() for i, v in enumerate(vs)], "series_id string, slot_idx long, value double")
    got = {x.series_id: x for x in I.adf(d, ["series_id"]).collect()}
    assert got["noise"].rejects and got["noise"].adf_p < 0.001 and got["flat"].adf is None and got["short"].adf is None
    assert not got["walk"].rejects and got["walk"].adf_p > 0.05
    # the p of the 5 % critical value is 5 %
    at = spark.range(1).select(I.normal_tail(F.lit(2.1659 - 1.4412 * 2.86154 + 0.038269 * 2.86154**2)).alias("p")).first().p
    assert at / 2 == pytest.approx(0.05, abs=0.002)
    assert I.adf(d.limit(0), ["series_id"]).collect() == []


def test_bootstrap_and_normal_intervals_agree(spark, sf):
    rows = registry.queries()["compare"](spark, sf).collect()
    assert len(rows) == 10  # by both losses
    for x in rows:
        assert x.boot_lo <= x.d <= x.boot_hi and x.lo <= x.d <= x.hi


@pytest.mark.parametrize("name", ["adf", "stationarity_table"])
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).collect()
