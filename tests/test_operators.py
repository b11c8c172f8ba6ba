"""Guards, ties and schemas that the queries' tables don't reach."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import forecast as M
from tessera.operators import panel as P
from tessera.operators import spatial as G
from tessera.plans.common import SPEC
from tessera.spec import RESULT, TRAINING, SeriesSpec


def test_truth_and_forecasts_must_meet(spark):
    t = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0)], "series_id string, slot_idx long, value double")
    p = t.select("series_id", "slot_idx", (F.col("value") + 1).alias("y_pred"), F.lit("m").alias("model"))
    assert [tuple(r) for r in M.paired(t, p, ["series_id", "slot_idx"]).orderBy("slot_idx").collect()] == [("a", 1, 2.0, 3.0, "m"), ("a", 2, 3.0, 4.0, "m")]
    for truth, forecasts in ((t.filter("slot_idx = 1"), p), (t, p.filter("slot_idx = 1"))):
        with pytest.raises(Exception, match="no truth, or no forecast, at a 2"):
            M.paired(truth, forecasts, ["series_id", "slot_idx"]).collect()
    assert M.paired(t.limit(0), p.limit(0), ["series_id", "slot_idx"]).collect() == []


def test_log_is_compared_at_its_own_decimals(spark):
    derived = spark.createDataFrame([("a", 1.2345), ("b", 1.2345), ("c", 7.0)], "k string, mae double")
    log = spark.createDataFrame([("a", "1.23"), ("b", "1.24"), ("c", "7")], "k string, logged string")
    assert {(r.k, r.places, r.drift) for r in M.reconciled(derived, log, ["k"], "mae").collect()} == {("a", 2, False), ("b", 2, True), ("c", 0, False)}


def test_focus_area(spark):
    areas = spark.createDataFrame([("b",), ("a",), ("c",)], "area string")
    of = lambda *names: spark.createDataFrame([(n,) for n in names], "area string")
    for asked, control, want in (("z", of("b"), "z"), (None, of("b", "b"), "b"), (None, of("b", "c"), "a"), (None, of("other"), "a"), (None, None, "a"), (None, of("b").limit(0), "a")):
        assert [r.area for r in M.focus_area(areas, asked, control).collect()] == [want]


def test_training_frame_has_its_schema(spark):
    spec = SeriesSpec(n_slots=60, bounds=(30, 40, 50), season=12)
    panel = spark.range(60).select(F.lit("a").alias("series_id"), F.col("id").alias("slot_idx"), (F.col("id") % 7).cast("double").alias("value"))
    x = M.training_frame(panel, spec, 5)
    assert [(f.name, f.dataType) for f in x.schema] == [(f.name, f.dataType) for f in TRAINING]
    rows = x.orderBy("slot_idx").collect()
    assert len(rows) == 55 and rows[0].slot_idx == 5 and len(rows[0].lags) == len(rows[0].exog) == 5 and rows[0].truth == 5.0
    train = [t % 7 for t in range(30)]
    mean = sum(train) / 30
    sd = (sum((v - mean) ** 2 for v in train) / 30) ** 0.5
    assert rows[0].target == pytest.approx((5 - mean) / sd) and rows[0].scale == pytest.approx(sum(abs(train[t] - train[t - 12]) for t in range(12, 30)) / 18)
    assert "n_params" in RESULT.fieldNames()


def test_grid_guards_and_ties(spark):
    flat = spark.range(1, 101).select(F.col("id").alias("series_id"), F.floor((F.col("id") - 1) / 10).alias("row"), ((F.col("id") - 1) % 10).alias("col"), F.lit(1.0).alias("total"))
    with pytest.raises(ValueError, match="bands of 3"):
        G.row_bands(flat, 3, SPEC)
    shares = G.row_bands(flat, 5, SPEC).orderBy("band").collect()
    assert [r.share for r in shares] == [0.5, 0.5] and shares[0].lat_to == shares[1].lat_from
    best = {r.series_id: r for r in G.best_neighbours(flat, 1, 2, SPEC).collect()}
    assert (best[1].dr, best[1].dc) == (0, 0) and (best[55].dr, best[55].dc, best[55].best) == (-1, -1, 1.0)  # equal ones: the first in scan order
    high = flat.withColumn("total", F.when(F.col("series_id") == 56, 9.0).otherwise(1.0))
    best = {r.series_id: (r.dr, r.dc) for r in G.best_neighbours(high, 1, 2, SPEC).collect()}
    assert best[55] == (0, 1) and best[45] == (1, 1) and best[56] == (0, 0)
    low = {r.series_id: r for r in G.best_neighbours(high, 1, 2, SPEC, most=False).collect()}
    assert low[56].best == 1.0 and (low[56].dr, low[56].dc) == (-1, -1)
    points = spark.createDataFrame([(5, 5, 1, 0), (5, 5, 0, 1), (5, 5, -1, 0), (5, 5, 0, -1), (5, 5, 0, 0)], "row int, col int, dr int, dc int")
    assert [r.p for r in points.select(G.step_compass(F.col("row"), F.col("col"), F.col("dr"), F.col("dc"), 10).alias("p")).collect()] == ["N", "E", "S", "W", None]
    box = G.zoom_box(flat.filter("series_id in (12, 34)"), 1, SPEC).first()
    assert tuple(box) == (0, 4, 0, 4)


def test_records_outside_the_axis_are_set_apart(spark):
    raw = spark.createDataFrame([(1, 0), (1, 719), (1, 720), (1, -1), (0, 5), (101, 5), (None, 5), (1, None)], "series_id long, slot_idx long")
    good, bad = P.validate(raw, SPEC)
    assert good.count() == 2 and bad.count() == 6


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_prefix_sums_over_hot_values(spark, parts):
    from tessera.operators import stats as S

    rows = [(k, 5.0 if k % 3 else float(k % 17)) for k in range(400)]
    t = spark.createDataFrame(rows, "id long, v double").repartition(7)
    for order, by in ((["v", "id"], lambda r: (r[1], r[0])), (["-v", "-id"], lambda r: (-r[1], -r[0])), (["-v", "id"], lambda r: (-r[1], r[0]))):
        got = sorted((r["rank"], r.id, r.running) for r in S.prefix_sums(t, order, "v", parts).collect())
        want, total = [], 0.0
        for k, (i, v) in enumerate(sorted(rows, key=by)):
            total += v
            want.append((k + 1, i, total))
        assert got == want
    assert S.prefix_sums(t.limit(0), ["v", "id"], "v", parts).collect() == []
