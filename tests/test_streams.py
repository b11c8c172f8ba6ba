"""Streams with state of their own, over restarts, late rows and batches that come again."""

import shutil
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans.common import SPEC
from tessera.streaming import keyed as K
from tessera.streaming import twins as S


def put(spark, path, rows):
    """One file of events (event_id, hours after the origin, channel, value)."""
    table = spark.createDataFrame([(i, float(h), k, None if v is None else float(v)) for i, h, k, v in rows], "event_id long, hours double, event_type string, value double")
    ts = (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("hours") * 3600)).cast("timestamp_ntz")
    table.select("event_id", ts.alias("ts"), F.lit(1).cast("long").alias("user_id"), "event_type", "value", F.lit("{}").alias("props")).coalesce(1).write.mode("append").parquet(path)


def runs(spark, batches, make):
    """All batches, each taken by a query that starts again from the last one's checkpoint."""
    at = tempfile.mkdtemp(prefix="streams-")
    for rows in batches:
        put(spark, f"{at}/in", rows)
        out = S.run_to_end(make(S.read_events(spark, f"{at}/in")), f"{at}/out", f"{at}/state")
    return out


def events(seed, hours, keys=("a", "b")):
    r = np.random.default_rng(seed)
    return [(k, h, keys[k % len(keys)], v) for k, (h, v) in enumerate(zip(np.sort(r.uniform(0, hours, 400)), r.uniform(1, 5, 400), strict=True))]


def dense(rows, key, end):
    x = np.zeros(end)
    for _, h, k, v in rows:
        if k == key and h < end:
            x[int(h)] += v or 0
    return x


def test_forecasts_equal_batch_ones_over_restarts(spark):
    rows = events(1, 200.0)
    rows = [x for x in rows if not 60 < x[1] < 90 or x[2] == "a"]  # b is silent for a day
    cut = [rows[:150], rows[150:151], rows[151:320], rows[320:]]
    # rows of the second last batch come out of order, within the watermark
    cut[2] = cut[2][::-1]
    got = runs(spark, cut, lambda s: K.online_forecast(s, SPEC, "event_type")).orderBy("series_id", "slot_idx").collect()
    end = int(max(h for _, h, _, _ in rows) - 1)
    assert [(r.series_id, r.slot_idx) for r in got] == [(k, s) for k in "ab" for s in range(end)]
    for k in "ab":
        x, mine = dense(rows, k, end), [r for r in got if r.series_id == k]
        for s, r in enumerate(mine):
            assert r.value == pytest.approx(x[s])
            assert r.naive == (pytest.approx(x[s - 1]) if s else None)
            assert r.seasonal == (pytest.approx(x[s - 24]) if s >= 24 else None)
            assert r.tod == (pytest.approx(x[[s - 24 * d for d in (1, 2, 3, 4)]].mean()) if s >= 96 else None)


def test_silence_is_told_once_and_cleared(spark):
    batches = [
        [(1, 0.5, "a", 1), (2, 0.5, "b", 1), (3, 1.5, "c", 0)],  # c has rows, but no value
        [(4, 12.5, "b", 2)],  # by now a is silent for more than ten slots
        [(5, 20.5, "b", 2)],
        [(6, 30.5, "a", 4), (7, 30.7, "a", None)],
        [(8, 50.5, "d", 1)],
    ]
    rows = runs(spark, batches, lambda s: K.stalled(s, SPEC, 10, "event_type")).collect()
    told = {(r.series_id, r.last_slot, r.status, r.slot_idx) for r in rows}
    assert len(rows) == len(told)
    assert told == {
        ("a", 0, "stalled", 11), ("a", 0, "resumed", 30), ("a", 30, "stalled", 41),
        ("b", 0, "stalled", 11), ("b", 0, "resumed", 12), ("b", 20, "stalled", 31), ("c", -1, "stalled", 10),
    }  # d's slot is not closed yet
    batch = {k: max([s for _, s, c, v in sum(batches, []) if c == k and v], default=-1) for k in "abc"}
    now = {}
    for r in sorted(rows, key=lambda r: (r.slot_idx, r.status == "resumed")):
        now[r.series_id] = (r.status, r.last_slot)
    assert now == {k: ("stalled", int(batch[k]) if batch[k] >= 0 else -1) for k in "abc"}


def test_daily_store_stays_the_same_when_batches_come_again(spark):
    at = tempfile.mkdtemp(prefix="streams-")
    put(spark, f"{at}/in", [(1, 1, "a", 1), (2, 23, "a", 2), (None, 3, "a", 5), (None, 3, "a", 6)])
    put(spark, f"{at}/in", [(3, 22, "b", 3), (4, 25, "a", 4), (1, 1, "a", 1)])

    def days():
        store = S.daily_sink(S.read_files(spark, f"{at}/in", files=1), f"{at}/days", f"{at}/state")
        return sorted((str(r.date), r["sum(value)"], r["count"]) for r in store.groupBy("date").agg(F.sum("value"), F.count("*").alias("count")).collect())

    want = [("2024-01-01", 17.0, 5), ("2024-01-02", 4.0, 1)]
    assert days() == want
    shutil.rmtree(f"{at}/state/commits")  # as if the last batches had not been told as done
    assert days() == want
    shutil.rmtree(f"{at}/state")
    assert days() == want
    put(spark, f"{at}/in", [(9, 26, "c", 10)])
    assert days() == [want[0], ("2024-01-02", 14.0, 2)]


def test_late_rows_are_kept_apart_over_restarts(spark):
    at = tempfile.mkdtemp(prefix="streams-")
    for rows in ([(1, 30, "a", 1)], [(2, 2, "a", 1), (3, 20, "a", 1), (4, 40, "a", 1)], [(5, 29, "a", 1), (6, 30, "a", 2), (7, 31, "a", 3)], [(8, 5, "a", 1)]):
        put(spark, f"{at}/in", rows)
        kept, late = S.split_late(S.read_files(spark, f"{at}/in", files=1), 10 * 3600, f"{at}/out", f"{at}/state")
    assert {(r.event_id, r.batch) for r in late.collect()} == {(2, 1), (3, 1), (5, 2), (6, 2), (8, 3)}
    assert {r.event_id for r in kept.collect()} == {1, 4, 7}
    shutil.rmtree(f"{at}/state/commits")
    kept, late = S.split_late(S.read_files(spark, f"{at}/in", files=1), 10 * 3600, f"{at}/out", f"{at}/state")
    assert kept.count() == 3 and late.count() == 5
    first = tempfile.mkdtemp(prefix="streams-")
    put(spark, f"{first}/in", [(1, 1, "a", 1)])
    assert S.split_late(S.read_files(spark, f"{first}/in"), 60, f"{first}/out", f"{first}/state")[1].collect() == []


def test_sliding_means_and_sessions_equal_brute_force(spark):
    rows = events(3, 100.0, ("a",))
    rows = [x for x in rows if not 40 < x[1] < 50]
    means = runs(spark, [rows[:200], rows[200:]], lambda s: S.sliding_mean(s)).collect()
    last = max(h for _, h, _, _ in rows) - 1
    want = {}
    for begin in range(-18, 100, 6):
        inside = [v for _, h, _, v in rows if begin <= h < begin + 24]
        if inside and begin + 24 <= last:
            want[begin] = (np.mean(inside), len(inside))
    origin = np.datetime64("2024-01-01")
    got = {int((np.datetime64(r.start) - origin) / np.timedelta64(1, "h")): (r["mean"], r.n) for r in means}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)
    found = runs(spark, [rows[:200], rows[200:]], lambda s: S.sessions(s)).collect()
    times = [(h, v) for _, h, _, v in rows]
    groups = [[times[0]]]
    for t in times[1:]:
        groups.append([t]) if t[0] - groups[-1][-1][0] >= 0.5 else groups[-1].append(t)
    closed = [g for g in groups if g[-1][0] + 0.5 <= last]
    assert sorted((r.n, round(r.value, 6)) for r in found) == sorted((len(g), round(sum(v for _, v in g), 6)) for g in closed)
