"""Streams with state of their own for each key: forecasts from a ring of past slots, and keys that fall silent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..spec import SeriesSpec
from .twins import closed_slots

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """State of one's own needs the store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Slots(StatefulProcessor):
    """Keys whose slots come closed and in order; a timer goes off as the watermark closes a slot, with rows or without."""

    state_schema: str

    def __init__(self, spec: SeriesSpec):
        self.slot_ms = spec.slot_s * 1000
        self.origin_ms = int(np.datetime64(spec.origin).astype("datetime64[ms]").astype(np.int64))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)

    def slots(self, rows: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and values of the slots that came, in order."""
        frame = pd.concat(rows)
        number = (frame["slot_ts"].to_numpy("datetime64[ms]").astype(np.int64) - self.origin_ms) // self.slot_ms
        by = np.argsort(number)
        return number[by], frame["value"].to_numpy(float)[by]

    def end_ms(self, slot: int) -> int:
        return self.origin_ms + (slot + 1) * self.slot_ms

    def timer(self, slot: int) -> None:
        """The key's one timer, at the end of a slot."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(self.end_ms(slot))

    def close(self) -> None:
        pass


class OnlineForecast(_Slots):
    """Forecasts of each closed slot by the one before, the season before and the mean of `days` seasons before.

    State: the next slot's number and a ring of days * season values, which slot s holds at
    s modulo its length; slots without rows hold 0, as in the dense panel.
    """

    state_schema = "next long, ring array<double>"

    def __init__(self, spec: SeriesSpec, days: int = 4):
        super().__init__(spec)
        self.season, self.days = spec.season, days

    def _run(self, key: tuple, first: int, ring: list, numbers: np.ndarray, values: np.ndarray, end: int) -> pd.DataFrame:
        """Slots first to end - 1, told and put into the ring."""
        size, out = self.season * self.days, []
        came = dict(zip(numbers.tolist(), values.tolist(), strict=True))
        for s in range(first, end):
            back = lambda k: ring[(s - k) % size] if s >= k else None  # noqa: B023, E731
            seasons = [back(k * self.season) for k in range(1, self.days + 1)]
            value = came.get(s, 0.0)
            out.append((s, value, back(1), seasons[0], sum(seasons) / self.days if None not in seasons else None))
            ring[s % size] = value
        frame = pd.DataFrame(out, columns=["slot_idx", "value", "naive", "seasonal", "tod"])
        frame.insert(0, "series_id", key[0])
        return frame.astype({"naive": float, "seasonal": float, "tod": float})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        numbers, values = self.slots(rows)
        first, ring = self.state.get() if self.state.exists() else (0, [0.0] * (self.season * self.days))
        new = numbers >= first
        numbers, values = numbers[new], values[new]
        if len(numbers):
            ring, end = list(ring), int(numbers[-1]) + 1
            yield self._run(key, first, ring, numbers, values, end)
            self.state.update((end, ring))
            self.timer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, ring = self.state.get()
        ring, end = list(ring), max(first, (timerValues.getCurrentWatermarkInMs() - self.origin_ms) // self.slot_ms)
        none = np.zeros(0)
        yield self._run(key, first, ring, none, none, end)
        self.state.update((end, ring))
        self.timer(end)


class Stalled(_Slots):
    """A key is stalled once more than `quiet` slots in a row have no value; it is cleared by the next value. State: the last slot with one, and whether it is stalled."""

    state_schema = "last long, stalled boolean"

    def __init__(self, spec: SeriesSpec, quiet: int):
        super().__init__(spec)
        self.quiet = quiet

    def _frame(self, key: tuple, rows: list) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["last_slot", "status", "slot_idx"])
        frame.insert(0, "series_id", key[0])
        return frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        numbers, values = self.slots(rows)
        last, stalled = self.state.get() if self.state.exists() else (-1, False)
        out = []
        for s in numbers[values != 0].tolist():
            if s - last - 1 > self.quiet:
                if not stalled:
                    out.append((last, "stalled", last + self.quiet + 1))
                out.append((last, "resumed", s))
            last, stalled = max(last, s), False
        if out:
            yield self._frame(key, out)
        self.state.update((last, stalled))
        if not stalled:
            self.timer(last + self.quiet + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, stalled = self.state.get()
        if not stalled:
            self.state.update((last, True))
            yield self._frame(key, [(last, "stalled", last + self.quiet + 1)])


def online_forecast(events: DataFrame, spec: SeriesSpec, key: str = "series_id", days: int = 4) -> DataFrame:
    """(series_id, slot_idx, value, naive, seasonal, tod) of every slot that the watermark has closed, from each key's first rows on back to slot 0."""
    with_state_store(events.sparkSession)
    slots = closed_slots(events.filter(F.col("ts") >= F.lit(spec.origin).cast("timestamp")), key, spec.slot_s)
    return slots.groupBy("key").transformWithStateInPandas(OnlineForecast(spec, days), "series_id string, slot_idx long, value double, naive double, seasonal double, tod double", "Append", "EventTime")


def stalled(events: DataFrame, spec: SeriesSpec, quiet: int, key: str = "series_id") -> DataFrame:
    """(series_id, last_slot, status, slot_idx): stalled at the slot that makes the silence too long, resumed at the next value; last_slot is -1 where there was none before."""
    with_state_store(events.sparkSession)
    slots = closed_slots(events.filter(F.col("ts") >= F.lit(spec.origin).cast("timestamp")), key, spec.slot_s)
    return slots.groupBy("key").transformWithStateInPandas(Stalled(spec, quiet), "series_id string, last_slot long, status string, slot_idx long", "Append", "EventTime")
