"""How a table of records is read as a fleet of series in slots."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

RAW = T.StructType([T.StructField("square_id", T.IntegerType()), T.StructField("time_interval", T.LongType()), T.StructField("country_code", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("sms_in", "sms_out", "call_in", "call_out", "internet")]])
PREDICTION = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("series_id", T.StringType()), T.StructField("model", T.StringType()), T.StructField("seed", T.IntegerType()), T.StructField("slot_idx", T.LongType()), T.StructField("y_pred", T.DoubleType())])

#: windows of all series, and what a forecaster's run over one of them leaves
TRAINING = T.StructType([T.StructField("series_id", T.StringType()), T.StructField("slot_idx", T.LongType()), T.StructField("split", T.StringType()), T.StructField("lags", T.ArrayType(T.DoubleType())), T.StructField("target", T.DoubleType()), T.StructField("exog", T.ArrayType(T.DoubleType())), T.StructField("truth", T.DoubleType()), T.StructField("scale", T.DoubleType())])
RESULT = T.StructType([T.StructField(c, T.StringType()) for c in ("area", "model")] + [T.StructField(c, T.IntegerType()) for c in ("seed", "n_params")] + [T.StructField(c, T.DoubleType()) for c in ("val", "mae", "n_epochs", "s_per_epoch", "fit_s", "predict_ms", "latency_ms")])


@dataclass(frozen=True)
class SeriesSpec:
    """origin: first slot's start; slot_s: seconds a slot; season, week: slots a day and a week; bounds of train, validation and evaluation, in slots."""

    origin: str = "2024-01-01"
    slot_s: int = 3600
    n_slots: int = 720
    season: int = 24
    week: int = 168
    cells: int = 100
    side: int = 10
    bounds: tuple[int, int, int] = (336, 504, 672)
    holidays: tuple[str, ...] = ("2024-01-01", "2024-01-06")
    channels: tuple[str, ...] = field(default=("click", "error", "purchase", "signup", "view"))
