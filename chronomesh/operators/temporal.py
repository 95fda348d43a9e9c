"""Temporal steps and functions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.frame import EventFrame
from chronomesh.functions.time import seconds, time_floor, whole_seconds
from chronomesh.operators.features import shifted
from chronomesh.operators.kernels import asof_join, event_order, own_rows, sequenced
from chronomesh.pipeline import Step
from chronomesh.registry import step

#: Parts of a timestamp; weekday is 1 on Monday.
COMPONENTS = {
    "hour": F.hour, "weekday": lambda t: F.weekday(t) + 1, "day_of_week": lambda t: F.weekday(t) + 1, "day": F.dayofmonth,
    "day_of_month": F.dayofmonth, "day_of_year": F.dayofyear, "month": F.month, "year": F.year, "week": F.weekofyear,
    "week_of_year": F.weekofyear, "quarter": F.quarter, "is_weekend": lambda t: F.weekday(t) >= 5,
}
DEFAULT_COMPONENTS = ("hour", "weekday", "day", "month", "year", "is_weekend")
#: Column prefix, period and values of the calendar encodings.
CALENDAR = {
    "hour": ("hour", 24, range(24)), "day_of_week": ("dow", 7, range(1, 8)), "day_of_month": ("dom", 31, range(1, 32)),
    "month": ("month", 12, range(1, 13)), "week_of_year": ("woy", 53, range(1, 54)),
}


def _extracted(frame: EventFrame, components: Sequence[str], name: str) -> EventFrame:
    if odd := [c for c in components if c not in COMPONENTS]:
        raise ValueError(f"unknown components: {odd}")
    ts = frame.schema.timestamp_col
    return frame.produced(frame.df.withColumns({c: COMPONENTS[c](F.col(ts)) for c in components}), name, components, [ts], ["temporal"])


@step("extract_temporal_components", "temporal")
@dataclass
class ExtractTemporalComponentsStep(Step):
    """Hour, weekday (1 is Monday), day, month, year, ISO week, quarter, is_weekend (Saturday, Sunday)."""

    components: Sequence[str] = DEFAULT_COMPONENTS

    def with_components(self, *components: str) -> ExtractTemporalComponentsStep:
        return ExtractTemporalComponentsStep(components)

    def run(self, event_frame: EventFrame) -> EventFrame:
        return _extracted(event_frame, self.components, self.step_name)


def extract_temporal_components(event_frame: EventFrame, components: Sequence[str] = DEFAULT_COMPONENTS) -> EventFrame:
    return _extracted(event_frame, components, "extract_temporal_components")


@step("time_bins", "temporal")
@dataclass
class TimeBinsStep(Step):
    """Timestamps cut down to bins of a duration."""

    bin_size: str = "1h"
    bin_col: str = "time_bin"

    def run(self, event_frame: EventFrame) -> EventFrame:
        ts = event_frame.schema.timestamp_col
        df = event_frame.df.withColumn(self.bin_col, time_floor(ts, self.bin_size))
        out = event_frame.produced(df, self.step_name, [self.bin_col], [ts], ["temporal"], bin_size=self.bin_size)
        return out.with_metadata(time_bin=self.bin_size).require_context(temporal_resolution=self.bin_size)


def create_time_bins(event_frame: EventFrame, bin_size: str = "1h", bin_col: str = "time_bin") -> EventFrame:
    df = event_frame.df.withColumn(bin_col, time_floor(event_frame.schema.timestamp_col, bin_size))
    return event_frame.with_df(df).with_metadata(time_bin=bin_size)


def create_temporal_windows(event_frame: EventFrame, window_sizes: Sequence[str]) -> EventFrame:
    """The tumbling window of each size, ``window_{size}``."""
    ts = event_frame.schema.timestamp_col
    return event_frame.with_df(event_frame.df.withColumns({f"window_{w}": time_floor(ts, w) for w in window_sizes}))


@step("recency_weight", "temporal")
@dataclass
class RecencyWeightStep(Step):
    """Weight that halves every ``half_life`` units before the reference time (default: the last event)."""

    half_life: float = 7.0
    time_unit: str = "1d"
    reference_time: str | None = None
    output_col: str = "recency_weight"

    def __post_init__(self) -> None:
        if self.half_life <= 0:
            raise ValueError("half_life must be positive")

    def run(self, event_frame: EventFrame) -> EventFrame:
        ts = event_frame.schema.timestamp_col
        rate = 0.693147 / (self.half_life * seconds(self.time_unit))  # the constant is part of the definition
        df = event_frame.df
        if self.reference_time is None:
            df = df.join(F.broadcast(df.agg(F.max(ts).alias("_ref"))))  # one row
        else:
            df = df.withColumn("_ref", F.lit(self.reference_time).cast("timestamp_ntz"))
        df = df.withColumn(self.output_col, F.exp(-rate * whole_seconds(F.col(ts), F.col("_ref")))).drop("_ref")
        return event_frame.produced(df, self.step_name, [self.output_col], [ts], ["temporal"])


@step("calendar_encoding", "temporal")
@dataclass
class CalendarEncodingStep(Step):
    """Calendar parts as sines and cosines, numbers or indicators."""

    encoding_type: str = "cyclical"
    components: Sequence[str] = ("hour", "day_of_week", "month")

    def __post_init__(self) -> None:
        if self.encoding_type not in ("cyclical", "ordinal", "onehot"):
            raise ValueError(f"unknown encoding: {self.encoding_type}")
        if odd := [c for c in self.components if c not in CALENDAR]:
            raise ValueError(f"unknown components: {odd}")

    def run(self, event_frame: EventFrame) -> EventFrame:
        ts, made = event_frame.schema.timestamp_col, {}
        for c in self.components:
            prefix, period, values = CALENDAR[c]
            x = COMPONENTS[c](F.col(ts))
            if self.encoding_type == "cyclical":
                angle = F.lit(2 * math.pi) * x / F.lit(period)
                made |= {f"{prefix}_sin": F.sin(angle), f"{prefix}_cos": F.cos(angle)}
            elif self.encoding_type == "ordinal":
                made[f"{prefix}_ordinal"] = x
            else:
                made |= {f"{prefix}_{v}": F.coalesce(x == v, F.lit(False)).cast("int") for v in values}
        return event_frame.produced(event_frame.df.withColumns(made), self.step_name, made, [ts], ["temporal"])


@step("temporal_lag", "temporal")
@dataclass
class TemporalLagStep(Step):
    """Values of earlier rows, ``{col}_lag_{k}``; a negative lag looks ahead."""

    value_cols: Sequence[str]
    lag_periods: Sequence[int] = (1,)
    time_unit: str = "1d"
    group_cols: Sequence[str] = ()

    def with_lags(self, *lags: int) -> TemporalLagStep:
        return TemporalLagStep(self.value_cols, lags, self.time_unit, self.group_cols)

    def run(self, event_frame: EventFrame) -> EventFrame:
        lags = list(self.lag_periods)
        df, window = sequenced(event_frame.df, list(self.group_cols), event_order(event_frame), self.value_cols, max(0, *lags), max(0, *(-k for k in lags)))
        made = {f"{c}_lag_{k}": shifted(c, k, window) for c in self.value_cols for k in lags}
        df = own_rows(df.withColumns(made), [*event_frame.df.columns, *made])
        return event_frame.produced(df, self.step_name, made, [*self.value_cols, *self.group_cols], ["temporal"], time_unit=self.time_unit)


@step("moving_average", "temporal")
@dataclass
class MovingAverageStep(Step):
    """Means of the last rows, ``{col}_ma_{w}``, or of the rows around."""

    value_cols: Sequence[str]
    windows: Sequence[int] = (7,)
    time_unit: str = "1d"
    group_cols: Sequence[str] = ()
    center: bool = False

    def with_windows(self, *windows: int) -> MovingAverageStep:
        return MovingAverageStep(self.value_cols, windows, self.time_unit, self.group_cols, self.center)

    def run(self, event_frame: EventFrame) -> EventFrame:
        most = max(self.windows)
        df, window = sequenced(event_frame.df, list(self.group_cols), event_order(event_frame), self.value_cols, most, most if self.center else 0)
        spans = {w: (-(w // 2), (w - 1) // 2) if self.center else (-(w - 1), 0) for w in self.windows}
        made = {f"{c}_ma_{w}": F.avg(c).over(window.rowsBetween(*spans[w])) for c in self.value_cols for w in self.windows}
        df = own_rows(df.withColumns(made), [*event_frame.df.columns, *made])
        return event_frame.produced(df, self.step_name, made, [*self.value_cols, *self.group_cols], ["temporal"])


@step("inter_arrival", "temporal")
@dataclass
class InterArrivalStep(Step):
    """Whole seconds since the row before, with rolling means and deviations."""

    group_cols: Sequence[str] = ()
    output_col: str = "inter_arrival_seconds"
    include_stats: bool = False
    stat_windows: Sequence[int] = (10, 50)

    def run(self, event_frame: EventFrame) -> EventFrame:
        ts, out = event_frame.schema.timestamp_col, self.output_col
        most = 1 + (max(self.stat_windows) if self.include_stats else 0)
        df, window = sequenced(event_frame.df, list(self.group_cols), event_order(event_frame), [], most)
        df = df.withColumn(out, whole_seconds(F.lag(ts).over(window), F.col(ts)))
        made = {}
        if self.include_stats:
            for w in self.stat_windows:
                rows = window.rowsBetween(-(w - 1), 0)
                made |= {f"{out}_ma_{w}": F.avg(out).over(rows), f"{out}_std_{w}": F.stddev_samp(out).over(rows)}
        columns = [out, *made]
        df = own_rows(df.withColumns(made), [*(c for c in event_frame.df.columns if c != out), *columns])
        return event_frame.produced(df, self.step_name, columns, [ts, *self.group_cols], ["temporal"])


_DIRECTIONS = {"before": "backward", "after": "forward", "nearest": "nearest"}


def align_temporal(
    event_frame: EventFrame, context: DataFrame, context_ts: str, strategy: str = "nearest", window: str | None = None, ties: Sequence[str] = ()
) -> EventFrame:
    """Columns of the context row at the same time (exact), or before, after or nearest, up to ``window`` away.

    Of several rows at one time before takes the last and after the first by the order
    of ``ties``, such as an id, and then of all columns as they stand.
    """
    ts = event_frame.schema.timestamp_col
    cols = [c for c in context.columns if c != context_ts]
    if strategy == "exact":
        other = context.withColumnRenamed(context_ts, "_ts")
        df = event_frame.df.join(other, F.col(ts) == F.col("_ts"), "left").drop("_ts")
    elif strategy in _DIRECTIONS:
        df = asof_join(event_frame.df, context, ts, context_ts, cols, direction=_DIRECTIONS[strategy], tolerance=window, ties=ties)
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return event_frame.with_df(df)


def compute_time_deltas(event_frame: EventFrame, references: DataFrame, reference_ts: str, delta_col: str = "time_delta") -> EventFrame:
    """Whole seconds from the nearest reference time to the event, negative if the reference is later."""
    ts = event_frame.schema.timestamp_col
    df = asof_join(event_frame.df, references, ts, reference_ts, [], direction="nearest", keep_ts="_near")
    return event_frame.with_df(df.withColumn(delta_col, whole_seconds(F.col("_near"), F.col(ts))).drop("_near"))
