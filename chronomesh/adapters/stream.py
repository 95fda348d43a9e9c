"""Continuous-time sequences."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from typing import Any, ClassVar, Literal

import numpy as np
import pyarrow as pa
from pydantic import BaseModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.adapters.base import BaseModalityAdapter, Output
from chronomesh.frame import EventFrame
from chronomesh.functions.time import micros
from chronomesh.operators.kernels import own_rows, running, sequenced
from chronomesh.registry import ADAPTERS


class StreamAdapterConfig(BaseModel):
    timestamp_col: str | None = None
    state_cols: list[str] | None = None
    event_type_col: str | None = None
    intensity_cols: list[str] | None = None
    time_scale: Literal["none", "normalize", "log"] = "none"
    time_origin: Literal["first", "min", "custom"] = "first"
    custom_origin: str | None = None
    return_inter_times: bool = True
    max_events: int | None = None
    fractional: bool = False
    dtype: Literal["float32", "float64"] = "float32"


@dataclass
class StreamOutput(Output):
    timestamps: np.ndarray
    states: np.ndarray
    inter_times: np.ndarray
    event_types: np.ndarray | None = None
    intensity_features: np.ndarray | None = None
    origin: float = 0.0
    time_scale_params: dict[str, float] = field(default_factory=dict)
    state_names: list[str] = field(default_factory=list)
    event_type_names: list[str] = field(default_factory=list)
    dtypes: dict[str, str] = field(default_factory=dict)
    array_fields: ClassVar[tuple[str, ...]] = ("timestamps", "states", "inter_times", "event_types", "intensity_features")

    @property
    def n_events(self) -> int:
        return len(self.timestamps)

    @property
    def n_state_dims(self) -> int:
        return self.states.shape[1]

    @property
    def n_event_types(self) -> int:
        return len(self.event_type_names)

    def get_sequences_by_type(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Times and states by the number of the event type (-1: none); without types all under 0."""
        kinds = np.zeros(self.n_events, np.int64) if self.event_types is None else self.event_types
        order = np.argsort(kinds, kind="stable")
        numbers, first = np.unique(kinds[order], return_index=True) if len(kinds) or self.event_types is not None else (np.zeros(1, np.int64), np.zeros(1, np.int64))
        return {int(k): (self.timestamps[at], self.states[at]) for k, at in zip(numbers, np.split(order, first[1:]))}


@ADAPTERS.decorator("stream", tags={"stream", "ode", "continuous"}, config_model=StreamAdapterConfig)
class StreamAdapter(BaseModalityAdapter):
    """Events in order: time since the origin in whole seconds, gaps, states, types, intensities."""

    config_class, output_class, modality, formats = StreamAdapterConfig, StreamOutput, "stream", ("json", "parquet")

    def _events(self, source: EventFrame | DataFrame) -> tuple[DataFrame, list[str], list[str]]:
        c, df, ts = self.config, self.data(source), self.timestamp(source)
        states = self.features(source, c.state_cols, c.event_type_col, *(c.intensity_cols or []))
        intensity = [x for x in c.intensity_cols or [] if x in df.columns]
        rows = df.where(F.col(ts).isNotNull())
        if c.max_events is not None:
            rows = rows.orderBy(*self.order(source)).limit(c.max_events)
        second = micros(ts) / F.lit(1e6)
        return rows.withColumn("_s", second if c.fractional else F.floor(second).cast("double")), states, intensity

    def _origin(self, rows: DataFrame) -> float:
        if self.config.time_origin == "custom":
            own = self.config.custom_origin
            if own is None:
                raise ValueError("a custom origin is asked for and not given")
            try:
                return float(own)
            except ValueError:
                return (datetime.fromisoformat(own.replace("Z", "+00:00")).replace(tzinfo=None) - datetime(1970, 1, 1)).total_seconds()
        return rows.agg(F.min("_s")).first()[0] or 0.0

    def frame(self, source: EventFrame | DataFrame) -> DataFrame:
        """Long form: the order columns, time (scaled), inter_time, event_type (number), states, intensities."""
        rows, states, intensity = self._events(source)
        c, order = self.config, self.order(source)
        rows = rows.withColumn("time", F.col("_s") - F.lit(self._origin(rows)))
        scale = self._scale(rows)
        if c.time_scale == "normalize":
            rows = rows.withColumn("time", (F.col("time") - scale["mean"]) / scale["std"])
        elif c.time_scale == "log":
            rows = rows.withColumn("time", F.log1p(F.col("time") - scale["min"] + 1))
        kept = {"time": "time", **({"event_type": "_type"} if c.event_type_col else {})}
        if c.event_type_col:
            values = rows.where(F.col(c.event_type_col).isNotNull()).select(F.col(c.event_type_col).alias("_v")).distinct()
            values = values.withColumn("_type", F.row_number().over(Window.orderBy("_v")) - 1)  # one row a type
            rows = rows.join(values, F.col(c.event_type_col) == F.col("_v"), "left")
        df, window = sequenced(rows, [], order, ["time"], 1)
        df = df.withColumn("inter_time", F.coalesce(F.col("time") - F.lag("time").over(window), F.lit(0.0)))
        columns = [*rows.columns, "inter_time"]
        out = own_rows(df, columns)
        return out.select(*order, *(F.col(v).alias(k) for k, v in kept.items()), "inter_time", *(F.coalesce(self.numeric(x), F.lit(0.0)).alias(x) for x in [*states, *intensity]))

    def placed(self, source: EventFrame | DataFrame) -> DataFrame:
        """The long form with each event's ``place`` in the whole order, from 0."""
        return running(self.frame(source), [], self.order(source), {"_rank": F.lit(1)}).withColumn("place", F.col("_rank") - 1).drop("_rank")

    def by_type(self, source: EventFrame | DataFrame) -> DataFrame:
        """The sequences by event type in long form: the order columns, number of the type (-1: none; without types all 0), time, states."""
        df = self.frame(source)
        kind = F.coalesce(F.col("event_type"), F.lit(-1)) if self.config.event_type_col else F.lit(0)
        states = self.features(source, self.config.state_cols, self.config.event_type_col, *(self.config.intensity_cols or []))
        return df.select(*self.order(source), kind.cast("long").alias("event_type"), "time", *states)

    def _scale(self, rows: DataFrame) -> dict[str, float]:
        if self.config.time_scale == "none":
            return {}
        low, mean, std = rows.agg(F.min("time"), F.avg("time"), F.stddev_pop("time")).first()
        return {"min": low or 0.0} if self.config.time_scale == "log" else {"mean": mean or 0.0, "std": std or 1.0}

    def convert(self, event_frame: EventFrame | DataFrame) -> StreamOutput:
        rows, states, intensity = self._events(event_frame)
        origin, c = self._origin(rows), self.config
        scale = self._scale(rows.withColumn("time", F.col("_s") - F.lit(origin)))
        table = self.gather(self.frame(event_frame).orderBy(*self.order(event_frame)))
        block = lambda names: np.column_stack([table[x].to_numpy() for x in names]).astype(self.dtype) if names else np.zeros((table.num_rows, 0), self.dtype)
        types, names = None, []
        if c.event_type_col:
            names = self.gather(rows.where(F.col(c.event_type_col).isNotNull()).select(c.event_type_col).distinct().orderBy(c.event_type_col))[0].to_pylist()
            types = table["event_type"].fill_null(-1).to_numpy().astype(np.int64)
        gaps = table["inter_time"].to_numpy().astype(self.dtype) if c.return_inter_times else np.zeros(0, self.dtype)
        return StreamOutput(table["time"].to_numpy().astype(self.dtype), block(states), gaps, types, block(intensity) if intensity else None, origin, scale, states, names, {"timestamps": self.dtype, "states": self.dtype})

    def to_table(self, output: StreamOutput) -> pa.Table:
        cols = {"time": output.timestamps} | ({"inter_time": output.inter_times} if len(output.inter_times) else {}) | ({} if output.event_types is None else {"event_type": output.event_types})
        cols |= {f"state_{k}": output.states[:, k] for k in range(output.n_state_dims)}
        if output.intensity_features is not None:
            cols |= {f"intensity_{k}": output.intensity_features[:, k] for k in range(output.intensity_features.shape[1])}
        return pa.table(cols)

    def from_table(self, table: pa.Table, plain: dict[str, Any]) -> StreamOutput:
        def block(prefix: str) -> np.ndarray | None:
            names = [c for c in table.column_names if c.startswith(prefix)]
            return np.column_stack([table[c].to_numpy() for c in names]) if names else None

        have = lambda c: table[c].to_numpy() if c in table.column_names else None
        states, gaps = block("state_"), have("inter_time")
        return StreamOutput(have("time"), np.zeros((table.num_rows, 0)) if states is None else states, np.zeros(0) if gaps is None else gaps, have("event_type"), block("intensity_"), **plain)
