"""The streaming steps.

A step has ``initialize_state`` and ``process_event`` for streams, and on batches a
plan that gives the same columns. ``group_cols`` keeps a state for each group.
"""

from __future__ import annotations

import math
import pickle
from abc import abstractmethod
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from chronomesh.frame import EventFrame
from chronomesh.functions.time import micros, seconds
from chronomesh.operators.kernels import BLOCK, decayed_sum, event_order, own_rows, running, sequenced
from chronomesh.operators.point_process import positive
from chronomesh.operators.spatial import unused
from chronomesh.pipeline import Step
from chronomesh.registry import step
from chronomesh.streaming.state import StreamEvent, StreamWindow

TYPES = {"double": DoubleType(), "long": LongType(), "int": IntegerType()}


class StreamingStep(Step):
    """Columns from events one after the other.

    Subclasses give ``outputs`` (name to type), ``initialize_state`` and
    ``process_event``, which may change the state in place. ``run`` here works for
    any of them: rows are dealt out by group, sorted, and streamed through the
    state machine with the memory of one state.
    """

    group_cols: Sequence[str] = ()
    step_name = "streaming_step"

    @abstractmethod
    def outputs(self) -> dict[str, str]: ...

    @abstractmethod
    def initialize_state(self) -> Any: ...

    @abstractmethod
    def process_event(self, event: StreamEvent, state: Any) -> dict[str, Any]: ...

    def plan(self, frame: EventFrame) -> DataFrame:
        return self.sequential(frame)

    def run(self, event_frame: EventFrame) -> EventFrame:
        return event_frame.produced(self.plan(event_frame), self.step_name, self.outputs(), [event_frame.schema.timestamp_col], ["continuous"])

    def sequential(self, frame: EventFrame) -> DataFrame:
        keys, order, ts, outputs, me = list(self.group_cols), event_order(frame), frame.schema.timestamp_col, self.outputs(), self
        df = frame.df.select(*(c for c in frame.df.columns if c not in outputs))
        dealt = df.repartition(*keys) if keys else df.coalesce(1)
        ordered = dealt.sortWithinPartitions(*keys, *order)
        schema = StructType([*df.schema.fields, *(StructField(k, TYPES[t]) for k, t in outputs.items())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, state, n = None, None, 0
            for batch in batches:
                made: dict[str, list] = {k: [] for k in outputs}
                for row in batch.to_pylist():
                    key = [row[k] for k in keys]
                    if state is None or key != now:
                        now, state, n = key, me.initialize_state(), 0
                    found = me.process_event(StreamEvent(row[ts], row, n), state)
                    n += 1
                    for k in outputs:
                        made[k].append(found.get(k))
                kinds = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32()}
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, kinds[outputs[k]]) for k, v in made.items())], [*batch.schema.names, *made])

        return ordered.mapInArrow(run, schema)

    def stream(self, df: DataFrame, timestamp_col: str, keys: Sequence[str], watermark: str | None = None, id_col: str | None = None) -> DataFrame:
        """The step on a streaming DataFrame with a state for each key.

        A micro-batch's events are taken in order of time and id. With a watermark,
        events older than it are dropped before; the state never goes back.
        """
        if watermark:
            df = df.withWatermark(timestamp_col, watermark)
        outputs, me, order = self.outputs(), self, [timestamp_col, *([id_col] if id_col else [])]
        schema = StructType([*df.schema.fields, *(StructField(k, TYPES[t]) for k, t in outputs.items())])

        def run(key: tuple, parts: Iterator[pd.DataFrame], held: Any) -> Iterator[pd.DataFrame]:
            state, n = pickle.loads(held.get[0]) if held.exists else (me.initialize_state(), 0)
            rows = pd.concat(list(parts)).sort_values(order, kind="stable")
            made: dict[str, list] = {k: [] for k in outputs}
            for row in rows.to_dict("records"):
                row = {k: None if v is pd.NaT or (isinstance(v, float) and math.isnan(v)) else v for k, v in row.items()}
                found = me.process_event(StreamEvent(row[timestamp_col], row, n), state)
                n += 1
                for k in outputs:
                    made[k].append(found.get(k))
            held.update((pickle.dumps((state, n)),))
            yield rows.assign(**made)

        return df.groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", "NoTimeout")


def _number(x: Any) -> float | None:
    return None if x is None or isinstance(x, bool | str) or x != x else float(x)


@step("streaming_window", "temporal", "continuous")
@dataclass
class StreamingWindowStep(StreamingStep):
    """Size, length in seconds and leavers of a window bounded by number and time."""

    window_size: int = 100
    window_duration: str | None = None
    emit_on_expire: bool = False
    group_cols: Sequence[str] = ()

    def __post_init__(self) -> None:
        positive(window_size=self.window_size)
        unused(self, emit_on_expire=False)

    def outputs(self) -> dict[str, str]:
        return {"stream_window_size": "long", "stream_window_duration": "double", "stream_events_expired": "long"}

    def initialize_state(self) -> StreamWindow:
        return StreamWindow(self.window_size, seconds(self.window_duration) if self.window_duration else None)

    def process_event(self, event: StreamEvent, state: StreamWindow) -> dict[str, Any]:
        gone = state.add(event)
        length = (event.timestamp - state.events[0].timestamp).total_seconds()
        return {"stream_window_size": len(state), "stream_window_duration": length, "stream_events_expired": len(gone)}

    def plan(self, frame: EventFrame) -> DataFrame:
        order, m = event_order(frame), self.window_size
        df, window = sequenced(frame.df, list(self.group_cols), order, [], m + 1)
        df = df.withColumn("_us", micros(order[0])).withColumn("_rn", F.row_number().over(window))
        start = F.greatest(F.col("_rn") - (m - 1), F.lit(1))
        first_us = F.min("_us").over(window.rowsBetween(-(m - 1), 0))
        if self.window_duration:
            keys = [*self.group_cols, *([BLOCK] if BLOCK in df.columns else [])]
            span = Window.partitionBy(*keys).orderBy("_us").rangeBetween(-round(seconds(self.window_duration) * 1e6), 0)
            start = F.greatest(start, F.min("_rn").over(span))
            first_us = F.greatest(first_us, F.min("_us").over(span))
        df = df.withColumns({"_start": start, "_first": first_us})
        made = {
            "stream_window_size": (F.col("_rn") - F.col("_start") + 1).cast("long"),
            "stream_window_duration": (F.col("_us") - F.col("_first")) / F.lit(1e6),
            "stream_events_expired": (F.col("_start") - F.coalesce(F.lag("_start").over(window), F.lit(1))).cast("long"),
        }
        return own_rows(df.withColumns(made), [*(c for c in frame.df.columns if c not in made), *made])


@step("online_statistics", "temporal", "continuous")
@dataclass
class OnlineStatisticsStep(StreamingStep):
    """Running mean, deviation, minimum and maximum, ``{col}_online_{statistic}``; null values give nulls and are left out.

    ``decay_factor`` below 1 with ``decay=True`` makes mean and deviation
    exponentially weighted (streams and sequential runs only).
    """

    value_cols: Sequence[str]
    statistics: Sequence[str] = ("mean", "std", "min", "max")
    decay_factor: float = 0.99
    decay: bool = False
    group_cols: Sequence[str] = ()

    def __post_init__(self) -> None:
        if odd := [s for s in self.statistics if s not in ("mean", "std", "min", "max")]:
            raise ValueError(f"unknown statistics: {odd}")

    def outputs(self) -> dict[str, str]:
        return {f"{c}_online_{s}": "double" for c in self.value_cols for s in self.statistics}

    def initialize_state(self) -> dict[str, list[float]]:
        return {c: [0.0, 0.0, 0.0, math.inf, -math.inf] for c in self.value_cols}

    def process_event(self, event: StreamEvent, state: dict[str, list[float]]) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for c in self.value_cols:
            x = _number(event.attributes.get(c))
            if x is None:
                continue
            s = state[c]
            keep = self.decay_factor if self.decay else 1.0
            s[0] = s[0] * keep + 1
            gap = x - s[1]
            s[1] += gap / s[0]
            s[2] = s[2] * keep + gap * (x - s[1])
            s[3], s[4] = min(s[3], x), max(s[4], x)
            std = math.sqrt(s[2] / (s[0] - 1)) if s[0] > 1 else 0.0
            found = {"mean": s[1], "std": std, "min": s[3], "max": s[4]}
            out |= {f"{c}_online_{k}": found[k] for k in self.statistics}
        return out

    def plan(self, frame: EventFrame) -> DataFrame:
        if self.decay:
            return self.sequential(frame)
        order, keys, columns, df = event_order(frame), list(self.group_cols), frame.df.columns, frame.df
        centre = df.agg(*(F.avg(c).alias(f"_c{i}") for i, c in enumerate(self.value_cols)))  # sums of small numbers
        df = df.join(F.broadcast(centre))
        sums, low, high = {}, {}, {}
        for i, c in enumerate(self.value_cols):
            x = F.col(c).cast("double") - F.col(f"_c{i}")
            sums |= {f"_n{i}": F.when(x.isNotNull(), 1).otherwise(0), f"_s{i}": F.coalesce(x, F.lit(0.0)), f"_q{i}": F.coalesce(x * x, F.lit(0.0))}
            low[f"_lo{i}"], high[f"_hi{i}"] = F.col(c).cast("double"), F.col(c).cast("double")
        df = running(df, keys, order, sums)
        if "min" in self.statistics:
            df = running(df, keys, order, low, "min")
        if "max" in self.statistics:
            df = running(df, keys, order, high, "max")
        made = {}
        for i, c in enumerate(self.value_cols):
            n, s, q = (F.col(f"_{k}{i}") for k in "nsq")
            variance = (q - s * s / F.greatest(n, F.lit(1))) / F.greatest(n - 1, F.lit(1))
            found = {"mean": F.col(f"_c{i}") + s / F.greatest(n, F.lit(1)), "std": F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), variance))).otherwise(F.lit(0.0)), "min": F.col(f"_lo{i}"), "max": F.col(f"_hi{i}")}
            made |= {f"{c}_online_{k}": F.when(F.col(c).isNotNull(), found[k]) for k in self.statistics}
        return df.withColumns(made).select(*(c for c in columns if c not in made), *made)


@step("streaming_hawkes", "temporal", "continuous")
@dataclass
class StreamingHawkesStep(StreamingStep):
    """Triggering that decays between events and grows by alpha * beta at each, the present one included."""

    alpha: float = 0.5
    beta: float = 1.0
    mu: float = 0.1
    time_unit: str = "1h"
    update_threshold: float = 0.001
    group_cols: Sequence[str] = ()

    def __post_init__(self) -> None:
        positive(alpha=self.alpha, beta=self.beta, mu=self.mu)
        unused(self, update_threshold=0.001)

    def outputs(self) -> dict[str, str]:
        return {"streaming_hawkes_intensity": "double", "streaming_hawkes_trigger": "double"}

    def initialize_state(self) -> list:
        return [None, 0.0]

    def process_event(self, event: StreamEvent, state: list) -> dict[str, Any]:
        gap = (event.timestamp - state[0]).total_seconds() if state[0] is not None else 0.0
        state[0] = event.timestamp
        state[1] = state[1] * math.exp(-self.beta / seconds(self.time_unit) * gap) + self.alpha * self.beta
        return {"streaming_hawkes_intensity": self.mu + state[1], "streaming_hawkes_trigger": state[1]}

    def plan(self, frame: EventFrame) -> DataFrame:
        df = decayed_sum(frame.df, list(self.group_cols), event_order(frame), F.lit(self.alpha * self.beta), self.beta / seconds(self.time_unit), "streaming_hawkes_trigger")
        return df.withColumn("streaming_hawkes_intensity", F.col("streaming_hawkes_trigger") + F.lit(float(self.mu)))


@step("event_buffer", "temporal", "continuous")
@dataclass
class EventBufferStep(StreamingStep):
    """Place in a buffer that is emptied when full, or ``flush_interval`` after it was emptied last."""

    buffer_size: int = 1000
    flush_interval: str | None = None
    flush_on_full: bool = True
    group_cols: Sequence[str] = ()

    def __post_init__(self) -> None:
        positive(buffer_size=self.buffer_size)

    def outputs(self) -> dict[str, str]:
        return {"buffer_position": "long", "buffer_fill_ratio": "double", "buffer_flush_count": "long"}

    def initialize_state(self) -> list:
        return [0, None, 0]

    def process_event(self, event: StreamEvent, state: list) -> dict[str, Any]:
        state[0] += 1
        late = self.flush_interval and state[1] is not None and (event.timestamp - state[1]).total_seconds() >= seconds(self.flush_interval)
        if (self.flush_on_full and state[0] >= self.buffer_size) or late:
            state[:] = [0, event.timestamp, state[2] + 1]
        return {"buffer_position": state[0], "buffer_fill_ratio": state[0] / self.buffer_size, "buffer_flush_count": state[2]}

    def plan(self, frame: EventFrame) -> DataFrame:
        if self.flush_interval and self.flush_on_full:
            return self.sequential(frame)  # a flush depends on the flush before: there is no closed form
        columns, size = frame.df.columns, self.buffer_size
        df = running(frame.df, list(self.group_cols), event_order(frame), {"_rank": F.lit(1)})
        place = F.pmod(F.col("_rank"), F.lit(size)) if self.flush_on_full else F.col("_rank")
        made = {
            "buffer_position": place.cast("long"),
            "buffer_fill_ratio": place / F.lit(float(size)),
            "buffer_flush_count": (F.floor(F.col("_rank") / size) if self.flush_on_full else F.lit(0)).cast("long"),
        }
        return df.withColumns(made).select(*(c for c in columns if c not in made), *made)


@step("streaming_decay", "temporal", "continuous")
@dataclass
class StreamingDecayStep(StreamingStep):
    """Exponentially decayed sums, ``{col}_decayed_sum``; nulls count as 0."""

    value_cols: Sequence[str]
    decay_rate: float = 0.1
    time_unit: str = "1h"
    group_cols: Sequence[str] = ()

    def __post_init__(self) -> None:
        positive(decay_rate=self.decay_rate)

    def outputs(self) -> dict[str, str]:
        return {f"{c}_decayed_sum": "double" for c in self.value_cols}

    def initialize_state(self) -> dict[str, Any]:
        return {"last": None, **dict.fromkeys(self.outputs(), 0.0)}

    def process_event(self, event: StreamEvent, state: dict[str, Any]) -> dict[str, Any]:
        gap = (event.timestamp - state["last"]).total_seconds() if state["last"] is not None else 0.0
        state["last"], factor = event.timestamp, math.exp(-self.decay_rate / seconds(self.time_unit) * gap)
        for c in self.value_cols:
            state[f"{c}_decayed_sum"] = state[f"{c}_decayed_sum"] * factor + (_number(event.attributes.get(c)) or 0.0)
        return {k: state[k] for k in self.outputs()}

    def plan(self, frame: EventFrame) -> DataFrame:
        df = frame.df
        for c in self.value_cols:
            df = decayed_sum(df, list(self.group_cols), event_order(frame), F.coalesce(F.col(c).cast("double"), F.lit(0.0)), self.decay_rate / seconds(self.time_unit), f"{c}_decayed_sum")
        return df


@step("streaming_inter_event", "temporal", "continuous")
@dataclass
class StreamingInterEventStep(StreamingStep):
    """Seconds since the last event, their exponential moving average, and events per unit of time so far."""

    ema_alpha: float = 0.1
    time_unit: str = "1h"
    group_cols: Sequence[str] = ()

    def __post_init__(self) -> None:
        if not 0 < self.ema_alpha <= 1:
            raise ValueError("ema_alpha must be above 0 and at most 1")

    def outputs(self) -> dict[str, str]:
        return {"streaming_inter_event": "double", "streaming_inter_event_ema": "double", "streaming_event_rate": "double"}

    def initialize_state(self) -> list:
        return [None, None, 0, None]

    def process_event(self, event: StreamEvent, state: list) -> dict[str, Any]:
        first, last, n, ema = state
        first = event.timestamp if first is None else first
        gap = (event.timestamp - last).total_seconds() if last is not None else 0.0
        if last is not None:
            ema = gap if ema is None else self.ema_alpha * gap + (1 - self.ema_alpha) * ema
        state[:] = [first, event.timestamp, n + 1, ema]
        total = (event.timestamp - first).total_seconds()
        rate = (n + 1) / (total / seconds(self.time_unit)) if total > 0 else 0.0
        return {"streaming_inter_event": gap, "streaming_inter_event_ema": ema or 0.0, "streaming_event_rate": rate}

    def plan(self, frame: EventFrame) -> DataFrame:
        order, keys, columns, a = event_order(frame), list(self.group_cols), frame.df.columns, self.ema_alpha
        ts = order[0]
        df = frame.df.withColumn("_us", micros(ts))
        df = running(df, keys, order, {"_rank": F.lit(1)})
        df = running(df, keys, order, {"_first": F.col("_us")}, "min")
        df, window = sequenced(df, keys, order, ["_us"], 1)
        gap = F.coalesce((F.col("_us") - F.lag("_us").over(window)) / F.lit(1e6), F.lit(0.0))
        df = own_rows(df.withColumn("streaming_inter_event", gap), [*columns, "_us", "_rank", "_first", "streaming_inter_event"])
        weight = F.when(F.col("_rank") == 2, 1.0).otherwise(F.lit(float(a))) * F.col("streaming_inter_event")
        if a < 1:
            df = decayed_sum(df, keys, order, weight, -math.log(1 - a), "streaming_inter_event_ema", position=F.col("_rank"))
        else:
            df = df.withColumn("streaming_inter_event_ema", F.col("streaming_inter_event"))
        total = (F.col("_us") - F.col("_first")) / F.lit(1e6)
        rate = F.when(total > 0, F.col("_rank") / (F.greatest(total, F.lit(1e-6)) / seconds(self.time_unit))).otherwise(F.lit(0.0))
        return df.withColumn("streaming_event_rate", rate).select(*columns, *self.outputs())
