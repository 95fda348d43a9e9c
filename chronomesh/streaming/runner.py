"""Pipelines over batches, micro-batches, single events and streams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.frame import EventFrame
from chronomesh.pipeline import Pipeline, Step, is_streaming_step
from chronomesh.streaming.state import StreamEvent, batch_stream_iterator


class StreamPipeline(Step):
    """Streaming steps in a row, with states that live as long as the pipeline."""

    def __init__(self, steps: Iterable[Any], maintain_state: bool = True):
        self.steps, self.maintain_state = list(steps), maintain_state
        self._state: list[Any] = []
        self._seen = 0
        self.reset_state()

    def reset_state(self) -> None:
        self._state, self._seen = [s.initialize_state() for s in self.steps], 0

    def add_step(self, step: Any) -> StreamPipeline:
        self.steps.append(step)
        self._state.append(step.initialize_state())
        return self

    def run(self, event_frame: EventFrame) -> EventFrame:
        """All events at once, by the steps' closed forms."""
        return Pipeline(self.steps).run(event_frame)

    def process_event(self, event: dict[str, Any], timestamp_col: str = "timestamp") -> dict[str, Any]:
        """One event; its attributes with the steps' columns."""
        out = dict(event)
        for step, state in zip(self.steps, self._state):
            out |= step.process_event(StreamEvent(event[timestamp_col], out, self._seen), state)
        self._seen += 1
        return out

    def run_incremental(self, event_frame: EventFrame, batch_size: int = 100) -> Iterator[EventFrame]:
        """Frames of so many events in order; states go on from batch to batch."""
        if not self.maintain_state:
            self.reset_state()
        ts, spark = event_frame.schema.timestamp_col, event_frame.df.sparkSession
        fields = [*event_frame.df.schema.fields]
        schema = None
        for batch in batch_stream_iterator(event_frame, batch_size):
            rows = [self.process_event(e.attributes, ts) for e in batch]
            if schema is None:
                from chronomesh.streaming.steps import TYPES, StructField, StructType

                made = {k: t for s in self.steps for k, t in s.outputs().items()}
                schema = StructType([*fields, *(StructField(k, TYPES[t]) for k, t in made.items())])
            yield event_frame.with_df(spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema))

    def stream(self, df: DataFrame, timestamp_col: str, keys: Sequence[str], watermark: str | None = None, id_col: str | None = None) -> DataFrame:
        """The steps on a streaming DataFrame, one stateful operator for all of them."""
        return _Chain(self.steps).stream(df, timestamp_col, keys, watermark, id_col)


class _Chain:
    """Several steps as one, so that a stream has one stateful operator."""

    def __init__(self, steps: Sequence[Any]):
        self.steps = list(steps)

    def outputs(self) -> dict[str, str]:
        return {k: t for s in self.steps for k, t in s.outputs().items()}

    def initialize_state(self) -> list[Any]:
        return [s.initialize_state() for s in self.steps]

    def process_event(self, event: StreamEvent, state: list[Any]) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for step, own in zip(self.steps, state):
            out |= step.process_event(StreamEvent(event.timestamp, {**event.attributes, **out}, event.index), own)
        return out

    def stream(self, *args: Any, **kwargs: Any) -> DataFrame:
        from chronomesh.streaming.steps import StreamingStep

        return StreamingStep.stream(self, *args, **kwargs)  # type: ignore[arg-type]


class BranchingPipeline(Step):
    """Batch steps, then streaming ones."""

    def __init__(self, batch_steps: Iterable[Step] = (), stream_steps: Iterable[Any] = ()):
        self.batch, self.streams = Pipeline(batch_steps), StreamPipeline(stream_steps)

    @classmethod
    def from_steps(cls, steps: Iterable[Any]) -> BranchingPipeline:
        steps = list(steps)
        return cls([s for s in steps if not is_streaming_step(s)], [s for s in steps if is_streaming_step(s)])

    def run(self, event_frame: EventFrame) -> EventFrame:
        return self.streams.run(self.batch.run(event_frame))


def tumbling(df: DataFrame, timestamp_col: str, size: str, keys: Sequence[str] = (), watermark: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts by tumbling (or, with ``slide``, sliding) windows of a stream or batch: window_start, window_end, keys, n."""
    df = df.withColumn(timestamp_col, F.col(timestamp_col).cast("timestamp"))
    df = df.withWatermark(timestamp_col, watermark) if watermark else df
    window = F.window(timestamp_col, size, slide) if slide else F.window(timestamp_col, size)
    return df.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def sessionize(df: DataFrame, timestamp_col: str, gap: str, keys: Sequence[str], watermark: str | None = None) -> DataFrame:
    """Sessions that end after ``gap`` without an event, of a stream or batch: keys, session_start, session_end, n."""
    df = df.withColumn(timestamp_col, F.col(timestamp_col).cast("timestamp"))
    df = df.withWatermark(timestamp_col, watermark) if watermark else df
    out = df.groupBy(F.session_window(timestamp_col, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
