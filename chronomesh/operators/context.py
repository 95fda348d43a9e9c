"""Joins with side tables."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomesh.frame import EventFrame
from chronomesh.functions.geo import project
from chronomesh.functions.time import micros, parse_duration
from chronomesh.operators.features import AGGREGATES
from chronomesh.operators.kernels import asof_join
from chronomesh.operators.shapes import locate
from chronomesh.operators.spatial import as_frame, coordinates
from chronomesh.pipeline import Step
from chronomesh.registry import step
from chronomesh.sources.context import BaseContextSource

DIRECTIONS = {"asof_backward": "backward", "asof_forward": "forward", "backward": "backward", "forward": "forward", "nearest": "nearest"}


def _filled(df: DataFrame, cols: Sequence[str], value: Any) -> DataFrame:
    return df if value is None else df.withColumns({c: F.coalesce(F.col(c), F.lit(value).cast(df.schema[c].dataType)) for c in cols})


def _exact(df: DataFrame, context: DataFrame, pairs: Sequence[tuple[str, str]], cols: Sequence[str]) -> DataFrame:
    """Left equi-join; of a context column with the name of an event column the event's stays."""
    cols = [c for c in cols if c not in df.columns]
    other = context.select(*(F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(pairs)), *cols)
    on: Column = F.lit(True)
    for i, (a, _) in enumerate(pairs):
        on = on & (F.col(a) == F.col(f"_k{i}"))
    return df.join(other, on, "left").select(*df.columns, *cols)


@step("spatial_context_join", "spatial", "context")
@dataclass
class SpatialContextJoinStep(Step):
    """Columns of the geometry that contains or intersects the point, or is nearest; of several the first by its values."""

    context_data: Any
    context_spatial_col: str
    context_cols: Sequence[str]
    join_type: str = "contains"
    context_crs: str | None = None
    max_distance: float | None = None
    fill_value: Any = None

    def run(self, event_frame: EventFrame) -> EventFrame:
        lon, lat = coordinates(event_frame)
        x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
        if self.context_crs and self.context_crs != event_frame.metadata.crs:
            x, y = project(x, y, event_frame.metadata.crs, self.context_crs)
        df = event_frame.df.drop(*self.context_cols).withColumns({"_px": x, "_py": y})
        hits = locate(df.select(F.col("_px").alias("_x"), F.col("_py").alias("_y")), as_frame(self.context_data), self.context_spatial_col, list(self.context_cols), self.join_type, self.max_distance)
        hits = hits.select("_x", "_y", "_p.*")
        out = df.join(hits, (F.col("_px") == F.col("_x")) & (F.col("_py") == F.col("_y")), "left").drop("_px", "_py", "_x", "_y")
        out = _filled(out, self.context_cols, self.fill_value)
        return event_frame.produced(out, self.step_name, self.context_cols, [lon, lat], ["spatial", "context"]).require_context(context_tags={"spatial_context"})


@step("temporal_context_join", "temporal", "context")
@dataclass
class TemporalContextJoinStep(Step):
    """Columns of the context row at the same time, or the last, next or nearest one within the tolerance."""

    context_data: Any
    context_timestamp_col: str
    context_cols: Sequence[str]
    strategy: str = "nearest"
    tolerance: str | None = None
    fill_value: Any = None

    def run(self, event_frame: EventFrame) -> EventFrame:
        ts, context, cols = event_frame.schema.timestamp_col, as_frame(self.context_data), list(self.context_cols)
        df = event_frame.df.drop(*cols)
        if self.strategy == "exact":
            df = _exact(df, context, [(ts, self.context_timestamp_col)], cols)
        elif self.strategy in DIRECTIONS:
            df = asof_join(df, context, ts, self.context_timestamp_col, cols, direction=DIRECTIONS[self.strategy], tolerance=self.tolerance)
        else:
            raise ValueError(f"unknown strategy: {self.strategy}")
        return event_frame.produced(_filled(df, cols, self.fill_value), self.step_name, cols, [ts], ["temporal", "context"]).require_context(context_tags={"temporal_context"})


@step("spatiotemporal_context_join", "spatial", "temporal", "context")
@dataclass
class SpatioTemporalContextJoinStep(Step):
    """As :class:`TemporalContextJoinStep`, within the same spatial key."""

    context_data: Any
    spatial_key: str
    temporal_key: str
    context_cols: Sequence[str]
    temporal_strategy: str = "asof_backward"
    fill_value: Any = None
    tolerance: str | None = None

    def run(self, event_frame: EventFrame) -> EventFrame:
        ts, context, cols = event_frame.schema.timestamp_col, as_frame(self.context_data), list(self.context_cols)
        own_ts = self.temporal_key if self.temporal_key in event_frame.df.columns else ts
        df, by = event_frame.df.drop(*cols), [(self.spatial_key, self.spatial_key)]
        if self.temporal_strategy == "exact":
            df = _exact(df, context, [*by, (own_ts, self.temporal_key)], cols)
        elif self.temporal_strategy in DIRECTIONS:
            df = asof_join(df, context, own_ts, self.temporal_key, cols, by, DIRECTIONS[self.temporal_strategy], self.tolerance)
        else:
            raise ValueError(f"unknown strategy: {self.temporal_strategy}")
        return event_frame.produced(_filled(df, cols, self.fill_value), self.step_name, cols, [self.spatial_key, own_ts], ["context"]).require_context(context_tags={"spatiotemporal_context"})


@step("context_aggregation", "context")
@dataclass
class ContextAggregationStep(Step):
    """Aggregates of a side table by its groups, ``{prefix}{col}_{function}``, joined to the events."""

    context_data: Any
    group_cols: Sequence[str]
    agg_specs: Mapping[str, str | Sequence[str]]
    join_on: Sequence[str]
    prefix: str = "ctx_"

    def run(self, event_frame: EventFrame) -> EventFrame:
        aggs = {}
        for col, names in self.agg_specs.items():
            for f in [names] if isinstance(names, str) else names:
                if f not in AGGREGATES:
                    raise ValueError(f"unknown aggregate: {f}")
                aggs[f"{self.prefix}{col}_{f}"] = AGGREGATES[f](col)
        side = as_frame(self.context_data).groupBy(*self.group_cols).agg(*(c.alias(k) for k, c in aggs.items()))
        df = event_frame.df.join(side, list(self.join_on), "left").select(*event_frame.df.columns, *aggs)
        return event_frame.produced(df, self.step_name, aggs, self.group_cols, ["context"]).require_context(context_tags={"aggregated_context"})


class BaseJoiner(ABC):
    @abstractmethod
    def join(self, event_frame: EventFrame, source: BaseContextSource) -> EventFrame: ...


def _columns(source: BaseContextSource, df: DataFrame, *keys: str | None) -> list[str]:
    """The source's attributes that its table has, without the keys."""
    return [c for c in (source.schema.attribute_cols or df.columns) if c in df.columns and c not in keys]


@dataclass
class TemporalJoin(BaseJoiner):
    """By time: exact, nearest, backward or forward, within ``tolerance`` (or ``window``)."""

    strategy: str = "nearest"
    window: str | None = None
    tolerance: str | None = None

    def join(self, event_frame: EventFrame, source: BaseContextSource) -> EventFrame:
        when = source.schema.timestamp_col
        if not when:
            raise ValueError("the context has no timestamp column")
        context = source.load()
        one = TemporalContextJoinStep(context, when, _columns(source, context, when), self.strategy, self.tolerance or self.window)
        return one.run(event_frame)


@dataclass
class SpatialJoin(BaseJoiner):
    """By a shared cell or zone column, or by geometry (contains, intersects, nearest)."""

    join_type: str = "grid"
    spatial_col: str = "grid_id"
    max_distance: float | None = None

    def join(self, event_frame: EventFrame, source: BaseContextSource) -> EventFrame:
        context = source.load()
        if self.join_type in ("grid", "zone"):
            key = source.schema.spatial_col or self.spatial_col
            return event_frame.with_df(_exact(event_frame.df, context, [(self.spatial_col, key)], _columns(source, context, key)))
        geometry = source.schema.geometry_col
        if not geometry:
            raise ValueError("the context has no geometry column")
        return SpatialContextJoinStep(context, geometry, _columns(source, context, geometry), self.join_type, max_distance=self.max_distance).run(event_frame)


@dataclass
class SpatioTemporalJoin(BaseJoiner):
    """By time within the same place: one keyed as-of join."""

    temporal_join: TemporalJoin
    spatial_join: SpatialJoin

    def join(self, event_frame: EventFrame, source: BaseContextSource) -> EventFrame:
        when, where = source.schema.timestamp_col, source.schema.spatial_col or self.spatial_join.spatial_col
        if not when:
            raise ValueError("the context has no timestamp column")
        context, ts = source.load(), event_frame.schema.timestamp_col
        cols = [c for c in _columns(source, context, when, where) if c not in event_frame.df.columns]
        by = [(self.spatial_join.spatial_col, where)]
        if self.temporal_join.strategy == "exact":
            return event_frame.with_df(_exact(event_frame.df, context, [*by, (ts, when)], cols))
        way = DIRECTIONS[self.temporal_join.strategy]
        return event_frame.with_df(asof_join(event_frame.df, context, ts, when, cols, by, way, self.temporal_join.tolerance or self.temporal_join.window))


def _block(us: Column | str, width: int) -> Column:
    """Number of the block of time, in whole numbers: short blocks have more of them than a double has digits."""
    us = F.col(us) if isinstance(us, str) else us
    return ((us - F.pmod(us, F.lit(width))) / F.lit(width)).cast("long")


@dataclass
class IntervalJoin(BaseJoiner):
    """By context rows whose interval (start included, end not) holds the event's time.

    Intervals are dealt out to the blocks of time that they touch, so this is an
    equi-join; every matching interval gives a row, events without one stay. Blocks
    are as long as the intervals are on average, unless ``block`` says otherwise: then
    there are at most three pieces an interval, and where events are spread evenly
    an event meets about twice as many pieces as it matches.
    """

    block: str | None = None

    def join(self, event_frame: EventFrame, source: BaseContextSource) -> EventFrame:
        start, end = source.schema.interval_start_col, source.schema.interval_end_col
        if not (start and end):
            raise ValueError("the context has no interval columns")
        context, ts = source.load(), event_frame.schema.timestamp_col
        cols = [c for c in _columns(source, context) if c not in event_frame.df.columns]
        held = context.where(F.col(start) < F.col(end)).select(*cols, micros(start).alias("_a"), micros(end).alias("_z"))
        width = parse_duration(self.block) if self.block else math.ceil(held.agg(F.avg(F.col("_z") - F.col("_a"))).first()[0] or 1)
        cells = held.withColumn("_b", F.explode(F.sequence(_block("_a", width), _block(F.col("_z") - 1, width))))
        events = event_frame.df.withColumn("_t", micros(ts)).withColumn("_eb", _block("_t", width))
        df = events.join(cells, (F.col("_eb") == F.col("_b")) & (F.col("_a") <= F.col("_t")) & (F.col("_t") < F.col("_z")), "left")
        return event_frame.with_df(df.select(*event_frame.df.columns, *cols))


@dataclass
class EnricherStep(Step):
    """Loads a source and joins it."""

    source: BaseContextSource
    joiner: BaseJoiner

    def run(self, event_frame: EventFrame) -> EventFrame:
        return self.joiner.join(event_frame, self.source)
