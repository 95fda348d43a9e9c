"""Side tables with roles."""

from __future__ import annotations

from abc import ABC, abstractmethod
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.registry import SOURCES
from chronomesh.schema import ContextSchema


class BaseContextSource(ABC):
    """A table and the roles of its columns."""

    @abstractmethod
    def load(self) -> DataFrame: ...

    @property
    @abstractmethod
    def schema(self) -> ContextSchema: ...


class _FrameSource(BaseContextSource):
    """From a DataFrame, or a path that is read when it is needed."""

    def __init__(self, data: DataFrame | str, schema: ContextSchema | None = None, **roles: Any):
        self._data, self._schema = data, schema or ContextSchema(**roles)
        self._check()

    def _check(self) -> None: ...

    def load(self) -> DataFrame:
        return self._data if isinstance(self._data, DataFrame) else SparkSession.active().read.parquet(self._data)

    @property
    def schema(self) -> ContextSchema:
        return self._schema

    def _need(self, **parts: bool) -> None:
        if missing := [k for k, there in parts.items() if not there]:
            raise ValueError(f"{type(self).__name__} needs {' and '.join(missing)} columns")


@SOURCES.decorator("static_spatial")
class StaticSpatialSource(_FrameSource):
    """Places without time."""

    def _check(self) -> None:
        self._need(spatial=self._schema.has_spatial)


@SOURCES.decorator("static_temporal")
class StaticTemporalSource(_FrameSource):
    """Times without place, such as a calendar."""

    def _check(self) -> None:
        self._need(temporal=self._schema.has_temporal)


@SOURCES.decorator("dynamic_temporal")
class DynamicTemporalSource(_FrameSource):
    """A time series."""

    def _check(self) -> None:
        self._need(temporal=self._schema.has_temporal)


@SOURCES.decorator("spatiotemporal")
class SpatioTemporalSource(_FrameSource):
    """A time series of places."""

    def _check(self) -> None:
        self._need(temporal=self._schema.has_temporal, spatial=self._schema.has_spatial)


class _RenamedParquet(BaseContextSource):
    """A Parquet table whose columns get the library's names."""

    names: dict[str, str] = {}
    roles: dict[str, Any] = {}

    def __init__(self, path: str):
        self.path = path

    def load(self) -> DataFrame:
        df = SparkSession.active().read.parquet(self.path)
        return df.select(*(F.col(old).alias(new) for old, new in self.names.items() if old in df.columns))

    @property
    def schema(self) -> ContextSchema:
        keys = set(map(str, self.roles.values()))
        return ContextSchema(**self.roles, attribute_cols=[c for c in self.names.values() if c not in keys])


@SOURCES.decorator("chicago_weather")
class WeatherSource(_RenamedParquet):
    """Hourly weather."""

    names = {"timestamp": "timestamp", "temperature_f": "temperature", "precipitation_in": "precipitation", "wind_speed_mph": "wind_speed", "conditions": "conditions"}
    roles = {"timestamp_col": "timestamp"}


@SOURCES.decorator("chicago_special_events")
class SpecialEventsSource(_RenamedParquet):
    """Public events by date."""

    names = {"event_date": "timestamp", "event_name": "event_name", "event_type": "event_type", "expected_attendance": "attendance"}
    roles = {"timestamp_col": "timestamp"}


@SOURCES.decorator("chicago_demographics")
class DemographicsSource(_RenamedParquet):
    """Census figures by tract or community area."""

    roles = {"spatial_col": "zone_id"}

    def __init__(self, path: str, spatial_level: str = "census_tract"):
        super().__init__(path)
        if spatial_level not in ("census_tract", "community_area"):
            raise ValueError(f"unknown spatial level: {spatial_level}")
        self.spatial_level = spatial_level
        self.names = {spatial_level: "zone_id", "population": "population", "median_income": "median_income", "pct_below_poverty": "pct_below_poverty", "pct_college_educated": "pct_college_educated"}
