"""Recipes: named pipelines for datasets."""

from __future__ import annotations

from abc import ABC
from typing import Any

from pyspark.sql import functions as F

from chronomesh.frame import EventFrame
from chronomesh.operators.features import aggregate_counts
from chronomesh.operators.spatial import AssignToGridStep, TransformCRSStep
from chronomesh.operators.temporal import ExtractTemporalComponentsStep, TimeBinsStep
from chronomesh.pipeline import LambdaStep, Pipeline, Step
from chronomesh.registry import get_default_registry
from chronomesh.schema import RecipeConfig

_RECIPES: dict[str, dict[str, type[BaseRecipe]]] = {}


class BaseRecipe(ABC):
    """A pipeline from the steps of the config, or else from :meth:`build_pipeline`."""

    def __init__(self, config: RecipeConfig | dict[str, Any]):
        self.config = config if isinstance(config, RecipeConfig) else RecipeConfig(**config)

    def build_pipeline(self) -> Pipeline:
        raise NotImplementedError("the config names no steps, and the recipe has none")

    def get_pipeline(self) -> Pipeline:
        steps = self.config.features.get("steps")
        return get_default_registry().build_pipeline(steps) if steps else self.build_pipeline()

    def run(self, event_frame: EventFrame) -> EventFrame:
        return self.get_pipeline().run(event_frame)


def register_recipe(dataset: str, name: str, recipe: type[BaseRecipe]) -> None:
    if name in _RECIPES.setdefault(dataset, {}):
        raise ValueError(f"recipe {dataset}/{name} is registered already")
    _RECIPES[dataset][name] = recipe


def get_recipe(dataset: str, name: str) -> type[BaseRecipe]:
    if name not in _RECIPES.get(dataset, {}):
        raise ValueError(f"no recipe {dataset}/{name}")
    return _RECIPES[dataset][name]


def list_recipes(dataset: str | None = None) -> list[str]:
    return sorted(_RECIPES.get(dataset, {})) if dataset else sorted(f"{d}/{n}" for d, found in _RECIPES.items() for n in found)


def list_datasets() -> list[str]:
    return sorted(_RECIPES)


class _ProjectedGrid(Step):
    """Cells on the projected coordinates."""

    def __init__(self, size: float):
        self.size = size

    def run(self, event_frame: EventFrame) -> EventFrame:
        lon, lat = (f"{c}_proj" for c in (event_frame.schema.lon_col, event_frame.schema.lat_col))
        projected = event_frame.with_schema(lon_col=lon, lat_col=lat)
        gridded = AssignToGridStep(self.size).run(projected)
        return gridded.with_schema(lon_col=event_frame.schema.lon_col, lat_col=event_frame.schema.lat_col)


class CrimeV1Recipe(BaseRecipe):
    """Events by cell of a projected grid and six-hour bin, with the bin's temporal components."""

    def build_pipeline(self) -> Pipeline:
        grid, temporal = self.config.grid, self.config.temporal
        return Pipeline(
            [
                TransformCRSStep(grid.get("crs", "EPSG:26971")),
                _ProjectedGrid(grid.get("size_m", 300.0)),
                TimeBinsStep(temporal.get("bin_size", "6h")),
                LambdaStep(lambda f: aggregate_counts(f.filter(F.col("grid_id").isNotNull()), ["grid_id", "time_bin"])),
                LambdaStep(lambda f: f.with_schema(timestamp_col="time_bin"), "by_bin"),
            ]
        )

    def run(self, event_frame: EventFrame) -> EventFrame:
        pipeline = super().get_pipeline()
        if self.config.features.get("steps"):
            return pipeline.run(event_frame)
        for one in pipeline.steps:  # the timestamp becomes the bin, which a pipeline would refuse
            event_frame = one.run(event_frame)
        return ExtractTemporalComponentsStep().run(event_frame)


register_recipe("chicago_crime", "v1", CrimeV1Recipe)
