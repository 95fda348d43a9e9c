"""Registries of steps, context sources and output adapters by name."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable
from importlib import metadata
from typing import Any

from pydantic import BaseModel

from chronomesh.pipeline import Pipeline

STEP_TAGS = frozenset({"spatial", "temporal", "context", "continuous"})


@dataclasses.dataclass(frozen=True)
class Spec:
    name: str
    cls: type
    tags: frozenset[str] = frozenset()
    description: str = ""
    config_model: type[BaseModel] | None = None


class Registry:
    """Names for classes. ``tags`` limits the tags that may be used."""

    kind, group, tags = "entry", "", None

    def __init__(self) -> None:
        self._specs: dict[str, Spec] = {}

    def register(self, name: str, cls: type, *, tags: Iterable[str] = (), description: str = "", config_model: type[BaseModel] | None = None) -> Spec:
        if name in self._specs:
            raise ValueError(f"{self.kind} {name!r} is registered already")
        tags = frozenset(tags)
        if self.tags is not None and (odd := tags - self.tags):
            raise ValueError(f"unknown tags: {sorted(odd)}")
        self._specs[name] = spec = Spec(name, cls, tags, description or (cls.__doc__ or "").strip().partition("\n")[0], config_model)
        return spec

    def decorator(self, name: str, **details: Any) -> Callable[[type], type]:
        def wrap(cls: type) -> type:
            self.register(name, cls, **details)
            return cls

        return wrap

    def get(self, name: str) -> Spec:
        if name not in self._specs:
            raise KeyError(f"no {self.kind} {name!r}; there are {sorted(self._specs)}")
        return self._specs[name]

    def list(self, *, tag: str | None = None) -> list[Spec]:
        return [s for _, s in sorted(self._specs.items()) if tag is None or tag in s.tags]

    def create(self, name: str, params: dict[str, Any] | None = None) -> Any:
        spec, params = self.get(name), dict(params or {})
        if spec.config_model is not None:
            params = {k: v for k, v in spec.config_model.model_validate(params)}
        return spec.cls(**params)

    def load_entry_points(self) -> None:
        """Register what installed packages offer under this registry's group."""
        for point in metadata.entry_points(group=self.group):
            if point.name not in self._specs:
                self.register(point.name, point.load())


class FeatureStepRegistry(Registry):
    kind, group, tags = "step", "chronomesh.steps", STEP_TAGS

    def build_pipeline(self, steps: Iterable[str | dict[str, Any]]) -> Pipeline:
        """From names, or mappings with ``name`` (or ``step``) and ``params``."""
        made = []
        for one in steps:
            one = {"name": one} if isinstance(one, str) else one
            made.append(self.create(one.get("name") or one["step"], one.get("params")))
        return Pipeline(made)


class ContextSourceRegistry(Registry):
    kind, group = "context source", "chronomesh.context_sources"


class OutputAdapterRegistry(Registry):
    """Adapters take their settings as one config object."""

    kind, group = "output adapter", "chronomesh.output_adapters"

    def create(self, name: str, params: dict[str, Any] | None = None) -> Any:
        spec = self.get(name)
        return spec.cls(spec.config_model.model_validate(params or {})) if spec.config_model else spec.cls(**(params or {}))


StepRegistry = FeatureStepRegistry
#: The library's own steps and adapters register here when they are imported.
STEPS, SOURCES, ADAPTERS = FeatureStepRegistry(), ContextSourceRegistry(), OutputAdapterRegistry()


def step(name: str, *tags: str) -> Callable[[type], type]:
    """Register a dataclass as a built-in step; its fields are checked when it is made."""

    def wrap(cls: type) -> type:
        cls.step_name = name
        STEPS.register(name, cls, tags=tags)
        return cls

    return wrap


def get_default_registry() -> FeatureStepRegistry:
    """The registry with all built-in steps."""
    from chronomesh import operators, streaming

    operators.load()
    streaming.load()
    return STEPS


def get_default_adapter_registry() -> OutputAdapterRegistry:
    from chronomesh import adapters

    adapters.load()
    return ADAPTERS


