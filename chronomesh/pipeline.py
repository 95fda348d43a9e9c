"""Steps and the pipelines that run them."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from chronomesh.frame import EventFrame
from chronomesh.schema import EventMetadata, EventSchema


class Step(ABC):
    """A function from frame to frame."""

    @abstractmethod
    def run(self, event_frame: EventFrame) -> EventFrame: ...


class Pipeline(Step):
    """Steps in a row; each must give a frame whose schema keeps what the last one promised."""

    def __init__(self, steps: Iterable[Step] = ()):
        self.steps = list(steps)
        self.last_schema: EventSchema | None = None
        self.last_metadata: EventMetadata | None = None

    def add_step(self, step: Step) -> Pipeline:
        self.steps.append(step)
        return self

    def run(self, event_frame: EventFrame) -> EventFrame:
        for step in self.steps:
            out = step.run(event_frame)
            name = type(step).__name__
            if not isinstance(out, EventFrame):
                raise TypeError(f"{name} returned {type(out).__name__}, not an EventFrame")
            if issues := event_frame.schema.broken_by(out.schema):
                raise ValueError(f"{name} broke the schema: {'; '.join(issues)}")
            event_frame = out
        self.last_schema, self.last_metadata = event_frame.schema, event_frame.metadata
        return event_frame

    def __len__(self) -> int:
        return len(self.steps)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({[type(s).__name__ for s in self.steps]})"


class LambdaStep(Step):
    def __init__(self, fn: Callable[[EventFrame], EventFrame], name: str = "lambda"):
        self.fn, self.name = fn, name

    def run(self, event_frame: EventFrame) -> EventFrame:
        return self.fn(event_frame)


class ConditionalStep(Step):
    """One of two steps, chosen on the driver; without the second the frame passes."""

    def __init__(self, condition: Callable[[EventFrame], bool], if_true: Step, if_false: Step | None = None):
        self.condition, self.if_true, self.if_false = condition, if_true, if_false

    def run(self, event_frame: EventFrame) -> EventFrame:
        chosen = self.if_true if self.condition(event_frame) else self.if_false
        return chosen.run(event_frame) if chosen else event_frame


class ParallelSteps(Step):
    """Independent steps; chained, and fused by the optimizer."""

    def __init__(self, steps: Sequence[Step]):
        self.steps = list(steps)

    def run(self, event_frame: EventFrame) -> EventFrame:
        for step in self.steps:
            event_frame = step.run(event_frame)
        return event_frame


def is_streaming_step(step: Any) -> bool:
    return hasattr(step, "initialize_state") and hasattr(step, "process_event")
