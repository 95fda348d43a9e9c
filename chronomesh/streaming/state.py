"""Events, windows and state of streaming steps."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime
from itertools import islice
from typing import Any, Generic, TypeVar

from chronomesh.frame import EventFrame
from chronomesh.operators.kernels import event_order

T = TypeVar("T")


@dataclass(frozen=True)
class StreamEvent:
    timestamp: datetime
    attributes: dict[str, Any] = field(default_factory=dict)
    index: int = 0


@dataclass
class StreamWindow:
    """The last events, at most so many and at most so long ago."""

    max_size: int | None = None
    max_duration_seconds: float | None = None
    events: deque[StreamEvent] = field(default_factory=deque)

    def add(self, event: StreamEvent) -> list[StreamEvent]:
        """Add an event and return those that leave."""
        gone = []
        while self.max_size and len(self.events) >= self.max_size:
            gone.append(self.events.popleft())
        while self.max_duration_seconds is not None and self.events and (event.timestamp - self.events[0].timestamp).total_seconds() > self.max_duration_seconds:
            gone.append(self.events.popleft())
        self.events.append(event)
        return gone

    def get_events(self) -> list[StreamEvent]:
        return list(self.events)

    def __len__(self) -> int:
        return len(self.events)


@dataclass
class StreamState(Generic[T]):
    """A value and the ones before it."""

    value: T
    keep_history: bool = False
    history: list[T] = field(default_factory=list)
    updates: int = 0

    def update(self, value: T) -> None:
        if self.keep_history:
            self.history.append(self.value)
        self.value = value
        self.updates += 1


def event_stream_iterator(event_frame: EventFrame) -> Iterator[StreamEvent]:
    """All events in order, a partition at a time on the driver."""
    ts = event_frame.schema.timestamp_col
    for i, row in enumerate(event_frame.df.orderBy(*event_order(event_frame)).toLocalIterator()):
        values = row.asDict()
        yield StreamEvent(values[ts], values, i)


def batch_stream_iterator(event_frame: EventFrame, batch_size: int) -> Iterator[list[StreamEvent]]:
    events = event_stream_iterator(event_frame)
    while batch := list(islice(events, batch_size)):
        yield batch
