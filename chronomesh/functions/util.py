"""Small helpers: types of columns, time zones, progress."""

from __future__ import annotations

import logging
import time
from zoneinfo import ZoneInfo

from pyspark.sql import types as T


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_categorical(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType | T.BooleanType)


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType | T.DayTimeIntervalType)


def get_timezone(name: str) -> ZoneInfo:
    """ValueError on an unknown zone."""
    try:
        return ZoneInfo(name)
    except Exception as e:
        raise ValueError(f"unknown time zone: {name}") from e


class ProgressTracker:
    """Logs how far a count of steps has come."""

    def __init__(self, total: int, name: str = "progress", logger: logging.Logger | None = None):
        self.total, self.name, self.done, self.began = total, name, 0, time.monotonic()
        self.logger = logger or logging.getLogger(__name__)

    def update(self, n: int = 1) -> float:
        self.done += n
        share = self.done / self.total if self.total else 1.0
        self.logger.info("%s: %d of %d (%.0f %%) after %.1f s", self.name, self.done, self.total, 100 * share, time.monotonic() - self.began)
        return share
