"""Durations and timestamps as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds of the units (fixed values).
UNITS = {
    "us": 1, "ms": 1_000,
    "s": 1_000_000, "sec": 1_000_000, "second": 1_000_000,
    "m": 60_000_000, "min": 60_000_000, "minute": 60_000_000,
    "h": 3_600_000_000, "hr": 3_600_000_000, "hour": 3_600_000_000,
    "d": 86_400_000_000, "day": 86_400_000_000,
    "w": 604_800_000_000, "week": 604_800_000_000,
}
CALENDAR = {"mo": "month", "month": "month", "q": "quarter", "quarter": "quarter", "y": "year", "year": "year"}
#: The Monday after the epoch, in microseconds.
MONDAY = 4 * 86_400_000_000


def parse_duration(text: str) -> int:
    """Microseconds of ``7d``, ``6h``, ``day`` ...; ValueError on anything else."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)?\s*([a-z]+)\s*", text.lower()) if isinstance(text, str) else None
    unit = m and (m[2] if m[2] in UNITS else m[2].removesuffix("s"))
    if unit not in UNITS:
        raise ValueError(f"not a duration: {text!r}")
    return round(float(m[1] or 1) * UNITS[unit])


def seconds(text: str) -> float:
    return parse_duration(text) / 1e6


def parse_time_window(text: str) -> dict[str, int]:
    """``7d`` as ``{"days": 7}``."""
    m = re.fullmatch(r"(\d+)([smhdw])", text.strip())
    if not m:
        raise ValueError(f"not a time window: {text!r}")
    return {{"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}[m[2]]: int(m[1])}


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970, of a timestamp with or without zone, or a date."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def time_floor(ts: Column | str, duration: str) -> Column:
    """Start of the bin of a timestamp, without zone; weeks begin on Monday, months and longer follow the calendar."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    m = re.fullmatch(r"(\d*)([a-z]+)", duration.strip().lower())
    if m and (m[2] in CALENDAR or m[2].removesuffix("s") in CALENDAR):
        if m[1] not in ("", "1"):
            raise ValueError(f"only single calendar units can be bins: {duration!r}")
        return F.date_trunc(CALENDAR.get(m[2]) or CALENDAR[m[2].removesuffix("s")], ts).cast("timestamp_ntz")
    width = parse_duration(duration)
    shift = MONDAY if width % UNITS["w"] == 0 else 0
    us = micros(ts)
    return from_micros(us - F.pmod(us - F.lit(shift), F.lit(width)))


def whole_seconds(start: Column, end: Column) -> Column:
    """Seconds from start to end, cut toward zero."""
    return F.timestamp_diff("SECOND", start, end)
