"""Timestamps without zone, in microseconds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds in each unit (fixed values).
UNIT_US = {
    "us": 1, "microseconds": 1, "ms": 1_000, "milliseconds": 1_000, "s": 1_000_000, "seconds": 1_000_000,
    "m": 60_000_000, "minutes": 60_000_000, "h": 3_600_000_000, "hours": 3_600_000_000,
    "d": 86_400_000_000, "days": 86_400_000_000, "w": 604_800_000_000, "weeks": 604_800_000_000,
}

#: strftime fields and Spark's letters for them (fixed values).
STRPTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%b": "MMM", "%j": "DDD", "%p": "a", "%I": "hh"}


def window_us(text: str) -> int:
    """Length of a window such as "24h", "7d" or "1d12h"."""
    parts = re.findall(r"(\d+)(us|ms|s|m|h|d|w)", text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError(f"not a window: {text!r}")
    return sum(int(n) * UNIT_US[u] for n, u in parts)


def to_us(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)


def from_us(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))


def minutes_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 60_000_000


def add_offset(ts: Column, offset: Column, unit: str = "minutes") -> Column:
    """ts plus a signed, possibly fractional number of units; the shift is rounded to microseconds."""
    if unit == "nanoseconds":
        return F.timestamp_add("MICROSECOND", F.floor(offset / 1000).cast("long"), ts)
    if unit in ("months", "years"):
        return F.timestamp_add("MONTH", (offset * (12 if unit == "years" else 1)).cast("int"), ts)
    return F.timestamp_add("MICROSECOND", F.round(offset * UNIT_US[unit]).cast("long"), ts)


def make_datetime(year: Column, month: Column, day: Column, clock: Column, offset: Column | None = None, unit: str = "minutes") -> Column:
    """Timestamp from parts, the time of day as text HH:mm:ss; null if they make no valid time."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    text = F.concat(pad(year, 4), F.lit("-"), pad(month, 2), F.lit("-"), pad(day, 2), F.lit(" "), clock)
    made = text.try_cast("timestamp_ntz")
    return made if offset is None else add_offset(made, offset, unit)


def set_clock(ts: Column, hour: int = 0, minute: int = 0, second: int = 0) -> Column:
    """The same day at another time."""
    return F.timestamp_add("SECOND", F.lit(3600 * hour + 60 * minute + second), ts.cast("date").cast("timestamp_ntz"))


def parse(text: Column, fmt: str | None = None, strict: bool = True) -> Column:
    """Timestamp of a text in a strptime format; what does not fit is an error, or null if not ``strict``."""
    if fmt is None:
        return text.cast("timestamp_ntz") if strict else text.try_cast("timestamp_ntz")
    for field, letters in STRPTIME.items():
        fmt = fmt.replace(field, letters)
    made = F.to_timestamp(text, fmt) if strict else F.try_to_timestamp(text, F.lit(fmt))
    return made.cast("timestamp_ntz")
