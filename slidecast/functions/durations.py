"""Durations and instants as microseconds.

Windows, slides and origins are given as seconds (int/float), a
``datetime.timedelta``, or a short text such as ``"12 hours"``; origins may
also be a naive ``datetime`` (wall clock, read as UTC).
"""

from __future__ import annotations

import datetime as _dt

# Unit names accepted in duration text and their length in microseconds.
_UNITS = {
    "microsecond": 1, "microseconds": 1, "us": 1,
    "millisecond": 1_000, "milliseconds": 1_000, "ms": 1_000,
    "second": 1_000_000, "seconds": 1_000_000, "sec": 1_000_000, "s": 1_000_000,
    "minute": 60_000_000, "minutes": 60_000_000, "min": 60_000_000, "m": 60_000_000,
    "hour": 3_600_000_000, "hours": 3_600_000_000, "h": 3_600_000_000,
    "day": 86_400_000_000, "days": 86_400_000_000, "d": 86_400_000_000,
    "week": 604_800_000_000, "weeks": 604_800_000_000,
}

_EPOCH = _dt.datetime(1970, 1, 1)


def to_micros(value) -> int:
    """Length of a duration in microseconds."""
    if isinstance(value, bool):
        raise TypeError("a duration cannot be a bool")
    if isinstance(value, (int, float)):
        return int(round(value * 1_000_000))
    if isinstance(value, _dt.timedelta):
        return (value.days * 86_400 + value.seconds) * 1_000_000 + value.microseconds
    if isinstance(value, str):
        parts = value.strip().lower().split()
        if len(parts) % 2 or not parts:
            raise ValueError(f"cannot read duration {value!r}")
        total = 0
        for amount, unit in zip(parts[0::2], parts[1::2]):
            if unit not in _UNITS:
                raise ValueError(f"unknown unit {unit!r} in {value!r}")
            total += int(round(float(amount) * _UNITS[unit]))
        return total
    raise TypeError(f"unsupported duration {value!r}")


def instant_micros(value) -> int:
    """An origin instant as microseconds from 1970-01-01 00:00 (wall clock)."""
    if isinstance(value, _dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(_dt.timezone.utc).replace(tzinfo=None)
        return to_micros(value - _EPOCH)
    return to_micros(value)


def interval_text(micros: int) -> str:
    """Spark interval text for a number of microseconds."""
    return f"{int(micros)} microseconds"
