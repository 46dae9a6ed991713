"""Event times as whole microseconds and back (instants, or wall clocks for TIMESTAMP_NTZ)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_wall_clock(df: DataFrame, ts: str) -> bool:
    return df.schema[ts].dataType.simpleString() == "timestamp_ntz"


def to_instant_micros(col: Column | str, wall_clock: bool) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    if wall_clock:
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col)
    return F.unix_micros(col)


def from_instant_micros(col: Column, wall_clock: bool) -> Column:
    if wall_clock:
        return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.expr("INTERVAL '0.000001' SECOND") * col
    return F.timestamp_micros(col)
