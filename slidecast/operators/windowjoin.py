"""Joins inside windows in one plan: outer, semi, anti and IN, for DataFrame-form topics.

Per-window SQL with such a join runs window by window (Spark cannot
decorrelate it). A DataFrame-form topic gets the windowed rows of all windows
at once, so the window becomes a key like any other:

* :func:`cogroup` joins *aggregated* sides. The sides are one tagged union
  (a row is tagged with each side it belongs to), grouped once by window and
  key; every group tells which sides it has. A full outer join is the group
  itself, the other joins filter on presence. One shuffle, partial aggregates
  before it, no side is read twice.
* :func:`join_rows` keeps the *rows* of the left side: an equality join on
  (window, key), which Spark may broadcast, sort-merge or split where a key is
  hot. Semi and anti joins meet only the right side's distinct keys.

Both follow SQL on nulls: a null key matches nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import WINDOW_END, WINDOW_START

_AGGREGATES = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Side:
    """Rows of one side (all of them, or those of ``where``) and its aggregates ``(out, func, column)``.

    ``rows`` defaults to the topic's own rows; rows of another topic must carry the reader's window columns.
    """
    where: Column | None = None
    aggs: Sequence[tuple[str, str, str]] = ()
    rows: DataFrame | None = None


def has(side: str) -> str:
    return f"has_{side}"


def cogroup(rows: DataFrame, keys: Sequence[str], sides: Mapping[str, Side]) -> DataFrame:
    """One row per window and key that any side has: window columns, keys, ``has_<side>``, every side's aggregates.

    Aggregates of an absent side are null. A null key is a group of its own per side.
    """
    keys = list(keys)
    values = [(s, o, f, c) for s, side in sides.items() for o, f, c in side.aggs]
    frames: list[tuple[DataFrame, list[str]]] = []  # the sides on each distinct input
    for name, side in sides.items():
        source = rows if side.rows is None else side.rows
        for df, names in frames:
            if df is source:
                names.append(name)
                break
        else:
            frames.append((source, [name]))
    tagged = None
    for df, names in frames:
        tags = F.array(*[F.when(F.lit(True) if sides[s].where is None else sides[s].where, F.lit(s)) for s in names])
        inputs = [(F.lit(1) if c == "*" else F.col(c)) if s in names else F.lit(None) for s, _, _, c in values]
        part = df.select(WINDOW_START, WINDOW_END, *keys, F.explode(F.array_compact(tags)).alias("__side"),
                         *[v.alias(f"__v{i}") for i, v in enumerate(inputs)])
        tagged = part if tagged is None else tagged.unionByName(part)
    no_match = F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull() if keys else F.lit(False)
    grouped = tagged.groupBy(WINDOW_START, WINDOW_END, *keys, F.when(no_match, F.col("__side")).alias("__alone")).agg(
        *[F.max(F.col("__side") == s).alias(has(s)) for s in sides],
        *[_AGGREGATES[f](F.when(F.col("__side") == s, F.col(f"__v{i}"))).alias(f"__a{i}") for i, (s, _, f, _) in enumerate(values)])
    return grouped.select(WINDOW_START, WINDOW_END, *keys, *[has(s) for s in sides],
                          *[F.when(F.col(has(s)), F.col(f"__a{i}")).alias(o) for i, (s, o, _, _) in enumerate(values)])


def join_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Rows of ``left`` with (``inner``, ``left``), having (``left_semi``) or lacking (``left_anti``) a match of their window.

    ``not_in`` is SQL's NOT IN on one key: a window whose right side has a null keeps no row, and a null
    on the left is kept only where the right side of its window is empty.
    """
    keys = list(keys)
    on = [WINDOW_END, *keys]
    if how in ("inner", "left"):
        return left.join(right.drop(WINDOW_START), on, how)
    found = right.select(*on).distinct()
    if how in ("left_semi", "left_anti"):
        return left.join(found, on, how)
    if how != "not_in" or len(keys) != 1:
        raise ValueError(f"join_rows: {how!r} on {keys}")
    key = keys[0]
    state = found.groupBy(WINDOW_END).agg(F.max(F.col(key).isNull()).alias("__null"))
    return left.join(found, on, "left_anti").join(state, WINDOW_END, "left").filter(
        F.col("__null").isNull() | (~F.col("__null") & F.col(key).isNotNull())).drop("__null")
