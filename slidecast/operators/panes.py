"""Sliding-window aggregates over panes (each event is aggregated once).

A window of a sliding topic covers W/S slides, so tagging every event with
every window multiplies the input W/S times before anything is aggregated.
For decomposable aggregates the windows can be built from *panes* instead
(Li, Maier, Tufte, Papadimos, Tucker: "No pane, no gain", SIGMOD Record
2005): cut time into panes of ``gcd(W, S)`` (every window is a whole number
of panes), aggregate each (pane, key) once, then expand only the partial
aggregates to the windows that contain the pane and combine them. Rows are
never copied; the expansion is applied to one row per (pane, key). Counts and
whole sums take the way of differences (``sliding``), which expands nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sliding import exact_in_differences, sliding_distinct, sliding_sketches, sliding_sums
from .windows import WINDOW_END, WINDOW_START, assign_windows, window_params

# Decomposable aggregates → (partial, combine) functions.
_PARTIAL = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
_COMBINE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def pane_aggregate(df: DataFrame, window, slide, keys: Sequence[str],
                   aggs: Sequence[tuple[str, str, str]], origin=0, ts: str = "ts") -> DataFrame:
    """``GROUP BY keys`` per window with ``aggs = [(out, func, column), ...]``.

    ``func`` is one of count / sum / min / max (``column`` may be ``*`` for
    count). Same rows as the per-window SQL
    ``SELECT keys, func(column) AS out FROM topic GROUP BY keys``.
    """
    w, s, o = window_params(window, slide, origin)
    pane = math.gcd(w, s)
    for out, func, _ in aggs:
        if func not in _PARTIAL:
            raise ValueError(f"{out}: {func} is not decomposable over panes")
    if s < w and exact_in_differences(df, aggs):  # what can be taken off again needs no copy per window
        return sliding_sums(df, window, slide, keys, aggs, origin, ts)
    tagged = assign_windows(df, pane / 1e6, pane / 1e6, o / 1e6, ts=ts)
    partial_cols: list[Column] = []
    for i, (out, func, col) in enumerate(aggs):
        arg = F.lit(1) if col == "*" else F.col(col)
        partial_cols.append(_PARTIAL[func](arg).alias(f"__p{i}"))
    partial = (tagged.groupBy(F.col(WINDOW_START).alias("__pane_start"), *keys).agg(*partial_cols))
    per_window = assign_windows(partial, w / 1e6, s / 1e6, o / 1e6, ts="__pane_start")
    combined = [_COMBINE[func](f"__p{i}").alias(out) for i, (out, func, _) in enumerate(aggs)]
    return per_window.groupBy(WINDOW_START, WINDOW_END, *keys).agg(*combined)


#: Aggregates of the aggregate form beyond ``_PARTIAL``.
DISTINCT = ("count_distinct", "approx_distinct")


def sliding_aggregate(df: DataFrame, window, slide, keys: Sequence[str],
                      aggs: Sequence[tuple[str, str, str]], origin=0, ts: str = "ts") -> DataFrame:
    """:func:`pane_aggregate` that also takes ``count_distinct`` and ``approx_distinct`` of a column.

    Each distinct count is its own small table per window and key, joined on those.
    """
    keys = list(keys)
    plain = [a for a in aggs if a[1] not in DISTINCT]
    parts = [pane_aggregate(df, window, slide, keys, plain, origin, ts)] if plain else []
    for out, func, col in aggs:
        if func in DISTINCT:
            run = sliding_distinct if func == "count_distinct" else sliding_sketches
            parts.append(run(df, window, slide, keys, col, out, origin, ts))
    joined = parts[0]
    for part in parts[1:]:
        right = part.drop(WINDOW_START).withColumnsRenamed({c: f"__{c}" for c in (WINDOW_END, *keys)})
        same = joined[WINDOW_END] == right[f"__{WINDOW_END}"]
        for c in keys:
            same = same & joined[c].eqNullSafe(right[f"__{c}"])
        joined = joined.join(right, same).drop(*[f"__{c}" for c in (WINDOW_END, *keys)])
    return joined.select(WINDOW_START, WINDOW_END, *keys, *[out for out, _, _ in aggs])
