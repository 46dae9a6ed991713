"""Window assignment (sliding, tumbling, gapped) on an arrival-time column.

A window is the half-open interval ``[end - W, end)``; window ends fall on
``origin + k * S``. Each row is tagged with ``window_start``/``window_end``
(one output row per window the row belongs to), which is all the per-window
SQL and the streaming lanes need.

* ``S <= W`` (sliding, tumbling, ragged): ``F.window`` with
  ``startTime = (origin - W) mod S`` so that its window *ends* sit on the
  grid. Spark expands each row into ceil(W/S) candidates inside whole-stage
  codegen; no shuffle.
* ``S > W`` (gapped): ``F.window`` is tumbling over ``S`` (one candidate per
  row) and the rows in the gap ``[end - S, end - W)`` are filtered out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durations import instant_micros, interval_text, to_micros

WINDOW_START = "window_start"
WINDOW_END = "window_end"


def window_params(window, slide=None, origin=0) -> tuple[int, int, int]:
    w = to_micros(window)
    s = to_micros(slide) if slide is not None else w
    o = instant_micros(origin)
    if w <= 0 or s <= 0:
        raise ValueError("window and slide must be positive")
    return w, s, o


def window_struct(ts: Column | str, window, slide=None, origin=0) -> Column:
    """The ``F.window`` struct whose ends lie on ``origin + k*slide``.

    For gapped windows (slide > window) this is the enclosing tumbling
    slide; callers filter with :func:`in_gapped_window`.
    """
    w, s, o = window_params(window, slide, origin)
    ts = F.col(ts) if isinstance(ts, str) else ts
    if s <= w:
        return F.window(ts, interval_text(w), interval_text(s), interval_text((o - w) % s))
    return F.window(ts, interval_text(s), interval_text(s), interval_text(o % s))


def assign_windows(df: DataFrame, window, slide=None, origin=0, ts: str = "ts",
                   start_col: str = WINDOW_START, end_col: str = WINDOW_END) -> DataFrame:
    """Tag every row with each window it belongs to."""
    w, s, o = window_params(window, slide, origin)
    tmp = "__slidecast_w"
    # A row without an arrival time belongs to no window.
    out = (df.filter(F.col(ts).isNotNull())
           .withColumn(tmp, window_struct(ts, interval_text(w), interval_text(s), interval_text(o))))
    end = F.col(f"{tmp}.end")
    if s <= w:
        start = F.col(f"{tmp}.start")
    else:
        start = end - F.expr(f"INTERVAL {w} MICROSECONDS")
        out = out.filter(F.col(ts) >= start)
    return out.withColumn(start_col, start).withColumn(end_col, end).drop(tmp)


def window_count_per_row(window, slide=None) -> float:
    """How many windows one row lands in on average (W/S, at most 1 if gapped)."""
    w, s, _ = window_params(window, slide)
    return min(w / s, float(-(-w // s)))
