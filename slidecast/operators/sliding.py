"""Sliding windows at a high W/S without copying rows or partials once per window.

Time is cut into panes of ``gcd(W, S)``; pane ``p`` lies in the windows
numbered ``first(p) .. stop(p) - 1`` (window ``k`` ends at ``origin + k S``).

* **Differences** (:func:`sliding_sums`): a pane's counts and sums are added
  where the pane enters (window ``first``) and taken off where it leaves
  (``stop``): two rows a pane whatever W/S is. Prefix sums per key give every
  window's total. They run in two levels (inside buckets of windows, and over
  one total per bucket), so a key with a long history is many small tasks.
* **Exact distinct** (:func:`sliding_distinct`): a value adds one to the windows
  of its pane that do not hold the value's previous pane: the gap to that pane
  decides where it enters, so the same differences count each value once.
* **Approximate distinct** (:func:`sliding_sketches`): one HyperLogLog sketch
  per pane and key, united per window.
* **Top k** (:func:`sliding_top`): the k first rows of each pane, then of each
  window; Spark limits the rows of a group before each shuffle too.

Sums are exact only for whole numbers and decimals, so others are refused.
Rows without a time belong to no window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from ..functions.instants import from_instant_micros, is_wall_clock, to_instant_micros
from .windows import WINDOW_END, WINDOW_START, assign_windows, window_params

BUCKET_WINDOWS = 1024
SKETCH_LG_K = 12


def exact_in_differences(df: DataFrame, aggs: Sequence[tuple[str, str, str]]) -> bool:
    """Whether all aggregates are counts or sums that adding and taking off leaves exact."""
    return all(f == "count" or (f == "sum" and isinstance(df.schema[c].dataType, (IntegralType, DecimalType))) for _, f, c in aggs)


def _ceil_div(x: str, by: int) -> str:
    return f"(({x}) - pmod({x}, {by}L)) div {by}L + if(pmod({x}, {by}L) = 0, 0L, 1L)"


class _Grid:
    """Panes and window numbers of one (W, S, origin)."""

    def __init__(self, df: DataFrame, window, slide, origin, ts: str):
        self.w, self.s, self.o = window_params(window, slide, origin)
        self.pane_us = math.gcd(self.w, self.s)
        self.panes, self.step = self.w // self.pane_us, self.s // self.pane_us
        self.wall = is_wall_clock(df, ts)
        #: Windows a pane lies in at most.
        self.reach = -(-self.panes // self.step)

    def pane(self, ts: str) -> Column:
        since = to_instant_micros(ts, self.wall) - F.lit(self.o)
        return _whole(since, self.pane_us)

    def first(self, pane: str = "__pane") -> Column:
        return F.expr(_ceil_div(f"{pane} + 1L", self.step))

    def stop(self, pane: str = "__pane") -> Column:
        return F.expr(_ceil_div(f"{pane} + {self.panes + 1}L", self.step))

    def window_columns(self, k: Column) -> list[Column]:
        end = k * F.lit(self.s) + F.lit(self.o)
        return [from_instant_micros(end - F.lit(self.w), self.wall).alias(WINDOW_START), from_instant_micros(end, self.wall).alias(WINDOW_END)]


def _whole(micros: Column, by: int) -> Column:
    """Floor division of longs."""
    return F.call_function("div", micros - F.pmod(micros, F.lit(by)), F.lit(by))


def _prefix_sums(changes: DataFrame, keys: list[str], sums: list[str], grid: _Grid, alive: str) -> DataFrame:
    """(keys, __k, sums) changes to one row per key and window number where ``alive`` is above 0."""
    # A pane leaves at most ``reach`` windows after it enters: a bucket at least that long with totals above 0 holds a change.
    size = max(BUCKET_WINDOWS, grid.reach + 1)
    by_bucket = changes.withColumn("__b", _whole(F.col("__k"), size))
    totals = by_bucket.groupBy(*keys, "__b").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    # Each bucket starts with what is carried into it.
    carry = totals.select(*keys, "__b", (F.col("__b") * F.lit(size)).alias("__k"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in sums])
    points = by_bucket.select(*keys, "__b", "__k", *sums).unionByName(carry).groupBy(*keys, "__b", "__k").agg(*[F.sum(c).alias(c) for c in sums])
    inside = Window.partitionBy(*keys, "__b").orderBy("__k")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    total = points.select(*keys, "__k", F.coalesce(F.lead("__k").over(inside), (F.col("__b") + 1) * F.lit(size)).alias("__next"),
                          *[F.sum(c).over(upto).alias(c) for c in sums])
    # Totals stay as they are up to the next change: one row per window of the result.
    return total.filter(F.col(alive) > 0).select(*keys, F.explode(F.expr("sequence(__k, __next - 1)")).alias("__k"), *sums)


def _in_and_out(panes: DataFrame, keys: list[str], sums: list[str], first: Column, stop: Column) -> DataFrame:
    """Panes to changes: what enters at ``first`` and leaves at ``stop``, summed per key and window number."""
    signs = F.explode(F.array(F.struct(first.alias("k"), F.lit(1).alias("sign")), F.struct(stop.alias("k"), F.lit(-1).alias("sign"))))
    both = panes.filter(first < stop).select(*keys, *sums, signs.alias("__x"))
    return both.groupBy(*keys, F.col("__x.k").alias("__k")).agg(*[F.sum(F.col(c) * F.col("__x.sign")).alias(c) for c in sums])


def sliding_sums(df: DataFrame, window, slide, keys: Sequence[str], aggs: Sequence[tuple[str, str, str]],
                 origin=0, ts: str = "ts") -> DataFrame:
    """``GROUP BY keys`` per window with counts and whole sums ``(out, func, column)``, by differences."""
    if not exact_in_differences(df, aggs):
        raise ValueError("differences take counts, and sums of whole numbers and decimals")
    grid, keys = _Grid(df, window, slide, origin, ts), list(keys)
    parts = []
    for i, (_, func, col) in enumerate(aggs):
        if func == "count":
            parts.append(F.count(F.lit(1) if col == "*" else F.col(col)).alias(f"__v{i}"))
        else:  # a sum of nothing but nulls is null: its numbers are counted beside it
            parts += [F.coalesce(F.sum(col), F.lit(0)).alias(f"__v{i}"), F.count(col).alias(f"__n{i}")]
    panes = df.filter(F.col(ts).isNotNull()).withColumn("__pane", grid.pane(ts)).groupBy(*keys, "__pane").agg(F.count(F.lit(1)).alias("__rows"), *parts)
    sums = [c for c in panes.columns if c not in keys and c != "__pane"]
    changes = _in_and_out(panes, keys, sums, grid.first(), grid.stop())
    out = _prefix_sums(changes, keys, sums, grid, "__rows")
    types = {name: df.select(F.sum(c)).schema[0].dataType for name, f, c in aggs if f == "sum"}
    return out.select(*grid.window_columns(F.col("__k")), *keys, *[
        (F.col(f"__v{i}") if f == "count" else F.when(F.col(f"__n{i}") > 0, F.col(f"__v{i}").cast(types[name]))).alias(name)
        for i, (name, f, _) in enumerate(aggs)])


def sliding_distinct(df: DataFrame, window, slide, keys: Sequence[str], value: str, out: str = "n",
                     origin=0, ts: str = "ts") -> DataFrame:
    """Exact ``count(DISTINCT value)`` per window and key; a group of nulls alone counts 0."""
    grid, keys = _Grid(df, window, slide, origin, ts), list(keys)
    seen = df.filter(F.col(ts).isNotNull()).select(*keys, F.col(value).alias("__v"), grid.pane(ts).alias("__pane")).distinct()
    past = Window.partitionBy(*keys, "__v").orderBy("__pane")
    # Windows that hold the previous pane too end before its stop: there the value counts already.
    entry = F.greatest(grid.first(), F.coalesce(F.lag(grid.stop()).over(past), grid.first()))
    spans = seen.select(*keys, "__pane", "__v", entry.alias("__in"), grid.stop().alias("__out"))
    values = spans.select(*keys, "__in", "__out", F.when(F.col("__v").isNotNull(), 1).otherwise(0).cast("long").alias(out),
                          F.lit(1).cast("long").alias("__alive"))
    changes = _in_and_out(values, keys, [out, "__alive"], F.col("__in"), F.col("__out"))
    found = _prefix_sums(changes, keys, [out, "__alive"], grid, "__alive")
    return found.select(*grid.window_columns(F.col("__k")), *keys, out)


def sliding_sketches(df: DataFrame, window, slide, keys: Sequence[str], value: str, out: str = "n",
                     origin=0, ts: str = "ts", lg_k: int = SKETCH_LG_K) -> DataFrame:
    """Approximate ``count(DISTINCT value)`` per window and key, from one mergeable sketch per pane.

    The relative standard error is about ``1.04 / sqrt(2^lg_k)``. A pane's sketch (some KB) is what
    goes to the windows, never its rows.
    """
    grid, keys = _Grid(df, window, slide, origin, ts), list(keys)
    tagged = assign_windows(df, grid.pane_us / 1e6, grid.pane_us / 1e6, grid.o / 1e6, ts=ts)
    panes = tagged.groupBy(F.col(WINDOW_START).alias("__pane_start"), *keys).agg(F.hll_sketch_agg(value, lg_k).alias("__s"))
    windows = assign_windows(panes, grid.w / 1e6, grid.s / 1e6, grid.o / 1e6, ts="__pane_start")
    return windows.groupBy(WINDOW_START, WINDOW_END, *keys).agg(F.hll_sketch_estimate(F.hll_union_agg("__s")).alias(out))


def sliding_top(df: DataFrame, window, slide, order_by: Sequence[Column], k: int, keys: Sequence[str] = (),
                origin=0, ts: str = "ts", rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every window (and key) in an order, with their rank from 1.

    ``order_by`` should make the order total; a row's windows all hold its pane, so a row outside the first
    ``k`` of its pane is in the first ``k`` of no window.
    """
    grid, keys = _Grid(df, window, slide, origin, ts), list(keys)
    order = list(order_by)
    panes = df.filter(F.col(ts).isNotNull()).withColumn("__pane", grid.pane(ts))
    heads = panes.withColumn("__r", F.row_number().over(Window.partitionBy("__pane", *keys).orderBy(*order))).filter(F.col("__r") <= k).drop("__r", "__pane")
    placed = assign_windows(heads, grid.w / 1e6, grid.s / 1e6, grid.o / 1e6, ts=ts)
    by_window = Window.partitionBy(WINDOW_END, *keys).orderBy(*order)
    return placed.withColumn(rank, F.row_number().over(by_window)).filter(F.col(rank) <= k)
