"""Sliding aggregates by differences, distinct counts, sketches, top-k and joins in one plan, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import secs
from slidecast.operators import sliding
from slidecast.operators.panes import sliding_aggregate
from slidecast.operators.windowjoin import Side, cogroup, has, join_rows
from slidecast.operators.windows import assign_windows

GRIDS = [(10, 10, 0), (10, 3, 0), (60, 1, 0), (7, 5, 2), (5, 12, 0), (40, 4, 3)]


def rows(n=120, span=200, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(-20, span) + rng.choice([0, 0, 0.25]), rng.choice([None, 1, 2, 2, 3, 9]), rng.choice(["a", "a", "b", None]), rng.randrange(50))
            for _ in range(n)]


def windows_of(data, w, s, o):
    """(window end, rows) of every non-empty window."""
    out = {}
    for r in data:
        k = int((r[0] - o) // s) + 1
        while o + k * s - w <= r[0]:
            if r[0] < o + k * s:
                out.setdefault(o + k * s, []).append(r)
            k += 1
    return out


@pytest.fixture(params=GRIDS, ids=str)
def grid(request):
    return request.param


def keyed(df, *cols):
    return sorted(((secs(r.window_start), secs(r.window_end), r.event_type, *(r[c] for c in cols)) for r in df.collect()), key=repr)


def test_sums_and_distinct_equal_brute_force(spark, events_of, grid, monkeypatch):
    monkeypatch.setattr(sliding, "BUCKET_WINDOWS", 2)  # many buckets, so carries matter
    w, s, o = grid
    data = rows()
    df = events_of(data).union(events_of([(0, 5, "a", 1)]).withColumn("ts", F.lit(None).cast("timestamp_ntz")))
    got = sliding_aggregate(df, w, s, ["event_type"], [("n", "count", "*"), ("u", "sum", "user_id"), ("m", "count", "user_id"), ("d", "count_distinct", "user_id")], o)
    want = []
    for end, found in windows_of(data, w, s, o).items():
        for key in {r[2] for r in found}:
            users = [r[1] for r in found if r[2] == key]
            known = [u for u in users if u is not None]
            want.append((end - w, end, key, len(users), sum(known) if known else None, len(known), len(set(known))))
    assert keyed(got, "n", "u", "m", "d") == sorted(want, key=repr)


def test_sketches_equal_exact_counts_when_small(events_of):
    data = [r for r in rows() if r[1] is not None]
    got = sliding.sliding_sketches(events_of(data), 10, 3, ["event_type"], "user_id")
    want = [(end - 10, end, k, len({r[1] for r in found if r[2] == k})) for end, found in windows_of(data, 10, 3, 0).items() for k in {r[2] for r in found}]
    assert keyed(got, "n") == sorted(want, key=repr)


def test_top_k_equals_brute_force(events_of, grid):
    w, s, o = grid
    data = rows()
    got = sliding.sliding_top(events_of(data), w, s, [F.desc("value"), F.asc("event_id")], 2, origin=o)
    want = []
    for end, found in windows_of([(*r, i) for i, r in enumerate(data)], w, s, o).items():
        want += [(end, r[4], i + 1) for i, r in enumerate(sorted(found, key=lambda r: (-r[3], r[4]))[:2])]
    assert sorted((secs(r.window_end), r.event_id, r.rank) for r in got.collect()) == sorted(want)


def test_differences_refuse_doubles_and_stay_two_rows_a_pane(events_of):
    df = events_of(rows())
    with pytest.raises(ValueError):
        sliding.sliding_sums(df, 10, 3, [], [("x", "sum", "value")])
    grid = sliding._Grid(df, 86400, 60, 0, "ts")
    panes = df.withColumn("__pane", grid.pane("ts")).groupBy("event_type", "__pane").agg(F.count("*").alias("v"))
    changes = sliding._in_and_out(panes, ["event_type"], ["v"], grid.first(), grid.stop())
    assert changes.count() <= 2 * panes.count()


def test_aggregates_without_keys(events_of):
    data = rows()
    got = sliding_aggregate(events_of(data), 10, 3, [], [("n", "count", "*"), ("d", "count_distinct", "user_id"), ("m", "max", "value")])
    want = [(end, len(f), len({r[1] for r in f} - {None}), float(max(r[3] for r in f))) for end, f in windows_of(data, 10, 3, 0).items()]
    assert sorted((secs(r.window_end), r.n, r.d, r.m) for r in got.collect()) == sorted(want)


def test_empty_input(events_of):
    none = events_of([(1, 1, "a", 1)]).filter("false")
    assert sliding_aggregate(none, 10, 3, ["event_type"], [("n", "count", "*"), ("d", "count_distinct", "user_id")]).count() == 0
    assert sliding.sliding_top(none, 10, 3, [F.desc("value")], 2).count() == 0


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Scan")


def test_cogroup_and_row_joins_equal_sql(spark, events_of):
    left = assign_windows(events_of(rows(60, 40, 2)), 10, 10)
    left.createOrReplaceTempView("lw")
    both = cogroup(left, ["user_id"], {"a": Side(F.col("value") > 25, [("n", "count", "*")]), "b": Side(F.col("value") < 20, [("m", "max", "value")])})
    a = "(select window_end e, user_id u, count(*) n from lw where value > 25 group by 1, 2)"
    b = "(select window_end e, user_id u, max(value) m from lw where value < 20 group by 1, 2)"
    on = "on a.e = b.e and a.u = b.u"
    full = spark.sql(f"select coalesce(a.e, b.e) e, coalesce(a.u, b.u) u, a.n, b.m from {a} a full join {b} b {on}")
    assert sorted(map(repr, map(tuple, both.select("window_end", "user_id", "n", "m").collect()))) == sorted(map(repr, map(tuple, full.collect())))
    for how, cond in (("left", has("a")), ("inner", f"{has('a')} AND {has('b')}")):
        want = spark.sql(f"select a.e, a.u, a.n, b.m from {a} a {how} join {b} b {on}")
        assert sorted(map(repr, map(tuple, both.filter(cond).select("window_end", "user_id", "n", "m").collect()))) == sorted(map(repr, map(tuple, want.collect())))
    right = left.filter("value < 15")
    for how, cond in (("left_semi", "exists (select 1 from lw r where r.value < 15 and r.window_end = l.window_end and r.user_id = l.user_id)"),
                      ("left_anti", "not exists (select 1 from lw r where r.value < 15 and r.window_end = l.window_end and r.user_id = l.user_id)")):
        want = spark.sql(f"select event_id, window_end from lw l where {cond}")
        got = join_rows(left, right, ["user_id"], how).select("event_id", "window_end")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    kept = {(r.event_id, r.window_end) for r in join_rows(left, right, ["user_id"], "not_in").collect()}
    data = left.collect()
    for r in data:
        there = [x.user_id for x in data if x.window_end == r.window_end and x.value < 15]
        assert ((r.event_id, r.window_end) in kept) == (not there or (r.user_id is not None and None not in there and r.user_id not in there))
    assert scans(both) == scans(cogroup(assign_windows(events_of(rows(60, 4000, 2)), 10, 1), ["user_id"], {"a": Side(), "b": Side()}))
