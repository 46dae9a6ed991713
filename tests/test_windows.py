"""Window assignment: the hand-made cases and a brute-force model."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from slidecast.operators.windows import assign_windows
from conftest import secs


def windows_by_end(spark, events_of, ts_list, w, s, origin=0):
    df = events_of([(t, 1, "view", 1.0) for t in ts_list])
    out = assign_windows(df, w, s, origin).collect()
    res = {}
    for r in out:
        assert secs(r.window_end) - secs(r.window_start) == w
        res.setdefault(round(secs(r.window_end), 6), set()).add(round(secs(r.ts), 6))
    return res


def model(ts_list, w, s, origin=0):
    res = {}
    for t in ts_list:
        k = math.floor((t - origin) / s) + 1
        while origin + k * s - w <= t:
            e = origin + k * s
            if e - w <= t < e:
                res.setdefault(round(e, 6), set()).add(round(t, 6))
            k += 1
    return res


def test_tumbling_edges(spark, events_of):
    assert windows_by_end(spark, events_of, [0, 4.999, 5], 5, 5) == {5: {0, 4.999}, 10: {5}}


def test_sliding_overlap(spark, events_of):
    assert windows_by_end(spark, events_of, [0, 6], 10, 5) == {5: {0}, 10: {0, 6}, 15: {6}}


def test_gapped(spark, events_of):
    assert windows_by_end(spark, events_of, [0, 6, 9.999, 10], 5, 10) == {10: {6, 9.999}}


def test_hole_in_data(spark, events_of):
    assert set(windows_by_end(spark, events_of, [1, 21], 5, 5)) == {5, 25}


def test_origin_shift(spark, events_of):
    assert windows_by_end(spark, events_of, [1, 2, 6.999, 7], 5, 5, origin=2) == {2: {1}, 7: {2, 6.999}, 12: {7}}


def test_ragged(spark, events_of):
    got = windows_by_end(spark, events_of, [0, 1, 4, 5, 6, 9], 7, 5)
    assert got == {5: {0, 1, 4}, 10: {4, 5, 6, 9}, 15: {9}}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(w=st.integers(1, 40), s=st.integers(1, 40), origin=st.integers(-30, 30),
       ts=st.lists(st.integers(0, 400), min_size=1, max_size=25))
def test_matches_model(spark, events_of, w, s, origin, ts):
    ts = [t / 4 for t in ts]
    assert windows_by_end(spark, events_of, ts, w, s, origin) == model(ts, w, s, origin)
