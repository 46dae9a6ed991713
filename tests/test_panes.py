"""Pane aggregation equals the per-window SQL for sliding, ragged and gapped windows."""

import pytest

from slidecast.operators.panes import pane_aggregate
from slidecast.operators.topicsql import windowed_sql
from slidecast.operators.windows import assign_windows
from slidecast.sources.tables import read_events
from conftest import SF001

AGGS = [("n", "count", "*"), ("su", "sum", "user_id"), ("mn", "min", "value"), ("mx", "max", "value")]
SQL = "select event_type, count(*) as n, sum(user_id) as su, min(value) as mn, max(value) as mx from t group by event_type"


@pytest.mark.parametrize("w,s,origin", [(86400, 3600, 0), (7 * 3600, 5 * 3600, 1800), (6 * 3600, 12 * 3600, 0),
                                        (86400, 86400, 6 * 3600)])
def test_panes_equal_sql(spark, w, s, origin):
    ev = read_events(spark, SF001)
    got = pane_aggregate(ev, w, s, ["event_type"], AGGS, origin)
    want = windowed_sql(assign_windows(ev, w, s, origin), "t", SQL)
    cols = ["window_start", "window_end", "event_type", "n", "su", "mn", "mx"]
    assert sorted(tuple(r) for r in got.select(cols).collect()) == sorted(tuple(r) for r in want.select(cols).collect())


def test_rejects_non_decomposable(spark):
    with pytest.raises(ValueError):
        pane_aggregate(read_events(spark, SF001), 10, 5, [], [("m", "median", "value")])
