"""Per-window SQL: plan lane equals the window-by-window loop; edge cases."""

import pytest

from slidecast.operators.topicsql import choose_lane, windowed_sql
from slidecast.operators.windows import assign_windows
from slidecast.sources.tables import read_events
from conftest import SF001

SHAPES = [
    "select * from t",
    "select event_type, count(*) as n from t group by event_type order by n",
    "select count(*) as n, max(value) as mx from t where value > 250",
    "select count(distinct user_id) as users from t",
    "select user_id, count(*) as n from t group by user_id having count(*) > 1",
    "select distinct event_type from t",
    "select event_id, value from t order by value desc, event_id limit 2",
    "select a.event_id, b.mx from t a join (select event_type, max(value) as mx from t group by event_type) b "
    "on a.event_type = b.event_type and a.value >= b.mx",
    "select event_type from t where value > 100 union select event_type from t where value < 10",
    "select user_id from t where event_type = 'view' except select user_id from t where event_type = 'click'",
    "select user_id from t where event_type = 'view' intersect select user_id from t where event_type = 'click'",
    "with x as (select user_id, count(*) as n from t group by user_id) select n, count(*) as c from x group by n",
]


def canon(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows(spark):
    return assign_windows(read_events(spark, SF001), "3 days", "2 days")


@pytest.mark.parametrize("ql", SHAPES)
def test_plan_equals_loop(rows, ql):
    assert choose_lane(rows.sparkSession, "t", ql, rows.drop("window_start", "window_end").schema) == "plan"
    assert canon(windowed_sql(rows, "t", ql, lane="plan")) == canon(windowed_sql(rows, "t", ql, lane="loop"))


@pytest.mark.parametrize("ql", [
    "select a.event_type, count(b.event_id) as n from (select distinct event_type from t) a "
    "left join (select * from t where value > 200) b on a.event_type = b.event_type group by a.event_type",
    "select event_id from t a left semi join (select user_id from t where event_type = 'view') b "
    "on a.user_id = b.user_id",
    "select event_id from t where user_id in (select user_id from t where value > 300)",
    "select event_type, user_id, count(*) as n from t group by rollup(event_type, user_id)",
])
def test_loop_lane_chosen(rows, ql):
    spark = rows.sparkSession
    assert choose_lane(spark, "t", ql, rows.drop("window_start", "window_end").schema) == "loop"
    assert windowed_sql(rows, "t", ql).count() > 0


def test_empty_result_and_global_count(spark, events_of):
    rows = assign_windows(events_of([(1, 1, "view", 1.0), (2, 1, "view", 2.0)]), 5)
    assert windowed_sql(rows, "t", "select * from t where value > 10").count() == 0
    got = windowed_sql(rows, "t", "select count(*) as n from t where value > 10").collect()
    assert [r.n for r in got] == [0]


def test_name_clash_rejected(spark, events_of):
    rows = assign_windows(events_of([(1, 1, "view", 1.0)]), 5)
    with pytest.raises(ValueError):
        windowed_sql(rows, "t", "select ts as window_end from t")
    with pytest.raises(ValueError):
        windowed_sql(rows, "t", "select value as a, user_id as a from t")


def test_topic_name_does_not_leak(spark, events_of):
    rows = assign_windows(events_of([(1, 1, "view", 1.0)]), 5)
    windowed_sql(rows, "leaky_topic", "select * from leaky_topic", lane="loop").count()
    assert "leaky_topic" not in [t.name for t in spark.catalog.listTables()]


def test_rows_without_time_belong_to_no_window(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "event_id BIGINT, ts TIMESTAMP_NTZ")
    assert windowed_sql(assign_windows(df, 5), "t", "select count(*) as n from t").count() == 0


def test_loop_chunks_equal_one_chunk(rows):
    ql = ("select a.event_type, count(b.event_id) as n from (select distinct event_type from t) a "
          "left join (select * from t where value > 100) b on a.event_type = b.event_type group by a.event_type")
    assert canon(windowed_sql(rows, "t", ql, loop_chunk=3)) == canon(windowed_sql(rows, "t", ql))


@pytest.mark.parametrize("name", ["w", "q", "r", "o", "window_end"])
def test_topic_names_that_match_internal_aliases(rows, name):
    ql = f"select {name}.event_type, count(*) as n from {name} group by {name}.event_type"
    want = canon(windowed_sql(rows, "t", "select t.event_type, count(*) as n from t group by t.event_type"))
    assert canon(windowed_sql(rows, name, ql)) == want
    assert canon(windowed_sql(rows, name, ql, lane="loop")) == want


def test_loop_lane_leaves_no_views(spark, events_of):
    from slidecast.session import private_session
    rows = assign_windows(events_of([(1, 1, "view", 1.0), (7, 2, "click", 2.0)]), 5)
    windowed_sql(rows, "t", "select * from t", lane="loop").count()
    assert not [t.name for t in private_session(spark).catalog.listTables() if t.name.startswith("__sc_")]
