"""Topic / channel specifications, validation and the pipeline registry."""

import pytest

from slidecast.plans.spec import (ChannelSpec, SpecError, TopicSpec, compose, register_pipeline,
                                  resolve_pipeline)


def test_topic_validation(spark, events_of):
    schema = events_of([(1, 1, "view", 1.0)]).schema
    TopicSpec("top_users", "select event_type, count(*) as n from top_users group by event_type", 60).validate(
        spark, schema)
    with pytest.raises(SpecError):
        TopicSpec("bad name", "select 1", 60).validate()
    with pytest.raises(SpecError):
        TopicSpec("t", "select 1", 0).validate()
    with pytest.raises(SpecError):
        TopicSpec("t", "select nope from t", 60).validate(spark, schema)
    with pytest.raises(SpecError):
        TopicSpec("t", None, 60).validate()


def test_channel_validation():
    with pytest.raises(SpecError):
        ChannelSpec("c", []).validate()
    with pytest.raises(SpecError):
        ChannelSpec("c", [TopicSpec("a", "select 1", 5, channel="other")]).validate()
    with pytest.raises(SpecError):
        ChannelSpec("c", [TopicSpec("a", "select 1", 5, channel="c")] * 2).validate()


def test_spec_table(spark):
    df = spark.createDataFrame(
        [("ch", "b", "select * from b", 5, 5, 2), ("ch", "a", "select * from a", 60, 60, 1),
         ("other", "z", "select * from z", 5, 5, 1)],
        "channel STRING, name STRING, ql STRING, window INT, slide INT, position INT")
    spec = ChannelSpec.from_table(df, "ch").validate()
    assert [t.name for t in spec.topics] == ["a", "b"]
    assert spec.topics[0].window_us == 60_000_000


def test_pipelines(spark, events_of):
    register_pipeline("only_views", lambda d: d.filter("event_type = 'view'"))
    df = events_of([(1, 1, "view", 1.0), (2, 1, "click", 1.0)])
    assert resolve_pipeline("only_views")(df).count() == 1
    assert compose(resolve_pipeline("only_views"), lambda d: d.limit(0))(df).count() == 0
    with pytest.raises(SpecError):
        resolve_pipeline("missing")
    with pytest.raises(SpecError):
        register_pipeline("x", 3)


def test_aggregate_form_validation():
    TopicSpec("a", window=10, aggregate=(("k",), (("n", "count", "*"),))).validate()
    with pytest.raises(SpecError):
        TopicSpec("a", window=10, aggregate=(("k",), (("m", "median", "v"),))).validate()


def test_spec_table_keeps_every_field(spark):
    spec = ChannelSpec("ch", [
        TopicSpec("b", "select 1 as x from b", 60, 30, "ch", origin=7, order_by=("x",)),
        TopicSpec("a", window=60, channel="ch", aggregate=(("k",), (("n", "count", "*"), ("u", "count_distinct", "v"))))])
    back = ChannelSpec.from_table(spec.to_table(spark), "ch")
    for mine, theirs in zip(spec.topics, back.topics, strict=True):
        assert (mine.name, mine.ql, mine.window_us, mine.slide_us, mine.origin_us, mine.order_by, mine.aggregate) == (
            theirs.name, theirs.ql, theirs.window_us, theirs.slide_us, theirs.origin_us, theirs.order_by, theirs.aggregate)


def test_failing_topics_are_found_before_a_run(spark):
    spec = ChannelSpec("ch", [
        TopicSpec("ok", "select k, (select count(*) from other) as n from ok", 60, 60, "ch"),
        TopicSpec("other", "select missing from other", 60, 60, "ch"),
        TopicSpec("fn", fn=lambda df: df.select("missing"), window=60, channel="ch"),
        TopicSpec("agg", window=60, channel="ch", aggregate=(("missing",), (("n", "count", "*"),)))])
    schema = spark.createDataFrame([], "k int, ts timestamp_ntz").schema
    assert set(spec.failing(spark, schema)) == {"other", "fn", "agg"}
