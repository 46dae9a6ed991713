"""Streaming: stream equals batch on closed windows, restart, channels."""

import time

import pytest
from pyspark.sql import functions as F

from slidecast.operators.topicsql import windowed_sql
from slidecast.operators.windows import assign_windows
from slidecast.plans.spec import ChannelSpec, TopicSpec
from slidecast.session import scratch_path
from slidecast.sources.replay import replay_stream, stage_replay
from slidecast.sources.tables import read_events
from slidecast.streaming.channel import Channel, list_channels
from slidecast.streaming.lanes import read_sink, start_sql_topic
from conftest import SF001

QL = "select event_type, count(*) as n from t group by event_type"


def batch_closed(ev, w, s):
    rows = assign_windows(ev, w, s)
    mx = ev.agg(F.max("ts")).collect()[0][0]
    return sorted(tuple(r) for r in windowed_sql(rows, "t", QL).filter(F.col("window_end") <= F.lit(mx)).collect())


def test_sql_lane_equals_batch_and_survives_restart(spark):
    ev = read_events(spark, SF001)
    src = stage_replay(ev, 4)
    topic = TopicSpec("t", QL, 2 * 86400, 86400)
    sink, state, ck = (scratch_path(spark, k) for k in ("sink", "state", "ck"))
    stream = replay_stream(spark, src, ev.schema)
    # first run: two micro-batches only, then stop
    first = start_sql_topic(replay_stream(spark, src, ev.schema, max_files_per_trigger=2), topic, sink, state, ck,
                            available_now=False, processing_time="1 second")
    deadline = time.time() + 120
    while time.time() < deadline and (first.lastProgress is None or first.lastProgress["batchId"] < 1):
        time.sleep(0.5)
    first.stop()
    # restart on the same checkpoint and drain
    again = start_sql_topic(stream, topic, sink, state, ck, available_now=True)
    again.awaitTermination()
    got = sorted(tuple(r) for r in read_sink(spark, sink).select("window_start", "window_end", "event_type", "n")
                 .collect())
    assert got == batch_closed(ev, 2 * 86400, 86400)


def test_channel_lifecycle_and_isolation(spark):
    ev = read_events(spark, SF001)
    src = stage_replay(ev, 2)
    good = TopicSpec("good", QL.replace(" t ", " good "), 86400, 86400, "iso")
    bad = TopicSpec("bad", "select missing_column from bad", 86400, 86400, "iso")
    chan = Channel(spark, ChannelSpec("iso", [good, bad]), scratch_path(spark, "sink"), scratch_path(spark, "st"))
    qs = chan.start(replay_stream(spark, src, ev.schema), available_now=True)
    assert "iso" in list_channels(spark) or all(not q.isActive for q in qs)
    errors = {}
    for q in qs:
        try:
            q.awaitTermination()
        except Exception as exc:  # the failing topic reports its error
            errors[q.name] = exc
    assert set(errors) == {"iso.bad"}
    chan.stop()
    assert not chan.is_running
    res = chan.results()
    assert res.count() > 0 and {r.topic for r in res.select("topic").distinct().collect()} == {"good"}


def test_native_lane(spark):
    from slidecast.streaming.lanes import stream_native_agg_replay
    ev = read_events(spark, SF001)
    got = stream_native_agg_replay(spark, ev, 86400, 43200, ["event_type"], [F.count(F.lit(1)).alias("n")])
    assert sorted(tuple(r) for r in got.select("window_start", "window_end", "event_type", "n").collect()) == \
        batch_closed(ev, 86400, 43200)


@pytest.mark.parametrize("w,s", [(6 * 3600, 12 * 3600)])
def test_native_lane_gapped(spark, w, s):
    from slidecast.streaming.lanes import stream_native_agg_replay
    ev = read_events(spark, SF001)
    got = stream_native_agg_replay(spark, ev, w, s, ["event_type"], [F.count(F.lit(1)).alias("n")])
    assert sorted(tuple(r) for r in got.select("window_start", "window_end", "event_type", "n").collect()) == \
        batch_closed(ev, w, s)


def test_list_find_and_console(spark, capsys):
    from slidecast.plans.delivery import console_listener
    from slidecast.streaming.channel import find_channel_queries
    ev = read_events(spark, SF001)
    src = stage_replay(ev, 2)
    topic = TopicSpec("counts", QL.replace(" t ", " counts "), 86400, 86400, "listed")
    chan = Channel(spark, ChannelSpec("listed", [topic]), scratch_path(spark, "sink"), scratch_path(spark, "st"))
    qs = chan.start(replay_stream(spark, src, ev.schema))
    try:
        assert "listed" in list_channels(spark)
        assert [q.name for q in find_channel_queries(spark, "listed")] == ["listed.counts"]
        assert chan.start(replay_stream(spark, src, ev.schema)) == qs or len(chan.queries()) == 1
    finally:
        chan.stop(graceful=True)
    assert "listed" not in list_channels(spark)
    console_listener(3)("counts", ["event_type", "n"], chan.results())
    shown = capsys.readouterr().out
    assert shown.startswith("[counts] event_type, n") and len(shown.strip().splitlines()) == 4


@pytest.mark.parametrize("reader_first", [True, False])
def test_cross_topic_group_stream_equals_batch(spark, reader_first):
    from slidecast.plans.broker import run_channel
    from slidecast.streaming.channel import lifecycle_roundtrip, topic_groups
    ev = read_events(spark, SF001)
    reader = TopicSpec("rd", "select r.event_type, count(*) as n, (select count(*) from src) as src_n "
                             "from rd r group by r.event_type", 86400, 86400, "cx")
    src = TopicSpec("src", "select count(*) as n from src", 5 * 3600, 5 * 3600, "cx")
    spec = ChannelSpec("cx", [reader, src] if reader_first else [src, reader])
    assert [len(g) for g in topic_groups(spec, ev)] == [2]
    streamed = lifecycle_roundtrip(spark, ev, spec, n_files=3).filter(F.col("topic") == "rd")
    mx = ev.agg(F.max("ts")).collect()[0][0]
    batch = run_channel(ev, spec)["rd"].filter(F.col("window_end") <= F.lit(mx))
    from slidecast.plans.delivery import envelope
    want = sorted(tuple(r) for r in envelope(batch, "cx", "rd").select("window_end", "payload").collect())
    got = sorted(tuple(r) for r in streamed.select("window_end", "payload").collect())
    assert got == want and len(got) > 0


@pytest.mark.parametrize("w,s", [(86400, 3600), (6 * 3600, 12 * 3600)])
def test_native_pane_stream_equals_batch(spark, w, s):
    from slidecast.operators.panes import pane_aggregate
    from slidecast.streaming.lanes import stream_pane_agg_replay
    ev = read_events(spark, SF001)
    aggs = (("n", "count", "*"), ("su", "sum", "user_id"), ("mx", "max", "value"))
    topic = TopicSpec("p", window=w, slide=s, aggregate=(("event_type",), aggs))
    got = stream_pane_agg_replay(spark, ev, topic, n_files=3)
    mx = ev.agg(F.max("ts")).collect()[0][0]
    want = pane_aggregate(ev, w, s, ["event_type"], list(aggs)).filter(F.col("window_end") <= F.lit(mx))
    cols = ["window_start", "window_end", "event_type", "n", "su", "mx"]
    assert sorted(tuple(r) for r in got.select(cols).collect()) == sorted(tuple(r) for r in want.select(cols).collect())


def test_late_rows_are_counted_not_emitted(spark, events_of):
    path = scratch_path(spark, "late-src")
    events_of([(100, 1, "view", 1.0), (150, 2, "view", 1.0), (200, 3, "view", 1.0)]).coalesce(1).write.parquet(path)
    time.sleep(1.1)  # the late file lands later
    events_of([(1, 4, "view", 1.0), (205, 5, "view", 1.0)]).coalesce(1).write.mode("append").parquet(path)
    ev_schema = events_of([(1, 1, "view", 1.0)]).schema
    topic = TopicSpec("t", "select count(*) as n from t", 10, 10)
    sink, state, ck = (scratch_path(spark, k) for k in ("sink", "state", "ck"))
    q = start_sql_topic(replay_stream(spark, path, ev_schema), topic, sink, state, ck, available_now=True)
    q.awaitTermination()
    prog = spark.read.parquet(f"{state}/progress")
    assert sum(r.late for r in prog.collect()) == 1
    ends = sorted(r.window_end.second + 60 * r.window_end.minute for r in read_sink(spark, sink).collect())
    assert ends == [110, 160]  # [200, 210) is still open at watermark 205


def test_channel_mixes_sql_and_aggregate_topics(spark):
    from slidecast.plans.broker import run_channel
    from slidecast.plans.delivery import envelopes
    from slidecast.streaming.channel import lifecycle_roundtrip
    ev = read_events(spark, SF001)
    spec = ChannelSpec("mix", [
        TopicSpec("by_sql", "select event_type, count(*) as n from by_sql group by event_type", 86400, 43200, "mix"),
        TopicSpec("by_agg", window=86400, slide=43200, channel="mix",
                  aggregate=(("event_type",), (("n", "count", "*"),))),
    ])
    streamed = lifecycle_roundtrip(spark, ev, spec, n_files=3)
    mx = ev.agg(F.max("ts")).collect()[0][0]
    batch = envelopes(run_channel(ev, spec), "mix").filter(F.col("window_end") <= F.lit(mx))
    cols = ["topic", "window_end", "payload"]
    got = sorted(tuple(r) for r in streamed.select(cols).collect())
    assert got == sorted(tuple(r) for r in batch.select(cols).collect())
    assert {r[0] for r in got} == {"by_sql", "by_agg"}


def test_stream_keeps_order_as_row_index(spark):
    from slidecast.plans.broker import run_topic
    from slidecast.streaming.lanes import stream_sql_topic_replay
    ev = read_events(spark, SF001)
    topic = TopicSpec("o", "select event_type, count(*) as n from o group by event_type order by n", 86400, 86400,
                      order_by=("n", "event_type"))
    got = stream_sql_topic_replay(spark, ev, topic, n_files=2)
    mx = ev.agg(F.max("ts")).collect()[0][0]
    want = run_topic(ev, topic).filter(F.col("window_end") <= F.lit(mx))
    cols = ["window_end", "event_type", "n", "row_index"]
    assert sorted(tuple(r) for r in got.select(cols).collect()) == sorted(tuple(r) for r in want.select(cols).collect())


def _two_batches(spark, kind):
    """Batch 1 at 0, 30 and 65 s, batch 2 at 50, 58, 70 and 130 s."""
    path = scratch_path(spark, "two-batches")
    for part in ((0, 30, 65), (50, 58, 70, 130)):
        (spark.createDataFrame([(s,) for s in part], "s long")
         .select("s", F.expr(f"cast(timestamp_seconds(s) as {kind})").alias("ts"))
         .coalesce(1).write.mode("append").parquet(path))
        time.sleep(1.1)  # the file source orders by modification time
    return path


@pytest.mark.parametrize("delay, want", [(0, 2), (60, 4)])
def test_delay_keeps_rows_that_come_out_of_order(spark, delay, want, caplog):
    path = _two_batches(spark, "timestamp_ntz")
    sink = scratch_path(spark, "sink")
    start_sql_topic(replay_stream(spark, path, spark.read.parquet(path).schema), TopicSpec("t", "select count(*) as n from t", 60, 60),
                    sink, scratch_path(spark, "st"), scratch_path(spark, "ck"), available_now=True,
                    delay_us=delay * 1_000_000).awaitTermination()
    got = {r.window_end.minute: r.n for r in read_sink(spark, sink).collect()}
    assert got[1] == want
    assert ("2 rows arrived after a window" in caplog.text) == (delay == 0)


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_sql_lane_equals_batch_for_instants_in_any_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        from slidecast.streaming.lanes import stream_sql_topic_replay

        ev = read_events(spark, SF001).withColumn("ts", F.col("ts").cast("timestamp"))
        got = stream_sql_topic_replay(spark, ev, TopicSpec("t", QL, 86400, 86400))
        assert sorted(tuple(r) for r in got.select("window_start", "window_end", "event_type", "n").collect()) == \
            batch_closed(ev, 86400, 86400)
        rows = assign_windows(ev, 86400, 86400)
        assert sorted(map(tuple, windowed_sql(rows, "t", QL, lane="loop").collect())) == \
            sorted(map(tuple, windowed_sql(rows, "t", QL, lane="plan").collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_second_handle_sees_the_running_channel(spark):
    from slidecast.session import stream_session

    ev = read_events(spark, SF001)
    src = stage_replay(ev, 2)
    topic = TopicSpec("counts", QL.replace(" t ", " counts "), 86400, 86400, "shared")
    make = lambda: Channel(spark, ChannelSpec("shared", [topic], batch_interval="5 seconds"),
                           scratch_path(spark, "sink"), scratch_path(spark, "st"))
    one, two = make(), make()
    one.start(replay_stream(stream_session(spark), src, ev.schema))
    try:
        assert "shared" in list_channels(spark) and two.is_running
        assert [q.name for q in two.start(replay_stream(spark, src, ev.schema))] == ["shared.counts"]
    finally:
        two.stop(graceful=False)
    assert "shared" not in list_channels(spark) and not one.is_running


def test_envelopes_name_failed_topics(spark):
    from slidecast.plans.delivery import envelopes

    with pytest.raises(ValueError, match="bad"):
        envelopes({"bad": RuntimeError("x")}, "c")


def test_three_topics_share_one_read_and_one_store_with_retention(spark):
    from slidecast.plans.broker import run_channel
    from slidecast.plans.delivery import envelopes
    from slidecast.session import list_folders
    from slidecast.streaming.channel import channel_status

    ev = read_events(spark, SF001)
    src = stage_replay(ev, 6)
    spec = ChannelSpec("three", [TopicSpec(n, QL.replace(" t ", f" {n} "), w, s, "three") for n, w, s in (
        ("a", 86400, 86400), ("b", 2 * 86400, 86400), ("c", 6 * 3600, 12 * 3600))])
    sink, state = scratch_path(spark, "sink"), scratch_path(spark, "st")
    # Two batches, then a restart on the same checkpoint.
    chan = Channel(spark, spec, sink, state)
    qs = chan.start(replay_stream(spark, src, ev.schema, max_files_per_trigger=2))
    assert [q.name for q in qs] == ["three.a+b+c"] and [s[:2] for s in channel_status(spark)] == [("three", "a+b+c")]
    deadline = time.time() + 180
    while time.time() < deadline and (qs[0].lastProgress is None or qs[0].lastProgress["batchId"] < 1):
        time.sleep(0.5)
    chan.stop(graceful=False)
    for q in Channel(spark, spec, sink, state).start(replay_stream(spark, src, ev.schema), available_now=True):
        q.awaitTermination()
    mx = ev.agg(F.max("ts")).collect()[0][0]
    want = envelopes(run_channel(ev, spec), "three").filter(F.col("window_end") <= F.lit(mx))
    cols = ["topic", "window_end", "payload"]
    assert sorted(map(tuple, chan.results().select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    # Panes (half days) of windows that had fired before the last batch are gone: 30 days of data leave a few.
    panes = list_folders(spark, f"{state}/three/a+b+c/state/rows")
    days = (ev.agg(F.max("ts")).first()[0] - ev.agg(F.min("ts")).first()[0]).days
    assert 0 < len(panes) < days


def test_topic_that_fails_on_the_data_leaves_the_others(spark, events_of):
    path = scratch_path(spark, "src")
    events_of([(s, 1, "view", 1.0) for s in (1, 12, 25)]).coalesce(1).write.parquet(path)
    schema = spark.read.parquet(path).schema
    spec = ChannelSpec("half", [
        TopicSpec("fine", "select count(*) as n from fine", 10, 10, "half"),
        TopicSpec("wrong", "select cast(event_type as int) as n from wrong", 10, 10, "half")])
    state = scratch_path(spark, "st")
    chan = Channel(spark, spec, scratch_path(spark, "sink"), state)
    for q in chan.start(replay_stream(spark, path, schema), available_now=True):
        q.awaitTermination()
    assert {(r.topic, r.payload) for r in chan.results().collect()} == {("fine", '{"n":1}')}
    assert [r.topic for r in spark.read.parquet(f"{state}/half/fine+wrong/state/failures/*").collect()] == ["wrong"]


def test_distinct_counts_of_aggregate_topics_on_a_stream(spark):
    from slidecast.plans.broker import run_channel
    from slidecast.plans.delivery import envelopes
    from slidecast.streaming.channel import lifecycle_roundtrip

    ev = read_events(spark, SF001)
    spec = ChannelSpec("dist", [TopicSpec("d", window=86400, slide=43200, channel="dist", aggregate=(
        ("event_type",), (("n", "count", "*"), ("users", "count_distinct", "user_id"))))])
    mx = ev.agg(F.max("ts")).collect()[0][0]
    want = envelopes(run_channel(ev, spec), "dist").filter(F.col("window_end") <= F.lit(mx))
    got = lifecycle_roundtrip(spark, ev, spec, n_files=2)
    assert sorted(r.payload for r in got.collect()) == sorted(r.payload for r in want.collect())
