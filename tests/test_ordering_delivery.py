"""Row order inside windows (Q6), messages, routing and subscription."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from slidecast.operators.ordering import with_row_index
from slidecast.plans.delivery import envelope, messages, publish, subscribe
from slidecast.session import scratch_path


def test_row_index_matches_row_number(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).alias("v"),
                                     F.col("id"))
    got = with_row_index(df, "g", ["v", "id"], num_partitions=7)
    want = df.withColumn("row_index", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert sorted(tuple(r) for r in got.select("g", "v", "id", "row_index").collect()) == \
        sorted(tuple(r) for r in want.select("g", "v", "id", "row_index").collect())


def test_messages_are_bounded(spark, events_of):
    from slidecast.operators.windows import assign_windows
    from slidecast.operators.topicsql import windowed_sql
    ev = events_of([(i, i % 4, "view", float(i)) for i in range(10)])
    res = windowed_sql(assign_windows(ev, 100), "t", "select event_id, value from t")
    msgs = messages(envelope(res, "c", "t"), max_rows=3).collect()
    assert sorted(m.n_rows for m in msgs) == [1, 3, 3, 3]
    assert sum(len(m.data) for m in msgs) == 10


def test_publish_and_subscribe_prune(spark, events_of):
    from slidecast.operators.windows import assign_windows
    from slidecast.operators.topicsql import windowed_sql
    ev = events_of([(1, 1, "view", 1.0), (2, 2, "click", 2.0)])
    rows = assign_windows(ev, 5)
    path = scratch_path(spark, "pub-test")
    publish(envelope(windowed_sql(rows, "a", "select * from a"), "ch", "a"), path)
    publish(envelope(windowed_sql(rows, "a_b", "select count(*) as n from a_b"), "ch", "a_b"), path)
    publish(envelope(windowed_sql(rows, "b", "select count(*) as n from b"), "ch_a", "b"), path)
    got = subscribe(spark, path, "ch", "a")
    assert got.count() == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "partition" in plan.lower()
    assert subscribe(spark, path, "ch", "a_b").count() == 1
    assert subscribe(spark, path, "ch_a", "b").count() == 1


def test_unsubscribe_stops_only_that_handle(spark, events_of):
    from slidecast.operators.topicsql import windowed_sql
    from slidecast.operators.windows import assign_windows
    from slidecast.plans.delivery import subscribe_stream
    ev = events_of([(1, 1, "view", 1.0), (2, 2, "click", 2.0)])
    path = scratch_path(spark, "pub-unsub")
    publish(envelope(windowed_sql(assign_windows(ev, 5), "a", "select * from a"), "ch", "a"), path)
    seen = {"one": 0, "two": 0}

    def listener(key):
        def on(topic, columns, rows):
            seen[key] += rows.count()
        return on

    one = subscribe_stream(spark, path, "ch", "a", listener("one"), scratch_path(spark, "ck1"))
    two = subscribe_stream(spark, path, "ch", "a", listener("two"), scratch_path(spark, "ck2"))
    one.processAllAvailable()
    two.processAllAvailable()
    one.stop()
    assert not one.isActive and two.isActive
    two.stop()
    assert seen == {"one": 2, "two": 2}


def test_hot_window_is_spread_over_tasks(spark):
    """A window holding a third of all rows is split across tasks, not one."""
    import os
    from slidecast.operators.topicsql import _store_by_window
    from slidecast.operators.windows import assign_windows
    df = spark.range(0, 6000).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).cast("timestamp").cast("timestamp_ntz")
        .alias("ts"))
    rows = assign_windows(df, 10)
    path = scratch_path(spark, "hot")
    _store_by_window(rows, path)
    hot = [d for d in os.listdir(path) if d.startswith("__wkey=w19700101000010")][0]
    files = [f for f in os.listdir(os.path.join(path, hot)) if f.endswith(".parquet")]
    assert len(files) >= 2
    idx = with_row_index(rows, "window_end", ["ts", "event_id"], num_partitions=6)
    hot_idx = idx.filter(F.col("window_end") == F.lit("1970-01-01 00:00:10").cast("timestamp_ntz"))
    assert sorted(r.row_index for r in hot_idx.collect()) == list(range(1, hot_idx.count() + 1))


def test_envelope_keeps_microseconds(spark, events_of):
    from slidecast.operators.topicsql import windowed_sql
    from slidecast.operators.windows import assign_windows
    ev = events_of([(1.123456, 1, "view", 1.0)])
    env = envelope(windowed_sql(assign_windows(ev, 5), "t", "select ts from t"), "c", "t").collect()
    assert env[0].payload == '{"ts":"1970-01-01T00:00:01.123456"}' and env[0].columns == "ts"


def test_envelopes_keep_order_and_column_names(spark, events_of):
    from slidecast.operators.windows import assign_windows
    from slidecast.plans.delivery import FULL_COLUMNS, envelopes
    rows = assign_windows(events_of([(1, 1, "view", 3.0), (2, 2, "click", 2.0)]), 5)
    res = with_row_index(rows.select("window_start", "window_end", F.col("value").alias("a,b")), "window_end", [F.col("`a,b`")])
    env = envelopes({"o": res, "p": res.drop("row_index")}, "ch")
    assert tuple(env.columns) == FULL_COLUMNS
    path = scratch_path(spark, "ordered")
    publish(env, path)
    got = subscribe(spark, path, "ch", "o").orderBy("row_index").collect()
    assert [(r.row_index, r.column_names, r.payload) for r in got] == [(1, ["a,b"], '{"a,b":2.0}'), (2, ["a,b"], '{"a,b":3.0}')]
    assert [r.row_index for r in subscribe(spark, path, "ch", "p").collect()] == [None, None]
    assert [m.data for m in messages(subscribe(spark, path, "ch", "o"), 5).collect()] == [['{"a,b":2.0}', '{"a,b":3.0}']]


def test_slow_subscriber_takes_bounded_batches_and_goes_on_where_it_was(spark):
    from slidecast.plans.delivery import ENVELOPE_SCHEMA, subscribe_stream
    path, ck = scratch_path(spark, "bounded"), scratch_path(spark, "ck")
    for i in range(6):
        (spark.range(200).select(F.lit(None).cast("timestamp_ntz").alias("window_start"), F.lit(None).cast("timestamp_ntz").alias("window_end"),
                                 F.lit("x").alias("columns"), F.concat(F.lit(f"{i}-"), "id").alias("payload"), F.array(F.lit("x")).alias("column_names"),
                                 F.col("id").alias("row_index"), F.lit("c").alias("channel"), F.lit("t").alias("topic"))
         .coalesce(1).write.mode("append").partitionBy("channel", "topic").parquet(path))
    seen = []

    def take(topic, columns, rows):
        if len(seen) == 2:
            raise RuntimeError("too much")
        seen.append({r.payload for r in rows.collect()})

    import pytest
    with pytest.raises(Exception, match="too much"):
        subscribe_stream(spark, path, "c", "t", take, ck, available_now=True, max_bytes=5000).awaitTermination()
    first = list(seen)
    seen.clear()
    del take

    def rest(topic, columns, rows):
        seen.append({r.payload for r in rows.collect()})
    subscribe_stream(spark, path, "c", "t", rest, ck, available_now=True, max_bytes=5000).awaitTermination()
    batches = first + seen
    assert len(batches) > 3 and max(map(len, batches)) <= 400
    assert sum(map(len, batches)) == 1200 == len(set().union(*batches)) and "row_index" in ENVELOPE_SCHEMA.names


def test_messages_are_delivered_once_in_window_order(spark, events_of, monkeypatch):
    from slidecast.plans import delivery
    from slidecast.session import list_folders
    monkeypatch.setattr(delivery, "_LEDGER_FOLDERS", 4)
    from slidecast.operators.topicsql import windowed_sql
    from slidecast.operators.windows import assign_windows
    from slidecast.plans.delivery import deliver_messages, envelopes
    ev = events_of([(i, 1, "view", float(i)) for i in range(40)])
    res = windowed_sql(assign_windows(ev, 10), "t", "select event_id from t")
    path, ledger, ck = (scratch_path(spark, k) for k in ("msg", "ledger", "ck"))
    msgs = messages(envelopes({"t": res}, "ch"), max_rows=4)
    publish(msgs, path)
    got, fail = [], [5]

    def listener(topic, columns, message):
        if len(got) == fail[0]:
            fail[0] = -1
            raise RuntimeError("down")
        got.append((message.window_end, message.part, message.n_rows, columns))

    import pytest
    with pytest.raises(Exception, match="down"):
        deliver_messages(spark, path, "ch", "t", listener, ledger, ck, available_now=True).awaitTermination()
    deliver_messages(spark, path, "ch", "t", listener, ledger, ck, available_now=True).awaitTermination()
    publish(msgs, path)  # published a second time: nothing is delivered again
    deliver_messages(spark, path, "ch", "t", listener, ledger, ck, available_now=True).awaitTermination()
    assert got == sorted(got) and [g[1:3] for g in got] == [(0, 4), (1, 4), (2, 2)] * 4 and got[0][3] == ["event_id"]
    assert len(list_folders(spark, ledger)) == 1  # the commits of before, as one
