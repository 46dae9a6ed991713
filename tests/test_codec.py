"""Decode and drop malformed events; encode round trip; record projection."""

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

from slidecast.sources.codec import bbox_filter, decode, encode, project_record

SCHEMA = StructType([StructField("name", StringType()), StructField("text", StringType()),
                     StructField("count", LongType())])


def test_malformed_dropped_and_counted(spark):
    # valid, half a record, empty bytes, NULL, valid, {} (required fields missing), wrong field type
    values = [b'{"name": "a", "text": "x", "count": 0}', b'{"name": "b", "te', b"", None,
              b'{"name": "c", "text": "y", "count": 0}', b"{}", b'{"name": "d", "text": "z", "count": "many"}']
    log = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "key STRING, value BINARY")
    obs = Observation("decode")
    out = decode(log, SCHEMA, observation=obs)
    assert sorted(r.name for r in out.collect()) == ["a", "c"]
    assert obs.get == {"events": 7, "dropped": 5}


def test_roundtrip_keeps_microseconds(spark, events_of):
    ev = events_of([(1.123456, 3, "view", 2.5), (7.000001, 4, "click", 0.01)])
    log = encode(ev, {"event_id": "event_id", "ts": "ts", "name": "event_type"}, key="event_id")
    back = decode(log, StructType([StructField("event_id", LongType()), StructField("ts", TimestampNTZType()),
                                   StructField("name", StringType())]), keep_key=True)
    assert sorted(tuple(r) for r in back.collect()) == sorted(
        (str(r.event_id), r.event_id, r.ts, r.event_type) for r in ev.collect())


def test_project_and_bbox(spark, events_of):
    ev = events_of([(1, 3, "view", 2.5), (2, 40, "click", 30.0)])
    rec = project_record(ev, "event_type", "props")
    assert rec.columns == ["name", "text", "count"] and {r["count"] for r in rec.collect()} == {0}
    assert [r.user_id for r in bbox_filter(ev, "user_id", "value", (10, 60), (20, 200)).collect()] == [40]


def test_ingest_then_decode_stream_counts_drops(spark, events_of):
    from slidecast.session import scratch_path
    from slidecast.sources.codec import ingest
    ev = events_of([(1, 3, "view", 2.5), (2, 40, "click", 30.0), (3, 45, "view", 50.0)])
    path = scratch_path(spark, "log")
    ingest(ev, {"name": "event_type", "text": "props", "count": F.lit(0)}, path,
           box=("user_id", "value", (10, 60), (20.0, 200.0)))
    # a malformed record lands in the same log
    spark.createDataFrame([(None, b'{"name": "x"')], "key STRING, value BINARY").write.mode("append").parquet(path)
    stream = spark.readStream.schema("key STRING, value BINARY").parquet(path)
    out = decode(stream, SCHEMA, observation="decode_counts")
    q = (out.writeStream.format("memory").queryName("decoded_test").trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.name for r in spark.table("decoded_test").collect()) == ["click", "view"]
    metrics = [p["observedMetrics"]["decode_counts"] for p in q.recentProgress if p.get("observedMetrics")]
    assert sum(m["dropped"] for m in metrics) == 1 and sum(m["events"] for m in metrics) == 3


def test_broker_source_reports_missing_connector(spark):
    from slidecast.sources.replay import broker_sink_options, broker_stream
    assert broker_sink_options("h:9092", "tweets") == {"kafka.bootstrap.servers": "h:9092", "topic": "tweets"}
    try:
        df = broker_stream(spark, "localhost:9", ["tweets", "other"])
    except RuntimeError as exc:
        assert "connector" in str(exc)
    else:  # connector present: the schema is the broker record
        assert df.columns == ["key", "value", "topic"]


def _zigzag(n):
    n *= 2
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def test_binary_strings_equal_the_format_and_drop_malformed(spark):
    from pyspark.sql import Observation
    from slidecast.sources.binary import decode_strings, encode_strings

    texts = [("", ""), ("a", "b" * 63), ("a" * 64, "é" * 100), ("x" * 8191, "y" * 8192), ("z" * 70_000, "\U0001F600"), (None, "t")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(texts)], "i int, a string, b string")
    log = encode_strings(df, ["a", "b"], key="i", keep=["i"])
    for r in log.collect():
        a, b = ((t or "").encode() for t in texts[r.i])
        assert bytes(r.value) == _zigzag(len(a)) + a + _zigzag(len(b)) + b
    back = decode_strings(log, ["a", "b"], keep=["i"])
    assert {(r.i, r.a, r.b) for r in back.collect()} == {(i, a or "", b) for i, (a, b) in enumerate(texts)}
    bad = [None, b"", b"\x01", b"\x02", b"\x04a", b"\x02a", b"\x02a\x04b", b"\xff\xff\xff\xff\xff\xff", b"\x02\xff\x00", b"\x80", b"\x02a\x80"]
    good = [b"\x00\x00", b"\x02a\x02b", b"\x02a\x02bc"]  # bytes after the record are ignored
    seen = Observation("binary")
    log = spark.createDataFrame([(i, bytearray(v) if v is not None else None) for i, v in enumerate(bad + good)], "i int, value binary")
    assert sorted(r.i for r in decode_strings(log, ["a", "b"], seen, keep=["i"]).collect()) == [len(bad) + k for k in range(len(good))]
    assert seen.get == {"events": len(bad) + len(good), "dropped": len(bad)}


def test_landed_topics_start_and_bounds(spark):
    from pyspark.sql import functions as F
    from slidecast.session import scratch_path
    from slidecast.sources import landed

    path, out = scratch_path(spark, "landed"), scratch_path(spark, "landed-out")
    for k, day in enumerate((1, 2, 3)):
        log = spark.range(4).select(F.col("id").cast("string").alias("key"), F.lit(b"v").alias("value"))
        landed.land(landed.arrived(log, F.lit(f"2024-01-0{day} 12:00:00").cast("timestamp")), path, F.concat(F.lit("t"), F.col("key")))
    assert landed.topics(spark, path) == ["t0", "t1", "t2", "t3"]
    stream = landed.log_stream(spark, path, ["t1", "t2"], starting="2024-01-02 00:00:00", max_files=2)
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r.topic, str(r.timestamp)) for r in spark.read.parquet(out).collect())
    assert got == [(t, f"2024-01-0{d} 12:00:00") for t in ("t1", "t2") for d in (2, 3)]
    assert len([p for p in q.recentProgress if p["numInputRows"]]) > 1
    # Streaming ingest appends each record once, also over a restart; a record without a time takes the batch's.
    copy, ck = scratch_path(spark, "copy"), scratch_path(spark, "copy-ck")
    for _ in range(2):
        src = landed.arrived(landed.log_stream(spark, path, ["t0", "t3"]).drop("timestamp"))
        landed.land_stream(src, copy, "merged", ck, available_now=True).awaitTermination()
    merged = spark.read.parquet(copy)
    assert merged.count() == 6 and merged.filter("timestamp > '2024-02-01'").count() == 6
