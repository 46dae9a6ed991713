"""Channels as named streaming queries: start, list, find, stop.

A running channel reads its source once for all its SQL and DataFrame-form topics:
they share one query ``<channel>.<a>+<b>`` and one pane store. Topics of the
aggregate form keep their own native query (state, no rows), and so does a
topic that does not analyse, which fails alone. Each topic writes flat envelopes to
``<sink>/channel=<c>/topic=<t>/batch_id=<n>`` (routing by directory, so a
subscriber's read prunes to its topic). Starting a channel that already
runs is a no-op; stopping touches only that channel's queries.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.durations import interval_text, to_micros
from ..operators.crosstopic import referenced_topics
from ..plans.delivery import ENVELOPE_COLUMNS, deliver_messages, envelope, publish, subscribe_stream
from ..plans.spec import ChannelSpec, resolve_pipeline
from ..session import scratch_path, stream_session
from ..sources.replay import replay_stream, stage_replay
from .lanes import read_sink, start_native_topic, start_topic_group


# Queries of started channels by (application, channel): whichever session started them, every handle sees them.
_REGISTRY: dict[tuple[str, str], list[StreamingQuery]] = {}


def _active(spark: SparkSession, channel: str) -> list[StreamingQuery]:
    key = (spark.sparkContext.applicationId, channel)
    _REGISTRY[key] = [q for q in _REGISTRY.get(key, []) if q.isActive]
    return _REGISTRY[key]


def _qname(channel: str, topic: str) -> str:
    return f"{channel}.{topic}"


class Channel:
    def __init__(self, spark: SparkSession, spec: ChannelSpec, sink: str, state_root: str):
        self.spark = spark
        self.spec = spec.validate()
        self.sink = sink.rstrip("/")
        self.state_root = state_root.rstrip("/")
        self._started: list[StreamingQuery] = []
        self._sessions: list[SparkSession] = []

    def queries(self) -> list[StreamingQuery]:
        """This channel's active queries (started here, or found in the session)."""
        prefix = f"{self.spec.name}."
        found = {q.id: q for q in (*self._started, *_active(self.spark, self.spec.name)) if q.isActive}
        for session in {id(s): s for s in (self.spark, *self._sessions)}.values():
            for q in session.streams.active:
                if (q.name or "").startswith(prefix):
                    found.setdefault(q.id, q)
        return list(found.values())

    @property
    def is_running(self) -> bool:
        return bool(self.queries())

    def start(self, source: DataFrame, ts: str = "ts", available_now: bool = False) -> list[StreamingQuery]:
        """Start the channel's queries; idempotent while it runs."""
        if self.is_running:
            return self.queries()
        self._sessions.append(source.sparkSession)
        records = resolve_pipeline(self.spec.pipeline)(source)
        ch = self.spec.name
        trigger = None if available_now else interval_text(to_micros(self.spec.batch_interval))
        delay_us = to_micros(self.spec.delay)
        started = []
        for group in topic_groups(self.spec, records, ts):
            key = "+".join(t.name for t in group)
            where = f"{self.state_root}/{ch}/{key}"
            common = dict(ts=ts, available_now=available_now, query_name=_qname(ch, key), processing_time=trigger, delay_us=delay_us)
            if len(group) == 1 and native(group[0]):
                t = group[0]
                started.append(start_native_topic(
                    records, t, f"{self.sink}/channel={ch}/topic={t.name}", f"{where}/checkpoint",
                    to_output=lambda df, name=t.name: envelope(df, ch, name).drop("channel", "topic"), **common))
            else:
                started.append(start_topic_group(
                    records, group, lambda name: f"{self.sink}/channel={ch}/topic={name}", f"{where}/state", f"{where}/checkpoint",
                    to_output=lambda name, df: envelope(df, ch, name).drop("channel", "topic"), **common))
        self._started.extend(started)
        _REGISTRY.setdefault((self.spark.sparkContext.applicationId, ch), []).extend(started)
        return started

    def stop(self, graceful: bool = True) -> None:
        """Stop this channel's queries; graceful drains what has arrived first."""
        for q in self.queries():
            if graceful:
                q.processAllAvailable()
            q.stop()

    def results(self) -> DataFrame:
        return read_sink(self.spark, self.sink).filter(F.col("channel") == self.spec.name)


def native(topic) -> bool:
    """Whether a topic runs as a native streaming aggregation."""
    return topic.aggregate is not None and all(f in ("count", "sum", "min", "max") for _, f, _ in topic.aggregate[1])


def topic_groups(spec: ChannelSpec, records: DataFrame, ts: str = "ts") -> list[list]:
    """The topics of each query: all that need their windows' rows together (in channel order), the others alone.

    A native topic that others read shares their store: its windows' rows are their table.
    """
    failing = spec.failing(records.sparkSession, records.schema, ts)
    names = [t.name for t in spec.topics]
    read = {n for t in spec.topics if t.ql and t.name not in failing for n in referenced_topics(t.ql, [x for x in names if x != t.name])}
    alone = [t for t in spec.topics if t.name in failing or (native(t) and t.name not in read)]
    shared = [t for t in spec.topics if t not in alone]
    return ([shared] if shared else []) + [[t] for t in alone]


def list_channels(spark: SparkSession) -> list[str]:
    """Names of the channels with at least one running topic query."""
    app = spark.sparkContext.applicationId
    return sorted(channel for a, channel in list(_REGISTRY) if a == app and _active(spark, channel))


def channel_status(spark: SparkSession) -> list[tuple[str, str, str]]:
    """(channel, topic or topics, status) of every running query of a channel."""
    return sorted((c, q.name.split(".", 1)[1], q.status["message"])
                  for c in list_channels(spark) for q in _active(spark, c))


def find_channel_queries(spark: SparkSession, channel: str) -> list[StreamingQuery]:
    return list(_active(spark, channel))


# ------------------------------------------------------------- replay runs (queries, tests)


def lifecycle_roundtrip(spark: SparkSession, events: DataFrame, spec: ChannelSpec,
                        n_files: int = 4) -> DataFrame:
    """Start a channel over a replayed stream, check it is listed, drain, stop, read results."""
    src = stage_replay(events, n_files)
    chan = Channel(spark, spec, scratch_path(spark, "channel-sink"), scratch_path(spark, "channel-state"))
    stream = replay_stream(stream_session(spark), src, events.schema)
    first = chan.start(stream, available_now=True)
    again = chan.start(stream, available_now=True)
    if chan.is_running and len(again) != len(first):
        raise RuntimeError("a running channel was started twice")
    if chan.is_running and spec.name not in list_channels(spark):
        raise RuntimeError("a running channel is not listed")
    for q in first:
        q.awaitTermination()
    chan.stop()
    if chan.is_running:
        raise RuntimeError("channel still running after stop")
    return chan.results().select("channel", "topic", "window_start", "window_end", "columns", "payload")


def listener_roundtrip(spark: SparkSession, published: str, channel: str, topic: str) -> DataFrame:
    """Subscribe to a topic with a listener that stores what it receives."""
    out = scratch_path(spark, "listener-out")

    def store(delivered_topic: str, columns: list[str], rows: DataFrame) -> None:
        rows.withColumn("delivered_topic", F.lit(delivered_topic)).write.mode("append").parquet(out)

    q = subscribe_stream(spark, published, channel, topic, store, scratch_path(spark, "listener-ckpt"),
                         available_now=True)
    q.awaitTermination()
    return spark.read.parquet(out)


def unsubscribe_roundtrip(spark: SparkSession, parts: list[DataFrame], channel: str, topic: str) -> DataFrame:
    """Publish in two parts; the first subscriber leaves in between. What each of the two received (P5)."""
    path = scratch_path(spark, "published")
    received = {n: scratch_path(spark, f"received-{n}") for n in ("first", "second")}

    def store(name):
        def listener(delivered_topic: str, columns: list[str], rows: DataFrame) -> None:
            rows.withColumn("subscriber", F.lit(name)).write.mode("append").parquet(received[name])
        return listener

    publish(parts[0], path)
    subs = {n: subscribe_stream(spark, path, channel, topic, store(n), scratch_path(spark, f"sub-{n}")) for n in received}
    try:
        for q in subs.values():
            q.processAllAvailable()
        subs["first"].stop()
        publish(parts[1], path)
        subs["second"].processAllAvailable()
    finally:
        for q in subs.values():
            q.stop()
    return spark.read.parquet(*received.values()).select("subscriber", *ENVELOPE_COLUMNS)


def listed_roundtrip(spark: SparkSession, events: DataFrame, spec: ChannelSpec) -> DataFrame:
    """Results of a channel with what the registry said of it while it ran and after it stopped."""
    src = stage_replay(events, 2)
    chan = Channel(spark, spec, scratch_path(spark, "channel-sink"), scratch_path(spark, "channel-state"))
    chan.start(replay_stream(stream_session(spark), src, events.schema))
    try:
        listed, found = spec.name in list_channels(spark), len(find_channel_queries(spark, spec.name))
    finally:
        chan.stop(graceful=True)
    after = spec.name in list_channels(spark)
    return chan.results().select(*ENVELOPE_COLUMNS).withColumns(
        {"listed": F.lit(listed), "queries": F.lit(found), "listed_after": F.lit(after)})


def messages_roundtrip(spark: SparkSession, published: str, channel: str, topic: str) -> DataFrame:
    """Deliver a topic's messages to a listener that fails once on its way; what it kept, after a restart."""
    ledger, checkpoint = scratch_path(spark, "messages-ledger"), scratch_path(spark, "messages-ckpt")
    calls, kept = {"n": 0, "fail_at": 3}, []

    def keep(delivered_topic: str, columns: list[str], message) -> None:
        calls["n"] += 1
        if calls["n"] == calls["fail_at"]:
            raise RuntimeError("the subscriber died")
        kept.append((delivered_topic, message.window_start, message.window_end, message.part, ",".join(columns), "|".join(message.data)))

    for _ in range(2):
        q = deliver_messages(spark, published, channel, topic, keep, ledger, checkpoint, available_now=True)
        try:
            q.awaitTermination()
        except StreamingQueryException:
            if calls["n"] != calls["fail_at"]:
                raise
    return spark.createDataFrame(kept, _KEPT)


_KEPT = "delivered_topic string, window_start timestamp_ntz, window_end timestamp_ntz, part long, columns string, payloads string"
