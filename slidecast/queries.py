"""Registered queries (one per inventory item) and their DuckDB oracles.

Every query reads the driver's tables (``events``) whole. Window lengths
of the reference's example topics (5 s, 60 s) are scaled to the data's
30-day span. Window columns are TIMESTAMP_NTZ (DuckDB ``TIMESTAMP``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.sliding import sliding_top
from .operators.windowjoin import Side, cogroup, has, join_rows
from .operators.windows import WINDOW_END, WINDOW_START
from .plans.broker import run_channel, run_topic
from .plans.delivery import ENVELOPE_COLUMNS, envelopes, messages, publish, subscribe
from .plans.spec import ChannelSpec, TopicSpec, compose, register_pipeline
from .session import scratch_path, stream_session
from .sources.codec import bbox_filter, decode, encode, project_record
from .sources.tables import read_events

# Window sizes in seconds.
HOUR = 3600
DAY = 86400
US = 1_000_000

EVENT_COLS = "event_id, ts, user_id, event_type, value, props"
COUNT_BY_TYPE = "select event_type, count(*) as n from {t} group by event_type"

# ---------------------------------------------------------------- oracle helpers


def duck_windows(window_s: float, slide_s: float | None = None, origin_s: float = 0,
                 src: str = "events") -> str:
    """DuckDB relation: every row of ``src`` once per window ``[end-W, end)``."""
    w = int(window_s * US)
    s = int((slide_s or window_s) * US)
    o = int(origin_s * US)
    return (f"(SELECT x.* EXCLUDE (k), make_timestamp(k * {s} + {o} - {w}) AS window_start, "
            f"make_timestamp(k * {s} + {o}) AS window_end FROM ("
            f"SELECT r.*, unnest(generate_series("
            f"CAST(floor((epoch_us(r.ts) - {o}) / {s}) AS BIGINT) + 1, "
            f"CAST(floor((epoch_us(r.ts) + {w} - {o}) / {s}) AS BIGINT))) AS k FROM {src} r) x)")


def duck_count_by_type(window_s, slide_s=None, origin_s=0) -> str:
    return (f"SELECT window_start, window_end, event_type, count(*) AS n "
            f"FROM {duck_windows(window_s, slide_s, origin_s)} GROUP BY ALL")


# ---------------------------------------------------------------- helpers


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_events(spark, sf_dir)


def _topic(spark, sf_dir, name, ql, window, slide=None, origin=0, lane="auto", **kw) -> DataFrame:
    t = TopicSpec(name=name, ql=ql, window=window, slide=slide, origin=origin, **kw)
    return run_topic(_events(spark, sf_dir), t, lane=lane)


def _fanout_channel() -> ChannelSpec:
    ch = "events_channel"
    return ChannelSpec(ch, [
        TopicSpec("sliding", COUNT_BY_TYPE.format(t="sliding"), DAY, DAY // 2, ch),
        TopicSpec("tumbling", COUNT_BY_TYPE.format(t="tumbling"), DAY, DAY, ch),
        TopicSpec("gapped", COUNT_BY_TYPE.format(t="gapped"), 6 * HOUR, 12 * HOUR, ch),
    ])


def _duck_env(topic: str, rel: str, cols: list[str]) -> str:
    js = ", ".join(f"'{c}': {c}" for c in cols)
    return (f"SELECT 'events_channel' AS channel, '{topic}' AS topic, window_start, window_end, "
            f"'{','.join(cols)}' AS columns, CAST(to_json({{{js}}}) AS VARCHAR) AS payload FROM ({rel})")


# ---------------------------------------------------------------- sources (2A)


def _log(ev: DataFrame, corrupt_errors: bool, keep=()) -> DataFrame:
    log = encode(ev, {"event_id": "event_id", "ts": "ts", "user_id": "user_id",
                      "name": "event_type", "text": "props", "value": "value"},
                 key=F.col("event_id").cast("string"), keep=["event_type", *keep])
    if corrupt_errors:
        # Fixture: error events reach the log truncated to half their length.
        text = F.col("value").cast("string")
        cut = F.expr("substring(cast(value as string), 1, cast(length(cast(value as string)) / 2 as int))")
        log = log.withColumn("value", F.when(F.col("event_type") == "error", cut).otherwise(text).cast("binary"))
    return log.drop("event_type")


_LOG_SCHEMA = ("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, name STRING, "
               "text STRING, value DOUBLE")


def q_s1_replay_source(spark, sf_dir):
    from .streaming.lanes import run_passthrough_replay
    return run_passthrough_replay(spark, _events(spark, sf_dir), n_files=4)


def q_s2_decode_drop_malformed(spark, sf_dir):
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL(_LOG_SCHEMA)
    return decode(_log(_events(spark, sf_dir), True), schema)


def q_s4_project_record(spark, sf_dir):
    from pyspark.sql.types import StructType
    return project_record(decode(_log(_events(spark, sf_dir), False), StructType.fromDDL(_LOG_SCHEMA)))


def q_s6_encode_roundtrip(spark, sf_dir):
    from pyspark.sql.types import StructType
    rec = decode(_log(_events(spark, sf_dir), False), StructType.fromDDL(_LOG_SCHEMA), keep_key=True)
    return rec.select("key", "event_id", "ts", "name", "text")


def q_s7_bbox_filter(spark, sf_dir):
    return bbox_filter(_events(spark, sf_dir), "user_id", "value", (10, 60), (20.0, 200.0))


# ---------------------------------------------------------------- windows (2B)


def q_w1_sliding_count(spark, sf_dir):
    return _topic(spark, sf_dir, "sliding", COUNT_BY_TYPE.format(t="sliding"), DAY, DAY // 2)


def q_w2_tumbling_count(spark, sf_dir):
    return _topic(spark, sf_dir, "tumbling", COUNT_BY_TYPE.format(t="tumbling"), DAY)


def q_w3_gapped_count(spark, sf_dir):
    return _topic(spark, sf_dir, "gapped", COUNT_BY_TYPE.format(t="gapped"), 6 * HOUR, 12 * HOUR)


def q_w4_multi_topic_fanout(spark, sf_dir):
    return _fanout_envelopes(spark, sf_dir).select(*ENVELOPE_COLUMNS)


def _fanout_envelopes(spark, sf_dir):
    return envelopes(run_channel(_events(spark, sf_dir), _fanout_channel()), "events_channel")


def q_w5_empty_suppressed(spark, sf_dir):
    return _topic(spark, sf_dir, "hourly",
                  "select event_type, count(*) as n from hourly where value > 480 group by event_type", HOUR)


def q_w5b_empty_windows(spark, sf_dir):
    """Windows of a minute, most of them without a row: a global count fires only where rows are."""
    return _topic(spark, sf_dir, "minutely", "select count(*) as n, min(event_id) as first_id from minutely", 60)


def q_w8_origin_offset(spark, sf_dir):
    return _topic(spark, sf_dir, "shifted", COUNT_BY_TYPE.format(t="shifted"), DAY, DAY, origin=6 * HOUR)


def q_w8b_ragged(spark, sf_dir):
    return _topic(spark, sf_dir, "ragged", COUNT_BY_TYPE.format(t="ragged"), 30 * HOUR, 12 * HOUR)


_HOURLY_SLIDE_SQL = ("select event_type, count(*) as n, sum(user_id) as users_sum, min(value) as vmin, "
                    "max(value) as vmax from {t} group by event_type")


def q_w1b_sliding_pane_agg(spark, sf_dir):
    """1-day windows every hour as an aggregate topic: panes, no per-row copies."""
    return run_topic(_events(spark, sf_dir), _pane_topic())


def q_w1c_sliding_sql_same(spark, sf_dir):
    """The same topic as SQL (plan lane; each event is tagged with 24 windows)."""
    return _topic(spark, sf_dir, "hourly_day", _HOURLY_SLIDE_SQL.format(t="hourly_day"), DAY, HOUR)


def q_w1d_sliding_differences(spark, sf_dir):
    """1-day windows every minute: counts and whole sums by what enters and what leaves."""
    return run_topic(_events(spark, sf_dir), TopicSpec("minutely_day", window=DAY, slide=60, aggregate=(
        ("event_type",), (("n", "count", "*"), ("users_sum", "sum", "user_id")))))


def q_w1e_sliding_distinct(spark, sf_dir):
    """Exact distinct users per 1-day window every hour; no row or value is copied per window."""
    return run_topic(_events(spark, sf_dir), TopicSpec("hourly_users", window=DAY, slide=HOUR, aggregate=(
        ("event_type",), (("n", "count", "*"), ("users", "count_distinct", "user_id")))))


def _pane_topic() -> TopicSpec:
    return TopicSpec("hourly_day", window=DAY, slide=HOUR, aggregate=(
        ("event_type",), (("n", "count", "*"), ("users_sum", "sum", "user_id"),
                          ("vmin", "min", "value"), ("vmax", "max", "value"))))


def q_w7c_stream_pane_agg(spark, sf_dir):
    """The aggregate-form topic on a stream: chained pane aggregation, closed windows."""
    from .streaming.lanes import stream_pane_agg_replay
    return stream_pane_agg_replay(spark, _events(spark, sf_dir), _pane_topic(), n_files=4)


def q_w7_stream_equals_batch(spark, sf_dir):
    from .streaming.lanes import stream_sql_topic_replay
    t = TopicSpec("sliding", COUNT_BY_TYPE.format(t="sliding"), DAY, DAY // 2)
    return stream_sql_topic_replay(spark, _events(spark, sf_dir), t, n_files=4)


def q_w7d_out_of_order_stream(spark, sf_dir):
    """Rows that arrive up to half a day out of order, and windows that wait as long."""
    from .streaming.lanes import stream_sql_topic_replay
    t = TopicSpec("sliding", COUNT_BY_TYPE.format(t="sliding"), DAY, DAY // 2)
    ev = _events(spark, sf_dir)
    late = F.expr(f"make_interval(0, 0, 0, 0, 0, 0, cast(pmod(xxhash64(event_id), {DAY // 2}) as int))")
    return stream_sql_topic_replay(spark, ev.withColumn("arrival", F.col("ts") + late), t, n_files=4,
                                   delay_us=DAY // 2 * 1_000_000, arrival="arrival")


def q_w7b_stream_native_agg(spark, sf_dir):
    from .streaming.lanes import stream_native_agg_replay
    return stream_native_agg_replay(spark, _events(spark, sf_dir), DAY, DAY // 2, ["event_type"],
                                    [F.count(F.lit(1)).alias("n")], n_files=4)


# ---------------------------------------------------------------- per-window SQL (2C)


def q_q3_all_records(spark, sf_dir):
    return _topic(spark, sf_dir, "all_records", "select * from all_records", HOUR)


def q_q4_top_users(spark, sf_dir):
    return _topic(spark, sf_dir, "top_users",
                  "select event_type, count(*) as n from top_users group by event_type order by n", DAY)


def _cross_channel() -> ChannelSpec:
    ch = "cross"
    return ChannelSpec(ch, [
        TopicSpec("fivehour", "select user_id, count(*) as n from fivehour group by user_id",
                  5 * HOUR, 5 * HOUR, ch),
        TopicSpec("daily", "select d.user_id, d.n as day_n, f.n as recent_n from "
                  "(select user_id, count(*) as n from daily group by user_id) d join "
                  "(select user_id, count(*) as n from fivehour group by user_id) f "
                  "on d.user_id = f.user_id", DAY, DAY, ch),
    ])


def q_q5_cross_topic_asof(spark, sf_dir):
    res = run_channel(_events(spark, sf_dir), _cross_channel())
    out = res["daily"]
    if isinstance(out, Exception):
        raise out
    return out


def _theta_channel() -> ChannelSpec:
    ch = "theta"
    return ChannelSpec(ch, [
        TopicSpec("fivehour", "select user_id, count(*) as n from fivehour group by user_id", 5 * HOUR, 5 * HOUR, ch),
        TopicSpec("daily", "select d.user_id, d.n as day_n, f.mx as recent_max from "
                  "(select user_id, count(*) as n from daily group by user_id) d join "
                  "(select max(n) as mx from (select user_id, count(*) as n from fivehour group by user_id) u) f "
                  "on d.n > f.mx", DAY, DAY, ch),
    ])


def q_q5c_cross_topic_theta(spark, sf_dir):
    """A cross-topic join without an equality of its own: the window is still a join key."""
    out = run_channel(_events(spark, sf_dir), _theta_channel())["daily"]
    if isinstance(out, Exception):
        raise out
    return out


def q_q5b_cross_topic_stream(spark, sf_dir):
    from .streaming.channel import lifecycle_roundtrip
    out = lifecycle_roundtrip(spark, _events(spark, sf_dir), _cross_channel(), n_files=4)
    payload = "struct<user_id:bigint,day_n:bigint,recent_n:bigint>"
    return (out.filter(F.col("topic") == "daily")
            .select(WINDOW_START, WINDOW_END, F.from_json("payload", payload).alias("p"))
            .select(WINDOW_START, WINDOW_END, "p.user_id", "p.day_n", "p.recent_n"))


def q_q6_ordered_result(spark, sf_dir):
    return _topic(spark, sf_dir, "top_users",
                  "select event_type, count(*) as n from top_users group by event_type order by n", DAY,
                  order_by=("n", "event_type"))


# ---------------------------------------------------------------- delivery (2D)


def q_p1_envelope(spark, sf_dir):
    res = q_q6_ordered_result(spark, sf_dir)
    from .plans.delivery import envelope
    msgs = messages(envelope(res, "events_channel", "top_users"), max_rows=2, ordered=True)
    return msgs.withColumn("payloads", F.array_join("data", "|")).drop("data", "column_names")


def q_p3_subscribe(spark, sf_dir):
    path = scratch_path(spark, "published")
    publish(_fanout_envelopes(spark, sf_dir), path)
    return subscribe(spark, path, "events_channel", "gapped").select(*ENVELOPE_COLUMNS)


def q_p4_listener(spark, sf_dir):
    from .streaming.channel import listener_roundtrip
    path = scratch_path(spark, "published")
    publish(_fanout_envelopes(spark, sf_dir), path)
    return listener_roundtrip(spark, path, "events_channel", "tumbling").select("delivered_topic", *ENVELOPE_COLUMNS)


def q_p4b_ordered_messages_once(spark, sf_dir):
    """Messages of the ordered topic, in row order, through a subscriber that dies and starts again; each once."""
    from .streaming.channel import messages_roundtrip
    env = envelopes({"top_users": q_q6_ordered_result(spark, sf_dir)}, "events_channel")
    path = scratch_path(spark, "messages")
    publish(messages(env, max_rows=2, ordered=True), path)
    return messages_roundtrip(spark, path, "events_channel", "top_users")


def q_p5_unsubscribe(spark, sf_dir):
    """Two subscribers of a topic; the first leaves after the first half of January, the second stays."""
    from .streaming.channel import unsubscribe_roundtrip
    env = _fanout_envelopes(spark, sf_dir).filter(F.col("topic") == "gapped")
    early = F.col(WINDOW_END) <= F.lit(_MID).cast("timestamp_ntz")
    return unsubscribe_roundtrip(spark, [env.filter(early), env.filter(~early)], "events_channel", "gapped")


_MID = "2024-01-15 00:00:00"


# ---------------------------------------------------------------- composition (2E)


def _band(df: DataFrame) -> DataFrame:
    return df.withColumn("band", F.floor(F.col("value") / 50).cast("bigint"))


def q_x1_pipeline_compose(spark, sf_dir):
    ev = _events(spark, sf_dir)
    pipe = compose(lambda d: bbox_filter(d, "user_id", "value", (10, 60), (20.0, 200.0)), _band)
    ch = ChannelSpec("composed", [TopicSpec(
        "bands", "select band, count(*) as n, min(value) as vmin, max(value) as vmax from bands group by band",
        DAY, DAY, "composed")], pipeline=pipe)
    return run_channel(ev, ch)["bands"]


def q_x3_named_pipeline(spark, sf_dir):
    """The channel of ``x1`` with its pipeline picked by name."""
    register_pipeline("boxed_bands", compose(lambda d: bbox_filter(d, "user_id", "value", (10, 60), (20.0, 200.0)), _band))
    ch = ChannelSpec("named", [TopicSpec(
        "bands", "select band, count(*) as n, min(value) as vmin, max(value) as vmax from bands group by band",
        DAY, DAY, "named")], pipeline="boxed_bands")
    return run_channel(_events(spark, sf_dir), ch)["bands"]


def q_x5_spec_table(spark, sf_dir):
    """The fan-out channel written to a spec table in the shared folder, read back and run."""
    path = scratch_path(spark, "specs")
    _fanout_channel().to_table(spark).write.parquet(path)
    ch = ChannelSpec.from_table(spark.read.parquet(path), "events_channel")
    return envelopes(run_channel(_events(spark, sf_dir), ch), ch.name).select(*ENVELOPE_COLUMNS)


def q_x6_validate(spark, sf_dir):
    """Topics that cannot run over the events are found first; the others run."""
    ev = _events(spark, sf_dir)
    good = _fanout_channel()
    spec = ChannelSpec(good.name, [*good.topics, TopicSpec("bad", "select no_such_column from bad", DAY, DAY, good.name),
                                   TopicSpec("worse", "select from where", DAY, DAY, good.name)])
    failing = spec.failing(spark, ev.schema)
    fit = ChannelSpec(spec.name, [t for t in spec.topics if t.name not in failing])
    return envelopes(run_channel(ev, fit), fit.name).select(*ENVELOPE_COLUMNS, F.lit(",".join(sorted(failing))).alias("left_out"))


def q_x8_list_and_find(spark, sf_dir):
    """A running channel is listed and found by name; when it has stopped it is not."""
    from .streaming.channel import listed_roundtrip
    return listed_roundtrip(spark, _events(spark, sf_dir), _fanout_channel())


def q_x2_log_to_channel_stream(spark, sf_dir):
    """The reference's whole flow on a stream: encoded log (with truncated
    records) → landed log topic → decode pipeline (drop malformed) → channel with the
    example ``top_users`` topic → envelopes of the closed windows."""
    from pyspark.sql.types import StructType
    from .sources import landed
    from .streaming.channel import Channel
    path = scratch_path(spark, "x2-log")
    landed.land(landed.arrived(_log(_events(spark, sf_dir), True, keep=["ts"]), "ts"), path, "tweets")
    log = landed.log_stream(stream_session(spark), path, ["tweets"], wall_clock=True)
    schema = StructType.fromDDL(_LOG_SCHEMA)
    ch = ChannelSpec("tweets_channel", [TopicSpec(
        "top_users", "select name, count(*) as tweets from top_users group by name order by tweets",
        DAY, DAY, "tweets_channel")], pipeline=lambda df: decode(df.select("key", "value"), schema))
    chan = Channel(spark, ch, scratch_path(spark, "x2-sink"), scratch_path(spark, "x2-state"))
    for q in chan.start(log, available_now=True):
        q.awaitTermination()
    return chan.results().select("channel", "topic", WINDOW_START, WINDOW_END, "columns", "payload")


def _landed_log(spark, sf_dir) -> str:
    """Two log topics (even and odd events) whose records hold no time: only the log knows when they arrived."""
    from .sources import landed
    ev = _events(spark, sf_dir)
    log = encode(ev, {"name": "event_type", "text": "props"}, key=F.col("event_id").cast("string"), keep=["ts", "event_id"])
    path = scratch_path(spark, "log")
    landed.land(landed.arrived(log, "ts"), path, F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd"))
    return path


def q_s1b_two_log_topics(spark, sf_dir):
    """Two log topics as one stream, from an instant on, with the arrival time of each record."""
    from .sources.landed import log_stream
    log = log_stream(stream_session(spark), _landed_log(spark, sf_dir), ["even", "odd"], starting="2024-01-10 00:00:00", wall_clock=True, max_bytes=64 << 20)
    out = scratch_path(spark, "log-out")
    (log.select("key", "topic", F.col("timestamp").alias("arrived"), F.col("value").cast("string").alias("value"))
     .writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "log-ckpt"))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out)


def q_w7e_arrival_clock_stream(spark, sf_dir):
    """Records ``(name, text, count)`` without a time of their own, windowed by the time the log took them in."""
    from pyspark.sql.types import StructType
    from .sources.landed import ARRIVAL, log_stream
    from .streaming.channel import Channel
    schema = StructType.fromDDL("name STRING, text STRING")
    ch = ChannelSpec("arrivals", [TopicSpec(
        "names", "select name, count(*) as n, sum(count) as c from names group by name", DAY, DAY // 2, "arrivals")],
        pipeline=lambda df: project_record(decode(df, schema, keep=[ARRIVAL]), keep=[ARRIVAL]))
    chan = Channel(spark, ch, scratch_path(spark, "arrival-sink"), scratch_path(spark, "arrival-state"))
    log = log_stream(stream_session(spark), _landed_log(spark, sf_dir), ["even", "odd"], wall_clock=True)
    for q in chan.start(log, ts=ARRIVAL, available_now=True):
        q.awaitTermination()
    return chan.results().select(*ENVELOPE_COLUMNS)


def q_s3b_binary_records(spark, sf_dir):
    """The binary record of two strings: encoded, error events truncated to half, decoded, malformed ones dropped."""
    from .sources.binary import decode_strings, encode_strings
    ev = _events(spark, sf_dir)
    log = encode_strings(ev, ["event_type", "props"], key=F.col("event_id"), keep=["event_type"])
    half = F.expr("substring(value, 1, cast(octet_length(value) / 2 as int))")
    log = log.withColumn("value", F.when(F.col("event_type") == "error", half).otherwise(F.col("value")))
    return decode_strings(log, ["name", "text"], keep=["key"])


def q_x7_channel_lifecycle(spark, sf_dir):
    from .streaming.channel import lifecycle_roundtrip
    return lifecycle_roundtrip(spark, _events(spark, sf_dir), _fanout_channel(), n_files=4)


# ---------------------------------------------------------------- SQL through ql (2F)

F_SQL = {
    "f1_scalar_funcs": (
        "select event_id, upper(event_type) as et, length(props) as plen, "
        "case when value > 100 then 'high' else 'low' end as band, "
        "cast(floor(value) as bigint) as vfloor, get_json_object(props, '$.k') as k, "
        "abs(user_id - 75) as dist, hour(ts) as hr, concat(event_type, '-', cast(user_id as string)) as tag "
        "from ev"),
    "f2_filter": (
        "select event_id, event_type, value from ev where (value between 100 and 200 "
        "or event_type in ('error', 'signup')) and not (user_id < 5) and props like '%k%' "
        "and event_type is not null and event_type rlike '^[a-s]'"),
    "f3_global_agg": (
        "select count(*) as n, min(value) as vmin, max(value) as vmax, sum(user_id) as su "
        "from ev where value > 450"),
    "f4_count_distinct": "select event_type, count(distinct user_id) as users from ev group by event_type",
    "f5_having": "select user_id, count(*) as n from ev group by user_id having count(*) >= 3",
    "f6_distinct": "select distinct event_type, cast(floor(value / 100) as bigint) as vband from ev",
    "f7_topk": "select event_id, user_id, value from ev order by value desc, event_id limit 3",
    "f8_self_join": (
        "select a.event_id, a.event_type, a.value from ev a join "
        "(select event_type, max(value) as mx from ev group by event_type) b "
        "on a.event_type = b.event_type and a.value >= b.mx * 0.8"),
    "f9b_theta_join": (
        "select a.event_id, a.value from ev a, (select avg(value) as av, max(value) as mx from ev) b "
        "where a.value > b.mx * 0.9 and a.value > b.av"),
    "f12_union": (
        "select event_type, 'hi' as tag from ev where value > 300 union "
        "select event_type, 'lo' as tag from ev where value < 5"),
    "f12b_union_all": (
        "select event_type, 'hi' as tag from ev where value > 300 union all "
        "select event_type, 'lo' as tag from ev where value < 5"),
    "f13_intersect": (
        "select user_id from ev where event_type = 'purchase' intersect "
        "select user_id from ev where event_type = 'view'"),
    "f14_except": (
        "select user_id from ev where event_type = 'view' except "
        "select user_id from ev where event_type = 'purchase'"),
    "f15_with": (
        "with per_user as (select user_id, count(*) as n from ev group by user_id) "
        "select n, count(*) as users from per_user group by n"),
    "f16_approx_distinct": "select event_type, approx_count_distinct(user_id) as users from ev group by event_type",
    "f1b_nested_access": (
        "select event_id, split(props, ' ')[1] as second_tok, from_json(props, 'map<string,int>')['k'] as k_val, "
        "array(user_id, event_id)[0] as first_el, named_struct('u', user_id, 'v', value).v as sv from ev"),
    "f18_rank_window": (
        "select event_id, event_type, rank() over (partition by event_type order by value desc) as rk from ev"),
    "f20_explode": "select event_id, tok from ev lateral view explode(split(props, ' ')) t as tok",
    "f21_pivot": (
        "select * from (select user_id, event_type from ev) "
        "pivot (count(*) for event_type in ('view' as views, 'purchase' as purchases))"),
}

_W = f"{duck_windows(DAY)}"

F_ORACLE = {
    "f1_scalar_funcs": (
        f"SELECT window_start, window_end, event_id, upper(event_type) AS et, length(props) AS plen, "
        f"CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS band, CAST(floor(value) AS BIGINT) AS vfloor, "
        f"json_extract_string(props, '$.k') AS k, abs(user_id - 75) AS dist, CAST(hour(ts) AS INTEGER) AS hr, "
        f"concat(event_type, '-', CAST(user_id AS VARCHAR)) AS tag FROM {_W}"),
    "f2_filter": (
        f"SELECT window_start, window_end, event_id, event_type, value FROM {_W} WHERE (value BETWEEN 100 AND 200 "
        f"OR event_type IN ('error', 'signup')) AND NOT (user_id < 5) AND props LIKE '%k%' "
        f"AND event_type IS NOT NULL AND regexp_matches(event_type, '^[a-s]')"),
    "f3_global_agg": (
        f"SELECT w.window_start, w.window_end, count(e.event_id) AS n, min(e.value) AS vmin, "
        f"max(e.value) AS vmax, sum(e.user_id) AS su FROM (SELECT DISTINCT window_start, window_end FROM {_W}) w "
        f"LEFT JOIN (SELECT * FROM {_W} WHERE value > 450) e ON e.window_end = w.window_end "
        f"GROUP BY w.window_start, w.window_end"),
    "f4_count_distinct": (
        f"SELECT window_start, window_end, event_type, count(DISTINCT user_id) AS users FROM {_W} GROUP BY ALL"),
    "f5_having": (
        f"SELECT window_start, window_end, user_id, count(*) AS n FROM {_W} GROUP BY ALL HAVING count(*) >= 3"),
    "f6_distinct": (
        f"SELECT DISTINCT window_start, window_end, event_type, CAST(floor(value / 100) AS BIGINT) AS vband FROM {_W}"),
    "f7_topk": (
        f"SELECT window_start, window_end, event_id, user_id, value FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY window_end ORDER BY value DESC, event_id) AS rn FROM {_W}) WHERE rn <= 3"),
    "f8_self_join": (
        f"SELECT a.window_start, a.window_end, a.event_id, a.event_type, a.value FROM {_W} a JOIN "
        f"(SELECT window_end, event_type, max(value) AS mx FROM {_W} GROUP BY ALL) b "
        f"ON a.window_end = b.window_end AND a.event_type = b.event_type AND a.value >= b.mx * 0.8"),
    "f9b_theta_join": (
        f"SELECT a.window_start, a.window_end, a.event_id, a.value FROM {_W} a JOIN "
        f"(SELECT window_end, avg(value) AS av, max(value) AS mx FROM {_W} GROUP BY ALL) b "
        f"ON a.window_end = b.window_end WHERE a.value > b.mx * 0.9 AND a.value > b.av"),
    "f10_left_join": (
        f"SELECT a.window_start, a.window_end, a.event_type, count(b.event_id) AS hi FROM "
        f"(SELECT DISTINCT window_start, window_end, event_type FROM {_W}) a LEFT JOIN "
        f"(SELECT window_end, event_id, event_type FROM {_W} WHERE value > 300) b "
        f"ON a.window_end = b.window_end AND a.event_type = b.event_type GROUP BY ALL"),
    "f11_left_semi": (
        f"SELECT a.window_start, a.window_end, a.event_id, a.user_id FROM {_W} a WHERE EXISTS ("
        f"SELECT 1 FROM {_W} b WHERE b.window_end = a.window_end AND b.user_id = a.user_id "
        f"AND b.event_type = 'purchase')"),
    "f12_union": (
        f"SELECT window_start, window_end, event_type, 'hi' AS tag FROM {_W} WHERE value > 300 UNION "
        f"SELECT window_start, window_end, event_type, 'lo' AS tag FROM {_W} WHERE value < 5"),
    "f12b_union_all": (
        f"SELECT window_start, window_end, event_type, 'hi' AS tag FROM {_W} WHERE value > 300 UNION ALL "
        f"SELECT window_start, window_end, event_type, 'lo' AS tag FROM {_W} WHERE value < 5"),
    "f13_intersect": (
        f"SELECT window_start, window_end, user_id FROM {_W} WHERE event_type = 'purchase' INTERSECT "
        f"SELECT window_start, window_end, user_id FROM {_W} WHERE event_type = 'view'"),
    "f14_except": (
        f"SELECT window_start, window_end, user_id FROM {_W} WHERE event_type = 'view' EXCEPT "
        f"SELECT window_start, window_end, user_id FROM {_W} WHERE event_type = 'purchase'"),
    "f15_with": (
        f"SELECT window_start, window_end, n, count(*) AS users FROM (SELECT window_start, window_end, user_id, "
        f"count(*) AS n FROM {_W} GROUP BY ALL) GROUP BY ALL"),
    "f1b_nested_access": (
        f"SELECT window_start, window_end, event_id, split(props, ' ')[2] AS second_tok, "
        f"CAST(json_extract(props, '$.k') AS INTEGER) AS k_val, [user_id, event_id][1] AS first_el, "
        f"value AS sv FROM {_W}"),
    "f10b_full_outer": (
        f"SELECT coalesce(a.window_start, b.window_start) AS window_start, "
        f"coalesce(a.window_end, b.window_end) AS window_end, coalesce(a.event_type, b.event_type) AS event_type, "
        f"a.n AS hi_n, b.n AS lo_n FROM "
        f"(SELECT window_start, window_end, event_type, count(*) AS n FROM {_W} WHERE value > 300 GROUP BY ALL) a "
        f"FULL OUTER JOIN "
        f"(SELECT window_start, window_end, event_type, count(*) AS n FROM {_W} WHERE value < 5 GROUP BY ALL) b "
        f"ON a.window_end = b.window_end AND a.event_type = b.event_type"),
    "f17_in_subquery": (
        f"SELECT a.window_start, a.window_end, a.event_id, a.user_id FROM {_W} a WHERE EXISTS ("
        f"SELECT 1 FROM {_W} b WHERE b.window_end = a.window_end AND b.user_id = a.user_id AND b.value > 400)"),
    "f17b_not_in_subquery": (
        f"SELECT a.window_start, a.window_end, a.event_id, a.user_id FROM {_W} a WHERE NOT EXISTS ("
        f"SELECT 1 FROM {_W} b WHERE b.window_end = a.window_end AND b.user_id = a.user_id AND b.value > 400)"),
    "f7b_sliding_topk": (
        f"SELECT window_start, window_end, event_id, user_id, value, rank FROM (SELECT *, CAST(row_number() OVER "
        f"(PARTITION BY window_end ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM {duck_windows(DAY, HOUR)}) WHERE rank <= 3"),
    "f16b_sliding_approx_distinct": (
        f"SELECT window_start, window_end, event_type, count(DISTINCT user_id) AS users, true AS within_bound "
        f"FROM {duck_windows(DAY, HOUR)} GROUP BY ALL"),
    "f18_rank_window": (
        f"SELECT window_start, window_end, event_id, event_type, rank() OVER (PARTITION BY window_end, event_type "
        f"ORDER BY value DESC) AS rk FROM {_W}"),
    "f19_rollup": (
        f"SELECT window_start, window_end, event_type, count(*) AS n FROM {_W} "
        f"GROUP BY GROUPING SETS ((window_start, window_end, event_type), (window_start, window_end))"),
    "f20_explode": (
        f"SELECT window_start, window_end, event_id, unnest(string_split(props, ' ')) AS tok FROM {_W}"),
    "f21_pivot": (
        f"SELECT window_start, window_end, user_id, "
        f"nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS views, "
        f"nullif(count(*) FILTER (WHERE event_type = 'purchase'), 0) AS purchases FROM {_W} GROUP BY ALL"),
}


def _left_join_by_window(rows: DataFrame) -> DataFrame:
    """f10 as a DataFrame-form topic: the join keys carry ``window_end`` (fully parallel)."""
    types = rows.select(WINDOW_START, WINDOW_END, "event_type").distinct()
    high = rows.filter(F.col("value") > 300).groupBy(WINDOW_END, "event_type").agg(F.count("event_id").alias("hi"))
    return types.join(high, [WINDOW_END, "event_type"], "left").select(
        WINDOW_START, WINDOW_END, "event_type", F.coalesce("hi", F.lit(0)).alias("hi"))


def _left_join(rows: DataFrame) -> DataFrame:
    both = cogroup(rows, ["event_type"], {"a": Side(), "b": Side(F.col("value") > 300, [("hi", "count", "event_id")])})
    return both.filter(has("a")).select(WINDOW_START, WINDOW_END, "event_type", F.coalesce("hi", F.lit(0)).alias("hi"))


def _full_outer(rows: DataFrame) -> DataFrame:
    return cogroup(rows, ["event_type"], {
        "hi": Side(F.col("value") > 300, [("hi_n", "count", "*")]),
        "lo": Side(F.col("value") < 5, [("lo_n", "count", "*")])}).drop(has("hi"), has("lo"))


def _left_semi(rows: DataFrame) -> DataFrame:
    buyers = rows.filter(F.col("event_type") == "purchase")
    return join_rows(rows.select(WINDOW_START, WINDOW_END, "event_id", "user_id"), buyers, ["user_id"], "left_semi").select(
        WINDOW_START, WINDOW_END, "event_id", "user_id")


def _in_subquery(rows: DataFrame) -> DataFrame:
    high = rows.filter(F.col("value") > 400)
    return join_rows(rows.select(WINDOW_START, WINDOW_END, "event_id", "user_id"), high, ["user_id"], "left_semi").select(
        WINDOW_START, WINDOW_END, "event_id", "user_id")


def _not_in_subquery(rows: DataFrame) -> DataFrame:
    high = rows.filter(F.col("value") > 400)
    return join_rows(rows.select(WINDOW_START, WINDOW_END, "event_id", "user_id"), high, ["user_id"], "not_in").select(
        WINDOW_START, WINDOW_END, "event_id", "user_id")


def _rollup(rows: DataFrame) -> DataFrame:
    window = [WINDOW_START, WINDOW_END]
    return rows.groupingSets([[*window, "event_type"], window], *window, "event_type").agg(F.count(F.lit(1)).alias("n"))


# Joins and grouping sets as DataFrame-form topics: one plan for all windows.
F_FN = {"f10_left_join": _left_join, "f10b_full_outer": _full_outer, "f11_left_semi": _left_semi,
        "f17_in_subquery": _in_subquery, "f17b_not_in_subquery": _not_in_subquery, "f19_rollup": _rollup}


def _fn_query(key: str):
    def run(spark, sf_dir):
        return run_topic(_events(spark, sf_dir), TopicSpec("ev", fn=F_FN[key], window=DAY))
    run.__name__ = f"q_{key}"
    return run


def q_f7b_sliding_topk(spark, sf_dir):
    """The three largest values of every 1-day window, every hour."""
    top = sliding_top(_events(spark, sf_dir), DAY, HOUR, [F.desc("value"), F.asc("event_id")], 3)
    return top.select(WINDOW_START, WINDOW_END, "event_id", "user_id", "value", "rank")


def q_f16b_sliding_approx_distinct(spark, sf_dir):
    """Approximate distinct users per 1-day window every hour, held against the exact count (within five standard errors)."""
    t = TopicSpec("ev", window=DAY, slide=HOUR, aggregate=(("event_type",), (
        ("users", "count_distinct", "user_id"), ("about", "approx_distinct", "user_id"))))
    found = run_topic(_events(spark, sf_dir), t)
    return found.select(WINDOW_START, WINDOW_END, "event_type", "users",
                        (F.abs(F.col("about") - F.col("users")) <= 5 * 1.04 / 64 * F.col("users") + 1).alias("within_bound"))


def q_f10c_left_join_dataframe_topic(spark, sf_dir):
    t = TopicSpec("ev", fn=_left_join_by_window, window=DAY)
    return run_topic(_events(spark, sf_dir), t)


def _f_query(key: str):
    def run(spark, sf_dir):
        return _topic(spark, sf_dir, "ev", F_SQL[key], DAY)
    run.__name__ = f"q_{key}"
    return run


# ---------------------------------------------------------------- registry


def registry() -> dict:
    reg = {
        "s1_replay_source": q_s1_replay_source,
        "s2_decode_drop_malformed": q_s2_decode_drop_malformed,
        "s1b_two_log_topics": q_s1b_two_log_topics,
        "s3b_binary_records": q_s3b_binary_records,
        "s4_project_record": q_s4_project_record,
        "s6_encode_roundtrip": q_s6_encode_roundtrip,
        "s7_bbox_filter": q_s7_bbox_filter,
        "w1_sliding_count": q_w1_sliding_count,
        "w1b_sliding_pane_agg": q_w1b_sliding_pane_agg,
        "w1c_sliding_sql_same": q_w1c_sliding_sql_same,
        "w1d_sliding_differences": q_w1d_sliding_differences,
        "w1e_sliding_distinct": q_w1e_sliding_distinct,
        "w2_tumbling_count": q_w2_tumbling_count,
        "w3_gapped_count": q_w3_gapped_count,
        "w4_multi_topic_fanout": q_w4_multi_topic_fanout,
        "w5_empty_suppressed": q_w5_empty_suppressed,
        "w5b_empty_windows": q_w5b_empty_windows,
        "w7_stream_equals_batch": q_w7_stream_equals_batch,
        "w7b_stream_native_agg": q_w7b_stream_native_agg,
        "w7d_out_of_order_stream": q_w7d_out_of_order_stream,
        "w7c_stream_pane_agg": q_w7c_stream_pane_agg,
        "w7e_arrival_clock_stream": q_w7e_arrival_clock_stream,
        "w8_origin_offset": q_w8_origin_offset,
        "w8b_ragged": q_w8b_ragged,
        "q3_all_records": q_q3_all_records,
        "q4_top_users": q_q4_top_users,
        "q5_cross_topic_asof": q_q5_cross_topic_asof,
        "q5b_cross_topic_stream": q_q5b_cross_topic_stream,
        "q5c_cross_topic_theta": q_q5c_cross_topic_theta,
        "q6_ordered_result": q_q6_ordered_result,
        "p1_envelope": q_p1_envelope,
        "p3_subscribe": q_p3_subscribe,
        "p4_listener": q_p4_listener,
        "p4b_ordered_messages_once": q_p4b_ordered_messages_once,
        "p5_unsubscribe": q_p5_unsubscribe,
        "x1_pipeline_compose": q_x1_pipeline_compose,
        "x3_named_pipeline": q_x3_named_pipeline,
        "x5_spec_table": q_x5_spec_table,
        "x6_validate": q_x6_validate,
        "x8_list_and_find": q_x8_list_and_find,
        "x2_log_to_channel_stream": q_x2_log_to_channel_stream,
        "x7_channel_lifecycle": q_x7_channel_lifecycle,
    }
    for key in F_SQL:
        reg[key] = _f_query(key)
    for key in F_FN:
        reg[key] = _fn_query(key)
    reg["f10c_left_join_dataframe_topic"] = q_f10c_left_join_dataframe_topic
    reg["f7b_sliding_topk"] = q_f7b_sliding_topk
    reg["f16b_sliding_approx_distinct"] = q_f16b_sliding_approx_distinct
    return reg


def _fanout_oracle() -> str:
    parts = [
        _duck_env("sliding", duck_count_by_type(DAY, DAY // 2), ["event_type", "n"]),
        _duck_env("tumbling", duck_count_by_type(DAY), ["event_type", "n"]),
        _duck_env("gapped", duck_count_by_type(6 * HOUR, 12 * HOUR), ["event_type", "n"]),
    ]
    return " UNION ALL ".join(parts)


def _closed(sql: str) -> str:
    return f"SELECT * FROM ({sql}) WHERE window_end <= (SELECT max(ts) FROM events)"


def oracles() -> dict[str, str]:
    w_day = duck_windows(DAY)
    five = duck_windows(5 * HOUR)
    q6 = (f"SELECT window_start, window_end, event_type, n, row_number() OVER (PARTITION BY window_end "
          f"ORDER BY n, event_type) AS row_index FROM ({duck_count_by_type(DAY)})")
    out = {
        "s1_replay_source": f"SELECT {EVENT_COLS} FROM events",
        "s2_decode_drop_malformed": (
            "SELECT event_id, ts, user_id, event_type AS name, props AS text, value FROM events "
            "WHERE event_type <> 'error'"),
        "s1b_two_log_topics": (
            "SELECT CAST(event_id AS VARCHAR) AS key, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS topic, ts AS arrived, "
            "CAST(to_json({'name': event_type, 'text': props}) AS VARCHAR) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'"),
        "s3b_binary_records": (
            "SELECT CAST(event_id AS VARCHAR) AS key, event_type AS name, props AS text FROM events WHERE event_type <> 'error'"),
        "s4_project_record": "SELECT event_type AS name, props AS text, CAST(0 AS INTEGER) AS count FROM events",
        "s6_encode_roundtrip": (
            "SELECT CAST(event_id AS VARCHAR) AS key, event_id, ts, event_type AS name, props AS text FROM events"),
        "s7_bbox_filter": (
            f"SELECT {EVENT_COLS} FROM events WHERE user_id BETWEEN 10 AND 60 AND value BETWEEN 20.0 AND 200.0"),
        "w1_sliding_count": duck_count_by_type(DAY, DAY // 2),
        "w1b_sliding_pane_agg": (
            f"SELECT window_start, window_end, event_type, count(*) AS n, sum(user_id) AS users_sum, "
            f"min(value) AS vmin, max(value) AS vmax FROM {duck_windows(DAY, HOUR)} GROUP BY ALL"),
        "w1d_sliding_differences": (
            f"SELECT window_start, window_end, event_type, count(*) AS n, sum(user_id) AS users_sum "
            f"FROM {duck_windows(DAY, 60)} GROUP BY ALL"),
        "w1e_sliding_distinct": (
            f"SELECT window_start, window_end, event_type, count(*) AS n, count(DISTINCT user_id) AS users "
            f"FROM {duck_windows(DAY, HOUR)} GROUP BY ALL"),
        "w2_tumbling_count": duck_count_by_type(DAY),
        "w3_gapped_count": duck_count_by_type(6 * HOUR, 12 * HOUR),
        "w4_multi_topic_fanout": _fanout_oracle(),
        "w5_empty_suppressed": (
            f"SELECT window_start, window_end, event_type, count(*) AS n FROM {duck_windows(HOUR)} "
            f"WHERE value > 480 GROUP BY ALL"),
        "w7_stream_equals_batch": _closed(duck_count_by_type(DAY, DAY // 2)),
        "w7b_stream_native_agg": _closed(duck_count_by_type(DAY, DAY // 2)),
        "w7d_out_of_order_stream": (
            f"SELECT * FROM ({duck_count_by_type(DAY, DAY // 2)}) "
            f"WHERE window_end <= (SELECT max(ts) - INTERVAL {DAY // 2} SECOND FROM events)"),
        "w8_origin_offset": duck_count_by_type(DAY, DAY, 6 * HOUR),
        "w8b_ragged": duck_count_by_type(30 * HOUR, 12 * HOUR),
        "q3_all_records": f"SELECT window_start, window_end, {EVENT_COLS} FROM {duck_windows(HOUR)}",
        "q4_top_users": duck_count_by_type(DAY),
        "q5_cross_topic_asof": (
            f"WITH d AS (SELECT window_start, window_end, user_id, count(*) AS n FROM {w_day} GROUP BY ALL), "
            f"f AS (SELECT window_end, user_id, count(*) AS n FROM {five} GROUP BY ALL), "
            f"dw AS (SELECT DISTINCT window_end FROM d), fw AS (SELECT DISTINCT window_end FROM f), "
            f"seen AS (SELECT dw.window_end, (SELECT max(fw.window_end) FROM fw "
            f"WHERE fw.window_end <= dw.window_end) AS f_end FROM dw) "
            f"SELECT d.window_start, d.window_end, d.user_id, d.n AS day_n, f.n AS recent_n "
            f"FROM d JOIN seen s ON d.window_end = s.window_end "
            f"JOIN f ON f.window_end = s.f_end AND f.user_id = d.user_id"),
        "q5c_cross_topic_theta": (
            f"WITH d AS (SELECT window_start, window_end, user_id, count(*) AS n FROM {w_day} GROUP BY ALL), "
            f"f AS (SELECT window_end, max(n) AS mx FROM (SELECT window_end, user_id, count(*) AS n FROM {five} GROUP BY ALL) "
            f"GROUP BY window_end), "
            f"seen AS (SELECT w.window_end, max(f.window_end) AS f_end FROM (SELECT DISTINCT window_end FROM d) w "
            f"JOIN f ON f.window_end <= w.window_end GROUP BY w.window_end) "
            f"SELECT d.window_start, d.window_end, d.user_id, d.n AS day_n, f.mx AS recent_max "
            f"FROM d JOIN seen s ON d.window_end = s.window_end JOIN f ON f.window_end = s.f_end WHERE d.n > f.mx"),
        "q6_ordered_result": q6,
        "p1_envelope": (
            f"SELECT 'events_channel' AS channel, 'top_users' AS topic, window_start, window_end, "
            f"CAST(floor((row_index - 1) / 2) AS BIGINT) AS part, 'event_type,n' AS columns, "
            f"count(*) AS n_rows, string_agg(CAST(to_json({{'event_type': event_type, 'n': n}}) AS VARCHAR), '|' "
            f"ORDER BY row_index) AS payloads FROM ({q6}) GROUP BY ALL"),
        "p3_subscribe": _duck_env("gapped", duck_count_by_type(6 * HOUR, 12 * HOUR), ["event_type", "n"]),
        "p4_listener": (
            f"SELECT 'tumbling' AS delivered_topic, * FROM "
            f"({_duck_env('tumbling', duck_count_by_type(DAY), ['event_type', 'n'])})"),
        "p4b_ordered_messages_once": (
            f"SELECT 'top_users' AS delivered_topic, window_start, window_end, CAST(floor((row_index - 1) / 2) AS BIGINT) AS part, "
            f"'event_type,n' AS columns, string_agg(CAST(to_json({{'event_type': event_type, 'n': n}}) AS VARCHAR), '|' "
            f"ORDER BY row_index) AS payloads FROM ({q6}) GROUP BY ALL"),
        "x1_pipeline_compose": (
            f"SELECT window_start, window_end, CAST(floor(value / 50) AS BIGINT) AS band, count(*) AS n, "
            f"min(value) AS vmin, max(value) AS vmax FROM {duck_windows(DAY, src='(SELECT * FROM events WHERE user_id BETWEEN 10 AND 60 AND value BETWEEN 20.0 AND 200.0)')} "
            f"GROUP BY ALL"),
        "x7_channel_lifecycle": _closed(_fanout_oracle()),
    }
    out["q5b_cross_topic_stream"] = _closed(out["q5_cross_topic_asof"])
    out["w1c_sliding_sql_same"] = out["w1b_sliding_pane_agg"]
    out["w7c_stream_pane_agg"] = _closed(out["w1b_sliding_pane_agg"])
    ok = "(SELECT * FROM events WHERE event_type <> 'error')"
    out["x2_log_to_channel_stream"] = (
        f"SELECT 'tweets_channel' AS channel, 'top_users' AS topic, window_start, window_end, "
        f"'name,tweets' AS columns, CAST(to_json({{'name': name, 'tweets': tweets}}) AS VARCHAR) AS payload "
        f"FROM (SELECT window_start, window_end, event_type AS name, count(*) AS tweets "
        f"FROM {duck_windows(DAY, src=ok)} GROUP BY ALL) "
        f"WHERE window_end <= (SELECT max(ts) FROM events WHERE event_type <> 'error')")
    gapped = _duck_env("gapped", duck_count_by_type(6 * HOUR, 12 * HOUR), ["event_type", "n"])
    out["p5_unsubscribe"] = (f"SELECT 'second' AS subscriber, * FROM ({gapped}) UNION ALL "
                             f"SELECT 'first', * FROM ({gapped}) WHERE window_end <= TIMESTAMP '{_MID}'")
    out["w5b_empty_windows"] = (f"SELECT window_start, window_end, count(*) AS n, min(event_id) AS first_id "
                                f"FROM {duck_windows(60)} GROUP BY ALL")
    out["x3_named_pipeline"] = out["x1_pipeline_compose"]
    out["x5_spec_table"] = _fanout_oracle()
    out["x6_validate"] = f"SELECT *, 'bad,worse' AS left_out FROM ({_fanout_oracle()})"
    out["x8_list_and_find"] = f"SELECT *, true AS listed, 1 AS queries, false AS listed_after FROM ({_closed(_fanout_oracle())})"
    out["w7e_arrival_clock_stream"] = (
        f"SELECT 'arrivals' AS channel, 'names' AS topic, window_start, window_end, 'name,n,c' AS columns, "
        f"CAST(to_json({{'name': name, 'n': n, 'c': 0}}) AS VARCHAR) AS payload FROM (SELECT window_start, window_end, event_type AS name, "
        f"count(*) AS n FROM {duck_windows(DAY, DAY // 2)} GROUP BY ALL) WHERE window_end <= (SELECT max(ts) FROM events)")
    out.update(F_ORACLE)
    out["f10c_left_join_dataframe_topic"] = F_ORACLE["f10_left_join"]
    return out
