"""Batch channel run: every topic windows the same input with its own W/S.

The pipeline (decode, project, ...) runs once as a DataFrame; each topic is
a branch of the same plan over it (Catalyst prunes each branch's scan to
the columns that topic reads). Topics are evaluated in channel order, which
fixes what a cross-topic reference sees (``crosstopic``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.crosstopic import referenced_topics, windows_with_views
from ..operators.ordering import with_row_index
from ..operators.panes import sliding_aggregate
from ..operators.topicsql import windowed_sql
from ..operators.windows import WINDOW_END, assign_windows
from .spec import ChannelSpec, TopicSpec, resolve_pipeline


def topic_rows(records: DataFrame, topic: TopicSpec, ts: str = "ts") -> DataFrame:
    return assign_windows(records, topic.window_us / 1e6, topic.slide_us / 1e6,
                          topic.origin_us / 1e6, ts=ts)


def run_topic(records: DataFrame, topic: TopicSpec, ts: str = "ts", lane: str = "auto",
              channel: ChannelSpec | None = None, rows_by_topic: dict | None = None) -> DataFrame:
    """Result of one topic over all its windows: window columns + its columns."""
    if topic.aggregate is not None:
        keys, aggs = topic.aggregate
        out = sliding_aggregate(records, topic.window_us / 1e6, topic.slide_us / 1e6, list(keys), list(aggs),
                                topic.origin_us / 1e6, ts=ts)
        return with_row_index(out, WINDOW_END, list(topic.order_by)) if topic.order_by else out
    rows = topic_rows(records, topic, ts)
    if topic.fn is not None:
        out = topic.fn(rows)
    else:
        others = []
        if channel is not None:
            # every topic's window rows are visible by its name, whatever its form
            names = [t.name for t in channel.topics if t.name != topic.name]
            order = [t.name for t in channel.topics]
            for name in referenced_topics(topic.ql, names):
                other = next(t for t in channel.topics if t.name == name)
                orows = (rows_by_topic or {}).get(name)
                if orows is None:
                    orows = topic_rows(records, other, ts)
                others.append((name, orows, order.index(name) < order.index(topic.name)))
        if others:
            wins, refs = windows_with_views(rows, others)
            out = windowed_sql(rows, topic.name, topic.ql, lane=lane, windows=wins, others=refs)
        else:
            out = windowed_sql(rows, topic.name, topic.ql, lane=lane)
    if topic.order_by:
        out = with_row_index(out, WINDOW_END, list(topic.order_by))
    return out


def run_channel(source: DataFrame, channel: ChannelSpec, ts: str = "ts",
                lane: str = "auto") -> dict[str, DataFrame]:
    """All topics of a channel over a bounded source; ``{topic: result}``.

    A failing topic (SQL that does not analyse) is reported in the result map
    as the exception; the other topics still run.
    """
    channel.validate()
    records = resolve_pipeline(channel.pipeline)(source)
    rows_by_topic = {t.name: topic_rows(records, t, ts) for t in channel.topics}
    results: dict[str, DataFrame] = {}
    for topic in channel.topics:
        try:
            results[topic.name] = run_topic(records, topic, ts, lane, channel, rows_by_topic)
        except Exception as exc:  # isolate the failing topic (quirk: reference stops)
            results[topic.name] = exc
    return results
