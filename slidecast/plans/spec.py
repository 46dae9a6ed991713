"""Topic and channel specifications (structured, no delimited text).

A topic is ``(name, ql, window, slide, channel)``: SQL run separately over
every window of the channel's input, where the window's rows are visible as
a table named after the topic. A topic may instead carry a DataFrame
function (``fn``) that receives the windowed rows with ``window_start`` and
``window_end`` columns and groups by them itself; that form is fully
parallel for any shape, including outer and semi joins.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..functions.durations import instant_micros, to_micros

_IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


class SpecError(ValueError):
    """A topic or channel specification that cannot run."""


@dataclass(frozen=True)
class TopicSpec:
    name: str
    ql: str | None = None
    window: object = 60
    slide: object = None
    channel: str = "default"
    fn: Callable[[DataFrame], DataFrame] | None = None
    origin: object = 0
    order_by: tuple[str, ...] = ()
    # Aggregate form: (keys, ((out, func, column), ...)) evaluated over panes.
    aggregate: tuple | None = None

    @property
    def window_us(self) -> int:
        return to_micros(self.window)

    @property
    def slide_us(self) -> int:
        return to_micros(self.slide) if self.slide is not None else self.window_us

    @property
    def origin_us(self) -> int:
        return instant_micros(self.origin)

    def validate(self, spark: SparkSession | None = None,
                 schema: StructType | None = None) -> TopicSpec:
        if not self.name or not _IDENT.match(self.name):
            raise SpecError(f"topic name {self.name!r} is not an identifier")
        if not self.channel:
            raise SpecError(f"topic {self.name!r} has no channel")
        if sum(x is not None for x in (self.ql, self.fn, self.aggregate)) != 1:
            raise SpecError(f"topic {self.name!r} needs exactly one of ql, fn or aggregate")
        if self.window_us <= 0 or self.slide_us <= 0:
            raise SpecError(f"topic {self.name!r}: window and slide must be positive")
        if self.aggregate is not None:
            keys, aggs = self.aggregate
            known = ("count", "sum", "min", "max", "count_distinct", "approx_distinct")
            bad = [f for _, f, _ in aggs if f not in known]
            if bad or not aggs:
                raise SpecError(f"topic {self.name!r}: aggregate form takes {'/'.join(known)}, not {bad}")
        if spark is not None and schema is not None and self.ql is not None:
            from ..operators.topicsql import analyse_topic_sql
            try:
                analyse_topic_sql(spark, self.name, self.ql, schema)
            except Exception as exc:  # AnalysisException and parse errors
                raise SpecError(f"topic {self.name!r}: SQL does not analyse: {exc}") from exc
        return self


@dataclass
class ChannelSpec:
    name: str
    topics: Sequence[TopicSpec] = field(default_factory=list)
    pipeline: Callable[[DataFrame], DataFrame] | str | None = None
    batch_interval: object = 5
    delay: object = 0  # event time that windows of a stream wait for rows out of order

    def validate(self, spark: SparkSession | None = None,
                 schema: StructType | None = None) -> ChannelSpec:
        if not self.name:
            raise SpecError("channel has no name")
        if not self.topics:
            raise SpecError(f"channel {self.name!r} has no topic")
        seen = set()
        for t in self.topics:
            if t.channel != self.name:
                raise SpecError(f"topic {t.name!r} belongs to channel {t.channel!r}, not {self.name!r}")
            if t.name in seen:
                raise SpecError(f"channel {self.name!r} has topic {t.name!r} twice")
            seen.add(t.name)
            t.validate(spark, schema)
        return self

    def failing(self, spark: SparkSession, schema: StructType, ts: str = "ts") -> dict[str, Exception]:
        """Topics that cannot run over records of this schema, with their errors.

        SQL is analysed with every topic of the channel visible by its name, a DataFrame form is
        applied to an empty table; nothing is read.
        """
        from ..operators.topicsql import analyse_topic_sql
        from ..operators.windows import assign_windows
        empty = spark.createDataFrame([], schema)
        out: dict[str, Exception] = {}
        for t in self.topics:
            try:
                if t.ql is not None:
                    analyse_topic_sql(spark, t.name, t.ql, schema, {o.name: schema for o in self.topics if o is not t})
                elif t.fn is not None:
                    t.fn(assign_windows(empty, t.window_us / 1e6, t.slide_us / 1e6, t.origin_us / 1e6, ts=ts))
                else:
                    empty.select(*t.aggregate[0], *[c for _, _, c in t.aggregate[1] if c != "*"])
            except Exception as exc:
                out[t.name] = exc
        return out

    def to_table(self, spark: SparkSession) -> DataFrame:
        """The channel as a spec table that :meth:`from_table` reads back (X5); DataFrame-form topics have no text."""
        code = [t.name for t in self.topics if t.fn is not None]
        if code:
            raise SpecError(f"channel {self.name!r}: DataFrame-form topics {code} cannot be written to a table")
        rows = [(self.name, t.name, t.ql, t.window_us / 1e6, t.slide_us / 1e6, i, t.origin_us / 1e6, list(t.order_by),
                 t.aggregate and (list(t.aggregate[0]), [tuple(a) for a in t.aggregate[1]])) for i, t in enumerate(self.topics)]
        return spark.createDataFrame(rows, (
            "channel string, name string, ql string, `window` double, slide double, position int, origin double, order_by array<string>, "
            "aggregate struct<keys: array<string>, aggs: array<struct<out: string, func: string, column: string>>>"))

    @staticmethod
    def from_table(spec_df: DataFrame, channel: str,
                   pipeline: Callable[[DataFrame], DataFrame] | str | None = None) -> ChannelSpec:
        """Read a spec table ``(channel, name, ql, window, slide[, position, origin, order_by, aggregate])``.

        The table is configuration (a handful of rows per channel); topic order
        is ``position`` when present, else the name.
        """
        cols = set(spec_df.columns)
        order = "position" if "position" in cols else "name"
        optional = [c for c in ("origin", "order_by", "aggregate") if c in cols]
        rows = (spec_df.filter(spec_df["channel"] == channel)
                .orderBy(order).select("channel", "name", "ql", "window", "slide", *optional).collect())
        topics = []
        for r in rows:
            extra = {c: r[c] for c in optional if r[c] is not None}
            if "order_by" in extra:
                extra["order_by"] = tuple(extra["order_by"])
            if "aggregate" in extra:
                extra["aggregate"] = (tuple(extra["aggregate"]["keys"]), tuple(tuple(a) for a in extra["aggregate"]["aggs"]))
            topics.append(TopicSpec(name=r["name"], ql=r["ql"], window=r["window"], slide=r["slide"], channel=r["channel"], **extra))
        return ChannelSpec(channel, topics, pipeline)


# Named pipelines: a channel may pick its pipeline by name.
_PIPELINES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_pipeline(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    if not callable(fn):
        raise SpecError(f"pipeline {name!r} is not callable")
    _PIPELINES[name] = fn


def resolve_pipeline(pipeline) -> Callable[[DataFrame], DataFrame]:
    if pipeline is None:
        return lambda df: df
    if isinstance(pipeline, str):
        if pipeline not in _PIPELINES:
            raise SpecError(f"no pipeline named {pipeline!r}")
        return _PIPELINES[pipeline]
    if not callable(pipeline):
        raise SpecError(f"pipeline {pipeline!r} is not callable")
    return pipeline


def compose(*stages: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """``compose(a, b)(df) == df.transform(a).transform(b)``."""
    def run(df: DataFrame) -> DataFrame:
        for stage in stages:
            df = df.transform(stage)
        return df
    return run
