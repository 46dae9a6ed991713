"""Streaming lanes: a topic over an unbounded source.

* **native aggregate lane** (``native_agg_stream``): a topic that is a
  grouped aggregate runs as Spark's own windowed streaming aggregation with
  a watermark, in append mode: the state holds one partial aggregate per
  (window, key), and a window is emitted once, when the watermark passes
  its end.
* **SQL lane** (``SqlTopicStream``): any topic SQL. Each micro-batch
  (``foreachBatch``) appends its rows to a *pane store* (parquet in the
  shared work folder, partitioned by batch and by slide pane) and records
  its max event time; the windows that closed in this batch (end in
  ``(previous watermark, new watermark]``) are read back by pane pruning and
  evaluated with the batch per-window plan. Window rows live in files, not
  in executor state, so open windows can be any size. Every write is keyed
  by the batch id and overwritten on retry, so a replayed batch after a
  failure or restart gives the same output once.

Arrival time is the event's ``ts`` (TIMESTAMP_NTZ); the watermark needs a
TIMESTAMP, so the native lane casts it. Every lane takes a delay: windows
close that much event time after their end, so rows may come out of order by
as much. The SQL lane keys panes and bounds by whole microseconds, not by
text, so it does not depend on the session's time zone.
"""

from __future__ import annotations

import datetime as _dt
import logging
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.durations import interval_text
from ..operators.crosstopic import referenced_topics, windows_with_views
from ..operators.ordering import with_row_index
from ..operators.topicsql import choose_lane, windowed_sql
from ..operators.windows import WINDOW_END, WINDOW_START, assign_windows, window_struct
from ..plans.spec import TopicSpec
from ..session import delete_folder, list_folders, scratch_path, stream_session
from ..sources.replay import replay_stream, stage_replay

_EPOCH = _dt.datetime(1970, 1, 1)
_MAX_GLOB_PANES = 2000
_KEEP_PROGRESS = 1000


def _micros(text: str) -> int:
    """Fixed-width timestamp text (wall clock) → microseconds from the epoch."""
    t = _dt.datetime.strptime(text, "%Y-%m-%d %H:%M:%S.%f")
    return (t - _EPOCH) // _dt.timedelta(microseconds=1)


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def _text(micros: int) -> str:
    t = _EPOCH + _dt.timedelta(microseconds=micros)
    return t.strftime("%Y-%m-%d %H:%M:%S.%f")


log = logging.getLogger("slidecast.streaming")


def native_agg_stream(sdf: DataFrame, window, slide, keys: Sequence[str], aggs: Sequence[Column],
                      ts: str = "ts", delay: str = "0 seconds", origin=0) -> DataFrame:
    """Windowed streaming aggregate, append mode (W7 native lane)."""
    from ..operators.windows import window_params
    w, s, o = window_params(window, slide, origin)
    et = "__event_time"
    # The watermark needs a TIMESTAMP; map the wall-clock NTZ value to the
    # instant with the same UTC reading, so windows align as in batch
    # whatever the session time zone is.
    tz = sdf.sparkSession.conf.get("spark.sql.session.timeZone")
    ts_type = sdf.schema[ts].dataType.simpleString()
    event_time = (F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz) if ts_type == "timestamp_ntz"
                  else F.col(ts))
    src = sdf.withColumn(et, event_time).withWatermark(et, delay)
    wcol = window_struct(et, interval_text(w), interval_text(s), interval_text(o))
    if s > w:
        src = src.withColumn("__w", wcol).filter(
            F.col(et) >= F.col("__w.end") - F.expr(f"INTERVAL {w} MICROSECONDS"))
        grouped = src.groupBy("__w", *keys)
    else:
        grouped = src.groupBy(wcol.alias("__w"), *keys)
    out = grouped.agg(*aggs)
    start = (F.col("__w.end") - F.expr(f"INTERVAL {w} MICROSECONDS")) if s > w else F.col("__w.start")
    def back(c):
        return F.to_utc_timestamp(c, tz).cast("timestamp_ntz") if ts_type == "timestamp_ntz" else c
    return out.select(back(start).alias(WINDOW_START), back(F.col("__w.end")).alias(WINDOW_END),
                      *[c for c in out.columns if c != "__w"])


def native_pane_stream(sdf: DataFrame, window, slide, keys: Sequence[str],
                       aggs: Sequence[tuple[str, str, str]], origin=0, ts: str = "ts",
                       delay: str = "0 seconds") -> DataFrame:
    """Aggregate-form topic on a stream, over panes (chained streaming aggregation).

    First level: one partial aggregate per (pane of gcd(W, S), key); second
    level: the panes' partials combined per window, keyed by the pane's event
    time (``window_time``). Append mode emits each window once, when the
    watermark passes its end; no event is ever copied per window.
    """
    import math

    from ..operators.panes import _COMBINE, _PARTIAL
    from ..operators.windows import window_params
    w, s, o = window_params(window, slide, origin)
    pane = math.gcd(w, s)
    et = "__event_time"
    tz = sdf.sparkSession.conf.get("spark.sql.session.timeZone")
    ntz = sdf.schema[ts].dataType.simpleString() == "timestamp_ntz"
    src = sdf.withColumn(et, F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz) if ntz else F.col(ts))
    partial = (src.withWatermark(et, delay)
               .groupBy(window_struct(et, interval_text(pane), interval_text(pane), interval_text(o)).alias("__pane"),
                        *keys)
               .agg(*[_PARTIAL[f](F.lit(1) if c == "*" else F.col(c)).alias(f"__p{i}")
                      for i, (_, f, c) in enumerate(aggs)]))
    pane_time = F.window_time("__pane")
    wcol = window_struct(pane_time, interval_text(w), interval_text(s), interval_text(o))
    if s > w:
        partial = partial.withColumn("__w", wcol).filter(
            pane_time >= F.col("__w.end") - F.expr(f"INTERVAL {w} MICROSECONDS"))
        grouped = partial.groupBy("__w", *keys)
    else:
        grouped = partial.groupBy(wcol.alias("__w"), *keys)
    out = grouped.agg(*[_COMBINE[f](f"__p{i}").alias(name) for i, (name, f, _) in enumerate(aggs)])
    start = (F.col("__w.end") - F.expr(f"INTERVAL {w} MICROSECONDS")) if s > w else F.col("__w.start")

    def back(c):
        return F.to_utc_timestamp(c, tz).cast("timestamp_ntz") if ntz else c
    return out.select(back(start).alias(WINDOW_START), back(F.col("__w.end")).alias(WINDOW_END),
                      *keys, *[name for name, _, _ in aggs])


def start_native_topic(sdf: DataFrame, topic: TopicSpec, sink: str, checkpoint: str, ts: str = "ts",
                       available_now: bool = False, query_name: str | None = None, to_output=None,
                       processing_time: str | None = None, delay_us: int = 0):
    """An aggregate-form topic as a native pane stream; each batch's closed
    windows are written to ``sink/batch_id=<n>`` (overwritten on retry)."""
    keys, aggs = topic.aggregate
    agg = native_pane_stream(sdf, topic.window_us / 1e6, topic.slide_us / 1e6, list(keys), list(aggs),
                             topic.origin_us / 1e6, ts, delay=interval_text(delay_us))
    out = to_output or (lambda df: df)

    def write(batch: DataFrame, batch_id: int) -> None:
        out(batch).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")
    writer = (agg.writeStream.outputMode("append").foreachBatch(write)
              .option("checkpointLocation", checkpoint).queryName(query_name or topic.name))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def stream_pane_agg_replay(spark: SparkSession, df: DataFrame, topic: TopicSpec, n_files: int = 4) -> DataFrame:
    """An aggregate-form topic over a replayed stream (native pane lane)."""
    src = stage_replay(df, n_files)
    sink, ck = scratch_path(spark, "pane-sink"), scratch_path(spark, "pane-ckpt")
    start_native_topic(replay_stream(stream_session(spark), src, df.schema), topic, sink, ck,
                       available_now=True).awaitTermination()
    return read_sink(spark, sink)


def window_aggregate(rows: DataFrame, keys, aggs) -> DataFrame:
    """An aggregate-form topic over already windowed rows (closing windows only)."""
    fns = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max,
           "count_distinct": F.count_distinct, "approx_distinct": F.approx_count_distinct}
    cols = [fns[f](F.lit(1) if c == "*" else F.col(c)).alias(o) for o, f, c in aggs]
    return rows.groupBy(WINDOW_START, WINDOW_END, *keys).agg(*cols)


class TopicGroupStream:
    """``foreachBatch`` handler that evaluates SQL topics on their closed windows.

    One handler serves the SQL topics of a channel: one read of the source and
    one pane store for all of them, and cross-topic SQL sees the other
    topic's latest window at each firing time. Rows are stored once per batch; a
    topic that others read keeps a window index (one row per window that has
    fired) for the as-of lookup.

    Retention: before a batch is stored, panes that neither this batch nor any later one can
    read are deleted: those that end before the watermark of the batches already committed
    less the longest window (or, of a topic that others read, before its latest
    fired window). A retry of the batch starts from the same watermark, so it finds all it
    needs. Rows that come too late for every window are counted, not stored.

    A topic whose SQL fails on the data (SQLSTATE class 22 or 42) is noted in
    ``failures`` and left out from then on; the others go on.
    """

    def __init__(self, topics: Sequence[TopicSpec], sink_for: Callable[[str], str], state: str,
                 ts: str = "ts", delay_us: int = 0,
                 to_output: Callable[[str, DataFrame], DataFrame] | None = None):
        self.topics = list(topics)
        self.sink_for = sink_for
        self.state = state.rstrip("/")
        self.ts = ts
        self.delay_us = delay_us
        self.to_output = to_output or (lambda name, df: df)
        self._lanes: dict[str, str] = {}  # chosen once, on the first batch
        self._failed: set[str] = set()
        self._last = None  # (batch id, watermark text) of the last batch handled here
        # A pane is the smallest multiple of a slide that covers a window, so a
        # closing window reads one or two pane folders.
        self.pane_us = min(t.slide_us * -(-t.window_us // t.slide_us) for t in self.topics)
        self.origin_us = self.topics[0].origin_us

    def _instant(self, col: Column) -> Column:
        """A time as microseconds: of the instant, or of the wall clock for a TIMESTAMP_NTZ."""
        if self._schema[self.ts].dataType.simpleString() == "timestamp_ntz":
            return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col)
        return F.unix_micros(col)

    def _at(self, micros: int) -> Column:
        """The literal time of some microseconds, in the type of the event time."""
        if self._schema[self.ts].dataType.simpleString() == "timestamp_ntz":
            return F.lit(_text(micros)).cast("timestamp_ntz")
        return F.timestamp_micros(F.lit(micros))

    def _pane_key(self, col: Column) -> Column:
        since, pane = self._instant(col) - F.lit(self.origin_us), F.lit(self.pane_us)
        # Whole panes since the origin, exact in longs and rounded down before it too.
        number = ((since - F.pmod(since, pane)) / pane).cast("long")
        return F.concat(F.lit("p"), number.cast("string"))

    def _rows_between(self, spark, lo_us: int | None, hi_us: int) -> DataFrame:
        """Stored rows with ``lo <= ts < hi``; reads only the pane folders of that range.

        The store is laid out ``rows/__pane=<p>/batch=<n>``, so the read lists
        the needed panes only, not the whole history.
        """
        rows_dir = f"{self.state}/rows"
        path = f"{rows_dir}/__pane=*"
        if lo_us is not None:
            first = (lo_us - self.origin_us) // self.pane_us
            last = (hi_us - 1 - self.origin_us) // self.pane_us
            if last - first < _MAX_GLOB_PANES:
                keys = [f"p{k}" for k in range(first, last + 1)]
                path = f"{rows_dir}/__pane={{{','.join(keys)}}}"
        try:
            stored = spark.read.schema(self._stored_schema).option("basePath", rows_dir).parquet(path)
        except AnalysisException as e:
            if not _missing(e) or lo_us is None:
                raise
            if not list_folders(spark, self.state):  # the store itself must be there
                raise
            return spark.createDataFrame([], self._schema)  # no pane of that range holds rows
        cond = F.col(self.ts) < self._at(hi_us)
        if lo_us is not None:
            cond = cond & (F.col(self.ts) >= self._at(lo_us))
        return stored.filter(cond).drop("__pane", "batch")

    def _windows(self, spark, t: TopicSpec, prev_us, new_us) -> DataFrame:
        """Windowed rows of ``t`` whose window closes in ``(prev, new]``."""
        cand = self._rows_between(spark, None if prev_us is None else prev_us - t.window_us, new_us)
        rows = assign_windows(cand, t.window_us / 1e6, t.slide_us / 1e6, t.origin_us / 1e6, ts=self.ts)
        closing = F.col(WINDOW_END) <= self._at(new_us)
        if prev_us is not None:
            closing = closing & (F.col(WINDOW_END) > self._at(prev_us))
        return rows.filter(closing)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        t0 = time.perf_counter()
        spark = batch.sparkSession
        self._schema = batch.schema
        self._stored_schema = StructType(list(batch.schema.fields) + [
            StructField("__pane", StringType()), StructField("batch", LongType())])
        rows_dir, prog_dir, index_dir = (f"{self.state}/{k}" for k in ("rows", "progress", "windows"))
        # 1. watermark before this batch (kept in memory; read from the progress
        #    log after a start or restart)
        if self._last is not None and self._last[0] == batch_id - 1:
            prev = self._last[1]
        else:
            try:
                prev = (spark.read.parquet(prog_dir).filter(F.col("batch") < batch_id)
                        .agg(F.max("max_ts")).collect()[0][0])
            except AnalysisException as e:
                if not _missing(e) or batch_id > 0:
                    raise
                prev = None  # the first batch
        keep_from = None if prev is None else self._expire(spark, batch_id, _micros(prev) - self.delay_us)
        # 2. store this batch's rows by pane; dynamic overwrite replaces only this
        #    batch's folders, so a retried batch writes the same files once. The
        #    batch's max event time, and how many windows that had fired before a
        #    row of theirs arrived (late, one for each row and topic; the row still
        #    counts in its open windows), are observed in the same pass.
        late = [F.lit(0)]
        if prev is not None:
            fired = _micros(prev) - self.delay_us
            for t in self.topics:  # the first window of a row to fire ends with the row's slide
                since = self._instant(F.col(self.ts)) - F.lit(t.origin_us)
                end = since - F.pmod(since, F.lit(t.slide_us)) + F.lit(t.slide_us)
                late.append(F.when((end <= F.lit(fired - t.origin_us)) & (end - F.lit(t.window_us) <= since), 1).otherwise(0))
        stats = Observation(f"batch_{uuid.uuid4().hex[:8]}")
        (batch.observe(stats, F.max(self._instant(F.col(self.ts))).alias("m"),
                       F.sum(sum(late[1:], late[0])).alias("late"))
              .filter(F.lit(True) if keep_from is None else F.col(self.ts) >= self._at(keep_from))
              .withColumn("__pane", self._pane_key(F.col(self.ts)))
              .withColumn("batch", F.lit(batch_id).cast("long"))
              .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
              .partitionBy("__pane", "batch").parquet(rows_dir))
        batch_max, n_late = stats.get.get("m"), stats.get.get("late") or 0
        batch_max = None if batch_max is None else _text(batch_max)
        # 3. progress log; watermark = max event time over batches so far.
        #    Times travel as fixed-width text, so text order is time order. The
        #    last entry says all, so old ones go.
        new = max((m for m in (prev, batch_max) if m is not None), default=None)
        (spark.createDataFrame([(batch_id, new, n_late)], "batch BIGINT, max_ts STRING, late BIGINT")
              .write.mode("overwrite").parquet(f"{prog_dir}/b={batch_id}"))
        if batch_id >= _KEEP_PROGRESS:
            delete_folder(spark, f"{prog_dir}/b={batch_id - _KEEP_PROGRESS}")
        self._last = (batch_id, new)
        if n_late:
            log.warning("batch %d: %d rows arrived after a window of theirs had fired", batch_id, n_late)
        log.debug("batch %d: rows stored, watermark %s -> %s at %.2fs", batch_id, prev, new,
                  time.perf_counter() - t0)
        if new is None:
            return
        new_us = _micros(new) - self.delay_us
        prev_us = None if prev is None else _micros(prev) - self.delay_us
        closing = {t.name: self._windows(spark, t, prev_us, new_us) for t in self.topics}
        names, refs = [t.name for t in self.topics], self._references()
        # 4. window index of every topic that others read (all topics' windows
        #    closing now are indexed first: a later topic fired at its own,
        #    earlier times)
        read_by_others = {n for r in refs.values() for n in r}
        for name in read_by_others:
            (closing[name].select(WINDOW_END).distinct()
                .write.mode("overwrite").parquet(f"{index_dir}/topic={name}/batch={batch_id}"))
        # 5. evaluate every topic on its closing windows
        for t in self.topics:
            if t.name in self._failed:
                continue
            try:
                self._evaluate(spark, t, closing[t.name], batch_id, prev_us, new_us, names, refs[t.name])
            except PySparkException as e:
                if len(self.topics) == 1 or (e.getSqlState() or "")[:2] not in ("22", "42"):
                    raise  # nothing else to go on with, or no fault of the topic's
                self._failed.add(t.name)
                log.error("batch %d: topic %s failed and is left out: %s", batch_id, t.name, e)
                (spark.createDataFrame([(batch_id, t.name, str(e)[:2000])], "batch BIGINT, topic STRING, error STRING")
                      .write.mode("overwrite").parquet(f"{self.state}/failures/{t.name}"))
            log.debug("batch %d: topic %s done at %.2fs", batch_id, t.name, time.perf_counter() - t0)

    def _references(self) -> dict[str, list[str]]:
        names = [t.name for t in self.topics]
        return {t.name: (referenced_topics(t.ql, [n for n in names if n != t.name]) if t.ql else []) for t in self.topics}

    def _expire(self, spark, batch_id: int, fired_us: int) -> int:
        """Delete the panes that nothing can read any more; the first instant still needed.

        ``fired_us`` is the watermark up to which windows have fired in committed batches.
        """
        need = min(fired_us - t.window_us for t in self.topics)
        for name in {n for r in self._references().values() for n in r}:
            other = next(t for t in self.topics if t.name == name)
            try:
                ends = spark.read.parquet(f"{self.state}/windows/topic={name}").filter(F.col("batch") < batch_id)
            except AnalysisException as e:
                if not _missing(e):
                    raise
                continue  # none of its windows has fired
            e = self._instant(F.col(WINDOW_END))
            last = ends.agg(F.max(F.when(e <= fired_us, e))).first()[0]
            if last is not None:
                need = min(need, last - other.window_us)
        first = (need - self.origin_us) // self.pane_us
        for name in list_folders(spark, f"{self.state}/rows"):
            if name.startswith("__pane=p") and int(name[8:]) < first:
                delete_folder(spark, f"{self.state}/rows/{name}")
        return first * self.pane_us + self.origin_us

    def _evaluate(self, spark, t: TopicSpec, rows: DataFrame, batch_id: int, prev_us, new_us, names, refs) -> None:
        if t.aggregate is not None:
            result = window_aggregate(rows, *t.aggregate)
        elif t.fn is not None:
            result = t.fn(rows)
        else:
            if t.name not in self._lanes:
                schema = rows.drop(WINDOW_START, WINDOW_END).schema
                self._lanes[t.name] = choose_lane(spark, t.name, t.ql, schema, {n: schema for n in refs})
            wins, orefs = None, ()
            if refs:
                others = []
                for n in refs:
                    other = next(o for o in self.topics if o.name == n)
                    seen = (spark.read.parquet(f"{self.state}/windows/topic={n}")
                            .filter(F.col("batch") <= batch_id).select(WINDOW_END))
                    others.append((n, self._seen_rows(spark, other, seen, prev_us, new_us), names.index(n) < names.index(t.name)))
                wins, orefs = windows_with_views(rows, others)
            result = windowed_sql(rows, t.name, t.ql, lane=self._lanes[t.name], windows=wins, others=orefs, check=False)
        if t.order_by:
            result = with_row_index(result, WINDOW_END, list(t.order_by))
        (self.to_output(t.name, result).write.mode("overwrite")
             .parquet(f"{self.sink_for(t.name).rstrip('/')}/batch_id={batch_id}"))

    def _seen_rows(self, spark, other: TopicSpec, other_ends: DataFrame, prev_us, new_us) -> DataFrame:
        """Rows of ``other``'s windows that the reader's closing windows can see.

        Closing windows end in ``(prev, new]``, so the windows they can see
        run from the latest fired window ending at or before ``prev`` (or the
        first one) to the latest ending at or before ``new``; one small
        aggregate over the window index finds that range, and the store read
        is limited to it.
        """
        e = self._instant(F.col(WINDOW_END))
        lo_first = F.max(F.when(e <= prev_us, e)) if prev_us is not None else F.lit(None)
        bounds = other_ends.agg(
            F.coalesce(lo_first, F.min(e)).alias("lo"), F.max(F.when(e <= new_us, e)).alias("hi")).collect()[0]
        if bounds["lo"] is None or bounds["hi"] is None:
            cand = spark.createDataFrame([], self._schema)
        else:
            cand = self._rows_between(spark, bounds["lo"] - other.window_us, bounds["hi"])
        orows = assign_windows(cand, other.window_us / 1e6, other.slide_us / 1e6, other.origin_us / 1e6,
                               ts=self.ts)
        return orows.join(other_ends.distinct(), WINDOW_END, "left_semi")


class SqlTopicStream(TopicGroupStream):
    """Single-topic handler: results go to ``sink/batch_id=<n>``."""

    def __init__(self, topic: TopicSpec, sink: str, state: str, ts: str = "ts",
                 delay_us: int = 0, to_output: Callable[[DataFrame], DataFrame] | None = None):
        out = to_output or (lambda df: df)
        super().__init__([topic], lambda name: sink, state, ts, delay_us, lambda name, df: out(df))


def start_sql_topic(sdf: DataFrame, topic: TopicSpec, sink: str, state: str, checkpoint: str,
                    ts: str = "ts", available_now: bool = False, query_name: str | None = None,
                    to_output=None, processing_time: str | None = None, delay_us: int = 0):
    """``delay_us``: how long a window waits, in event time, for rows that come out of order."""
    handler = SqlTopicStream(topic, sink, state, ts, delay_us, to_output=to_output)
    writer = (sdf.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
              .queryName(query_name or topic.name))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def start_topic_group(sdf: DataFrame, topics: Sequence[TopicSpec], sink_for: Callable[[str], str],
                      state: str, checkpoint: str, query_name: str, ts: str = "ts",
                      available_now: bool = False, to_output=None, processing_time: str | None = None,
                      delay_us: int = 0):
    """One streaming query for topics that read each other's tables."""
    handler = TopicGroupStream(topics, sink_for, state, ts, delay_us, to_output=to_output)
    writer = (sdf.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
              .queryName(query_name))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def read_sink(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink).drop("batch_id")


# ------------------------------------------------------------- replay runs (tests, queries)


def run_passthrough_replay(spark: SparkSession, df: DataFrame, n_files: int = 4) -> DataFrame:
    """S1r: replay a table as a stream of ``n_files`` micro-batches into a file sink."""
    src = stage_replay(df, n_files)
    out, ck = scratch_path(spark, "replay-sink"), scratch_path(spark, "replay-ckpt")
    q = (replay_stream(stream_session(spark), src, df.schema).writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def stream_sql_topic_replay(spark: SparkSession, df: DataFrame, topic: TopicSpec,
                            n_files: int = 4, delay_us: int = 0, arrival: str = "ts") -> DataFrame:
    """A SQL topic over a stream replayed in order of ``arrival``; closed windows only."""
    src = stage_replay(df, n_files, arrival)
    sink, state, ck = (scratch_path(spark, k) for k in ("topic-sink", "topic-state", "topic-ckpt"))
    q = start_sql_topic(replay_stream(stream_session(spark), src, df.schema), topic, sink, state, ck,
                        available_now=True, delay_us=delay_us)
    q.awaitTermination()
    return read_sink(spark, sink)


def stream_native_agg_replay(spark: SparkSession, df: DataFrame, window, slide, keys, aggs,
                             n_files: int = 4, progress: list | None = None) -> DataFrame:
    """W7 native lane over a replayed stream; append mode emits closed windows."""
    src = stage_replay(df, n_files)
    out, ck = scratch_path(spark, "agg-sink"), scratch_path(spark, "agg-ckpt")
    agg = native_agg_stream(replay_stream(stream_session(spark), src, df.schema), window, slide, keys, aggs)
    q = (agg.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    if progress is not None:
        progress.extend(q.recentProgress)
    return spark.read.parquet(out)
