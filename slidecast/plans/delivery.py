"""Publishing topic results and subscribing to them.

The reference pushes ``(from, topic, columns, rows)`` through an actor
cluster. Here a result is a table: the **flat envelope** has one row per
result row (``channel, topic, window_start, window_end, columns, payload``,
the payload being the row as JSON), routed by ``partitionBy(channel,
topic)``. Column names go as an array too (``column_names``: a name may hold a comma), and a result
in order keeps its ``row_index`` (null without one). Subscribing is a read (batch or stream) filtered on the partition
columns, so only that topic's files are listed. **Messages** group a
window's rows into parts of at most ``max_rows`` so no message, and no task,
ever holds an unbounded window.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType, TimestampNTZType

from ..operators.ordering import with_row_index
from ..operators.windows import WINDOW_END, WINDOW_START
from ..session import delete_folder, list_folders
from ..sources.codec import JSON_OPTIONS

ENVELOPE_COLUMNS = ("channel", "topic", WINDOW_START, WINDOW_END, "columns", "payload")
FULL_COLUMNS = (*ENVELOPE_COLUMNS, "column_names", "row_index")


def envelope(result: DataFrame, channel: str, topic: str) -> DataFrame:
    """Flat envelope of one topic's result (one row per result row)."""
    cols = [c for c in result.columns if c not in (WINDOW_START, WINDOW_END, "row_index")]
    out = result.select(
        F.lit(channel).alias("channel"), F.lit(topic).alias("topic"),
        F.col(WINDOW_START).cast("timestamp_ntz").alias(WINDOW_START),
        F.col(WINDOW_END).cast("timestamp_ntz").alias(WINDOW_END),
        F.lit(",".join(cols)).alias("columns"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]), JSON_OPTIONS).alias("payload"),
        F.array(*[F.lit(c) for c in cols]).alias("column_names"),
        (F.col("row_index") if "row_index" in result.columns else F.lit(None)).cast("long").alias("row_index"))
    return out


def envelopes(results: dict[str, DataFrame], channel: str) -> DataFrame:
    """All topics of a channel as one flat envelope table (``UNION ALL``).

    A topic whose result is no DataFrame has failed: the error names all of them.
    """
    failed = sorted(name for name, df in results.items() if not isinstance(df, DataFrame))
    if failed or not results:
        raise ValueError(f"topics without a result: {', '.join(failed) or 'no topic at all'}")
    frames = [envelope(df, channel, name) for name, df in results.items() if isinstance(df, DataFrame)]
    out = frames[0].select(*FULL_COLUMNS)
    for f in frames[1:]:
        out = out.unionByName(f.select(*FULL_COLUMNS))
    return out


def messages(env: DataFrame, max_rows: int = 1000, order_cols=("payload",), ordered: bool | None = None) -> DataFrame:
    """Window results as messages of at most ``max_rows`` rows.

    ``part`` numbers the messages of one window; ``data`` keeps row order. ``ordered`` says whether
    the envelopes carry their row index; left out, a look at one row tells.
    """
    if ordered is None:
        some = env.select("row_index").head(1) if "row_index" in env.columns else []
        ordered = bool(some) and some[0][0] is not None
    if not ordered:
        env = env.drop("row_index").withColumn("__g", F.concat_ws("|", "channel", "topic", F.col(WINDOW_END).cast("string")))
        env = with_row_index(env, "__g", list(order_cols)).drop("__g")
    part = F.floor((F.col("row_index") - 1) / F.lit(max_rows)).cast("long")
    grouped = (env.withColumn("part", part)
               .groupBy("channel", "topic", WINDOW_START, WINDOW_END, "part", "columns")
               .agg(F.count(F.lit(1)).alias("n_rows"), F.first("column_names").alias("column_names"),
                    F.sort_array(F.collect_list(F.struct("row_index", "payload"))).alias("__d")))
    return grouped.withColumn("data", F.transform("__d", lambda x: x["payload"])).drop("__d")


def publish(env: DataFrame, path: str, mode: str = "append") -> None:
    """Route envelopes by channel and topic."""
    env.write.mode(mode).partitionBy("channel", "topic").parquet(path)


ENVELOPE_SCHEMA = StructType([
    StructField(WINDOW_START, TimestampNTZType()), StructField(WINDOW_END, TimestampNTZType()),
    StructField("columns", StringType()), StructField("payload", StringType()),
    StructField("column_names", ArrayType(StringType())), StructField("row_index", LongType()),
    StructField("channel", StringType()), StructField("topic", StringType()),
])
MESSAGE_SCHEMA = StructType([
    StructField(WINDOW_START, TimestampNTZType()), StructField(WINDOW_END, TimestampNTZType()),
    StructField("part", LongType()), StructField("columns", StringType()), StructField("n_rows", LongType()),
    StructField("data", ArrayType(StringType())), StructField("column_names", ArrayType(StringType())),
    StructField("channel", StringType()), StructField("topic", StringType()),
])
_LEDGER_FOLDERS = 256
LEDGER_SCHEMA = StructType([StructField(WINDOW_END, TimestampNTZType()), StructField("part", LongType())])


def subscribe(spark: SparkSession, path: str, channel: str, topic: str) -> DataFrame:
    """One topic of one channel, read back by partition pruning."""
    return (spark.read.parquet(path)
            .filter((F.col("channel") == channel) & (F.col("topic") == topic)))


def subscribe_stream(spark: SparkSession, path: str, channel: str, topic: str,
                     listener: Callable[[str, list[str], DataFrame], None],
                     checkpoint: str, available_now: bool = False, max_bytes: int | None = None) -> StreamingQuery:
    """Stream new envelopes of a topic to ``listener(topic, columns, rows)``.

    The listener receives each micro-batch as a DataFrame (never collected);
    ``query.stop()`` on the returned handle unsubscribes this subscriber only
    (P5). ``max_bytes`` bounds a micro-batch: a slow subscriber takes more of them
    and loses nothing, its checkpoint is its place in the results.
    """
    src = (_bounded(spark.readStream.schema(ENVELOPE_SCHEMA), max_bytes).parquet(path)
           .filter((F.col("channel") == channel) & (F.col("topic") == topic)))

    def deliver(batch: DataFrame, batch_id: int) -> None:
        first = batch.select("column_names").limit(1).collect()
        if first:
            listener(topic, first[0]["column_names"], batch)

    writer = (src.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
              .queryName(f"sub.{channel}.{topic}.{uuid.uuid4().hex[:8]}"))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def _bounded(reader, max_bytes: int | None):
    return reader.option("maxBytesPerTrigger", max_bytes) if max_bytes else reader


def deliver_messages(spark: SparkSession, path: str, channel: str, topic: str,
                     listener: Callable[[str, list[str], Row], None], ledger: str, checkpoint: str,
                     available_now: bool = False, max_bytes: int | None = None, commit_every: int = 1) -> StreamingQuery:
    """One listener call per fired window, or per part of a large one, in window order.

    ``path`` holds published :func:`messages`. What has been delivered is committed to the ledger (window end, part) after
    every ``commit_every`` calls, and a message in the ledger is never delivered again, whatever is retried or
    published twice: with 1, only a call that was under way when the process died is repeated. Messages are bounded
    by their ``max_rows`` and come to the driver one partition of a micro-batch (``max_bytes``) at a time.
    """
    ledger = ledger.rstrip("/")
    src = (_bounded(spark.readStream.schema(MESSAGE_SCHEMA), max_bytes).parquet(path)
           .filter((F.col("channel") == channel) & (F.col("topic") == topic)))

    def deliver(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        attempt = uuid.uuid4().hex[:8]
        entries = list_folders(session, ledger)
        done = (session.read.schema(LEDGER_SCHEMA).option("recursiveFileLookup", "true").parquet(ledger)
                if entries else session.createDataFrame([], LEDGER_SCHEMA))
        if len(entries) > _LEDGER_FOLDERS:  # many small commits become one; entries that are there twice do no harm
            whole = f"{ledger}/all-{batch_id}-{attempt}"
            done.distinct().write.parquet(whole)
            for name in entries:
                delete_folder(session, f"{ledger}/{name}")
            done = session.read.schema(LEDGER_SCHEMA).parquet(whole)
        todo = batch.dropDuplicates([WINDOW_END, "part"]).join(done, [WINDOW_END, "part"], "left_anti").orderBy(WINDOW_END, "part")
        pending: list[tuple] = []

        def commit() -> None:
            if pending:
                session.createDataFrame(pending, LEDGER_SCHEMA).coalesce(1).write.parquet(f"{ledger}/{batch_id}-{attempt}-{uuid.uuid4().hex[:8]}")
                pending.clear()
        try:
            for message in todo.toLocalIterator():
                listener(topic, list(message.column_names), message)
                pending.append((message[WINDOW_END], message.part))
                if len(pending) >= commit_every:
                    commit()
        finally:
            commit()

    writer = (src.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
              .queryName(f"msg.{channel}.{topic}.{uuid.uuid4().hex[:8]}"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def console_listener(n: int | None = None) -> Callable[[str, list[str], DataFrame], None]:
    """The example listener: print the topic, its columns and every row (or ``n`` of them)."""
    def show(topic: str, columns: list[str], rows: DataFrame) -> None:
        print(f"[{topic}] {', '.join(columns)}")
        for row in (rows if n is None else rows.limit(n)).select("payload").toLocalIterator():
            print(row.payload)
    return show
