"""A log landed in folders: several log topics as one stream, with the time each record arrived.

The log is a table ``key, value, timestamp`` under ``<path>/topic=<name>/``, written by any job
(:func:`land`) and read by Spark's own file source, so it may lie in any store
that Spark reads and a micro-batch has as many tasks as its files have splits.
Each landing is one commit; a stream takes what has landed since its last micro-batch, bounded by
``max_files`` or ``max_bytes``, and its checkpoint holds what it has read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from ..session import list_folders

#: The log's own clock: when a record arrived.
ARRIVAL = "timestamp"


def log_schema(wall_clock: bool = False) -> StructType:
    return StructType([StructField("key", StringType()), StructField("value", BinaryType()),
                       StructField(ARRIVAL, TimestampNTZType() if wall_clock else TimestampType()), StructField("topic", StringType())])


def arrived(log: DataFrame, at: Column | str | None = None) -> DataFrame:
    """The log with an arrival time: ``at``, or the time of the (micro-)batch that takes it in."""
    col = F.current_timestamp() if at is None else F.col(at) if isinstance(at, str) else at
    return log.withColumn(ARRIVAL, col)


def land(log: DataFrame, path: str, topic: Column | str) -> None:
    """Append a log (``key, value, timestamp``) to the folders of its topics, as one commit."""
    name = F.lit(topic) if isinstance(topic, str) else topic
    log.select("key", "value", ARRIVAL, name.alias("topic")).write.mode("append").partitionBy("topic").parquet(path)


def land_stream(log: DataFrame, path: str, topic: Column | str, checkpoint: str, available_now: bool = False,
                processing_time: str | None = None) -> StreamingQuery:
    """Streaming ingest: what arrives is appended to the topics' folders, each micro-batch once."""
    name = F.lit(topic) if isinstance(topic, str) else topic
    writer = (log.select("key", "value", ARRIVAL, name.alias("topic")).writeStream.format("parquet").partitionBy("topic")
              .option("path", path).option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def topics(spark: SparkSession, path: str) -> list[str]:
    """The log topics that have landed."""
    return sorted(n.split("=", 1)[1] for n in list_folders(spark, path) if n.startswith("topic="))


def log_stream(spark: SparkSession, path: str, names: Sequence[str], starting: str = "earliest", wall_clock: bool = False,
               max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """A set of log topics as one stream ``key, value, timestamp, topic``.

    ``starting`` is ``earliest`` or an instant (``yyyy-MM-dd HH:mm:ss``): records that arrived before it are left out.
    It is part of the query, so a restart keeps it; a start at the latest offset is a start at the
    present instant. Only the named topics' folders are read.
    """
    reader = spark.readStream.schema(log_schema(wall_clock))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    log = reader.parquet(path).filter(F.col("topic").isin(*names))
    if starting != "earliest":
        log = log.filter(F.col(ARRIVAL) >= F.lit(starting).cast(log.schema[ARRIVAL].dataType))
    return log
