"""Stream sources: a file replay of a table, and the broker source.

``stage_replay`` writes a table into ``n`` files by arrival time; reading
the folder with ``maxFilesPerTrigger = 1`` replays it in ``n``
micro-batches, in arrival order. It is a harness for tests and benchmarks
(each file is one task's range, so ``n`` also bounds its write parallelism);
in production the log's landing folder, written by the producer in arrival
order, or the broker source below is the stream source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import scratch_path


def stage_replay(df: DataFrame, n_files: int, ts: str = "ts", path: str | None = None) -> str:
    """Write ``df`` as ``n_files`` files, each a contiguous range of ``ts``.

    The file source replays files oldest first, so the ranges are landed one
    after another in time order: one parallel range-partitioned write, then
    one small append per range file, in range order.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "replay")
    ranged = scratch_path(spark, "replay-ranges")
    (df.repartitionByRange(n_files, ts).sortWithinPartitions(ts)
       .write.parquet(ranged))
    # part-00000 holds the earliest range, part-00001 the next, ...
    for f in sorted(spark.read.parquet(ranged).inputFiles(), key=lambda p: p.rsplit("/", 1)[-1]):
        spark.read.schema(df.schema).parquet(f).write.mode("append").parquet(path)
    return path


def replay_stream(spark: SparkSession, path: str, schema: StructType,
                  max_files_per_trigger: int = 1, glob: str | None = None) -> DataFrame:
    """A streaming DataFrame over the parquet files of ``path``, oldest first."""
    reader = (spark.readStream.schema(schema)
              .option("maxFilesPerTrigger", max_files_per_trigger)
              .option("latestFirst", "false"))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def broker_stream(spark: SparkSession, servers: str, topics: list[str],
                  starting_offsets: str = "latest", max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Subscribe to a set of log topics as one ``key, value, timestamp, topic`` stream
    (the form of ``landed.log_stream``; windows may run by the log's ``timestamp``).

    Starts at the latest offsets, as the reference does. Needs the Kafka
    connector on the classpath (absent in the test container).
    """
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", servers)
              .option("subscribe", ",".join(topics))
              .option("startingOffsets", starting_offsets))
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    try:
        src = reader.load()
    except Exception as exc:  # connector jar absent: say so plainly
        if "kafka" in str(exc).lower() and ("not find" in str(exc).lower() or "failed to find" in str(exc).lower()):
            raise RuntimeError("the Kafka connector (spark-sql-kafka) is not on the classpath; "
                               "use replay_stream over landed files instead") from exc
        raise
    return src.selectExpr("CAST(key AS STRING) AS key", "value", "timestamp", "topic")


def broker_sink_options(servers: str, topic: str) -> dict[str, str]:
    """Options for ``write``/``writeStream.format('kafka')`` of an encoded log."""
    return {"kafka.bootstrap.servers": servers, "topic": topic}
