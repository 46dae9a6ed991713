"""Reading the input tables.

Only the columns a plan names are read (Catalyst prunes the parquet scan);
filters on them are pushed into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table_path

EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream table (arrival time ``ts`` is TIMESTAMP_NTZ)."""
    return read_table(spark, sf_dir, "events")
