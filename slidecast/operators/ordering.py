"""Row order inside each window's result (Q6), without one task per window.

A result that must keep the SQL's order gets ``row_index`` (1, 2, ... per
window, by the given keys). A plain ``row_number() OVER (PARTITION BY
window_end ...)`` would put a whole window into one task; instead the rows
are range-partitioned on ``(window_end, keys)`` so a hot window spreads
over many tasks, each task numbers its rows in sorted order, and a small
table of per-(window, task) counts turns local positions into window-wide
indexes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_dir


def with_row_index(df: DataFrame, group_col: str, order_cols: Sequence, index_col: str = "row_index",
                   num_partitions: int | None = None) -> DataFrame:
    """Add a 1-based index within ``group_col`` in ``order_cols`` order.

    ``order_cols`` should make the order total (add tiebreak columns), or
    ties are numbered in an unspecified order.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group_col)] + [F.col(c) if isinstance(c, str) else c for c in order_cols]
    tagged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("__pid", F.spark_partition_id())
              .withColumn("__pos", F.monotonically_increasing_id()))
    # Pin the partitioning and positions once (reliable checkpoint in the
    # shared folder); both branches below read them.
    work_dir(spark)
    tagged = tagged.checkpoint(eager=True)
    counts = tagged.groupBy(group_col, "__pid").agg(F.min("__pos").alias("__first"),
                                                     F.count(F.lit(1)).alias("__cnt"))
    before = Window.partitionBy(group_col).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__cnt").over(before), F.lit(0)))
    return (tagged.join(offsets.select(group_col, "__pid", "__first", "__before"), [group_col, "__pid"])
            .withColumn(index_col, F.col("__pos") - F.col("__first") + F.col("__before") + 1)
            .drop("__pid", "__pos", "__first", "__before"))
