"""As-of lookup between two lists of instants, without a single-task sort.

For every target instant ``t`` find the latest candidate ``c`` with
``c <= t`` (inclusive) or ``c < t`` (strict). Both lists are window lists
(one row per window), but a long history at a short slide still makes them
large, so the lookup is two-level:

1. inside each day bucket, a running max over the candidates in time order
   (window partitioned by bucket: at most one day of windows per group);
2. across buckets, the last candidate of all earlier buckets, from a
   per-bucket max (one row per day) with a running max.

The answer is the in-bucket value when present, else the carried value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_latest(targets: DataFrame, target_col: str, candidates: DataFrame, cand_col: str,
                out_col: str, inclusive: bool = True, bucket: str = "day") -> DataFrame:
    """``targets`` (distinct ``target_col``) + ``out_col`` = latest candidate."""
    tag_target, tag_cand = 1, (0 if inclusive else 2)
    both = (targets.select(F.col(target_col).alias("__t"), F.lit(tag_target).alias("__kind"))
            .unionByName(candidates.select(F.col(cand_col).alias("__t"), F.lit(tag_cand).alias("__kind")))
            .withColumn("__b", F.date_trunc(bucket, "__t")))
    cand_t = F.when(F.col("__kind") != tag_target, F.col("__t"))
    in_bucket = Window.partitionBy("__b").orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumn("__in", F.max(cand_t).over(in_bucket)).filter(F.col("__kind") == tag_target)
    per_bucket = both.groupBy("__b").agg(F.max(cand_t).alias("__bmax"))
    # One row per day bucket: small enough for one ordered pass.
    earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.withColumn("__carry", F.max("__bmax").over(earlier)).select("__b", "__carry")
    return (local.join(carry, "__b", "left")
            .select(F.col("__t").alias(target_col), F.coalesce("__in", "__carry").alias(out_col)))
