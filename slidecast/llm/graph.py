"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component): the smallest node reachable, for every node on a link.

    Each round hangs every node's larger (then smaller) neighbours on the
    smallest node near it. Rounds grow with the log of the longest path; links
    stay at most as many as given. A round's links are written to the shared
    work folder. Joins are by merge at every size: rounds are many and short,
    and the driver would hold a table for each. Null nodes and links of a node
    to itself are ignored; an empty table gives an empty result.
    """
    edges = materialize(
        links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star-0")
    level = 0
    while True:
        # Large star: every larger neighbour of a node goes to the smallest in the node's neighbourhood.
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        # One row for each link: (w, u) with w > u becomes (w, m). Nothing is cut off: where m < u, the link of u to m has a row too.
        large = edges.withColumnsRenamed({"u": "w", "v": "u"}).join(low.hint("merge"), "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        # Small star: a node and its smaller neighbours go to the smallest of them; the row of that one stands for the node.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        level += 1
        after = materialize(small, f"star-{level}")
        # Done when every node hangs on one root that hangs on nothing.
        ends = after.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
            after.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        open_ends = ends.agg(F.max(F.expr("below > 1 OR (below = 1 AND above = 1)"))).first()[0]
        edges = after
        if not open_ends:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
