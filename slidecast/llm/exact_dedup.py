"""Exact deduplication by distributed MSD radix partitioning.

Documents are split recursively by successive digits of their normalised
text (A-Z lower-cased, UTF-8). A digit is a run of consecutive bytes; digit
widths grow by a constant factor, so a text of L bytes takes O(log L) rounds.
A round keys the open groups by (group, digit), counts each with a partial
aggregate and splits them: a group of one leaves, a group whose texts have
ended leaves as a class of equal texts, the rest goes on to the next digit
with only the text that is left. Digits are compared byte by byte by the
grouping itself; no digest decides equality.

Rounds are joined on (group, digit) with adaptive skew splitting, so a hot
group of copies is spread over tasks, and its count is a partial aggregate.
Each round's open rows are written to the shared work folder.

Edge cases: a null text counts as empty; empty texts are one class; rows with
equal text and equal doc_id are the same document repeated, all of them are
in the class (``group_size`` counts rows) and all rows with the largest
doc_id are ``kept``; a null doc_id never wins over a number, and a class of
null ids has a null ``keep_id`` and is kept; an empty table gives an empty
result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

FIRST_DIGIT = 64
GROWTH = 16


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = pc.ascii_lower(pc.fill_null(batch.column(1), "")).cast(pa.binary())
        digest = pa.array([hashlib.sha256(x).hexdigest() for x in raw.to_pylist()], type=pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), raw, digest], names=["doc_id", "rest", "text_sha256"])


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = pc.ascii_lower(pc.fill_null(batch.column(1), "")).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), raw], names=["doc_id", "head"])


def _classes(rows: DataFrame) -> DataFrame:
    """The (group, digit) classes of one radix step."""
    return rows.groupBy("grp", "digit").agg(
        F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     first_digit: int = FIRST_DIGIT, growth: int = GROWTH) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = base.schema["doc_id"].dataType.simpleString()
    rows = base.mapInArrow(_normalise, f"doc_id {id_type}, rest binary, text_sha256 string")
    # The group of a row: the path of digit classes so far, named by round and smallest member.
    rows = rows.withColumn("grp", F.lit(""))
    # The first count needs the head of each text only (N characters hold at least N bytes).
    heads = base.select("doc_id", F.substring("text", 1, first_digit)).mapInArrow(
        _lowered, f"doc_id {id_type}, head binary").select(
        "doc_id", F.lit("").alias("grp"), F.expr(f"substring(head, 1, {first_digit})").alias("digit"))
    done: list[DataFrame] = []
    width, level = first_digit, 0
    while True:
        rows = rows.withColumn("digit", F.expr(f"substring(rest, 1, {width})"))
        sizes = _classes(rows if level else heads)
        # A class is named by its own number within its round: ids of different classes never meet.
        sizes = materialize(sizes.filter("group_size > 1").withColumn(
            "next_grp", F.concat(F.lit(f"{level}:"), F.monotonically_increasing_id().cast("string"))),
            f"radix-sizes-{level}")
        # The classes are the small side; a hash join needs no sort of the texts.
        joined = rows.join(sizes.hint("shuffle_hash"), ["grp", "digit"], "left")
        ended = F.length("digit") < F.lit(width)
        out = materialize(
            joined.withColumn("state", F.when(F.col("group_size").isNull(), 0).when(ended, 1).otherwise(2)).select(
                "doc_id", "text_sha256", "state", "keep_id", "group_size",
                F.when(F.col("state") == 2, F.col("next_grp")).alias("grp"),
                F.when(F.col("state") == 2, F.expr(f"substring(rest, {width + 1})")).alias("rest")),
            f"radix-rows-{level}")
        single = out.filter("state = 0").select(
            "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
        equal = out.filter("state = 1").select("doc_id", "keep_id", "group_size", "text_sha256")
        done += [single, equal]
        rows = out.filter("state = 2").select("doc_id", "rest", "text_sha256", "grp")
        if rows.isEmpty():
            break
        width, level = width * growth, level + 1
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
