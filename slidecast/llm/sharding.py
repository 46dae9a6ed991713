"""Sharding by a Feistel permutation with cycle walking.

Native DataFrame code throughout. Rows get global numbers 0..N-1 (a hash of
the row's content picks a bucket, the bucket's offset plus the row's place in
it is the number), a keyed permutation of 0..N-1 shuffles the numbers, and
``shard = place mod shards``, ``slot = place div shards``. Law ``rows``: the
counts of two shards differ by one at most and slots have no gaps.

The permutation is a generalised Feistel network over Z_a x Z_b with
``a = ceil(sqrt(N))`` and ``b = ceil(N / a)``; numbers that fall on one of the
fewer than ``a`` points beyond N walk on along their cycle. Place, shard and
slot are computable from the number alone, and back: :func:`place_of` and
:func:`number_at` do it on the driver for single rows.

The order of numbering takes content (id, text hash, size) only, so the file
layout does not matter. Buckets hold about ``ROWS_PER_BUCKET`` rows whatever
the input size. Edge cases: null texts have size 8 (no bytes plus 8) and the
checksum of the empty text, null ids sort first within their bucket, equal
rows get numbers of their own, an empty table gives an empty result, other
columns are ignored by :func:`shard_plan`.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 24
SEED = 97
ROUNDS = 6
ROWS_PER_BUCKET = 65_536
WALK = 64


def domain(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square that holds n points."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def round_keys(seed: int) -> list[tuple[int, int]]:
    """A multiplier and an addend below 2^31 for each round."""
    out = []
    for i in range(ROUNDS):
        h = xxhash.xxh64_intdigest(f"feistel-{seed}-{i}")
        out.append(((h & 0x7FFFFFFF) | 1, (h >> 32) & 0x7FFFFFFF))
    return out


# The round function is plain arithmetic below 2^63, equal in SQL and Python:
# x -> ((x mod m)^2 + k1 * (x mod m) + k2) mod m, twice, m the prime 2^31 - 1.
_M = 2_147_483_647


def _mixed(x: int, k1: int, k2: int) -> int:
    for _ in range(2):
        x %= _M
        x = (x * x % _M + k1 * x % _M + k2) % _M
    return x


def _mixed_sql(x: str, k1: int, k2: int) -> str:
    once = lambda v: f"(({v} * {v}) % {_M} + ({k1}L * {v}) % {_M} + {k2}L) % {_M}"
    return f"element_at(transform(array(({x}) % {_M}), m0 -> element_at(transform(array({once('m0')}), m1 -> {once('m1')}), 1)), 1)"


def permute(x: int, n: int, seed: int = SEED) -> int:
    """One pass of the network on the driver (no walking)."""
    a, b = domain(n)
    left, right = x // b, x % b
    for i, (k1, k2) in enumerate(round_keys(seed)):
        if i % 2 == 0:
            left = (left + _mixed(right, k1, k2)) % a
        else:
            right = (right + _mixed(left, k1, k2)) % b
    return left * b + right


def _unpermute(x: int, n: int, seed: int) -> int:
    a, b = domain(n)
    left, right = x // b, x % b
    for i, (k1, k2) in reversed(list(enumerate(round_keys(seed)))):
        if i % 2 == 0:
            left = (left - _mixed(right, k1, k2)) % a
        else:
            right = (right - _mixed(left, k1, k2)) % b
    return left * b + right


def place_of(number: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of a global row number."""
    x = permute(number, n, seed)
    while x >= n:
        x = permute(x, n, seed)
    return x % shards, x // shards


def number_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The global row number in a slot of a shard: the permutation walked backwards."""
    x = _unpermute(slot * shards + shard, n, seed)
    while x >= n:
        x = _unpermute(x, n, seed)
    return x


def _pass_sql(x: str, n: int, seed: int) -> str:
    """One pass of the network as a SQL expression; lets by one-element arrays."""
    a, b = domain(n)
    state = f"named_struct('l', {x} div {b}L, 'r', {x} % {b}L)"
    for i, (k1, k2) in enumerate(round_keys(seed)):
        v = f"s{i}"
        if i % 2 == 0:
            step = f"named_struct('l', ({v}.l + {_mixed_sql(f'{v}.r', k1, k2)}) % {a}L, 'r', {v}.r)"
        else:
            step = f"named_struct('l', {v}.l, 'r', ({v}.r + {_mixed_sql(f'{v}.l', k1, k2)}) % {b}L)"
        state = f"element_at(transform(array({state}), {v} -> {step}), 1)"
    return f"element_at(transform(array({state}), z -> z.l * {b}L + z.r), 1)"


def permuted(number: str, n: int, seed: int = SEED) -> Column:
    """The place of a number: one pass, and for the few beyond N a walk along the cycle.

    A walk meets fewer than ``a`` points beyond N; ``WALK`` passes are always
    enough up to N = WALK^2, and beyond that a longer walk has a chance below
    1 / N^(WALK/2). Should it happen, the query fails rather than misplaces a row.
    """
    walk = (
        f"aggregate(sequence(1, {WALK}), x0, (acc, i) -> "
        f"if(acc < {n}L, acc, {_pass_sql('acc', n, seed)}))"
    )
    return F.expr(
        f"element_at(transform(array({_pass_sql(number, n, seed)}), x0 -> if(x0 < {n}L, x0, {walk})), 1)")


def number_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """``rows`` with a global number 0..n-1 from content alone: bucket offset plus place in the bucket."""
    buckets = max(1, -(-n // ROWS_PER_BUCKET))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    # One row per bucket, at most n / ROWS_PER_BUCKET of them.
    offsets = counts.select(
        F.col("__bucket").alias("__b"),
        (F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n")).alias("__offset"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) - 1
    return rows.withColumn("__place", place).join(
        offsets, F.col("__bucket") == F.col("__b")).withColumn(
        "__number", (F.col("__offset") + F.col("__place")).cast("long")).drop("__bucket", "__b", "__offset", "__place")


def shard_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
               seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, number, shard, slot, grown_shard."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text_col).alias("text_hash"))
    rows = materialize(rows, "shard-rows")
    n = rows.count()
    numbered = number_rows(rows, ["doc_id", "text_hash", "size", "text_crc32"], n)
    return numbered.withColumn("place", permuted("__number", max(n, 1), seed)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("__number").alias("number"),
        F.expr(f"cast(if(place < {max(n, 1)}L, place % {shards}L, raise_error('cycle walk ended early')) as int)").alias("shard"),
        F.expr(f"place div {shards}L").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
