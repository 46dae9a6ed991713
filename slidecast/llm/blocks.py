"""Similarity links inside blocks, without forming all pairs of a block.

Entries (col, salt, node, n) say that a node (a set of n shingles, named by
its hash) stands in a block ``col``. Each block pairs its members with a hub;
a hot block is cut into sub-blocks (``salt`` of 0 or more) whose hubs meet in a
second step. Pairs within the size bounds are checked over the whole sets. What
shares a block and is still in different components afterwards meets some
hubs more, and what is split even then is paired by a join on the block, so
that every link between components that some block holds is found, whatever
the hubs were. These later pairs must also pass a bitmap of each set: a slot
whose parity differs holds an element that only one of the two has, so the
differing slots bound the symmetric difference from below and no link is lost.

Joins that every turn makes again go by merge at every size, so the driver
gathers no tables for them; only the few hubs of a turn may be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, blank_words, bucketed, materialize, parity_bits, shingle_set, slices
from .graph import components

NUM, DEN = 80, 100  # links have a Jaccard similarity of NUM / DEN or more
HOT_BLOCK = 4096
HUB_BLOCK = 256
MORE_HUBS = (12, 24)
BITMAP_LONGS = 16


def packer():
    """Packs whole texts for their way between tasks (one packer a task)."""
    z = zstandard.ZstdCompressor(level=1)
    return lambda text: z.compress(text.encode("utf-8", "surrogatepass"))


def unpacker():
    z = zstandard.ZstdDecompressor()
    return lambda body: z.decompress(body).decode("utf-8", "surrogatepass")


def placed_size(n: str, pos: str):
    """Set size and place in the set's order of blocks, packed in one number."""
    return F.shiftleft(F.col(n), 32) + F.col(pos)


def salts(weight: np.ndarray, node: int) -> np.ndarray:
    """Sub-block of a node in blocks of some expected sizes: -1 in a usual one, else more the hotter it is."""
    cut = np.maximum(1, weight // HOT_BLOCK + 1).astype(np.int64)
    return np.where(cut > 1, np.int64(node & 0x7FFFFFFF) % cut, -1).astype(np.int32)


def _hub_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (col, salt, rank): pair each node of a block with the block's first one."""
    before = None  # the last row of the batch before: col, salt, node, and its block's hub with its size
    for batch in batches:
        if not batch.num_rows:
            continue
        col, salt, node, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:4])
        first, again = np.ones(len(col), dtype=bool), np.zeros(len(col), dtype=bool)
        first[1:] = (col[1:] != col[:-1]) | (salt[1:] != salt[:-1])
        again[1:] = node[1:] == node[:-1]
        if before:
            first[0], again[0] = (col[0], salt[0]) != before[:2], node[0] == before[2]
        at = np.maximum.accumulate(np.where(first, np.arange(len(col)), -1))
        hub, hub_n = node[at], n[at]
        if before:
            hub[at < 0], hub_n[at < 0] = before[3:]
        # The hub of a sub-block goes to the second step; a node that comes twice is paired once.
        keep = np.where(first, salt >= 0, ~again & (node != hub))
        before = col[-1], salt[-1], node[-1], hub[-1], hub_n[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[keep]) for x in (col, salt, hub, hub_n, node, n)], names=["col", "salt", "hub", "hub_n", "node", "n"])


_HUB_SCHEMA = "col long, salt int, hub long, hub_n long, node long, n long"


def _hubs(entries: DataFrame) -> DataFrame:
    # A hub is drawn per node and half of the columns: members meet the same few hubs, but not one alone.
    rank = F.xxhash64("node", F.expr("col & 1"))
    return (
        entries.repartition(F.col("col"), F.col("salt")).withColumn("rank", rank)
        .sortWithinPartitions("col", "salt", "rank", "node").select("col", "salt", "node", "n")
        .mapInArrow(_hub_task, _HUB_SCHEMA))


def _near(a: str, b: str):
    """The size bounds on a pair that meets in a block, from packed sizes and places.

    A link needs an overlap of at least ``o = NUM (n_a + n_b) / (NUM + DEN)``. Sizes must allow it, and the first
    block that the two share must come no later than place ``n - o`` in either (all before it are misses).
    """
    size, place = (lambda x: f"shiftright({x}, 32)"), (lambda x: f"({x} & 4294967295L)")
    need = f"({NUM} * ({size(a)} + {size(b)}))"
    late = " AND ".join(f"{NUM + DEN} * ({size(x)} - {place(x)}) >= {need}" for x in (a, b))
    return F.expr(f"{DEN} * least({size(a)}, {size(b)}) >= {NUM} * greatest({size(a)}, {size(b)}) AND {late}")


def _few_differ(a: str, b: str, n_a: str, n_b: str):
    """The bitmap bound: a link's sets differ in at most ``(DEN - NUM) (n_a + n_b) / (DEN + NUM)`` elements."""
    differ = " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(BITMAP_LONGS))
    return F.expr(f"{DEN + NUM} * ({differ}) <= {DEN - NUM} * (shiftright({n_a}, 32) + shiftright({n_b}, 32))")


def bitmap(s: np.ndarray) -> list[int]:
    """Parity of each slot of a shingle set."""
    return parity_bits(s, BITMAP_LONGS).tolist()


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, block, hub's text first): overlap of each member with the hub's set."""
    hasher, unpack, key, base = WordHasher(), unpacker(), None, None
    for batch in slices(batches):
        a, b = [], []
        for hub, block, node, body in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
            s = shingle_set(hasher.of(blank_words(unpack(body))))
            if node is None:
                key, base = (hub, block), s
                continue
            if key != (hub, block):
                raise ValueError("a block without its hub")
            both = len(np.intersect1d(base, s, assume_unique=True))
            if DEN * both >= NUM * (len(base) + len(s) - both):
                a.append(hub)
                b.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _count_overlaps(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (hub, node) whose overlap reaches the bound, counted over whole sets."""
    blocks = F.expr(f"greatest(1L, members div {HUB_BLOCK}L)")
    members = pairs.withColumn("blocks", blocks).select(
        "hub", F.expr("cast(pmod(xxhash64(node), blocks) as int)").alias("block"), F.col("node").alias("member"), "node")
    heads = pairs.select("hub", blocks.alias("blocks")).distinct().select(
        "hub", F.explode(F.expr("transform(sequence(0L, blocks - 1), x -> cast(x as int))")).alias("block"),
        F.lit(None).cast("long").alias("member"), F.col("hub").alias("node"))
    return (
        heads.unionByName(members).join(texts.hint("shuffle_hash"), "node").select("hub", "block", "member", "body")
        .repartition(F.col("hub"), F.col("block"))
        .sortWithinPartitions("hub", "block", F.col("member").asc_nulls_first())
        .mapInArrow(_count_task, "a long, b long"))


def _with_members(pairs: DataFrame) -> DataFrame:
    sizes = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("members"))
    return pairs.join(sizes.hint("merge"), "hub")


def _united(comps: DataFrame, found: DataFrame, tag: str) -> DataFrame:
    """Components after some more links: only what the links join is worked on, component by component."""
    of = comps.select("node", "component")
    ends = found.join(of.withColumnsRenamed({"node": "a", "component": "at"}).hint("merge"), "a", "left").join(
        of.withColumnsRenamed({"node": "b", "component": "bt"}).hint("merge"), "b", "left").select(
        F.coalesce("at", "a").alias("a"), F.coalesce("bt", "b").alias("b")).filter("a <> b").distinct()
    over = components(ends).select(F.col("component").alias("root"), F.col("node").alias("component"))
    alone = over.select(F.col("component").alias("node")).join(of.hint("merge"), "node", "left_anti")
    return materialize(
        of.union(alone.select("node", F.col("node").alias("component"))).join(over.hint("merge"), "component", "left").select(
            "node", F.coalesce("root", "component").alias("component")), f"{tag}-components")


def link_blocks(entries: DataFrame, bits_of: Callable[[DataFrame], DataFrame], texts_of: Callable[[DataFrame], DataFrame],
                tag: str) -> DataFrame:
    """Links (a, b) that connect whatever the links within blocks connect.

    ``bits_of`` gets nodes (one column, ``node``) and returns (node, bits), their sets' :func:`bitmap`; ``texts_of``
    returns (node, body), their texts by :func:`packer`. Texts are dealt only of nodes that some pair may link.
    """
    spark = entries.sparkSession
    near = materialize(_hubs(entries), f"{tag}-blocks")
    second = materialize(_hubs(
        near.filter("salt >= 0").select("col", F.lit(-1).cast("int").alias("salt"), F.col("hub").alias("node"),
                                        F.col("hub_n").alias("n")).distinct()), f"{tag}-hot")
    met = near.unionByName(second).filter("hub <> node")
    bitmaps = materialize(bits_of(met.select("node").union(met.select("hub")).distinct()), f"{tag}-bits")
    size = (F.shiftleft(F.shiftright(x, 32), 32).alias(x) for x in ("hub_n", "n"))
    fit = met.filter(_near("hub_n", "n")).select("hub", "node", *size).distinct()
    of_hub = bitmaps.select(F.col("node").alias("hub"), F.col("bits").alias("hub_bits"))
    fit = fit.join(bitmaps.hint("shuffle_hash"), "node").join(of_hub.hint("shuffle_hash"), "hub").filter(
        _few_differ("hub_bits", "bits", "hub_n", "n")).select("hub", "node")
    pairs = materialize(_with_members(materialize(fit, f"{tag}-fit")), f"{tag}-pairs")
    # A block of two nodes is done with its one pair; only larger ones can hold links that no hub has met.
    large = near.groupBy("col").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("col")
    entry = near.join(large.hint("merge"), "col")
    entry = materialize(entry.select("col", F.col("hub").alias("node"), F.col("hub_n").alias("n")).union(
        entry.select("col", "node", "n")).distinct(), f"{tag}-entry")
    # Every later join with the texts is on their node: stored by it once, they are not shuffled again.
    wanted = pairs.select("node").union(pairs.select("hub")).union(entry.select("node")).distinct()
    texts, name = bucketed(texts_of(wanted), "node", f"{tag}_texts")
    links = materialize(_count_overlaps(pairs, texts), f"{tag}-links")
    tested = pairs.select(F.col("hub").alias("x"), F.col("node").alias("y"))

    # Blocks whose members are in different components still: first against some hubs more (all of them in a small
    # block), then, in the large blocks that this leaves split, every pair across components.
    comps = materialize(components(links), f"{tag}-components")
    for turn, some in enumerate((*MORE_HUBS, None)):
        placed = entry.join(comps.hint("merge"), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        split = placed.groupBy("col").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("k")).filter(
            f"lo < hi AND k > {2 if turn == 0 else 2 * MORE_HUBS[0] - 1}")
        rest = placed.join(split.select("col", "k").hint("merge"), "col")
        rest = materialize(rest if turn else rest.join(bitmaps.hint("shuffle_hash"), "node"), f"{tag}-rest")
        entry = rest.drop("comp", "k")  # components only grow, so no other block can be split later
        if rest.isEmpty():
            break
        other = rest.filter(F.pmod(F.xxhash64("node", F.lit(turn)), F.expr(f"greatest(1L, k div {some}L)")) == 0) if some else rest
        other = other.select("col", F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"),
                             F.col("bits").alias("hub_bits"))
        # Where every member is a hub, each pair is met from one side only.
        once = f"k < {2 * some}" if some else "true"
        more = rest.join(other, "col").filter(
            F.expr(f"hub_comp <> comp AND (NOT ({once}) OR hub < node)") & _near("hub_n", "n")
            & _few_differ("hub_bits", "bits", "hub_n", "n")).select("hub", "node").distinct()
        more = more.join(tested.hint("merge"), (F.col("hub") == F.col("x")) & (F.col("node") == F.col("y")), "left_anti").join(
            tested.hint("merge"), (F.col("hub") == F.col("y")) & (F.col("node") == F.col("x")), "left_anti")
        more = materialize(more, f"{tag}-more")
        if more.isEmpty():
            continue
        found = materialize(_count_overlaps(_with_members(more), texts), f"{tag}-more-links")
        tested = tested.union(more.select(F.col("hub").alias("x"), F.col("node").alias("y")))
        if not found.isEmpty():
            links = links.union(found)
            comps = _united(comps, found, tag)
    spark.sql(f"DROP TABLE {name}")  # the name only; nothing lazy reads it any more
    return links
