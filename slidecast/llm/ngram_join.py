"""N-gram Jaccard join as a blocked sparse matrix product.

Let A be the incidence matrix of documents by 5-word shingles. Two documents
link if their Jaccard similarity is 0.8 or more, that is if the entry of
A x A' is at least the size-derived bound ``0.8 / 1.8 * (n_x + n_y)``.

1. Documents with equal shingle sets share a row of A (a *node*, named by a
   64-bit hash of the set). Copies are never expanded.
2. Columns are ordered by rarity (a counting sketch of fixed size over all
   shingles of all documents; any order is correct, a good one is fast). A
   row's whole text is packed beside its columns and is dealt once. By
   the size bound a linked pair shares one of the first ``n - ceil(0.8 n) + 1``
   columns of both rows, so only these entries of A enter the product.
3. Product by column blocks: sorted by column, each block's rows stream past.
   A column's documents are paired with a hub of the column, not with each
   other; a hot column is cut into sub-blocks whose hubs meet in a second
   step. Pairs outside the size ratio are discarded.
4. Overlap counts of the surviving pairs are accumulated over whole shingle
   sets, hub by hub, in blocks of bounded size.
5. Links give components. What is left are pairs that share a column and are
   still in different components: these are formed by a join on the column
   (no pair within a component), counted the same way, and added. So no link
   that joins two components is lost, whatever the hubs were.

Edge cases: texts are cut at 20 and 09-0D only; a text of one to four words is
one shingle; a null or blank text has no shingles, links with nothing and is
its own component; a row with a null doc_id lends no id and makes no
link, but takes the component of an equal set (else null); rows that repeat a doc_id are one node of the graph
per text, and the id reaches what any of them reaches; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import DEN, NUM, bitmap, link_blocks, packer, placed_size, salts
from .common import WordHasher, blank_words, few_texts, materialize, mix, shingle_set, signed, slices
from .graph import components

SKETCH_BITS = 24
SKETCH_CHUNK = 1 << 16
STEPS = 8  # codes of the sketch per doubling of a count


def prefix_length(n: int) -> int:
    """Columns of a row of n entries of which a partner shares one at least."""
    return n - -(-NUM * n // DEN) + 1


def _set_hash(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(signed(mix(np.array([np.add.reduce(mix(s)) ^ np.uint64(len(s))], dtype=np.uint64)))[0])


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits per slot in one task, as packed chunks of counters; what is empty packs to nothing."""
    counts, hasher, top = np.zeros(1 << SKETCH_BITS, dtype=np.uint16), WordHasher(), np.iinfo(np.uint16).max
    pending, waiting = [], 0

    def add():
        hit, times = np.unique(np.concatenate(pending), return_counts=True)
        counts[hit] = np.minimum(counts[hit] + times, top)

    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            s = shingle_set(hasher.of(blank_words(text)))
            pending.append(_slots(s))
            waiting += len(s)
            if waiting > 1 << 20:
                add()
                pending, waiting = [], 0
    if pending:
        add()
    z = zstandard.ZstdCompressor(level=1)
    # One chunk of counters per row; chunks meet by number, so no task sums more than its share.
    for i, chunk in enumerate(counts.reshape(-1, SKETCH_CHUNK)):
        if chunk.any():
            yield _chunk(i, z.compress(chunk.tobytes()))


def _chunk(number: int, packed: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([packed], pa.binary())], names=["chunk", "counts"])


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the chunks, coded by the logarithm: a byte holds any count, and the order of counts is kept."""
    totals: dict[int, np.ndarray] = {}
    unpacker = zstandard.ZstdDecompressor()
    for batch in slices(batches):
        for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(unpacker.decompress(raw), dtype=np.uint16)
            if chunk not in totals:
                totals[chunk] = np.zeros(SKETCH_CHUNK, dtype=np.uint64)
            totals[chunk] += part
    z = zstandard.ZstdCompressor(level=1)
    for chunk, total in totals.items():
        code = np.minimum(np.round(STEPS * np.log2(1.0 + total)), 255).astype(np.uint8)
        yield _chunk(chunk, z.compress(code.tobytes()))


def sketch_counts() -> np.ndarray:
    """The count that each code of the sketch stands for."""
    return np.exp2(np.arange(256) / STEPS) - 1


def usual_count(order: np.ndarray, counts: np.ndarray) -> float:
    """Mean count of a slot. Chunk by chunk: numpy counts codes as longs, eight times the sketch at once."""
    found = np.zeros(256, dtype=np.int64)
    for i in range(0, len(order), SKETCH_CHUNK):
        found += np.bincount(order[i : i + SKETCH_CHUNK], minlength=256)
    return float((found * counts).sum() / len(order))


def column_sketch(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each of 2^SKETCH_BITS slots of shingles is hit over all documents, as codes (16 MB at every input size)."""
    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(_sketch_task, "chunk int, counts binary")
    summed = parts.repartition(32, "chunk").mapInArrow(_sum_chunks, "chunk int, counts binary")
    codes = np.zeros(1 << SKETCH_BITS, dtype=np.uint8).reshape(-1, SKETCH_CHUNK)
    unpacker = zstandard.ZstdDecompressor()
    for row in summed.collect():  # 256 chunks of 64 KB, whatever the input
        codes[row.chunk] = np.frombuffer(unpacker.decompress(row.counts), dtype=np.uint8)
    return codes.reshape(-1)


_ROWS_SCHEMA = "doc_id {id}, n_shingles long, node long, cols array<long>, salts array<int>, body binary, bits array<long>"


def _rows_task(sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, hasher, seen, counts, pack = sketch.value, WordHasher(), set(), sketch_counts(), packer()
        usual = usual_count(order, counts)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(hasher.of(blank_words(text)))
                if not len(s):
                    rows.append((doc_id.as_py(), 0, None, None, None, None, None))
                    continue
                node = _set_hash(s)
                if not doc_id.is_valid or node in seen:  # no id to lend, or a copy whose columns went out already
                    rows.append((doc_id.as_py(), len(s), node, None, None, None, None))
                    continue
                if len(seen) < 1 << 20:
                    seen.add(node)
                weight = order[_slots(s)]
                first = np.lexsort((s, weight))[: prefix_length(len(s))]
                rows.append((doc_id.as_py(), len(s), node, signed(s[first]), salts(counts[weight[first]] - usual, node), pack(text), bitmap(s)))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.list_(pa.int32())),
                 pa.array(cols[5], pa.binary()), pa.array(cols[6], pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "node", "cols", "salts", "body", "bits"])
    return run


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows (doc_id, n_shingles, node) of all documents, links (a, b) between nodes.

    The links connect exactly what all links connect; copies share a node.
    """
    spark = docs.sparkSession
    few_texts(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = spark.sparkContext.broadcast(column_sketch(base, "text"))
    id_type = base.schema["doc_id"].dataType.simpleString()
    rows = materialize(base.mapInArrow(_rows_task(sketch), _ROWS_SCHEMA.format(id=id_type)), "ngram-rows")
    sketch.destroy()  # the rows are a table now
    lending = rows.filter("cols IS NOT NULL")
    entries = lending.select(
        F.col("node"), F.col("n_shingles").alias("n"), F.posexplode(F.arrays_zip("cols", "salts")).alias("pos", "x")).select(
        F.col("x.cols").alias("col"), F.col("x.salts").alias("salt"), "node", placed_size("n", "pos").alias("n"))

    def chosen(nodes: DataFrame) -> DataFrame:
        """One document for each node. Rows meet by node and id, so the copies of one text lie in no one task."""
        return lending.select("node", "doc_id").join(nodes.hint("shuffle_hash"), "node", "left_semi").groupBy("node").agg(
            F.min("doc_id").alias("doc_id")).hint("shuffle_hash")

    def bits_of(nodes: DataFrame) -> DataFrame:
        return lending.select("node", "doc_id", "bits").join(chosen(nodes), ["node", "doc_id"]).select("node", "bits").dropDuplicates(["node"])

    def texts_of(nodes: DataFrame) -> DataFrame:
        return lending.select("node", "doc_id", "body").join(chosen(nodes), ["node", "doc_id"]).select("node", "body")

    links = link_blocks(entries, bits_of, texts_of, "ngram")
    return rows.select("doc_id", "n_shingles", "node"), links


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    rows, links = jaccard_links(docs, id_col, text_col)
    placed = rows.filter("node IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "node")
    heads = placed.groupBy("node").agg(F.min("doc_id").alias("head"))
    # Ids are nodes of the graph too: an id that stands on several texts joins them.
    several = placed.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("b < last").select("doc_id", "b")
    bridges = placed.distinct().join(several, "doc_id").select(F.col("node").alias("a"), "b").filter("a <> b")
    comps = components(links.select("a", "b").union(bridges)).withColumnRenamed("component", "root")
    of_node = heads.join(comps, "node", "left").select("node", "head", F.coalesce("root", "node").alias("root"))
    least = of_node.groupBy("root").agg(F.min("head").alias("component_id"))
    named = of_node.join(least, "root").select("node", "component_id")
    out = rows.join(named, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out
