"""Benchmark decontamination with an FM-index per training shard.

Words are maximal runs of 0-9, a-z and non-ASCII characters after A-Z are
lower-cased. A window is ``WINDOW`` consecutive words of a benchmark item (an
item of fewer words is one window). Each Spark task cuts its documents into
shards of about ``SHARD_WORDS`` words and builds an FM-index over a shard's
words; all windows are searched backwards at once through wavelet ranks,
their occurrences are located by sampled suffix positions, and overlapping
occurrences are merged into removal spans.

Words that no benchmark item has cannot be part of an occurrence: they become
separators, and passages between separators that are shorter than the
shortest window are left out of the index.

The benchmark is the query set. It is sent to executors in blocks of at most
``BLOCK_BYTES`` of text (an item that is larger is a block of its own); with
several blocks the documents are read once and pass through one search per
block. Tasks hold one shard (or one document, if larger).

Edge cases: null or empty texts have no words and no hits; items without
words have no windows; a null item id is listed as the empty string, items
that share an id count once; very long texts are one shard; an empty
benchmark hits nothing; an empty table gives an empty result; columns of the
input are passed through by :func:`remove_contamination` and ignored by
:func:`find_contamination`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import alnum_words, few_texts, slices
from .fmindex import FMIndex

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 4 << 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def query_set(items: list[tuple[str, str | None]], window: int) -> dict:
    """Windows of a block of benchmark items: vocabulary, windows by length, items of each window.

    Plain containers, so that a broadcast of it needs no class on the workers.
    """
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in alnum_words(text)]
        for i in range(max(1, len(ids) - window + 1) if ids else 0):
            found.setdefault(tuple(ids[i : i + window]), set()).add(item)
    by_length = {}
    for length in sorted({len(w) for w in found}):
        chosen = [w for w in found if len(w) == length]
        by_length[length] = (np.array(chosen, dtype=np.int32), [sorted(found[w]) for w in chosen])
    return {"vocabulary": vocabulary, "by_length": by_length, "shortest": min(by_length, default=window)}


def query_sets(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
               window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[dict]:
    """The benchmark as blocks."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t"))
    block, size = [], 0
    for row in rows.toLocalIterator():
        more = len((row.t or "").encode("utf-8", "surrogatepass"))
        if block and size + more > block_bytes:
            yield query_set(block, window)
            block, size = [], 0
        block.append((row.i, row.t))
        size += more
    if block:
        yield query_set(block, window)


def search_shard(texts: list[np.ndarray], queries: dict) -> tuple[list[list[str]], list[list[tuple[int, int]]]]:
    """Items and merged word spans [start, end) of each document of a shard, from the numbers of its words (0: no item's)."""
    items: list[list[str]] = [[] for _ in texts]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # one separator after each document
    ids = np.zeros(int(starts[-1]), dtype=np.int32)
    for at, words in zip(starts, texts, strict=False):
        ids[at : at + len(words)] = words
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids != 0).astype(np.int8), [0]])))
    begins, lengths = edges[::2], edges[1::2] - edges[::2]
    fits = lengths >= queries["shortest"]
    begins, lengths = begins[fits], lengths[fits]
    if not len(begins) or not queries["by_length"]:
        return items, spans
    parts = lengths + 1  # each passage with the separator that follows it
    offsets = np.concatenate([[0], np.cumsum(parts)[:-1]])
    source = np.arange(int(parts.sum())) - np.repeat(offsets, parts) + np.repeat(begins, parts)
    symbols = ids[source]
    index = FMIndex(symbols, len(queries["vocabulary"]))
    cover = np.zeros(len(symbols) + 1, dtype=np.int64)
    seen: set[tuple[int, str]] = set()
    for length, (patterns, owners) in queries["by_length"].items():
        lo, hi = index.search(patterns)
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        counts = hi[hit] - lo[hit]
        rows = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo[hit], counts)
        places = index.locate(rows)
        np.add.at(cover, places, 1)
        np.add.at(cover, places + length, -1)
        doc = np.searchsorted(starts, source[places], side="right") - 1
        pairs = np.unique(np.stack([doc, np.repeat(hit, counts)]), axis=1)
        for d, w in pairs.T.tolist():
            seen.update((d, item) for item in owners[w])
    for d, item in seen:
        items[d].append(item)
    covered = (np.cumsum(cover[:-1]) > 0).astype(np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        at = int(source[a])
        d = int(np.searchsorted(starts, at, side="right")) - 1
        start = at - int(starts[d])
        spans[d].append((start, start + b - a))
    return items, spans


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search_task(queries, text_col: str, shard_words: int, cut: bool):
    """Adds to __items and __spans of each row; fills __n_words. ``cut`` takes the spans out of the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        texts: list[np.ndarray] = []  # a number per word: the words of a shard are not held as objects
        get = queries.value["vocabulary"].get
        size = 0

        def flush():
            items, spans = search_shard(texts, queries.value)
            at = 0
            for batch in held:
                n = batch.num_rows
                old_items = batch.column(batch.schema.get_field_index("__items")).to_pylist()
                old_spans = batch.column(batch.schema.get_field_index("__spans")).to_pylist()
                new = {
                    "__n_words": pa.array([len(w) for w in texts[at : at + n]], pa.int64()),
                    "__items": pa.array([sorted({*o, *x}) for o, x in zip(old_items, items[at : at + n], strict=True)], pa.list_(pa.string())),
                    "__spans": pa.array([
                        [{"start": a, "end": b} for a, b in _merged([*((s["start"], s["end"]) for s in o), *x])]
                        for o, x in zip(old_spans, spans[at : at + n], strict=True)], _SPANS),
                }
                at += n
                if cut:
                    whole = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                    new[text_col] = pa.array([cut_spans(t, x) for t, x in zip(whole, new["__spans"].to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [new.get(name, batch.column(i)) for i, name in enumerate(batch.schema.names)], names=batch.schema.names)
            held.clear()
            texts.clear()

        for batch in slices(batches):
            column = batch.column(batch.schema.get_field_index(text_col))
            begin = 0
            for i in range(batch.num_rows):
                words = alnum_words(column[i].as_py())
                texts.append(np.fromiter(map(get, words, repeat(0)), dtype=np.int32, count=len(words)))
                size += len(words)
                if size >= shard_words:
                    held.append(batch.slice(begin, i + 1 - begin))
                    begin, size = i + 1, 0
                    yield from flush()
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        if held:
            yield from flush()

    return run


def find_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS,
               block_bytes: int = BLOCK_BYTES, cut: bool = False) -> DataFrame:
    """``docs`` with __n_words, __items array<string>, __spans array<struct<start,end>> (word positions).

    ``cut`` takes the spans out of the texts, in the task that finds the last of them.
    """
    spark = docs.sparkSession
    few_texts(spark)
    names = docs.columns
    text_col = f"__c{names.index(text_col)}"  # a column may have any name
    out = docs.toDF(*[f"__c{i}" for i in range(len(names))]).withColumns({
        "__n_words": F.lit(0).cast("long"), "__items": F.array().cast("array<string>"),
        "__spans": F.array().cast("array<struct<start:bigint,end:bigint>>")})
    blocks = query_sets(benchmark, item_col, item_text_col, window, block_bytes)
    queries = next(blocks, None) or query_set([], window)  # no items: words are counted all the same
    while queries is not None:
        after = next(blocks, None)
        out = out.mapInArrow(
            _search_task(spark.sparkContext.broadcast(queries), text_col, shard_words, cut and after is None), StructType(out.schema.fields))
        queries = after
    return out.toDF(*names, "__n_words", "__items", "__spans")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items, spans."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return find_spans(base, benchmark, "text", **options).select(
        "doc_id", F.col("__n_words").alias("n_words"),
        F.aggregate("__spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"]).alias("n_hit"),
        F.col("__items").alias("items"), F.col("__spans").alias("spans"))


def cut_spans(text: str | None, spans: list[dict]) -> str | None:
    """``text`` without the words of some spans and what stands between them."""
    if not text or not spans:
        return text
    lowered = text.translate({c: c + 32 for c in range(0x41, 0x5B)})
    words = [m.span() for m in _WORD.finditer(lowered)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : words[s["start"]][0]])
        at = words[s["end"] - 1][1]
    out.append(text[at:])
    return "".join(out)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the removal spans cut out of their texts; all rows and columns stay."""
    found = find_spans(docs, benchmark, text_col, cut=True, **options)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    return found.toDF(*names, "__n_words", "__items", "__spans").select(*names).toDF(*docs.columns)
