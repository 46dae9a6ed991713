"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidecast.session import scratch_path, table_path

SHINGLE_WORDS = 5
BATCH_ROWS = 2048
_MULTIPLIERS = np.array(
    [xxhash.xxh64_intdigest(f"shingle-{i}") | 1 for i in range(SHINGLE_WORDS)], dtype=np.uint64)
_MIX_1, _MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)

WHITESPACE_WORD = r"[^\x20\x09-\x0D]+"

# Bytes outside 0-9, a-z and UTF-8 sequences become blanks, A-Z become a-z.
ALNUM_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def materialize(df: DataFrame, kind: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back: cuts lineage with a
    replicated table, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, kind)
    writer = df.write.option("compression", "zstd")
    for k, v in (options or {}).items():
        writer = writer.option(k, v)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_texts(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` rows at most in this session, unless its own bound is lower: Spark hands
    tasks 10,000 whole texts at a time, which JVM and worker hold beside the heap, several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def bucketed(df: DataFrame, key: str, kind: str) -> tuple[DataFrame, str]:
    """:func:`materialize` into one bucket per shuffle partition: joins on ``key`` read it without a shuffle.

    Returns the table and its name in the catalog, to be dropped after use.
    """
    spark = df.sparkSession
    path = scratch_path(spark, kind)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name), name


def quoted(names) -> list:
    """Columns by their whole names, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def ascii_lower(column):
    """Lower-case A-Z only, on the JVM."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _S33)
    x = x * _MIX_1
    x = x ^ (x >> _S33)
    x = x * _MIX_2
    return x ^ (x >> _S33)


class WordHasher:
    """64-bit word hashes, without a memo: to look a word up costs more than its hash."""

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def blank_words(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than blank and 09-0D, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Words of 0-9, a-z and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split() if text else []


def slices(batches, rows: int = 512):
    """Batches cut small, so that no more than ``rows`` texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all consecutive 5-word shingles; a shorter text is one shingle, no words give none."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    k = min(n, SHINGLE_WORDS)
    acc = hashes[: n - k + 1] * _MULTIPLIERS[0]
    for i in range(1, k):
        acc = acc + hashes[i : n - k + 1 + i] * _MULTIPLIERS[i]
    return mix(acc + np.uint64(k))


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingles(hashes))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def parity_bits(s: np.ndarray, longs: int) -> np.ndarray:
    """Bitmap of a set of hashes: how often each of 64 * ``longs`` slots is hit, modulo 2."""
    slot = (mix(s) >> np.uint64(40)) % np.uint64(64 * longs)
    odd = (np.bincount(slot.astype(np.int64), minlength=64 * longs) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)
