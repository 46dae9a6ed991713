"""Event codec: encode records into a key/value log, decode it back.

The log has the shape of a message-broker record: ``key STRING, value
BINARY``. Values are JSON documents (the container has no Avro package;
``from_avro`` takes the same place where it is loaded). Decoding is a
column expression (``from_json``) inside whole-stage codegen; nothing is
decoded in Python.

Undecodable events are dropped, never fatal: a value survives only if it
parses, carries no corrupt-record mark and has every required field. The
number of dropped events is reported through a Spark ``Observation``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

CORRUPT = "_corrupt_record"
# Text formats for timestamps inside encoded values (microseconds kept).
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
JSON_OPTIONS = {"timestampFormat": TS_FORMAT, "timestampNTZFormat": TS_FORMAT}


def encode(df: DataFrame, fields: dict[str, Column | str], key: Column | str | None = None,
           keep: Sequence[str] = ()) -> DataFrame:
    """Records → ``key STRING, value BINARY`` (S6). ``key`` may be omitted (null).

    ``keep`` carries source columns along (e.g. the arrival time for staging).
    """
    body = F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()])
    key_col = F.lit(None).cast("string") if key is None else (F.col(key) if isinstance(key, str) else key).cast("string")
    return df.select(key_col.alias("key"), F.to_json(body, JSON_OPTIONS).cast("binary").alias("value"), *keep)


def decode(log: DataFrame, schema: StructType, required: Sequence[str] | None = None,
           observation: Observation | str | None = None, keep_key: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """``key, value`` log → typed records; malformed values are dropped.

    ``required`` defaults to every field of ``schema``; ``keep`` carries columns of the log along
    (its arrival time). With an
    ``observation``, the counts ``events`` and ``dropped`` are recorded when
    the result is computed; on a stream pass a name instead, and the counts
    appear per micro-batch in ``query.lastProgress["observedMetrics"]``.
    """
    required = list(schema.fieldNames() if required is None else required)
    with_corrupt = StructType(list(schema.fields) + [StructField(CORRUPT, StringType(), True)])
    opts = dict(JSON_OPTIONS, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    parsed = F.from_json(F.col("value").cast("string"), with_corrupt, opts)
    kept = (["key"] if keep_key else []) + list(keep)
    out = log.select(*kept, parsed.alias("__r"))
    ok = F.col("__r").isNotNull() & F.col(f"__r.{CORRUPT}").isNull()
    for name in required:
        ok = ok & F.col(f"__r.`{name}`").isNotNull()
    out = out.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    if observation is not None:
        out = out.observe(observation, F.count(F.lit(1)).alias("events"),
                          F.sum(F.when(F.col("__ok"), 0).otherwise(1)).alias("dropped"))
    return out.filter("__ok").select(*kept, *[F.col(f"__r.`{n}`").alias(n) for n in schema.fieldNames()])


def write_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """Land an encoded log as files (the broker sink takes ``broker_sink_options``)."""
    log.write.mode(mode).parquet(path)


def ingest(df: DataFrame, fields: dict[str, Column | str], path: str,
           box: tuple[str, str, tuple[float, float], tuple[float, float]] | None = None) -> None:
    """Ingest job (S6 + S7): optional box filter → record → encoded log → files."""
    if box is not None:
        df = bbox_filter(df, *box)
    write_log(encode(df, fields), path)


def project_record(df: DataFrame, name: str = "name", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Decoded event → query record ``(name, text, count = 0)`` (S4); ``keep`` carries the arrival time along."""
    return df.select(*keep, F.col(name).alias("name"), F.col(text).alias("text"),
                     F.lit(0).cast(IntegerType()).alias("count"))


def bbox_filter(df: DataFrame, x: str, y: str, x_range: tuple[float, float],
                y_range: tuple[float, float]) -> DataFrame:
    """Keep rows inside a box on two coordinates (S7); both ranges inclusive."""
    return df.filter(F.col(x).between(*x_range) & F.col(y).between(*y_range))
