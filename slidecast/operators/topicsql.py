"""Per-window SQL: run a topic's query separately over each of its windows.

Two lanes, same answer:

* **plan lane** (default): one Spark plan for all windows. The windows list
  is the outer side of a ``LATERAL`` subquery whose body binds the topic
  name to that window's rows (a CTE correlated on ``window_end``) and runs
  the topic SQL unchanged. Catalyst decorrelates it: ``window_end`` joins
  every grouping key, limits become per-window ranks, and the window list
  (one row per window) is joined back, broadcast only when AQE has measured
  it below the broadcast threshold.
* **loop lane**: for SQL that Spark cannot decorrelate (outer / semi / anti
  joins, subquery expressions, grouping sets), the reference's own
  execution, one evaluation per window: the rows are written once to the
  shared folder, one folder per window (range-partitioned so a hot window
  spans several tasks); each window's SQL binds the topic name to its own
  folder through a CTE, in a private session (so names cannot clash with
  the caller's views); a chunk of windows is one ``UNION ALL`` statement,
  and with several chunks each is landed in the shared folder, so no plan
  grows with the window count and a lost executor repeats one chunk.

The lane is chosen from the analysed plan of the topic SQL against an empty
table with the topic's schema (an allow-list: anything not known to
decorrelate goes to the loop).
"""

from __future__ import annotations

import itertools
import logging
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import private_session, scratch_path
from .windows import WINDOW_END, WINDOW_START

# Analysed-plan markers that send a topic to the loop lane.
LOOP_MARKERS = (
    "exists#", "list#", "scalar-subquery#", "lateral-subquery#",
    "LeftOuter", "RightOuter", "FullOuter", "LeftSemi", "LeftAnti", "ExistenceJoin",
    "Expand",
)

RESERVED = (WINDOW_START, WINDOW_END)

log = logging.getLogger("slidecast.topicsql")


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _strip_sql(ql: str) -> str:
    ql = ql.strip()
    while ql.endswith(";"):
        ql = ql[:-1].rstrip()
    return ql


def analysed_plan(spark: SparkSession, ql: str) -> str:
    """The analysed logical plan text of a query (``EXPLAIN EXTENDED``)."""
    text = spark.sql(f"EXPLAIN EXTENDED {ql}").collect()[0][0]
    start = text.find("== Analyzed Logical Plan ==")
    end = text.find("== Optimized Logical Plan ==")
    return text[start:end] if start >= 0 else text


def analyse_topic_sql(spark: SparkSession, name: str, ql: str, schema: StructType,
                      others: dict[str, StructType] | None = None, lane: bool = False):
    """Analyse the topic SQL against empty tables of the given schemas.

    Returns the (empty) result DataFrame, or with ``lane=True`` the lane the
    SQL needs as well.
    """
    private = spark.newSession()
    private.createDataFrame([], schema).createOrReplaceTempView(name)
    for other, oschema in (others or {}).items():
        private.createDataFrame([], oschema).createOrReplaceTempView(other)
    df = private.sql(_strip_sql(ql))
    cols = df.columns
    clash = [c for c in cols if c.lower() in RESERVED]
    if clash:
        raise ValueError(f"topic {name!r}: result column(s) {clash} clash with the window columns")
    lowered = [c.lower() for c in cols]
    dups = sorted({c for c in cols if lowered.count(c.lower()) > 1})
    if dups:
        raise ValueError(f"topic {name!r}: duplicate result column(s) {dups}")
    if not lane:
        return df
    plan = analysed_plan(private, _strip_sql(ql))
    return df, ("loop" if any(m in plan for m in LOOP_MARKERS) else "plan")


_LANES: dict[tuple, str] = {}


def choose_lane(spark: SparkSession, name: str, ql: str, schema: StructType,
                others: dict[str, StructType] | None = None) -> str:
    """``"plan"`` or ``"loop"`` for this SQL over this schema (remembered per input)."""
    key = (name, ql, schema.json(), tuple(sorted((k, v.json()) for k, v in (others or {}).items())))
    if key not in _LANES:
        _LANES[key] = analyse_topic_sql(spark, name, ql, schema, others, lane=True)[1]
    return _LANES[key]


@dataclass(frozen=True)
class OtherTopic:
    """Another topic's windowed rows visible to this topic's SQL (cross-topic).

    ``rows`` carry the ``window_end`` of the reading topic's window that sees
    them (see ``crosstopic``).
    """
    name: str
    rows: DataFrame


def windowed_sql(rows: DataFrame, topic: str, ql: str, *, lane: str = "auto",
                 record_cols: Sequence[str] | None = None,
                 windows: DataFrame | None = None,
                 others: Sequence[OtherTopic] = (),
                 loop_chunk: int = 64, check: bool = True) -> DataFrame:
    """Run ``ql`` over every window of ``rows``; returns window columns + result.

    ``rows`` carries the record columns plus ``window_start``/``window_end``.
    Windows exist only where rows do, so empty windows never run (W5) and a
    window whose SQL returns nothing contributes no row (W6).
    """
    spark = rows.sparkSession
    ql = _strip_sql(ql)
    if record_cols is None:
        record_cols = [c for c in rows.columns if c not in RESERVED]
    record_cols = list(record_cols)
    schema = rows.select(*record_cols).schema
    other_schemas = {o.name: o.rows.select(*[c for c in o.rows.columns if c not in RESERVED]).schema
                     for o in others}
    if windows is None:
        windows = rows.select(WINDOW_START, WINDOW_END).distinct()
    if lane == "auto":
        lane = choose_lane(spark, topic, ql, schema, other_schemas)
    elif check:
        analyse_topic_sql(spark, topic, ql, schema, other_schemas)
    if lane == "plan":
        return _plan_lane(spark, rows, windows, topic, ql, record_cols, others)
    if lane == "loop":
        return _loop_lane(spark, rows, windows, topic, ql, record_cols, others, loop_chunk)
    raise ValueError(f"unknown lane {lane!r}")


def _plan_lane(spark, rows, windows, topic, ql, record_cols, others) -> DataFrame:
    tag = uuid.uuid4().hex[:10]
    views = {"rows": f"__sc_rows_{tag}", "wins": f"__sc_wins_{tag}"}
    rows.createOrReplaceTempView(views["rows"])
    windows.createOrReplaceTempView(views["wins"])
    ctes = [f"{_q(topic)} AS (SELECT {', '.join(_q(c) for c in record_cols)} "
            f"FROM {views['rows']} r WHERE r.{WINDOW_END} = w.{WINDOW_END})"]
    for i, o in enumerate(others):
        v = f"__sc_other{i}_{tag}"
        views[v] = v
        o.rows.createOrReplaceTempView(v)
        ocols = [c for c in o.rows.columns if c not in RESERVED]
        ctes.append(f"{_q(o.name)} AS (SELECT {', '.join(_q(c) for c in ocols)} "
                    f"FROM {v} o WHERE o.{WINDOW_END} = w.{WINDOW_END})")
    sql = (f"SELECT w.{WINDOW_START}, w.{WINDOW_END}, q.* FROM {views['wins']} w, LATERAL ("
           f"WITH {', '.join(ctes)} SELECT * FROM ({ql}) __topic_q) q")
    try:
        out = spark.sql(sql)
    finally:
        for v in views.values():
            spark.catalog.dropTempView(v)
    return out


def _window_key(col) -> F.Column:
    return F.concat(F.lit("w"), F.date_format(col, "yyyyMMddHHmmssSSSSSS"))


def _store_by_window(rows: DataFrame, path: str) -> None:
    """Write windowed rows to one folder per window.

    Range-partitioning on ``(window_end, row hash)`` first keeps the file count near
    the partition count plus the window count (not tasks x windows), and a
    hot window is still spread over several tasks.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows of a hot window are told apart by a hash of their content (maps cannot be hashed).
    own = [F.col(_q(f.name)) for f in rows.schema.fields if f.name not in RESERVED and "map<" not in f.dataType.simpleString()]
    order = [F.col(WINDOW_END)] + ([F.xxhash64(*own)] if own else [])
    (rows.withColumn("__wkey", _window_key(F.col(WINDOW_END)))
         .repartitionByRange(n, *order)
         .write.partitionBy("__wkey").parquet(path))


def _loop_lane(spark, rows, windows, topic, ql, record_cols, others, chunk) -> DataFrame:
    t0 = time.perf_counter()
    ts_type = rows.schema[WINDOW_END].dataType.simpleString()
    stored = scratch_path(spark, "loop-rows")
    _store_by_window(rows, stored)
    other_paths = []
    for o in others:
        p = scratch_path(spark, "loop-other")
        _store_by_window(o.rows, p)
        other_paths.append(p)
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    sel = [F.date_format(WINDOW_START, fmt).alias("s"), F.date_format(WINDOW_END, fmt).alias("e"),
           _window_key(F.col(WINDOW_END)).alias("k")]
    # The window list is metadata (one small row per window, bounded by the
    # time span over the slide, not by the data volume); it is streamed to the
    # driver one partition at a time and consumed chunk by chunk.
    win_iter = windows.select(*sel).orderBy("e").toLocalIterator()
    first = list(itertools.islice(win_iter, chunk + 1))
    log.debug("loop lane %s: rows stored, windows listed in %.2fs", topic, time.perf_counter() - t0)

    private = private_session(spark)
    empty_schema = analyse_topic_sql(spark, topic, ql, rows.select(*record_cols).schema,
                                     {o.name: o.rows.select(*[c for c in o.rows.columns
                                                             if c not in RESERVED]).schema
                                      for o in others}).schema
    if not first:
        fields = rows.select(WINDOW_START, WINDOW_END).schema.fields + empty_schema.fields
        return spark.createDataFrame([], StructType(fields))
    # Each stored table is listed once; every window's CTE prunes to its folder.
    tag = uuid.uuid4().hex[:10]
    base_view = f"__sc_loop_{tag}"
    private.read.parquet(stored).createOrReplaceTempView(base_view)
    for i, (o, p) in enumerate(zip(others, other_paths, strict=True)):  # no window may see a row of it
        private.read.schema(StructType([*o.rows.schema.fields, StructField("__wkey", StringType())])).parquet(p).createOrReplaceTempView(f"{base_view}_o{i}")
    cols = ", ".join(_q(c) for c in record_cols)
    ocols = [", ".join(_q(c) for c in o.rows.columns if c not in RESERVED) for o in others]

    def one_window(w) -> str:
        ctes = [f"{_q(topic)} AS (SELECT {cols} FROM {base_view} WHERE __wkey = '{w['k']}')"]
        for i, o in enumerate(others):
            ctes.append(f"{_q(o.name)} AS (SELECT {ocols[i]} FROM {base_view}_o{i} WHERE __wkey = '{w['k']}')")
        return (f"SELECT CAST('{w['s']}' AS {ts_type}) AS {WINDOW_START}, "
                f"CAST('{w['e']}' AS {ts_type}) AS {WINDOW_END}, __q.* FROM "
                f"(WITH {', '.join(ctes)} SELECT * FROM ({ql}) __t) __q")

    # One statement per chunk: the windows' plans are analysed together.
    def block(ws) -> DataFrame:
        return private.sql(" UNION ALL ".join(one_window(w) for w in ws))

    views = [base_view] + [f"{base_view}_o{i}" for i in range(len(other_paths))]

    def drop_views() -> None:  # plans already hold their relations
        for v in views:
            private.catalog.dropTempView(v)

    if len(first) <= chunk:
        out = block(first)
        drop_views()
        log.debug("loop lane %s: %d window plans built at %.2fs", topic, len(first), time.perf_counter() - t0)
        return out
    # Several chunks: land each in the shared folder so no plan grows with the
    # number of windows and a lost executor repeats only its chunk.
    out_path = scratch_path(spark, "loop-out")
    pending = first
    while pending:
        block(pending[:chunk]).write.mode("append").parquet(out_path)
        pending = pending[chunk:] + list(itertools.islice(win_iter, chunk - len(pending[chunk:])))
    drop_views()
    log.debug("loop lane %s: chunks written at %.2fs", topic, time.perf_counter() - t0)
    return spark.read.parquet(out_path)
