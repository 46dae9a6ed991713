"""Spark session and shared work-folder helpers.

Everything the engine writes between stages (staged replay files, loop-lane
chunks, stream stores, sinks) goes under the shared folder that the cluster
names in ``spark.checkpoint.dir``. Only when that setting is absent (local
runs, tests) does the engine create one of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_STREAM_SESSIONS: dict[tuple, tuple] = {}


def get_spark(master: str | None = None, app: str = "slidecast",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the engine relies on (UTC, AQE, no UI)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Streaming state (native lanes) in RocksDB: off the JVM heap, committed
        # incrementally to the query's checkpoint location.
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _inherit(session: SparkSession, caller: SparkSession) -> SparkSession:
    """Give a session the caller's settings that change what SQL means."""
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.caseSensitive",
                "spark.sql.timestampType"):
        session.conf.set(key, caller.conf.get(key))
    return session


def private_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose temp views the caller never sees
    (reused per caller session; callers register only uniquely named views)."""
    key = ("private", id(spark))
    if key not in _STREAM_SESSIONS:
        _STREAM_SESSIONS[key] = (spark, spark.newSession())
    return _inherit(_STREAM_SESSIONS[key][1], spark)


def stream_session(spark: SparkSession) -> SparkSession:
    """A session for starting streaming queries from a bounded replay.

    Stateful operators fix their partition count at the first run; here it
    is the cluster's parallelism (one state partition per core) rather than
    a large static default, and state lives in RocksDB. The caller's session
    is left as it is.
    """
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), cores))
    key = (id(spark), parts)
    if key not in _STREAM_SESSIONS:  # one per caller session: each holds a query manager
        ss = spark.newSession()
        ss.conf.set("spark.sql.shuffle.partitions", str(parts))
        ss.conf.set("spark.sql.streaming.stateStore.providerClass",
                    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        _STREAM_SESSIONS[key] = (spark, ss)
    return _inherit(_STREAM_SESSIONS[key][1], spark)


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Read from ``spark.checkpoint.dir`` (cluster setting) or the context's
    checkpoint dir; set a fresh local one only when neither is configured and
    the master is local. On a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # pragma: no cover - conf lookup can refuse static keys
            configured = None
    if configured and not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)  # so Dataset.checkpoint() writes there too
    if not configured:
        configured = sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = sc.applicationId
    if key not in _LOCAL_DIRS:
        local = tempfile.mkdtemp(prefix="slidecast-ckpt-")
        sc.setCheckpointDir(local)
        _LOCAL_DIRS[key] = local
    return _LOCAL_DIRS[key]


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new, unique path under the work folder (never reused between runs)."""
    return f"{work_dir(spark)}/{kind}-{uuid.uuid4().hex[:12]}"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder of the shared file system (none where it does not exist yet)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    if not fs.exists(where):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory())


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
