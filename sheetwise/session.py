"""Spark session settings shared by the library, the tests and the bench."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job of this package relies on.  They are semantic, not tuning:
# - case-sensitive column names, because uploaded headers such as ``a`` and ``A``
#   are different columns;
# - UTC session time zone, so that day and month keys do not move with the host;
# - ANSI mode stays on (Spark 4 default); text is parsed with ``try_*`` functions.
SEMANTIC_CONF = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

# Runtime settings applied to any session the queries run in.  Generated
# methods above 8000 bytes of bytecode are never JIT-compiled by the JVM, so a
# wide fused stage (aggregate + many CASE/regex projections) would run
# interpreted; with this limit Spark splits such stages instead (measured 4x on
# the cleaning stage).
RUNTIME_CONF = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Scale settings.  AQE re-plans joins and coalesces partitions at runtime, splits
# skewed join partitions, and turns joins whose *measured* build side is below the
# threshold into broadcast joins; nothing in this package broadcasts data whose
# size is not bounded by construction.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Many analyses per prepared table generate many stage classes; keep their
    # compiled (and JIT-warmed) code instead of recompiling after eviction.
    "spark.sql.codegen.cache.maxEntries": "2000",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "sheetwise") -> SparkSession:
    """Create (or reuse) a session with the package settings.

    ``master`` and ``shuffle_partitions`` are only set when given, so a session
    submitted to a cluster keeps the cluster's values.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("SHEETWISE_DRIVER_MEMORY", "16g"))
    for key, value in {**SEMANTIC_CONF, **RUNTIME_CONF, **SCALE_CONF}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    apply_conf(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in executors' Python workers (pandas UDFs,
    ``mapInPandas``): zip it once per SparkContext and register it with
    ``addPyFile``, which distributes it to every executor."""
    import zipfile

    key = id(spark.sparkContext)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="sheetwise-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(key)


def apply_conf(spark: SparkSession) -> None:
    """Apply the semantic and runtime settings to an existing session (e.g. the driver's)."""
    ship_package(spark)
    for key, value in {**SEMANTIC_CONF, **RUNTIME_CONF}.items():
        try:
            spark.conf.set(key, value)
        except Exception:  # static conf on an already running session
            pass


# Wide rows (some 30 cells, half a kilobyte in a hash table) that one task takes.
ROWS_A_TASK = 250_000


def tasks_for(df) -> int:
    """Number of tasks to deal the rows of ``df`` over, so that a task's memory doesn't grow with the table.

    Adaptive coalescing goes by the bytes of a shuffle, which say little about rows that a join
    widens afterwards.  ``df`` should be a scan: Parquet counts its rows from the file footers.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))


def materialize(df):
    """Cut lineage by writing a Parquet table into the shared checkpoint folder.

    Used where one prepared frame feeds many metric subqueries (findings,
    reports, catalogue plans): it is computed once; every reader then scans
    only the columns it needs, and a lost executor re-reads the files instead
    of recomputing the joins.
    """
    import uuid
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


_LOCAL_CHECKPOINTS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a session whose driver and executors are one process (tests, local runs) gets a
    scratch folder when none is set; on a cluster a missing setting is an error, since
    other machines would not see the driver's disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_CHECKPOINTS:
            _LOCAL_CHECKPOINTS[app] = tempfile.mkdtemp(prefix="sheetwise-ckpt-")
        configured = _LOCAL_CHECKPOINTS[app]
    spark.sparkContext.setCheckpointDir(configured)
    return configured
