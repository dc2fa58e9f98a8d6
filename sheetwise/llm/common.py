"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.session import apply_conf, checkpoint_dir

__all__ = ["prepare", "tidy", "tidy_group", "read_table", "save", "discard", "parallelism", "source_key"]


# Whole texts go to Python in batches; a few megabytes of them at a time keep the
# memory of a worker small beside its largest document.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def prepare(spark: SparkSession) -> None:
    """Session settings that the corpus operators rely on."""
    apply_conf(spark)
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


def tidy(batches_to_batches: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """For a function over the batches of a task: a Python worker that waits for its next
    task gives the memory of this one back, as several wait beside the JVM."""

    @functools.wraps(batches_to_batches)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from batches_to_batches(batches)
        finally:
            _give_back()

    return run


def tidy_group(of_group: Callable) -> Callable:
    """``tidy`` for a function of one group."""

    @functools.wraps(of_group)
    def run(group):
        try:
            return of_group(group)
        finally:
            _give_back()

    return run


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's reader only (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table into the shared folder that
    ``spark.checkpoint.dir`` names and read it back.  A stage that is run again
    after a lost executor reads the files again."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``save`` that a later round has replaced."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session, the unit for bucket counts."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def source_key(col: str) -> Column:
    """A text key equal for equal values and never null, so that null is a group
    of its own in equi-joins; its order is the code-point order, nulls last."""
    return F.when(F.col(col).isNull(), F.lit("\U0010ffff")).otherwise(F.concat(F.lit("="), F.col(col)))
