"""Incremental ingest of a landing folder with Structured Streaming.

New files in the landing folder are picked up by a ``binaryFile`` stream.  Every file of
a micro-batch gets one row in ``manifest/`` with its decision (``ingested`` or the reason
why not); accepted CSV files are read with charset detection, cleaned with the same batch
functions and get one run row each.  A file is a dataset of its own, named by its path.

No streaming state is kept beyond the file-source log.  The checkpoint lies in the shared
checkpoint folder under a name that depends on the landing folder only, so a restarted
query (also in a new process) resumes where it stopped; runs are numbered by batch, and a
retried batch replaces its own rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheetwise.operators.cleaning import clean_summary, cleaned
from sheetwise.session import checkpoint_dir, materialize
from sheetwise.sources.files import ALLOWED_EXTENSIONS, csv_groups, file_charsets, plain_path, read_csv_group
from sheetwise.sources.sinks import clean_path, write_runs


def decided(files: DataFrame, max_bytes: int | None) -> DataFrame:
    """Files ``(path, length)`` with their ``dataset_id``, ``extension`` and ``reason`` (null: read)."""
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    reason = (F.when(~extension.isin(*ALLOWED_EXTENSIONS), "unsupported_extension")
              .when(F.col("length") == 0, "empty_file")
              .when(F.lit(max_bytes is not None) & (F.col("length") > F.lit(max_bytes)), "too_large")
              .when(extension != ".csv", "workbook_needs_batch_scan"))
    return files.select("path", "length", F.xxhash64("path").alias("dataset_id"), extension.alias("extension"), reason.alias("reason"))


def _hadoop(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def empty_files(spark: SparkSession, landing: str, root: str, batch_id: int) -> DataFrame:
    """Files of no bytes ``(path, length)``, which Spark's file scans leave out, as far as no
    other batch's manifest has them."""
    path, fs = _hadoop(spark, landing)
    names = [(s.getPath().toString(), 0) for s in fs.listStatus(path) if s.isFile() and s.getLen() == 0]
    found = spark.createDataFrame(names, "path string, length long")
    manifest, fs = _hadoop(spark, f"{root}/manifest")
    if fs.exists(manifest):
        found = found.join(spark.read.parquet(f"{root}/manifest").where(F.col("batch_id") != batch_id), "path", "left_anti")
    return found


def _process(spark: SparkSession, landing: str, root: str, max_bytes: int | None):
    def run(batch: DataFrame, batch_id: int) -> None:
        files = decided(batch.select("path", "length").unionByName(empty_files(spark, landing, root, batch_id)), max_bytes)
        names = [r["path"] for r in files.where("reason is null").select("path").collect()]
        if names:
            charsets = file_charsets(spark, names).select(F.col("file").alias("_plain"), F.col("charset").isNull().alias("_unknown"))
            files = (files.withColumn("_plain", plain_path(F.col("path"), encoded=False)).join(charsets, "_plain", "left")
                     .withColumn("reason", F.coalesce("reason", F.when(F.col("_unknown"), "undecodable"))).drop("_plain", "_unknown"))
        files = materialize(files.withColumns({"batch_id": F.lit(batch_id), "decision": F.coalesce("reason", F.lit("ingested"))}).drop("reason"))
        files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{root}/manifest")
        # the names of one batch's files (maxFilesPerTrigger of them); rows stay on the cluster
        for row in files.where("decision = 'ingested'").select("path", "dataset_id").collect():
            for group in csv_groups(spark, row["path"]):
                raw = read_csv_group(spark, group).drop("_file", "_pos")
                target = clean_path(root, row["dataset_id"], batch_id)
                cleaned(raw).write.mode("overwrite").parquet(target)
                write_runs(clean_summary(raw).withColumns({
                    "dataset_id": F.lit(row["dataset_id"]), "run_id": F.lit(batch_id).cast("long"),
                    "source_path": F.lit(row["path"]), "cleaned_storage_path": F.lit(target)}), root)
    return run


def checkpoint_name(landing: str, root: str) -> str:
    """Stable across processes: a digest of the folders."""
    return "ingest-" + hashlib.sha256(f"{landing}\n{root}".encode()).hexdigest()[:24]


def start_ingest(spark: SparkSession, landing: str, root: str, available_now: bool = True,
                 max_bytes: int | None = None, files_per_trigger: int = 100) -> StreamingQuery:
    """Start the ingest stream; ``available_now`` processes what is there and stops.

    ``max_bytes`` rejects larger files (no limit by default); ``files_per_trigger`` only
    sets the rate.
    """
    stream = (spark.readStream.format("binaryFile")
              .schema("path string, modificationTime timestamp, length long, content binary")
              .option("maxFilesPerTrigger", files_per_trigger).load(landing))
    writer = stream.select("path", "length").writeStream.foreachBatch(_process(spark, landing, root, max_bytes)) \
        .option("checkpointLocation", f"{checkpoint_dir(spark)}/{checkpoint_name(landing, root)}")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
