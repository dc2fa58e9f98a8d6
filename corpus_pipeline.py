"""A corpus pipeline of five operators, each stage written as Parquet and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm import centroid_lang, entropy_mix, packing, queries, secret_index, simhash_anchor
from sheetwise.llm.common import prepare
from sheetwise.session import checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest language centroid rejects go."""
    prepare(spark)
    model = centroid_lang.fit(docs)
    return docs.withColumn("_p", centroid_lang.predicted(F.col("text"), model)).filter("not _p.rejected").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest id."""
    prepare(spark)
    return simhash_anchor.keep_one(docs.select(*COLUMNS), queries.SHINGLE, queries.MAX_BITS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; documents without any stay as they are."""
    prepare(spark)
    masked = docs.withColumn("_t", secret_index.redacted(F.col("text")))
    return masked.select("doc_id", F.col("_t").alias("text"), "lang", "source",
                         F.when(F.col("_t") == F.col("text"), F.col("n_chars")).otherwise(F.length("_t").cast("long")).alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    prepare(spark)
    return entropy_mix.mixed(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences."""
    prepare(spark)
    return packing.pack(docs, *queries.tokenizer_paths(), max_len=queries.SEQUENCE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_dedup", near_dedup), ("secrets", secrets), ("mix", mix), ("pack", pack)]

# Hashes, centroids and token ids can't be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    prepare(spark)
    folder = f"{checkpoint_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
