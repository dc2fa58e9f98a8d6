"""Token counts: an exact histogram of encoded lengths and its suffix sums.

Every document is encoded once; documents are then only known by their length.
The histogram has one row per distinct length, so totals, quantiles and truncated
totals for *every* context limit are lookups in it, never another pass over texts.

Defined cases: a null or empty text has length 0; equal lengths and repeated rows
add up in one histogram row (partial aggregation, so a length that a third of all
documents share is one row per task in the shuffle); an empty table gives an empty
histogram; further columns of the documents are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.common import save, tidy
from sheetwise.llm.encoding import encoder

# Lengths per block of the two-level suffix sum.
BLOCK = 256


def encoded_lengths(docs: DataFrame, tokenizer: str, ranks: str | None = None, text: str = "text") -> DataFrame:
    """One row ``length`` per document."""

    @F.pandas_udf("long")
    @tidy
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(tokenizer, ranks)
        for batch in texts:
            yield batch.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return docs.select(count(F.col(text)).alias("length"))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Per distinct ``length``: ``n_docs``, ``n_tokens``, the suffix sums ``docs_ge`` and
    ``tokens_ge`` (documents of at least this length), their complements ``docs_lt`` and
    ``tokens_lt``, and ``truncated_tokens``: the tokens left when every document is cut
    to ``length`` tokens.

    Suffix sums have two levels: within a block of lengths, and over the totals of
    the blocks, so that no task sees all distinct lengths.
    """
    # written: both levels read the histogram, and texts are encoded once
    hist = (save(lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")))
            .withColumn("n_tokens", F.col("length") * F.col("n_docs"))
            .withColumn("block", F.floor(F.col("length") / BLOCK)))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("block")
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"),
        F.sum("d").over(all_rows).alias("d_all"),
        F.sum("t").over(all_rows).alias("t_all"))
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    return (hist
            .withColumn("d_in", F.sum("n_docs").over(within))
            .withColumn("t_in", F.sum("n_tokens").over(within))
            .join(blocks, "block")
            .withColumn("docs_ge", F.col("d_in") + F.col("d_later"))
            .withColumn("tokens_ge", F.col("t_in") + F.col("t_later"))
            .select("length", "n_docs", "n_tokens", "docs_ge", "tokens_ge",
                    (F.col("d_all") - F.col("docs_ge")).alias("docs_lt"),
                    (F.col("t_all") - F.col("tokens_ge")).alias("tokens_lt"),
                    (F.col("t_all") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge"))
                    .alias("truncated_tokens")))


def totals(hist: DataFrame) -> DataFrame:
    """One row ``n_docs``, ``n_tokens`` (zeros over no documents)."""
    return hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"),
                    F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """One row ``truncated_tokens``: the tokens left at a context limit of ``limit``."""
    return hist.agg(F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs")), F.lit(0))
                    .alias("truncated_tokens"))


def quantiles(hist: DataFrame, probabilities: list[float]) -> DataFrame:
    """Per probability q the smallest length that at least q of all documents do not exceed."""
    out = None
    n = F.col("docs_ge") + F.col("docs_lt")
    for q in probabilities:
        row = (hist.filter(F.col("docs_lt") + F.col("n_docs") >= F.ceil(F.lit(q) * n))
               .agg(F.min("length").alias("length")).select(F.lit(q).alias("q"), "length"))
        out = row if out is None else out.unionByName(row)
    return out
