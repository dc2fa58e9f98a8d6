"""Result order as data (SRT-1 .. SRT-3) and exact medians, without a task that sees all rows.

*Ranks.*  Rows are dealt into ranges of their sort key, sorted within a range and written; a
row's place in its range comes with the write.  The sizes of the ranges, summed in order, are
the offsets: as many numbers as there are partitions.  The same write gives ranks within
groups: a group's rows follow each other, so its first rank is subtracted.

*Medians.*  Values are counted first (one row for each different value, combined map-side), the
counted values are dealt into ranges like ranks are, and only the range that holds a middle value is
looked at value by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.session import materialize

POS = "_pos"
FIRST = "_first"
_IN_RANGE = (1 << 33) - 1  # monotonically_increasing_id: range number above 33 bits of place


def _ranged(df: DataFrame, keys: list[Column]) -> DataFrame:
    """``df`` written in ranges of ``keys``, with ``_range`` and the place in it, ``_at`` (from 0)."""
    named = {f"_key{i}": k for i, k in enumerate(keys)}
    sorted_ = df.withColumns(named).repartitionByRange(*named).sortWithinPartitions(*named)
    at = F.monotonically_increasing_id()
    return materialize(sorted_.withColumn("_id", at).select(
        *df.columns, F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND(F.lit(_IN_RANGE)).alias("_at")))


def _offsets(sizes: DataFrame, size: str) -> DataFrame:
    """``sizes`` (one row a range) with ``_before``, the sum over the ranges in front."""
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_before", F.coalesce(F.sum(size).over(before), F.lit(0)))


def ranked(df: DataFrame, keys: list[Column], within: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` with its place (from 1) in the order of ``keys``, in each group of ``within`` if given.

    Keys are ascending columns (negate numbers for descending order); rows with equal keys get
    different places in no stated order, so keys should be unique.
    """
    group = [F.col(c) for c in within or []]
    ranged = _ranged(df, [*group, *keys])
    offsets = _offsets(ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size")), "_size").select("_range", "_before")
    placed = ranged.join(offsets, "_range").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")
    if within:
        first = placed.groupBy(*within).agg(F.min(name).alias("_first"))
        same = None
        for c in within:
            equal = F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}"))
            same = equal if same is None else same & equal
        placed = (placed.alias("p").join(first.alias("f"), same)
                  .select(*[F.col(f"p.{c}") for c in df.columns], (F.col(f"p.{name}") - F.col("f._first") + 1).alias(name)))
    return placed.select(F.col(name).cast("long").alias(name), *df.columns)


def descending(column: str) -> Column:
    """Sort key for large values first, where a missing value counts as zero."""
    return -F.coalesce(F.col(column), F.lit(0)).cast("double")


def first_seen(df: DataFrame) -> list[Column]:
    """SRT-3: aggregate for the first row of a group, where rows have positions."""
    return [F.min(POS).alias(FIRST)] if POS in df.columns else []


def value_counts(df: DataFrame, value: Column) -> DataFrame:
    """The different non-null values with the number of their rows, ``(value, n)``, written."""
    return materialize(df.select(value.alias("value")).where(F.col("value").isNotNull())
                       .groupBy("value").agg(F.count(F.lit(1)).alias("n")))


def median_of_counts(counts: DataFrame) -> DataFrame:
    """One row ``(median)`` of ``(value, n)``: the middle value, or the mean of the two middle
    ones; null if there are none."""
    ranged = _ranged(counts, [F.col("value")])
    sizes = _offsets(ranged.groupBy("_range").agg(F.sum("n").alias("_size")), "_size")
    total = sizes.agg(F.sum("_size")).scalar()
    low, high = F.floor((total - 1) / 2).cast("long"), F.floor(total / 2).cast("long")  # places from 0
    held = sizes.where((F.col("_before") <= high) & (F.col("_before") + F.col("_size") > low)).select("_range", "_before")
    # of the (at most two) ranges that hold a middle place: the values around it
    up_to = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.join(held, "_range").withColumn("_end", F.col("_before") + F.sum("n").over(up_to))
    middle = inside.where((F.col("_end") > low) & (F.col("_end") - F.col("n") <= high))
    return middle.agg(((F.min("value").cast("double") + F.max("value").cast("double")) / 2).alias("median"))


def median(df: DataFrame, value: Column) -> DataFrame:
    """One row ``(median)``: the exact median of the non-null values."""
    return median_of_counts(value_counts(df, value))
