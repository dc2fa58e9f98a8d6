"""Student-score analyses (STU-1 .. STU-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.columns import MONEY_WORK, has, money, non_empty, strip, to_number
from sheetwise.functions.normalize import day_key, parse_dates
from sheetwise.operators.ranking import FIRST, POS, median_of_counts, value_counts
from sheetwise.session import materialize



def _score(df: DataFrame) -> Column:
    return to_number(df, "score")


def _stats(s: Column, count_name: str = "count") -> list[Column]:
    return [F.count(s).alias(count_name), money(F.avg(s.try_cast(MONEY_WORK))).alias("average"),
            money(F.max(s)).alias("maximum"), money(F.min(s)).alias("minimum")]


# Columns of ``_stats``, for results of tables without the columns they need.
_STATS = "count long, average double, maximum double, minimum double"


def student_count(df: DataFrame) -> DataFrame:
    """STU-1: distinct non-empty student ids (compared as written, not trimmed)."""
    if not has(df, "student_id"):
        return df.agg(F.lit(0).cast("long").alias("student_count"))
    return df.agg(F.count_distinct(F.when(non_empty(df, "student_id"), F.col("student_id").cast("string")))
                  .alias("student_count"))


def score_summary(df: DataFrame) -> DataFrame:
    """STU-2: count, mean, max, min, median of parsed scores; no row if none."""
    counts = value_counts(df, _score(df))  # everything follows from the different values
    v, n = F.col("value"), F.col("n")
    exact = v.try_cast(MONEY_WORK)
    mean = F.sum(exact * n).try_cast(MONEY_WORK) / F.sum(F.when(exact.isNotNull(), n))
    a = counts.agg(F.sum(n).alias("count"), money(mean).alias("average"), money(F.max(v)).alias("maximum"),
                   money(F.min(v)).alias("minimum"), money(median_of_counts(counts).scalar()).alias("median"))
    return a.where(F.col("count") > 0)


def group_score(df: DataFrame, column: str) -> DataFrame:
    """STU-3/4: score statistics per trimmed, non-empty label."""
    if not (has(df, column) and has(df, "score")):
        return df.sparkSession.createDataFrame([], f"name string, {_STATS}")
    s = _score(df)
    rows = df.where(s.isNotNull() & non_empty(df, column))
    return rows.groupBy(strip(F.col(column).cast("string")).alias("name")).agg(*_stats(s))


def subject_score(df: DataFrame) -> DataFrame:
    return group_score(df, "subject")


def class_score(df: DataFrame) -> DataFrame:
    return group_score(df, "class_name")


def student_rollup(df: DataFrame) -> DataFrame:
    """STU-5: per trimmed student id: statistics and the first non-empty name."""
    if not (has(df, "student_id") and has(df, "score")):
        return df.sparkSession.createDataFrame([], f"student_id string, score_{_STATS}, student_name string")
    s = _score(df)
    rows = df.where(s.isNotNull() & non_empty(df, "student_id"))
    if has(df, "student_name"):
        name = F.when(non_empty(df, "student_name"), strip(F.col("student_name").cast("string")))
        first = F.min_by(name, F.when(name.isNotNull(), F.col(POS))) if POS in df.columns else F.min(name)
        extra = [first.alias("student_name")]
    else:
        extra = []
    return rows.groupBy(strip(F.col("student_id").cast("string")).alias("student_id")).agg(
        *_stats(s, "score_count"), *extra)


def exam_trend(df: DataFrame) -> DataFrame:
    """STU-6: mean score per exam date, ascending; when no date parses, per exam name in order
    of first appearance.  ``_first`` is the sort key.

    One pass sums the scores by date and name; both branches and the choice between them
    read these sums.
    """
    s = _score(df)
    exact = s.try_cast(MONEY_WORK)
    if not (has(df, "exam_date") or has(df, "exam_name")):
        return df.sparkSession.createDataFrame([], f"name string, average double, count long, {FIRST} long")
    day = day_key(parse_dates(df, "exam_date")) if has(df, "exam_date") else F.lit(None).cast("string")
    name = F.when(non_empty(df, "exam_name"), strip(F.col("exam_name").cast("string"))) if has(df, "exam_name") else F.lit(None).cast("string")
    position = F.col(POS) if has(df, POS) else F.lit(None).cast("long")
    sums = materialize(df.where(s.isNotNull()).groupBy(day.alias("day"), name.alias("exam"))
                       .agg(F.sum(exact).alias("total"), F.count(exact).alias("n"), F.count(s).alias("count"), F.min(position).alias("position")))
    by_date = sums.agg(F.coalesce(F.bool_or(F.col("day").isNotNull()), F.lit(False))).scalar()
    average = money(F.sum("total").try_cast(MONEY_WORK) / F.sum("n")).alias("average")
    dated = (sums.where(F.col("day").isNotNull() & by_date).groupBy(F.col("day").alias("name"))
             .agg(average, F.sum("count").alias("count"))
             .withColumn(FIRST, F.unix_date(F.to_date("name", "yyyy-MM-dd")).cast("long")))
    named = (sums.where(F.col("exam").isNotNull() & ~by_date).groupBy(F.col("exam").alias("name"))
             .agg(average, F.sum("count").alias("count"), F.min("position").cast("long").alias(FIRST)))
    return dated.unionByName(named)
