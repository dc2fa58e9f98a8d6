"""Inventory analyses (INV-1 .. INV-9).

Row values are coerced with ``to_number`` (text or typed input); every sum is
taken over values brought to an exact DECIMAL first, so totals do not depend
on the order in which partitions are combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.columns import MONEY_WORK, has, money, non_empty, strip, to_number
from sheetwise.functions.normalize import day_key, parse_dates
from sheetwise.operators.ranking import POS, median_of_counts, value_counts


def exact(c: Column) -> Column:
    return c.try_cast(MONEY_WORK)


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def inventory_count(df: DataFrame) -> DataFrame:
    """INV-1: distinct trimmed product ids; names when no id is filled; else 0."""
    def distinct(col: str) -> Column:
        if not has(df, col):
            return F.lit(0).cast("long")
        return df.where(non_empty(df, col)).select(strip(F.col(col).cast("string")).alias("v")).distinct().agg(F.count("v")).scalar()
    ids = distinct("product_id")
    return df.sparkSession.range(1).select(F.when(ids > 0, ids).otherwise(distinct("product_name")).alias("inventory_count"))


def stock_summary(df: DataFrame) -> DataFrame:
    """INV-2: count, total, mean, max, min, median of stock; no row if none parses."""
    # everything follows from the different values and how often they occur
    counts = value_counts(df, to_number(df, "stock_quantity"))
    v, n = F.col("value"), F.col("n")
    total, rows = F.sum(exact(v) * n), F.sum(F.when(exact(v).isNotNull(), n))
    a = counts.agg(F.sum(n).alias("count"), money(total).alias("total"), money(exact(total) / rows).alias("average"),
                   money(F.max(v)).alias("maximum"), money(F.min(v)).alias("minimum"),
                   money(median_of_counts(counts).scalar()).alias("median"))
    return a.where(F.col("count") > 0)


def _paired(df: DataFrame, left: str, right: str) -> DataFrame | None:
    if not (has(df, left) and has(df, right)):
        return None
    out = df.withColumns({"_left": to_number(df, left), "_right": to_number(df, right)})
    return out.where(F.col("_left").isNotNull() & F.col("_right").isNotNull())


def _label(df: DataFrame, col: str) -> Column:
    return F.when(non_empty(df, col), strip(F.col(col).cast("string"))) if has(df, col) else F.lit(None).cast("string")


def low_stock(df: DataFrame) -> DataFrame:
    """INV-3: rows with stock below safety stock and their shortage (all of them)."""
    rows = _paired(df, "stock_quantity", "safety_stock")
    if rows is None:
        return _empty(df, "product_id string, product_name string, stock_quantity double, safety_stock double, shortage double")
    low = rows.where(F.col("_left") < F.col("_right"))
    return low.select(
        _label(df, "product_id").alias("product_id"), _label(df, "product_name").alias("product_name"),
        money(F.col("_left")).alias("stock_quantity"), money(F.col("_right")).alias("safety_stock"),
        money(F.col("_right") - F.col("_left")).alias("shortage"),
        *([POS] if POS in df.columns else []),
    )


def low_stock_sorted(df: DataFrame) -> DataFrame:
    """INV-3 in report order: −shortage, then id or name."""
    r = low_stock(df)
    return r.orderBy(F.desc("shortage"), F.coalesce("product_id", "product_name", F.lit("")))


def inventory_value(df: DataFrame) -> DataFrame:
    """INV-4: stock × unit cost: count, total and mean."""
    rows = _paired(df, "stock_quantity", "unit_cost")
    if rows is None:
        return _empty(df, "count long, total double, average double")
    v = exact(F.col("_left").cast("double") * F.col("_right").cast("double"))
    a = rows.agg(F.count(v).alias("count"), money(F.sum(v)).alias("total"), money(F.avg(v)).alias("average"))
    return a.where(F.col("count") > 0)


def group_stock(df: DataFrame, column: str) -> DataFrame:
    """INV-5..7: stock per trimmed, non-empty group label."""
    if not (has(df, column) and has(df, "stock_quantity")):
        return _empty(df, "name string, value double")
    # summed by the cell as it stands first: a label is stripped once for each different text
    s = to_number(df, "stock_quantity")
    cells = df.where(s.isNotNull()).groupBy(column).agg(F.sum(exact(s)).alias("_sum"))
    # a filter on the label itself would move below the first sum and strip every row's
    g = cells.groupBy(strip(F.col(column).cast("string")).alias("name")).agg(
        money(F.sum("_sum")).alias("value"), F.count_if(non_empty(cells, column)).alias("_named"))
    return g.where(F.col("_named") > 0).drop("_named")


def category_stock(df: DataFrame) -> DataFrame:
    return group_stock(df, "category")


def warehouse_stock(df: DataFrame) -> DataFrame:
    return group_stock(df, "warehouse")


def supplier_stock(df: DataFrame) -> DataFrame:
    return group_stock(df, "supplier")


def inventory_flow(df: DataFrame) -> DataFrame:
    """INV-8: inbound, outbound and net change over rows where both parse."""
    rows = _paired(df, "inbound_quantity", "outbound_quantity")
    if rows is None:
        return _empty(df, "total_inbound double, total_outbound double, net_change double")
    a = rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(exact(F.col("_left"))), 2).alias("i"),
                 F.round(F.sum(exact(F.col("_right"))), 2).alias("o"))
    return a.where(F.col("n") > 0).select(
        F.col("i").cast("double").alias("total_inbound"), F.col("o").cast("double").alias("total_outbound"),
        money(F.col("i") - F.col("o")).alias("net_change"))


def inventory_trend(df: DataFrame) -> DataFrame:
    """INV-9: stock per day, ascending (days from the mixed-format date parse)."""
    if not (has(df, "inventory_date") and has(df, "stock_quantity")):
        return _empty(df, "name string, value double")
    # summed by the cell as it stands first: a date is parsed once for each different text
    s = to_number(df, "stock_quantity")
    cells = df.where(s.isNotNull()).groupBy("inventory_date").agg(F.sum(exact(s)).alias("_sum"))
    d = parse_dates(cells, "inventory_date")
    # a filter on the date itself would move below the first sum and parse every row
    g = cells.groupBy(day_key(d).alias("name")).agg(money(F.sum("_sum")).alias("value"), F.count(d).alias("_dated"))
    return g.where(F.col("_dated") > 0).drop("_dated")
