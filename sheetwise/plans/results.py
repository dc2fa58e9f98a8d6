"""Order of every result list (SRT-1 .. SRT-3): sort keys by result name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.operators.ranking import FIRST, POS, descending, ranked

Keys = Callable[[DataFrame], list[Column]]


def _largest(metric: str, name: str = "name") -> Keys:
    return lambda df: [descending(metric), F.col(name)]


def _ascending(name: str = "name") -> Keys:
    return lambda df: [F.col(name)]


def _appearance(df: DataFrame) -> list[Column]:
    return [*([F.col(FIRST)] if FIRST in df.columns else []), F.col("name")]


def _shortage(df: DataFrame) -> list[Column]:
    label = F.coalesce("product_id", "product_name", F.lit(""))
    rest = [F.col(POS)] if POS in df.columns else [F.col(c) for c in ("product_name", "stock_quantity", "safety_stock")]
    return [descending("shortage"), label, *rest]


ORDERS: dict[str, Keys] = {
    "product_sales": _largest("sales_amount"),
    "category_sales": _largest("sales_amount", "category"),
    "region_sales": _largest("region_sales"),
    "region_performance": _largest("sales_amount"),
    "product_quantity": _largest("value"),
    "status_analysis": _largest("order_count"),
    "payment_analysis": _largest("sales_amount"),
    "customer_rollup": _largest("sales_amount", "customer_id"),
    "top_customers": _largest("sales_amount", "customer_id"),
    "gender_profile": _appearance,
    "age_profile": _appearance,
    "daily_sales": _ascending(),
    "monthly_sales": _ascending(),
    "monthly_orders": _ascending(),
    "subject_score": _largest("average"),
    "class_score": _largest("average"),
    "student_rollup": _largest("average", "student_id"),
    "exam_trend": _appearance,
    "low_stock": _shortage,
    "category_stock": _largest("value"),
    "warehouse_stock": _largest("value"),
    "supplier_stock": _largest("value"),
    "inventory_trend": _ascending(),
}

_INTERNAL = (FIRST, POS)


def in_order(name: str, result: DataFrame) -> DataFrame:
    """A result list with its ``rank``; other results as they are."""
    out = ranked(result, ORDERS[name](result)) if name in ORDERS else result
    return out.drop(*_INTERNAL)
