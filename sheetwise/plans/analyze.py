"""One uploaded table from its raw cells to the results its columns support.

Missing tokens and cleaning, canonical headers (with the user's overrides), the table's
domain, its capability plan, and then only the supported analyses.  Only header-sized
facts reach the driver (names, counts of filled cells, the plan); every result is a lazy
DataFrame over the written canonical rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sheetwise.operators import inventory as I
from sheetwise.operators import orders as O
from sheetwise.operators import profile as P
from sheetwise.operators import scores as S
from sheetwise.operators.cleaning import POS, cleaned
from sheetwise.plans.domains import Domain, capability_plan, domain_choice
from sheetwise.plans.mapping import canonicalize
from sheetwise.plans.results import in_order
from sheetwise.session import materialize, tasks_for

Analysis = Callable[[DataFrame], DataFrame]

# Results of each capability, by domain: what is computed when the plan supports it.
ANALYSES: dict[str, dict[str, dict[str, Analysis]]] = {
    "order": {
        "order_count": {"order_count": O.order_count},
        "product_quantity": {"product_quantity": O.product_quantity},
        "product_sales": {"product_sales": O.product_sales},
        "category_analysis": {"category_sales": O.category_sales},
        "sales_total": {"order_overview": O.order_overview, "sales_summary": O.sales_summary, "sales_volatility": O.sales_volatility},
        "region_sales": {"region_sales": O.region_sales, "region_ranking": O.region_ranking, "region_performance": O.region_performance},
        "sales_trend": {"daily_sales": O.daily_sales, "monthly_sales": O.monthly_sales, "monthly_orders": O.monthly_orders, "growth_rate": O.growth_rate},
        "target_completion": {"target_completion": O.target_completion},
        "customer_analysis": {"customer_rollup": O.customer_rollup, "top_customers": O.top_customers, "customer_summary": O.customer_summary},
        "status_analysis": {"status_analysis": O.status_analysis, "status_summary": O.status_summary},
        "payment_method_analysis": {"payment_analysis": O.payment_analysis},
        "discount_analysis": {"discount_analysis": O.discount_analysis},
        "demographic_analysis": {"gender_profile": O.gender_profile, "age_profile": O.age_profile},
        "data_quality_analysis": {"data_quality": O.data_quality},
        "refund_analysis": {"status_amounts": O.status_amounts},
    },
    "student_score": {
        "student_count": {"student_count": S.student_count},
        "score_summary": {"score_summary": S.score_summary},
        "subject_score": {"subject_score": S.subject_score},
        "class_score": {"class_score": S.class_score},
        "student_score": {"student_rollup": S.student_rollup},
        "exam_trend": {"exam_trend": S.exam_trend},
    },
    "inventory": {
        "inventory_count": {"inventory_count": I.inventory_count},
        "stock_summary": {"stock_summary": I.stock_summary},
        "low_stock_analysis": {"low_stock": I.low_stock},
        "inventory_value": {"inventory_value": I.inventory_value},
        "category_stock": {"category_stock": I.category_stock},
        "warehouse_stock": {"warehouse_stock": I.warehouse_stock},
        "supplier_stock": {"supplier_stock": I.supplier_stock},
        "inventory_flow": {"inventory_flow": I.inventory_flow},
        "inventory_trend": {"inventory_trend": I.inventory_trend},
    },
    "generic": {
        "row_count": {"table_shape": P.table_shape},
        "column_profile": {"column_profile": P.column_profile},
        "missing_value_analysis": {"missing_rate": P.missing_rate},
    },
}


class Results(Mapping):
    """Results by name; an analysis is planned (and what it writes is written) at first use."""

    def __init__(self, rows: DataFrame, analyses: dict[str, Analysis]):
        self._rows, self._analyses, self._done = rows, analyses, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._done:
            self._done[name] = self._analyses[name](self._rows)
        return self._done[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._analyses)

    def __len__(self) -> int:
        return len(self._analyses)


@dataclass(frozen=True)
class Analysed:
    """``table`` is the canonical table (of orders: not written, its deduplicated rows are), ``available`` its columns with a filled cell; ``plan`` has
    a row for each capability of the domain;
    ``results`` holds the supported ones by name, each computed when it is asked for."""

    domain: str
    score: float
    plan: list[Row]
    table: DataFrame
    available: list[str]
    results: Mapping[str, DataFrame]

    def result(self, name: str) -> DataFrame:
        """A result with the ``rank`` of its rows, if it is a list."""
        return in_order(name, self.results[name])


def _columns(names: list[str], filled: Row | None = None) -> list[tuple[int, int, str, int]]:
    """The table as a catalogue of dataset 0, with the number of filled cells of each column."""
    return [(0, i, c, filled[i] if filled else 0) for i, c in enumerate(names)]


def analyze(df: DataFrame, overrides: dict[str, str] | None = None, domains: list[Domain] | None = None,
            analyses: dict[str, dict[str, dict[str, Analysis]]] = ANALYSES, tasks: int | None = None,
            lot: str | None = None) -> Analysed:
    """Clean, map, choose, plan and analyse one table.

    ``domains`` (with capabilities) and ``analyses`` take a plug-in's entries.  A ``_pos``
    column (row position) is kept throughout, so first-row rules hold.  The domain follows from the
    headers; the rows of an order table are dealt over ``tasks`` once (by default as many as their
    number asks for), deduplicated where cleaning left them, and written once.  ``lot`` names a
    column beside the cells by which the rows are dealt already, the same for rows that are equal
    once cleaned: such rows aren't dealt again.
    """
    deal, df = df, df.drop(lot) if lot else df
    spark, schema = df.sparkSession, "dataset_id long, pos int, name string, non_null long"
    table = canonicalize(cleaned(df), overrides)
    names = [c for c in table.columns if c != POS]
    choice = materialize(domain_choice(spark.createDataFrame(_columns(names), schema), domains))
    chosen = choice.first()
    if chosen["domain"] == "order":
        if lot:
            dealt = cleaned(deal, lot=lot).toDF(*table.columns, lot)
        else:
            dealt = cleaned(df, tasks or tasks_for(df)).toDF(*table.columns)
        rows = materialize(O.order_rows(dealt).drop(*([lot] if lot else [])))
    else:
        rows = table = materialize(table)
    counted = _columns(names, rows.agg(*[F.count(F.col(f"`{c}`")) for c in names]).first())
    plan = capability_plan(spark.createDataFrame(counted, schema), choice, domains).collect()
    own = analyses.get(chosen["domain"], {})
    supported = {name: run for item in plan if item["supported"] for name, run in own.get(item["capability_id"], {}).items()}
    return Analysed(chosen["domain"], chosen["score"], plan, table,
                    [name for _, _, name, filled in counted if filled], Results(rows, supported))
