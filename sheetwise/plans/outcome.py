"""What is made of a table's results, for every domain: coverage, payload, KPIs and findings.

All of it is driven by the plan and the results of ``analyze``: a result that the plan doesn't
support is in none of them.  Lists are put in order together: rows of all sections get one
sort key form and one distributed rank (``ranking.ranked`` within the section).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.operators import findings as FD
from sheetwise.operators import report as R
from sheetwise.operators.ranking import FIRST, POS, ranked
from sheetwise.plans.analyze import ANALYSES, Analysed, Results
from sheetwise.plans.results import ORDERS

Section = tuple[str, str]  # section of the output, name of the result

# Sections of the payload (PRJ-3), by domain.
PAYLOAD: dict[str, tuple[Section, ...]] = {
    "order": (("overview", "order_overview"), ("product_analysis", "product_sales"), ("category_analysis", "category_sales"),
              ("region_analysis", "region_sales"), ("daily_sales_trend", "daily_sales"), ("monthly_sales_trend", "monthly_sales"),
              ("monthly_order_trend", "monthly_orders"), ("customer_analysis", "customer_summary"), ("top_customers", "top_customers"),
              ("status_analysis", "status_analysis"), ("status_summary", "status_summary"), ("payment_method_analysis", "payment_analysis"),
              ("discount_analysis", "discount_analysis"), ("gender", "gender_profile"), ("age", "age_profile"), ("data_quality", "data_quality")),
    "student_score": (("student_count", "student_count"), ("score_summary", "score_summary"), ("subject_score", "subject_score"),
                      ("class_score", "class_score"), ("student_score", "student_rollup"), ("exam_trend", "exam_trend")),
    "inventory": (("inventory_count", "inventory_count"), ("stock_summary", "stock_summary"), ("low_stock_analysis", "low_stock"),
                  ("inventory_value", "inventory_value"), ("category_stock", "category_stock"), ("warehouse_stock", "warehouse_stock"),
                  ("supplier_stock", "supplier_stock"), ("inventory_flow", "inventory_flow"), ("inventory_trend", "inventory_trend")),
    "generic": (("row_count", "table_shape"), ("column_profile", "column_profile"), ("missing_value_summary", "missing_rate")),
}
# Columns that don't leave the engine: names of customers, contact counters, and in the quality
# part the total of amounts that nothing verifies.
PRIVATE = {"top_customers": ("customer_name",), "customer_rollup": ("customer_name",)}
PRIVATE_QUALITY = ("phone_", "email_", "contact_", "unverified_amount_total")

# What shows that a capability has a result (CTX-1): a result with rows, or with this value.
# ``None`` stands for results that always hold something.
SHOWN: dict[str, dict[str, tuple[str, str | None] | None]] = {
    "order": {"order_count": ("order_count", "order_count"), "product_quantity": ("product_quantity", None), "sales_total": ("sales_summary", None),
              "product_sales": ("product_sales", None), "category_analysis": ("category_sales", None), "region_sales": ("region_sales", None),
              "sales_trend": ("daily_sales", None), "target_completion": ("target_completion", "completion_rate"), "customer_analysis": None,
              "status_analysis": ("status_analysis", None), "payment_method_analysis": ("payment_analysis", None), "discount_analysis": None,
              "demographic_analysis": ("gender_profile", None), "data_quality_analysis": None},
    "student_score": {"student_count": ("student_count", "student_count"), "score_summary": ("score_summary", None),
                      "subject_score": ("subject_score", None), "class_score": ("class_score", None), "student_score": ("student_rollup", None),
                      "exam_trend": ("exam_trend", None)},
    "inventory": {"inventory_count": ("inventory_count", "inventory_count"), "stock_summary": ("stock_summary", None),
                  "low_stock_analysis": ("low_stock", None), "inventory_value": ("inventory_value", None), "category_stock": ("category_stock", None),
                  "warehouse_stock": ("warehouse_stock", None), "supplier_stock": ("supplier_stock", None), "inventory_flow": ("inventory_flow", None),
                  "inventory_trend": ("inventory_trend", None)},
    "generic": {},
}

# KPI labels of the domains' dashboards.
KPIS: dict[str, tuple[tuple[str, tuple[tuple[str, str], ...]], ...]] = {
    "order": (("order_overview", tuple((k, label) for k, label, _ in R.KPI_ORDER)),
              ("customer_summary", (("unique_customer_count", "客户数量"), ("repeat_customer_rate", "复购率"))),
              ("status_summary", (("refund_rate", "退款率"),))),
    "student_score": (("student_count", (("student_count", "学生数量"),)),
                      ("score_summary", (("average", "平均分"), ("maximum", "最高分"), ("minimum", "最低分"), ("median", "中位数")))),
    "inventory": (("inventory_count", (("inventory_count", "商品数量"),)),
                  ("stock_summary", (("total", "库存总量"), ("average", "平均库存"), ("maximum", "最大库存"), ("minimum", "最小库存"))),
                  ("inventory_value", (("total", "库存价值"),))),
    "generic": (("table_shape", (("row_count", "数据行数"), ("column_count", "字段数量"))),),
}
NO_RESULT = "未产生可用计算结果"
# End of fixed values.

LONG = "section string, rank long, col_no int, field string, value_text string, value_num double"


def all_results(rows: DataFrame, domain: str) -> Results:
    """Every analysis of a domain over rows in its canonical form, without a plan."""
    return Results(rows, {name: run for own in ANALYSES[domain].values() for name, run in own.items()})


def _values(df: DataFrame, columns: list[tuple[str, str]]) -> list[Column]:
    """A row's cells as two arrays in column order, texts and numbers: a cell is null in the other one."""
    numeric = [isinstance(df.schema[name].dataType, T.NumericType) for _, name in columns]
    texts = [F.lit(None).cast("string") if n else F.col(name).cast("string") for n, (_, name) in zip(numeric, columns)]
    numbers = [F.col(name).cast("double") if n else F.lit(None).cast("double") for n, (_, name) in zip(numeric, columns)]
    return [F.array(*texts).alias("texts"), F.array(*numbers).alias("numbers")]


def _sort_key(df: DataFrame, keys: list[Column]) -> list[Column]:
    """Sort keys of any list in one form: number, text, number."""
    kinds = [df.select(k.alias("k")).schema["k"].dataType for k in keys]
    numbers = [k.cast("double") for k, kind in zip(keys, kinds) if isinstance(kind, T.NumericType)]
    texts = [k for k, kind in zip(keys, kinds) if not isinstance(kind, T.NumericType)]
    last = [F.lit(None).cast("double")] * 2
    first, third = [*numbers, *last][:2]
    return [first.alias("_k0"), (texts[0] if texts else F.lit(None).cast("string")).alias("_k1"), third.alias("_k2")]


def ordered_sections(parts: list[tuple[str, str, DataFrame, list[tuple[str, str]]]], spark: SparkSession) -> DataFrame:
    """Lists ``(section, result name, rows, [(field, column)])`` as one table of cells, one row each,
    with the rank of their row in its section.  Rows are sorted with their values only; the names of
    the fields, the same for all rows of a part, come afterwards."""
    shaped = []
    for i, (section, name, df, columns) in enumerate(parts):
        keys = ORDERS[name](df) if name in ORDERS else [F.lit(0)]
        shaped.append(df.select(F.lit(section).alias("section"), F.lit(i).alias("_part"), *_sort_key(df, keys), *_values(df, columns)))
    if not shaped:
        return spark.createDataFrame([], LONG)
    every = shaped[0]
    for part in shaped[1:]:
        every = every.unionByName(part)
    placed = ranked(every, [F.col("_k0"), F.col("_k1"), F.col("_k2")], within=["section"])
    fields = F.array(*[F.array(*[F.lit(field) for field, _ in columns]) for _, _, _, columns in parts])
    cells = F.arrays_zip(fields[F.col("_part")].alias("field"), F.col("texts").alias("value_text"), F.col("numbers").alias("value_num"))
    return placed.select("section", "rank", F.posexplode(cells).alias("col_no", "c")).select("section", "rank", "col_no", "c.*")


def _public(name: str, df: DataFrame) -> list[tuple[str, str]]:
    hidden = (*PRIVATE.get(name, ()), FIRST, POS)
    cols = [c for c in df.columns if c not in hidden]
    if name == "data_quality":
        cols = [c for c in cols if not c.startswith(PRIVATE_QUALITY)]
    return [(c, c) for c in cols]


def result_payload(results: Mapping[str, DataFrame], domain: str, spark: SparkSession) -> DataFrame:
    """The results that may leave the engine (PRJ-3), less the private columns."""
    parts = [(section, name, results[name], _public(name, results[name])) for section, name in PAYLOAD[domain] if name in results]
    return ordered_sections(parts, spark)


def payload(a: Analysed) -> DataFrame:
    """PRJ-3 for an analysed table: the selected domain, its available fields, the plan and the results."""
    spark = a.table.sparkSession
    facts = [("selected_module", 1, 0, "id", a.domain, None)]
    facts += [("available_fields", i + 1, 0, "name", name, None) for i, name in enumerate(a.available)]
    for i, item in enumerate(sorted(a.plan, key=lambda r: r["cap_order"])):
        for j, (field, value) in enumerate((("id", item["capability_id"]), ("name", item["capability_name"]),
                                            ("supported", str(item["supported"]).lower()), ("missing_fields", item["missing_fields"]))):
            facts.append(("analysis_plan", i + 1, j, field, value, None))
    return spark.createDataFrame(facts, LONG).unionByName(result_payload(a.results, a.domain, spark))


def coverage(a: Analysed) -> DataFrame:
    """CTX-1: a capability is covered if it is planned as supported and its result holds something.

    The generic domain has one result for all of its capabilities, listed as ``generic_analysis``; its plan's own
    entries count as skipped.
    """
    spark = a.table.sparkSession
    rows = []
    for item in sorted(a.plan, key=lambda r: r["cap_order"]):
        shown = SHOWN[a.domain].get(item["capability_id"], ())
        if not item["supported"] or shown == ():
            held = F.lit(False)
        elif shown is None:
            held = F.lit(True)
        else:
            held = _holds(a.results, *shown)
        if item["capability_id"] == "demographic_analysis" and item["supported"] and "gender" not in a.table.columns:
            held = _holds(a.results, "age_profile", None)
        rows.append(F.struct(F.lit(item["cap_order"]).cast("int").alias("position"), F.lit(item["capability_id"]).alias("capability_id"),
                             F.lit(item["capability_name"]).alias("capability_name"), F.coalesce(held, F.lit(False)).alias("covered"),
                             F.lit(item["missing_fields"] or "").alias("missing_fields"), F.lit(item["reason"]).alias("reason")))
    if a.domain == "generic":
        rows.append(F.struct(F.lit(len(rows)).cast("int").alias("position"), F.lit("generic_analysis").alias("capability_id"),
                             F.lit(None).cast("string").alias("capability_name"), F.lit(True).alias("covered"), F.lit("").alias("missing_fields"),
                             F.lit(None).cast("string").alias("reason")))
    c = spark.range(1).select(F.explode(F.array(*rows)).alias("c")).select("c.*")
    return c.select("position", "capability_id", "capability_name", "covered",
                    F.when(~F.col("covered"), F.col("missing_fields")).alias("missing_fields"),
                    F.when(~F.col("covered"), F.coalesce("reason", F.lit(NO_RESULT))).alias("reason"))


def _holds(results: Mapping[str, DataFrame], name: str, value: str | None) -> Column:
    df = results[name]
    return df.agg(F.count(F.lit(1) if value is None else F.col(value)) > 0).scalar()


def kpis(a: Analysed) -> DataFrame:
    """RPT-7 for any domain: the dashboard's figures that there are, and for orders the quality
    counters above zero."""
    out = a.table.sparkSession.createDataFrame([], R.LONG_SCHEMA)
    for name, labels in KPIS[a.domain]:
        if name in a.results:
            out = out.unionByName(R._metric_rows(a.results[name], "kpi", labels))
    if a.domain == "order" and "data_quality" in a.results:
        out = out.unionByName(R.quality_warnings(a.results["data_quality"]))
    return out


def findings(a: Analysed) -> DataFrame:
    """The domain's findings (FND-1, FND-3, FND-4, FND-5) over the supported results."""
    if a.domain == "order":
        return FD.order_findings(a.results)
    if a.domain == "student_score":
        return FD.score_findings(a.results)
    if a.domain == "inventory":
        return FD.inventory_findings(a.results)
    from sheetwise.operators.profile import generic_findings
    return generic_findings(a.table.drop(POS))
