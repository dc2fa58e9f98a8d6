"""Report tables as long DataFrames (RPT-1 .. RPT-7, CTX-1).

A report section is stored long: ``(section, row_key, col_no, header,
value_text, value_num)``, one row per cell.  Rows are identified by their
natural key (product name, day, ...), not by a global row number, so building
a section never funnels a large result through one task; presentation order is
restored by sorting on the section's key at export time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.operators import inventory as I
from sheetwise.operators import orders as O
from sheetwise.operators import scores as S

LONG_SCHEMA = "section string, row_key string, col_no int, header string, value_text string, value_num double"

# ---------------------------------------------------------------------------
# Report titles, headers and labels.
ORDER_OVERVIEW_LABELS = (
    ("record_count", "记录数"), ("order_count", "订单数量"), ("verified_sales_total", "已验证销售额总计"),
    ("verified_order_count", "已验证订单数"), ("amount_verification_rate", "金额验证覆盖率（%）"),
    ("no_usable_amount_order_count", "无可用金额订单数"), ("average_verified_order_value", "已验证平均客单价"),
    ("maximum_verified_order_value", "最大已验证订单金额"), ("minimum_verified_order_value", "最小已验证订单金额"),
    ("median_verified_order_value", "已验证订单金额中位数"), ("unverified_order_count", "未验证金额订单数"),
    ("unverified_amount_total", "未验证原始金额总计"), ("amount_comparable_count", "可比较金额订单数"),
    ("amount_mismatch_count", "金额不一致记录数"), ("amount_mismatch_rate", "金额不一致率"),
    ("completed_sales_amount", "已完成订单已验证金额"), ("cancelled_order_amount", "已取消订单已验证金额"),
    ("refund_related_amount", "退款相关订单已验证金额"),
)
BASIS_LABEL = "统计口径"
BASIS_TEXT = ("销售金额优先采用单价 × 数量 × 有效折扣计算得到的可验证金额；"
              "仅存在原始订单金额且无法验证的记录不计入已验证销售额。")
STUDENT_OVERVIEW_LABELS = (("count", "有效成绩数量"), ("average", "平均分"), ("median", "中位数"),
                           ("maximum", "最高分"), ("minimum", "最低分"))
INVENTORY_OVERVIEW_LABELS = (("count", "有效库存记录数"), ("total", "库存总量"), ("average", "平均库存"),
                             ("maximum", "最大库存"), ("minimum", "最小库存"), ("median", "库存中位数"))
ORDER_SECTIONS = (
    ("product_sales", "商品销售分析", "name", (("商品", "name"), ("订单数", "order_count"), ("销量", "quantity"),
                                             ("已验证销售额", "sales_amount"))),
    ("category_sales", "品类销售分析", "category", (("品类", "category"), ("订单数", "order_count"), ("销量", "quantity"),
                                                  ("已验证销售额", "sales_amount"), ("销售占比", "sales_share"))),
    ("region_sales", "地区销售分析", "name", (("地区", "name"), ("订单数", "region_order_count"),
                                            ("销量", "region_quantity"), ("已验证销售额", "region_sales"),
                                            ("已验证平均客单价", "region_average_order_value"))),
    ("status_analysis", "订单状态分析", "name", (("状态", "name"), ("订单数", "order_count"),
                                               ("已验证订单金额", "sales_amount"), ("订单占比", "share"))),
    ("payment_analysis", "支付方式分析", "name", (("支付方式", "name"), ("订单数", "order_count"),
                                                ("已验证订单金额", "sales_amount"), ("订单占比", "order_share"),
                                                ("销售额占比", "sales_share"))),
    ("top_customers", "客户复购分析", "customer_id", (("客户编号", "customer_id"), ("订单数", "order_count"),
                                                    ("已验证销售额", "sales_amount"))),
    ("daily_sales", "日销售趋势", "name", (("日期", "name"), ("数值", "value"))),
    ("monthly_sales", "月度销售趋势", "name", (("月份", "name"), ("数值", "value"))),
    ("monthly_orders", "月度订单趋势", "name", (("月份", "name"), ("数值", "value"))),
)
QUALITY_LABELS = {
    "contact_complete_rate": "联系方式完整率(%)", "contact_complete_count": "联系方式完整记录数",
    "phone_invalid_count": "无效联系方式数", "email_invalid_count": "无效邮箱数",
    "phone_missing_count": "缺失联系方式数", "email_missing_count": "缺失邮箱数",
}
KPI_ORDER = (("order_count", "订单数量", "笔"), ("verified_sales_total", "已验证销售额", ""),
             ("average_verified_order_value", "已验证平均客单价", ""), ("amount_verification_rate", "金额验证覆盖率", "%"))
QUALITY_WARNINGS = (
    ("duplicate_row_count", "重复记录"), ("duplicate_order_id_count", "重复订单号"), ("invalid_date_count", "无效日期"),
    ("invalid_unit_price_count", "异常单价"), ("invalid_quantity_count", "异常数量"), ("invalid_discount_count", "异常折扣"),
    ("amount_mismatch_count", "金额不一致"), ("phone_invalid_count", "无效联系方式"), ("email_invalid_count", "无效邮箱"),
    ("phone_missing_count", "联系方式缺失"), ("email_missing_count", "邮箱缺失"), ("unverified_order_count", "无法验证金额订单"),
)
MISSING_FIELDS_TEXT = ("缺少 ", " 字段")
NO_RESULT_TEXT = "未生成可用计算结果"
# End of fixed values.
# ---------------------------------------------------------------------------


def _cell(df: DataFrame, name: str, header: str, col_no: int) -> Column:
    dtype = df.schema[name].dataType
    numeric = isinstance(dtype, T.NumericType)
    return F.struct(F.lit(col_no).alias("col_no"), F.lit(header).alias("header"),
                    (F.lit(None).cast("string") if numeric else F.col(name).cast("string")).alias("value_text"),
                    (F.col(name).cast("double") if numeric else F.lit(None).cast("double")).alias("value_num"))


def to_long(df: DataFrame, section: str, key: str, columns) -> DataFrame:
    """Wide result -> long cells; ``columns`` is a sequence of (header, column)."""
    cells = F.array(*[_cell(df, c, h, i) for i, (h, c) in enumerate(columns)])
    return df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("row_key"),
                     F.explode(cells).alias("c")).select("section", "row_key", "c.*")


def _metric_rows(one_row: DataFrame, section: str, labels) -> DataFrame:
    """One-row metrics -> (label, value) rows, skipping NULL values."""
    long = to_long(one_row.withColumn("_k", F.lit(section)), section, "_k",
                   [(label, key) for key, label in labels])
    return long.where(F.col("value_text").isNotNull() | F.col("value_num").isNotNull())


def report_overview(rows: DataFrame) -> DataFrame:
    """RPT-1 (order variant): overview labels with values, NULLs skipped, plus the basis note."""
    ov = _metric_rows(O.order_overview(rows), "overview", ORDER_OVERVIEW_LABELS)
    note = rows.sparkSession.range(1).select(
        F.lit("overview").alias("section"), F.lit("overview").alias("row_key"),
        F.lit(len(ORDER_OVERVIEW_LABELS)).alias("col_no"), F.lit(BASIS_LABEL).alias("header"),
        F.lit(BASIS_TEXT).alias("value_text"), F.lit(None).cast("double").alias("value_num"))
    return ov.unionByName(note)


def student_overview(df: DataFrame) -> DataFrame:
    """RPT-1 (student variant)."""
    c = _metric_rows(S.student_count(df), "overview", (("student_count", "学生数量"),))
    return c.unionByName(_metric_rows(S.score_summary(df), "overview", STUDENT_OVERVIEW_LABELS))


def inventory_overview(df: DataFrame) -> DataFrame:
    """RPT-1 (inventory variant)."""
    c = _metric_rows(I.inventory_count(df), "overview", (("inventory_count", "商品数量"),))
    s = _metric_rows(I.stock_summary(df), "overview", INVENTORY_OVERVIEW_LABELS)
    v = _metric_rows(I.inventory_value(df), "overview", (("total", "库存价值总计"), ("average", "平均库存价值")))
    return c.unionByName(s).unionByName(v)


def report_order_tables(rows: DataFrame) -> DataFrame:
    """RPT-2: all order sections (customers without names), discount and quality tables."""
    fns = {"product_sales": O.product_sales, "category_sales": O.category_sales, "region_sales": O.region_sales,
           "status_analysis": O.status_analysis, "payment_analysis": O.payment_analysis,
           "top_customers": O.top_customers, "daily_sales": O.daily_sales, "monthly_sales": O.monthly_sales,
           "monthly_orders": O.monthly_orders}
    parts = [to_long(fns[key](rows), title, k, cols) for key, title, k, cols in ORDER_SECTIONS]
    disc = O.discount_analysis(rows)
    parts.append(to_long(disc.withColumn("_k", F.lit("1")), "折扣分析", "_k", [(c, c) for c in disc.columns]))
    q = O.data_quality(rows)
    parts.append(to_long(q.withColumn("_k", F.lit("1")), "数据质量检查", "_k",
                         [(QUALITY_LABELS.get(c, c), c) for c in q.columns]))
    parts.append(missing_row(rows, len(q.columns)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_row(rows: DataFrame, col_no: int) -> DataFrame:
    """The quality table's list of columns with missing values over all rows, ``column:count``;
    no row if there are none."""
    def entry(c: str) -> Column:
        missing = F.sum(F.when(F.col(c).isNull(), F.col(O.COPIES)).otherwise(0))
        return F.when(missing > 0, F.concat(F.lit(f"{c}:"), missing.cast("string")))
    text = F.array_join(F.array_compact(F.array(*[entry(c) for c in rows.columns if not c.startswith("_")])), "；")
    one = rows.agg(F.nullif(text, F.lit("")).alias("missing_value_summary"))
    row = to_long(one.withColumn("_k", F.lit("1")), "数据质量检查", "_k", [("missing_value_summary", "missing_value_summary")])
    return row.where(F.col("value_text").isNotNull()).withColumn("col_no", F.lit(col_no))


def report_student_tables(df: DataFrame) -> DataFrame:
    """RPT-3: subject, class, student (name column only when some name exists) and exam tables."""
    stats = (("有效成绩数", "count"), ("平均分", "average"), ("最高分", "maximum"), ("最低分", "minimum"))
    parts = [to_long(S.subject_score(df), "学科成绩统计", "name", (("学科", "name"),) + stats),
             to_long(S.class_score(df), "班级成绩统计", "name", (("班级", "name"),) + stats)]
    st = S.student_rollup(df)
    has_name = st.agg(F.count("student_name") > 0).scalar() if "student_name" in st.columns else F.lit(False)
    cols = [("学生编号", "student_id")] + ([("学生姓名", "student_name")] if "student_name" in st.columns else []) + \
        [("有效成绩数", "score_count"), ("平均分", "average"), ("最高分", "maximum"), ("最低分", "minimum")]
    srows = to_long(st, "学生成绩汇总", "student_id", cols)
    parts.append(srows.where((F.col("header") != "学生姓名") | has_name))
    parts.append(to_long(S.exam_trend(df), "考试趋势", "name",
                         (("考试", "name"), ("平均分", "average"), ("有效成绩数", "count"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report_inventory_tables(df: DataFrame) -> DataFrame:
    """RPT-4: low stock, per-group stock, flow (with the analyzer's field names) and trend."""
    low = I.low_stock(df).withColumn("_k", F.concat_ws("|", F.coalesce("product_id", F.lit("")),
                                                       F.coalesce("product_name", F.lit(""))))
    parts = [to_long(low, "低库存明细", "_k", (("商品编号", "product_id"), ("商品名称", "product_name"),
                                            ("当前库存", "stock_quantity"), ("安全库存", "safety_stock"),
                                            ("库存缺口", "shortage")))]
    for fn, title, first in ((I.category_stock, "分类库存统计", "分类"), (I.warehouse_stock, "仓库库存统计", "仓库"),
                             (I.supplier_stock, "供应商库存统计", "供应商")):
        parts.append(to_long(fn(df), title, "name", ((first, "name"), ("库存数量", "value"))))
    flow = I.inventory_flow(df).withColumn("_k", F.lit("1"))
    parts.append(to_long(flow, "库存流动统计", "_k", (("入库总量", "total_inbound"), ("出库总量", "total_outbound"),
                                                   ("净变化", "net_change"))))
    parts.append(to_long(I.inventory_trend(df), "库存趋势", "name", (("日期", "name"), ("库存总量", "value"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report_skipped(plan: DataFrame) -> DataFrame:
    """RPT-5: one notice per unsupported capability of a plan."""
    detail = F.when(F.length(F.coalesce("missing_fields", F.lit(""))) > 0,
                    F.concat(F.lit(MISSING_FIELDS_TEXT[0]), F.regexp_replace("missing_fields", ",", "、"),
                             F.lit(MISSING_FIELDS_TEXT[1]))).otherwise(F.coalesce("reason", F.lit(NO_RESULT_TEXT)))
    return plan.where(~F.col("supported")).select("dataset_id", "capability_id",
                                                  F.concat(F.col("capability_name"), F.lit("："), detail).alias("notice"))


def region_chart_series(rows: DataFrame) -> DataFrame:
    """RPT-6: name and value of the top 10 regions."""
    return O.region_ranking(rows).where(F.col("in_top10")).select("rank", "name", "value")


def kpi_rows(rows: DataFrame) -> DataFrame:
    """RPT-7: dashboard KPIs (present values only) and quality warnings (counter > 0)."""
    ov = O.order_overview(rows)
    kpis = _metric_rows(ov, "kpi", [(k, label) for k, label, _ in KPI_ORDER])
    cust = _metric_rows(O.customer_summary(rows), "kpi", (("unique_customer_count", "客户数量"),
                                                          ("repeat_customer_rate", "复购率")))
    refund = _metric_rows(O.status_summary(rows), "kpi", (("refund_rate", "退款率"),))
    return kpis.unionByName(cust).unionByName(refund).unionByName(quality_warnings(O.data_quality(rows)))


def quality_warnings(quality: DataFrame) -> DataFrame:
    """The quality counters above zero."""
    return to_long(quality.withColumn("_k", F.lit("quality")), "quality_warning", "_k",
                   [(label, key) for key, label in QUALITY_WARNINGS]).where(F.col("value_num") > 0)


def single_table_catalog(df: DataFrame, dataset_id: int = 0) -> DataFrame:
    """A one-table catalogue ``(dataset_id, pos, name, non_null)`` from one profile aggregate."""
    from sheetwise.operators.profile import generic_profile
    cols = [c for c in df.columns if not c.startswith("_")]
    p = generic_profile(df.select(*cols))
    return p.select(F.lit(dataset_id).cast("long").alias("dataset_id"), F.col("position").alias("pos"), "name",
                    F.col("non_null_count").alias("non_null"))


def analysis_coverage(raw: DataFrame) -> DataFrame:
    """CTX-1 for an order table: a capability is covered when it is planned as
    supported *and* its result is neither missing nor empty."""
    from sheetwise.plans.domains import capability_plan
    from sheetwise.session import materialize
    rows = materialize(O.order_rows(raw))
    # a column has a filled cell in the written rows if it has one in the raw table, which is computed once
    plan = capability_plan(single_table_catalog(rows.select(*raw.columns)))
    ov = O.order_overview(rows)

    def nonempty(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1)) > 0).scalar()

    def present(df: DataFrame, col: str) -> Column:
        return df.select(F.col(col).isNotNull()).scalar()

    has_cols = lambda *cs: F.lit(any(c in raw.columns for c in cs))
    checks = {
        "order_count": present(ov, "order_count"),
        "product_quantity": nonempty(O.product_quantity(rows)),
        "sales_total": present(ov, "verified_sales_total"),
        "product_sales": nonempty(O.product_sales(rows)),
        "category_analysis": nonempty(O.category_sales(rows)),
        "region_sales": nonempty(O.region_sales(rows)),
        "sales_trend": nonempty(O.daily_sales(rows)),
        "target_completion": present(O.target_completion(rows), "completion_rate"),
        "customer_analysis": F.lit(True),
        "status_analysis": nonempty(O.status_analysis(rows)),
        "payment_method_analysis": nonempty(O.payment_analysis(rows)),
        "discount_analysis": has_cols("discount"),
        "demographic_analysis": has_cols("gender") | (has_cols("age") & nonempty(O.age_profile(rows))),
        "data_quality_analysis": F.lit(True),
    }
    result = F.create_map(*[x for k, v in checks.items() for x in (F.lit(k), v)])
    covered = F.col("supported") & F.coalesce(result[F.col("capability_id")], F.lit(False))
    return plan.select("capability_id", "capability_name", covered.alias("covered"),
                       F.when(~covered, F.coalesce("missing_fields", F.lit(""))).alias("missing_fields"),
                       F.when(~covered, F.coalesce("reason", F.lit("未产生可用计算结果"))).alias("reason"))
