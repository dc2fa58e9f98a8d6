"""DuckDB SQL for the parts of ``plans/outcome.py``: coverage, payload, KPIs and findings of uploads.

Plans and labels are written out here once more.  Uploads are cleaned first, so equal rows
count once: the base views below are the typed ones without copies and without the columns
that the upload lacks.
"""

from __future__ import annotations

# id, name, missing fields (None: supported) of the uploads' plans.
_ORDER_PLAN = (
    ("order_count", "订单数量分析", None), ("product_quantity", "商品销量分析", None), ("product_sales", "商品销售分析", None),
    ("category_analysis", "品类销售分析", None), ("sales_total", "销售额分析", None), ("region_sales", "区域销售分析", None),
    ("sales_trend", "销售趋势分析", None), ("target_completion", "目标完成率分析", None), ("customer_analysis", "客户分析", None),
    ("status_analysis", "订单状态分析", None), ("payment_method_analysis", "支付方式分析", "payment_method"),
    ("discount_analysis", "折扣分析", None), ("demographic_analysis", "客户画像分析", "gender"), ("data_quality_analysis", "数据质量分析", None),
    ("refund_analysis", "退款分析", None),
)
_SCORES_PLAN = (
    ("student_count", "学生数量分析", None), ("score_summary", "成绩概览", None), ("subject_score", "学科成绩分析", None),
    ("class_score", "班级成绩分析", "class_name"), ("student_score", "学生成绩分析", None), ("exam_trend", "考试趋势分析", None),
)
_STOCK_PLAN = (
    ("inventory_count", "库存商品数量", None), ("stock_summary", "库存概览", None), ("low_stock_analysis", "低库存分析", None),
    ("inventory_value", "库存价值分析", None), ("category_stock", "分类库存分析", None), ("warehouse_stock", "仓库库存分析", None),
    ("supplier_stock", "供应商库存分析", "supplier"), ("inventory_flow", "库存流动分析", "outbound_quantity"), ("inventory_trend", "库存趋势分析", None),
)
_GENERIC_PLAN = (("row_count", "行数统计", None), ("column_profile", "列信息概览", None), ("missing_value_analysis", "缺失值分析", None))
_LACKING, _NOTHING = "缺少所需字段", "未产生可用计算结果"

_FIELDS = {
    "order": ("order_id", "customer_id", "customer_name", "product", "category", "region", "date", "unit_price", "quantity", "discount",
              "sales_amount", "status", "target_amount", "phone", "email", "ok", "pk", "sk", "ln"),
    "scores": ("student_id", "student_name", "subject", "score", "exam_name"),
    "stock": ("product_id", "product_name", "category", "warehouse", "stock_quantity", "safety_stock", "unit_cost", "inbound_quantity", "inventory_date"),
    "generic": ("doc_id", "lang", "source", "n_chars", "quality", "toxic"),
}
_DOMAIN = {"order": "order", "scores": "student_score", "stock": "inventory", "generic": "generic"}
_PLANS = {"order": _ORDER_PLAN, "scores": _SCORES_PLAN, "stock": _STOCK_PLAN, "generic": _GENERIC_PLAN}

# section, key of the SQL, columns; lists are ordered by the keys' own order
_OVERVIEW = ("record_count order_count verified_sales_total verified_order_count average_verified_order_value maximum_verified_order_value "
             "minimum_verified_order_value median_verified_order_value unverified_order_count no_usable_amount_order_count amount_verification_rate "
             "unverified_amount_total amount_comparable_count amount_mismatch_count amount_mismatch_rate standard_deviation coefficient_of_variation "
             "completed_sales_amount cancelled_order_amount refund_related_amount")
_QUALITY = ("row_count duplicate_row_count duplicate_order_id_count invalid_date_count invalid_unit_price_count zero_unit_price_count "
            "invalid_quantity_count zero_quantity_count invalid_discount_count invalid_age_count invalid_status_count unverified_amount_count "
            "invalid_amount_count amount_mismatch_count amount_comparable_count amount_mismatch_rate unverified_order_count")
_ORDER_SECTIONS = (
    ("overview", "order_overview", _OVERVIEW), ("product_analysis", "product_sales", "name order_count quantity sales_amount"),
    ("category_analysis", "category_sales", "category order_count quantity sales_amount sales_share"),
    ("region_analysis", "region_sales", "name region_order_count region_sales region_quantity region_average_order_value target_amount completion_rate value"),
    ("daily_sales_trend", "daily_sales", "name value"), ("monthly_sales_trend", "monthly_sales", "name value"),
    ("monthly_order_trend", "monthly_orders", "name value"),
    ("customer_analysis", "customer_summary", "unique_customer_count repeat_customer_count repeat_customer_rate average_orders_per_customer"),
    ("top_customers", "top_customers", "customer_id order_count sales_amount"),
    ("status_analysis", "status_analysis", "name order_count sales_amount share"),
    ("status_summary", "status_summary", "completed_order_count cancelled_order_count refund_order_count order_completion_rate cancellation_rate refund_rate"),
    ("payment_method_analysis", "payment_analysis", "name order_count sales_amount order_share sales_share"),
    ("discount_analysis", "discount_analysis", "valid_discount_count discounted_order_count discounted_order_rate average_discount "
     "average_discounted_order_value estimated_discount_amount"),
    ("gender", "gender_profile", "name order_count customer_count sales_amount"), ("age", "age_profile", "name order_count customer_count sales_amount"),
    ("data_quality", "data_quality", _QUALITY),
)
_SCORE_SECTIONS = (
    ("student_count", "student_count", "student_count"), ("score_summary", "score_summary", "count average maximum minimum median"),
    ("subject_score", "subject_score", "name count average maximum minimum"),
    ("student_score", "student_rollup", "student_id score_count average maximum minimum student_name"), ("exam_trend", "exam_names", "name average count"),
)
_STOCK_SECTIONS = (
    ("inventory_count", "inventory_count", "inventory_count"), ("stock_summary", "stock_summary", "count total average maximum minimum median"),
    ("low_stock_analysis", "low_stock", "product_id product_name stock_quantity safety_stock shortage"),
    ("inventory_value", "inventory_value", "count total average"), ("category_stock", "category_stock", "name value"),
    ("warehouse_stock", "warehouse_stock", "name value"), ("inventory_trend", "inventory_trend", "name value"),
)
_GENERIC_SECTIONS = (
    ("row_count", "table_shape", "row_count column_count"),
    ("column_profile", "column_profile", "position name data_type missing_count unique_count"),
    ("missing_value_summary", "missing_rate", "column_name missing_count missing_rate"),
)
_TEXT = {"name", "category", "customer_id", "student_id", "student_name", "product_id", "product_name", "data_type", "column_name"}


def _text(value: str | None) -> str:
    return "cast(null as varchar)" if value is None else f"'{value}'"


def _sections(sections, sql: dict[str, str], orders: dict[str, str]) -> str:
    parts = []
    for section, key, columns in sections:
        cells = ", ".join(
            f"{{'col_no': {i}, 'field': '{c}', 'value_text': {f'cast({c} as varchar)' if c in _TEXT else 'cast(null as varchar)'}, "
            f"'value_num': {'cast(null as double)' if c in _TEXT else f'cast({c} as double)'}}}" for i, c in enumerate(columns.split()))
        rank = f"row_number() over (order by {orders[key]})" if key in orders else "1"
        parts.append(f"select '{section}' section, cast({rank} as bigint) rank, unnest([{cells}]) c from ({sql[key]}) l")
    return "select section, rank, c.col_no, c.field, c.value_text, c.value_num from (" + " union all ".join(parts) + ")"


def _facts(upload: str) -> str:
    rows = [("selected_module", 1, 0, "id", _DOMAIN[upload])]
    rows += [("available_fields", i + 1, 0, "name", name) for i, name in enumerate(_FIELDS[upload])]
    for i, (cap, name, missing) in enumerate(_PLANS[upload]):
        rows += [("analysis_plan", i + 1, j, field, value) for j, (field, value) in enumerate((
            ("id", cap), ("name", name), ("supported", "true" if missing is None else "false"), ("missing_fields", missing or "")))]
    values = ", ".join(f"('{s}', cast({r} as bigint), {c}, '{f}', {_text(v)}, cast(null as double))" for s, r, c, f, v in rows)
    return f"select * from (values {values}) v(section, rank, col_no, field, value_text, value_num)"


def _coverage(upload: str, held: dict[str, str]) -> str:
    parts = []
    for i, (cap, name, missing) in enumerate(_PLANS[upload]):
        covered = "false" if missing is not None else held.get(cap, "false")
        reason = _LACKING if missing is not None else _NOTHING
        parts.append(f"select {i} position, '{cap}' capability_id, '{name}' capability_name, {covered} covered, '{missing or ''}' m, '{reason}' r")
    if upload == "generic":
        parts.append(f"select {len(parts)}, 'generic_analysis', null, true, '', ''")
    return ("select position, capability_id, capability_name, covered, case when not covered then m end missing_fields, "
            "case when not covered then r end reason from (" + " union all ".join(parts) + ")")


def _kpis(sql: dict[str, str], figures: list[tuple[str, tuple[tuple[str, str], ...]]]) -> str:
    return " union all ".join(
        f"select 'kpi' section, 'kpi' row_key, {i} col_no, '{label}' header, cast(null as varchar) value_text, cast({c} as double) value_num "
        f"from ({sql[key]}) where {c} is not null" for key, labels in figures for i, (c, label) in enumerate(labels))


def outcome_sql(base: dict[str, str], orders: dict[str, str], findings) -> dict[str, str]:
    """``base`` is the SQL of the typed keys; ``findings(sql)`` composes the findings from such."""
    def swapped(pairs: list[tuple[str, str]]) -> dict[str, str]:
        out = {}
        for key, text in base.items():
            for old, new in pairs:
                text = text.replace(old, new)
            out[key] = text
        return out

    order = swapped([(" union all select * from v where ok % 50 = 0", ""), ("cast(ck % 131 as int) age", "cast(null as int) age")])
    scores = swapped([("from events),\nsc as", "from events),\nonce as (select student_id, student_name, subject, score, exam_name, "
                       "min(event_id) event_id from ss group by all),\nsc as"), ("double) s from ss)", "double) s from once)")])
    stock = swapped([("iv as (select *,", "once as (select product_id, product_name, category, warehouse, stock_quantity, safety_stock, unit_cost, "
                      "inbound_quantity, inventory_date, min(pos) pos from inv group by all),\niv as (select *,"), (" st from inv)", " st from once)")])
    docs = "(select d.doc_id, lang, source, n_chars, quality, toxic from documents d left join labels l on d.doc_id = l.doc_id)"
    fields = _FIELDS["generic"]
    rate = "cast(round(cast((count(*) - count({c})) * 100.0 / count(*) as decimal(38,8)), 2) as double)"
    generic = {
        "table_shape": f"select count(*) row_count, {len(fields)} column_count from {docs}",
        "column_profile": " union all ".join(f"select {i} \"position\", '{c}' \"name\", 'text' data_type, count(*) - count({c}) missing_count, "
                                             f"count(distinct {c}) unique_count from {docs}" for i, c in enumerate(fields)),
        "missing_rate": " union all ".join(f"select {i} \"position\", '{c}' column_name, count(*) - count({c}) missing_count, "
                                           f"{rate.format(c=c)} missing_rate from {docs}" for i, c in enumerate(fields)),
    }
    listed = {**orders, "column_profile": "position", "missing_rate": "position"}  # the order of columns

    def held(sql: dict[str, str], by_key: dict[str, str | None]) -> dict[str, str]:
        return {cap: "true" if key is None else f"(select count(*) > 0 from ({sql[key]}))" for cap, key in by_key.items()}

    order_held = held(order, {"order_count": "order_overview", "product_quantity": "product_quantity", "product_sales": "product_sales",
                              "category_analysis": "category_sales", "sales_total": "sales_summary", "region_sales": "region_sales",
                              "sales_trend": "daily_sales", "customer_analysis": None, "status_analysis": "status_analysis",
                              "discount_analysis": None, "data_quality_analysis": None})
    order_held["target_completion"] = f"(select completion_rate is not null from ({order['target_completion']}))"
    score_held = held(scores, {"student_count": None, "score_summary": "score_summary", "subject_score": "subject_score",
                               "student_score": "student_rollup", "exam_trend": "exam_names"})
    stock_held = held(stock, {"inventory_count": None, "stock_summary": "stock_summary", "low_stock_analysis": "low_stock",
                              "inventory_value": "inventory_value", "category_stock": "category_stock", "warehouse_stock": "warehouse_stock",
                              "inventory_trend": "inventory_trend"})
    skipped = {"payment_method_analysis", "gender", "age"}
    found = {
        "upload_order_coverage": _coverage("order", order_held),
        "upload_scores_coverage": _coverage("scores", score_held),
        "upload_stock_coverage": _coverage("stock", stock_held),
        "upload_generic_coverage": _coverage("generic", {}),
        "upload_order_payload": _facts("order") + " union all " + _sections([s for s in _ORDER_SECTIONS if s[0] not in skipped], order, orders),
        "upload_scores_payload": _facts("scores") + " union all " + _sections(_SCORE_SECTIONS, scores, orders),
        "upload_stock_payload": _facts("stock") + " union all " + _sections(_STOCK_SECTIONS, stock, orders),
        "upload_generic_payload": _facts("generic") + " union all " + _sections(_GENERIC_SECTIONS, generic, listed),
        "upload_scores_kpis": _kpis(scores, [("student_count", (("student_count", "学生数量"),)),
                                             ("score_summary", (("average", "平均分"), ("maximum", "最高分"), ("minimum", "最低分"), ("median", "中位数")))]),
        "upload_stock_kpis": _kpis(stock, [("inventory_count", (("inventory_count", "商品数量"),)),
                                           ("stock_summary", (("total", "库存总量"), ("average", "平均库存"), ("maximum", "最大库存"), ("minimum", "最小库存"))),
                                           ("inventory_value", (("total", "库存价值"),))]),
        "upload_generic_kpis": _kpis(generic, [("table_shape", (("row_count", "数据行数"), ("column_count", "字段数量")))]),
        "upload_generic_findings": f"select 'missing_values' code, column_name subject, cast(missing_count as double) \"value\", missing_rate "
                                   f"from ({generic['missing_rate']}) where missing_count > 0",
        "safe_payload": _sections(_ORDER_SECTIONS, base, orders),
    }
    for upload, sql in (("order", order), ("scores", scores), ("stock", stock)):
        composed = findings(sql)
        key = {"order": "order_findings", "scores": "score_findings", "stock": "inventory_findings"}[upload]
        found[f"upload_{upload}_findings"] = composed[key]
        if upload == "order":
            found["upload_order_kpis"] = composed["kpi_rows"]
    return found
