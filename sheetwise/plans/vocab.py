"""Canonical vocabulary, domain signals and capability catalogues (data, not code).

Fixed values: these lists must equal the reference's vocabulary for equal
mapping, domain and planning results.  They are given plainly, in the
reference's natural order.
"""

from __future__ import annotations

# --- Fixed values: header aliases per canonical field -----------------------
ORDER_ALIASES: dict[str, tuple[str, ...]] = {
    "order_id": ("订单编号", "订单号", "order id", "order_id", "orderid"),
    "product": ("商品", "商品名称", "产品", "产品名称", "product"),
    "quantity": ("数量", "商品数量", "件数", "quantity"),
    "unit_price": ("单价", "商品单价", "unit price", "unit_price"),
    "sales_amount": ("销售额", "销售金额", "订单金额", "成交金额", "订单实付金额", "order amount", "order_amount",
                     "sales amount", "sales_amount", "sales"),
    "customer_id": ("客户编号", "客户ID", "用户编号", "用户ID", "user id", "user_id", "customer id", "customer_id"),
    "customer_name": ("客户姓名", "客户名称", "用户姓名", "用户名", "user name", "user_name", "customer name",
                      "customer_name"),
    "phone": ("phone", "mobile", "mobile_phone", "mobile phone", "tel", "telephone", "手机号", "手机号码", "手机",
              "联系电话", "联系电话号码", "电话"),
    "email": ("email", "e-mail", "mail", "email_address", "email address", "邮箱", "电子邮箱", "电子邮件"),
    "category": ("商品类别", "商品品类", "订单品类", "分类", "商品分类", "产品分类", "品类", "category"),
    "region": ("区域", "地区", "大区", "城市", "city", "region"),
    "status": ("状态", "订单状态", "order status", "order_status", "status"),
    "date": ("日期", "订单日期", "交易日期", "下单时间", "订单时间", "order time", "order_time", "date"),
    "discount": ("折扣", "折扣率", "discount"),
    "payment_method": ("支付方式", "付款方式", "支付渠道", "payment method", "payment_method"),
    "gender": ("性别", "gender"),
    "age": ("年龄", "age"),
    "target_amount": ("目标额", "目标金额", "target amount", "target_amount", "target"),
}
STUDENT_ALIASES: dict[str, tuple[str, ...]] = {
    "student_id": ("学号", "学生编号", "student id", "student_id"),
    "student_name": ("学生姓名", "姓名", "student name", "student_name"),
    "subject": ("科目", "学科", "课程", "subject"),
    "score": ("成绩", "分数", "得分", "score"),
    "class_name": ("班级", "班级名称", "class", "class name", "class_name"),
    "grade": ("年级", "年级名称", "grade"),
    "exam_name": ("考试", "考试名称", "测试名称", "exam name", "exam_name"),
    "exam_date": ("考试日期", "测试日期", "exam date", "exam_date"),
}
INVENTORY_ALIASES: dict[str, tuple[str, ...]] = {
    "product_id": ("商品编号", "产品编号", "SKU", "sku", "product id", "product_id"),
    "product_name": ("商品名称", "产品名称", "商品", "产品", "product name", "product_name"),
    "category": ("分类", "商品分类", "产品分类", "品类", "商品类别", "商品品类", "订单品类", "category"),
    "stock_quantity": ("库存", "库存数量", "当前库存", "库存量", "stock", "stock quantity", "stock_quantity"),
    "safety_stock": ("安全库存", "最低库存", "库存下限", "safety stock", "safety_stock"),
    "unit_cost": ("成本", "单位成本", "单价成本", "unit cost", "unit_cost"),
    "warehouse": ("仓库", "仓库名称", "库房", "warehouse"),
    "supplier": ("供应商", "supplier"),
    "inbound_quantity": ("入库数量", "入库量", "inbound quantity", "inbound_quantity"),
    "outbound_quantity": ("出库数量", "出库量", "outbound quantity", "outbound_quantity"),
    "inventory_date": ("库存日期", "盘点日期", "inventory date", "inventory_date"),
}
# Context targets deciding ambiguous product headers.
INVENTORY_CONTEXT = ("product_id", "stock_quantity", "safety_stock", "unit_cost", "warehouse", "supplier",
                     "inbound_quantity", "outbound_quantity", "inventory_date")
ORDER_CONTEXT = ("order_id", "quantity", "unit_price", "sales_amount", "customer_id", "region", "status", "date",
                 "target_amount")

# --- Fixed values: domain signals and scores (registration order) -----------
# (domain id, domain name, base score, step per extra signal, signals)
DOMAINS = (
    ("order", "订单分析", "0.55", "0.15", (("sales_amount",), ("order_id", "product"), ("sales_amount", "product"),
                                          ("quantity", "unit_price"), ("customer_id", "order_id"))),
    ("student_score", "学生成绩分析", "0.65", "0.10", (("student_id", "score"), ("student_name", "score"),
                                                    ("subject", "score"), ("class_name", "score"),
                                                    ("exam_date", "score"), ("exam_name", "score"))),
    ("inventory", "库存分析", "0.60", "0.10", (("product_id", "stock_quantity"), ("product_name", "stock_quantity"),
                                             ("warehouse", "stock_quantity"), ("stock_quantity", "safety_stock"),
                                             ("stock_quantity", "unit_cost"))),
)
GENERIC = ("generic", "通用表格分析")
MINIMUM_DOMAIN_SCORE = "0.5"

# --- Fixed values: capability catalogues -------------------------------------
# (capability id, name, all_of, any_of)
_SALES = (("sales_amount",), ("unit_price", "quantity"))
CAPABILITIES: dict[str, tuple[tuple[str, str, tuple[str, ...], tuple[tuple[str, ...], ...]], ...]] = {
    "order": (
        ("order_count", "订单数量分析", ("order_id",), ()),
        ("product_quantity", "商品销量分析", ("product", "quantity"), ()),
        ("product_sales", "商品销售分析", ("product",), _SALES),
        ("category_analysis", "品类销售分析", ("category",), _SALES),
        ("sales_total", "销售额分析", (), _SALES),
        ("region_sales", "区域销售分析", ("region",), _SALES),
        ("sales_trend", "销售趋势分析", ("date",), _SALES),
        ("target_completion", "目标完成率分析", ("target_amount",), _SALES),
        ("customer_analysis", "客户分析", ("customer_id", "order_id"), ()),
        ("status_analysis", "订单状态分析", ("status",), ()),
        ("payment_method_analysis", "支付方式分析", ("payment_method",), _SALES),
        ("discount_analysis", "折扣分析", ("discount",), _SALES),
        ("demographic_analysis", "客户画像分析", (), (("gender",), ("age",))),
        ("data_quality_analysis", "数据质量分析", (), ()),
        ("refund_analysis", "退款分析", ("status",), ()),
    ),
    "student_score": (
        ("student_count", "学生数量分析", ("student_id",), ()),
        ("score_summary", "成绩概览", ("score",), ()),
        ("subject_score", "学科成绩分析", ("subject", "score"), ()),
        ("class_score", "班级成绩分析", ("class_name", "score"), ()),
        ("student_score", "学生成绩分析", ("student_id", "score"), ()),
        ("exam_trend", "考试趋势分析", (), (("exam_date", "score"), ("exam_name", "score"))),
    ),
    "inventory": (
        ("inventory_count", "库存商品数量", (), (("product_id",), ("product_name",))),
        ("stock_summary", "库存概览", ("stock_quantity",), ()),
        ("low_stock_analysis", "低库存分析", ("stock_quantity", "safety_stock"), ()),
        ("inventory_value", "库存价值分析", ("stock_quantity", "unit_cost"), ()),
        ("category_stock", "分类库存分析", ("category", "stock_quantity"), ()),
        ("warehouse_stock", "仓库库存分析", ("warehouse", "stock_quantity"), ()),
        ("supplier_stock", "供应商库存分析", ("supplier", "stock_quantity"), ()),
        ("inventory_flow", "库存流动分析", ("inbound_quantity", "outbound_quantity"), ()),
        ("inventory_trend", "库存趋势分析", ("inventory_date", "stock_quantity"), ()),
    ),
    "generic": (
        ("row_count", "行数统计", (), ()),
        ("column_profile", "列信息概览", (), ()),
        ("missing_value_analysis", "缺失值分析", (), ()),
    ),
}
MISSING_REASON = "缺少所需字段"
# --- End of fixed values -----------------------------------------------------


def all_aliases() -> dict[str, tuple[str, ...]]:
    """Targets in registration order (order, student, inventory; later entries of a
    shared target replace earlier ones, as a dict merge does)."""
    return {**ORDER_ALIASES, **STUDENT_ALIASES, **INVENTORY_ALIASES}


def canonical_fields() -> tuple[str, ...]:
    return tuple(all_aliases())
