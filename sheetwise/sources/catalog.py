"""A catalogue of many uploaded tables, derived from the driver tables.

Every customer is treated as one uploaded dataset.  Its market segment decides
what kind of sheet it uploaded (orders, inventory, scores or free notes), its
nation decides the header language, and the customer's orders decide how many
non-missing values each column holds.  The catalogue therefore grows with the
customer and order tables, like the catalogue of a real multi-tenant service.

Also derived here: field-mapping overrides (with the reference's five error
cases injected by key arithmetic), cleaning runs and the audit log.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.sources.fixtures import table

# Sheet templates: (Chinese header, English header, snake_case header, non-null rule).
# Rules: "all" = every order of the customer, "urgent" = urgent orders only,
# "done" = finished orders only, "none" = never filled.
TEMPLATES: dict[str, tuple[tuple[str, str, str, str], ...]] = {
    "order": (("订单编号", "Order ID", "order_id", "all"), ("商品名称", "Product", "product", "all"),
              ("数量", "Quantity", "quantity", "all"), ("单价", "Unit Price", "unit_price", "all"),
              ("销售额", "Sales Amount", "sales_amount", "urgent"), ("区域", "City", "region", "all"),
              ("订单日期", "Order Time", "date", "done"), ("订单状态", "Order Status", "status", "all"),
              ("备注", "Remark", "remark", "none")),
    "inventory": (("商品编号", "SKU", "product_id", "all"), ("商品名称", "Product Name", "product_name", "all"),
                  ("库存数量", "Stock", "stock_quantity", "all"), ("安全库存", "Safety Stock", "safety_stock", "urgent"),
                  ("仓库", "Warehouse", "warehouse", "all"), ("单位成本", "Unit Cost", "unit_cost", "done")),
    "student": (("学号", "Student ID", "student_id", "all"), ("姓名", "Student Name", "student_name", "all"),
                ("科目", "Subject", "subject", "all"), ("成绩", "Score", "score", "urgent"),
                ("班级", "Class", "class_name", "done"), ("考试日期", "Exam Date", "exam_date", "all")),
    "notes": (("姓名", "Name", "name", "all"), ("城市", "City", "city", "all"), ("备注", "Remark", "remark", "none")),
}
# Orders of every 7th customer carry a second sales column (an alias conflict).
EXTRA_SALES = ("销售金额", "Sales", "sales", "all")
SEGMENT_KIND = {"AUTOMOBILE": "order", "BUILDING": "order", "FURNITURE": "inventory", "MACHINERY": "student",
                "HOUSEHOLD": "notes"}
REMARK = {0: "备注", 1: "Remark", 2: "remark"}


def _template_array(rows) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(zh).alias("zh"), F.lit(en).alias("en"),
                              F.lit(sn).alias("sn"), F.lit(rule).alias("rule"))
                     for i, (zh, en, sn, rule) in enumerate(rows)])


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per uploaded dataset with its kind, language and order statistics."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey")).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_done"))
    kind = F.lit(None).cast("string")
    for seg, k in SEGMENT_KIND.items():
        kind = F.when(F.col("c_mktsegment") == seg, k).otherwise(kind)
    d = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return d.select(F.col("c_custkey").alias("dataset_id"), F.col("c_nationkey").alias("owner_id"),
                    F.col("c_name").alias("file_name"), F.coalesce(kind, F.lit("notes")).alias("kind"),
                    (F.col("c_nationkey") % 3).alias("lang"),
                    *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in ("n_all", "n_urgent", "n_done")])


def table_columns(spark: SparkSession, sf_dir: str, d: DataFrame | None = None) -> DataFrame:
    """``(dataset_id, pos, name, non_null)`` for every column of every dataset."""
    d = d if d is not None else datasets(spark, sf_dir)
    arr = F.lit(None)
    for kind, rows in TEMPLATES.items():
        arr = F.when(F.col("kind") == kind, _template_array(rows)).otherwise(arr)
    extra = F.array(F.struct(F.lit(len(TEMPLATES["order"])).alias("pos"), F.lit(EXTRA_SALES[0]).alias("zh"),
                             F.lit(EXTRA_SALES[1]).alias("en"), F.lit(EXTRA_SALES[2]).alias("sn"),
                             F.lit(EXTRA_SALES[3]).alias("rule")))
    arr = F.when((F.col("kind") == "order") & (F.col("dataset_id") % 7 == 0), F.concat(arr, extra)).otherwise(arr)
    x = d.select("dataset_id", "lang", "n_all", "n_urgent", "n_done", F.explode(arr).alias("t"))
    name = F.when(F.col("lang") == 0, F.col("t.zh")).when(F.col("lang") == 1, F.col("t.en")).otherwise(F.col("t.sn"))
    rule = F.col("t.rule")
    non_null = (F.when(rule == "all", F.col("n_all")).when(rule == "urgent", F.col("n_urgent"))
                .when(rule == "done", F.col("n_done")).otherwise(F.lit(0)))
    return x.select("dataset_id", F.col("t.pos").alias("pos"), name.alias("name"), non_null.cast("long").alias("non_null"))


def overrides(spark: SparkSession, sf_dir: str, d: DataFrame | None = None) -> DataFrame:
    """``(dataset_id, seq, source, target)`` user overrides, some of them invalid on purpose."""
    d = d if d is not None else datasets(spark, sf_dir)
    ck = F.col("dataset_id")
    remark = F.when(F.col("lang") == 0, REMARK[0]).when(F.col("lang") == 1, REMARK[1]).otherwise(REMARK[2])
    first_by_kind = F.lit(None).cast("string")
    for kind, rows in TEMPLATES.items():
        zh, en, sn, _ = rows[0]
        by_lang = F.when(F.col("lang") == 0, zh).when(F.col("lang") == 1, en).otherwise(sn)
        first_by_kind = F.when(F.col("kind") == kind, by_lang).otherwise(first_by_kind)
    rules = [
        (ck % 11 == 0, remark, F.lit("customer_name")),
        (ck % 13 == 0, F.lit("不存在的列"), F.lit("order_id")),
        (ck % 17 == 0, remark, F.lit("bogus_field")),
        (ck % 19 == 0, first_by_kind, F.lit("customer_name")),
        (ck % 23 == 0, remark, F.lit("order_id")),
        (ck % 29 == 0, remark, F.lit("phone")),
        (ck % 29 == 0, first_by_kind, F.lit("phone")),
    ]
    parts = [d.where(cond).select("dataset_id", F.lit(i).alias("seq"), src.alias("source"), tgt.alias("target"))
             for i, (cond, src, tgt) in enumerate(rules)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # an override set is a map: a later entry for the same source replaces the earlier one
    return out.groupBy("dataset_id", "source").agg(F.max("seq").alias("seq"), F.max_by("target", "seq").alias("target"))


def cleaning_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning runs: every order is one run of its customer's dataset."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("dataset_id"),
                    F.concat(F.lit("cleaned/"), F.col("o_custkey").cast("string"), F.lit("/"),
                             F.col("o_orderkey").cast("string"), F.lit(".parquet")).alias("cleaned_storage_path"),
                    F.col("o_orderdate").alias("created_at"))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events: one per event row (id, user, action, time, detail)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "props")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("user_id"),
                    F.col("event_type").alias("action"), F.col("ts").alias("created_at"),
                    F.col("props").alias("detail"))


# Repeated and blank names, and a name with a line break.
ODD_HEADER = 'a,a,,"two\nlines"'


def landing_folder(spark: SparkSession, sf_dir: str) -> str:
    """Export upload files derived from the driver tables into the shared folder.

    ``csv/utf8`` and ``csv/gbk`` hold the customer table (with a Chinese name
    column) in two charsets; ``xlsx`` holds the supplier table as workbooks.
    The export is idempotent (overwrite), so a re-run after a failure is safe.
    """
    from sheetwise.session import checkpoint_dir
    from sheetwise.sources.sinks import export_csv, export_lines, export_workbooks
    root = f"{checkpoint_dir(spark)}/landing/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("c_custkey"), F.concat(F.lit("客户"), F.col("c_name")).alias("name_cn"),
        "c_name", F.col("c_nationkey").cast("string").alias("c_nationkey"), "c_mktsegment")
    export_csv(c.where(F.col("c_custkey") % 2 == 0), f"{root}/csv/utf8", "UTF-8")
    export_csv(c.where(F.col("c_custkey") % 2 == 1), f"{root}/csv/gbk", "GBK")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("s_suppkey"), "s_name",
                                                F.col("s_nationkey").cast("string").alias("s_nationkey"))
    export_workbooks(s, f"{root}/xlsx")
    o = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0")
    export_workbooks(o.select("o_orderkey", "o_orderdate"), f"{root}/dated/a", 2_000)
    export_workbooks(o.where("o_orderkey % 3 = 0").select("o_orderdate", "o_orderkey", "o_orderstatus"), f"{root}/dated/b", 2_000)
    cells = [F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')) for c in ("c_custkey", "c_name", "c_mktsegment", "c_nationkey")]
    lines = table(spark, sf_dir, "customer").select(F.concat_ws(",", *cells).alias("value"))
    export_lines(lines, f"{root}/odd_headers", ODD_HEADER)
    return root
