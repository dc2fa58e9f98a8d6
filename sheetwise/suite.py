"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the driver tables through the canonical fixture views and
runs one operator of the library over the *whole* view.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.functions.columns import clean_text
from sheetwise.functions.normalize import normalize_status, valid_email, valid_phone, with_region
from sheetwise.functions.columns import MONEY_WORK, money, to_number
from sheetwise.functions.normalize import day_key, order_date_text, parse_date_text
from sheetwise.operators import cleaning as C
from sheetwise.operators import inventory as I
from sheetwise.operators import profile as P
from sheetwise.operators import orders as O
from sheetwise.operators import scores as S
from sheetwise.operators.ranking import ranked
from sheetwise.plans.results import ORDERS, in_order
from sheetwise.sources.fixtures import (
    document_profile_frame, document_text_frame, inventory_rows, order_lines, raw_sales, student_scores,
)

Query = Callable[[SparkSession, str], DataFrame]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.order_rows(order_lines(spark, sf_dir))


def _on_rows(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(_rows(spark, sf_dir))


def _on_saved_rows(fn: Callable[[DataFrame], DataFrame]) -> Query:
    """For outputs built from many metrics of the same rows: prepare them once."""
    from sheetwise.session import materialize
    return lambda spark, sf_dir: fn(materialize(_rows(spark, sf_dir)))


def _on_raw(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(order_lines(spark, sf_dir))


def _status_words(df: DataFrame) -> DataFrame:
    code = normalize_status(clean_text(df, "status"))
    return df.groupBy(F.col("status").alias("raw_status"), code.alias("status_code")).agg(
        F.count(F.lit(1)).alias("row_count"))


def _regions(df: DataFrame) -> DataFrame:
    return with_region(df).groupBy(F.col("_region").alias("region")).agg(F.count(F.lit(1)).alias("row_count"))


def _text_values(df: DataFrame) -> DataFrame:
    return df.groupBy(clean_text(df, "status").alias("value")).agg(F.count(F.lit(1)).alias("row_count"))


def _contact_values(column: str, check) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        text = clean_text(df, column)
        return df.groupBy(text.alias(column), F.coalesce(check(text), F.lit(False)).alias("is_valid")).agg(
            F.count(F.lit(1)).alias("row_count"))
    return run


ORDER_QUERIES: dict[str, Query] = {
    "order_overview": _on_rows(O.order_overview),
    "order_rollup": _on_rows(O.order_rollup),
    "order_count": _on_rows(O.order_count),
    "status_amounts": _on_rows(O.status_amounts),
    "sales_volatility": _on_rows(O.sales_volatility),
    "product_sales": _on_rows(O.product_sales),
    "category_sales": _on_rows(O.category_sales),
    "region_sales": _on_rows(O.region_sales),
    "daily_sales": _on_rows(O.daily_sales),
    "monthly_sales": _on_rows(O.monthly_sales),
    "monthly_orders": _on_rows(O.monthly_orders),
    "customer_rollup": _on_rows(O.customer_rollup),
    "top_customers": _on_rows(O.top_customers),
    "customer_summary": _on_rows(O.customer_summary),
    "status_analysis": _on_rows(O.status_analysis),
    "status_summary": _on_rows(O.status_summary),
    "payment_analysis": _on_rows(O.payment_analysis),
    "discount_analysis": _on_rows(O.discount_analysis),
    "gender_profile": _on_rows(O.gender_profile),
    "age_profile": _on_rows(O.age_profile),
    "contact_quality": _on_rows(O.contact_quality),
    "valid_ranges": _on_rows(O.valid_ranges),
    "data_quality": _on_rows(O.data_quality),
    "missing_summary": _on_raw(O.missing_summary),
    "sales_summary": _on_rows(O.sales_summary),
    "region_ranking": _on_rows(O.region_ranking),
    "growth_rate": _on_rows(O.growth_rate),
    "target_completion": _on_rows(O.target_completion),
    "region_performance": _on_rows(O.region_performance),
    "product_quantity": _on_rows(O.product_quantity),
    "amount_status": _on_rows(O.amount_status),
    "verified_amount": _on_rows(lambda r: O.amount_rows(r, ["ok", "pk", "sk", "ln", "_copies"]).drop(
        "unverified_amount", "amount_comparable", "amount_mismatch")),
    "unverified_amount": _on_rows(lambda r: O.amount_rows(r, ["ok", "pk", "sk", "ln", "_copies"]).select(
        "ok", "pk", "sk", "ln", "_copies", "unverified_amount")),
    "amount_mismatch": _on_rows(lambda r: O.amount_rows(r, ["ok", "pk", "sk", "ln", "_copies"]).select(
        "ok", "pk", "sk", "ln", "_copies", "amount_comparable", "amount_mismatch")),
    "order_dedup": _on_raw(O.order_dedup),
    "normalize_status": _on_raw(_status_words),
    "normalize_region": _on_raw(_regions),
    "clean_text": _on_raw(_text_values),
    "valid_phone": _on_raw(_contact_values("phone", valid_phone)),
    "valid_email": _on_raw(_contact_values("email", valid_email)),
}


def _inv(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(inventory_rows(spark, sf_dir))


def _stu(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(student_scores(spark, sf_dir))


INVENTORY_QUERIES: dict[str, Query] = {
    "inventory_count": _inv(I.inventory_count),
    "stock_summary": _inv(I.stock_summary),
    "low_stock": _inv(I.low_stock),
    "inventory_value": _inv(I.inventory_value),
    "category_stock": _inv(I.category_stock),
    "warehouse_stock": _inv(I.warehouse_stock),
    "supplier_stock": _inv(I.supplier_stock),
    "inventory_flow": _inv(I.inventory_flow),
    "inventory_trend": _inv(I.inventory_trend),
}

SCORE_QUERIES: dict[str, Query] = {
    "student_count": _stu(S.student_count),
    "score_summary": _stu(S.score_summary),
    "subject_score": _stu(S.subject_score),
    "class_score": _stu(S.class_score),
    "student_rollup": _stu(S.student_rollup),
    "exam_trend": _stu(S.exam_trend),
}


def _docs(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(document_profile_frame(spark, sf_dir))


PROFILE_QUERIES: dict[str, Query] = {
    "generic_profile": _docs(P.generic_profile),
    "missing_rate": _docs(P.missing_rate),
    "available_fields": _docs(P.available_fields),
    "column_profile": _docs(P.column_profile),
    "table_shape": _docs(P.table_shape),
    "generic_findings": _docs(P.generic_findings),
    "infer_types": lambda spark, sf_dir: P.infer_types(document_text_frame(spark, sf_dir)),
}


def _sales(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(raw_sales(spark, sf_dir))


def _clean_date(df: DataFrame) -> DataFrame:
    return C.cleaned(df).groupBy("date").agg(F.count(F.lit(1)).alias("row_count"))


def _clean_number(df: DataFrame) -> DataFrame:
    c = C.cleaned(df)
    aggs = []
    for col, name in (("sales_amount", "sales"), ("target_amount", "target"), ("customer_count", "customer")):
        aggs += [F.count(col).alias(f"{name}_count"), money(F.sum(F.col(col).try_cast(MONEY_WORK))).alias(f"{name}_total")]
    return c.agg(*aggs)


def _coalesce_columns(df: DataFrame) -> DataFrame:
    std = C.standardize_headers(C.with_missing_tokens(df))
    return std.groupBy("region").agg(F.count(F.lit(1)).alias("row_count"))


def _missing_tokens(df: DataFrame) -> DataFrame:
    t = C.with_missing_tokens(df)
    return P.missing_rate(t).select("column_name", "missing_count")


def _to_number(df: DataFrame) -> DataFrame:
    t = C.with_missing_tokens(df)
    n = to_number(t, "销售额")
    return t.agg(F.count(n).alias("parsed_count"), F.count_if(F.col("销售额").isNotNull() & n.isNull()).alias("invalid_count"),
                 money(F.sum(n.try_cast(MONEY_WORK))).alias("total"))


def _parse_dates(df: DataFrame) -> DataFrame:
    t = C.with_missing_tokens(df)
    d = parse_date_text(order_date_text(F.col("日期")))
    return t.groupBy(day_key(d).alias("day_key")).agg(F.count(F.lit(1)).alias("row_count"))


CLEANING_QUERIES: dict[str, Query] = {
    "clean_summary": _sales(C.clean_summary),
    "invalid_values": _sales(C.invalid_values),
    "missing_cells": _sales(C.missing_cells),
    "drop_empty_rows": _sales(C.drop_empty_rows),
    "drop_duplicate_rows": _sales(C.drop_duplicate_rows),
    "clean_table": _sales(C.cleaned),
    "clean_date": _sales(_clean_date),
    "clean_number": _sales(_clean_number),
    "coalesce_columns": _sales(_coalesce_columns),
    "missing_tokens": _sales(_missing_tokens),
    "to_number": _sales(_to_number),
    "parse_dates": _sales(_parse_dates),
}


def _catalog_queries() -> dict[str, Query]:
    from sheetwise.plans import domains as D
    from sheetwise.plans import mapping as MP
    from sheetwise.sources import catalog as CT

    from sheetwise.session import materialize

    def catalog(spark, sf_dir):
        """The dataset table is derived once (checkpointed); columns and overrides from it."""
        d = materialize(CT.datasets(spark, sf_dir))
        return CT.table_columns(spark, sf_dir, d), CT.overrides(spark, sf_dir, d)

    def cols(spark, sf_dir):
        return catalog(spark, sf_dir)[0]

    def mapped(spark, sf_dir):
        # read by both the domain choice and the availability lists: computed once
        return materialize(MP.mapped_columns(*catalog(spark, sf_dir)))

    def ambiguous(spark, sf_dir):
        _, amb = MP.alias_frames(spark)
        r = MP.resolved_columns(cols(spark, sf_dir))
        return r.join(F.broadcast(amb), "key", "left_semi").select("dataset_id", "pos", "name", "target")

    def latest_run(spark, sf_dir):
        runs = CT.cleaning_runs(spark, sf_dir)
        return runs.groupBy("dataset_id").agg(F.max("run_id").alias("run_id"),
                                              F.max_by("cleaned_storage_path", "run_id").alias("cleaned_storage_path"))

    def by_owner(spark, sf_dir):
        d = CT.datasets(spark, sf_dir).select("dataset_id", "owner_id", "file_name", "kind")
        return ranked(d, [-F.col("dataset_id")], within=["owner_id"], name="position")

    def audit_page(spark, sf_dir, page: int = 3, size: int = 20):
        log = CT.audit_log(spark, sf_dir)
        total = log.agg(F.count(F.lit(1))).scalar()
        return (log.orderBy(F.desc("id")).offset((page - 1) * size).limit(size)
                .select("id", "user_id", "action", total.alias("total"),
                        F.ceil(total / F.lit(size)).cast("long").alias("total_pages")))

    def override_map(spark, sf_dir):
        ov = MP.valid_overrides(*catalog(spark, sf_dir))
        entries = F.array_sort(F.collect_list(F.struct("source", "target")))
        return ov.groupBy("dataset_id").agg(
            F.array_join(F.transform(entries, lambda e: F.concat(e["source"], F.lit("="), e["target"])), ",")
            .alias("overrides"))

    return {
        "normalize_header": lambda s, d: MP.header_key(cols(s, d).select("name").distinct()).select("name", "key"),
        "clean_headers": lambda s, d: MP.clean_header_catalog(cols(s, d)),
        "ambiguous_alias": ambiguous,
        "canonical_mapping": lambda s, d: MP.canonical_mapping(*catalog(s, d)),
        "unmapped_columns": lambda s, d: MP.unmapped_columns(*catalog(s, d)),
        "override_errors": lambda s, d: MP.override_errors(*catalog(s, d)).where(F.col("error_code").isNotNull()),
        "domain_score": lambda s, d: D.domain_score(mapped(s, d)),
        "domain_choice": lambda s, d: D.domain_choice(mapped(s, d)),
        "capability_plan": lambda s, d: D.capability_plan(mapped(s, d)),
        "latest_run": latest_run,
        "datasets_by_owner": by_owner,
        "audit_page": audit_page,
        "override_map": override_map,
        "mapping_preview": lambda s, d: MP.mapping_preview(*catalog(s, d)),
    }


def _report_queries() -> dict[str, Query]:
    from sheetwise.operators import findings as FD
    from sheetwise.operators import report as R
    from sheetwise.plans import domains as D
    from sheetwise.plans import mapping as MP
    from sheetwise.sources import catalog as CT

    def skipped(spark, sf_dir):
        from sheetwise.session import materialize
        d = materialize(CT.datasets(spark, sf_dir))
        cols = CT.table_columns(spark, sf_dir, d)
        return R.report_skipped(D.capability_plan(MP.mapped_columns(cols, CT.overrides(spark, sf_dir, d))))

    return {
        "order_findings": _on_saved_rows(FD.order_findings),
        "sales_findings": _on_saved_rows(FD.sales_findings),
        "score_findings": _stu(FD.score_findings),
        "inventory_findings": _inv(FD.inventory_findings),
        "safe_payload": _on_saved_rows(FD.safe_payload),
        "report_overview": _on_saved_rows(R.report_overview),
        "student_overview": _stu(R.student_overview),
        "inventory_overview": _inv(R.inventory_overview),
        "report_order_tables": _on_saved_rows(R.report_order_tables),
        "report_student_tables": _stu(R.report_student_tables),
        "report_inventory_tables": _inv(R.report_inventory_tables),
        "report_skipped": skipped,
        "region_chart_series": _on_rows(R.region_chart_series),
        "kpi_rows": _on_saved_rows(R.kpi_rows),
        "analysis_coverage": _on_raw(R.analysis_coverage),
    }


def _file_queries() -> dict[str, Query]:
    from sheetwise.sources import catalog as CT
    from sheetwise.session import checkpoint_dir
    from sheetwise.sources import files as FS
    from sheetwise.sources import sinks as SK
    from sheetwise.sources.sinks import preview

    def csv_scan(spark, sf_dir):
        root = CT.landing_folder(spark, sf_dir)
        return FS.read_csv_folder(spark, f"{root}/csv/*/*.csv").drop("_file", "_pos")

    def xlsx_scan(spark, sf_dir):
        root = CT.landing_folder(spark, sf_dir)
        return FS.workbook_frame(FS.read_workbooks(spark, f"{root}/xlsx"),
                                 ["s_suppkey", "s_name", "s_nationkey"]).drop("_pos")

    def manifest(spark, sf_dir):
        root = CT.landing_folder(spark, sf_dir)
        return FS.landing_manifest(spark, f"{root}/*/*").drop("path")

    def file_charsets(spark, sf_dir):
        root = CT.landing_folder(spark, sf_dir)
        cs = FS.file_charsets(spark, f"{root}/csv/*/*.csv")
        return cs.groupBy(F.regexp_extract("file", r"/csv/([^/]+)/", 1).alias("folder"), "charset").agg(
            F.count(F.lit(1)).alias("files"))

    def dated_workbooks(spark, sf_dir):
        root = CT.landing_folder(spark, sf_dir)
        rows = FS.read_workbooks(spark, f"{root}/dated/a").unionByName(FS.read_workbooks(spark, f"{root}/dated/b"))
        return FS.workbook_frame(rows).drop("_pos")

    def odd_headers(spark, sf_dir):
        root = CT.landing_folder(spark, sf_dir)
        return FS.read_csv_folder(spark, f"{root}/odd_headers/*.csv").drop("_file", "_pos").withColumnRenamed("two\nlines", "two lines")

    def sinks(spark, sf_dir):
        """Catalogue rows and audit events, each written twice and read back."""
        root = f"{checkpoint_dir(spark)}/sinks/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
        log = CT.audit_log(spark, sf_dir)
        profile = P.column_profile(log.select("id", "user_id", "action"))
        for _ in range(2):
            SK.catalog_append(spark, root, {"dataset_id": 7, "file_name": "events.csv"}, profile)
            SK.audit_append(spark, root, log.where("id % 2 = 0"), "even")
            SK.audit_append(spark, root, log.where("id % 2 = 1"), "odd")
            runs = CT.cleaning_runs(spark, sf_dir).where("run_id % 500 = 0")
            SK.write_runs(runs.select("dataset_id", "run_id", "cleaned_storage_path"), root)
        counts = [spark.read.parquet(f"{root}/{name}").agg(F.lit(name).alias("sink"), F.count(F.lit(1)).alias("rows"), key.cast("long").alias("key_total"))
                  for name, key in (("datasets", F.sum("dataset_id")), ("dataset_columns", F.sum("unique_count")), ("audit", F.sum("id")), ("runs", F.sum("run_id")))]
        return counts[0].union(counts[1]).union(counts[2]).union(counts[3])

    return {
        "csv_headers": odd_headers,
        "xlsx_dates": dated_workbooks,
        "sinks_written_twice": sinks,
        "csv_scan": csv_scan,
        "xlsx_batch_scan": xlsx_scan,
        "landing_manifest": manifest,
        "csv_charsets": file_charsets,
        "preview": lambda spark, sf_dir: preview(raw_sales(spark, sf_dir)),
    }


# Headers that users give to canonical columns (others keep their name).
UPLOAD_HEADERS = {
    "order_id": "订单编号", "product": "产品", "quantity": "数量", "unit_price": "单价", "sales_amount": "销售额",
    "customer_id": "客户编号", "customer_name": "客户姓名", "region": "区域", "date": "订单日期", "discount": "折扣率",
    "target_amount": "目标额", "student_id": "学号", "student_name": "学生姓名", "subject": "科目", "score": "成绩",
    "class_name": "班级", "exam_name": "考试名称", "exam_date": "考试日期", "product_id": "商品编号", "product_name": "产品名称",
    "stock_quantity": "库存数量", "safety_stock": "安全库存", "unit_cost": "单位成本", "warehouse": "仓库", "supplier": "供应商",
    "inbound_quantity": "入库数量", "outbound_quantity": "出库数量", "inventory_date": "盘点日期",
}


LOT = "_lot"


def _analyzed(cells: DataFrame, by: str | None = None):
    """A view as a user's upload - text cells under Chinese headers - analysed.  ``by`` names the cell by
    which the view's rows are dealt: equal rows lie in one task already."""
    from sheetwise.plans.analyze import analyze
    text = [F.col(c) if c == O.POS else F.col(c).cast("string").alias(UPLOAD_HEADERS.get(c, c)) for c in cells.columns]
    return analyze(cells.select(*text, F.col(by).alias(LOT)), lot=LOT) if by else analyze(cells.select(*text))


def _dealt_by(view: Callable[[SparkSession, str], DataFrame]) -> str | None:
    """The order view's rows lie by order number, since its last join is by it."""
    return "ok" if view is order_lines else None


def _uploaded(view: Callable[[SparkSession, str], DataFrame], result: str) -> Query:
    """A view as a user's upload, from raw cells to one result."""
    return lambda spark, sf_dir: _analyzed(view(spark, sf_dir), _dealt_by(view)).result(result)


# key: the query over typed columns whose result it must equal
UPLOADED = {"uploaded_product_sales": "product_sales", "uploaded_region_sales": "region_sales", "uploaded_daily_sales": "daily_sales",
            "uploaded_customers": "customer_rollup", "uploaded_subject_score": "subject_score", "uploaded_category_stock": "category_stock"}


# Uploads that lack columns, so that some analyses of their domain are skipped.
PARTIAL_UPLOADS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], tuple[str, ...]]] = {
    "order": (order_lines, ("payment_method", "gender", "age")),
    "scores": (student_scores, ("class_name", "exam_date")),
    "stock": (inventory_rows, ("supplier", "outbound_quantity")),
    "generic": (lambda spark, sf_dir: document_profile_frame(spark, sf_dir).drop("text"), ()),
}


def _outcome(upload: str, part: str) -> Query:
    """One part of what is made of an upload: coverage, payload, kpis or findings."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from sheetwise.plans import outcome
        view, absent = PARTIAL_UPLOADS[upload]
        return getattr(outcome, part)(_analyzed(view(spark, sf_dir).drop(*absent), _dealt_by(view)))
    return run


def _listed(query: Query, name: str) -> Query:
    return lambda spark, sf_dir: in_order(name, query(spark, sf_dir))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    views = {"subject_score": student_scores, "category_stock": inventory_rows}
    out.update({key: _uploaded(views.get(result, order_lines), result) for key, result in UPLOADED.items()})
    out.update(_file_queries())
    out.update(_report_queries())
    out.update(_catalog_queries())
    out.update(PROFILE_QUERIES)
    out.update(CLEANING_QUERIES)
    out.update(ORDER_QUERIES)
    out.update(INVENTORY_QUERIES)
    out.update(SCORE_QUERIES)
    out.update({f"upload_{upload}_{part}": _outcome(upload, part) for upload in PARTIAL_UPLOADS
                for part in ("coverage", "payload", "kpis", "findings")})
    out["exam_names"] = lambda spark, sf_dir: S.exam_trend(student_scores(spark, sf_dir).drop("exam_date"))
    lists = {**{name: name for name in ORDERS}, "exam_names": "exam_trend"}
    out.update({key: _listed(out[key], name) for key, name in lists.items()})
    return out
