"""Coverage, payload, KPIs and findings of analysed tables of every domain."""
from helpers import rows

from sheetwise.plans import outcome
from sheetwise.plans.analyze import analyze


def test_orders_with_absent_columns(spark):
    df = spark.createDataFrame([
        (0, "O1", "C1", "Ann", "茶", "2", "10", "上海", "1-a", "2024-01-05"), (1, "O2", "C1", "Ann", "书", "1", "70", "北京", None, "2024-01-06"),
        (2, "O3", "C2", "Bob", "茶", "1", "10", "北京", None, None),
    ], "_pos long, `订单编号` string, `客户编号` string, `客户姓名` string, `产品` string, `数量` string, `单价` string, `区域` string, `手机` string, `订单日期` string")
    a = analyze(df)
    covered = {r["capability_id"]: r["covered"] for r in outcome.coverage(a).collect()}
    assert covered["product_sales"] and covered["sales_trend"] and not covered["status_analysis"] and not covered["target_completion"]
    reasons = {r["capability_id"]: r["missing_fields"] for r in outcome.coverage(a).collect() if not r["covered"]}
    assert reasons["status_analysis"] == "status" and reasons["payment_method_analysis"] == "payment_method"
    payload = outcome.payload(a).collect()
    text = " ".join(r["value_text"] or "" for r in payload)
    assert "Ann" not in text and "Bob" not in text and "1-a" not in text
    fields = {(r["section"], r["field"]) for r in payload}
    assert ("top_customers", "customer_name") not in fields and ("data_quality", "phone_missing_count") not in fields
    assert ("data_quality", "unverified_amount_total") not in fields and ("overview", "unverified_amount_total") in fields
    assert [r["value_text"] for r in sorted(payload) if r["section"] == "product_analysis" and r["field"] == "name"] == ["书", "茶"]
    assert [r["value_text"] for r in sorted(payload) if r["section"] == "daily_sales_trend" and r["field"] == "name"] == ["2024-01-05", "2024-01-06"]
    kpis = {r["header"]: r["value_num"] for r in outcome.kpis(a).collect()}
    assert kpis["订单数量"] == 3 and kpis["客户数量"] == 2 and "退款率" not in kpis
    codes = {r["code"] for r in outcome.findings(a).collect()}
    assert "region_gap" in codes and "sales_trend_up" in codes and "refund_orders" not in codes and "low_target_completion" not in codes


def test_scores_inventory_and_generic(spark):
    s = analyze(spark.createDataFrame([("1", "90"), ("2", "70")], "`学号` string, `成绩` string"))
    assert {r["capability_id"] for r in outcome.coverage(s).collect() if r["covered"]} == {"student_count", "score_summary", "student_score"}
    assert {r["header"]: r["value_num"] for r in outcome.kpis(s).collect()} == {"学生数量": 2, "平均分": 80, "最高分": 90, "最低分": 70, "中位数": 80}
    assert [r["code"] for r in outcome.findings(s).collect()] == ["top_student"]
    i = analyze(spark.createDataFrame([("p", "3", "5"), ("q", "9", "5")], "`商品编号` string, `库存数量` string, `安全库存` string"))
    assert {r["header"]: r["value_num"] for r in outcome.kpis(i).collect()} == {"商品数量": 2, "库存总量": 12, "平均库存": 6, "最大库存": 9, "最小库存": 3}
    assert [(r["code"], r["value"]) for r in outcome.findings(i).collect()] == [("low_stock", 1.0)]
    g = analyze(spark.createDataFrame([("x", None), ("y", "1")], "memo string, extra string"))
    assert {r["header"]: r["value_num"] for r in outcome.kpis(g).collect()} == {"数据行数": 2, "字段数量": 2}
    assert [r["capability_id"] for r in outcome.coverage(g).collect() if r["covered"]] == ["generic_analysis"]
    assert [r["subject"] for r in rows(outcome.findings(g))] == ["extra"]
    sections = {r["section"] for r in outcome.payload(g).collect()}
    assert sections == {"selected_module", "available_fields", "analysis_plan", "row_count", "column_profile", "missing_value_summary"}
