from helpers import one, rows

from sheetwise.operators import orders as O
from sheetwise.plans.analyze import analyze


def test_orders_from_raw_cells(spark):
    df = spark.createDataFrame([
        (0, "O1", "C1", None, "茶", "2", "10.005", "NA", "上海"), (1, "O2", "C1", "Zed", "茶", "1", "1e300", "1", "北京市"),
        (2, "O3", "C1", "Amy", "书", "3", "5", "1", "北京"), (3, "O3", "C1", "Amy", "书", "3", "5", "1", "北京"), (4, None, None, None, None, None, None, None, None),
    ], "_pos long, `订单编号` string, `客户编号` string, `客户姓名` string, `产品` string, `数量` string, `单价` string, `折扣率` string, `区域` string")
    got = analyze(df)
    assert got.domain == "order" and "_pos" in got.table.columns
    supported = {p["capability_id"] for p in got.plan if p["supported"]}
    assert "product_sales" in supported and "status_analysis" not in supported
    assert "status_analysis" not in got.results and "exam_trend" not in got.results
    sales = {r["name"]: (r["quantity"], r["sales_amount"]) for r in rows(got.results["product_sales"])}
    assert sales["书"] == (3.0, 15.0) and sales["茶"][0] == 3.0   # duplicates count once, 1e300 ends nothing
    assert one(got.results["customer_rollup"])["customer_name"] == "Zed"   # the first name that is not blank


def test_overrides_decide_the_domain(spark):
    df = spark.createDataFrame([("a", "90"), ("b", "70")], "memo string, points string")
    assert analyze(df).domain == "generic" and set(analyze(df).results) == {"table_shape", "column_profile", "missing_rate"}
    got = analyze(df, {"memo": "student_id", "points": "score"})
    assert got.domain == "student_score" and one(got.results["score_summary"])["average"] == 80.0


def test_huge_and_infinite_amounts_do_not_end_the_job(spark):
    df = spark.createDataFrame([("O1", "1e300", "1"), ("O2", "2", "3"), ("O3", "inf", "1")], "order_id string, unit_price string, quantity string")
    assert one(O.sales_summary(O.order_rows(df)))["total"] == 6.0


def test_results_of_tables_without_columns(spark):
    from sheetwise.operators import findings as FD
    from sheetwise.operators import report as R
    scores = spark.createDataFrame([("90",), ("80",)], "score string")
    assert rows(R.report_student_tables(scores)) == [] and FD.score_findings(scores).count() >= 0
    stock = spark.createDataFrame([("p", "3")], "product_name string, stock_quantity string")
    assert FD.inventory_findings(stock).count() >= 0 and R.report_inventory_tables(stock).count() >= 0
    full = spark.createDataFrame([("s", "90", "m", "c", "n")], "student_id string, score string, subject string, class_name string, student_name string")
    from sheetwise.operators import scores as S
    for fn in (S.subject_score, S.class_score, S.student_rollup):
        assert set(fn(scores).columns) == set(fn(full).columns)
