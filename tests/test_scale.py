"""Tasks that don't grow with the table: how rows are dealt, and how often they move."""
import re
from datetime import date

from helpers import rows

from sheetwise import session
from sheetwise.operators import orders as O
from sheetwise.sources.fixtures import order_lines


def _tables(spark, folder, orders=40):
    made = {
        "region": ("r_regionkey long, r_name string", [(0, "ASIA")]),
        "nation": ("n_nationkey long, n_name string, n_regionkey long", [(0, "CHINA", 0)]),
        "customer": ("c_custkey long, c_name string, c_nationkey long", [(1, "Customer#1", 0)]),
        "part": ("p_partkey long, p_name string, p_type string, p_retailprice double", [(1, "bolt", "STEEL", 2.5)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate date, o_orderstatus string, o_orderpriority string, o_totalprice double",
                   [(i, 1, date(2024, 1, 1 + i % 28), "F", "1-URGENT", 10.0) for i in range(orders)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string",
                     [(i, 1, 1, n, 3.0, 0.1, "N") for i in range(orders) for n in (1, 2)]),
    }
    for name, (schema, data) in made.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_order_rows_are_dealt_by_their_number_and_move_no_more(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(session, "ROWS_A_TASK", 8)
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # as with large tables
    try:
        found = O.order_rows(order_lines(spark, _tables(spark, tmp_path)))
        found.explain()
        plan = capsys.readouterr().out
        assert re.search(r"hashpartitioning\(l_orderkey#\d+L, 10\), REPARTITION_BY_NUM", plan)   # 80 lines, 8 a task
        assert "hashpartitioning(order_id" not in plan   # copies lie together already
        assert sorted(r["_copies"] for r in rows(found, "_copies")) == [1] * 78 + [2] * 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


def test_cleaning_and_deduplication_share_one_shuffle(spark, capsys):
    from sheetwise.operators.cleaning import cleaned
    data = [(0, "O1", "2024-01-02", "1,000"), (1, "O1", "2024/1/2", "1000"), (2, "O1", "2024-01-02", "1,000"),
            (3, "O2", None, "x"), (4, "O2", "bad", "NA"), (5, None, "NA", ""), (6, None, "2024-01-03", "-0")]
    cells = spark.createDataFrame(data, "_pos long, order_id string, date string, sales_amount string")
    dealt, plain = O.dedup_with_copies(cleaned(cells, 3)), O.dedup_with_copies(cleaned(cells))
    assert rows(dealt) == rows(plain)
    assert rows(dealt.where("order_id = 'O1'")) == [
        {"order_id": "O1", "date": "2024-01-02", "sales_amount": 1000.0, "_copies": 2, "_pos": 0}]
    dealt.explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan   # equal once standardised: in one task already


def test_an_order_upload_is_written_once(spark, monkeypatch):
    from sheetwise.plans import analyze as A
    written = []
    monkeypatch.setattr(A, "materialize", lambda df: written.append(df.columns) or session.materialize(df))
    cells = spark.createDataFrame([("O1", "茶", "2", "10"), ("O2", "书", "1", "5")], "`订单编号` string, `产品` string, `数量` string, `单价` string")
    assert A.analyze(cells).domain == "order"
    assert sum("order_id" in columns for columns in written) == 1


def test_an_upload_of_the_order_view_stays_where_its_last_join_left_it(spark, tmp_path, monkeypatch, capsys):
    from sheetwise import suite
    from sheetwise.plans import analyze as A
    folder, written = _tables(spark, tmp_path / "in"), []
    monkeypatch.setattr(A, "materialize", lambda df: written.append(df) or session.materialize(df))
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # as with large tables
    try:
        found = rows(suite.queries()["uploaded_customers"](spark, folder))
        table = next(df for df in written if "_copies" in df.columns)
        table.explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    plan = capsys.readouterr().out
    assert "rangepartitioning" not in plan and "hashpartitioning(order_id" not in plan   # both deduplications move nothing
    assert "_lot" not in table.columns and "_expected" not in table.columns
    plain = suite._analyzed(order_lines(spark, folder))   # dealt by its cells
    assert found == rows(plain.result("customer_rollup"))
    assert rows(table) == rows(O.order_rows(A.cleaned(plain.table)).select(table.columns))


def test_rows_with_a_lot_are_cleaned_like_others(spark):
    from sheetwise.operators.cleaning import cleaned
    data = [(7, 0, "O1", "2024-01-02", "1,000"), (7, 1, "O1", "2024/1/2", "1000"), (7, 2, "O1", "2024-01-02", "1,000"),
            (8, 3, "O2", None, "x"), (8, 4, "O2", "bad", "NA"), (None, 5, None, "NA", ""), (None, 6, None, "2024-01-03", "-0")]
    cells = spark.createDataFrame(data, "_lot long, _pos long, order_id string, date string, sales_amount string")
    lots = O.dedup_with_copies(cleaned(cells, lot="_lot")).drop("_lot")
    assert rows(lots) == rows(O.dedup_with_copies(cleaned(cells.drop("_lot"))))


def test_coverage_computes_the_raw_table_once(spark, tmp_path):
    from sheetwise.operators.report import analysis_coverage
    folder = _tables(spark, tmp_path / "in")
    order_lines(spark, folder).write.parquet(f"{tmp_path}/raw")
    found = analysis_coverage(spark.read.parquet(f"{tmp_path}/raw"))
    assert not [f for f in found.inputFiles() if "/raw/" in f]   # the plan follows from the rows that are written anyway
    covered = {r["capability_id"] for r in rows(found) if r["covered"]}
    assert {"order_count", "product_sales", "region_sales", "demographic_analysis"} <= covered


_ORDERS = [("A", "Luoyang", "2", "1.005", "1.005", "+86 138-0000", 1), ("A", "洛阳市", "3", "2", "9", "12-3", 2), ("A", "ＬＵＯＹＡＮＧ", None, None, "4", None, 1),
           ("B", "Ｘ1", "-1", "5", "-3", "(0571) 8888-9999", 1), (None, "luoyang", "1", "7", "8", "+1+2345678", 3), (None, None, "1", None, "0.005", "++12345678", 1),
           (None, "X1", "x", "1", "0.005", " ", 1), (" ", "Ｘ1", "0", "1", "1", "1234567", 1)]


def _order_frame(spark):
    return O.prepare(spark.createDataFrame(_ORDERS, "order_id string, region string, quantity string, unit_price string, sales_amount string, phone string, _copies long"))


def test_quality_is_one_pass_without_a_written_copy(spark, monkeypatch):
    monkeypatch.setattr(O, "materialize", None)
    got = rows(O.data_quality(_order_frame(spark)))[0]
    assert {k: got[k] for k in ("row_count", "duplicate_row_count", "duplicate_order_id_count", "amount_mismatch_count", "amount_comparable_count",
                                "unverified_order_count", "unverified_amount_total", "invalid_amount_count", "invalid_quantity_count",
                                "phone_valid_count", "phone_invalid_count", "phone_missing_count")} == {
        # A (2.01 and 6 against 1.005 and 9) and the first row without an id differ, the blank id's row too; of the
        # others, A's third row and two rows without an id are unverified: 4 + 0.01 + 0.01
        "row_count": 11, "duplicate_row_count": 3, "duplicate_order_id_count": 3, "amount_mismatch_count": 3, "amount_comparable_count": 3,
        "unverified_order_count": 3, "unverified_amount_total": 4.02, "invalid_amount_count": 1, "invalid_quantity_count": 1,
        "phone_valid_count": 3, "phone_invalid_count": 6, "phone_missing_count": 2}
    empty = rows(O.data_quality(_order_frame(spark).limit(0)))[0]
    assert empty["row_count"] == 0 and empty["amount_mismatch_count"] == 0 and empty["unverified_amount_total"] is None


def test_spellings_of_regions_are_read_once_an_order(spark, capsys):
    found = O.region_sales(_order_frame(spark))
    assert [(r["name"], r["region_order_count"], r["region_sales"], r["region_quantity"]) for r in rows(found)] == [
        ("X1", 1, 0.0, 0.0), ("洛阳", 1, 15.01, 6.0)]   # rows without an id count only where none has one
    found.explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[0]
    assert "HashAggregate" in plan.split("ArrowEvalPython")[-1]   # summed by spelling and order below the Python node


def test_phones_and_dates_in_one_step_are_those_of_all_steps(spark):
    from sheetwise.functions.normalize import order_date_text, valid_phone
    from pyspark.sql import functions as F
    ws = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]"
    blank = ["", " ", "-", "(", ")", "\n", "\u3000", "\x85", "+", "x", "/", "年"]
    texts = [a + core + b for a in blank for b in blank for core in ("1234567", "123 4567", "+1234567", "1+234567", "123456", "1" * 16, "2024-01-02", "2024-1-2  3:4:5", "2024-01-02 03:04:05")]
    c = F.col("t")
    digits = F.regexp_replace(F.regexp_replace(c, rf"{ws}|[-()]", ""), r"^\+", "")
    steps = F.regexp_replace(F.regexp_replace(F.translate(c, "年月/.", "----"), "日", " "), rf"{ws}+", " ")
    odd = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").where(
        ~(valid_phone(c).eqNullSafe(F.coalesce(digits.rlike(r"^\p{Nd}{7,15}$"), F.lit(False))))
        | ~(order_date_text(c).eqNullSafe(F.regexp_replace(steps, rf"^{ws}+|{ws}+$", ""))))
    assert odd.count() == 0
