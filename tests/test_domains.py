from helpers import one, rows

from sheetwise.operators import inventory as I
from sheetwise.operators import scores as S
from sheetwise.plans import domains as D
from sheetwise.plans import mapping as MP


def test_inventory_basics(spark):
    df = spark.createDataFrame([
        ("P1", "bolt", "hw", "north", "Acme", "10", "12", "3.5", "5", "2", "2026-01-02"),
        ("P2", "nut", "hw", "north", " ", "lots", "4", "1", "7", "9", "2026/01/01"),
        ("P3", None, "tools", "south", "Acme", "25", "30", "10", "5", "5", "oops"),
    ], "product_id string, product_name string, category string, warehouse string, supplier string, "
       "stock_quantity string, safety_stock string, unit_cost string, inbound_quantity string, "
       "outbound_quantity string, inventory_date string")
    assert one(I.inventory_count(df))["inventory_count"] == 3
    s = one(I.stock_summary(df))
    assert (s["count"], s["total"], s["median"]) == (2, 35.0, 17.5)
    assert one(I.inventory_value(df))["total"] == 285.0
    assert {r["product_id"]: r["shortage"] for r in rows(I.low_stock(df))} == {"P1": 2.0, "P3": 5.0}
    assert {r["name"]: r["value"] for r in rows(I.supplier_stock(df))} == {"Acme": 35.0}
    f = one(I.inventory_flow(df))
    assert (f["total_inbound"], f["total_outbound"], f["net_change"]) == (17.0, 16.0, 1.0)
    assert [r["name"] for r in I.inventory_trend(df).orderBy("name").collect()] == ["2026-01-02"]


def test_scores_zero_kept_and_exam_fallback(spark):
    df = spark.createDataFrame([
        ("s1", "Ann", "math", "0", "c1", "mid", None), ("s1", " ", "math", "90", "c1", "final", None),
        (" ", "Bo", "art", "abc", None, "mid", None), ("s2", "Bo", None, "60", "c2", "mid", None),
    ], "student_id string, student_name string, subject string, score string, class_name string, "
       "exam_name string, exam_date string")
    assert one(S.student_count(df))["student_count"] == 2
    sm = one(S.score_summary(df))
    assert (sm["count"], sm["minimum"], sm["average"]) == (3, 0.0, 50.0)
    trend = {r["name"]: r["average"] for r in rows(S.exam_trend(df))}
    assert trend == {"mid": 30.0, "final": 90.0}   # no date parses -> by exam name
    st = {r["student_id"]: r for r in rows(S.student_rollup(df))}
    assert st["s1"]["student_name"] == "Ann" and st["s1"]["score_count"] == 2


def _mapped(spark, names, overrides=None):
    got = MP.map_table(spark, names, overrides).collect()
    renames = {r["sources"]: r["target"] for r in got if r["outcome"] in ("override", "automatic")}
    return renames, {r["target"]: (r["outcome"], r["sources"]) for r in got if r["outcome"].startswith("conflict")}


def test_header_conflicts_and_ambiguous_product(spark):
    renames, conflicts = _mapped(spark, ["score", "分数", "成绩", "x"])
    assert renames == {} and conflicts["score"][0] == "conflict_canonical"
    assert _mapped(spark, ["商品编号", "商品名称", "库存数量"])[0]["商品名称"] == "product_name"
    assert _mapped(spark, ["订单编号", "商品名称", "数量"])[0]["商品名称"] == "product"
    renames, conflicts = _mapped(spark, ["销售额", "销售金额"])
    assert renames == {} and conflicts["sales_amount"] == ("conflict_multiple", "销售额,销售金额")


def test_overrides_validation(spark):
    import pytest
    with pytest.raises(ValueError, match="duplicate_target"):
        MP.map_table(spark, ["a", "b"], {"a": "phone", "b": "phone"})
    with pytest.raises(ValueError, match="unknown_target"):
        MP.map_table(spark, ["a"], {"a": "nope"})
    renames, conflicts = _mapped(spark, ["memo", "手机"], {"memo": "phone"})
    assert renames == {"memo": "phone"} and conflicts["phone"][0] == "conflict_override"


def test_canonicalize_is_a_projection(spark):
    df = spark.createDataFrame([("1", "2", "x")], "`订单编号` string, `数量` string, memo string")
    assert MP.canonicalize(df, {"memo": "customer_name"}).columns == ["order_id", "quantity", "customer_name"]


def test_plug_in_capabilities(spark):
    own = D.Domain("sensor", "sensor", "0.9", "0.05", (("temperature", "device"),), (("heat", "heat", ("temperature",), ()),))
    cat = _catalog(spark, {1: [("temperature", 3), ("device", 3)]})
    plan = D.capability_plan(cat, domains=[*D.registry(), own]).collect()
    assert [(r["capability_id"], r["supported"]) for r in plan] == [("heat", True)]


def test_normalize_header_nfkc(spark):
    df = spark.createDataFrame([("ＯＲＤＥＲ＿ＩＤ",), (" Order - Id ",)], "name string")
    assert {r["key"] for r in MP.header_key(df).collect()} == {"orderid"}


def _catalog(spark, tables):
    data = [(d, i, n, nn) for d, cols in tables.items() for i, (n, nn) in enumerate(cols)]
    return spark.createDataFrame(data, "dataset_id long, pos int, name string, non_null long")


def test_domain_choice_tie_and_plan(spark):
    cat = _catalog(spark, {
        1: [("score", 3), ("student_id", 3)],                        # student 0.65
        2: [("product_id", 2), ("stock_quantity", 2), ("sales_amount", 2)],  # order 0.55, inventory 0.6
        3: [("note", 1)],
        4: [("sales_amount", 1), ("score", 1), ("student_id", 1), ("product", 0), ("order_id", 1)],
    })
    choice = {r["dataset_id"]: (r["domain"], r["score"]) for r in rows(D.domain_choice(cat))}
    assert choice[1] == ("student_score", 0.65)
    assert choice[2] == ("inventory", 0.6)
    assert choice[3] == ("generic", 0.0)
    assert choice[4] == ("order", 0.85)   # product counts for the domain even without values
    plan = {r["capability_id"]: r for r in rows(D.capability_plan(cat).where("dataset_id = 4"))}
    assert plan["product_sales"]["supported"] is False and plan["product_sales"]["missing_fields"] == "product"
    assert plan["sales_total"]["matched_fields"] == "sales_amount"
    assert plan["region_sales"]["missing_fields"] == "region"      # fewest-missing alternative is complete
    assert plan["demographic_analysis"]["missing_fields"] == "gender"


def test_catalog_mapping_matches_single_table(spark):
    tables = {7: ["订单编号", "商品名称", "数量", "销售额", "销售金额", "memo"], 8: ["SKU", "商品名称", "库存"]}
    cat = _catalog(spark, {k: [(n, 1) for n in v] for k, v in tables.items()})
    ov = spark.createDataFrame([(7, 0, "memo", "customer_name")], "dataset_id long, seq int, source string, target string")
    mapped = {(r["dataset_id"], r["source"]): r["name"] for r in rows(MP.mapped_columns(cat, ov))}
    for d, cols in tables.items():
        rename, _ = _mapped(spark, cols, {"memo": "customer_name"} if d == 7 else None)
        for c in cols:
            assert mapped[(d, c)] == rename.get(c, c)


def test_stock_dates_and_labels_are_read_once_for_each_text(spark, capsys):
    data = [("2024-01-02", " a ", "1"), ("2024/1/2", "a", "2"), ("bad", "  ", "4"), (None, None, "8"), ("2024-01-03", "b", "x"), ("2024-01-03", "b", "inf")]
    df = spark.createDataFrame(data, "inventory_date string, warehouse string, stock_quantity string")
    trend, stock = I.inventory_trend(df), I.warehouse_stock(df)
    assert rows(trend) == [{"name": "2024-01-02", "value": 3.0}, {"name": "2024-01-03", "value": None}]
    assert rows(stock) == [{"name": "a", "value": 3.0}, {"name": "b", "value": None}]
    for found, read in ((trend, "gettimestamp"), (stock, "warehouse, Some")):
        found.explain()
        plan = capsys.readouterr().out
        assert plan.count("HashAggregate") >= 4 and read not in plan.split("Exchange")[-1].lower()   # after the first sum


def test_payload_cells_are_named_after_the_sort(spark):
    from sheetwise.plans.outcome import ordered_sections
    a = spark.createDataFrame([("x", 1.0), ("y", 3.0)], "name string, value double")
    b = spark.createDataFrame([(5, None)], "n int, word string")
    found = ordered_sections([("s", "warehouse_stock", a, [("label", "name"), ("amount", "value")]), ("t", "other", b, [("count", "n"), ("word", "word")])], spark)
    assert {tuple(r) for r in found.collect()} == {
        ("s", 1, 0, "label", "y", None), ("s", 1, 1, "amount", None, 3.0), ("s", 2, 0, "label", "x", None), ("s", 2, 1, "amount", None, 1.0),
        ("t", 1, 0, "count", None, 5.0), ("t", 1, 1, "word", None, None)}
