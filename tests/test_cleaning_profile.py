from helpers import one, rows

from sheetwise.operators import cleaning as C
from sheetwise.operators import profile as P


def test_clean_pipeline_counts(spark):
    df = spark.createDataFrame([
        ("2026/07/01", "north", "1,200", None, "x"),
        ("2026-07-02", "north", "1200", "N/A", None),
        ("2026-07-02", "north", "1200", "N/A", None),
        (None, None, None, None, None),
        ("not a date", "south", "¥30", "5", "y"),
        ("2026年7月3日", None, "abc", "7", None),
    ], "`日期` string, `区域` string, `销售额` string, `目标额` string, `大区` string")
    s = one(C.clean_summary(df))
    assert (s["original_row_count"], s["cleaned_row_count"]) == (6, 4)
    assert (s["removed_empty_rows"], s["removed_duplicate_rows"]) == (1, 1)
    assert s["invalid_value_count"] == 2            # 'not a date', 'abc'
    cleaned = rows(C.cleaned(df))
    assert {r["sales_amount"] for r in cleaned} == {1200.0, 30.0, None}
    assert {r["date"] for r in cleaned} == {"2026-07-01", "2026-07-02", "2026-07-03", None}
    # 区域 and 大区 both alias to region: merged left to right
    assert {r["region"] for r in cleaned} == {"north", "south", "x", None} - {"x"} | {"north"}


def test_number_text_rules(spark):
    from sheetwise.functions.columns import to_number
    df = spark.createDataFrame([(v,) for v in ("1", " 2.5 ", "1d", "nan", "1,200", "inf", "-3e2", "１")], "v string")
    got = [r[0] for r in df.select(to_number(df, "v")).collect()]
    assert got[:2] == [1.0, 2.5] and got[2] is None and got[3] is None and got[4] is None
    assert got[5] == float("inf") and got[6] == -300.0 and got[7] is None


def test_profile_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "a string, b int")
    assert {r["column_name"]: r["missing_rate"] for r in rows(P.missing_rate(empty))} == {"a": 0.0, "b": 0.0}
    df = spark.createDataFrame([("x", None), (None, None)], "a string, b int")
    prof = {r["name"]: r for r in rows(P.generic_profile(df))}
    assert prof["b"]["dtype"] == "float64" and prof["b"]["null_count"] == 2
    assert [r["name"] for r in rows(P.available_fields(df))] == ["a"]
    types = {r["name"]: r["data_type"] for r in rows(P.infer_types(spark.createDataFrame(
        [("1", "true", "a"), ("2.5", "false", None)], "n string, b string, t string")))}
    assert types == {"n": "number", "b": "boolean", "t": "text"}


def test_date_shapes_equal_ladder(spark):
    from pyspark.sql import functions as F

    from sheetwise.functions.normalize import DATE_LADDER, order_date_text, parse_date_text
    values = ["2026-07-01", "2026/7/1", "2026.07.01 08:05", "2026年7月1日", "2026-7-1T1:2:3", "20260701", "2026",
              "01/02/2026", "13/02/2026", "Mar 5 2026", "Mar 5, 2026", "5 Mar 2026 10:30", "5 Mar 2026", "2026-07",
              "2026-13-01", "bad", "", "2026-001-01", "09:45:30.5", "2026-02-30", "12026-1-1", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    t = order_date_text(F.col("v"))
    ladder = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in DATE_LADDER]).cast("timestamp_ntz")
    got = df.select(ladder.alias("a"), parse_date_text(t).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]
