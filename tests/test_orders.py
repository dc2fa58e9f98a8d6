from decimal import Decimal as D

from helpers import one, rows

from sheetwise.operators import orders as O

SCHEMA = ("order_id string, customer_id string, customer_name string, product string, category string, "
          "region string, status string, payment_method string, date string, unit_price string, quantity string, "
          "discount string, sales_amount string, gender string, age string, phone string, email string")


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def base_rows():
    # order_id, customer, name, product, category, region, status, pay, date, price, qty, disc, sales, gender, age,
    # phone, email
    return [
        ("A1", "c1", "Ann", "pen", "office", " Luoyang ", "已完成", "card", "2026/03/01", "10", "2", "0.5", "10",
         "F", "30", "138 0000 1111", "ann@shop.example.org"),
        ("A1", "c1", "Ann", "ink", "office", "洛阳市", "completed", "card", "2026年3月1日", "5", "4", None, "20",
         "F", "30", "138 0000 1111", "ann@shop.example.org"),
        ("A2", "c2", None, "pen", None, "zhengzhou", "取消", "cash", "2026-03-05 10:30:00", "10", "3", "1", "31",
         None, "0", "12-3", "bad-mail"),
        ("A2", "c2", None, "pen", None, "zhengzhou", "取消", "cash", "2026-03-05 10:30:00", "10", "3", "1", "31",
         None, "0", "12-3", "bad-mail"),
        (None, "c3", "Cy", "cup", "home", "Other Town", "退款中", "card", "bad date", "-1", "1", "1", "7", "M",
         "130", None, None),
        (None, "c2", "Bo", "cup", "home", "Other Town", "??", None, None, "0", "5", "0.8", None, "M", "44",
         "+8613800001111", "bo@example.com"),
    ]


def test_overview_zero_is_not_missing_and_dedup(spark):
    rows_ = O.order_rows(frame(spark, base_rows()))
    ov = one(O.order_overview(rows_))
    assert ov["record_count"] == 6          # all rows, the duplicate included
    assert ov["order_count"] == 4           # A1, A2 and two rows without id
    # A1: 10*2*0.5 = 10 (second line has no discount value -> not verifiable); A2: 30; zero-price row: 0
    assert ov["verified_order_count"] == 3
    assert ov["verified_sales_total"] == 40.0
    assert ov["minimum_verified_order_value"] == 0.0   # a real zero is kept
    assert ov["median_verified_order_value"] == 10.0
    assert ov["unverified_order_count"] == 2           # A1 (line 2 has only a raw amount) and the -1 price row
    assert ov["unverified_amount_total"] == 27.0       # A1 line 2 (20) + row 5 (7)
    assert ov["amount_mismatch_count"] == 1            # A2: 30 vs 31
    assert ov["completed_sales_amount"] == 10.0
    assert ov["cancelled_order_amount"] == 30.0


def test_hybrid_counts_and_status(spark):
    rows_ = O.order_rows(frame(spark, base_rows()))
    st = {r["name"]: r for r in rows(O.status_analysis(rows_))}
    assert st["completed"]["order_count"] == 1
    assert st["unknown"]["order_count"] == 1           # '??' and no id -> the row count
    assert st["unknown"]["sales_amount"] == 0.0 and st["refund_in_progress"]["sales_amount"] is None
    assert st["completed"]["share"] == 50.0
    s = one(O.status_summary(rows_))
    assert s["refund_order_count"] == 1 and s["cancelled_order_count"] == 1


def test_region_synonyms_and_unknown_kept(spark):
    rows_ = O.order_rows(frame(spark, base_rows()))
    got = {r["name"]: r["region_order_count"] for r in rows(O.region_sales(rows_))}
    assert got == {"洛阳": 1, "郑州": 1, "Other Town": 2}


def test_dates_and_quality(spark):
    rows_ = O.order_rows(frame(spark, base_rows()))
    q = one(O.data_quality(rows_))
    assert q["row_count"] == 6 and q["duplicate_row_count"] == 1
    assert q["invalid_date_count"] == 1                # 'bad date'; the NULL date is missing, not invalid
    assert q["invalid_unit_price_count"] == 1 and q["zero_unit_price_count"] == 1
    assert q["invalid_age_count"] == 3                 # 0 (twice: duplicates count here) and 130
    assert q["duplicate_order_id_count"] == 2
    assert q["phone_valid_count"] == 3 and q["phone_missing_count"] == 1
    assert q["email_valid_count"] == 3
    days = {r["name"]: r["value"] for r in rows(O.daily_sales(rows_))}
    assert days == {"2026-03-01": 10.0, "2026-03-05": 30.0}


def test_multi_line_orders_and_customers(spark):
    data = [("B1", "k1", None, "p", None, None, "paid", None, None, "100", "1", None, None, None, None, None, None),
            ("B1", "k1", None, "q", None, None, "paid", None, None, "50", "1", None, None, None, None, None, None),
            ("B1", "k1", None, "q", None, None, "paid", None, None, "50", "1", None, None, None, None, None, None),
            ("B2", "k1", None, "p", None, None, "paid", None, None, "250", "1", None, None, None, None, None, None)]
    df = frame(spark, data).drop("discount")
    rows_ = O.order_rows(df)
    ov = one(O.order_overview(rows_))
    assert (ov["order_count"], ov["verified_sales_total"], ov["maximum_verified_order_value"]) == (2, 400.0, 250.0)
    cs = one(O.customer_summary(rows_))
    assert cs["repeat_customer_count"] == 1 and cs["average_orders_per_customer"] == 2.0


def test_age_bands_edges(spark):
    data = [(f"o{a}", None, None, None, None, None, None, None, None, "1", "1", None, None, None, str(a), None, None)
            for a in (0, 17, 18, 65, 119, 120)]
    got = {r["name"]: r["order_count"] for r in rows(O.age_profile(O.order_rows(frame(spark, data))))}
    assert got == {"18以下": 1, "18-24": 1, "65+": 2}


def test_rounding_half_up_on_exact_values(spark):
    df = spark.createDataFrame([("x", D("1.005"), D("1"))], "order_id string, unit_price decimal(12,4), quantity decimal(12,2)")
    ov = one(O.order_overview(O.order_rows(df)))
    assert ov["verified_sales_total"] == 1.01


def test_partition_count_invariance(spark):
    df = frame(spark, base_rows() * 3)
    a = rows(O.order_overview(O.order_rows(df.repartition(1))))
    b = rows(O.order_overview(O.order_rows(df.repartition(7))))
    assert a == b
