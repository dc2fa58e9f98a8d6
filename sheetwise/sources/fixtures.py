"""Canonical test views built from the driver tables (TPC-H-like star schema).

The driver tables have no defects, so defects are injected by key arithmetic;
these are *derivations of the given tables* and grow with them.  The same
views are written as SQL text for the DuckDB oracle (``sheetwise.oracle``).
``_pos`` is a row's position in its table, taken from the tables' own keys.

Each dimension is joined on its own key, so Spark's size check decides per
dimension between a broadcast (small dimension) and a sort-merge join (large
one); nothing is forced.  Nation and region are tiny by definition (25 and 5 rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.session import tasks_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read with its natural splits."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dec(c: Column | str, p: int, s: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(f"decimal({p},{s})")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical order view (one row per line, plus exact duplicate lines)."""
    t = lambda n: table(spark, sf_dir, n)
    # The lines meet their parts first, while they are narrow, and the orders their customers (an
    # order has a few lines); each dimension is joined on its own key, so each broadcast decision is
    # Spark's size check.  The join by order number comes last: the rows stay dealt by it, and a
    # grouping that holds the order number among its keys needs no further shuffle.
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                 "l_quantity", "l_discount", "l_returnflag")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus",
                                "o_orderpriority", "o_totalprice")
    part = t("part").select("p_partkey", "p_name", "p_type", "p_retailprice")
    customer = t("customer").select("c_custkey", "c_name", "c_nationkey")
    nation = t("nation").select("n_nationkey", "n_regionkey")
    region = t("region").select("r_regionkey", "r_name")
    sold = (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    b = (lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
         .repartition(tasks_for(lines), "l_orderkey")
         .join(sold, F.col("l_orderkey") == F.col("o_orderkey")))

    ok, pk, sk, ln, ck = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "o_custkey"))
    p = _dec("p_retailprice", 12, 2)
    q = _dec("l_quantity", 12, 2)
    d = _dec(F.lit(1), 6, 4) - _dec("l_discount", 6, 4)
    amount = F.round(p * q * d, 2)
    v = b.select(
        F.when(ok % 37 == 0, F.lit(None)).otherwise(F.concat(F.lit("O-"), ok.cast("string"))).alias("order_id"),
        F.concat(F.lit("C-"), ck.cast("string")).alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("p_name").alias("product"),
        F.when(pk % 19 == 0, F.lit(None)).otherwise(F.col("p_type")).alias("category"),
        F.col("r_name").alias("region"),
        F.col("o_orderdate").alias("date"),
        F.when(pk % 29 == 0, F.lit(None)).when(pk % 31 == 0, -p).otherwise(p).alias("unit_price"),
        F.when(sk % 23 == 0, -q).otherwise(q).alias("quantity"),
        F.when(sk % 13 == 0, F.lit(None)).when(sk % 17 == 0, _dec(F.lit(1.2), 6, 4)).otherwise(d).alias("discount"),
        F.when(ln == 7, F.lit(None))
         .when(ok % 43 == 0, _dec(F.lit(-1), 18, 2))
         .when(ok % 11 == 0, _dec(amount + 5, 18, 2))
         .otherwise(_dec(amount, 18, 2)).alias("sales_amount"),
        F.when(ok % 23 == 0, "Canceled").when(ok % 41 == 0, "mystery")
         .when(F.col("l_returnflag") == "R", " refunded ").when(F.col("o_orderstatus") == "F", "COMPLETE")
         .when(F.col("o_orderstatus") == "P", "pending").otherwise("paid").alias("status"),
        F.col("o_orderpriority").alias("payment_method"),
        _dec("o_totalprice", 14, 2).alias("target_amount"),
        F.when(ck % 9 == 0, F.lit(None)).when(ck % 2 == 0, "F").otherwise("M").alias("gender"),
        (ck % 131).cast("int").alias("age"),
        F.when(ck % 10 == 0, F.lit(None)).when(ck % 7 == 0, "12-3")
         .otherwise(F.concat(F.lit("+86 138-"), (ck + 10000000).cast("string"))).alias("phone"),
        F.when(ck % 8 == 0, F.lit(None)).when(ck % 6 == 0, "bad-email")
         .otherwise(F.concat(F.lit("u"), ck.cast("string"), F.lit("@example.com"))).alias("email"),
        ok.alias("ok"), pk.alias("pk"), sk.alias("sk"), ln.alias("ln"),
        (ok * 8 + ln).alias("_pos"),
    )
    # exact duplicate rows, injected for every 50th order (one pass, no second join)
    copies = F.when(F.col("ok") % 50 == 0, 2).otherwise(1)
    return v.withColumn("_dup", F.explode(F.sequence(F.lit(1), copies))).drop("_dup")


def inventory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical inventory view: blank suppliers and non-numeric stock injected."""
    t = lambda n: table(spark, sf_dir, n)
    supplier = t("supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = t("nation").select("n_nationkey", "n_name")
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    part = t("part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    b = (lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
         .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
         .join(nation, F.col("s_nationkey") == F.col("n_nationkey")))
    return b.select(
        F.concat(F.lit("P-"), F.col("l_partkey").cast("string")).alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("n_name").alias("warehouse"),
        F.when(F.col("l_suppkey") % 11 == 0, "  ").otherwise(F.col("s_name")).alias("supplier"),
        F.when(F.col("l_orderkey") % 47 == 0, "n/a-qty")
         .otherwise(F.col("l_quantity").cast("int").cast("string")).alias("stock_quantity"),
        F.col("p_size").cast("int").alias("safety_stock"),
        _dec("p_retailprice", 12, 2).alias("unit_cost"),
        (F.col("l_linenumber") * 3).cast("int").alias("inbound_quantity"),
        F.col("l_quantity").cast("int").alias("outbound_quantity"),
        F.col("l_shipdate").alias("inventory_date"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("_pos"),
    )


def student_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical student-score view over the events table (score as text)."""
    e = table(spark, sf_dir, "events")
    uid = F.col("user_id")
    return e.select(
        F.concat(F.lit("S-"), uid.cast("string")).alias("student_id"),
        F.concat(F.lit("Student "), uid.cast("string")).alias("student_name"),
        F.col("event_type").alias("subject"),
        F.when(F.col("event_id") % 53 == 0, "absent")
         .otherwise(_dec("value", 10, 2).cast("string")).alias("score"),
        F.when(uid % 17 == 0, F.lit(None))
         .otherwise(F.concat(F.lit("Class "), (uid % 10).cast("string"))).alias("class_name"),
        F.concat(F.lit("Week "), F.weekofyear("ts").cast("string")).alias("exam_name"),
        F.to_date("ts").alias("exam_date"),
        F.col("event_id").alias("_pos"),
    )


def document_profile_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic table: documents left join labels (real NULLs in quality / toxic)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id", "left")


def document_text_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generic table rendered as text (as a CSV upload is read), plus a flag column."""
    d = document_profile_frame(spark, sf_dir)
    return d.select(*[F.col(c).cast("string").alias(c) for c in d.columns],
                    (F.col("n_chars") > 1000).cast("string").alias("is_long"))


# Date renderings used by the raw sales table, chosen by line number.
_DATE_FORMS = {1: "yyyy-MM-dd", 2: "yyyy/MM/dd", 3: "yyyy.M.d", 4: "yyyy年M月d日", 5: "yyyy-MM-dd HH:mm:ss"}


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An uploaded sales sheet as text: Chinese headers, thousands separators,
    currency marks, five date forms, missing-value tokens, empty and duplicate rows.
    """
    t = lambda n: table(spark, sf_dir, n)
    supplier = t("supplier").select("s_suppkey", "s_nationkey")
    nation = t("nation").select("n_nationkey", "n_name")
    li = t("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                              "l_shipdate")
    b = (li.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
         .join(nation, F.col("s_nationkey") == F.col("n_nationkey")))
    ok, sk, ln = F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_linenumber")
    price = _dec("l_extendedprice", 12, 2)
    date = F.when(ln == 6, F.lit("not a date"))
    for k, fmt in _DATE_FORMS.items():
        date = date.when(ln == k, F.date_format("l_shipdate", fmt))
    sales = (F.when(ok % 29 == 0, F.lit("n/a"))
             .when(ok % 3 == 0, F.format_number(price, 2))
             .when(ok % 3 == 1, F.concat(F.lit("¥"), price.cast("string")))
             .otherwise(price.cast("string")))
    region = F.when(sk % 13 == 0, F.lit("N/A")).when(sk % 17 == 0, F.lit("NULL")).otherwise(F.col("n_name"))
    empty = ok % 61 == 0
    v = b.select(
        F.when(~empty, date).alias("日期"),
        F.when(~empty, region).alias(" 区域 "),
        F.when(~empty, sales).alias("销售额"),
        F.when(~empty, (price + 100).cast("string")).alias("目标额"),
        F.when(~empty, F.col("l_quantity").cast("int").cast("string")).alias("Customers "),
        F.when(~empty & (sk % 7 == 0), F.col("n_name")).alias("大区"),
        F.when(~empty, ok.cast("string")).alias("单号"),
    )
    copies = F.when(F.col("单号").cast("long") % 50 == 0, 2).otherwise(1)
    return v.withColumn("_dup", F.explode(F.sequence(F.lit(1), copies))).drop("_dup")
