"""Order-domain analyses (AGG-0 .. AGG-20, MET-1 .. MET-6, NUM-4 .. NUM-8, FLT-3).

Plan shape
----------
``order_rows(df)`` deduplicates the canonical frame with *one* aggregate over all
columns that also counts the copies of each row (``_copies``).  This single
shuffle gives the deduplicated rows every analysis works on *and* lets the
"all rows" quality counters be computed as weighted sums, so the raw frame is
never scanned twice.  Hot duplicate groups are combined map-side by the partial
aggregate.

``order_level(rows)`` rolls rows up per order id.  Rows without an id are orders
of their own: they take a separate, shuffle-free branch instead of a synthetic
key, so missing ids can never form a hot key.  Distinct order counts under several
conditions come from one row per order id.

Every analysis is one ``DataFrame -> DataFrame`` function; grouped analyses are
hash aggregates with partial/final split.  Scalars such as "total orders" for a
share are scalar subqueries (``DataFrame.scalar()``) over an aggregate, never a
global window over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.functions.columns import (
    MONEY_WORK, clean_text, has, hybrid_order_count, money, pct, to_number,
)
from sheetwise.functions.normalize import (
    KNOWN_STATUSES, REFUND_STATUSES, day_key, month_key, normalize_region, normalize_status, parse_dates,
    valid_email, valid_phone,
)
from sheetwise.operators.ranking import POS, descending, first_seen, median, ranked
from sheetwise.session import materialize

COPIES = "_copies"

# Default labels and age bands (left-closed, 0 < age < 120).
UNCATEGORISED = "未分类"
UNKNOWN_GENDER = "unknown"
AGE_BANDS = ((0, 18, "18以下"), (18, 25, "18-24"), (25, 35, "25-34"), (35, 45, "35-44"),
             (45, 55, "45-54"), (55, 65, "55-64"), (65, None, "65+"))


def money_dec(c: Column) -> Column:
    """Half-up rounding to 2 decimals, kept as an exact decimal for later sums."""
    return F.round(c.try_cast(MONEY_WORK), 2)


def _rows_per_id(rows: DataFrame, conds: dict[str, Column], *more: Column) -> DataFrame:
    """One row per order id (and one for rows without) with the number of rows that meet each
    condition, ``_n_<name>``: distinct counts under several conditions then need one pass."""
    return rows.groupBy("_order_id").agg(*[F.count_if(c).alias(f"_n_{k}") for k, c in conds.items()], *more)


def _ids_or_rows(name: str) -> Column:
    """AGG-0 over ``_rows_per_id``: ids with such a row, or such rows where none has an id."""
    n = F.col(f"_n_{name}")
    ids = F.count_if(F.col("_order_id").isNotNull() & (n > 0))
    return F.when(ids > 0, ids).otherwise(F.coalesce(F.sum(n), F.lit(0)))


# ---------------------------------------------------------------------------
# Row preparation


def dedup_with_copies(df: DataFrame) -> DataFrame:
    """FLT-3: exact-duplicate removal that keeps the number of copies per row.

    A ``_pos`` column (row position from ingest) is not part of the row: the
    first position of the copies is kept.
    """
    cols = [c for c in df.columns if c != POS]
    aggs = [F.count(F.lit(1)).alias(COPIES)]
    if POS in df.columns:
        aggs.append(F.min(POS).alias(POS))
    return df.groupBy(*cols).agg(*aggs)


def exact_amount(df: DataFrame, amount: Column) -> Column:
    """Amounts computed from text are doubles: each becomes an exact decimal before any sum,
    so totals don't depend on the order of rows.  A number beyond the working decimal, or
    infinity, is no usable amount (NULL)."""
    kind = df.select(amount.alias("amount")).schema["amount"].dataType
    return amount.try_cast(MONEY_WORK) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else amount


def prepare(df: DataFrame) -> DataFrame:
    """Derived row columns of the order analyzer (NUM-5..8, STR-1, STR-3, DAT-1).

    Adds ``_``-prefixed columns and keeps the canonical ones.  The region is
    added separately (``region_sales``) because it needs a lookup.
    """
    p, q, d = to_number(df, "unit_price"), to_number(df, "quantity"), to_number(df, "discount")
    raw = to_number(df, "sales_amount")
    has_discount = has(df, "discount")
    valid_p = p.isNotNull() & (p >= 0)
    valid_q = q.isNotNull() & (q >= 0)
    valid_d = (d.isNotNull() & d.between(0, 1)) if has_discount else F.lit(True)
    multiplier = d if has_discount else F.lit(1)
    expected = exact_amount(df, F.when(valid_p & valid_q & valid_d, p * q * multiplier))
    raw = exact_amount(df, raw)
    raw_present = F.col("sales_amount").isNotNull() if has(df, "sales_amount") else F.lit(False)
    if COPIES not in df.columns:
        df = df.withColumn(COPIES, F.lit(1).cast("long"))
    out = df.withColumns({
        "_order_id": clean_text(df, "order_id"),
        "_customer_id": clean_text(df, "customer_id"),
        "_product": clean_text(df, "product"),
        "_category": F.coalesce(clean_text(df, "category"), F.lit(UNCATEGORISED)),
        "_date": parse_dates(df, "date"),
        "_unit_price": p,
        "_quantity": q,
        "_discount": d,
        "_raw_amount": raw,
        "_raw_present": raw_present,
        "_status": normalize_status(clean_text(df, "status")),
        "_expected": expected,
    })
    valid_raw = F.col("_raw_amount").isNotNull() & (F.col("_raw_amount") >= 0)
    verified = F.col("_expected")
    out = out.withColumns({
        "_verified": verified,
        "_unverified": F.when(verified.isNull() & valid_raw, F.col("_raw_amount")),
        "_comparable": verified.isNotNull() & valid_raw,
    })
    out = out.withColumn(
        "_mismatch", F.col("_comparable") & ~(F.abs(F.col("_verified") - F.col("_raw_amount")) <= 0.01))
    status = (F.when(verified.isNull() & F.col("_raw_present") & ~valid_raw, "invalid_amount")
              .when(F.col("_mismatch"), "conflict")
              .when(F.col("_comparable"), "verified_match")
              .when(verified.isNotNull() & ~valid_raw, "verified")
              .when(F.col("_unverified").isNotNull(), "unverified")
              .otherwise("missing"))
    return out.withColumn("_amount_status", status).drop("_expected")  # it is the verified amount


def order_rows(df: DataFrame) -> DataFrame:
    """Deduplicated, prepared rows with ``_copies`` (the analyzer's working frame)."""
    return prepare(dedup_with_copies(df))


def order_level_aggs() -> list[Column]:
    return [
        money_dec(F.sum("_verified")).alias("verified_amount"),
        money_dec(F.sum("_unverified")).alias("unverified_amount"),
        (F.count("_verified") > 0).alias("has_verified_amount"),
        (F.count("_unverified") > 0).alias("has_unverified_amount"),
        F.coalesce(F.bool_or("_comparable"), F.lit(False)).alias("has_comparable_amount"),
        F.count_if(F.col("_mismatch")).alias("conflict_count"),
        F.sum(COPIES).alias("record_count"),
    ]


def order_level(rows: DataFrame, extra_sums: tuple[str, ...] = ()) -> DataFrame:
    """AGG-4: one row per order.  Values are rounded per order (exact decimals).

    Rows with an order id meet in one hash aggregate (partial + final), so hot orders are
    combined map-side.  A (deduplicated) row without one is an order of its own: its values
    are computed from the row where it lies.  ``extra_sums`` are row columns summed per order
    as well (exact partial sums).
    """
    oid = F.col("_order_id")
    # the columns in use, written: the filters of two branches over one plan would each move
    # below the deduplication and compute it twice
    rows = materialize(rows.select("_order_id", "_verified", "_unverified", "_comparable", "_mismatch", COPIES, *extra_sums))
    sums = [F.sum(c).alias(c) for c in extra_sums]
    with_id = rows.where(oid.isNotNull()).groupBy(oid.alias("order_id")).agg(*order_level_aggs(), *sums)
    alone = rows.where(oid.isNull()).select(
        oid.alias("order_id"),
        money_dec(F.col("_verified")).alias("verified_amount"),
        money_dec(F.col("_unverified")).alias("unverified_amount"),
        F.col("_verified").isNotNull().alias("has_verified_amount"),
        F.col("_unverified").isNotNull().alias("has_unverified_amount"),
        F.coalesce("_comparable", F.lit(False)).alias("has_comparable_amount"),
        F.coalesce(F.col("_mismatch").cast("long"), F.lit(0)).cast("long").alias("conflict_count"),
        F.col(COPIES).cast("long").alias("record_count"), *extra_sums)
    # the sum's type may be wider than the row's
    return with_id.unionByName(alone.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in with_id.schema]))


def order_rollup(rows: DataFrame) -> DataFrame:
    """AGG-4 as a result table (money as DOUBLE)."""
    o = order_level(rows)
    return o.select("order_id", F.col("verified_amount").cast("double").alias("verified_amount"),
                    F.col("unverified_amount").cast("double").alias("unverified_amount"),
                    "has_verified_amount", "has_unverified_amount", "has_comparable_amount", "conflict_count")


def _overview_aggs(middle: Column) -> list[Column]:
    v = F.col("verified_amount")
    n_v = F.count(v)
    mean = F.avg(v)
    return [
        F.sum("record_count").alias("record_count"),
        F.count(F.lit(1)).alias("order_count"),
        money(F.sum(v)).alias("verified_sales_total"),
        n_v.alias("verified_order_count"),
        money(mean).alias("average_verified_order_value"),
        money(F.max(v)).alias("maximum_verified_order_value"),
        money(F.min(v)).alias("minimum_verified_order_value"),
        money(middle).alias("median_verified_order_value"),
        F.count_if(F.col("has_unverified_amount")).alias("unverified_order_count"),
        F.count_if(~F.col("has_verified_amount") & ~F.col("has_unverified_amount")).alias("no_usable_amount_order_count"),
        pct(n_v, F.count(F.lit(1))).alias("amount_verification_rate"),
        money(F.sum("unverified_amount")).alias("unverified_amount_total"),
        F.count_if(F.col("has_comparable_amount")).alias("amount_comparable_count"),
        F.count_if(F.col("conflict_count") > 0).alias("amount_mismatch_count"),
        pct(F.count_if(F.col("conflict_count") > 0), F.count_if(F.col("has_comparable_amount"))).alias("amount_mismatch_rate"),
        *_volatility_aggs(),
    ]


def _volatility_aggs() -> list[Column]:
    v = F.col("verified_amount")
    spread = (F.count(v) >= 2) & (F.avg(v) != 0)
    return [F.when(spread, money(F.stddev_pop(v))).alias("standard_deviation"),
            F.when(spread, pct(F.stddev_pop(v), F.avg(v))).alias("coefficient_of_variation")]


_STATUS_PARTS = {
    "completed_sales_amount": ("completed",),
    "cancelled_order_amount": ("cancelled",),
    "refund_related_amount": REFUND_STATUSES,
}


def order_overview(rows: DataFrame) -> DataFrame:
    """AGG-5 (+ AGG-6 status amounts, AGG-7 volatility): one row.

    Status-scoped sums are carried through the order roll-up as exact per-order
    partial sums, so the whole overview is one pass over the orders.
    """
    parts = {f"_{k}": F.when(F.col("_status").isin(*v), F.col("_verified")) for k, v in _STATUS_PARTS.items()}
    # written: the overview, the counted values and their middle read it
    o = materialize(order_level(rows.withColumns(parts), tuple(parts)))
    middle = median(o, F.col("verified_amount")).scalar()
    return o.agg(*_overview_aggs(middle), *[money(F.sum(f"_{k}")).alias(k) for k in _STATUS_PARTS])


def status_amounts(rows: DataFrame) -> DataFrame:
    """AGG-6: verified sums of completed, cancelled and refund-related rows."""
    v, s = F.col("_verified"), F.col("_status")
    return rows.agg(
        money(F.sum(F.when(s == "completed", v))).alias("completed_sales_amount"),
        money(F.sum(F.when(s == "cancelled", v))).alias("cancelled_order_amount"),
        money(F.sum(F.when(s.isin(*REFUND_STATUSES), v))).alias("refund_related_amount"),
    )


def sales_volatility(rows: DataFrame) -> DataFrame:
    """AGG-7: population std and CV % of order values; NULL if < 2 values or mean 0."""
    return order_level(rows).agg(*_volatility_aggs())


def order_count(rows: DataFrame) -> DataFrame:
    """AGG-0 (hybrid count over rows) next to the order roll-up count."""
    o = order_level(rows).agg(F.count(F.lit(1)).alias("order_count"))
    h = rows.agg(hybrid_order_count(F.col("_order_id")).alias("hybrid_order_count"))
    return o.select("order_count", h.scalar().alias("hybrid_order_count")) if hasattr(h, "scalar") else o


# ---------------------------------------------------------------------------
# Grouped business analyses


def _business_aggs(prefix: str = "") -> list[Column]:
    q = F.col("_quantity")
    return [
        hybrid_order_count(F.col("_order_id")).alias(f"{prefix}order_count"),
        money_dec(F.sum(F.when(q >= 0, q))).alias(f"{prefix}quantity"),
        money_dec(F.sum("_verified")).alias(f"{prefix}sales_amount"),
    ]


def group_business(rows: DataFrame, column: str) -> DataFrame:
    """AGG-8: order count, quantity (>= 0 only), verified sales per group."""
    g = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(*_business_aggs())
    return g.select("name", "order_count", F.col("quantity").cast("double").alias("quantity"),
                    F.col("sales_amount").cast("double").alias("sales_amount"))


def product_sales(rows: DataFrame) -> DataFrame:
    """AGG-9."""
    return group_business(rows, "_product")


def category_sales(rows: DataFrame) -> DataFrame:
    """AGG-10: AGG-8 by category plus the share of the sum of rounded category sales."""
    g = materialize(rows.groupBy(F.col("_category").alias("category")).agg(*_business_aggs()))
    total = g.agg(F.sum("sales_amount")).scalar()
    return g.select(
        "category", "order_count", F.col("quantity").cast("double").alias("quantity"),
        F.col("sales_amount").cast("double").alias("sales_amount"),
        F.when(F.col("sales_amount").isNotNull(), pct(F.col("sales_amount"), total)).alias("sales_share"),
    )


def region_sales(rows: DataFrame) -> DataFrame:
    """AGG-11: AGG-8 by normalised region, average order value, targets, completion."""
    # summed by spelling and order first, so that a spelling's normal form is looked up once for each order
    q = F.col("_quantity")
    per_id = rows.groupBy(clean_text(rows, "region").alias("_text"), "_order_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.when(q >= 0, q)).alias("_q"), F.sum("_verified").alias("_v"),
        F.sum(to_number(rows, "target_amount")).alias("_t"))
    oid = F.col("_order_id")
    # rows without a region are a group that goes afterwards: a filter on the region itself would
    # move below the aggregate and compute every normal form twice
    g = per_id.withColumn("_region", normalize_region(F.col("_text"))).groupBy(F.col("_region").alias("name")).agg(
        F.when(F.count(oid) > 0, F.count_distinct(oid)).otherwise(F.sum("_n")).alias("order_count"),
        money_dec(F.sum("_q")).alias("quantity"), money_dec(F.sum("_v")).alias("sales_amount"),
        money_dec(F.sum("_t")).alias("target_amount"), F.count("_region").alias("_named")).where(F.col("_named") > 0)
    sales = F.col("sales_amount")
    return g.select(
        "name",
        F.col("order_count").alias("region_order_count"),
        sales.cast("double").alias("region_sales"),
        F.col("quantity").cast("double").alias("region_quantity"),
        F.when(sales.isNotNull() & (F.col("order_count") > 0),
               money(sales / F.col("order_count"))).alias("region_average_order_value"),
        F.col("target_amount").cast("double").alias("target_amount"),
        F.when(sales.isNotNull(), pct(sales, F.col("target_amount"))).alias("completion_rate"),
        sales.cast("double").alias("value"),
    )


def _dated(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("_date").isNotNull() & F.col("_verified").isNotNull())


def _at_least_two(g: DataFrame) -> DataFrame:
    """Keep a trend only when it has two or more points (window over the aggregated
    points only: one row per day / month)."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return g.withColumn("_n", n).where(F.col("_n") >= 2).drop("_n")


def daily_sales(rows: DataFrame) -> DataFrame:
    """AGG-12a: verified sales per day (>= 2 points, else empty)."""
    g = _dated(rows).groupBy(day_key(F.col("_date")).alias("name")).agg(money(F.sum("_verified")).alias("value"))
    return _at_least_two(g)


def monthly_sales(rows: DataFrame) -> DataFrame:
    """AGG-12b."""
    g = _dated(rows).groupBy(month_key(F.col("_date")).alias("name")).agg(money(F.sum("_verified")).alias("value"))
    return _at_least_two(g)


def monthly_orders(rows: DataFrame) -> DataFrame:
    """AGG-12c: hybrid order count per month over rows with a verified amount."""
    g = _dated(rows).groupBy(month_key(F.col("_date")).alias("name")).agg(
        hybrid_order_count(F.col("_order_id")).alias("value"))
    return _at_least_two(g)


def customer_rollup(rows: DataFrame) -> DataFrame:
    """AGG-18a: per customer id: orders, verified sales, first non-empty name."""
    name = clean_text(rows, "customer_name")
    # the first name that is not blank; without positions the table has no first row
    first_name = F.min_by(name, F.when(name.isNotNull(), F.col(POS))) if POS in rows.columns else F.min(name)
    return rows.where(F.col("_customer_id").isNotNull()).groupBy(F.col("_customer_id").alias("customer_id")).agg(
        hybrid_order_count(F.col("_order_id")).alias("order_count"),
        money(F.sum("_verified")).alias("sales_amount"),
        first_name.alias("customer_name"),
    )


def top_customers(rows: DataFrame, k: int = 10) -> DataFrame:
    """TOP-1: the k customers with the highest verified sales (ties: id)."""
    c = customer_rollup(rows)
    return c.orderBy(F.desc(F.coalesce(F.col("sales_amount"), F.lit(0.0))), F.col("customer_id")).limit(k)


def customer_summary(rows: DataFrame) -> DataFrame:
    """AGG-18b: unique and repeat customers, repeat rate, mean orders per customer."""
    c = customer_rollup(rows)
    n = F.count(F.lit(1))
    repeats = F.count_if(F.col("order_count") >= 2)
    return c.agg(
        n.alias("unique_customer_count"),
        repeats.alias("repeat_customer_count"),
        pct(repeats, n).alias("repeat_customer_rate"),
        F.when(n > 0, money(F.sum("order_count") / n)).alias("average_orders_per_customer"),
    )


def _with_total(rows: DataFrame, key: Column, aggs: list[Column]) -> DataFrame:
    """Group rows by ``key`` and also over all rows in the *same* pass (rollup, written);
    the grand total row is returned as ``_total_<col>`` columns next to every group."""
    g = materialize(rows.rollup(key.alias("name")).agg(*aggs, F.grouping_id().alias("_gid")))
    names = [c for c in g.columns if c not in ("name", "_gid")]
    total = g.where(F.col("_gid") == 1).select(F.struct(*names)).scalar()
    return g.where(F.col("_gid") == 0).drop("_gid").withColumns({f"_total_{c}": total[c] for c in names})


def status_analysis(rows: DataFrame) -> DataFrame:
    """AGG-14: distribution over normalised statuses (incl. 'unknown')."""
    g = _with_total(rows, F.col("_status"), [hybrid_order_count(F.col("_order_id")).alias("order_count"),
                                            money(F.sum("_verified")).alias("sales_amount")])
    return g.select("name", "order_count", "sales_amount",
                    pct(F.col("order_count"), F.col("_total_order_count")).alias("share"))


def status_summary(rows: DataFrame) -> DataFrame:
    """AGG-13: completed / cancelled / refund counts and rates over known statuses."""
    valid = rows.where(F.col("_status").isin(*KNOWN_STATUSES))
    s = F.col("_status")
    per_id = _rows_per_id(valid, {"all": F.lit(True), **{w: s == w for w in ("completed", "cancelled", "refund_in_progress", "refunded")}})
    a = per_id.agg(
        _ids_or_rows("all").alias("_den"),
        _ids_or_rows("completed").alias("completed_order_count"),
        _ids_or_rows("cancelled").alias("cancelled_order_count"),
        (_ids_or_rows("refund_in_progress") + _ids_or_rows("refunded")).alias("refund_order_count"),
    )
    den = F.col("_den")
    return a.select(
        "completed_order_count", "cancelled_order_count", "refund_order_count",
        pct(F.col("completed_order_count"), den).alias("order_completion_rate"),
        pct(F.col("cancelled_order_count"), den).alias("cancellation_rate"),
        pct(F.col("refund_order_count"), den).alias("refund_rate"),
    )


def payment_analysis(rows: DataFrame) -> DataFrame:
    """AGG-15: orders and sales per payment method, with order and sales shares."""
    r = rows.withColumn("_payment", clean_text(rows, "payment_method")).where(F.col("_payment").isNotNull())
    g = _with_total(r, F.col("_payment"), [hybrid_order_count(F.col("_order_id")).alias("order_count"),
                                          money_dec(F.sum("_verified")).alias("sales_amount"),
                                          F.sum("_verified").alias("_s")])
    total_orders, total_sales = F.col("_total_order_count"), F.col("_total__s")
    return g.select(
        "name", "order_count", F.col("sales_amount").cast("double").alias("sales_amount"),
        pct(F.col("order_count"), total_orders).alias("order_share"),
        F.when(F.col("sales_amount").isNotNull(), pct(F.col("sales_amount"), total_sales)).alias("sales_share"),
    )


def discount_analysis(rows: DataFrame) -> DataFrame:
    """AGG-16: valid discounts, discounted orders and rate, means, estimated discount."""
    if not has(rows, "discount"):
        return rows.sparkSession.createDataFrame(
            [], "valid_discount_count long, discounted_order_count long, discounted_order_rate double, "
                "average_discount double, average_discounted_order_value double, estimated_discount_amount double")
    d = F.col("_discount")
    valid = rows.where(d.isNotNull() & d.between(0, 1))
    disc = d < 1
    expected = F.col("_verified")
    per_id = _rows_per_id(
        valid, {"all": F.lit(True), "disc": disc},
        F.sum(d.try_cast(MONEY_WORK)).alias("_d"), F.sum(F.when(disc, F.col("_verified"))).alias("_v"),
        F.count(F.when(disc, F.col("_verified"))).alias("_nv"),
        F.sum(F.when(expected.isNotNull(), F.col("_unit_price") * F.col("_quantity") - expected)).alias("_saved"))
    n_disc = _ids_or_rows("disc")
    return per_id.agg(
        F.coalesce(F.sum("_n_all"), F.lit(0)).alias("valid_discount_count"),
        n_disc.alias("discounted_order_count"),
        pct(n_disc, _ids_or_rows("all")).alias("discounted_order_rate"),
        money(F.try_divide(F.sum("_d").try_cast(MONEY_WORK), F.sum("_n_all"))).alias("average_discount"),
        money(F.try_divide(F.sum("_v").try_cast(MONEY_WORK), F.sum("_nv"))).alias("average_discounted_order_value"),
        money(F.sum("_saved")).alias("estimated_discount_amount"),
    )


def _profile_aggs(rows: DataFrame) -> list[Column]:
    return [
        hybrid_order_count(F.col("_order_id")).alias("order_count"),
        F.count_distinct("_customer_id").alias("customer_count"),
        money(F.sum("_verified")).alias("sales_amount"),
        *first_seen(rows),
    ]


def gender_profile(rows: DataFrame) -> DataFrame:
    """AGG-17a: orders, distinct customers and verified sales per gender."""
    if not has(rows, "gender"):
        return rows.sparkSession.createDataFrame([], "name string, order_count long, customer_count long, sales_amount double")
    g = F.coalesce(clean_text(rows, "gender"), F.lit(UNKNOWN_GENDER))
    return rows.groupBy(g.alias("name")).agg(*_profile_aggs(rows))


def age_band(age: Column) -> Column:
    """NUM-4: left-closed bands over 0 < age < 120."""
    valid = age.isNotNull() & (age > 0) & (age < 120)
    expr = None
    for low, high, label in AGE_BANDS:
        cond = (age >= low) if high is None else ((age >= low) & (age < high))
        expr = F.when(valid & cond, label) if expr is None else expr.when(valid & cond, label)
    return expr


def age_profile(rows: DataFrame) -> DataFrame:
    """AGG-17b: the same profile per age band (empty when no valid age)."""
    band = age_band(to_number(rows, "age"))
    return rows.where(band.isNotNull()).groupBy(band.alias("name")).agg(*_profile_aggs(rows))


# ---------------------------------------------------------------------------
# Quality (AGG-19, AGG-20, PRD-1) -- "all rows" counters are weighted by copies


def _w(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col(COPIES)).otherwise(0))


def _contact_cols(rows: DataFrame, column: str, check) -> tuple[Column, list[Column]]:
    text = clean_text(rows, column)
    present = text.isNotNull()
    valid = present & check(text)
    return valid, [
        _w(present).alias(f"{column}_present_count"),
        _w(~present).alias(f"{column}_missing_count"),
        _w(valid).alias(f"{column}_valid_count"),
        _w(present & ~valid).alias(f"{column}_invalid_count"),
    ]


def contact_quality(rows: DataFrame) -> DataFrame:
    """AGG-19: phone and e-mail present / missing / valid / invalid over all rows."""
    phone_ok, phone = _contact_cols(rows, "phone", valid_phone)
    mail_ok, mail = _contact_cols(rows, "email", valid_email)
    n = F.sum(COPIES)
    both = _w(phone_ok & mail_ok)
    return rows.agg(*phone, *mail, both.alias("contact_complete_count"),
                    pct(both, n).alias("contact_complete_rate"))


def valid_ranges(rows: DataFrame) -> DataFrame:
    """PRD-1: rows (all copies) passing each range predicate."""
    p, q, d, raw = (F.col(c) for c in ("_unit_price", "_quantity", "_discount", "_raw_amount"))
    age = to_number(rows, "age")
    return rows.agg(
        _w(p >= 0).alias("valid_unit_price_count"),
        _w(q >= 0).alias("valid_quantity_count"),
        _w(d.between(0, 1)).alias("valid_discount_count"),
        _w(raw >= 0).alias("valid_raw_amount_count"),
        _w((age > 0) & (age < 120)).alias("valid_age_count"),
    )


def data_quality(rows: DataFrame) -> DataFrame:
    """AGG-20: the data-quality row (scalar counters; missing values: ``missing_summary``).

    One pass: every row counter is a per-row indicator (weighted by copies where
    the reference counts all rows), summed per order id and then over the ids, next to the
    order-level counters.  Rows without an id are orders of their own: in their one group
    the order-level counters are sums over rows.
    """
    p, q, d = F.col("_unit_price"), F.col("_quantity"), F.col("_discount")
    age = to_number(rows, "age")
    copies = F.col(COPIES)
    date_bad = (F.col("date").isNotNull() & F.col("_date").isNull()) if has(rows, "date") else F.lit(False)
    phone = clean_text(rows, "phone")
    mail = clean_text(rows, "email")
    phone_ok = phone.isNotNull() & valid_phone(phone)
    mail_ok = mail.isNotNull() & valid_email(mail)

    def w(cond: Column) -> Column:
        return F.when(cond, copies).otherwise(F.lit(0)).cast("long")

    weighted = {
        "row_count": copies.cast("long"),
        "invalid_date_count": w(date_bad),
        "invalid_unit_price_count": w(p.isNotNull() & (p < 0)),
        "zero_unit_price_count": w(p == 0),
        "invalid_quantity_count": w(q.isNotNull() & (q < 0)),
        "zero_quantity_count": w(q == 0),
        "invalid_discount_count": w(d.isNotNull() & ~d.between(0, 1)) if has(rows, "discount") else F.lit(0).cast("long"),
        "invalid_age_count": w(age.isNotNull() & ~((age > 0) & (age < 120))),
        "invalid_status_count": w(F.col("_status") == "unknown") if has(rows, "status") else F.lit(0).cast("long"),
        "phone_present_count": w(phone.isNotNull()), "phone_missing_count": w(phone.isNull()),
        "phone_valid_count": w(phone_ok), "phone_invalid_count": w(phone.isNotNull() & ~phone_ok),
        "email_present_count": w(mail.isNotNull()), "email_missing_count": w(mail.isNull()),
        "email_valid_count": w(mail_ok), "email_invalid_count": w(mail.isNotNull() & ~mail_ok),
        "contact_complete_count": w(phone_ok & mail_ok),
        "_id_rows": w(F.col("_order_id").isNotNull()),
        "_dedup_rows": F.lit(1).cast("long"),
        "unverified_amount_count": F.col("_unverified").isNotNull().cast("long"),
        "invalid_amount_count": (F.col("_amount_status") == "invalid_amount").cast("long"),
    }
    o = rows.groupBy("_order_id").agg(
        *[F.sum(v).alias(f"_dq_{k}") for k, v in weighted.items()],
        F.count_if(F.col("_mismatch")).alias("_conflicts"), F.count_if(F.col("_comparable")).alias("_comparables"),
        F.count("_unverified").alias("_unverifieds"), F.sum("_unverified").alias("_of_order"),
        F.sum(F.when(F.col("_order_id").isNull(), money_dec(F.col("_unverified")))).alias("_of_rows"))
    total = {k: F.coalesce(F.sum(f"_dq_{k}"), F.lit(0)).cast("long") for k in weighted}
    named = F.col("_order_id").isNotNull()

    def orders_with(rows_with: str) -> Column:
        n = F.col(rows_with)
        return F.coalesce(F.sum(F.when(named, (n > 0).cast("long")).otherwise(n)), F.lit(0))

    has_mismatch, comparable = orders_with("_conflicts"), orders_with("_comparables")
    unverified = F.sum(F.when(named, money_dec(F.col("_of_order"))).otherwise(F.col("_of_rows")))
    return o.agg(
        total["row_count"].alias("row_count"),
        (total["row_count"] - total["_dedup_rows"]).alias("duplicate_row_count"),
        (total["_id_rows"] - F.count("_order_id")).alias("duplicate_order_id_count"),
        *[total[k].alias(k) for k in ("invalid_date_count", "invalid_unit_price_count", "zero_unit_price_count",
                                      "invalid_quantity_count", "zero_quantity_count", "invalid_discount_count",
                                      "invalid_age_count", "invalid_status_count", "unverified_amount_count",
                                      "invalid_amount_count", "phone_present_count", "phone_missing_count",
                                      "phone_valid_count", "phone_invalid_count", "email_present_count",
                                      "email_missing_count", "email_valid_count", "email_invalid_count",
                                      "contact_complete_count")],
        pct(total["contact_complete_count"], total["row_count"]).alias("contact_complete_rate"),
        has_mismatch.alias("amount_mismatch_count"),
        comparable.alias("amount_comparable_count"),
        pct(has_mismatch, comparable).alias("amount_mismatch_rate"),
        orders_with("_unverifieds").alias("unverified_order_count"),
        money(unverified).alias("unverified_amount_total"),
    )


def missing_summary(df: DataFrame) -> DataFrame:
    """PRF-7 on the raw order frame: columns with missing values and their count."""
    cols = [c for c in df.columns if c not in (COPIES, POS)]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = counts.unpivot([], cols, "column_name", "missing_count")
    return long.where(F.col("missing_count") > 0)


# ---------------------------------------------------------------------------
# Derived top-level metrics (MET-1 .. MET-6)


def sales_summary(rows: DataFrame) -> DataFrame:
    """MET-1: total / average / max / min of order values; no row if nothing verified."""
    v = F.col("verified_amount")
    o = order_level(rows).agg(money(F.sum(v)).alias("total"), money(F.avg(v)).alias("average"),
                              money(F.max(v)).alias("maximum"), money(F.min(v)).alias("minimum"))
    return o.where(F.col("total").isNotNull())


def region_ranking(rows: DataFrame) -> DataFrame:
    """MET-2: regions with sales, ranked (−sales, name), with highest/lowest flags."""
    r = region_sales(rows).where(F.col("region_sales").isNotNull()).select("name", F.col("region_sales").alias("value"))
    placed = ranked(r, [descending("value"), F.col("name")])
    last = placed.agg(F.max("rank")).scalar()
    return placed.select("rank", "name", "value", (F.col("rank") == 1).alias("is_highest"),
                         (F.col("rank") == last).alias("is_lowest"), (F.col("rank") <= 10).alias("in_top10"))


def growth_rate(rows: DataFrame) -> DataFrame:
    """MET-3: (last − first) / first × 100 over the daily trend."""
    t = daily_sales(rows)
    a = t.agg(F.count(F.lit(1)).alias("n"), F.min_by("value", "name").alias("first"),
              F.max_by("value", "name").alias("last"))
    return a.select(F.when((F.col("n") >= 2) & (F.col("first") != 0),
                           pct(F.col("last") - F.col("first"), F.col("first"))).alias("growth_rate"))


def target_completion(rows: DataFrame) -> DataFrame:
    """MET-4: verified total / Σ target; targets over *all* rows (copies included)."""
    total = order_level(rows).agg(money(F.sum("verified_amount"))).scalar()
    target = to_number(rows, "target_amount")
    t = rows.agg(F.sum(target * F.col(COPIES)).alias("target_total"))
    return t.select(F.when(total.isNotNull(), pct(total, F.col("target_total"))).alias("completion_rate"))


def region_performance(rows: DataFrame) -> DataFrame:
    """MET-5: sales, target and completion per region with sales."""
    r = region_sales(rows)
    return r.where(F.col("region_sales").isNotNull()).select(
        "name", F.col("region_sales").alias("sales_amount"), "target_amount", "completion_rate")


def product_quantity(rows: DataFrame) -> DataFrame:
    """MET-6: product quantities (−quantity, name)."""
    return product_sales(rows).where(F.col("quantity").isNotNull()).select("name", F.col("quantity").alias("value"))


# ---------------------------------------------------------------------------
# Row-level amount checks as distributions (NUM-5 .. NUM-8)


def amount_status(rows: DataFrame) -> DataFrame:
    """NUM-8: deduplicated rows per amount status, with their verified / raw sums."""
    return rows.groupBy(F.col("_amount_status").alias("amount_status")).agg(
        F.count(F.lit(1)).alias("row_count"),
        money(F.sum("_verified")).alias("verified_total"),
        money(F.sum("_unverified")).alias("unverified_total"),
    )


def amount_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """NUM-5 .. NUM-7 per deduplicated row: verified, unverified, comparable, mismatch."""
    return rows.select(*keys, money(F.col("_verified")).alias("verified_amount"),
                       money(F.col("_unverified")).alias("unverified_amount"),
                       F.col("_comparable").alias("amount_comparable"), F.col("_mismatch").alias("amount_mismatch"))


def order_dedup(df: DataFrame) -> DataFrame:
    """FLT-3: row count, distinct rows and removed duplicates."""
    d = dedup_with_copies(df)
    return d.agg(F.sum(COPIES).alias("row_count"), F.count(F.lit(1)).alias("distinct_row_count"),
                 (F.sum(COPIES) - F.count(F.lit(1))).alias("duplicate_row_count"))
