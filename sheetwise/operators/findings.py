"""Rule findings as rows (FND-1 .. FND-4) and the privacy projection (PRJ-3).

A finding is ``(code, subject, value, reference, reference_value)``; sentence
templates are left to the presentation layer.  Every rule reads small,
already aggregated metric frames (one row, or one row per group), so the
rules themselves never touch the row data: each metric is a scalar subquery
(``DataFrame.scalar()``) of one single-row frame, and the triggered findings
are produced by ``explode`` over an array of conditional structs.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.functions.columns import money

FINDING_SCHEMA = "code string, subject string, value double, reference string, reference_value double"

# Thresholds of the rules and the quality counters that are reported.
COMPLETION_WARNING = 80.0
VOLATILITY_WARNING = 30.0
QUALITY_COUNTERS = ("duplicate_row_count", "duplicate_order_id_count", "invalid_date_count", "amount_mismatch_count",
                    "unverified_order_count", "phone_invalid_count", "email_invalid_count")
UNNAMED_PRODUCT = "未命名商品"


def _finding(code: str | Column, subject=None, value=None, reference=None, reference_value=None) -> Column:
    def lit(x, t):
        return (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(lit(code, "string").alias("code"), lit(subject, "string").alias("subject"),
                    lit(value, "double").alias("value"), lit(reference, "string").alias("reference"),
                    lit(reference_value, "double").alias("reference_value"))


def _emit(spark: SparkSession, rules: list[tuple[Column, Column]]) -> DataFrame:
    """One row per rule whose condition holds (conditions may be NULL = not met)."""
    if not rules:
        return spark.createDataFrame([], FINDING_SCHEMA)
    arr = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), f) for cond, f in rules]))
    return spark.range(1).select(F.explode(arr).alias("f")).select("f.*")


def _ends(df: DataFrame, key: Column, value: str, name: str = "name") -> DataFrame:
    """First and last row of a series ordered by ``key``, and its length."""
    s = F.struct(F.col(name).alias("name"), F.col(value).alias("value"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.min_by(s, key).alias("first"), F.max_by(s, key).alias("last"))


def _sorted_ends(df: DataFrame, metric: str, name: str) -> DataFrame:
    """First and last of a list sorted by (−metric (NULL as 0), name)."""
    key = F.struct(-F.coalesce(F.col(metric), F.lit(0.0)), F.col(name))
    return _ends(df, key, metric, name)


def _scalars(df: DataFrame, *cols: str) -> tuple[Column, ...]:
    """Fields of a one-row frame through a single scalar subquery."""
    s = df.select(F.struct(*cols)).scalar()
    return tuple(s[c] for c in cols)


def _trend_rule(ends: DataFrame, prefix: str) -> tuple[Column, Column]:
    n, first, last = _scalars(ends, "n", "first", "last")
    change = money(last["value"] - first["value"])
    code = F.concat(F.lit(prefix), F.when(change > 0, "_up").when(change < 0, "_down").otherwise("_flat"))
    return n >= 2, _finding(code, first["name"], F.abs(change), last["name"], None)


def _results(given: DataFrame | Mapping[str, DataFrame], domain: str) -> Mapping[str, DataFrame]:
    """Results by name; of rows in canonical form: all of the domain."""
    if isinstance(given, DataFrame):
        from sheetwise.plans.outcome import all_results
        return all_results(given, domain)
    return given


def _session(results: Mapping[str, DataFrame]) -> SparkSession:
    return next(iter(results.values())).sparkSession if len(results) else SparkSession.active()


def order_findings(given: DataFrame | Mapping[str, DataFrame]) -> DataFrame:
    """FND-1: completion below 80, region gap, refunds, quality counters, trend change.

    Takes rows, or the supported results of an analysed table: rules whose result is not
    among them don't apply.
    """
    r = _results(given, "order")
    rules: list[tuple[Column, Column]] = []
    if "target_completion" in r:
        completion = r["target_completion"].select("completion_rate").scalar()
        rules.append((completion < COMPLETION_WARNING, _finding("low_target_completion", None, completion, None, COMPLETION_WARNING)))
    if "region_sales" in r:
        rn, rf, rl = _scalars(_sorted_ends(r["region_sales"], "region_sales", "name"), "n", "first", "last")
        rules.append(((rn >= 2) & rf["value"].isNotNull() & rl["value"].isNotNull(),
                      _finding("region_gap", rf["name"], rf["value"], rl["name"], rl["value"])))
    if "status_summary" in r:
        refunds = r["status_summary"].select("refund_order_count").scalar()
        rules.append((refunds > 0, _finding("refund_orders", None, refunds)))
    if "data_quality" in r:
        for counter, v in zip(QUALITY_COUNTERS, _scalars(r["data_quality"], *QUALITY_COUNTERS)):
            rules.append((v > 0, _finding("data_quality", counter, v)))
    if "daily_sales" in r:
        rules.append(_trend_rule(_ends(r["daily_sales"], F.col("name"), "value"), "sales_trend"))
    return _emit(_session(r), rules)


def sales_findings(given: DataFrame | Mapping[str, DataFrame]) -> DataFrame:
    """FND-2: completion, growth, regions below target, region imbalance, volatility."""
    r = _results(given, "order")
    rules: list[tuple[Column, Column]] = []
    if "target_completion" in r:
        completion = r["target_completion"].select("completion_rate").scalar()
        rules.append((completion < COMPLETION_WARNING, _finding("low_target_completion", None, completion, None, COMPLETION_WARNING)))
    if "growth_rate" in r:
        growth = r["growth_rate"].select("growth_rate").scalar()
        rules.append((growth < 0, _finding("sales_decline", None, F.abs(growth))))
    if "region_performance" in r:
        key = F.struct(-F.coalesce(F.col("sales_amount"), F.lit(0.0)), F.col("name"))
        low = r["region_performance"].where(F.col("completion_rate") < COMPLETION_WARNING).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col("name").alias("n")))),
                                     lambda x: x["n"]), "、").alias("names"), F.count(F.lit(1)).alias("cnt"))
        low_names, low_n = _scalars(low, "names", "cnt")
        rules.append((low_n > 0, _finding("low_completion_regions", low_names, low_n, None, COMPLETION_WARNING)))
    if "region_ranking" in r:
        hi = r["region_ranking"].where(F.col("is_highest")).select(F.struct("name", "value")).scalar()
        lo = r["region_ranking"].where(F.col("is_lowest")).select(F.struct("name", "value")).scalar()
        rules.append(((hi["value"] > 0) & (hi["value"] >= lo["value"] * 2),
                      _finding("region_imbalance", hi["name"], hi["value"], lo["name"], lo["value"])))
    if "sales_volatility" in r:
        cv = r["sales_volatility"].select("coefficient_of_variation").scalar()
        total = r["sales_summary"].select("total").scalar()
        rules.append((total.isNotNull() & (cv >= VOLATILITY_WARNING), _finding("high_volatility", None, cv, None, VOLATILITY_WARNING)))
    return _emit(_session(r), rules)


def score_findings(given: DataFrame | Mapping[str, DataFrame]) -> DataFrame:
    """FND-3: subject gap, class gap, top student, exam trend change (in the order of the exams)."""
    r = _results(given, "student_score")
    rules = []
    for code, name in (("subject_gap", "subject_score"), ("class_gap", "class_score")):
        if name in r:
            n, first, last = _scalars(_sorted_ends(r[name], "average", "name"), "n", "first", "last")
            rules.append(((n >= 1) & (first["name"] != last["name"]),
                          _finding(code, first["name"], first["value"], last["name"], last["value"])))
    if "student_rollup" in r:
        st = r["student_rollup"]
        label = F.coalesce(F.col("student_name"), F.col("student_id")) if "student_name" in st.columns else F.col("student_id")
        top = st.agg(F.min_by(F.struct(label.alias("name"), F.col("average").alias("value")),
                              F.struct(-F.col("average"), F.col("student_id")))).scalar()
        rules.append((top.isNotNull(), _finding("top_student", top["name"], top["value"])))
    if "exam_trend" in r:
        rules.append(_trend_rule(_ends(r["exam_trend"].withColumnRenamed("average", "value"), F.struct("_first", "name"), "value"), "exam_trend"))
    return _emit(_session(r), rules)


def inventory_findings(given: DataFrame | Mapping[str, DataFrame]) -> DataFrame:
    """FND-4: low-stock count with the first five names, stock trend change, leading warehouse."""
    r = _results(given, "inventory")
    rules = []
    if "low_stock" in r:
        label = F.coalesce(F.col("product_name"), F.col("product_id"), F.lit(UNNAMED_PRODUCT))
        order = [-F.col("shortage"), F.coalesce("product_id", "product_name", F.lit(""))]
        low = r["low_stock"].select(F.struct(*order).alias("k"), label.alias("label"))
        count = low.agg(F.count(F.lit(1))).scalar()
        first5 = low.orderBy("k").limit(5)
        names = first5.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "label"))),
                                                    lambda x: x["label"]), "、")).scalar()
        rules.append((count > 0, _finding("low_stock", names, count)))
    if "inventory_trend" in r:
        rules.append(_trend_rule(_ends(r["inventory_trend"], F.col("name"), "value"), "stock_trend"))
    if "warehouse_stock" in r:
        wh = _sorted_ends(r["warehouse_stock"], "value", "name").select("first").scalar()
        rules.append((wh.isNotNull(), _finding("leading_warehouse", wh["name"], wh["value"])))
    return _emit(_session(r), rules)


def safe_payload(rows: DataFrame) -> DataFrame:
    """PRJ-3: the order results that may leave the engine, a row for each cell: no customer names,
    and in the quality part no contact counters and no unverified total (the overview has its own)."""
    from sheetwise.plans.outcome import all_results, result_payload
    return result_payload(all_results(rows, "order"), "order", rows.sparkSession)
