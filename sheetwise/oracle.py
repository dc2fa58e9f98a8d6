"""Independent DuckDB SQL for every registered query (the correctness oracle).

The SQL is written separately from the Spark code, with its own copy of status words and city
names, rendered into CASE expressions.
Tables ``lineitem orders part customer nation region events documents labels
pages ...`` are views over the driver's parquet files.
"""

from __future__ import annotations

from sheetwise.oracle_outcome import outcome_sql

# Fixed values, written out again so that a wrong one in the library shows.
STATUS_CODES = {
    "待支付": "pending", "pending": "pending", "待付款": "pending",
    "已支付": "paid", "paid": "paid",
    "已完成": "completed", "completed": "completed", "complete": "completed",
    "已取消": "cancelled", "取消": "cancelled", "cancelled": "cancelled", "canceled": "cancelled",
    "退款中": "refund_in_progress", "refund in progress": "refund_in_progress",
    "已退款": "refunded", "退款": "refunded", "refunded": "refunded",
}
REGION_NAMES = {
    "郑州市": "郑州", "zhengzhou": "郑州",
    "洛阳市": "洛阳", "luoyang": "洛阳",
    "南阳市": "南阳", "nanyang": "南阳",
    "开封市": "开封", "kaifeng": "开封",
    "安阳市": "安阳", "anyang": "安阳",
    "新乡市": "新乡", "xinxiang": "新乡",
    "焦作市": "焦作", "jiaozuo": "焦作",
    "许昌市": "许昌", "xuchang": "许昌",
    "周口市": "周口", "zhoukou": "周口",
    "平顶山市": "平顶山", "pingdingshan": "平顶山",
    "三门峡市": "三门峡", "sanmenxia": "三门峡",
    "商丘市": "商丘", "shangqiu": "商丘",
    "濮阳市": "濮阳", "puyang": "濮阳",
    "鹤壁市": "鹤壁", "hebi": "鹤壁",
    "漯河市": "漯河", "luohe": "漯河",
    "信阳市": "信阳", "xinyang": "信阳",
    "驻马店市": "驻马店", "zhumadian": "驻马店",
    "济源市": "济源", "jiyuan": "济源",
}
# End of fixed values.


def M(x: str) -> str:
    """Half-up rounding to 2 places on a DECIMAL(38,8), as DOUBLE."""
    return f"cast(round(cast({x} as decimal(38,8)), 2) as double)"


def RD(x: str) -> str:
    """Rounded but kept decimal (for later exact sums)."""
    return f"round(cast({x} as decimal(38,8)), 2)"


def PCT(a: str, b: str) -> str:
    return (f"case when ({b}) is not null and ({b}) <> 0 then "
            f"{M(f'cast({a} as double) / cast({b} as double) * 100')} end")


def HYB(oid: str = "oid") -> str:
    return f"(case when count({oid}) > 0 then count(distinct {oid}) else count(*) end)"


def HYB_IF(cond: str, oid: str = "oid") -> str:
    return (f"(case when count(case when {cond} then {oid} end) > 0 "
            f"then count(distinct case when {cond} then {oid} end) else count_if({cond}) end)")


def _case_map(expr: str, mapping: dict[str, str], default: str) -> str:
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items())
    return f"coalesce(case {expr} {whens} end, {default})"


STATUS_SQL = _case_map("lower(trim(status))", STATUS_CODES, "'unknown'")
REGION_SQL = _case_map("lower(nullif(trim(region), ''))", REGION_NAMES, "nullif(trim(region), '')")

ORDER_BASE = f"""
b as (
 select l_orderkey ok, l_partkey pk, l_suppkey sk, l_linenumber ln, o_custkey ck, c_name, p_name, p_type, r_name,
        o_orderdate, o_orderstatus, o_orderpriority, l_returnflag,
        cast(p_retailprice as decimal(12,2)) p, cast(l_quantity as decimal(12,2)) q,
        cast(1 as decimal(6,4)) - cast(l_discount as decimal(6,4)) d,
        cast(o_totalprice as decimal(14,2)) tgt
 from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
      join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
      join region on n_regionkey = r_regionkey),
v as (
 select case when ok % 37 = 0 then null else concat('O-', cast(ok as varchar)) end order_id,
  concat('C-', cast(ck as varchar)) customer_id, c_name customer_name, p_name product,
  case when pk % 19 = 0 then null else p_type end category, r_name region, o_orderdate order_date,
  case when pk % 29 = 0 then null when pk % 31 = 0 then -p else p end unit_price,
  case when sk % 23 = 0 then -q else q end quantity,
  case when sk % 13 = 0 then null when sk % 17 = 0 then cast(1.2 as decimal(6,4)) else d end discount,
  case when ln = 7 then null when ok % 43 = 0 then cast(-1 as decimal(18,2))
       when ok % 11 = 0 then cast(round(p*q*d, 2) + 5 as decimal(18,2))
       else cast(round(p*q*d, 2) as decimal(18,2)) end sales_amount,
  case when ok % 23 = 0 then 'Canceled' when ok % 41 = 0 then 'mystery'
       when l_returnflag = 'R' then ' refunded ' when o_orderstatus = 'F' then 'COMPLETE'
       when o_orderstatus = 'P' then 'pending' else 'paid' end status,
  o_orderpriority payment_method, tgt target_amount,
  case when ck % 9 = 0 then null when ck % 2 = 0 then 'F' else 'M' end gender,
  cast(ck % 131 as int) age,
  case when ck % 10 = 0 then null when ck % 7 = 0 then '12-3'
       else concat('+86 138-', cast(10000000 + ck as varchar)) end phone,
  case when ck % 8 = 0 then null when ck % 6 = 0 then 'bad-email'
       else concat('u', cast(ck as varchar), '@example.com') end email,
  ok, pk, sk, ln
 from b),
src as (select * from v union all select * from v where ok % 50 = 0),
dd as (select *, count(*) as copies from src group by all),
r0 as (
 select *, nullif(trim(order_id), '') oid, nullif(trim(customer_id), '') cid, nullif(trim(product), '') prod,
  coalesce(nullif(trim(category), ''), '未分类') cat, {REGION_SQL} reg, order_date dt,
  unit_price up, quantity qt, discount dc, sales_amount raw, {STATUS_SQL} st,
  case when unit_price >= 0 and quantity >= 0 and discount between 0 and 1
       then unit_price * quantity * discount end ver
 from dd),
r as (
 select *, case when ver is null and raw >= 0 then raw end unver,
  coalesce(ver is not null and raw >= 0, false) cmp,
  coalesce(ver is not null and raw >= 0 and not (abs(ver - raw) <= 0.01), false) mis,
  case when ver is null and sales_amount is not null and not coalesce(raw >= 0, false) then 'invalid_amount'
       when coalesce(ver is not null and raw >= 0 and not (abs(ver - raw) <= 0.01), false) then 'conflict'
       when coalesce(ver is not null and raw >= 0, false) then 'verified_match'
       when ver is not null then 'verified'
       when ver is null and raw >= 0 then 'unverified' else 'missing' end amount_status
 from r0),
ol as (
 select oid order_id, {RD('sum(ver)')} va, {RD('sum(unver)')} ua, count(ver) > 0 hv, count(unver) > 0 hu,
  coalesce(bool_or(cmp), false) hc, count_if(mis) cc, sum(copies) rc,
  sum(case when st = 'completed' then ver end) s_comp, sum(case when st = 'cancelled' then ver end) s_canc,
  sum(case when st in ('refund_in_progress', 'refunded') then ver end) s_ref
 from r where oid is not null group by oid
 union all
 select null, {RD('ver')}, {RD('unver')}, ver is not null, unver is not null, cmp, cast(mis as bigint), copies,
  case when st = 'completed' then ver end, case when st = 'cancelled' then ver end,
  case when st in ('refund_in_progress', 'refunded') then ver end
 from r where oid is null)"""


def _with(*extra: str) -> str:
    parts = [ORDER_BASE.strip()] + [e.strip() for e in extra]
    return "with " + ",\n".join(parts) + "\n"


OVERVIEW_COLS = f"""
 sum(rc) record_count, count(*) order_count, {M('sum(va)')} verified_sales_total, count(va) verified_order_count,
 {M('avg(va)')} average_verified_order_value, {M('max(va)')} maximum_verified_order_value,
 {M('min(va)')} minimum_verified_order_value, {M('median(cast(va as double))')} median_verified_order_value,
 count_if(hu) unverified_order_count, count_if(not hv and not hu) no_usable_amount_order_count,
 {PCT('count(va)', 'count(*)')} amount_verification_rate, {M('sum(ua)')} unverified_amount_total,
 count_if(hc) amount_comparable_count, count_if(cc > 0) amount_mismatch_count,
 {PCT('count_if(cc > 0)', 'count_if(hc)')} amount_mismatch_rate,
 case when count(va) >= 2 and avg(va) <> 0 then {M('stddev_pop(cast(va as double))')} end standard_deviation,
 case when count(va) >= 2 and avg(va) <> 0 then {PCT('stddev_pop(cast(va as double))', 'avg(va)')} end
   coefficient_of_variation"""

BUSINESS = f"""{HYB()} order_count, {RD('sum(case when qt >= 0 then qt end)')} quantity, {RD('sum(ver)')} sales"""


def _orders_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["order_overview"] = _with() + f"""select {OVERVIEW_COLS},
 {M('sum(s_comp)')} completed_sales_amount, {M('sum(s_canc)')} cancelled_order_amount,
 {M('sum(s_ref)')} refund_related_amount from ol"""
    q["order_rollup"] = _with() + """select order_id, cast(va as double) verified_amount,
 cast(ua as double) unverified_amount, hv has_verified_amount, hu has_unverified_amount,
 hc has_comparable_amount, cc conflict_count from ol"""
    q["order_count"] = _with() + f"""select count(*) order_count,
 (select {HYB()} from r) hybrid_order_count from ol"""
    q["status_amounts"] = _with() + f"""select
 {M("sum(case when st = 'completed' then ver end)")} completed_sales_amount,
 {M("sum(case when st = 'cancelled' then ver end)")} cancelled_order_amount,
 {M("sum(case when st in ('refund_in_progress', 'refunded') then ver end)")} refund_related_amount from r"""
    q["sales_volatility"] = _with() + f"""select
 case when count(va) >= 2 and avg(va) <> 0 then {M('stddev_pop(cast(va as double))')} end standard_deviation,
 case when count(va) >= 2 and avg(va) <> 0 then {PCT('stddev_pop(cast(va as double))', 'avg(va)')} end
   coefficient_of_variation from ol"""
    q["product_sales"] = _with() + f"""select prod name, {HYB()} order_count,
 {M('sum(case when qt >= 0 then qt end)')} quantity, {M('sum(ver)')} sales_amount
 from r where prod is not null group by prod"""
    q["category_sales"] = _with(f"g as (select cat category, {BUSINESS} from r group by cat)") + f"""
 select category, order_count, cast(quantity as double) quantity, cast(sales as double) sales_amount,
 case when sales is not null then {PCT('sales', '(select sum(sales) from g)')} end sales_share from g"""
    region_g = (f"g as (select reg name, {BUSINESS}, {RD('sum(target_amount)')} tgt "
                f"from r where reg is not null group by reg)")
    q["region_sales"] = _with(region_g) + f"""
 select name, order_count region_order_count, cast(sales as double) region_sales,
 cast(quantity as double) region_quantity,
 case when sales is not null and order_count > 0 then {M('sales / order_count')} end region_average_order_value,
 cast(tgt as double) target_amount, case when sales is not null then {PCT('sales', 'tgt')} end completion_rate,
 cast(sales as double) value from g"""
    for key, fmt, val in (("daily_sales", "%Y-%m-%d", M("sum(ver)")), ("monthly_sales", "%Y-%m", M("sum(ver)")),
                          ("monthly_orders", "%Y-%m", HYB())):
        q[key] = _with(f"""t as (select strftime(dt, '{fmt}') name, {val} value from r
 where dt is not null and ver is not null group by 1)""") + "select * from t where (select count(*) from t) >= 2"
    cust = f"""cr as (select cid customer_id, {HYB()} order_count, {M('sum(ver)')} sales_amount,
 min(nullif(trim(customer_name), '')) customer_name from r where cid is not null group by cid)"""
    q["customer_rollup"] = _with(cust) + "select * from cr"
    q["top_customers"] = _with(cust) + "select * from cr order by coalesce(sales_amount, 0) desc, customer_id limit 10"
    q["customer_summary"] = _with(cust) + f"""select count(*) unique_customer_count,
 count_if(order_count >= 2) repeat_customer_count,
 {PCT('count_if(order_count >= 2)', 'count(*)')} repeat_customer_rate,
 case when count(*) > 0 then {M('sum(order_count) / count(*)')} end average_orders_per_customer from cr"""
    q["status_analysis"] = _with() + f"""select st name, {HYB()} order_count, {M('sum(ver)')} sales_amount,
 {PCT(HYB(), f'(select {HYB()} from r)')} share from r group by st"""
    known = "('pending', 'paid', 'completed', 'cancelled', 'refund_in_progress', 'refunded')"
    q["status_summary"] = _with(f"""a as (select {HYB()} den,
 {HYB_IF("st = 'completed'")} completed_order_count, {HYB_IF("st = 'cancelled'")} cancelled_order_count,
 {HYB_IF("st = 'refund_in_progress'")} + {HYB_IF("st = 'refunded'")} refund_order_count
 from r where st in {known})""") + f"""select completed_order_count, cancelled_order_count, refund_order_count,
 {PCT('completed_order_count', 'den')} order_completion_rate, {PCT('cancelled_order_count', 'den')} cancellation_rate,
 {PCT('refund_order_count', 'den')} refund_rate from a"""
    q["payment_analysis"] = _with(
        "pr as (select *, nullif(trim(payment_method), '') pay from r where nullif(trim(payment_method), '') is not null)",
        f"g as (select pay name, {HYB()} order_count, {RD('sum(ver)')} sales from pr group by pay)",
        f"tot as (select {HYB()} n, sum(ver) s from pr)") + f"""
 select name, order_count, cast(sales as double) sales_amount,
 {PCT('order_count', '(select n from tot)')} order_share,
 case when sales is not null then {PCT('sales', '(select s from tot)')} end sales_share from g"""
    q["discount_analysis"] = _with() + f"""select count(*) valid_discount_count,
 {HYB_IF('dc < 1')} discounted_order_count, {PCT(HYB_IF('dc < 1'), HYB())} discounted_order_rate,
 {M('avg(dc)')} average_discount, {M('avg(case when dc < 1 then ver end)')} average_discounted_order_value,
 {M('sum(case when ver is not null then up * qt - ver end)')} estimated_discount_amount
 from r where dc is not null and dc between 0 and 1"""
    prof = f"{HYB()} order_count, count(distinct cid) customer_count, {M('sum(ver)')} sales_amount, min(ok * 8 + ln) seen"
    q["gender_profile"] = _with() + f"""select coalesce(nullif(trim(gender), ''), 'unknown') name, {prof}
 from r group by 1"""
    band = """case when age > 0 and age < 120 then case when age < 18 then '18以下' when age < 25 then '18-24'
 when age < 35 then '25-34' when age < 45 then '35-44' when age < 55 then '45-54' when age < 65 then '55-64'
 else '65+' end end"""
    q["age_profile"] = _with() + f"select {band} name, {prof} from r where ({band}) is not null group by 1"
    phone_ok = ("coalesce(regexp_full_match(regexp_replace(regexp_replace(nullif(trim(phone), ''), "
                "'[\\s\\-()]', '', 'g'), '^\\+', ''), '[0-9]{7,15}'), false)")
    mail_ok = ("coalesce(regexp_full_match(nullif(trim(email), ''), '[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+@"
               "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+'),"
               " false)")

    def W(cond: str) -> str:
        return f"sum(case when {cond} then copies else 0 end)"

    def contact(col: str, ok: str) -> str:
        present = f"nullif(trim({col}), '') is not null"
        return (f"{W(present)} {col}_present_count, {W('not (' + present + ')')} {col}_missing_count, "
                f"{W(ok)} {col}_valid_count, {W(present + ' and not ' + ok)} {col}_invalid_count")

    both = W(f"{phone_ok} and {mail_ok}")
    contacts = (f"{contact('phone', phone_ok)}, {contact('email', mail_ok)}, {both} contact_complete_count, "
                f"{PCT(both, 'sum(copies)')} contact_complete_rate")
    q["contact_quality"] = _with() + f"select {contacts} from r"
    q["valid_ranges"] = _with() + f"""select {W('up >= 0')} valid_unit_price_count, {W('qt >= 0')} valid_quantity_count,
 {W('dc between 0 and 1')} valid_discount_count, {W('raw >= 0')} valid_raw_amount_count,
 {W('age > 0 and age < 120')} valid_age_count from r"""
    q["data_quality"] = _with(f"""o as (select count_if(cc > 0) amount_mismatch_count, count_if(hc) amount_comparable_count,
 {PCT('count_if(cc > 0)', 'count_if(hc)')} amount_mismatch_rate, count_if(hu) unverified_order_count,
 {M('sum(ua)')} unverified_amount_total from ol)""") + f"""select sum(copies) row_count,
 sum(copies) - count(*) duplicate_row_count, {W('oid is not null')} - count(distinct oid) duplicate_order_id_count,
 {W('order_date is not null and dt is null')} invalid_date_count, {W('up < 0')} invalid_unit_price_count,
 {W('up = 0')} zero_unit_price_count, {W('qt < 0')} invalid_quantity_count, {W('qt = 0')} zero_quantity_count,
 {W('dc is not null and not (dc between 0 and 1)')} invalid_discount_count,
 {W('age is not null and not (age > 0 and age < 120)')} invalid_age_count,
 {W("st = 'unknown'")} invalid_status_count, count(unver) unverified_amount_count,
 count_if(amount_status = 'invalid_amount') invalid_amount_count, {contacts},
 any_value(o.amount_mismatch_count) amount_mismatch_count, any_value(o.amount_comparable_count) amount_comparable_count,
 any_value(o.amount_mismatch_rate) amount_mismatch_rate, any_value(o.unverified_order_count) unverified_order_count,
 any_value(o.unverified_amount_total) unverified_amount_total from r, o"""
    cols = ["order_id", "customer_id", "customer_name", "product", "category", "region", "order_date",
            "unit_price", "quantity", "discount", "sales_amount", "status", "payment_method", "target_amount",
            "gender", "age", "phone", "email", "ok", "pk", "sk", "ln"]
    unions = " union all ".join(
        f"select '{'date' if c == 'order_date' else c}' column_name, count(*) - count({c}) missing_count from src"
        for c in cols)
    q["missing_summary"] = _with() + f"select * from ({unions}) m where missing_count > 0"
    q["sales_summary"] = _with() + f"""select {M('sum(va)')} total, {M('avg(va)')} average, {M('max(va)')} maximum,
 {M('min(va)')} minimum from ol having sum(va) is not null"""
    q["region_ranking"] = _with(region_g) + """
 select row_number() over (order by sales desc, name) rank, name, cast(sales as double) value,
 row_number() over (order by sales desc, name) = 1 is_highest,
 row_number() over (order by sales desc, name) = count(*) over () is_lowest,
 row_number() over (order by sales desc, name) <= 10 in_top10 from g where sales is not null"""
    q["growth_rate"] = _with(f"""t as (select strftime(dt, '%Y-%m-%d') name, {M('sum(ver)')} value from r
 where dt is not null and ver is not null group by 1)""") + f"""
 select case when count(*) >= 2 and arg_min(value, name) <> 0 then
 {PCT('arg_max(value, name) - arg_min(value, name)', 'arg_min(value, name)')} end growth_rate from t"""
    q["target_completion"] = _with() + f"""select case when (select sum(va) from ol) is not null then
 {PCT(M('(select sum(va) from ol)'), 'sum(target_amount * copies)')} end completion_rate from r"""
    q["region_performance"] = _with(region_g) + f"""select name, cast(sales as double) sales_amount,
 cast(tgt as double) target_amount, {PCT('sales', 'tgt')} completion_rate from g where sales is not null"""
    q["product_quantity"] = _with() + f"""select prod name, {M('sum(case when qt >= 0 then qt end)')} value
 from r where prod is not null group by prod having sum(case when qt >= 0 then qt end) is not null"""
    q["amount_status"] = _with() + f"""select amount_status, count(*) row_count, {M('sum(ver)')} verified_total,
 {M('sum(unver)')} unverified_total from r group by amount_status"""
    q["verified_amount"] = _with() + f"select ok, pk, sk, ln, copies _copies, {M('ver')} verified_amount from r"
    q["unverified_amount"] = _with() + f"select ok, pk, sk, ln, copies _copies, {M('unver')} unverified_amount from r"
    q["amount_mismatch"] = _with() + """select ok, pk, sk, ln, copies _copies, cmp amount_comparable,
 mis amount_mismatch from r"""
    q["order_dedup"] = _with() + """select sum(copies) row_count, count(*) distinct_row_count,
 sum(copies) - count(*) duplicate_row_count from dd"""
    q["normalize_status"] = _with() + f"""select status raw_status, {STATUS_SQL} status_code, count(*) row_count
 from src group by all"""
    q["normalize_region"] = _with() + f"select {REGION_SQL} region, count(*) row_count from src group by 1"
    q["clean_text"] = _with() + "select nullif(trim(status), '') value, count(*) row_count from src group by 1"
    q["valid_phone"] = _with() + f"""select nullif(trim(phone), '') phone, {phone_ok} is_valid, count(*) row_count
 from src group by all"""
    q["valid_email"] = _with() + f"""select nullif(trim(email), '') email, {mail_ok} is_valid, count(*) row_count
 from src group by all"""
    return q


INVENTORY_BASE = """with inv as (
 select concat('P-', cast(l_partkey as varchar)) product_id, p_name product_name, p_type category, n_name warehouse,
  case when l_suppkey % 11 = 0 then '  ' else s_name end supplier,
  case when l_orderkey % 47 = 0 then 'n/a-qty' else cast(cast(l_quantity as int) as varchar) end stock_quantity,
  cast(p_size as int) safety_stock, cast(p_retailprice as decimal(12,2)) unit_cost,
  cast(l_linenumber * 3 as int) inbound_quantity, cast(l_quantity as int) outbound_quantity,
  l_shipdate inventory_date, l_orderkey * 8 + l_linenumber pos
 from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
      join nation on s_nationkey = n_nationkey),
iv as (select *, try_cast(trim(stock_quantity) as double) st from inv)
"""

X = "cast({} as decimal(38,8))"


def _inventory_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    b = INVENTORY_BASE

    def dist(c: str) -> str:
        return f"count(distinct case when nullif(trim({c}), '') is not null then trim({c}) end)"
    q["inventory_count"] = b + f"""select case when {dist('product_id')} > 0 then {dist('product_id')}
 else {dist('product_name')} end inventory_count from iv"""
    q["stock_summary"] = b + f"""select count(st) count, {M(X.format('sum(st)'))} total,
 {M('avg(' + X.format('st') + ')')} average, {M('max(st)')} maximum, {M('min(st)')} minimum,
 {M('median(st)')} median from iv having count(st) > 0"""
    q["low_stock"] = b + f"""select nullif(trim(product_id), '') product_id, nullif(trim(product_name), '') product_name,
 {M('st')} stock_quantity, {M('safety_stock')} safety_stock, {M('safety_stock - st')} shortage, pos
 from iv where st is not null and safety_stock is not null and st < safety_stock"""
    val = X.format("st * cast(unit_cost as double)")
    q["inventory_value"] = b + f"""select count({val}) count, {M('sum(' + val + ')')} total,
 {M('avg(' + val + ')')} average from iv where st is not null and unit_cost is not null having count(*) > 0"""
    for key, col in (("category_stock", "category"), ("warehouse_stock", "warehouse"), ("supplier_stock", "supplier")):
        q[key] = b + f"""select trim({col}) name, {M('sum(' + X.format('st') + ')')} value from iv
 where st is not null and nullif(trim({col}), '') is not null group by 1"""
    q["inventory_flow"] = b + f"""select cast(i as double) total_inbound, cast(o as double) total_outbound,
 {M('i - o')} net_change from (select count(*) n, round(sum({X.format('inbound_quantity')}), 2) i,
 round(sum({X.format('outbound_quantity')}), 2) o from iv
 where inbound_quantity is not null and outbound_quantity is not null) where n > 0"""
    q["inventory_trend"] = b + f"""select strftime(inventory_date, '%Y-%m-%d') name,
 {M('sum(' + X.format('st') + ')')} value from iv where st is not null and inventory_date is not null group by 1"""
    return q


SCORES_BASE = """with ss as (
 select concat('S-', cast(user_id as varchar)) student_id, concat('Student ', cast(user_id as varchar)) student_name,
  event_type subject,
  case when event_id % 53 = 0 then 'absent' else cast(cast(value as decimal(10,2)) as varchar) end score,
  case when user_id % 17 = 0 then null else concat('Class ', cast(user_id % 10 as varchar)) end class_name,
  concat('Week ', cast(extract(week from ts) as varchar)) exam_name, cast(ts as date) exam_date, event_id
 from events),
sc as (select *, try_cast(trim(score) as double) s from ss)
"""


def _scores_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    b = SCORES_BASE
    stats = f"{M('avg(' + X.format('s') + ')')} average, {M('max(s)')} maximum, {M('min(s)')} minimum"
    q["student_count"] = b + """select count(distinct case when nullif(trim(student_id), '') is not null
 then student_id end) student_count from sc"""
    q["score_summary"] = b + f"select count(s) count, {stats}, {M('median(s)')} median from sc having count(s) > 0"
    for key, col in (("subject_score", "subject"), ("class_score", "class_name")):
        q[key] = b + f"""select trim({col}) name, count(s) count, {stats} from sc
 where s is not null and nullif(trim({col}), '') is not null group by 1"""
    q["student_rollup"] = b + f"""select trim(student_id) student_id, count(s) score_count, {stats},
 min(nullif(trim(student_name), '')) student_name from sc
 where s is not null and nullif(trim(student_id), '') is not null group by 1"""
    avg = M('avg(' + X.format('s') + ')')
    q["exam_trend"] = b + f"""select strftime(exam_date, '%Y-%m-%d') name, {avg} average, count(s) count
 from sc where s is not null and exam_date is not null group by 1
 having (select count(*) from sc where s is not null and exam_date is not null) > 0
 union all
 select trim(exam_name) name, {avg} average, count(s) count
 from sc where s is not null and nullif(trim(exam_name), '') is not null group by 1
 having (select count(*) from sc where s is not null and exam_date is not null) = 0"""
    q["exam_names"] = b + f"""select trim(exam_name) name, {avg} average, count(s) count, min(event_id) seen
 from sc where s is not null and nullif(trim(exam_name), '') is not null group by 1"""
    return q


PROFILE_BASE = """with gp as (select d.doc_id, lang, source, n_chars, text, quality, toxic
 from documents d left join labels l on d.doc_id = l.doc_id)
"""
PROFILE_COLS = [("doc_id", "int64", "number"), ("lang", "object", "text"), ("source", "object", "text"),
                ("n_chars", "int64", "number"), ("text", "object", "text"), ("quality", "int64", "number"),
                ("toxic", "int64", "number")]
NUMBER_RE = r"[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)"


def _profile_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    b = PROFILE_BASE

    def per_col(fn) -> str:
        return " union all ".join(fn(i, c, dt, lab) for i, (c, dt, lab) in enumerate(PROFILE_COLS))
    q["generic_profile"] = b + per_col(lambda i, c, dt, lab: (
        f"select {i} position, '{c}' name, "
        + (f"case when count(*) - count({c}) > 0 then 'float64' else 'int64' end" if dt == "int64" else f"'{dt}'")
        + f" dtype, count({c}) non_null_count, count(*) - count({c}) null_count from gp"))
    rate = lambda c: f"coalesce(case when count(*) > 0 then {M(f'(count(*) - count({c})) / count(*) * 100')} end, 0.0)"
    q["missing_rate"] = b + per_col(lambda i, c, dt, lab: (
        f"select '{c}' column_name, count(*) - count({c}) missing_count, {rate(c)} missing_rate from gp"))
    q["available_fields"] = b + "select * from (" + per_col(lambda i, c, dt, lab: (
        f"select {i} position, '{c}' name, count({c}) n from gp")) + ") where n > 0"
    q["available_fields"] = q["available_fields"].replace("select * from (", "select position, name from (")
    q["column_profile"] = b + per_col(lambda i, c, dt, lab: (
        f"select {i} position, '{c}' name, '{lab}' data_type, count(*) - count({c}) missing_count, "
        f"count(distinct {c}) unique_count from gp"))
    q["table_shape"] = b + "select count(*) row_count, cast(7 as bigint) column_count from gp"
    q["generic_findings"] = b + "select * from (" + per_col(lambda i, c, dt, lab: (
        f"select 'missing_values' code, '{c}' subject, cast(count(*) - count({c}) as double) value, "
        f"{rate(c)} missing_rate from gp")) + ") where value > 0"
    text_cols = [c for c, _, _ in PROFILE_COLS] + ["is_long"]
    tf = ("with gp as (select d.doc_id, lang, source, n_chars, text, quality, toxic from documents d "
          "left join labels l on d.doc_id = l.doc_id), tf as (select " +
          ", ".join(f"cast({c} as varchar) {c}" for c, _, _ in PROFILE_COLS) +
          ", case when n_chars > 1000 then 'true' else 'false' end is_long from gp)\n")
    bools = "('True', 'False', 'TRUE', 'FALSE', 'true', 'false')"
    q["infer_types"] = tf + " union all ".join(
        f"""select {i} position, '{c}' name, case when count_if({c} in {bools}) = count(*) and count(*) > 0
 then 'boolean' when count_if(regexp_full_match(trim({c}), '{NUMBER_RE}')) = count({c}) then 'number'
 else 'text' end data_type from tf""" for i, c in enumerate(text_cols))
    return q


TOKENS_SQL = ("('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', "
              "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')")


def _tok(c: str) -> str:
    return f"case when {c} not in {TOKENS_SQL} then {c} end"


def _date_parse(c: str) -> str:
    t = f"trim(regexp_replace(replace(translate({c}, '年月/.', '----'), '日', ' '), '\\s+', ' ', 'g'))"
    return (f"try_strptime({t}, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%d', '%Y-%m-%dT%H:%M:%S', "
            f"'%Y%m%d'])")


RAW_SALES = f"""with rs0 as (
 select l_orderkey ok, l_suppkey sk, l_linenumber ln, l_quantity, cast(l_extendedprice as decimal(12,2)) price,
  l_shipdate, n_name
 from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
raw as (
 select case when ok % 61 = 0 then null when ln = 6 then 'not a date'
   when ln = 1 then strftime(l_shipdate, '%Y-%m-%d') when ln = 2 then strftime(l_shipdate, '%Y/%m/%d')
   when ln = 3 then strftime(l_shipdate, '%Y.%-m.%-d') when ln = 4 then strftime(l_shipdate, '%Y年%-m月%-d日')
   when ln = 5 then strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') end d_txt,
  case when ok % 61 = 0 then null when sk % 13 = 0 then 'N/A' when sk % 17 = 0 then 'NULL' else n_name end reg,
  case when ok % 61 = 0 then null when ok % 29 = 0 then 'n/a' when ok % 3 = 0 then format('{{:,.2f}}', price)
   when ok % 3 = 1 then concat('¥', cast(price as varchar)) else cast(price as varchar) end sales,
  case when ok % 61 = 0 then null else cast(price + 100 as varchar) end tgt,
  case when ok % 61 = 0 then null else cast(cast(l_quantity as int) as varchar) end cust,
  case when ok % 61 = 0 then null when sk % 7 = 0 then n_name end big,
  case when ok % 61 = 0 then null else cast(ok as varchar) end no
 from rs0),
rs as (select * from raw union all select * from raw where cast(no as bigint) % 50 = 0),
tok as (select {_tok('d_txt')} d_txt, {_tok('reg')} reg, {_tok('sales')} sales, {_tok('tgt')} tgt,
 {_tok('cust')} cust, {_tok('big')} big, {_tok('no')} no from rs),
std as (select d_txt, coalesce(reg, big) region, sales, tgt, cust, no from tok),
g as (select *, count(*) copies, d_txt is null and region is null and sales is null and tgt is null
  and cust is null and no is null empty from std group by all),
pg as (select *, {_date_parse('d_txt')} dp,
  try_cast(trim(replace(replace(sales, ',', ''), '¥', '')) as double) sp,
  try_cast(trim(replace(replace(tgt, ',', ''), '¥', '')) as double) tp,
  try_cast(trim(replace(replace(cust, ',', ''), '¥', '')) as double) cp from g),
cl as (select *, strftime(dp, '%Y-%m-%d') date,
  cast(d_txt is not null and dp is null as int) + cast(sales is not null and sp is null as int)
  + cast(tgt is not null and tp is null as int) + cast(cust is not null and cp is null as int) inv,
  cast(dp is null as int) + cast(region is null as int) + cast(sp is null as int) + cast(tp is null as int)
  + cast(cp is null as int) + cast(no is null as int) miss from pg)
"""


def _cleaning_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    b = RAW_SALES
    summary = """select sum(copies) original_row_count, count_if(not empty) cleaned_row_count,
 coalesce(sum(case when empty then copies end), 0) removed_empty_rows,
 coalesce(sum(case when not empty then copies - 1 end), 0) removed_duplicate_rows,
 cast(coalesce(sum(case when not empty then inv end), 0) as bigint) invalid_value_count,
 coalesce(sum(case when not empty then miss end), 0) missing_value_count, cast(6 as bigint) column_count from cl"""
    q["clean_summary"] = b + summary
    q["invalid_values"] = b + "select invalid_value_count from (" + summary + ")"
    q["missing_cells"] = b + "select missing_value_count from (" + summary + ")"
    q["drop_empty_rows"] = b + """select sum(case when not empty then copies else 0 end) row_count,
 sum(case when empty then copies else 0 end) removed_empty_rows from g"""
    q["drop_duplicate_rows"] = b + """select count(*) row_count, sum(copies) - count(*) removed_duplicate_rows
 from g where not empty"""
    q["clean_table"] = b + """select date, region, sp sales_amount, tp target_amount, cp customer_count, no "单号"
 from cl where not empty"""
    q["clean_date"] = b + "select date, count(*) row_count from cl where not empty group by 1"
    x = lambda c: f"sum(cast({c} as decimal(38,8)))"
    q["clean_number"] = b + f"""select count(sp) sales_count, {M(x('sp'))} sales_total, count(tp) target_count,
 {M(x('tp'))} target_total, count(cp) customer_count, {M(x('cp'))} customer_total from cl where not empty"""
    q["coalesce_columns"] = b + "select region, count(*) row_count from std group by 1"
    q["missing_tokens"] = b + " union all ".join(
        f"select '{n}' column_name, count(*) - count({c}) missing_count from tok"
        for n, c in (("日期", "d_txt"), (" 区域 ", "reg"), ("销售额", "sales"), ("目标额", "tgt"),
                     ("Customers ", "cust"), ("大区", "big"), ("单号", "no")))
    q["to_number"] = b + f"""select count(sn) parsed_count, count_if(sales is not null and sn is null) invalid_count,
 {M(x('sn'))} total from (select sales, try_cast(trim(sales) as double) sn from tok)"""
    q["parse_dates"] = b + f"""select strftime({_date_parse('d_txt')}, '%Y-%m-%d') day_key, count(*) row_count
 from tok group by 1"""
    return q


def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _catalog_base() -> str:
    from sheetwise.plans.vocab import CAPABILITIES, DOMAINS, INVENTORY_CONTEXT, ORDER_CONTEXT, all_aliases
    from sheetwise.sources.catalog import EXTRA_SALES, SEGMENT_KIND, TEMPLATES
    tpl = ", ".join(f"({_q(k)}, {i}, {_q(zh)}, {_q(en)}, {_q(sn)}, {_q(rule)})"
                    for k, rows in TEMPLATES.items() for i, (zh, en, sn, rule) in enumerate(rows))
    seg = " ".join(f"when {_q(a)} then {_q(b)}" for a, b in SEGMENT_KIND.items())
    aliases = ", ".join(f"({_q(t)}, {_q(a)})" for t, al in all_aliases().items() for a in (t, *al))
    sig = ", ".join(f"({_q(d)}, {o}, {b}, {st}, {si}, {len(sg)}, {_q(f)})"
                    for o, (d, _n, b, st, sigs) in enumerate(DOMAINS) for si, sg in enumerate(sigs) for f in sg)

    def lst(xs):
        return "[" + ", ".join(_q(x) for x in xs) + "]"
    caps = ", ".join(f"({_q(d)}, {o}, {_q(cid)}, {_q(name)}, {lst(a) if a else '[]::varchar[]'}, "
                     f"{'[' + ', '.join(lst(x) for x in y) + ']' if y else '[]::varchar[][]'})"
                     for d, cs in CAPABILITIES.items() for o, (cid, name, a, y) in enumerate(cs))
    zh, en, sn, rule = EXTRA_SALES
    key = "lower(regexp_replace(trim({}), '[\\s_-]+', '', 'g'))"
    inv = ", ".join(_q(x) for x in INVENTORY_CONTEXT)
    ordc = ", ".join(_q(x) for x in ORDER_CONTEXT)
    canon = ", ".join(_q(x) for x in all_aliases())
    ck = "dataset_id"
    remark = "case lang when 0 then '备注' when 1 then 'Remark' else 'remark' end"
    first = ("case kind " + " ".join(
        f"when {_q(k)} then case lang when 0 then {_q(r[0][0])} when 1 then {_q(r[0][1])} else {_q(r[0][2])} end"
        for k, r in TEMPLATES.items()) + " end")
    return f"""with ostat as (select o_custkey, count(*) n_all, count_if(o_orderpriority = '1-URGENT') n_urgent,
  count_if(o_orderstatus = 'F') n_done from orders group by o_custkey),
ds as (select c_custkey dataset_id, c_nationkey owner_id, c_name file_name,
  coalesce(case c_mktsegment {seg} end, 'notes') kind, c_nationkey % 3 lang,
  coalesce(n_all, 0) n_all, coalesce(n_urgent, 0) n_urgent, coalesce(n_done, 0) n_done
 from customer left join ostat on c_custkey = o_custkey),
tpl(kind, pos, zh, en, sn, rule) as (values {tpl}),
cols as (
 select dataset_id, pos, case lang when 0 then zh when 1 then en else sn end name,
  cast(case rule when 'all' then n_all when 'urgent' then n_urgent when 'done' then n_done else 0 end as bigint) non_null
 from ds join tpl using (kind)
 union all
 select dataset_id, {len(TEMPLATES['order'])}, case lang when 0 then {_q(zh)} when 1 then {_q(en)} else {_q(sn)} end, n_all
 from ds where kind = 'order' and dataset_id % 7 = 0),
al(target, alias) as (values {aliases}),
ak as (select {key.format('alias')} key, target from al),
kidx as (select key, min(target) target, count(distinct target) nt, list(distinct target) cands from ak group by key),
rc as (
 select c.*, {key.format('c.name')} key,
  case when k.nt = 1 then k.target end alias_target, case when k.nt > 1 then k.cands end candidates
 from cols c left join kidx k on {key.format('c.name')} = k.key),
rc2 as (
 select *, max(case when alias_target in ({inv}) then 1 else 0 end) over (partition by dataset_id) = 1 invc,
  max(case when alias_target in ({ordc}) then 1 else 0 end) over (partition by dataset_id) = 1 ordc from rc),
res as (
 select dataset_id, pos, name, non_null, key, coalesce(alias_target,
   case when candidates is null then null
        when invc and not ordc and list_contains(candidates, 'product_name') then 'product_name'
        when list_contains(candidates, 'product') then 'product' end) target from rc2),
ovr0 as (
 select {ck} dataset_id, 0 seq, {remark} source, 'customer_name' target from ds where {ck} % 11 = 0
 union all select {ck}, 1, '不存在的列', 'order_id' from ds where {ck} % 13 = 0
 union all select {ck}, 2, {remark}, 'bogus_field' from ds where {ck} % 17 = 0
 union all select {ck}, 3, {first}, 'customer_name' from ds where {ck} % 19 = 0
 union all select {ck}, 4, {remark}, 'order_id' from ds where {ck} % 23 = 0
 union all select {ck}, 5, {remark}, 'phone' from ds where {ck} % 29 = 0
 union all select {ck}, 6, {first}, 'phone' from ds where {ck} % 29 = 0),
ovr as (select dataset_id, max(seq) seq, source, arg_max(target, seq) target from ovr0 group by dataset_id, source),
oerr as (
 select o.*, case
   when not exists (select 1 from cols c where c.dataset_id = o.dataset_id and c.name = o.source) then 'unknown_source'
   when o.target not in ({canon}) then 'unknown_target'
   when o.source in ({canon}) and o.source <> o.target then 'source_is_canonical'
   when exists (select 1 from cols c where c.dataset_id = o.dataset_id and c.name = o.target)
        and o.source <> o.target then 'target_exists'
   when count(*) over (partition by o.dataset_id, o.target) > 1 then 'duplicate_target' end error_code
 from ovr o),
vov as (select dataset_id, seq, source, target from oerr
 where dataset_id not in (select dataset_id from oerr where error_code is not null)),
cand as (
 select r.* from res r where r.target is not null and r.name <> r.target
  and not exists (select 1 from vov v where v.dataset_id = r.dataset_id and v.source = r.name)),
cg as (select dataset_id, target, string_agg(name, ',' order by pos) cn, count(*) n from cand group by all),
og as (select dataset_id, target, string_agg(source, ',' order by seq) os from vov group by all),
pres as (select distinct dataset_id, name target from cols where name in ({canon})),
cmap as (
 select cg.dataset_id, cg.target,
  case when og.os is not null then og.os || ',' || cg.cn when p.target is not null then cg.target || ',' || cg.cn
       else cg.cn end sources,
  case when og.os is not null then 'conflict_override' when p.target is not null then 'conflict_canonical'
       when cg.n = 1 then 'automatic' else 'conflict_multiple' end outcome
 from cg left join og on cg.dataset_id = og.dataset_id and cg.target = og.target
  left join pres p on cg.dataset_id = p.dataset_id and cg.target = p.target
 union all select dataset_id, target, source, 'override' from vov),
mcols as (
 select c.dataset_id, c.pos, coalesce(m.target, c.name) name, c.non_null, c.name source from cols c
 left join (select * from cmap where outcome in ('override', 'automatic')) m
  on c.dataset_id = m.dataset_id and c.name = m.sources),
sig(domain, reg_order, base, step, signal, size, field) as (values {sig}),
hits as (select m.dataset_id, s.domain, s.reg_order, s.base, s.step, s.signal, s.size, count(distinct s.field) n
 from (select distinct dataset_id, name from mcols) m join sig s on m.name = s.field group by all),
dscore as (select dataset_id, domain, reg_order, count(*) matched_signals,
  cast(least(cast(1 as decimal(6,2)), cast(any_value(base) as decimal(6,2))
   + cast(any_value(step) as decimal(6,2)) * (count(*) - 1)) as double) score
 from hits where n = size group by dataset_id, domain, reg_order),
best as (select * from (select *, row_number() over (partition by dataset_id order by score desc, reg_order) rn
 from dscore where score > 0.5) where rn = 1),
choice as (select t.dataset_id, coalesce(b.domain, 'generic') domain, coalesce(b.score, 0.0) score
 from (select distinct dataset_id from mcols) t left join best b on t.dataset_id = b.dataset_id),
caps(domain, cap_order, capability_id, capability_name, all_of, any_of) as (values {caps}),
avail as (select dataset_id, list(distinct name) filter (where non_null > 0) av from mcols group by dataset_id)
"""


def _catalog_sql() -> dict[str, str]:
    from sheetwise.plans.vocab import DOMAINS, GENERIC, MISSING_REASON
    b = _catalog_base()
    q: dict[str, str] = {}
    q["normalize_header"] = b + "select distinct name, key from res"
    q["ambiguous_alias"] = b + """select r.dataset_id, r.pos, r.name, r.target from res r
 join kidx k on r.key = k.key where k.nt > 1"""
    q["canonical_mapping"] = b + "select * from cmap"
    q["unmapped_columns"] = b + f"""select dataset_id, pos, name from res r
 where r.target is null and r.name not in (select target from al)
 and not exists (select 1 from vov v where v.dataset_id = r.dataset_id and v.source = r.name)"""
    q["override_errors"] = b + "select dataset_id, seq, source, target, error_code from oerr where error_code is not null"
    q["domain_score"] = b + "select dataset_id, domain, reg_order, matched_signals, score from dscore"
    names = " ".join(f"when {_q(d)} then {_q(n)}" for d, n, *_ in DOMAINS)
    q["domain_choice"] = b + f"""select dataset_id, domain, coalesce(case domain {names} end, {_q(GENERIC[1])}) domain_name,
 score from choice"""
    miss = "list_filter({}, lambda f: not list_contains(av, f))"
    q["capability_plan"] = b + f""", pl as (
 select ch.dataset_id, ch.domain, c.cap_order, c.capability_id, c.capability_name, c.all_of, c.any_of,
  {miss.format('c.all_of')} am,
  list_transform(c.any_of, lambda alt: list_filter(alt, lambda f: not list_contains(av, f))) alts
 from choice ch join caps c on ch.domain = c.domain join avail a on ch.dataset_id = a.dataset_id),
pl2 as (select *, coalesce(list_position(list_transform(alts, lambda m: len(m) = 0), true), 0) fo,
  list_min(list_transform(alts, lambda m, i: {{'n': len(m), 'i': i}})) fw from pl),
pl3 as (select *, list_concat(am, case when len(any_of) = 0 or fo > 0 then []::varchar[] else alts[fw.i] end) miss,
  case when len(any_of) > 0 and fo > 0 then any_of[fo] else []::varchar[] end malt from pl2)
 select dataset_id, domain, cap_order, capability_id, capability_name, len(miss) = 0 supported,
 array_to_string(miss, ',') missing_fields,
 case when len(miss) = 0 then array_to_string(list_concat(all_of, malt), ',') end matched_fields,
 case when len(miss) > 0 then {_q(MISSING_REASON)} end reason from pl3"""
    q["clean_headers"] = b + """, ch(key, target) as (values """ + ", ".join(
        f"({_q(''.join(a.strip().lower().split()))}, {_q(t)})"
        for t, al in __import__('sheetwise.operators.cleaning', fromlist=['x']).CLEAN_HEADER_ALIASES.items() for a in al
    ) + """)
 select c.dataset_id, c.pos, c.name, coalesce(ch.target, trim(c.name)) clean_name from cols c
 left join ch on lower(regexp_replace(trim(c.name), '\\s', '', 'g')) = ch.key"""
    q["latest_run"] = """select o_custkey dataset_id, max(o_orderkey) run_id,
 arg_max(concat('cleaned/', cast(o_custkey as varchar), '/', cast(o_orderkey as varchar), '.parquet'), o_orderkey)
 cleaned_storage_path from orders group by o_custkey"""
    q["datasets_by_owner"] = b + """select dataset_id, owner_id, file_name, kind,
 row_number() over (partition by owner_id order by dataset_id desc) position from ds"""
    q["audit_page"] = """select id, user_id, action, total, cast(ceil(total / 20.0) as bigint) total_pages from (
 select event_id id, user_id, event_type action, count(*) over () total from events)
 order by id desc limit 20 offset 40"""
    q["override_map"] = b + """select dataset_id, string_agg(source || '=' || target, ',' order by source) overrides
 from vov group by dataset_id"""
    q["mapping_preview"] = b + """, un as (select dataset_id, pos, name from res r
 where r.target is null and r.name not in (select target from al)
 and not exists (select 1 from vov v where v.dataset_id = r.dataset_id and v.source = r.name))
 select t.dataset_id, o.overrides, m.mappings, coalesce(c.conflicts, 0) conflicts, u.unmapped
 from (select distinct dataset_id from cols) t
 left join (select dataset_id, string_agg(source || '=' || target, ',' order by source) overrides from vov
            group by dataset_id) o on t.dataset_id = o.dataset_id
 left join (select dataset_id, string_agg(sources || '->' || target, ',' order by sources || '->' || target) mappings
            from cmap where outcome in ('override', 'automatic') group by dataset_id) m on t.dataset_id = m.dataset_id
 left join (select dataset_id, count(*) conflicts from cmap where outcome like 'conflict%' group by dataset_id) c
  on t.dataset_id = c.dataset_id
 left join (select dataset_id, string_agg(name, ',' order by pos) unmapped from un group by dataset_id) u
  on t.dataset_id = u.dataset_id"""
    return q


def _report_sql(base: dict[str, str], exam_order: str = "name") -> dict[str, str]:
    """Findings and report tables, composed from the metric SQL above."""
    from sheetwise.operators.findings import QUALITY_COUNTERS, UNNAMED_PRODUCT
    from sheetwise.operators.report import (
        BASIS_LABEL, BASIS_TEXT, INVENTORY_OVERVIEW_LABELS, KPI_ORDER, ORDER_OVERVIEW_LABELS, ORDER_SECTIONS,
        QUALITY_LABELS, QUALITY_WARNINGS, STUDENT_OVERVIEW_LABELS,
    )

    def sub(key: str) -> str:
        return f"({base[key]})"

    def F(code, subject="null", value="null", ref="null", ref_value="null"):
        return (f"select cast({code} as varchar) code, cast({subject} as varchar) subject, cast({value} as double) value,"
                f" cast({ref} as varchar) reference, cast({ref_value} as double) reference_value")

    def ends(key: str, order: str, value: str, name: str = "name") -> str:
        return (f"(select {name} nm, {value} val, row_number() over (order by {order}) r, count(*) over () n "
                f"from {sub(key)})")

    def trend(key: str, prefix: str, value: str = "value", order: str = "name") -> str:
        e = ends(key, order, value)
        ch = M("l.val - f.val")
        return (F(f"'{prefix}' || case when {ch} > 0 then '_up' when {ch} < 0 then '_down' else '_flat' end",
                  "f.nm", f"abs({ch})", "l.nm") + f" from {e} f, {e} l where f.r = 1 and l.r = l.n and f.n >= 2")

    q: dict[str, str] = {}
    quality = " union all ".join(F("'data_quality'", f"'{c}'", c) + f" from {sub('data_quality')} where {c} > 0"
                                 for c in QUALITY_COUNTERS)
    re_ = ends("region_sales", "-coalesce(region_sales, 0), name", "region_sales")
    q["order_findings"] = " union all ".join([
        F("'low_target_completion'", "null", "completion_rate", "null", "80.0")
        + f" from {sub('target_completion')} where completion_rate < 80",
        F("'region_gap'", "f.nm", "f.val", "l.nm", "l.val")
        + f" from {re_} f, {re_} l where f.r = 1 and l.r = l.n and f.n >= 2 and f.val is not null and l.val is not null",
        F("'refund_orders'", "null", "refund_order_count") + f" from {sub('status_summary')} where refund_order_count > 0",
        quality, trend("daily_sales", "sales_trend")])
    perf = sub("region_performance")
    rk = sub("region_ranking")
    q["sales_findings"] = " union all ".join([
        F("'low_target_completion'", "null", "completion_rate", "null", "80.0")
        + f" from {sub('target_completion')} where completion_rate < 80",
        F("'sales_decline'", "null", "abs(growth_rate)") + f" from {sub('growth_rate')} where growth_rate < 0",
        F("'low_completion_regions'", "string_agg(name, '、' order by -coalesce(sales_amount, 0), name)", "count(*)",
          "null", "80.0") + f" from {perf} where completion_rate < 80 having count(*) > 0",
        F("'region_imbalance'", "h.name", "h.value", "l.name", "l.value")
        + f" from {rk} h, {rk} l where h.is_highest and l.is_lowest and h.value > 0 and h.value >= l.value * 2",
        F("'high_volatility'", "null", "coefficient_of_variation", "null", "30.0")
        + f" from {sub('sales_volatility')} where coefficient_of_variation >= 30"
        + f" and (select count(*) from {sub('sales_summary')}) > 0"])
    parts = []
    for code, key in (("subject_gap", "subject_score"), ("class_gap", "class_score")):
        e = ends(key, "-coalesce(average, 0), name", "average")
        parts.append(F(f"'{code}'", "f.nm", "f.val", "l.nm", "l.val")
                     + f" from {e} f, {e} l where f.r = 1 and l.r = l.n and f.nm <> l.nm")
    st = (f"(select coalesce(student_name, student_id) nm, average val, "
          f"row_number() over (order by -average, student_id) r from {sub('student_rollup')})")
    parts.append(F("'top_student'", "nm", "val") + f" from {st} where r = 1")
    parts.append(trend("exam_trend", "exam_trend", "average", exam_order))
    q["score_findings"] = " union all ".join(parts)
    low = sub("low_stock")
    first5 = (f"(select coalesce(product_name, product_id, '{UNNAMED_PRODUCT}') label, "
              f"row_number() over (order by -shortage, coalesce(product_id, product_name, '')) r from {low})")
    wh = ends("warehouse_stock", "-coalesce(value, 0), name", "value")
    q["inventory_findings"] = " union all ".join([
        F("'low_stock'", f"(select string_agg(label, '、' order by r) from {first5} where r <= 5)", "count(*)")
        + f" from {low} having count(*) > 0",
        trend("inventory_trend", "stock_trend"),
        F("'leading_warehouse'", "nm", "val") + f" from {wh} where r = 1"])

    def metric_rows(key: str, labels, section: str = "overview", start: int = 0) -> str:
        return " union all ".join(
            f"select '{section}' section, '{section}' row_key, {i + start} col_no, '{label}' header, "
            f"cast(null as varchar) value_text, cast({k} as double) value_num from {sub(key)} where {k} is not null"
            for i, (k, label) in enumerate(labels))
    q["report_overview"] = metric_rows("order_overview", [(k, lab) for k, lab in ORDER_OVERVIEW_LABELS]) + (
        f" union all select 'overview', 'overview', {len(ORDER_OVERVIEW_LABELS)}, '{BASIS_LABEL}', '{BASIS_TEXT}', null")
    q["student_overview"] = (metric_rows("student_count", [("student_count", "学生数量")]) + " union all "
                             + metric_rows("score_summary", [(k, lab) for k, lab in STUDENT_OVERVIEW_LABELS]))
    q["inventory_overview"] = " union all ".join([
        metric_rows("inventory_count", [("inventory_count", "商品数量")]),
        metric_rows("stock_summary", [(k, lab) for k, lab in INVENTORY_OVERVIEW_LABELS]),
        metric_rows("inventory_value", [("total", "库存价值总计"), ("average", "平均库存价值")])])
    text_cols = {"name", "category", "customer_id", "student_id", "student_name", "product_id", "product_name"}

    def long(src: str, section: str, key: str, cols) -> str:
        return " union all ".join(
            f"select '{section}' section, cast({key} as varchar) row_key, {i} col_no, '{h}' header, "
            + (f"cast({c} as varchar) value_text, cast(null as double) value_num" if c in text_cols else
               f"cast(null as varchar) value_text, cast({c} as double) value_num") + f" from {src}"
            for i, (h, c) in enumerate(cols))
    disc_cols = ["valid_discount_count", "discounted_order_count", "discounted_order_rate", "average_discount",
                 "average_discounted_order_value", "estimated_discount_amount"]
    dq_cols = ["row_count", "duplicate_row_count", "duplicate_order_id_count", "invalid_date_count",
               "invalid_unit_price_count", "zero_unit_price_count", "invalid_quantity_count", "zero_quantity_count",
               "invalid_discount_count", "invalid_age_count", "invalid_status_count", "unverified_amount_count",
               "invalid_amount_count", "phone_present_count", "phone_missing_count", "phone_valid_count",
               "phone_invalid_count", "email_present_count", "email_missing_count", "email_valid_count",
               "email_invalid_count", "contact_complete_count", "contact_complete_rate", "amount_mismatch_count",
               "amount_comparable_count", "amount_mismatch_rate", "unverified_order_count", "unverified_amount_total"]
    q["report_order_tables"] = " union all ".join(
        [long(sub(key), title, k, cols) for key, title, k, cols in ORDER_SECTIONS]
        + [long(sub("discount_analysis"), "折扣分析", "'1'", [(c, c) for c in disc_cols]),
           long(sub("data_quality"), "数据质量检查", "'1'", [(QUALITY_LABELS.get(c, c), c) for c in dq_cols])]
        + ["select '数据质量检查' section, '1' row_key, 28 col_no, 'missing_value_summary' header, "
           "string_agg(column_name || ':' || missing_count, '；' order by list_position(['order_id', 'customer_id', 'customer_name', 'product', "
           "'category', 'region', 'date', 'unit_price', 'quantity', 'discount', 'sales_amount', 'status', 'payment_method', 'target_amount', "
           "'gender', 'age', 'phone', 'email'], column_name)) value_text, cast(null as double) value_num "
           f"from {sub('missing_summary')} having count(*) > 0"])
    stats = [("有效成绩数", "count"), ("平均分", "average"), ("最高分", "maximum"), ("最低分", "minimum")]
    q["report_student_tables"] = " union all ".join([
        long(sub("subject_score"), "学科成绩统计", "name", [("学科", "name")] + stats),
        long(sub("class_score"), "班级成绩统计", "name", [("班级", "name")] + stats),
        long(sub("student_rollup"), "学生成绩汇总", "student_id",
             [("学生编号", "student_id"), ("学生姓名", "student_name"), ("有效成绩数", "score_count"),
              ("平均分", "average"), ("最高分", "maximum"), ("最低分", "minimum")]),
        long(sub("exam_trend"), "考试趋势", "name", [("考试", "name"), ("平均分", "average"), ("有效成绩数", "count")])])
    lowk = f"(select *, concat_ws('|', coalesce(product_id, ''), coalesce(product_name, '')) k from {low})"
    q["report_inventory_tables"] = " union all ".join([
        long(lowk, "低库存明细", "k", [("商品编号", "product_id"), ("商品名称", "product_name"),
                                    ("当前库存", "stock_quantity"), ("安全库存", "safety_stock"), ("库存缺口", "shortage")]),
        long(sub("category_stock"), "分类库存统计", "name", [("分类", "name"), ("库存数量", "value")]),
        long(sub("warehouse_stock"), "仓库库存统计", "name", [("仓库", "name"), ("库存数量", "value")]),
        long(sub("supplier_stock"), "供应商库存统计", "name", [("供应商", "name"), ("库存数量", "value")]),
        long(sub("inventory_flow"), "库存流动统计", "'1'", [("入库总量", "total_inbound"), ("出库总量", "total_outbound"),
                                                        ("净变化", "net_change")]),
        long(sub("inventory_trend"), "库存趋势", "name", [("日期", "name"), ("库存总量", "value")])])
    q["report_skipped"] = f"""select dataset_id, capability_id, capability_name || '：' ||
 case when length(coalesce(missing_fields, '')) > 0 then '缺少 ' || replace(missing_fields, ',', '、') || ' 字段'
 else coalesce(reason, '未生成可用计算结果') end notice from {sub('capability_plan')} where not supported"""
    q["region_chart_series"] = f"select rank, name, value from {rk} where in_top10"
    kpi = " union all ".join([
        metric_rows("order_overview", [(k, lab) for k, lab, _ in KPI_ORDER], "kpi"),
        metric_rows("customer_summary", [("unique_customer_count", "客户数量"), ("repeat_customer_rate", "复购率")], "kpi"),
        metric_rows("status_summary", [("refund_rate", "退款率")], "kpi")])
    warn = " union all ".join(
        f"select 'quality_warning' section, 'quality' row_key, {i} col_no, '{lab}' header, "
        f"cast(null as varchar) value_text, cast({k} as double) value_num from {sub('data_quality')} where {k} > 0"
        for i, (k, lab) in enumerate(QUALITY_WARNINGS))
    q["kpi_rows"] = kpi + " union all " + warn
    checks = {
        "order_count": f"(select order_count is not null from {sub('order_overview')})",
        "product_quantity": f"(select count(*) > 0 from {sub('product_quantity')})",
        "sales_total": f"(select verified_sales_total is not null from {sub('order_overview')})",
        "product_sales": f"(select count(*) > 0 from {sub('product_sales')})",
        "category_analysis": f"(select count(*) > 0 from {sub('category_sales')})",
        "region_sales": f"(select count(*) > 0 from {sub('region_sales')})",
        "sales_trend": f"(select count(*) > 0 from {sub('daily_sales')})",
        "target_completion": f"(select completion_rate is not null from {sub('target_completion')})",
        "customer_analysis": "true", "status_analysis": f"(select count(*) > 0 from {sub('status_analysis')})",
        "payment_method_analysis": f"(select count(*) > 0 from {sub('payment_analysis')})",
        "discount_analysis": "true", "demographic_analysis": "true", "data_quality_analysis": "true",
    }
    from sheetwise.plans.vocab import CAPABILITIES
    q["analysis_coverage"] = "select capability_id, capability_name, covered, case when not covered then '' end " \
        "missing_fields, case when not covered then '未产生可用计算结果' end reason from (" + " union all ".join(
            f"select '{cid}' capability_id, '{name}' capability_name, {checks.get(cid, 'false')} covered"
            for cid, name, _a, _b in CAPABILITIES["order"]) + ")"
    return q


# Sort keys of the result lists, as SQL.
LIST_ORDERS = {
    "product_sales": "coalesce(sales_amount, 0) desc, name", "category_sales": "coalesce(sales_amount, 0) desc, category",
    "region_sales": "coalesce(region_sales, 0) desc, name", "region_performance": "coalesce(sales_amount, 0) desc, name",
    "product_quantity": "value desc, name", "status_analysis": "order_count desc, name",
    "payment_analysis": "coalesce(sales_amount, 0) desc, name", "customer_rollup": "coalesce(sales_amount, 0) desc, customer_id",
    "top_customers": "coalesce(sales_amount, 0) desc, customer_id", "gender_profile": "seen", "age_profile": "seen",
    "daily_sales": "name", "monthly_sales": "name", "monthly_orders": "name",
    "subject_score": "average desc, name", "class_score": "average desc, name", "student_rollup": "average desc, student_id",
    "exam_trend": "name", "exam_names": "seen", "low_stock": "shortage desc, coalesce(product_id, product_name, ''), pos",
    "category_stock": "value desc, name", "warehouse_stock": "value desc, name", "supplier_stock": "value desc, name",
    "inventory_trend": "name",
}


def _ranked(key: str, sql: str) -> str:
    hidden = {"low_stock": "pos", "gender_profile": "seen", "age_profile": "seen", "exam_names": "seen"}.get(key)
    cols = f"l.* exclude ({hidden})" if hidden else "l.*"
    return f"select cast(row_number() over (order by {LIST_ORDERS[key]}) as bigint) rank, {cols} from ({sql}) l"


def _upload_reports(base: dict[str, str]) -> dict[str, str]:
    """Findings and KPIs over the SQL of an upload without class names and exam dates."""
    unlisted = "select name, count, average, maximum, minimum from (select '' name, 0 count, 0 average, 0 maximum, 0 minimum) where false"
    exams = f"select name, average, count, seen from ({base['exam_names']})"
    return _report_sql({**base, "class_score": unlisted, "exam_trend": exams}, exam_order="seen")


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(_catalog_sql())
    out.update(_orders_sql())
    out.update(_inventory_sql())
    out.update(_scores_sql())
    out.update(_report_sql(dict(out)))
    out.update(outcome_sql(dict(out), LIST_ORDERS, _upload_reports))
    out.update({key: _ranked(key, out[key]) for key in LIST_ORDERS})
    out.update(_profile_sql())
    out.update(_cleaning_sql())
    # a table uploaded as text under other headers gives what the typed columns give
    for key, same in (("uploaded_product_sales", "product_sales"), ("uploaded_region_sales", "region_sales"),
                      ("uploaded_daily_sales", "daily_sales"), ("uploaded_customers", "customer_rollup"),
                      ("uploaded_subject_score", "subject_score"), ("uploaded_category_stock", "category_stock")):
        out[key] = out[same]
    out["csv_scan"] = """select cast(c_custkey as varchar) c_custkey, '客户' || c_name name_cn, c_name,
 cast(c_nationkey as varchar) c_nationkey, c_mktsegment from customer"""
    out["csv_headers"] = """select cast(c_custkey as varchar) a, c_name "a.1", c_mktsegment "Unnamed: 2",
 cast(c_nationkey as varchar) "two lines" from customer"""
    out["sinks_written_twice"] = """select 'datasets' sink, 1 "rows", cast(7 as bigint) key_total
 union all select 'dataset_columns', 3, (select count(distinct event_id) + count(distinct user_id) + count(distinct event_type) from events)
 union all select 'audit', count(*), cast(sum(event_id) as bigint) from events
 union all select 'runs', count(*), cast(sum(o_orderkey) as bigint) from orders where o_orderkey % 500 = 0"""
    out["xlsx_dates"] = """with o as (select cast(o_orderkey as varchar) o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') o_orderdate, o_orderstatus,
  o_orderkey k from orders where o_orderkey % 10 = 0)
 select o_orderkey, o_orderdate, null o_orderstatus from o union all select o_orderkey, o_orderdate, o_orderstatus from o where k % 3 = 0"""
    out["xlsx_batch_scan"] = """select cast(s_suppkey as varchar) s_suppkey, s_name,
 cast(s_nationkey as varchar) s_nationkey from supplier"""
    return out
