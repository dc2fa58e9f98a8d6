"""Value normal forms: status, region, contact checks, order dates (STR-2..5, DAT-1..4)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.functions.columns import _WS, clean_text, has

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's vocabulary for equal results).
# Status words (Chinese and English, compared after strip + casefold) -> code.
STATUS_CODES = {
    "待支付": "pending", "pending": "pending", "待付款": "pending",
    "已支付": "paid", "paid": "paid",
    "已完成": "completed", "completed": "completed", "complete": "completed",
    "已取消": "cancelled", "取消": "cancelled", "cancelled": "cancelled", "canceled": "cancelled",
    "退款中": "refund_in_progress", "refund in progress": "refund_in_progress",
    "已退款": "refunded", "退款": "refunded", "refunded": "refunded",
}
KNOWN_STATUSES = ("pending", "paid", "completed", "cancelled", "refund_in_progress", "refunded")
REFUND_STATUSES = ("refund_in_progress", "refunded")

# City spellings (compared after NFKC, whitespace collapse and casefold) -> city.
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

# E-mail shape: local part, one "@", host labels of at most 63 characters,
# at least one dot in the domain.
EMAIL_PATTERN = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+"
# End of fixed values.
# ---------------------------------------------------------------------------

# Date formats tried in order after the separators were unified (first match wins).
DATE_LADDER = (
    "yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d", "yyyy-M-d'T'H:m:s", "yyyyMMdd",
    "M-d-yyyy", "d-M-yyyy", "MMM d yyyy", "MMM d, yyyy", "d MMM yyyy H:m", "d MMM yyyy",
    "yyyy-M", "yyyy",
)


def _literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def normalize_status(text: Column) -> Column:
    """STR-3: strip + casefold lookup; missing or unknown words -> 'unknown'."""
    return F.coalesce(_literal_map(STATUS_CODES)[F.lower(text)], F.lit("unknown"))


def valid_phone(text: Column) -> Column:
    """STR-4: 7 to 15 digits after one '+' or none, with any blanks, '-', '(' and ')' between."""
    noise = rf"[{_WS}()\-]*+"
    return F.coalesce(text.rlike(rf"^{noise}(?:\+{noise})?(?:\p{{Nd}}{noise}){{7,15}}$"), F.lit(False))


def valid_email(text: Column) -> Column:
    """STR-5: full match of the e-mail shape."""
    return F.coalesce(text.rlike(rf"^(?:{EMAIL_PATTERN})$"), F.lit(False))


# Text NFKC leaves unchanged for sure: ASCII and CJK unified ideographs.
NFKC_STABLE = r"^[\x00-\x7F\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]*$"


@F.pandas_udf(T.StringType())
def _nfkc_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v) if isinstance(v, str) else None)


def nfkc(text: Column) -> Column:
    """NFKC of a text column.  Only values outside ASCII / CJK ideographs reach Python
    (Arrow batches, no shuffle); all other values pass through unchanged."""
    return F.coalesce(_nfkc_udf(F.when(~text.rlike(NFKC_STABLE), text)), text)


def normalize_region(text: Column) -> Column:
    """STR-2 on cleaned text: NFKC, collapse blanks, casefold lookup; unknown kept."""
    normal = F.regexp_replace(F.regexp_replace(nfkc(text), rf"^{_WS}+|{_WS}+$", ""), rf"{_WS}+", " ")
    normal = F.nullif(normal, F.lit(""))
    return F.coalesce(_literal_map(REGION_NAMES)[F.lower(normal)], normal)


def with_region(df: DataFrame, source: str = "region", out: str = "_region") -> DataFrame:
    """Add the normalised region column (a projection, no join, no shuffle)."""
    return df.withColumn(out, normalize_region(clean_text(df, source)))


def order_date_text(c: Column) -> Column:
    """DAT-1 text step: CJK year/month marks and '/' '.' -> '-', day mark -> blank."""
    t = F.translate(c, "年月/.", "----")
    t = F.regexp_replace(t, "日", " ")
    t = F.regexp_replace(t, rf"{_WS}+", " ")
    # digits with '-' and ':' and single blanks between them: no step would change them
    return F.when(c.rlike(r"^[0-9:-]++(?: [0-9:-]++)*+\z"), c).otherwise(F.regexp_replace(t, rf"^{_WS}+|{_WS}+$", ""))


# Shape of the text -> the ladder formats that can parse that shape (in ladder order).
# Every ladder format only accepts its own shape, so testing the shape first and
# parsing once gives the ladder's first-match result without failed parses.
_N, _Y, _MON = r"\d+", r"\d{4,}", r"[A-Za-z]{3}"
DATE_SHAPES = (
    (rf"^{_Y}-{_N}-{_N} {_N}:{_N}:{_N}$", ("yyyy-M-d H:m:s",)),
    (rf"^{_Y}-{_N}-{_N} {_N}:{_N}$", ("yyyy-M-d H:m",)),
    (rf"^{_Y}-{_N}-{_N}$", ("yyyy-M-d",)),
    (rf"^{_Y}-{_N}-{_N}T{_N}:{_N}:{_N}$", ("yyyy-M-d'T'H:m:s",)),
    (r"^\d+$", ("yyyyMMdd", "yyyy")),
    (rf"^{_N}-{_N}-{_Y}$", ("M-d-yyyy", "d-M-yyyy")),
    (rf"^{_MON} {_N} {_Y}$", ("MMM d yyyy",)),
    (rf"^{_MON} {_N}, {_Y}$", ("MMM d, yyyy",)),
    (rf"^{_N} {_MON} {_Y} {_N}:{_N}$", ("d MMM yyyy H:m",)),
    (rf"^{_N} {_MON} {_Y}$", ("d MMM yyyy",)),
    (rf"^{_Y}-{_N}$", ("yyyy-M",)),
)


def parse_date_text(text: Column) -> Column:
    """Mixed-format parse of normalised date text (the DATE_LADDER); unparsable -> NULL."""
    expr = None
    for shape, fmts in DATE_SHAPES:
        parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in fmts]) if len(fmts) > 1 else \
            F.try_to_timestamp(text, F.lit(fmts[0]))
        expr = F.when(text.rlike(shape), parsed) if expr is None else expr.when(text.rlike(shape), parsed)
    return expr.cast("timestamp_ntz")


def parse_dates(df: DataFrame, name: str) -> Column:
    """DAT-1/DAT-2: a column as TIMESTAMP_NTZ; typed dates pass through."""
    if not has(df, name):
        return F.lit(None).cast("timestamp_ntz")
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp_ntz")
    return parse_date_text(order_date_text(F.col(name).cast("string")))


def day_key(ts: Column) -> Column:
    """DAT-4: 'YYYY-MM-DD'."""
    return F.date_format(ts, "yyyy-MM-dd")


def month_key(ts: Column) -> Column:
    """DAT-4: 'YYYY-MM'."""
    return F.date_format(ts, "yyyy-MM")
