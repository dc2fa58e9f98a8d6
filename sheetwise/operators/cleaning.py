"""Cleaning of an uploaded table (MAP-1, MAP-2, SRC-3, FLT-1, FLT-2, PRJ-1, PRJ-2, AGG-1..3).

Plan shape: header aliasing is a projection (names are driver-side metadata);
missing-value tokens, dropping empty rows, dropping duplicates and counting
both are **one** aggregate over all columns that keeps the number of copies of
each distinct row.  Value standardisation and every counter of the cleaning
summary are computed from that aggregate, so the upload is read once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.columns import parse_number
from sheetwise.functions.normalize import day_key, order_date_text, parse_date_text
from pyspark.sql import types as T

COPIES = "_copies"
POS = "_pos"

# ---------------------------------------------------------------------------
# Fixed values.
# Text a CSV reader takes as missing (the pandas reader defaults).
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Clean-time header aliases (key: stripped, lower-cased, all whitespace removed).
CLEAN_HEADER_ALIASES = {
    "date": ("date", "日期", "日期时间", "交易日期"),
    "region": ("region", "区域", "大区"),
    "product": ("product", "产品", "商品"),
    "sales_amount": ("sales_amount", "sales", "销售额", "销售金额"),
    "target_amount": ("target_amount", "target", "目标额", "目标金额"),
    "customer_count": ("customer_count", "customers", "客户数"),
}
CLEAN_NUMERIC = ("sales_amount", "target_amount", "customer_count")
# Characters removed from numbers before parsing.
NUMBER_NOISE = ",¥"
# End of fixed values.
# ---------------------------------------------------------------------------


def header_key(name: str) -> str:
    return "".join(name.strip().lower().split())


def clean_header_names(columns: list[str]) -> list[str]:
    """MAP-1 for one table: aliased name or the stripped header."""
    index = {header_key(a): target for target, aliases in CLEAN_HEADER_ALIASES.items() for a in aliases}
    return [index.get(header_key(c), c.strip()) for c in columns]


def header_key_col(name: Column) -> Column:
    """MAP-1 key as a column expression (for a catalogue of headers)."""
    return F.lower(F.regexp_replace(F.trim(name), r"\s", ""))


def clean_header_lookup(spark) -> DataFrame:
    """(key, target) of the clean-time aliases: vocabulary-sized, safe to broadcast."""
    rows = [(header_key(a), t) for t, aliases in CLEAN_HEADER_ALIASES.items() for a in aliases]
    return spark.createDataFrame(rows, "key string, target string")


def with_missing_tokens(df: DataFrame) -> DataFrame:
    """SRC-3: reader missing-value tokens -> NULL in every text column (one projection)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(~c.isin(*MISSING_TOKENS), c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def standardize_headers(df: DataFrame) -> DataFrame:
    """MAP-1 + MAP-2: rename by alias; headers that collide are merged left to right
    (first non-null value), at the position of the first one."""
    names = clean_header_names(df.columns)
    order: list[str] = []
    sources: dict[str, list[int]] = {}
    for i, n in enumerate(names):
        if n not in sources:
            order.append(n)
            sources[n] = []
        sources[n].append(i)
    cols = []
    for n in order:
        idx = sources[n]
        exprs = [df[df.columns[i]] for i in idx]
        if len(exprs) > 1:
            common = exprs[0].cast("string") if len({df.schema.fields[i].dataType for i in idx}) > 1 else None
            exprs = [e.cast("string") for e in exprs] if common is not None else exprs
            cols.append(F.coalesce(*exprs).alias(n))
        else:
            cols.append(exprs[0].alias(n))
    return df.select(*cols)


def _standard_value(df: DataFrame, name: str) -> tuple[Column, Column | None]:
    """(standardised value, parsed-or-null used for the invalid count)."""
    c = F.col(f"`{name}`")
    if name == "date":
        parsed = parse_date_text(order_date_text(c.cast("string")))
        return day_key(parsed), parsed
    if name in CLEAN_NUMERIC:
        text = F.trim(F.translate(c.cast("string"), NUMBER_NOISE, ""))
        parsed = parse_number(text, T.StringType())
        return parsed, parsed
    return c, None


def clean_groups(df: DataFrame, tasks: int | None = None, lot: str | None = None) -> DataFrame:
    """Distinct rows of the aliased table with copies, empty flag and parsed values.

    A ``_pos`` column (row position from ingest) is not part of the row: the first
    position of the copies is kept.  With ``tasks`` the rows are dealt into so many ranges
    of their standardised cells: like rows lie beside each other, and rows that are equal once
    standardised lie in one task, so a later grouping by all cells moves nothing.
    ``lot`` names a column that is no cell, the same in rows that are equal once standardised: where
    rows lie by it already (a join left them so) they stay there.  It is kept as the last column."""
    std = standardize_headers(with_missing_tokens(df))
    cols = [c for c in std.columns if c not in (POS, lot)]
    place = [F.min(POS).alias(POS)] if POS in std.columns else []
    values = {c: _standard_value(std, c) for c in cols}
    standard = {}
    if tasks and not lot:
        standard = {c: f"_standard{i}" for i, c in enumerate(cols) if values[c][1] is not None}
        std = std.select("*", *[values[c][0].alias(name) for c, name in standard.items()])
        std = std.repartitionByRange(tasks, *[F.col(f"`{standard.get(c, c)}`") for c in cols])
    lots = [F.col(f"`{lot}`")] if lot else []
    g = std.groupBy(*[F.col(f"`{c}`") for c in [*cols, *standard.values()]], *lots).agg(F.count(F.lit(1)).alias(COPIES), *place)
    empty = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNull() for c in cols])
    out = [F.col(COPIES), empty.alias("_empty"), *(F.col(POS) for _ in place)]
    invalid = []
    for c in cols:
        value, parsed = values[c]
        if c in standard:
            # the parsed value is null where its standard form is
            value = parsed = F.col(standard[c])
        out.append(value.alias(c))
        if parsed is not None:
            invalid.append((F.col(f"`{c}`").isNotNull() & parsed.isNull()).cast("int"))
    inv = reduce(lambda a, b: a + b, invalid) if invalid else F.lit(0)
    return g.select(*out, inv.alias("_invalid"), *lots)


def cleaned(df: DataFrame, tasks: int | None = None, lot: str | None = None) -> DataFrame:
    """The cleaned table: non-empty distinct rows with standardised values."""
    g = clean_groups(df, tasks, lot)
    return g.where(~F.col("_empty")).drop(COPIES, "_empty", "_invalid")


def clean_summary(df: DataFrame) -> DataFrame:
    """AGG-3: original, cleaned, removed empty, removed duplicates, invalid, missing, columns."""
    g = clean_groups(df)
    data_cols = [c for c in g.columns if c not in (COPIES, POS, "_empty", "_invalid")]
    kept = ~F.col("_empty")
    missing = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("long") for c in data_cols])
    return g.agg(
        F.sum(COPIES).alias("original_row_count"),
        F.count_if(kept).alias("cleaned_row_count"),
        F.coalesce(F.sum(F.when(~kept, F.col(COPIES))), F.lit(0)).alias("removed_empty_rows"),
        F.coalesce(F.sum(F.when(kept, F.col(COPIES) - 1)), F.lit(0)).alias("removed_duplicate_rows"),
        F.coalesce(F.sum(F.when(kept, F.col("_invalid"))), F.lit(0)).cast("long").alias("invalid_value_count"),
        F.coalesce(F.sum(F.when(kept, missing)), F.lit(0)).alias("missing_value_count"),
        F.lit(len(data_cols)).cast("long").alias("column_count"),
    )


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """FLT-1: rows left after dropping all-missing rows, and how many were dropped."""
    g = clean_groups(df)
    return g.agg(F.sum(F.when(~F.col("_empty"), F.col(COPIES)).otherwise(0)).alias("row_count"),
                 F.sum(F.when(F.col("_empty"), F.col(COPIES)).otherwise(0)).alias("removed_empty_rows"))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """FLT-2: rows left after dropping exact duplicates (keep first), and how many."""
    g = clean_groups(df).where(~F.col("_empty"))
    return g.agg(F.count(F.lit(1)).alias("row_count"), (F.sum(COPIES) - F.count(F.lit(1))).alias("removed_duplicate_rows"))


def missing_cells(df: DataFrame) -> DataFrame:
    """AGG-2: missing cells of the cleaned table."""
    return clean_summary(df).select("missing_value_count")


def invalid_values(df: DataFrame) -> DataFrame:
    """AGG-1: present but unparsable date / number cells of the cleaned table."""
    return clean_summary(df).select("invalid_value_count")
