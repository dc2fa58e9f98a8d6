"""Column profiling of any table (PRF-1 .. PRF-7, FND-5 input).

Every profile is *one* aggregate over the table (all columns at once), then
``unpivot`` turns the single wide row into one row per column.  Exact distinct
counts can be switched to ``approx_count_distinct`` for very wide or very
large tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.functions.columns import NUMBER_TEXT

# Text spellings a CSV reader takes as booleans.
BOOL_TEXT = ("True", "False", "TRUE", "FALSE", "true", "false")


def _pandas_dtype(dtype: T.DataType) -> str:
    """dtype name the reference reports for a column read from a file."""
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.IntegralType):
        return "int64"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "float64"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime64[ns]"
    return "object"


def _label_of_type(dtype: T.DataType) -> str | None:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return None


def _positions(df: DataFrame) -> Column:
    return F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])


def _long(df: DataFrame, wide: DataFrame, metrics: list[str]) -> DataFrame:
    """Wide single row with ``{metric}__{i}`` columns -> one row per input column."""
    structs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"),
                        *[F.col(f"{m}__{i}").alias(m) for m in metrics]) for i, c in enumerate(df.columns)]
    return wide.select(F.explode(F.array(*structs)).alias("p")).select("p.*")


def generic_profile(df: DataFrame) -> DataFrame:
    """PRF-4: dtype, non-null and null count per column (int with NULLs reads as float64)."""
    aggs = []
    for i, c in enumerate(df.columns):
        aggs += [F.count(F.col(c)).alias(f"non_null_count__{i}"), F.count_if(F.col(c).isNull()).alias(f"null_count__{i}")]
    out = _long(df, df.agg(*aggs), ["non_null_count", "null_count"])
    base = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(_pandas_dtype(df.schema[c].dataType)))])
    integral = [c for c in df.columns if isinstance(df.schema[c].dataType, T.IntegralType)]
    boolean = [c for c in df.columns if isinstance(df.schema[c].dataType, T.BooleanType)]
    dtype = (F.when(F.col("name").isin(*integral) & (F.col("null_count") > 0), "float64")
             .when(F.col("name").isin(*boolean) & (F.col("null_count") > 0), "object")
             .otherwise(base[F.col("name")]))
    return out.select("position", "name", dtype.alias("dtype"), "non_null_count", "null_count")


def missing_rate(df: DataFrame) -> DataFrame:
    """PRF-5: missing count and rate (% of rows, 2 decimals; 0.0 for an empty table)."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"missing_count__{i}"))
    wide = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"missing_count__{i}").alias("missing_count"))
               for i, c in enumerate(df.columns)]
    long = wide.select("rows", F.explode(F.array(*structs)).alias("p")).select("rows", "p.*")
    rate = F.when(F.col("rows") > 0, F.round((F.col("missing_count") / F.col("rows") * 100).cast("decimal(38,8)"), 2))
    return long.select("column_name", "missing_count",
                       F.coalesce(rate.cast("double"), F.lit(0.0)).alias("missing_rate"))


def available_fields(df: DataFrame) -> DataFrame:
    """PRF-6: columns with at least one non-missing value (an empty string counts)."""
    p = generic_profile(df)
    return p.where(F.col("non_null_count") > 0).select("position", "name")


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """PRF-2 (+ PRF-1 labels of typed columns): position, label, missing, distinct."""
    aggs = []
    for i, c in enumerate(df.columns):
        distinct = F.approx_count_distinct(c) if approx else F.count_distinct(c)
        aggs += [F.count_if(F.col(c).isNull()).alias(f"missing_count__{i}"), distinct.alias(f"unique_count__{i}")]
    out = _long(df, df.agg(*aggs), ["missing_count", "unique_count"])
    labels = F.create_map(*[x for c in df.columns
                            for x in (F.lit(c), F.lit(_label_of_type(df.schema[c].dataType) or "text"))])
    return out.select("position", "name", labels[F.col("name")].alias("data_type"), "missing_count", "unique_count")


def infer_types(df: DataFrame) -> DataFrame:
    """PRF-1 on text columns (a CSV read as strings): boolean -> number -> datetime -> text.

    A column is boolean when every row holds a boolean word, number when every
    present value is a number (an all-missing column is numeric, as in the
    reference's reader); typed columns keep the label of their type.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        t = F.col(c).cast("string")
        aggs += [F.count(t).alias(f"present__{i}"), F.count_if(t.isin(*BOOL_TEXT)).alias(f"bool__{i}"),
                 F.count_if(F.trim(t).rlike(NUMBER_TEXT)).alias(f"num__{i}")]
    wide = df.agg(*aggs)
    structs = []
    for i, c in enumerate(df.columns):
        typed = _label_of_type(df.schema[c].dataType)
        if typed:
            label = F.lit(typed)
        else:
            present, b, n, rows = (F.col(f"present__{i}"), F.col(f"bool__{i}"), F.col(f"num__{i}"), F.col("rows"))
            label = (F.when((b == rows) & (rows > 0), "boolean").when(n == present, "number").otherwise("text"))
        structs.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), label.alias("data_type")))
    return wide.select(F.explode(F.array(*structs)).alias("p")).select("p.*")


def table_shape(df: DataFrame) -> DataFrame:
    """PRF-3: row and column count."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).cast("long").alias("column_count"))


def generic_findings(df: DataFrame) -> DataFrame:
    """FND-5: one finding per column with missing values."""
    m = missing_rate(df).where(F.col("missing_count") > 0)
    return m.select(F.lit("missing_values").alias("code"), F.col("column_name").alias("subject"),
                    F.col("missing_count").cast("double").alias("value"), F.col("missing_rate"))
