"""Column-level helpers: text, numbers, money and percentages (STR-1, NUM-1..3).

All helpers return JVM-side ``Column`` expressions, so they stay inside
whole-stage codegen.  They take the DataFrame as well as the column name
because the reference treats an *absent* column as "all missing", and the
right coercion depends on the column's input type (text from a CSV file,
or typed values from Parquet).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Exact decimal type used for money before rounding.  Products of the fixed
# input types (DECIMAL(12,2) x DECIMAL(12,2) x DECIMAL(6,4)) have scale 8, so
# nothing is lost; doubles are brought to the same scale before rounding so that
# ties are broken the same way (half up) on every engine.
MONEY_WORK = "decimal(38,8)"

# The characters Python's str.strip() removes (str.isspace()),
# many of which Spark's trim() keeps (ideographic space U+3000, no-break space...).
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
              "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
              "\u2028\u2029\u202f\u205f\u3000")
# The same set as a regular-expression class.
_WS = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]"

# Numbers accepted as text: optional sign, digits with an optional fraction,
# optional exponent, or infinity.  Spark would also take "1d", "1f" and "nan".
NUMBER_TEXT = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def strip(c: Column) -> Column:
    """Remove leading/trailing Unicode whitespace (Python ``str.strip``), no regex."""
    return F.btrim(c, F.lit(WHITESPACE))


def clean_text(df: DataFrame, name: str) -> Column:
    """STR-1: value as text, stripped, blank -> NULL; absent column -> NULL."""
    if not has(df, name):
        return F.lit(None).cast("string")
    return F.nullif(strip(F.col(name).cast("string")), F.lit(""))


def non_empty(df: DataFrame, name: str) -> Column:
    """PRD-2: present and not blank after stripping."""
    if not has(df, name):
        return F.lit(False)
    return F.col(name).isNotNull() & (F.length(strip(F.col(name).cast("string"))) > 0)


def parse_number(c: Column, dtype: T.DataType) -> Column:
    """NUM-1 on one column of a known type; unparsable -> NULL, NaN -> NULL."""
    if isinstance(dtype, (T.DecimalType, T.IntegralType)):
        return c
    if isinstance(dtype, T.BooleanType):
        return c.cast("int")
    if isinstance(dtype, T.FractionalType):
        return F.when(~F.isnan(c), c)
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def to_number(df: DataFrame, name: str) -> Column:
    """NUM-1: numeric coercion of a column; absent column -> NULL."""
    if not has(df, name):
        return F.lit(None).cast("double")
    return parse_number(F.col(name), df.schema[name].dataType)


def money(c: Column) -> Column:
    """NUM-2: round half up to 2 decimals on an exact decimal, as DOUBLE.  A number beyond the
    working decimal (and infinity) has no cents and is kept as it is."""
    return F.coalesce(F.round(c.try_cast(MONEY_WORK), 2).cast("double"), c.cast("double"))


def pct(part: Column, whole: Column) -> Column:
    """NUM-3: round(part / whole * 100, 2); NULL when whole is 0 or NULL."""
    ratio = F.when(whole.isNotNull() & (whole != 0), part.cast("double") / whole.cast("double") * 100)
    return money(ratio)


def hybrid_order_count(order_id: Column) -> Column:
    """AGG-0: distinct non-null order ids, or the row count when a group has none."""
    return F.when(F.count(order_id) > 0, F.count_distinct(order_id)).otherwise(F.count(F.lit(1)))
