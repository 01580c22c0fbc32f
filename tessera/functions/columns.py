"""Scalar column functions (F01-F07) and missing-value conventions.

A value is *missing* when it is NULL or, for floating columns, NaN (the pandas notion the
operators reproduce).  Spark keeps the two apart, so every operator goes through these helpers.
All functions return JVM-side ``Column`` expressions (whole-stage codegen, no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_float(dt: T.DataType) -> bool:
    return isinstance(dt, FLOAT_TYPES)


def is_missing(c, dt: T.DataType | None = None) -> Column:
    """NULL, or NaN for floating types (F05 complement for missing only)."""
    c = col(c)
    if dt is None or is_float(dt):
        if dt is None:
            return c.isNull()
        return c.isNull() | F.isnan(c)
    return c.isNull()


def is_finite(c) -> Column:
    """not NULL, not NaN, not +/-inf.  NULL-safe: always true/false, never NULL."""
    c = col(c).cast("double")
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(INF)), F.lit(False))


def finite_or_null(c) -> Column:
    """The value as double when finite, else NULL (what moments and associations consume)."""
    x = col(c).cast("double")
    return F.when(is_finite(x), x)


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def normalise(df: DataFrame) -> DataFrame:
    """Map NaN to NULL in every floating column so Spark's NULL semantics equal pandas'."""
    cols = []
    for f in df.schema.fields:
        if is_float(f.dataType):
            cols.append(nan_to_null(f.name).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _number_text(c: Column) -> Column:
    """Integer-valued numbers without '.0' (1 and 1.0 are the same key); others as text."""
    x = c.cast("double")
    integral = F.floor(x) == x
    return F.when(integral, x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))


def scalar_key(c, dt: T.DataType) -> Column:
    """canonical JSON-like key: ``["number", "1"]``, ``["string", "a"]``, ``["bool", true]``.

    Non-integral floats use Spark's shortest round-trip text, which equals Python ``repr`` except
    for the exponent spelling of very small/large magnitudes (documented difference).
    """
    c = col(c)
    if isinstance(dt, T.BooleanType):
        return F.when(c.isNotNull(),
                      F.concat(F.lit('["bool", '), F.when(c, F.lit("true")).otherwise(F.lit("false")),
                               F.lit("]")))
    if is_numeric(dt):
        return F.when(is_finite(c), F.concat(F.lit('["number", "'), _number_text(c), F.lit('"]')))
    text = c.cast("string")
    # to_json(array(x)) yields ["x"] with JSON escaping; strip the brackets
    escaped = F.regexp_extract(F.to_json(F.array(text)), r'^\[(.*)\]$', 1)
    return F.when(c.isNotNull(), F.concat(F.lit('["string", '), escaped, F.lit("]")))


def priority(seed, key: Column) -> Column:
    """sha256 hex of ``seed || '\\0' || key`` (key as text)."""
    return F.sha2(F.concat(F.lit(str(seed)), F.lit("\u0000"), key.cast("string")), 256)


def hash_unit(hex_col: Column) -> Column:
    """first 16 hex digits as an unsigned 64-bit integer divided by 2**64, in [0, 1)."""
    as_int = F.conv(F.substring(hex_col, 1, 16), 16, 10).cast("decimal(20,0)")
    return as_int.cast("double") / F.lit(float(2 ** 64))


def category_token(c, dt: T.DataType) -> Column:
    """``__missing__`` / ``number:<n>`` / ``value:<text>`` used by one-hot encoding."""
    c = col(c)
    if isinstance(dt, T.BooleanType):
        body = F.concat(F.lit("value:"), F.when(c, F.lit("True")).otherwise(F.lit("False")))
        return F.when(c.isNull(), F.lit("__missing__")).otherwise(body)
    if is_numeric(dt):
        missing = c.isNull() | F.isnan(c.cast("double"))
        return F.when(missing, F.lit("__missing__")).otherwise(F.concat(F.lit("number:"), _number_text(c)))
    return F.when(c.isNull(), F.lit("__missing__")).otherwise(F.concat(F.lit("value:"), c.cast("string")))


def strip_ws(c) -> Column:
    """Python ``str.strip()``: removes all leading/trailing whitespace, not only spaces."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def text_length(c) -> Column:
    return F.length(col(c).cast("string")).cast("bigint")
