"""Column expressions: missing and finite tests, parsing, JSON-safe output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
NUMERIC = INTEGRAL + FLOATING + (T.DecimalType,)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)

# Spellings and patterns that decide how a cell is read.
WHITESPACE = " \t\n\r\x0b\x0c"
BOOLEAN_WORDS = ["true", "false", "yes", "no", "y", "n", "0", "1", "是", "否"]
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITY_WORDS = ["inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]
ZERO_PADDED_PATTERN = r"^0\d+$"
DATE_MARKS_PATTERN = r"[-/:年月日]"
# Coefficients of the rational approximation of the inverse normal
# distribution function (published by P. J. Acklam), highest power first.
NORMAL_CENTRE_TOP = [-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2,
                     1.383577518672690e2, -3.066479806614716e1, 2.506628277459239e0]
NORMAL_CENTRE_BOTTOM = [-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2,
                        6.680131188771972e1, -1.328068155288572e1, 1.0]
NORMAL_TAIL_TOP = [-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838e0,
                   -2.549732539343734e0, 4.374664141464968e0, 2.938163982698783e0]
NORMAL_TAIL_BOTTOM = [7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996e0,
                      3.754408661907416e0, 1.0]
NORMAL_TAIL_LIMIT = 0.02425


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots or blanks."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    """The column's name inside SQL text."""
    return "`" + name.replace("`", "``") + "`"


def present_sql(df: DataFrame, name: str) -> str:
    """``present`` as SQL text, for structs built once per column of a wide table."""
    c = quoted(name)
    return f"if(isnan({c}), NULL, {c})" if isinstance(dtype_of(df, name), FLOATING) else c


def micros_sql(df: DataFrame, name: str) -> str:
    c = quoted(name)
    if isinstance(dtype_of(df, name), T.TimestampType):
        return f"unix_micros({c})"
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ))"


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN for floating columns. Infinity is a value."""
    c = col(name)
    return (c.isNull() | F.isnan(c)) if isinstance(dtype_of(df, name), FLOATING) else c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value, with NaN turned into null."""
    c = col(name)
    return F.when(~F.isnan(c), c) if isinstance(dtype_of(df, name), FLOATING) else c


def finite(df: DataFrame, name: str) -> Column:
    """The value as double; null when missing, NaN or infinite. Strings are parsed."""
    dtype = dtype_of(df, name)
    if isinstance(dtype, INTEGRAL + (T.DecimalType, T.BooleanType)):
        return col(name).cast("double")
    c = col(name).cast("double") if isinstance(dtype, FLOATING) else parse_number(col(name))
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def stripped(c: Column) -> Column:
    return F.btrim(c.cast("string"), F.lit(WHITESPACE))


def parse_number(c: Column) -> Column:
    """String to double: strip, drop thousands commas; null when it is no number.

    The pattern guard is needed because a plain cast also reads ``1d`` or ``2f``.
    """
    text = F.replace(stripped(c), F.lit(","), F.lit(""))
    readable = text.rlike(NUMBER_PATTERN) | F.lower(text).isin(INFINITY_WORDS)
    return F.when(readable, text).try_cast("double")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a date or timestamp column."""
    return F.expr(micros_sql(df, name))


def iso_from_micros(c: Column) -> Column:
    """ISO text of microseconds since 1970, always with six decimals."""
    moment = F.timestamp_add("MICROSECOND", c, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def cell_text(df: DataFrame, name: str) -> Column:
    """Display string of a value; null when missing."""
    return present(df, name).cast("string")


def _horner(coefficients: list[float], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function for 0 < p < 1."""
    centre = p - 0.5
    square = centre * centre
    tail = F.sqrt(F.lit(-2.0) * F.ln(F.least(p, 1.0 - p)))
    tail_value = _horner(NORMAL_TAIL_TOP, tail) / _horner(NORMAL_TAIL_BOTTOM, tail)
    return (
        F.when(p < NORMAL_TAIL_LIMIT, tail_value)
        .when(p > 1.0 - NORMAL_TAIL_LIMIT, -tail_value)
        .otherwise(_horner(NORMAL_CENTRE_TOP, square) * centre / _horner(NORMAL_CENTRE_BOTTOM, square))
    )


def has_floating(kind: T.DataType) -> bool:
    """Whether floating values stand anywhere in a type, map keys left out."""
    if isinstance(kind, T.StructType):
        return any(has_floating(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return has_floating(kind.elementType)
    return has_floating(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, FLOATING)


def finite_value(c: Column, kind: T.DataType) -> Column:
    """The value with null for each NaN or infinity in it; map keys stay."""
    if not has_floating(kind):
        return c
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[finite_value(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: finite_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: finite_value(x, kind.valueType))
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become null, also inside nested values; top-level moments ISO text, intervals text."""
    out = []
    for field in df.schema.fields:
        c = col(field.name)
        if has_floating(field.dataType):
            c = finite_value(c, field.dataType)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = iso_from_micros(micros(df, field.name))
        elif isinstance(field.dataType, (T.DateType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
            c = c.cast("string")
        out.append(c.alias(field.name))
    return df.select(*out)


def kind_is_moment(df: DataFrame, name: str) -> bool:
    return isinstance(dtype_of(df, name), TEMPORAL)
