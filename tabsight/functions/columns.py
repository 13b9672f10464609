"""Column expressions used by many operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed patterns: a plain or exponent number, and the two date shapes
# (year first, or day/month first) that count as a date vote.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
DATE_PATTERN = r"^([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}.*|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}.*)$"
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "M/d/yyyy", "d-M-yyyy", "d.M.yyyy")
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "0", "1")

# Longer strings are grouped by digest so that a shuffle never carries them.
LONG_VALUE = 64


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def is_temporal(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def scalar_columns(df: DataFrame) -> list[str]:
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return [f.name for f in df.schema if not isinstance(f.dataType, nested)]


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is zero (ANSI division would raise)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def parse_number(c: Column) -> Column:
    """Number in a string, thousands separators allowed, else null."""
    text = F.replace(F.trim(c), F.lit(","), F.lit(""))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def parse_timestamp(c: Column) -> Column:
    """Timestamp in a string by a fixed list of shapes, else null."""
    text = F.trim(c)
    plain = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS]
    iso = F.when(text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[T ]"), text.try_cast("timestamp_ntz"))
    return F.coalesce(iso, *plain)


def number_of(df: DataFrame, name: str) -> Column:
    """The column as double: numbers as they are, strings parsed, NaN and infinities null."""
    field = df.schema[name]
    if is_numeric(field):
        value = col(name).cast("double")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
        return value
    if isinstance(field.dataType, T.StringType):
        return parse_number(col(name))
    return F.lit(None).cast("double")


def present(df: DataFrame, name: str) -> Column:
    """True when the cell holds a value: not null, not blank, not NaN."""
    field = df.schema[name]
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.trim(col(name)) != "", F.lit(False))
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return col(name).isNotNull() & ~F.isnan(col(name))
    return col(name).isNotNull()


def value_key(c: Column, field: T.StructField) -> Column:
    """Equality key of a cell as a short string; long strings become their digest."""
    if isinstance(field.dataType, T.StringType):
        return F.when(F.length(c) > LONG_VALUE, F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))).otherwise(c)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return (c + F.lit(0.0)).cast("string")
    return c.cast("string")


def round_half_even(c: Column, digits: int = 0) -> Column:
    """Scale, round to the nearest even, scale back: the rounding of array libraries."""
    scale = float(10 ** abs(digits))
    if digits == 0:
        return F.rint(c)
    return F.rint(c * scale) / scale if digits > 0 else F.rint(c / scale) * scale


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every floating column, adding 0.0 so that -0.0 does not show."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in skip:
            out.append((F.round(col(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out)
