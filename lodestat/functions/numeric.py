"""Reading values as numbers, booleans and dates, as cleaning operators understand them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words for true and false in English and Swahili (fixed values).
TRUTHY = ("true", "t", "yes", "y", "1", "ndiyo", "sawa")
FALSY = ("false", "f", "no", "n", "0", "hapana")
#: Date patterns tried in order after the ISO forms.
DATE_FORMATS = ("M/d/yyyy", "d-M-yyyy", "yyyy/M/d", "d MMM yyyy", "MMM d, yyyy", "d/M/yyyy")
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric_type(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def finite(c: Column) -> Column:
    """NaN and infinities become missing."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def to_number(c: Column, t: T.DataType) -> Column:
    """The value as a double, or missing; suffixes such as 1d or 1f are text, not numbers."""
    if isinstance(t, T.BooleanType):
        return c.cast("double")
    if isinstance(t, T.NumericType):
        return finite(c.cast("double"))
    if isinstance(t, T.StringType):
        return finite(F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double")))
    return F.lit(None).cast("double")


def numbers(df: DataFrame, *names: str) -> list[Column]:
    return [to_number(F.col(f"`{n}`"), dtype(df, n)).alias(n) for n in names]


def to_boolean(c: Column) -> Column:
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*TRUTHY), True).when(word.isin(*FALSY), False)


def to_timestamp(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    text = c.cast("string")
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r over rows that have both; null where either does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
