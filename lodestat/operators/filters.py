"""Row filters: fourteen operators, joined by and / or."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import all_of, any_of, dtype, to_number
from .columns import OperationError, require

OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "between", "in", "not_in", "contains", "startswith", "endswith", "is_null", "not_null")


def _number(v: Any) -> float | None:
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def condition(df: DataFrame, column: str, operator: str, value: Any = None) -> Column:
    """Missing values match only ``is_null``, ``ne`` and ``not_in``.

    Numbers are compared as numbers if the operands are numbers and the column
    can hold some (strings are read as numbers), else as text.
    """
    require(df, [column])
    if operator not in OPERATORS:
        raise OperationError(f"operators are {', '.join(OPERATORS)}")
    c, t = F.col(f"`{column}`"), dtype(df, column)
    missing = c.isNull() | F.isnan(c) if isinstance(t, (T.DoubleType, T.FloatType)) else c.isNull()
    if operator == "is_null":
        return missing
    if operator == "not_null":
        return ~missing
    false, true = F.lit(False), F.lit(True)
    if operator in ("contains", "startswith", "endswith"):
        return F.coalesce(getattr(F.lower(c.cast("string")), operator)(F.lit(str(value).lower())), false)
    values = list(value) if isinstance(value, (list, tuple, set)) else [value]
    if operator == "between" and len(values) != 2:
        raise OperationError("between takes two limits")
    read = [_number(v) for v in values]
    if all(v is not None for v in read) and isinstance(t, (T.NumericType, T.BooleanType, T.StringType)):
        c, values = to_number(c, t), read
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        values = [F.lit(str(v)).cast(t) for v in values]
    else:
        c, values = c.cast("string"), [str(v) for v in values]
    match operator:
        case "eq":
            return F.coalesce(c == values[0], false)
        case "ne":
            return F.coalesce(c != values[0], true)
        case "gt":
            return F.coalesce(c > values[0], false)
        case "gte":
            return F.coalesce(c >= values[0], false)
        case "lt":
            return F.coalesce(c < values[0], false)
        case "lte":
            return F.coalesce(c <= values[0], false)
        case "between":
            lo, hi = (F.least(*values), F.greatest(*values)) if isinstance(values[0], Column) else (min(values), max(values))
            return F.coalesce(c.between(lo, hi), false)
        case "in":
            return F.coalesce(c.isin(values), false)
    return F.coalesce(~c.isin(values), true)


def filter_mask(df: DataFrame, conditions: Sequence[Mapping[str, Any]], logic: str = "and") -> Column:
    if logic not in ("and", "or"):
        raise OperationError("logic is and / or")
    if not conditions:
        raise OperationError("conditions is required")
    parts = [condition(df, c.get("column"), c.get("operator"), c.get("value")) for c in conditions]
    return all_of(parts) if logic == "and" else any_of(parts)


def filter_rows(df: DataFrame, conditions: Sequence[Mapping[str, Any]], logic: str = "and") -> DataFrame:
    return df.where(filter_mask(df, conditions, logic))
