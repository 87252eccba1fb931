"""Group-by with eight aggregations, frequencies, crosstabs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import all_of, dtype, to_number
from .columns import OperationError, require
from .ranges import medians

ROWS = "__rows__"


def aggregation(df: DataFrame, column: str, fn: str) -> Column:
    c = F.col(f"`{column}`")
    n = to_number(c, dtype(df, column))
    found = {"count": F.count(c), "sum": F.coalesce(F.sum(n), F.lit(0.0)), "mean": F.avg(n), "min": F.min(c), "max": F.max(c), "std": F.stddev_samp(n), "nunique": F.countDistinct(c)}
    if fn not in found:
        raise OperationError(f"aggregations are {', '.join([*found, 'median'])}")
    return found[fn].alias(f"{column}_{fn}")


def group_by(df: DataFrame, by: Sequence[str], aggregations: Mapping[str, Sequence[str] | str]) -> DataFrame:
    """Missing keys are groups and come last; ``__rows__`` counts rows."""
    keys = require(df, by, "by")
    columns, order, middle = [], [], {}
    for name, fns in aggregations.items():
        if name == ROWS:
            columns.append(F.count("*").alias("row_count"))
            order.append("row_count")
        else:
            require(df, [name])
            for fn in [fns] if isinstance(fns, str) else fns:
                order.append(f"{name}_{fn}")
                if fn == "median":
                    middle[order[-1]] = to_number(F.col(f"`{name}`"), dtype(df, name))
                else:
                    columns.append(aggregation(df, name, fn))
    if not order:
        raise OperationError("aggregations is required")
    out = df.groupBy(*[f"`{k}`" for k in keys]).agg(*(columns or [F.count("*").alias("__n")]))
    # medians come from ranges of values: a table of groups joins a table of groups
    for name, table in medians(df, keys, middle).items():
        table = table.withColumnsRenamed({k: f"__{k}" for k in keys})
        out = out.join(table, all_of([F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`")) for k in keys]), "left").drop(*[f"__{k}" for k in keys])
    return out.select(*[f"`{c}`" for c in [*keys, *order]]).orderBy(*[F.col(f"`{k}`").asc_nulls_last() for k in keys])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, count, percentage of all rows; missing is a value."""
    require(df, [column])
    counts = df.groupBy(F.col(f"`{column}`").cast("string").alias("value")).count()
    return counts.withColumn("percentage", F.round(100 * F.col("count") / df.count(), 2))


def crosstab(df: DataFrame, row: str, column: str, missing: str | None = "<missing>") -> DataFrame:
    """row, column, n in long form; missing labels are a label or, with None, left out."""
    require(df, [row, column])
    labels = [F.col(f"`{c}`").cast("string").alias(a) for c, a in ((row, "row"), (column, "column"))]
    cells = df.select(*labels)
    cells = cells.dropna() if missing is None else cells.fillna(missing)
    return cells.groupBy("row", "column").agg(F.count("*").alias("n"))
