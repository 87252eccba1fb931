"""Duplicates and missing values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import dtype, to_number
from .ranges import quantiles
from .columns import POS, OperationError, public, require


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None, keep: str = "first") -> DataFrame:
    """One row of each key; missing equals missing.

    With positions the first (or last) row stays: a pre-aggregated least
    position and a join on it, so no key's rows are gathered.  Without positions rows are alike or any one stays.
    """
    if keep not in ("first", "last"):
        raise OperationError("keep is first / last")
    names = require(df, subset) if subset else public(df)
    if POS not in df.columns:
        return df.dropDuplicates(names)
    best = df.groupBy(*[f"`{n}`" for n in names]).agg((F.min if keep == "first" else F.max)(POS).alias(POS)).select(POS)
    return df.join(best, POS, "left_semi")


def _missing(df: DataFrame, name: str):
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if isinstance(dtype(df, name), (T.DoubleType, T.FloatType)) else c.isNull()


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None, threshold: int | None = None) -> DataFrame:
    """Rows that are complete in ``columns``, or have fewer than ``threshold`` (default 1) missing values."""
    names = require(df, columns) if columns else public(df)
    least = 1 if threshold is None or columns else int(threshold)
    return df.where(reduce(lambda a, b: a + b, [_missing(df, n).cast("int") for n in names]) < least)


def fill_missing(df: DataFrame, method: str, columns: Sequence[str] | None = None, value: Any = None) -> DataFrame:
    """drop, mean, median, mode (the least of tied ones), zero (empty text for text) or constant.

    All columns' fill values come from one aggregation, medians from two passes.
    """
    names = require(df, columns) if columns else public(df)
    if method == "drop":
        return drop_missing(df, names)
    kinds = {n: dtype(df, n) for n in names}
    clean = {n: F.when(~_missing(df, n), F.col(f"`{n}`")) for n in names}
    if method in ("mean", "median", "mode"):
        if method != "mode":
            clean = {n: to_number(c, kinds[n]) for n, c in clean.items() if isinstance(kinds[n], (T.NumericType, T.StringType))}
        if not clean:
            return df
        if method == "median":
            long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("c"), c.alias("v")) for n, c in clean.items()])).alias("x")).select("x.*")
            middle = {r.c: r.q[0] for r in quantiles(long, [0.5], ["c"]).collect()}
            own = {id(c): F.lit(middle.get(n)) for n, c in clean.items()}
        agg = {"mean": F.avg, "median": lambda c: F.any_value(own[id(c)]), "mode": lambda c: F.mode(c, True)}[method]
        row = df.agg(*[agg(c).alias(f"f{k}") for k, c in enumerate(clean.values())], *[F.count_if(c.isNull() & ~_missing(df, n)).alias(f"t{k}") for k, (n, c) in enumerate(clean.items())]).first()
        # a text column counts as numeric only if all its values are numbers
        fills = {n: row[f"f{k}"] for k, n in enumerate(clean) if row[f"f{k}"] is not None and (method == "mode" or not row[f"t{k}"])}
    elif method == "zero":
        fills = {n: 0 if isinstance(t, T.NumericType) else "" for n, t in kinds.items() if isinstance(t, (T.NumericType, T.StringType))}
    elif method == "constant":
        if value is None:
            raise OperationError("constant needs a value")
        fills = dict.fromkeys(names, value)
    else:
        raise OperationError("methods are drop, mean, median, mode, zero, constant")
    out = {}
    for n, v in fills.items():
        old = F.when(~_missing(df, n), F.col(f"`{n}`"))
        if method in ("mean", "median"):
            old = to_number(old, kinds[n])
        elif isinstance(v, str) and not isinstance(kinds[n], T.StringType):
            old = old.cast("string")
        out[n] = F.coalesce(old, F.lit(v))
    return df.withColumns(out)


def change_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows, columns and missing cells before and after, an aggregation a side."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        cells = reduce(lambda a, b: a + b, [_missing(df, n).cast("int") for n in public(df)])
        return df.agg(F.count("*").alias(f"rows_{tag}"), F.lit(len(public(df))).alias(f"columns_{tag}"), F.coalesce(F.sum(cells), F.lit(0)).alias(f"missing_cells_{tag}"))

    # one row meets one row
    both = side(before, "before").withColumn("k", F.lit(1)).join(side(after, "after").withColumn("k", F.lit(1)), "k").drop("k")
    return both.withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))
