"""Sorting, top k, samples and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import POS, OperationError, require


def sort(df: DataFrame, by: Sequence[str], ascending: bool | Sequence[bool] = True) -> DataFrame:
    """Missing last in both directions; equal rows keep the order of their positions."""
    names = require(df, by, "by")
    up = [ascending] * len(names) if isinstance(ascending, bool) else list(ascending)
    if len(up) != len(names):
        raise OperationError("one direction for each column")
    keys = [F.col(f"`{n}`").asc_nulls_last() if a else F.col(f"`{n}`").desc_nulls_last() for n, a in zip(names, up, strict=True)]
    return df.orderBy(*keys, *([POS] if POS in df.columns else []))


def top_values(df: DataFrame, column: str, k: int = 8) -> DataFrame:
    """The k most frequent values, ties by value."""
    require(df, [column])
    return df.groupBy(F.col(f"`{column}`").cast("string").alias("value")).count().orderBy(F.desc("count"), F.asc_nulls_last("value")).limit(k)


def sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows with the least hashes (MD5 of their positions, or of the whole row, and the seed): the same rows at any partitioning."""
    key = [POS] if POS in df.columns else [f"`{c}`" for c in df.columns]
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key], F.lit(str(seed)))
    return df.orderBy(F.md5(text), *key).limit(n)


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Rows of one page, from 1, by position: a range predicate that reaches the scan."""
    if POS not in df.columns:
        raise OperationError(f"pages need row positions ({POS})")
    at = max(0, number - 1) * size
    return df.where((F.col(POS) >= at) & (F.col(POS) < at + size))
