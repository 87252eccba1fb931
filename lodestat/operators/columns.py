"""Projections, renames, casts, calculated columns and cell edits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import compile_expression
from ..functions.numeric import dtype, to_boolean, to_number, to_timestamp
from ..storage import written

#: Row positions are a column: rows of a DataFrame have no order of their own.
POS = "_pos"


class OperationError(ValueError):
    """An operator was asked for something that its input does not allow."""


def require(df: DataFrame, names: Sequence[str], what: str = "columns") -> list[str]:
    names = [names] if isinstance(names, str) else list(names or ())
    if not names:
        raise OperationError(f"{what} is required")
    if lost := [n for n in names if n not in df.columns]:
        raise OperationError(f"columns not found: {', '.join(lost)}")
    return names


def public(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != POS]


def with_position(df: DataFrame) -> DataFrame:
    """Adds contiguous row positions from 0, in partition order.

    Rows are written once with their partition and their number in it; what was
    written is counted and numbered, so that no second run of a shuffle or a sort,
    which may deal rows to other partitions, can lose or repeat a row.  The
    offsets, one number a partition, are the only thing that is broadcast.
    """
    marked = written(df.drop(POS).withColumn("_m", F.monotonically_increasing_id()), "positions")
    part, row = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r.p, r.n) for r in marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, at = [], 0
    for p, n in counts:
        offsets.append((p, at))
        at += n
    table = df.sparkSession.createDataFrame(offsets, "_p long, _o long")
    return marked.withColumn("_p", part).join(F.broadcast(table), "_p").withColumn(POS, F.col("_o") + row).drop("_p", "_o", "_m")


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    names = require(df, columns)
    return df.select(*[f"`{n}`" for n in names], *([POS] if POS in df.columns and POS not in names else []))


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    names = require(df, columns)
    if not set(public(df)) - set(names):
        raise OperationError("dropping every column leaves nothing")
    return df.drop(*names)


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    require(df, list(mapping), "mapping")
    new = [mapping.get(c, c) for c in df.columns]
    if len(set(new)) < len(new):
        raise OperationError("two columns would have one name")
    return df.withColumnsRenamed(dict(mapping))


def cast_column(df: DataFrame, column: str) -> dict[str, Column]:
    """The column as each target type; what cannot be read becomes missing."""
    c, t = F.col(f"`{column}`"), dtype(df, column)
    n = to_number(c, t)
    return {"numeric": n, "integer": F.bround(n, 0).cast("bigint"), "text": c.cast("string"), "date": to_timestamp(c, t), "boolean": to_boolean(c)}


def cast_types(df: DataFrame, column: str, target_type: str) -> DataFrame:
    require(df, [column])
    kinds = cast_column(df, column)
    if target_type not in kinds:
        raise OperationError(f"target types are {', '.join(kinds)}")
    return df.withColumn(column, kinds[target_type])


def calculate_column(df: DataFrame, name: str, expression: str, overwrite: bool = False, dtype: str | None = None) -> DataFrame:
    if name in df.columns and not overwrite:
        raise OperationError(f"{name} exists; set overwrite to replace it")
    c = compile_expression(expression, df)
    return df.withColumn(name, F.bround(c, 0) if dtype == "integer" else c)


def set_values(df: DataFrame, edits: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Cells by row position; an empty string or null clears, the last edit of a cell counts."""
    if not edits:
        raise OperationError("edits is required")
    if POS not in df.columns:
        raise OperationError(f"edits need row positions ({POS})")
    by: dict[str, dict[int, Any]] = {}
    for e in edits:
        require(df, [e.get("column")], "column")
        if not isinstance(e.get("row"), int) or isinstance(e["row"], bool) or e["row"] < 0 or "value" not in e:
            raise OperationError("an edit has a row position, a column and a value")
        v = e["value"]
        by.setdefault(e["column"], {})[e["row"]] = None if isinstance(v, str) and not v.strip() else v
    out = {}
    for column, cells in by.items():
        old = F.col(f"`{column}`")
        if any(isinstance(v, str) for v in cells.values()):
            old = old.cast("string")
        elif any(isinstance(v, float) for v in cells.values()) and dtype(df, column).typeName() in ("integer", "long", "short", "byte"):
            old = old.cast("double")
        new = old
        for row, v in cells.items():
            new = F.when(F.col(POS) == row, F.lit(v)).otherwise(new)
        out[column] = new
    return df.withColumns(out)
