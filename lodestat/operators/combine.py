"""Joins on keys where missing equals missing, and append by name."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import all_of
from .columns import POS, OperationError, require

JOINS = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def merge(left: DataFrame, right: DataFrame, how: str = "inner", on: Sequence[str] | None = None, left_on: Sequence[str] | None = None, right_on: Sequence[str] | None = None, suffixes: tuple[str, str] = ("_left", "_right"), right_columns: Sequence[str] | None = None) -> DataFrame:
    """An equi-join; keys of one name become one column, other columns of one name get suffixes.

    Null-safe equality is still a hash key for Spark, so the join shuffles or broadcasts as usual.
    """
    if how not in JOINS:
        raise OperationError(f"how is {', '.join(JOINS)}")
    lk = require(left, left_on or on, "left keys")
    rk = require(right, right_on or on, "right keys")
    if len(lk) != len(rk):
        raise OperationError("as many keys on each side")
    if right_columns:
        right = right.select(*dict.fromkeys([*rk, *require(right, right_columns)]))
    left, right = left.drop(POS), right.drop(POS)
    a, b = left.alias("a"), right.alias("b")
    joined = a.join(b, all_of([F.col(f"a.`{x}`").eqNullSafe(F.col(f"b.`{y}`")) for x, y in zip(lk, rk, strict=True)]), JOINS[how])
    shared = {x for x, y in zip(lk, rk, strict=True) if x == y}
    out = []
    for c in left.columns:
        if c in shared:
            out.append(F.coalesce(f"a.`{c}`", f"b.`{c}`").alias(c))
        else:
            out.append(F.col(f"a.`{c}`").alias(c + suffixes[0] if c in right.columns else c))
    out += [F.col(f"b.`{c}`").alias(c + suffixes[1] if c in left.columns else c) for c in right.columns if c not in shared]
    return joined.select(*out)


def key_frequencies(left: DataFrame, right: DataFrame, lk: Sequence[str], rk: Sequence[str]) -> DataFrame:
    """(k0.., l, r): rows of both sides for each key; missing is a key like any other.  Pre-aggregated, so a hot key is a row a task."""
    keys = [f"k{i}" for i in range(len(lk))]
    text = [("string" in (kinds := {left.schema[a].dataType.typeName(), right.schema[b].dataType.typeName()})) and len(kinds) > 1 for a, b in zip(lk, rk, strict=True)]
    sides = [df.select(*[(F.col(f"`{c}`").cast("string") if odd else F.col(f"`{c}`")).alias(k) for c, k, odd in zip(names, keys, text, strict=True)]).groupBy(*keys).agg(F.count("*").alias(tag)) for df, names, tag in ((left, lk, "l"), (right, rk, "r"))]
    both = sides[0].withColumn("r", F.lit(0).cast("long")).unionByName(sides[1].withColumn("l", F.lit(0).cast("long")))
    return both.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))


def predict_merge(left: DataFrame, right: DataFrame, how: str = "inner", on: Sequence[str] | None = None, left_on: Sequence[str] | None = None, right_on: Sequence[str] | None = None, **_: object) -> DataFrame:
    """One row on a merge that is not run: rows of both sides, rows that it would give, keys on both sides, on one
    side only and more than once on both, and the rows of the key that gives most.

    Rows out are the sum over keys of the product of their frequencies, with the rows of keys without a partner that ``how`` keeps.
    """
    if how not in JOINS:
        raise OperationError(f"how is {', '.join(JOINS)}")
    lk, rk = require(left, left_on or on, "left keys"), require(right, right_on or on, "right keys")
    if len(lk) != len(rk):
        raise OperationError("as many keys on each side")
    n = F.col("l") * F.col("r")
    if how in ("left", "outer"):
        n = n + F.when(F.col("r") == 0, F.col("l")).otherwise(0)
    if how in ("right", "outer"):
        n = n + F.when(F.col("l") == 0, F.col("r")).otherwise(0)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return key_frequencies(left, right, lk, rk).agg(zero(F.sum("l")).alias("rows_left"), zero(F.sum("r")).alias("rows_right"), zero(F.sum(n)).alias("rows"), F.count_if((F.col("l") > 0) & (F.col("r") > 0)).alias("keys_shared"), F.count_if(F.col("r") == 0).alias("keys_left_only"), F.count_if(F.col("l") == 0).alias("keys_right_only"), F.count_if((F.col("l") > 1) & (F.col("r") > 1)).alias("keys_repeated"), zero(F.max(n)).alias("rows_of_largest_key"))


def merge_report(left: DataFrame, right: DataFrame, how: str = "inner", most_rows: int | None = None, **keys: Any) -> dict:
    """What a merge would give, with warnings where the keys probably do not fit: no rows, rows lost, rows multiplied, types that differ.

    Nothing is joined.  Beyond ``most_rows`` the merge is refused.
    """
    r = predict_merge(left, right, how, **keys).first().asDict()
    a, b, n = r["rows_left"], r["rows_right"], r["rows"]
    if most_rows is not None and n > most_rows:
        raise OperationError(f"the merge would give {n} rows from {a} and {b}, above {most_rows}; {r['keys_repeated']} keys repeat on both sides, one gives {r['rows_of_largest_key']} rows")
    warnings = []
    pairs = zip(keys.get("left_on") or keys.get("on") or [], keys.get("right_on") or keys.get("on") or [], strict=False)
    if odd := [x for x, y in pairs if (left.schema[x].dataType.typeName() == "string") != (right.schema[y].dataType.typeName() == "string")]:
        warnings.append(f"types differ: {', '.join(odd)} is text on one side only")
    if not n:
        warnings.append("no rows: the keys of both sides share no value; compare their spelling and their types")
    elif how == "inner" and n < min(a, b):
        warnings.append(f"rows lost: {n} of {a} are left; a left join shows which keys have no partner")
    elif n > max(a, b):
        warnings.append(f"rows multiplied: {n} from {a} and {b}; {r['keys_repeated']} keys repeat on both sides")
    return {"how": how, **r, "warnings": warnings}


def append(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of both, columns by name; a column missing on one side is null there, types that differ become text.

    Positions of the right side follow those of the left.
    """
    a, b = left, right
    for f in left.schema:
        if f.name in right.columns and right.schema[f.name].dataType != f.dataType and f.name != POS:
            kinds = {f.dataType.typeName(), right.schema[f.name].dataType.typeName()}
            to = "double" if kinds <= {"integer", "long", "double", "float", "short", "byte"} else "string"
            to = "bigint" if kinds <= {"integer", "long", "short", "byte"} else to
            a, b = a.withColumn(f.name, F.col(f"`{f.name}`").cast(to)), b.withColumn(f.name, F.col(f"`{f.name}`").cast(to))
    if POS in a.columns and POS in b.columns:
        first = a.agg(F.coalesce(F.max(POS) + 1, F.lit(0)).alias("n")).first().n
        b = b.withColumn(POS, F.col(POS) + first)
    return a.unionByName(b, allowMissingColumns=True)
