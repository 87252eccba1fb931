"""Chart data: aggregated by Spark to a bounded number of rows before anything is collected."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dtype, is_numeric_type, numbers
from ..operators.columns import OperationError, require
from ..operators.filters import filter_mask
from ..operators.ordering import sample
from ..operators.ranges import quantiles
from .profile import histogram

CATEGORIES, FACETS, POINTS, BOX_POINTS = 50, 12, 5000, 2000
AGGREGATIONS = ("sum", "mean", "count", "min", "max", "median")
TYPES = ("bar", "line", "scatter", "histogram", "box", "pie", "heatmap")
MISSING = "<missing>"


def _label(column: str):
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(MISSING))


def _aggregated(rows: DataFrame, keys: dict[str, Column], y: str | None, how: str) -> DataFrame:
    """(keys..., value) of each group."""
    if how not in AGGREGATIONS:
        raise OperationError(f"aggregations are {', '.join(AGGREGATIONS)}")
    named = [c.alias(k) for k, c in keys.items()]
    if y is None:
        return rows.groupBy(*named).agg(F.count("*").cast("double").alias("value"))
    c = numbers(rows, y)[0]
    if how == "median":
        return quantiles(rows.select(*named, c.alias("v")), [0.5], list(keys)).select(*keys, F.col("q")[0].alias("value"))
    value = {"sum": F.sum(c), "mean": F.avg(c), "count": F.count(c).cast("double"), "min": F.min(c), "max": F.max(c)}[how]
    return rows.groupBy(*named).agg(value.alias("value"))


def _with_numbers(df: DataFrame, y: str | None) -> DataFrame:
    return df if y is None else df.where(numbers(df, y)[0].isNotNull())


def categories(df: DataFrame, x: str, y: str | None = None, aggregation: str = "sum", group_by: str | None = None, k: int = CATEGORIES) -> DataFrame:
    """(x, series, value) of at most k values of x: by x if it is a number or date, else the largest.

    Missing combinations of x and series are 0.
    """
    rows = _with_numbers(df, y)
    ordered = is_numeric_type(dtype(df, x)) or dtype(df, x).typeName() in ("date", "timestamp", "timestamp_ntz")
    key = F.col(f"`{x}`") if ordered else _label(x)
    first = _aggregated(rows, {"x": key}, y, aggregation).orderBy(F.asc_nulls_last("x") if ordered else F.desc("value"), "x").limit(k)
    if not group_by:
        return first.select("x", F.lit("value").alias("series"), "value")
    cells = _aggregated(rows, {"x": key, "series": _label(group_by)}, y, aggregation)
    series = rows.groupBy(_label(group_by).alias("series")).count().orderBy(F.desc("count"), "series").limit(k).select("series")
    # at most k by k rows: a frame of all combinations, filled by a join
    grid = first.select("x", F.lit(1).alias("one")).join(series.withColumn("one", F.lit(1)), "one").drop("one").alias("g")
    same = F.col("g.x").eqNullSafe(F.col("c.x")) & (F.col("g.series") == F.col("c.series"))
    return grid.join(cells.alias("c"), same, "left").select("g.x", "g.series", F.coalesce("c.value", F.lit(0.0)).alias("value"))


def pie(df: DataFrame, x: str, y: str | None = None, aggregation: str = "sum") -> DataFrame:
    rows = categories(df, x, y, aggregation)
    return rows.withColumn("share", F.try_divide(F.col("value"), F.sum("value").over(Window.partitionBy("series")))).drop("series")


def box(df: DataFrame, y: str, x: str | None = None) -> DataFrame:
    """(x, n, low, q1, median, q3, high) with fences at one and a half times the box."""
    rows = _with_numbers(df, y).select((_label(x) if x else F.lit("all")).alias("x"), numbers(df, y)[0].alias("v"))
    ends = rows.groupBy("x").agg(F.min("v").alias("least"), F.max("v").alias("most"))
    out = quantiles(rows, [0.25, 0.5, 0.75], ["x"]).join(ends, "x")
    spread = 1.5 * (F.col("q")[2] - F.col("q")[0])
    return out.select("x", "n", F.greatest("least", F.col("q")[0] - spread).alias("low"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), F.least("most", F.col("q")[2] + spread).alias("high")).orderBy(F.desc("n"), "x").limit(CATEGORIES)


def heatmap(df: DataFrame, x: str, group_by: str, y: str | None = None, aggregation: str = "sum") -> DataFrame:
    """(x, series, value) of at most 50 by 50 labels, in one grouping."""
    rows = _with_numbers(df, y)
    cells = _aggregated(rows, {"x": _label(x), "series": _label(group_by)}, y, aggregation)
    kept = [rows.groupBy(_label(c).alias(a)).count().orderBy(F.desc("count"), a).limit(CATEGORIES).select(a) for c, a in ((x, "x"), (group_by, "series"))]
    return cells.join(F.broadcast(kept[0]), "x", "left_semi").join(F.broadcast(kept[1]), "series", "left_semi").select("x", "series", "value")


def scatter(df: DataFrame, x: str, y: str, limit: int = POINTS, color: str | None = None, size: str | None = None) -> DataFrame:
    """A sample of complete points; the same points at any partitioning."""
    names = list(dict.fromkeys([x, y, *([size] if size else [])]))
    kept = df.where(numbers(df, x)[0].isNotNull() & numbers(df, y)[0].isNotNull())
    return sample(kept.select(*numbers(df, *names), *([_label(color).alias("color")] if color else [])), min(limit, POINTS))


def build(df: DataFrame, chart_type: str, x: str | None = None, y: str | None = None, aggregation: str = "sum", group_by: str | None = None, filters: list[dict] | None = None, logic: str = "and", facet: str | None = None, **more: Any) -> dict[str, DataFrame]:
    """Data of each panel (one, named all, without a facet), after the filters."""
    if chart_type not in TYPES:
        raise OperationError(f"charts are {', '.join(TYPES)}")
    require(df, [c for c in (x, y, group_by, facet) if c] or [x])
    if filters:
        df = df.where(filter_mask(df, filters, logic))

    def panel(rows: DataFrame) -> DataFrame:
        match chart_type:
            case "bar" | "line":
                return categories(rows, x, y, aggregation, group_by)
            case "scatter":
                return scatter(rows, x, y, **more)
            case "histogram":
                return histogram(rows, x or y, **more)
            case "box":
                return box(rows, y or x, x if y else group_by)
            case "pie":
                return pie(rows, x, y, aggregation)
        return heatmap(rows, x, group_by, y, aggregation)

    if not facet:
        return {"all": panel(df)}
    labels = [r.v for r in df.groupBy(_label(facet).alias("v")).count().orderBy(F.desc("count"), "v").limit(FACETS).collect()]
    return {v: panel(df.where(_label(facet) == v)) for v in labels}


def wide(panel: DataFrame) -> DataFrame:
    """Chart data of x, series and value as a table: x and a column for each series, of which a chart has few."""
    if not {"x", "series", "value"} <= set(panel.columns):
        return panel
    names = [r.series for r in panel.select("series").distinct().orderBy("series").limit(CATEGORIES).collect()]
    return panel.groupBy("x").pivot("series", names).agg(F.first("value")).orderBy("x")


#: Characters of a note on a chart.
NOTE = 280


def annotations(notes: list[dict] | None) -> list[dict[str, Any]]:
    """Notes at places given in values of the data: text and x are needed, y and series may be."""
    out = []
    for k, note in enumerate(notes or [], 1):
        text = str((note or {}).get("text") or "").strip() if isinstance(note, dict) else ""
        if not text or note.get("x") is None:
            raise OperationError(f"note {k} needs a text and an x")
        out.append({"text": text[:NOTE], **{c: note.get(c) for c in ("x", "y", "series")}})
    return out


def placed(panel: DataFrame, notes: list[dict] | None) -> list[dict[str, Any]]:
    """Notes with the chart's value where they stand, read from the panel's few rows; null where it has none."""
    found = annotations(notes)
    if not found or not {"x", "value"} <= set(panel.columns):
        return [n | {"value": None} for n in found]
    label = F.col("x").cast("string")
    wanted = panel.where(label.isin(*{str(n["x"]) for n in found})).select(label.alias("x"), (F.col("series") if "series" in panel.columns else F.lit(None)).cast("string").alias("series"), "value")
    values = {(r.x, r.series): r.value for r in wanted.collect()}
    first = {x: v for (x, _), v in sorted(values.items(), key=lambda r: str(r[0]), reverse=True)}
    return [n | {"value": values.get((str(n["x"]), n["series"]), first.get(str(n["x"])) if n["series"] is None else None)} for n in found]


def describe(chart_type: str, x: str | None = None, y: str | None = None, aggregation: str = "sum", group_by: str | None = None, facet: str | None = None, filters: list[dict] | None = None) -> str:
    """What a chart shows, in a line."""
    if chart_type not in TYPES:
        raise OperationError(f"charts are {', '.join(TYPES)}")
    subject = {"scatter": f"{y} against {x}", "heatmap": f"{aggregation} of {y} by {x}" if y else f"rows by {x}", "box": f"{y or x} by {x}" if y else f"{x}", "histogram": f"{x or y}"}.get(chart_type, f"{aggregation} of {y} by {x}" if y else f"rows by {x}")
    more = [f"and {group_by}" if chart_type == "heatmap" else f"for each {group_by}"] if group_by else []
    more += [f"in panels of {facet}"] if facet else []
    more += ["filtered"] if filters else []
    return ", ".join([f"{chart_type}: {subject}{' ' + more.pop(0) if more and more[0].startswith('and ') else ''}", *more])
