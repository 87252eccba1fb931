"""Totals and quantiles over ranges of values: no task sees all rows, or all of a group."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.numeric import all_of
from ..storage import remove, written

#: Accuracy of the sketch that brackets a quantile, and the share of a group's values on each side of it that the bracket takes.
ACCURACY, MARGIN = 4000, 0.001
#: Groups of so few values are bracketed by their least and greatest.
SMALL = 8000
#: Groups whose brackets come to the driver, and values inside brackets that are ranked by one window for each group.
GROUPS, RANKED = 10_000, 20_000_000


def running_totals(df: DataFrame, order: str, columns: list[str], group: str | None = None, descending: bool = False) -> DataFrame:
    """Adds ``<c>_upto`` for each of ``columns``: its total over the rows up to this one, by ``order``, in each ``group``.

    Rows are dealt into ranges and written, so that the marks of the ranges are one and the same
    wherever they are read.  Totals of ranges are added up first (a row for each range and
    group), then inside each: no task sees all rows, or all of a group.
    """
    key = F.col(f"`{order}`").desc() if descending else F.col(f"`{order}`")
    by = [group] if group else []
    spread = written(df.repartitionByRange(*by, key).withColumn("_p", F.spark_partition_id()), "ranges")
    totals = spread.groupBy("_p", *by).agg(*[F.sum(c).alias(f"{c}_t") for c in columns])
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_p", *by, *[F.coalesce(F.sum(f"{c}_t").over(earlier), F.lit(0)).alias(f"{c}_t") for c in columns])
    inner = Window.partitionBy("_p", *by).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    inside = spread.select("*", *[F.sum(c).over(inner).alias(f"{c}_in") for c in columns])
    return inside.join(totals, ["_p", *by]).select(*df.columns, *[(F.col(f"{c}_in") + F.col(f"{c}_t")).alias(f"{c}_upto") for c in columns])


def quantiles(rows: DataFrame, probabilities: Sequence[float], by: Sequence[str] = (), value: str = "v") -> DataFrame:
    """(by..., n, q): exact quantiles of the values of each group, linear between neighbours, as an array in the order of ``probabilities``.

    A mergeable sketch brackets each quantile; the next pass counts what lies below
    a bracket and keeps the distinct values inside it, about a 500th of a large group, with
    their numbers.  Only these are ranked.  A group that a bracket misses is
    done again over all its values, so the result is exact.  Null values do not
    count, null keys are groups, and groups without values are absent.
    """
    spark, names = rows.sparkSession, [f"k{i}" for i in range(len(by))]
    own = rows.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, names, strict=True)], F.col(f"`{value}`").cast("double").alias("v")).where("v IS NOT NULL")
    ends = [max(0.0, min(1.0, p + s * MARGIN)) for p in probabilities for s in (-1, 1)]
    found = own.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.approx_percentile("v", F.array(*map(F.lit, ends)), F.lit(ACCURACY)).alias("b"))
    found = found.where("n > 0")
    few = found.limit(GROUPS + 1).collect()
    local = len(few) <= GROUPS
    brackets = _local(spark, few, found.schema) if local else written(found, "brackets")
    answers = _selected(own, brackets, names, probabilities, few if local else None)
    if local:
        got = answers.collect()
        if any(x is None for r in got for x in r.q) or len(got) < len(few):
            missed = [r for r in few if not any(_same(r, g, names) and None not in g.q for g in got)]
            wide = [Row(**r.asDict() | {"b": [r.least, r.most] * len(probabilities)}) for r in missed]
            got = [g for g in got if None not in g.q] + _selected(own, _local(spark, wide, found.schema), names, probabilities, wide).collect()
        out = _local(spark, got, answers.schema)
    else:
        out = written(answers, "quantiles")
        whole = out.where(~F.exists("q", lambda x: x.isNull()))
        rest = brackets.join(whole.select(*names).withColumn("_done", F.lit(1)), all_of([brackets[k].eqNullSafe(whole[k]) for k in names]), "left_anti")
        if not rest.isEmpty():
            wide = rest.withColumn("b", F.flatten(F.array_repeat(F.array("least", "most"), len(probabilities))))
            out = whole.unionByName(written(_selected(own, wide, names, probabilities, None), "quantiles"))
        remove(spark, brackets)
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, names, strict=True)], "n", "q")


def _local(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    """A few rows as a local table; times keep to the usual way, which knows the session's zone."""
    if any(isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) for f in schema):
        return spark.createDataFrame(rows, schema)
    columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(to_arrow_schema(schema))]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=schema.names), schema)


def _same(a, b, names: list[str]) -> bool:
    return all(a[k] == b[k] or a[k] is None and b[k] is None for k in names)


def _selected(own: DataFrame, brackets: DataFrame, names: list[str], probabilities: Sequence[float], few: list | None) -> DataFrame:
    """(keys, n, q) of the groups in ``brackets``, which are ``few`` rows or many; a quantile that its bracket misses is null."""
    count = len(probabilities)
    if few is not None and not names:  # one group: numbers, no join
        r = few[0] if few else None
        tagged = own.select("v", F.lit(r.n if r else 0).alias("n"), F.lit(r.least if r else None).cast("double").alias("least"), F.lit(r.most if r else None).cast("double").alias("most"), F.array(*[F.lit(float(x)) for x in (r.b if r else [0.0] * 2 * count)]).alias("b"))
    else:
        other = brackets.select(*[F.col(k).alias(f"_{k}") for k in names], "n", "least", "most", "b")
        tagged = own.join(F.broadcast(other) if few is not None else other, all_of([F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names]))
    small = F.col("n") <= SMALL

    def mark(j: int) -> Column:
        low, high = F.when(small, F.col("least")).otherwise(F.col("b")[2 * j]), F.when(small, F.col("most")).otherwise(F.col("b")[2 * j + 1])
        return F.when(F.col("v") <= high, F.struct(F.lit(j).alias("j"), F.when(F.col("v") >= low, F.col("v")).alias("v")))

    marks = F.filter(F.array(*[mark(j) for j in range(count)]), lambda x: x.isNotNull())
    kept = tagged.select(*names, "n", F.explode(marks).alias("m")).groupBy(*names, "n", F.col("m.j").alias("j"), F.col("m.v").alias("v")).agg(F.count("*").alias("c"))
    group = F.struct(*names, "j")
    if few is not None and sum(r.n if r.n <= SMALL else 4 * MARGIN * r.n for r in few) * count <= RANKED:
        ranked = kept.withColumn("c_upto", F.sum("c").over(Window.partitionBy(*names, "j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        ranked = running_totals(kept.withColumn("_g", group), "v", ["c"], group="_g")
    place = F.element_at(F.array(*[F.lit(float(p)) for p in probabilities]), F.col("j") + 1) * (F.col("n") - 1)
    low, high = F.floor("h"), F.ceil("h")
    here = lambda rank: F.col("v").isNotNull() & (F.col("c_upto") > rank) & (F.col("c_upto") - F.col("c") <= rank)
    pairs = ranked.withColumn("h", place).groupBy(*names, "n", "j", "h").agg(F.max(F.when(here(low), F.col("v"))).alias("a"), F.max(F.when(here(high), F.col("v"))).alias("z"))
    between = F.when(F.col("a") == F.col("z"), F.col("a")).otherwise((F.ceil("h") - F.col("h")) * F.col("a") + (F.col("h") - F.floor("h")) * F.col("z"))
    return pairs.withColumn("x", between).groupBy(*names, "n").agg(F.array(*[F.max(F.when(F.col("j") == j, F.col("x"))) for j in range(count)]).alias("q"))


def medians(rows: DataFrame, by: Sequence[str], values: dict[str, Column]) -> dict[str, DataFrame]:
    """name -> (by..., name): the median of each group, a table for each of ``values``."""
    return {name: quantiles(rows.select(*[f"`{b}`" for b in by], c.alias("_value")), [0.5], by, "_value").select(*[f"`{b}`" for b in by], F.col("q")[0].alias(name)) for name, c in values.items()}


def with_previous(rows: DataFrame, order: str, column: str) -> DataFrame:
    """Adds ``<column>_before``: the value of the row before, by ``order`` (null for the first).

    Rows are dealt into written ranges; a range's first row takes the last value of the
    range before it that has rows, one number a range.
    """
    key = F.col(f"`{order}`")
    spread = written(rows.repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "ranges")
    last = spread.groupBy("_p").agg(F.max_by(column, order).alias("_last"))
    last = last.select("_p", F.lag("_last").over(Window.partitionBy(F.lit(0)).orderBy("_p")).alias("_last"))
    before = F.lag(column).over(Window.partitionBy("_p").orderBy(key))
    first = F.row_number().over(Window.partitionBy("_p").orderBy(key)) == 1
    found = spread.withColumn("_b", before).withColumn("_f", first).join(F.broadcast(last), "_p")
    return found.select(*rows.columns, F.when(F.col("_f"), F.col("_last")).otherwise(F.col("_b")).alias(f"{column}_before"))


def moving_average(rows: DataFrame, position: str, value: str, window: int, block: int = 100_000) -> DataFrame:
    """Adds ``<value>_moving``: the mean of a centred window of rows by their ``position``, 0, 1, 2..; beyond the ends the end values are repeated.

    Rows are dealt into blocks of positions; rows near a border are copied to the
    blocks that look at them, and each block is averaged by itself.  An even window has one row more behind it; a
    window above the number of rows is that number.  A null value makes its windows null.
    """
    at, v = F.col(f"`{position}`"), F.col(f"`{value}`")
    ends = rows.agg(F.count("*").alias("n"), F.min_by(v, at).alias("first"), F.max_by(v, at).alias("last")).first()
    window = max(1, min(int(window), ends.n or 1))
    back, ahead, size = window // 2, window - 1 - window // 2, max(block, window)
    own = F.floor(at / size)
    seen = rows.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(F.floor((at - ahead) / size), F.floor((at + back) / size))))
    frame = Window.partitionBy("_block").orderBy(at).rowsBetween(-back, ahead)
    missing = F.greatest(F.lit(0), back - at) * F.lit(ends.first).cast("double") + F.greatest(F.lit(0), at + ahead - ((ends.n or 0) - 1)) * F.lit(ends.last).cast("double")
    whole = F.count(v).over(frame) == F.count("*").over(frame)
    mean = F.when(whole, (F.sum(v).over(frame) + missing) / window)
    return seen.withColumn(f"{value}_moving", mean).where("_block = _own").drop("_block", "_own")


def roc_points(scored: DataFrame, cells: int = 200) -> tuple[DataFrame, DataFrame]:
    """Rows (s, y) -> the curve, and one row (auc, positives, negatives).

    Hits are added up over descending ranges of the distinct scores, which gives every point of
    the curve and the exact area.  The curve returned is bounded: of each ``cells``-th of the false positives the last point,
    with its threshold, true and false positives and their rates.
    """
    per = scored.groupBy(F.col("s").alias("v")).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("m"))
    run = written(running_totals(per, "v", ["p", "m"], descending=True), "roc")
    all_p, all_m = run.agg(F.coalesce(F.sum("p"), F.lit(0.0)), F.coalesce(F.sum("m"), F.lit(0.0))).first()
    area = run.agg((F.sum(F.col("m") * (F.col("p_upto") - F.col("p") / 2)) / F.lit(float(all_p * all_m) or None)).alias("auc"), F.lit(float(all_p)).alias("positives"), F.lit(float(all_m)).alias("negatives"))
    cell = F.ceil(F.col("m_upto") * cells / F.lit(float(all_m) or 1.0))
    last = run.groupBy(cell.alias("cell")).agg(F.max_by(F.struct("v", "p_upto", "m_upto"), F.struct("p_upto", "m_upto")).alias("r"))
    return last.select(F.col("r.v").alias("threshold"), F.col("r.p_upto").alias("true_positives"), F.col("r.m_upto").alias("false_positives"), F.try_divide("r.p_upto", F.lit(float(all_p))).alias("tpr"), F.try_divide("r.m_upto", F.lit(float(all_m))).alias("fpr")), area


def hull(points: list[tuple[float, float]]) -> list[bool]:
    """Which points of a curve, ascending in both coordinates, are corners of its upper convex hull from (0, 0) to (1, 1)."""
    chain: list[tuple[float, float, int]] = [(0.0, 0.0, -1)]
    for k, (x, y) in enumerate(points):
        while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (y - chain[-2][1]) >= (x - chain[-2][0]) * (chain[-1][1] - chain[-2][1]):
            chain.pop()
        chain.append((x, y, k))
    kept = {k for *_, k in chain}
    return [k in kept for k in range(len(points))]
