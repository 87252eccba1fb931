"""Correlation and contingency tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.numeric import correlation, numbers
from ..operators.columns import require
from ..operators.grouping import crosstab as cells_of
from ..operators.grouping import value_counts
from ..operators.ranges import running_totals
from ..storage import written
from .basic import as_list, average_ranks, moments, numeric_columns
from .result import AnalysisError, Result, analysis, result, too_few

#: Different labels of a table that goes to the driver.
MOST_LABELS = 10_000
STRENGTH = ((0.2, "negligible"), (0.4, "weak"), (0.7, "moderate"), (math.inf, "strong"))


def shown(rows: DataFrame, *order: Any, what: str = "rows", most: int | None = None) -> tuple[list, list[str]]:
    """The first rows for a table that goes to the driver, and a warning with the number of those left out; statistics are made of all."""
    most = MOST_LABELS if most is None else most
    got = rows.orderBy(*order).limit(most).collect()
    left = rows.count() - len(got) if len(got) == most else 0
    return got, [f"the table of {what} leaves out {left} rows"] if left else []


def pairs_of(df: DataFrame, x: str, y: str) -> DataFrame:
    a, b = numbers(df, *require(df, [x, y]))
    return df.select(a.alias("x"), b.alias("y")).dropna()


def correlation_test(r: float | None, n: int, level: float = 0.95) -> dict:
    if r is None or n < 3 or math.isnan(r):
        return {"r": None, "p_value": None}
    r = max(-1.0, min(1.0, r))
    t = r * math.sqrt((n - 2) / (1 - r * r)) if abs(r) < 1 else math.inf
    p = 2 * D.t_sf(abs(t), n - 2) if math.isfinite(t) else 0.0
    return {"r": r, "statistic": t, "df": n - 2, "p_value": p, "interval": D.fisher_z_interval(r, n, level), "strength": next(name for top, name in STRENGTH if abs(r) < top)}


def spearman_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y): average ranks of complete pairs, a join for each side with the ranks of its distinct values."""
    p = pairs_of(df, x, y)
    rx, ry = average_ranks(p, "x").select(F.col("v").alias("x"), F.col("r").alias("rx")), average_ranks(p, "y").select(F.col("v").alias("y"), F.col("r").alias("ry"))
    return p.join(rx, "x").join(ry, "y").select(F.col("rx").alias("x"), F.col("ry").alias("y"))


def _correlation(kind: str, p: DataFrame, level: float) -> Result:
    r = p.agg(F.count("*").alias("n"), correlation(F.col("x"), F.col("y")).alias("r")).first()
    if r.n < 3:
        return too_few(kind, r.n)
    t = correlation_test(r.r, r.n, level)
    return result(kind, r.n, {"r": t["r"]}, {k: t.get(k) for k in ("statistic", "df", "p_value")}, t.get("interval"), {"strength": t.get("strength")})


@analysis("pearson", "point_biserial")
def pearson(df: DataFrame, x: str | None = None, y: str | None = None, x_column: str | None = None, y_column: str | None = None, confidence_level: float = 0.95, **_: Any) -> Result:
    return _correlation("pearson", pairs_of(df, x_column or x, y_column or y), confidence_level)


@analysis("spearman")
def spearman(df: DataFrame, x: str | None = None, y: str | None = None, x_column: str | None = None, y_column: str | None = None, confidence_level: float = 0.95, **_: Any) -> Result:
    return _correlation("spearman", spearman_pairs(df, x_column or x, y_column or y), confidence_level)


#: Combinations of distinct values up to which Kendall's pairs are counted in one matrix.
MATRIX = 4_000_000


def kendall_counts(df: DataFrame, x: str, y: str) -> np.ndarray:
    """(n, C - D, tied pairs of x, of y) of complete pairs.

    Few combinations of values are one small matrix; else pairs are counted by
    running totals over ranges, level by level of the ranks of x.
    """
    table = pairs_of(df, x, y).groupBy("x", "y").agg(F.count("*").alias("c"))
    levels = table.agg(F.countDistinct("x").alias("a"), F.countDistinct("y").alias("b")).first()
    if levels.a * levels.b > MATRIX:
        return _kendall_levels(written(table, "cells"), levels.a)
    got = table.toPandas()
    xs, i = np.unique(got["x"], return_inverse=True)
    ys, j = np.unique(got["y"], return_inverse=True)
    m = np.zeros((len(xs), len(ys)))
    m[i, j] = got["c"]
    below = np.zeros_like(m)  # pairs with both smaller, and with x smaller and y larger
    below[1:, 1:] = m.cumsum(0).cumsum(1)[:-1, :-1]
    above = np.zeros_like(m)
    above[1:, :-1] = m[:, ::-1].cumsum(0).cumsum(1)[:, ::-1][:-1, 1:]
    n, tx, ty = m.sum(), m.sum(1), m.sum(0)
    return np.array([n, (m * below).sum() - (m * above).sum(), (tx * (tx - 1)).sum() / 2, (ty * (ty - 1)).sum() / 2])


def _kendall_levels(cells: DataFrame, distinct: int) -> np.ndarray:
    """Two ranks of x differ first in one of their digits of base 16: there, and only there, the pair is counted.

    Rows of one block share all higher digits; in the order of y, running
    totals of each digit tell how many rows of a smaller digit lie below and above.
    """
    ranks = running_totals(cells.select("x").distinct().withColumn("one", F.lit(1)), "x", ["one"]).select("x", (F.col("one_upto") - 1).alias("rank"))
    ranked = written(cells.join(ranks, "x").select("rank", "y", F.col("c").cast("double").alias("c")), "ranked")
    names = [f"n{d}" for d in range(16)]
    score = 0.0
    for level in range(max(1, -(-(distinct - 1).bit_length() // 4))):
        digit = F.shiftright("rank", 4 * level).bitwiseAND(F.lit(15))
        wide = ranked.groupBy(F.shiftright("rank", 4 * level + 4).alias("block"), "y").agg(*[F.sum(F.when(digit == d, F.col("c")).otherwise(0.0)).alias(n) for d, n in enumerate(names)])
        run = running_totals(wide, "y", names, group="block")
        whole = wide.groupBy("block").agg(*[F.sum(n).alias(f"{n}_all") for n in names])
        # below less above: twice the total up to here, less this row, less all
        lead = [2 * F.col(f"{n}_upto") - F.col(n) - F.col(f"{n}_all") for n in names]
        parts, before = [], F.lit(0.0)
        for d in range(1, 16):
            before = before + lead[d - 1]
            parts.append(F.col(names[d]) * before)
        score += run.join(whole, "block").agg(F.sum(sum(parts[1:], parts[0]))).first()[0] or 0.0
    tied = [cells.groupBy(k).agg(F.sum("c").cast("double").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1)) / 2).first()[0] for k in ("x", "y")]
    return np.array([cells.agg(F.sum("c")).first()[0], score, *tied], float)


@analysis("kendall")
def kendall(df: DataFrame, x: str | None = None, y: str | None = None, x_column: str | None = None, y_column: str | None = None, **_: Any) -> Result:
    n, s, tx, ty = kendall_counts(df, x_column or x, y_column or y)
    pairs = n * (n - 1) / 2
    if n < 3 or pairs in (tx, ty):
        return too_few("kendall", int(n))
    tau = s / math.sqrt((pairs - tx) * (pairs - ty))
    z = tau / math.sqrt(2 * (2 * n + 5) / (9 * n * (n - 1)))
    return result("kendall", n, {"tau": tau}, {"statistic": z, "p_value": 2 * D.normal_sf(abs(z))})


def pairwise_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, n, r) of each pair of columns over the rows that have both; r is null where either does not vary.

    One pass for the means, one for products of columns less their means: a batch gives
    matrix products of values and of what is there, so no pair has an expression of its own.
    """
    k = len(columns)
    c = numbers(df, *columns)
    mean = np.array([m or 0.0 for m in df.agg(*[F.avg(x) for x in c]).first()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, k, k))
        for b in batches:
            x = b.to_numpy(float) - mean
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

    rows = df.select(*[x.alias(f"c{i}") for i, x in enumerate(c)]).mapInPandas(run, "at int, v double")
    got = rows.groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").toPandas()["v"].to_numpy()
    n, s, q, xy = got.reshape(4, k, k) if len(got) else np.zeros((4, k, k))
    out = []
    for i, j in combinations(range(k), 2):
        own = n[i, j]
        # sums of i, of its square, and of j, over the rows that have both
        vx, vy = (q[a, b] - s[a, b] ** 2 / own if own else 0.0 for a, b in ((i, j), (j, i)))
        varies = all(v > own * (1e-13 * abs(m)) ** 2 for v, m in ((vx, mean[i]), (vy, mean[j])))
        r = float((xy[i, j] - s[i, j] * s[j, i] / own) / math.sqrt(vx * vy)) if own > 1 and varies else None
        out.append((columns[i], columns[j], int(own), r))
    return df.sparkSession.createDataFrame(out, "x string, y string, n long, r double")


@analysis("correlation_matrix")
def correlation_matrix(df: DataFrame, columns: Any = None, method: str = "pearson", **_: Any) -> Result:
    names = require(df, as_list(columns)) if columns else numeric_columns(df)
    if len(names) < 2:
        raise AnalysisError("a correlation matrix takes two columns and more")
    if method == "spearman":
        rows = [(a, b, *spearman_pairs(df, a, b).agg(F.count("*"), correlation(F.col("x"), F.col("y"))).first()) for a, b in combinations(names, 2)]
    else:
        rows = [tuple(r) for r in pairwise_correlations(df, names).collect()]
    table = [{"x": a, "y": b, "n": n, **{k: correlation_test(r, n)[k] for k in ("r", "p_value")}} for a, b, n, r in rows]
    table.sort(key=lambda t: -abs(t["r"] or 0))
    matrix = {a: {a: 1.0} for a in names}
    for t in table:
        matrix[t["x"]][t["y"]] = matrix[t["y"]][t["x"]] = t["r"]
    return result("correlation_matrix", max((t["n"] for t in table), default=0), {"strongest": table[0]}, tables={"pairs": table, "matrix": matrix, "descriptives": [{k: v for k, v in r.asDict().items() if k not in ("q1", "median", "q3")} for r in moments(df, names, quantiles=False).collect()]}, method=method)


@analysis("partial_correlation")
def partial_correlation(df: DataFrame, x: str, y: str, control_columns: Any = None, controls: Any = None, z: Any = None, confidence_level: float = 0.95, **_: Any) -> Result:
    names = require(df, [x, y, *as_list(control_columns or controls or z)])
    m, n = covariance(df, names)
    k = len(names) - 2
    if n < k + 4:
        return too_few("partial_correlation", n, k + 4)
    p = np.linalg.inv(m)
    r = -p[0, 1] / math.sqrt(p[0, 0] * p[1, 1])
    t = correlation_test(r, n - k, confidence_level)
    return result("partial_correlation", n, {"r": r}, {"statistic": t["statistic"], "df": n - k - 2, "p_value": t["p_value"]}, t["interval"], {"strength": t["strength"]})


def covariance(df: DataFrame, names: list[str]) -> tuple[np.ndarray, int]:
    """Sample covariance of complete rows, all pairs in one aggregation, and their number."""
    c = df.select(*numbers(df, *names)).dropna()
    k = len(names)
    at = [(i, j) for i in range(k) for j in range(i, k)]
    r = c.agg(F.count("*"), *[F.covar_samp(f"`{names[i]}`", f"`{names[j]}`") for i, j in at]).first()
    m = np.zeros((k, k))
    for (i, j), v in zip(at, r[1:], strict=True):
        m[i, j] = m[j, i] = v if v is not None else np.nan
    return m, r[0]


def contingency(df: DataFrame, row: str, column: str, missing: str | None = "<missing>") -> tuple[np.ndarray, list[str], list[str]]:
    got = cells_of(df, row, column, missing).limit(MOST_LABELS + 1).collect()
    if len(got) > MOST_LABELS:
        raise AnalysisError(f"a table of more than {MOST_LABELS} cells")
    rows, columns = sorted({r.row for r in got}), sorted({r.column for r in got})
    m = np.zeros((len(rows), len(columns)))
    for r in got:
        m[rows.index(r.row), columns.index(r.column)] = r.n
    return m, rows, columns


def chi_square_of(m: np.ndarray) -> dict:
    n = m.sum()
    expected = np.outer(m.sum(1), m.sum(0)) / n
    stat = float(((m - expected) ** 2 / expected).sum())
    d = (m.shape[0] - 1) * (m.shape[1] - 1)
    return {"statistic": stat, "df": d, "p_value": D.chi2_sf(stat, d) if d else None, "v": math.sqrt(stat / (n * min(k - 1 for k in m.shape))) if d else None, "expected": expected}


def chi_square_of_cells(cells: DataFrame) -> DataFrame:
    """One row (n, rows, columns, statistic, df, v, least_expected) from the counted cells (row, column, n) of a table of any size.

    Cells meet their margins by joins; the statistic is n times the sum of o^2 / (row x column) less n, so cells without rows need not be made.
    """
    sides = [cells.groupBy(c).agg(F.sum("n").cast("double").alias(f"{c}_n")) for c in ("row", "column")]
    ends = [s.agg(F.count("*").alias("k"), F.min(f"{c}_n").alias("least"), F.sum(f"{c}_n").alias("n")).first() for s, c in zip(sides, ("row", "column"), strict=True)]
    n, k = float(ends[0].n or 0), min(ends[0].k, ends[1].k) - 1
    share = cells.join(sides[0], "row").join(sides[1], "column").agg((F.sum(F.col("n") * F.col("n") / F.col("row_n") / F.col("column_n")) * n - n).alias("statistic"))
    d = (ends[0].k - 1) * (ends[1].k - 1)
    return share.select(F.lit(n).alias("n"), F.lit(ends[0].k).alias("rows"), F.lit(ends[1].k).alias("columns"), "statistic", F.lit(d).cast("long").alias("df"), (F.sqrt(F.col("statistic") / F.lit(n * k)) if n and k > 0 else F.lit(None).cast("double")).alias("v"), F.lit((ends[0].least or 0) * (ends[1].least or 0) / n if n else None).cast("double").alias("least_expected"))


def fisher_p(m: np.ndarray) -> float:
    """Two-sided: all tables of these margins that are not likelier."""
    a, b, c, d = (int(x) for x in m.ravel())
    log = lambda k: math.lgamma(a + b + 1) - math.lgamma(k + 1) - math.lgamma(a + b - k + 1) + math.lgamma(c + d + 1) - math.lgamma(a + c - k + 1) - math.lgamma(d - a + k + 1)
    span = range(max(0, a - d), min(a + b, a + c) + 1)
    values = [log(k) for k in span]
    top = max(values)
    weights = [math.exp(v - top) for v in values]
    own = math.exp(log(a) - top)
    return min(1.0, sum(w for w in weights if w <= own * (1 + 1e-7)) / sum(weights))


def _table(df: DataFrame, missing: str | None, p: dict) -> tuple[np.ndarray, list[str], list[str]]:
    return contingency(df, p.get("row_column") or p.get("row") or p.get("x"), p.get("column_column") or p.get("column") or p.get("y"), missing)


@analysis("chi_square", "crosstab")
def chi_square(df: DataFrame, method: str | None = None, **p: Any) -> Result:
    names = p.get("row_column") or p.get("row") or p.get("x"), p.get("column_column") or p.get("column") or p.get("y")
    cells = cells_of(df, *names, "<missing>")
    if cells.limit(MOST_LABELS + 1).count() > MOST_LABELS:
        # a large table stays in Spark: the statistic is exact, the cells shown are those with most rows
        x = chi_square_of_cells(written(cells, "cells")).first()
        shown = [{"row": r.row, "column": r.column, "observed": float(r.n)} for r in cells.orderBy(F.desc("n"), "row", "column").limit(100).collect()]
        return result("chi_square", int(x.n), test={"statistic": x.statistic, "df": x.df, "p_value": D.chi2_sf(x.statistic, x.df) if x.df else None}, effect={"cramers_v": x.v}, diagnostics={"least_expected": x.least_expected}, warnings=[f"a table of {x['rows']} rows and {x['columns']} columns: the 100 largest cells are shown"], tables={"cells": shown})
    m, rows, columns = _table(df, "<missing>", p)
    if min(m.shape, default=0) < 2:
        raise AnalysisError("two rows and two columns at least")
    x = chi_square_of(m)
    table = [{"row": r, "column": c, "observed": m[i, j], "expected": x["expected"][i, j], "row_percent": 100 * m[i, j] / m[i].sum()} for i, r in enumerate(rows) for j, c in enumerate(columns)]
    test = {k: x[k] for k in ("statistic", "df", "p_value")}
    diagnostics, kind = {"least_expected": float(x["expected"].min())}, "chi_square"
    if m.shape == (2, 2) and (x["expected"].min() < 5 or method == "fisher"):
        diagnostics["chi_square"] = dict(test)
        test = {"statistic": None, "p_value": fisher_p(m), "method": "fisher"}
    return result(kind, m.sum(), None, test, effect={"cramers_v": x["v"]}, diagnostics=diagnostics, tables={"cells": table})


@analysis("fisher_exact")
def fisher_exact(df: DataFrame, **p: Any) -> Result:
    m, rows, columns = _table(df, None, p)
    if m.shape != (2, 2):
        raise AnalysisError("Fisher's test takes a 2 x 2 table")
    odds = m[0, 0] * m[1, 1] / (m[0, 1] * m[1, 0]) if m[0, 1] * m[1, 0] else math.inf
    return result("fisher_exact", m.sum(), {"odds_ratio": odds}, {"p_value": fisher_p(m)}, tables={"cells": m.tolist(), "rows": rows, "columns": columns})


@analysis("frequency")
def frequency(df: DataFrame, columns: Any = None, column: Any = None, **_: Any) -> Result:
    names = require(df, as_list(columns or column))
    tables, warnings = {}, []
    for c in names:
        rows, cut = shown(value_counts(df, c), F.desc("count"), F.asc_nulls_last("value"), what=c)
        tables[c] = [r.asDict() for r in rows]
        warnings += cut
    return result("frequency", df.count(), warnings=warnings, tables=tables)


@analysis("weighted_frequencies")
def weighted_frequencies(df: DataFrame, weight_column: str, columns: Any = None, column: Any = None, **_: Any) -> Result:
    tables, warnings = {}, []
    for c in require(df, as_list(columns or column)):
        w = df.select(F.col(f"`{c}`").cast("string").alias("value"), numbers(df, weight_column)[0].alias("w")).where("w > 0")
        rows, cut = shown(w.groupBy("value").agg(F.sum("w").alias("weight"), F.count("*").alias("count")), F.desc("weight"), F.asc_nulls_last("value"), what=c)
        total = w.agg(F.sum("w")).first()[0]
        tables[c] = [{**r.asDict(), "percentage": 100 * r.weight / total} for r in rows]
        warnings += cut
    return result("weighted_frequencies", df.count(), warnings=warnings, tables=tables)


@analysis("chi_square_gof")
def goodness_of_fit(df: DataFrame, column: str | None = None, value_column: str | None = None, x: str | None = None, expected: Any = None, **_: Any) -> Result:
    """expected: shares or counts of the values, most frequent first (ties by value); default equal."""
    name = require(df, [column or value_column or x])[0]
    counts = df.where(F.col(f"`{name}`").isNotNull()).groupBy(F.col(f"`{name}`").cast("string").alias("v")).count()
    values, n = counts.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    e = np.array([float(v) for v in expected.split(",")] if isinstance(expected, str) else expected, float) if expected is not None else None
    if values < 2 or (e is not None and (len(e) != values or (e <= 0).any())):
        raise AnalysisError("a positive expected value for each of two values and more")
    # values with an expectation of their own are as many as the caller's list; equal ones need no list
    rows, cut = shown(counts, F.desc("count"), "v", what=name, most=None if e is None else max(values, MOST_LABELS))
    o = np.array([r["count"] for r in rows], float)
    if e is None:
        e = np.full(len(o), n / values)
        stat = float(counts.agg(F.sum(F.pow(F.col("count") - n / values, F.lit(2.0)))).first()[0]) / (n / values)
    else:
        e = e / e.sum() * n
        stat = float(((o - e) ** 2 / e).sum())
    cells = [{"value": r.v, "observed": a, "expected": b, "residual": (a - b) / math.sqrt(b)} for r, a, b in zip(rows, o.tolist(), e.tolist(), strict=True)][:MOST_LABELS]
    if len(cells) < len(rows):
        cut = [f"the table of {name} leaves out {len(rows) - len(cells)} rows"]
    return result("chi_square_gof", n, None, {"statistic": stat, "df": values - 1, "p_value": D.chi2_sf(stat, values - 1)}, effect={"cohens_w": math.sqrt(stat / n)}, warnings=cut, tables={"cells": cells})


@analysis("mcnemar")
def mcnemar(df: DataFrame, before_column: str | None = None, after_column: str | None = None, row_column: str | None = None, column_column: str | None = None, **_: Any) -> Result:
    before, after = require(df, [before_column or row_column, after_column or column_column])
    m, rows, columns = contingency(df, before, after, None)
    labels = sorted({*rows, *columns})
    if len(labels) != 2:
        return result("mcnemar", m.sum(), status="invalid", warnings=["both columns hold the same two values"])
    get = lambda r, c: float(m[rows.index(r), columns.index(c)]) if r in rows and c in columns else 0.0
    b, c = get(labels[0], labels[1]), get(labels[1], labels[0])
    if b + c == 0:
        return result("mcnemar", m.sum(), status="invalid", warnings=["no pair changed"])
    stat = max(0.0, abs(b - c) - 1) ** 2 / (b + c)
    return result("mcnemar", m.sum(), {"changed": [b, c]}, {"statistic": stat, "df": 1, "p_value": D.chi2_sf(stat, 1)}, effect={"odds_ratio": b / c if c else None})


@analysis("two_proportion_z_test")
def two_proportions(df: DataFrame, value_column: str, group_column: str, positive_value: Any = None, confidence_level: float = 0.95, **_: Any) -> Result:
    """The positive value defaults to the larger label; groups are in order of their labels."""
    m, groups, values = contingency(df, group_column, value_column, None)
    if m.shape != (2, 2):
        raise AnalysisError("two groups and two values")
    j = values.index(str(positive_value)) if positive_value is not None else 1
    n, x = m.sum(1), m[:, j]
    p, pooled = x / n, x.sum() / n.sum()
    z = (p[0] - p[1]) / math.sqrt(pooled * (1 - pooled) * (1 / n).sum())
    half = D.normal_ppf(0.5 + confidence_level / 2) * math.sqrt((p * (1 - p) / n).sum())
    other = n - x
    return result("two_proportion_z_test", n.sum(), {"difference": p[0] - p[1], "proportions": dict(zip(groups, p.tolist(), strict=True))}, {"statistic": z, "p_value": 2 * D.normal_sf(abs(z))}, [p[0] - p[1] - half, p[0] - p[1] + half], {"odds_ratio": x[0] * other[1] / (x[1] * other[0]) if x[1] * other[0] else None, "cohens_h": 2 * math.asin(math.sqrt(p[0])) - 2 * math.asin(math.sqrt(p[1]))})


@analysis("cohens_kappa")
def cohens_kappa(df: DataFrame, row_column: str, column_column: str, **_: Any) -> Result:
    m, rows, columns = contingency(df, row_column, column_column, None)
    labels = sorted({*rows, *columns})
    full = np.zeros((len(labels), len(labels)))
    full[np.ix_([labels.index(r) for r in rows], [labels.index(c) for c in columns])] = m
    n = full.sum()
    if n < 3:
        return too_few("cohens_kappa", int(n))
    p = full / n
    po, a, b = np.trace(p), p.sum(1), p.sum(0)
    pe = float(a @ b)
    if pe == 1:
        return result("cohens_kappa", n, status="invalid", warnings=["only one label"])
    kappa = (po - pe) / (1 - pe)
    se0 = math.sqrt(pe + pe**2 - (a * b * (a + b)).sum()) / ((1 - pe) * math.sqrt(n))
    se = math.sqrt(po * (1 - po) / n) / (1 - pe)
    return result("cohens_kappa", n, {"kappa": kappa, "agreement": po}, {"statistic": kappa / se0 if se0 else None, "p_value": 2 * D.normal_sf(abs(kappa / se0)) if se0 else None}, [kappa - 1.959964 * se, kappa + 1.959964 * se])
