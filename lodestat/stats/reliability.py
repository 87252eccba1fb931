"""Scales and raters: alpha, omega, Likert items, Fleiss' kappa, intraclass correlation."""

from __future__ import annotations

import math
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.numeric import numbers
from ..operators.columns import require
from .association import covariance, shown
from .basic import as_list
from .result import AnalysisError, Result, analysis, result, too_few


def _items(df: DataFrame, *given: Any, least: int = 2) -> list[str]:
    names = require(df, as_list(next((g for g in given if g), None)))
    if len(names) < least:
        raise AnalysisError(f"{least} columns at least")
    return names


def alpha_of(m: np.ndarray) -> float | None:
    k, total = len(m), m.sum()
    return k / (k - 1) * (1 - np.trace(m) / total) if k > 1 and total else None


@analysis("cronbach_alpha")
def cronbach_alpha(df: DataFrame, items: Any = None, columns: Any = None, **_: Any) -> Result:
    """Everything follows from one covariance matrix of complete rows."""
    names = _items(df, items, columns)
    m, n = covariance(df, names)
    if n < 3:
        return too_few("cronbach_alpha", n)
    rows = []
    for i, name in enumerate(names):
        rest = np.delete(np.delete(m, i, 0), i, 1)
        with_rest = m[i].sum() - m[i, i]
        rows.append({"item": name, "item_total_r": with_rest / math.sqrt(m[i, i] * rest.sum()) if m[i, i] * rest.sum() > 0 else None, "alpha_if_deleted": alpha_of(rest)})
    return result("cronbach_alpha", n, {"alpha": alpha_of(m), "items": len(names)}, tables={"items": rows})


@analysis("mcdonalds_omega")
def mcdonalds_omega(df: DataFrame, columns: Any = None, items: Any = None, raters: Any = None, **_: Any) -> Result:
    """(sum of item-total correlations)^2 over k times the correlations' sum of variances: an estimate without a factor model."""
    names = _items(df, columns, items, raters)
    m, n = covariance(df, names)
    if n < 3 or (np.diag(m) <= 0).any():
        return too_few("mcdonalds_omega", n)
    r = m.sum(1) / np.sqrt(np.diag(m) * m.sum())
    loads = r * np.sqrt(np.diag(m))
    omega = loads.sum() ** 2 / (loads.sum() ** 2 + (np.diag(m) * (1 - r**2)).sum())
    return result("mcdonalds_omega", n, {"omega": omega, "alpha": alpha_of(m)}, tables={"items": [{"item": c, "item_total_r": x} for c, x in zip(names, r.tolist(), strict=True)]})


@analysis("likert_analysis")
def likert(df: DataFrame, items: Any, scale_min: float | None = None, scale_max: float | None = None, weight_column: str | None = None, reversed_items: Any = None, **_: Any) -> Result:
    """All items in one grouping; a reversed item is scored from the other end."""
    names, back = _items(df, items, least=1), set(as_list(reversed_items))
    w = numbers(df, weight_column)[0] if weight_column else F.lit(1.0)
    wide = df.select(*numbers(df, *names), w.alias("_w"))
    long = wide.unpivot("_w", names, "item", "v").where("v IS NOT NULL AND _w > 0")
    ends = long.agg(F.min("v"), F.max("v")).first()
    lo = scale_min if scale_min is not None else ends[0] or 0
    hi = scale_max if scale_max is not None else ends[1] or 0
    v = F.when(F.col("item").isin(list(back)), lo + hi - F.col("v")).otherwise(F.col("v"))
    cells = long.groupBy("item", v.alias("v")).agg(F.count("*").alias("n"), F.sum("_w").alias("w"))
    above = lambda least: F.sum(F.when(F.col("v") >= least, F.col("w")).otherwise(0.0))
    sums = {r.item: r for r in cells.groupBy("item").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum(F.col("v") * F.col("n")).alias("vn"), F.sum(F.col("v") * F.col("w")).alias("vw"), above(hi).alias("top"), above(hi - 1).alias("two")).collect()}
    rows = [{"item": c, "n": r.n, "mean": r.vn / r.n, "weighted_mean": r.vw / r.w, "top_box": 100 * r.top / r.w, "top_two": 100 * r.two / r.w, "reversed": c in back} for c in names if (r := sums.get(c))]
    table, cut = shown(cells, F.array_position(F.array(*map(F.lit, names)), F.col("item")), "v", what="frequencies")
    freq = [{"item": r.item, "value": r.v, "n": r.n, "percentage": 100 * r.n / sums[r.item].n, "weighted_percentage": 100 * r.w / sums[r.item].w} for r in table]
    alpha = None
    if len(names) > 1:
        m, n = covariance(df, names)
        sign = np.array([-1.0 if c in back else 1.0 for c in names])
        alpha = alpha_of(m * np.outer(sign, sign)) if n > 2 else None
    return result("likert_analysis", df.count(), {"alpha": alpha}, warnings=cut, tables={"items": rows, "frequencies": freq})


@analysis("fleiss_kappa")
def fleiss_kappa(df: DataFrame, columns: Any = None, raters: Any = None, **_: Any) -> Result:
    """Rows are subjects, columns raters.  A subject's agreement is counted inside its row, labels' totals in one grouping."""
    names = _items(df, columns, raters, least=3)
    k = len(names)
    rows = df.select(*[F.col(f"`{c}`").cast("string").alias(f"r{i}") for i, c in enumerate(names)]).dropna()
    pairs = reduce(lambda a, b: a + b, [(F.col(f"r{i}") == F.col(f"r{j}")).cast("int") for i in range(k) for j in range(i)])
    n, agree = rows.agg(F.count("*"), F.coalesce(F.sum(pairs), F.lit(0))).first()
    if n < 2:
        return too_few("fleiss_kappa", n, 2)
    share = F.col("count") / (n * k)
    labels = rows.select(F.explode(F.array(*rows.columns)).alias("v")).groupBy("v").count().withColumn("p", share)
    pe, cubes = labels.agg(F.sum(F.col("p") ** 2), F.sum(F.col("p") ** 3)).first()
    po = agree / (n * k * (k - 1) / 2)
    if pe == 1:
        return result("fleiss_kappa", n, status="invalid", warnings=["only one label"])
    kappa, pq = (po - pe) / (1 - pe), 1 - pe
    # the sum of p q (q - p), with q = 1 - p
    var = 2 * (pq**2 - (1 - 3 * pe + 2 * cubes)) / (n * k * (k - 1) * pq**2)
    table, cut = shown(labels, F.desc("count"), "v", what="labels")
    z = kappa / math.sqrt(var) if var > 0 else None
    return result("fleiss_kappa", n, {"kappa": kappa, "agreement": po}, {"statistic": z, "p_value": 2 * D.normal_sf(abs(z)) if z is not None else None}, warnings=cut, tables={"labels": [{"label": r.v, "share": r.p} for r in table]})


@analysis("icc")
def icc(df: DataFrame, columns: Any, **_: Any) -> Result:
    """Two-way random effects, absolute agreement: one rater, and the mean of all; from one covariance matrix and the means."""
    names = _items(df, columns)
    k = len(names)
    m, n = covariance(df, names)
    if n < 3:
        return too_few("icc", n)
    mean = np.array(df.select(*numbers(df, *names)).dropna().agg(*[F.avg(f"`{c}`") for c in names]).first())
    total = (n - 1) * np.trace(m) + n * ((mean - mean.mean()) ** 2).sum()
    rows = (n - 1) * m.sum() / k
    cols = n * ((mean - mean.mean()) ** 2).sum()
    msr, msc, mse = rows / (n - 1), cols / (k - 1), (total - rows - cols) / ((n - 1) * (k - 1))
    single = (msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n)
    average = (msr - mse) / (msr + (msc - mse) / n)
    f = msr / mse if mse else None
    return result("icc", n, {"icc_2_1": single, "icc_2_k": average}, {"statistic": f, "df1": n - 1, "df2": (n - 1) * (k - 1), "p_value": D.f_sf(f, n - 1, (n - 1) * (k - 1)) if f else None})
