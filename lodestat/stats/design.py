"""Design matrices, their cross products, and maximum likelihood over partitions.

Rows stay distributed: a cross product is one aggregation, a Newton step one
pass in which each partition gives its log-likelihood, score and curvature, a few
numbers whatever the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import dtype, is_numeric_type, numbers
from ..operators.columns import public, require
from ..storage import written
from .basic import as_list
from .likelihoods import Model, block_sums
from .result import AnalysisError


def features_of(df: DataFrame, target: str, p: dict) -> list[str]:
    found = as_list(p.get("features") or p.get("predictors") or p.get("x") or p.get("independent"))
    return require(df, found) if found else [c for c in public(df) if c != target and is_numeric_type(dtype(df, c))]


def complete(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns as numbers, rows that have all."""
    return df.select(*numbers(df, *require(df, names))).dropna()


def two_values(df: DataFrame, target: str, positive: Any = None) -> tuple[DataFrame, str]:
    """Adds _y, 1 for the positive label: the given one, else the rarer, of equals the larger."""
    label = F.col(f"`{target}`").cast("string")
    counts = {r.v: r["count"] for r in df.where(label.isNotNull()).groupBy(label.alias("v")).count().limit(3).collect()}
    if len(counts) != 2:
        raise AnalysisError("the target takes exactly two values")
    if positive is None:
        numeric = {k: float(k) for k in counts if k.replace(".", "", 1).isdigit()}
        positive = "1" if set(counts) == {"0", "1"} else "1.0" if set(counts) == {"0.0", "1.0"} else min(counts, key=lambda k: (counts[k], -numeric.get(k, 0)))
    if str(positive) not in counts:
        raise AnalysisError(f"no value {positive!r}")
    return df.where(label.isNotNull()).withColumn("_y", (label == str(positive)).cast("double")), str(positive)


def shifted(rows: DataFrame, names: list[str]) -> tuple[DataFrame, np.ndarray]:
    """The columns less their means, and the means: sums of products of what is left do not cancel, however large the means."""
    mean = np.array([v if v is not None else 0.0 for v in rows.agg(*[F.avg(f"`{n}`") for n in names]).first()])
    return rows.select(*[(F.col(f"`{n}`") - float(m)).alias(n) for n, m in zip(names, mean.tolist(), strict=True)], *[F.col(f"`{c}`") for c in rows.columns if c not in names]), mean


def cross_products(rows: DataFrame, names: list[str]) -> np.ndarray:
    """(1, names)' (1, names) over the rows, one aggregation."""
    k = len(names)
    c = [F.lit(1.0), *[F.col(f"`{n}`") for n in names]]
    at = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    r = rows.agg(*[F.coalesce(F.sum(c[i] * c[j]), F.lit(0.0)) for i, j in at]).first()
    m = np.zeros((k + 1, k + 1))
    for (i, j), v in zip(at, r, strict=True):
        m[i, j] = m[j, i] = v
    return m


def centred(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """n, means and centred cross products from those of ``cross_products``, whose columns should be shifted ones."""
    n = m[0, 0]
    mean = m[0, 1:] / n if n else m[0, 1:]
    return n, mean, m[1:, 1:] - n * np.outer(mean, mean)


def centred_products(rows: DataFrame, names: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """n, means and centred cross products of the columns: one pass for the means, one for the products."""
    own, mean = shifted(rows, names)
    n, rest, s = centred(cross_products(own, names))
    return n, mean + rest, s


#: Rows of a distinct one above which equal rows are put together before passes are made over them.
REPEATED = 2


def counted(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns with ``_times``, how often a row stands for: equal rows become one where they repeat, so that passes go over distinct rows.

    How many there are is estimated in one pass; the result is the same sums either way.
    """
    rows = rows.select(*[F.col(f"`{c}`") for c in names])
    n, distinct = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*[f"`{c}`" for c in names]))).first()
    if n <= REPEATED * distinct:
        return rows.withColumn("_times", F.lit(1.0))
    return written(rows.groupBy(*[f"`{c}`" for c in names]).agg(F.count("*").cast("double").alias("_times")), "counted")


def maximise(rows: DataFrame, y: str, names: list[str], model: Model, start: np.ndarray, rounds: int = 60, intercept: bool = True, blocks: tuple[int, ...] = (0,)) -> dict:
    """Damped Newton steps on the summed log-likelihood of ``model``, whose derivatives are in closed form; x has a leading 1 column.

    Features (all names but the offset ``_off``) are standardised while the model is
    fitted, and the parameters taken back: steps, curvature and the test of
    convergence do not depend on the units of a column.  ``blocks`` are the places in theta where
    an intercept and slopes begin; without ``intercept`` there are slopes alone, and the
    parameter after them takes up the shift.  Equal rows are put together first, see ``counted``.
    """
    k, scaled = len(start), [n for n in names if n != "_off"]
    got = rows.agg(*[f(f"`{n}`") for n in scaled for f in (F.avg, F.stddev_pop)]).first() if scaled else ()
    mean = np.array([v or 0.0 for v in got[::2]])
    sd = np.array([v if v and math.isfinite(v) and v > 1e-12 * (abs(m) + 1e-300) else 1.0 for m, v in zip(mean.tolist(), got[1::2], strict=True)])
    back = np.eye(k)
    for b in blocks:
        at = np.arange(len(scaled)) + b + bool(intercept)
        back[at, at] = 1 / sd
        if intercept:
            back[b, at] = -mean / sd
        else:
            back[b + len(scaled), at] = mean / sd

    def passed(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(1 + k + 2 * k * k)
            with np.errstate(all="ignore"):
                for b in batches:
                    own = iter(((b[scaled].to_numpy(float) - mean) / sd).T)
                    x = np.column_stack([*([np.ones(len(b))] if intercept else []), *[b[n].to_numpy(float) if n == "_off" else next(own) for n in names]])
                    total += block_sums(model(theta, x, b[y].to_numpy(float)), b["_times"].to_numpy(float))
            yield pd.DataFrame({"at": np.arange(len(total)), "v": total})

        got = distinct.mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").toPandas()["v"].to_numpy()
        return got[0], got[1 : 1 + k], got[1 + k : 1 + k + k * k].reshape(k, k), got[1 + k + k * k :].reshape(k, k)

    distinct = counted(rows, list(dict.fromkeys([y, *names])))
    theta = np.linalg.solve(back, np.asarray(start, float))
    value, score, curve, outer = passed(theta)
    converged = False
    for _ in range(rounds):
        ridge = 0.0
        while True:
            try:
                step = np.linalg.solve(curve + ridge * np.eye(k), score)
                if score @ step >= 0 and np.isfinite(step).all():
                    break
            except np.linalg.LinAlgError:
                pass
            ridge = max(1e-6 * max(1.0, np.abs(curve).max()), ridge * 10)
            if ridge > 1e12:
                raise AnalysisError("the likelihood has no curvature here")
        size = 1.0
        while size > 1e-6:
            new = passed(theta + size * step)
            if np.isfinite(new[0]) and new[0] >= value - 1e-9 * abs(value):
                break
            size /= 4
        else:
            break
        gain, theta = new[0] - value, theta + size * step
        value, score, curve, outer = new
        if abs(gain) < 1e-9 * (abs(value) + 1) and np.abs(size * step).max() < 1e-5 * (1 + np.abs(theta).max()):
            converged = True
            break
    try:
        cov = np.linalg.inv(curve)
    except np.linalg.LinAlgError:
        cov = np.full((k, k), np.nan)
    robust, cov = back @ cov @ outer @ cov @ back.T, back @ cov @ back.T
    return {"theta": back @ theta, "loglik": float(value), "cov": cov, "se": np.sqrt(np.maximum(np.diag(cov), 0)), "robust": robust, "converged": converged}
