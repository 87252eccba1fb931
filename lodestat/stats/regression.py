"""Linear, binary, count, censored, penalised and quantile regression."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.numeric import numbers
from ..operators.columns import POS, require
from ..operators.ranges import hull, quantiles as ranged, roc_points, with_previous
from .basic import as_list, jarque_bera
from .design import centred, centred_products, complete, counted, features_of, maximise, shifted, two_values
from .likelihoods import extra_parameters, ll_hurdle, ll_logit, ll_negative_binomial, ll_ordinal, ll_poisson, ll_probit, ll_tobit, ll_zero_inflated
from .result import AnalysisError, Result, analysis, hold, result, too_few

def table_of(names: list[str], theta: np.ndarray, se: np.ndarray, df: float | None = None, exp: str | None = None, level: float = 0.95) -> list[dict]:
    quantile = D.t_ppf(0.5 + level / 2, df) if df else D.normal_ppf(0.5 + level / 2)
    out = []
    for name, b, s in zip(names, theta.tolist(), se.tolist(), strict=False):
        t = b / s if s else None
        row = {"term": name, "coefficient": b, "standard_error": s, "statistic": t, "p_value": (2 * D.t_sf(abs(t), df) if df else 2 * D.normal_sf(abs(t))) if t is not None and math.isfinite(t) else None, "ci_low": b - quantile * s, "ci_high": b + quantile * s}
        if exp:
            row |= {exp: math.exp(min(b, 700)), f"{exp}_low": math.exp(min(row["ci_low"], 700)), f"{exp}_high": math.exp(min(row["ci_high"], 700))}
        out.append(row)
    return out


def fit_ols(rows: DataFrame, target: str, names: list[str]) -> dict:
    n, mean, s = centred_products(rows, [*names, target])
    k = len(names)
    if n <= k + 1:
        return {"n": int(n)}
    scale = np.sqrt(np.maximum(np.diag(s)[:k], 1e-300))
    try:
        # columns of unit length: units of measurement do not matter
        inner = np.linalg.inv(s[:k, :k] / np.outer(scale, scale)) / np.outer(scale, scale)
    except np.linalg.LinAlgError as e:
        raise AnalysisError("predictors are collinear") from e
    slopes = inner @ s[:k, k]
    inverse = np.zeros((k + 1, k + 1))
    inverse[1:, 1:] = inner
    inverse[0, 1:] = inverse[1:, 0] = -inner @ mean[:k]
    inverse[0, 0] = 1 / n + mean[:k] @ inner @ mean[:k]
    beta = np.concatenate([[mean[k] - slopes @ mean[:k]], slopes])
    total = s[k, k]
    rss = max(0.0, float(total - slopes @ s[:k, k]))
    rest = n - k - 1
    return {"n": int(n), "beta": beta, "rss": rss, "total": float(total), "df": rest, "cov": inverse * rss / rest, "inverse": inverse}


def fitted(rows: DataFrame, names: list[str], beta: np.ndarray, target: str) -> DataFrame:
    line = F.lit(float(beta[0]))
    for n, b in zip(names, beta[1:].tolist(), strict=True):
        line = line + F.col(f"`{n}`") * b
    return rows.withColumn("_fit", line).withColumn("_res", F.col(f"`{target}`") - line)


BANDS = 40


def residual_bands(res: DataFrame, low: float, high: float) -> list[dict]:
    """(band, n, fitted, residual, spread) of at most 40 bands of the fitted values."""
    if not high > low:
        return []
    band = F.least(F.floor((F.col("_fit") - low) / (high - low) * BANDS), F.lit(BANDS - 1))
    return [x.asDict() for x in res.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg("_fit").alias("fitted"), F.avg("_res").alias("residual"), F.stddev_samp("_res").alias("spread")).orderBy("band").collect()]


def residual_pattern(bands: list[dict]) -> dict:
    """Whether residuals drift, bend or widen over the fitted range.

    A quadratic is fitted to the means of the bands, weighted by their rows; drift and bend are its terms at two
    standard errors and more.  Residuals widen if the spread of the upper third of bands is half as large again as that of the lower.
    """
    if len(bands) < 4:
        return {"status": "insufficient"}
    x, y, w = (np.array([float(b[c] or 0) for b in bands]) for c in ("fitted", "residual", "n"))
    x = x - x.mean()
    design = np.column_stack([np.ones(len(x)), x, x * x - (x * x).mean()])
    scale = np.abs(design).max(0)
    scale[scale == 0] = 1
    gram = np.linalg.pinv((design / scale).T @ (w[:, None] * design / scale))
    beta = gram @ ((design / scale).T @ (w * y))
    left = y - design / scale @ beta
    variance = (w * left * left).sum() / (len(x) - 3)
    t = [float(b / math.sqrt(v)) if v > 0 else 0.0 for b, v in zip(beta, np.diag(gram) * variance, strict=True)]
    spread = np.array([b["spread"] or 0.0 for b in bands])
    third = max(len(bands) // 3, 1)
    low, high = float(spread[:third].mean()), float(spread[-third:].mean())
    flags = {"drift": abs(t[1]) >= 2, "bend": abs(t[2]) >= 2, "widening": len(bands) >= 6 and high >= 1.5 * low and high - low > 0.25}
    return {"status": "warn" if any(flags.values()) else "pass", **flags, "slope": beta[1] / scale[1], "t_slope": t[1], "curvature": beta[2] / scale[2], "t_curvature": t[2], "spread_growth": high - low}


def breusch_pagan(res: DataFrame, names: list[str]) -> dict:
    """n times R^2 of the squared residuals on the features."""
    f = fit_ols(res.withColumn("_square", F.col("_res") * F.col("_res")), "_square", names)
    if "beta" not in f or not f["total"]:
        return {"statistic": None, "df": len(names), "p_value": None}
    lm = f["n"] * (1 - f["rss"] / f["total"])
    return {"statistic": lm, "df": len(names), "p_value": D.chi2_sf(lm, len(names))}


def _sandwich(inverse: np.ndarray, meat: np.ndarray, factor: float) -> np.ndarray:
    return np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse) * factor, 0))


def _symmetric(row: Any, size: int) -> np.ndarray:
    m = np.zeros((size, size))
    for (i, j), v in zip([(i, j) for i in range(size) for j in range(i, size)], row, strict=True):
        m[i, j] = m[j, i] = v or 0.0
    return m


def cluster_errors(res: DataFrame, names: list[str], cluster: str, f: dict) -> tuple[np.ndarray, int]:
    """CR1 standard errors and the number of clusters: scores are added up by cluster, their products over clusters."""
    k = len(names) + 1
    c = [F.col("_res"), *[F.col(f"`{n}`") * F.col("_res") for n in names]]
    sums = res.groupBy(F.col(f"`{cluster}`").cast("string").alias("_cluster")).agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate(c)])
    r = sums.agg(F.count("*"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(k) for j in range(i, k)]).first()
    groups = r[0]
    if groups < 2:
        return np.full(k, np.nan), groups
    return _sandwich(f["inverse"], _symmetric(r[1:], k), groups / (groups - 1) * (f["n"] - 1) / f["df"]), groups


def jackknife_errors(res: DataFrame, names: list[str], f: dict) -> np.ndarray:
    """Delete-one jackknife: each row's leave-one-out coefficients follow from its leverage, so one pass adds them up."""
    k = len(names) + 1
    x = [F.lit(1.0), *[F.col(f"`{n}`") for n in names]]
    inverse = f["inverse"].tolist()
    leverage = sum((x[i] * x[j] * inverse[i][j] for i in range(k) for j in range(k)), F.lit(0.0))
    share = F.try_divide(F.col("_res"), 1 - leverage)
    shift = [sum((x[j] * inverse[i][j] for j in range(k)), F.lit(0.0)) * share for i in range(k)]
    r = res.agg(*[F.var_pop(s) for s in shift]).first()
    return np.sqrt(np.array([v or 0.0 for v in r]) * (f["n"] - 1))


@analysis("linear_regression")
def linear_regression(df: DataFrame, target: str | None = None, y: str | None = None, confidence_level: float = 0.95, cluster_column: str | None = None, jackknife: bool = False, **p: Any) -> Result:
    """Least squares with residual diagnostics; CR1 errors with ``cluster_column``, delete-one errors with ``jackknife``."""
    target = require(df, [target or y])[0]
    names = [n for n in features_of(df, target, p) if n != cluster_column]
    keep = [POS] if POS in df.columns else []
    rows = complete(df, [target, *names, *keep])
    if cluster_column:
        own = require(df, [cluster_column])[0]
        rows = df.select(*numbers(df, target, *names, *keep), F.col(f"`{own}`").alias("_cluster_of")).dropna()
    f = fit_ols(rows, target, names)
    if "beta" not in f:
        return too_few("linear_regression", f["n"], len(names) + 2)
    n, k, rss, total = f["n"], len(names), f["rss"], f["total"]
    r2 = 1 - rss / total if total else None
    stat = (total - rss) / k / (rss / f["df"]) if rss else None
    res = fitted(rows, names, f["beta"], target)
    sd = math.sqrt(rss / n) or 1.0
    parts = [F.avg(F.pow(F.col("_res") / sd, 3)).alias("m3"), F.avg(F.pow(F.col("_res") / sd, 4)).alias("m4"), F.min("_fit").alias("lo"), F.max("_fit").alias("hi")]
    r = res.agg(*parts).first()
    durbin = lag = None
    if keep and rss:
        both = with_previous(res.select(POS, "_res"), POS, "_res")
        d = both.agg(F.sum(F.pow(F.col("_res") - F.col("_res_before"), 2)).alias("d"), F.sum(F.col("_res") * F.col("_res_before")).alias("l")).first()
        durbin, lag = (d.d / rss, d.l / rss) if d.d is not None else (None, None)
    bands = residual_bands(res, r.lo, r.hi)
    more: dict[str, Any] = {}
    terms, df_rest = ["intercept", *names], f["df"]
    if cluster_column:
        se, groups = cluster_errors(res, names, "_cluster_of", f)
        more = {"cluster_robust": table_of(terms, f["beta"], se, max(groups - 1, 1), level=confidence_level)}
    if jackknife:
        more["jackknife"] = table_of(terms, f["beta"], jackknife_errors(res, names, f), df_rest, level=confidence_level)
    return result("linear_regression", n, {"r_squared": r2, "adjusted_r_squared": 1 - (1 - r2) * (n - 1) / df_rest if r2 is not None else None, "rmse": math.sqrt(rss / df_rest)}, {"statistic": stat, "df1": k, "df2": df_rest, "p_value": D.f_sf(stat, k, df_rest) if stat else None}, diagnostics={"aic": n * math.log(rss / n) + 2 * (k + 1) if rss else None, "bic": n * math.log(rss / n) + math.log(n) * (k + 1) if rss else None, "durbin_watson": durbin, "lag_correlation": lag, "jarque_bera": jarque_bera(n, r.m3, r.m4 - 3), "breusch_pagan": breusch_pagan(res, names) if rss else None, "residual_pattern": residual_pattern(bands)}, tables={"coefficients": table_of(terms, f["beta"], np.sqrt(np.diag(f["cov"])), df_rest, level=confidence_level), "residual_bands": bands, **more})


@analysis("linear_probability_model")
def linear_probability(df: DataFrame, target: str, positive_category: Any = None, **p: Any) -> Result:
    rows, positive = two_values(df, target, positive_category)
    names = features_of(df, target, p)
    rows = complete(rows, ["_y", *names])
    f = fit_ols(rows, "_y", names)
    if "beta" not in f:
        return too_few("linear_probability_model", f["n"], len(names) + 2)
    res = fitted(rows, names, f["beta"], "_y")
    # the meat X' diag(e^2) X is a cross product of columns times residuals
    k = len(names)
    c = [F.col("_res"), *[F.col(f"`{n}`") * F.col("_res") for n in names]]
    at = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    r = res.agg(*[F.sum(c[i] * c[j]) for i, j in at]).first()
    meat = np.zeros((k + 1, k + 1))
    for (i, j), v in zip(at, r, strict=True):
        meat[i, j] = meat[j, i] = v
    cov = f["inverse"] @ meat @ f["inverse"] * f["n"] / f["df"]
    return result("linear_probability_model", f["n"], {"positive": positive, "r_squared": 1 - f["rss"] / f["total"] if f["total"] else None}, tables={"hc1": table_of(["intercept", *names], f["beta"], np.sqrt(np.diag(cov)), f["df"])})


def roc_table(scored: DataFrame, link=None) -> tuple[float | None, list[dict]]:
    """The exact area under the curve of (s, y), and at most 200 points of it; ``link`` turns thresholds into probabilities."""
    points, area = roc_points(scored)
    rows = [r.asDict() for r in points.orderBy("fpr", "tpr").collect()]
    for r, corner in zip(rows, hull([(r["fpr"] or 0.0, r["tpr"] or 0.0) for r in rows]), strict=True):
        r |= {"on_hull": corner, "threshold": link(r["threshold"]) if link else r["threshold"]}
    return area.first().auc, rows


def area_under_curve(scored: DataFrame) -> float | None:
    """From (s, y), exact with ties."""
    return roc_points(scored)[1].first().auc


def _binary(kind: str, df: DataFrame, target: str, positive: Any, loglik, threshold: float, p: dict, exp: str | None) -> Result:
    rows, label = two_values(df, target, positive)
    names = features_of(df, target, p)
    rows = hold(complete(rows, ["_y", *names]))
    n, ones = rows.agg(F.count("*"), F.sum("_y")).first()
    if n < len(names) + 2 or not 0 < (ones or 0) < n:
        return too_few(kind, n, len(names) + 2)
    fit = maximise(rows, "_y", names, loglik, np.zeros(len(names) + 1))
    share = ones / n
    null = n * (share * math.log(share) + (1 - share) * math.log(1 - share))
    eta = F.lit(float(fit["theta"][0]))
    for c, b in zip(names, fit["theta"][1:].tolist(), strict=True):
        eta = eta + F.col(f"`{c}`") * b
    # both links are increasing: the line itself orders the rows
    cut = math.log(threshold / (1 - threshold)) if loglik is ll_logit else D.normal_ppf(threshold)
    hits = rows.groupBy("_y", (eta >= cut).alias("hit")).count().collect()
    at = {(int(r["_y"]), r.hit): r["count"] for r in hits}
    snell = 1 - math.exp(2 / n * (null - fit["loglik"]))
    auc, curve = roc_table(rows.select(eta.alias("s"), F.col("_y").alias("y")), (lambda v: 1 / (1 + math.exp(-max(v, -700)))) if loglik is ll_logit else lambda v: D.normal_sf(-v))
    return result(kind, n, {"positive": label, "mcfadden_r2": 1 - fit["loglik"] / null, "cox_snell_r2": snell, "nagelkerke_r2": snell / (1 - math.exp(2 / n * null)), "auc": auc, "log_likelihood": fit["loglik"]}, {"statistic": 2 * (fit["loglik"] - null), "df": len(names), "p_value": D.chi2_sf(2 * (fit["loglik"] - null), len(names))}, diagnostics={"converged": fit["converged"], "aic": 2 * (len(names) + 1) - 2 * fit["loglik"]}, tables={"coefficients": table_of(["intercept", *names], fit["theta"], fit["se"], exp=exp), "confusion": {"true_positive": at.get((1, True), 0), "false_positive": at.get((0, True), 0), "true_negative": at.get((0, False), 0), "false_negative": at.get((1, False), 0)}, "roc": curve})


@analysis("logistic_regression")
def logistic_regression(df: DataFrame, target: str, positive_value: Any = None, threshold: float = 0.5, **p: Any) -> Result:
    return _binary("logistic_regression", df, target, positive_value, ll_logit, threshold, p, "odds_ratio")


@analysis("probit")
def probit(df: DataFrame, target: str, positive_category: Any = None, **p: Any) -> Result:
    return _binary("probit", df, target, positive_category, ll_probit, 0.5, p, None)


def _counts(df: DataFrame, target: str, p: dict) -> tuple[DataFrame, list[str], list[str]]:
    """Rows with _off, the log of the exposure (0 without one); names of features, and those with _off in front."""
    exposure = p.get("exposure") or p.get("exposure_column") or p.get("offset_column")
    names = [c for c in features_of(df, target, p) if c != exposure]
    rows = complete(df, [target, *names, *([exposure] if exposure else [])])
    rows = rows.where(F.col(f"`{exposure}`") > 0).withColumn("_off", F.log(f"`{exposure}`")) if exposure else rows.withColumn("_off", F.lit(0.0))
    return hold(rows.where(F.col(f"`{target}`") >= 0)), names, ["_off", *names]


def _start_counts(rows: DataFrame, target: str, k: int) -> np.ndarray:
    mean = rows.agg(F.sum(f"`{target}`") / F.sum(F.exp("_off"))).first()[0] or 1.0
    return np.concatenate([[math.log(max(mean, 1e-6))], np.zeros(k)])


@analysis("poisson_regression")
def poisson_regression(df: DataFrame, target: str, **p: Any) -> Result:
    rows, names, columns = _counts(df, target, p)
    n, mean, var, zeros = rows.agg(F.count("*"), F.avg(f"`{target}`"), F.var_samp(f"`{target}`"), F.avg((F.col(f"`{target}`") == 0).cast("double"))).first()
    if n < len(names) + 2:
        return too_few("poisson_regression", n, len(names) + 2)
    fit = maximise(rows, target, columns, ll_poisson, _start_counts(rows, target, len(names)))
    mu = F.lit(float(fit["theta"][0])) + F.col("_off")
    for c, b in zip(names, fit["theta"][1:].tolist(), strict=True):
        mu = mu + F.col(f"`{c}`") * b
    pearson = rows.agg(F.sum(F.pow(F.col(f"`{target}`") - F.exp(mu), 2) / F.exp(mu))).first()[0]
    return result("poisson_regression", n, {"log_likelihood": fit["loglik"], "dispersion": pearson / (n - len(names) - 1) if n > len(names) + 1 else None}, diagnostics={"variance_to_mean": var / mean if mean else None, "zero_share": zeros, "converged": fit["converged"]}, tables={"coefficients": table_of(["intercept", *names], fit["theta"], fit["se"], exp="rate_ratio")})


@analysis("negative_binomial")
def negative_binomial(df: DataFrame, target: str, **p: Any) -> Result:
    rows, names, columns = _counts(df, target, p)
    n = rows.count()
    if n < len(names) + 3:
        return too_few("negative_binomial", n, len(names) + 3)
    base = maximise(rows, target, columns, ll_poisson, _start_counts(rows, target, len(names)))
    fit = maximise(rows, target, columns, ll_negative_binomial, np.append(base["theta"], -1.0))
    ratio = max(0.0, 2 * (fit["loglik"] - base["loglik"]))
    k = len(names) + 2
    return result("negative_binomial", n, {"alpha": math.exp(fit["theta"][-1]), "log_likelihood": fit["loglik"]}, {"statistic": ratio, "df": 1, "p_value": D.chi2_sf(ratio, 1) / 2, "against": "poisson"}, diagnostics={"aic": 2 * k - 2 * fit["loglik"], "bic": math.log(n) * k - 2 * fit["loglik"], "converged": fit["converged"]}, tables={"coefficients": table_of(["intercept", *names], fit["theta"][:-1], fit["se"][:-1], exp="rate_ratio")})


def _two_part(kind: str, df: DataFrame, target: str, distribution: str, make, p: dict, second: str) -> Result:
    rows, names, columns = _counts(df, target, p)
    n, zeros = rows.agg(F.count("*"), F.coalesce(F.avg((F.col(f"`{target}`") == 0).cast("double")), F.lit(0.0))).first()
    k = len(names) + 1
    if n < 2 * k + 1 or not 0 < zeros < 1:
        return too_few(kind, n, 2 * k + 1)
    extra = extra_parameters(distribution)
    base = maximise(rows, target, columns, ll_poisson, _start_counts(rows, target, len(names)))
    share = max(0.05, min(0.95, zeros)) if kind == "hurdle" else max(0.05, min(0.9, zeros / 2))
    logit = math.log((1 - share) / share) if kind == "hurdle" else math.log(share / (1 - share))
    fit = maximise(rows, target, columns, make(distribution, k), np.concatenate([base["theta"], [-0.5] * extra, [logit], np.zeros(k - 1)]), blocks=(0, k + extra))
    cut = k + extra
    terms = ["intercept", *names]
    return result(kind, n, {"log_likelihood": fit["loglik"], "poisson_log_likelihood": base["loglik"], "alpha": math.exp(fit["theta"][k]) if extra else None}, diagnostics={"aic": 2 * len(fit["theta"]) - 2 * fit["loglik"], "zero_share": zeros, "converged": fit["converged"]}, tables={"count": table_of(terms, fit["theta"][:k], fit["se"][:k], exp="rate_ratio"), second: table_of(terms, fit["theta"][cut:], fit["se"][cut:], exp="odds_ratio")}, distribution=distribution)


@analysis("zero_inflated")
def zero_inflated(df: DataFrame, target: str, distribution: str = "poisson", **p: Any) -> Result:
    return _two_part("zero_inflated", df, target, distribution, ll_zero_inflated, p, "zero")


@analysis("hurdle")
def hurdle(df: DataFrame, target: str, distribution: str = "poisson", **p: Any) -> Result:
    return _two_part("hurdle", df, target, distribution, ll_hurdle, p, "any")


@analysis("tobit")
def tobit(df: DataFrame, target: str, threshold: float | None = None, censoring_value: float | None = None, censor_type: str | None = None, side: str | None = None, **p: Any) -> Result:
    limit = threshold if threshold is not None else censoring_value
    if limit is None:
        raise AnalysisError("tobit needs the censoring value")
    names = features_of(df, target, p)
    rows = hold(complete(df, [target, *names]))
    f = fit_ols(rows, target, names)
    if "beta" not in f:
        return too_few("tobit", f["n"], len(names) + 2)
    right = (censor_type or side or "left") in ("right", "upper")
    y = F.col(f"`{target}`")
    censored = rows.where(y >= float(limit) if right else y <= float(limit)).count()
    fit = maximise(rows, target, names, ll_tobit(float(limit), right), np.append(f["beta"], 0.5 * math.log(max(f["rss"] / f["df"], 1e-12))))
    return result("tobit", f["n"], {"sigma": math.exp(fit["theta"][-1]), "log_likelihood": fit["loglik"], "censored": censored}, diagnostics={"converged": fit["converged"]}, tables={"coefficients": table_of(["intercept", *names], fit["theta"][:-1], fit["se"][:-1])})


@analysis("ordinal_logit")
def ordinal_logit(df: DataFrame, target: str, **p: Any) -> Result:
    """Levels are in order of numbers if all are numbers, else of text."""
    names = features_of(df, target, p)
    found = [r.v for r in df.where(F.col(f"`{target}`").isNotNull()).select(F.col(f"`{target}`").cast("string").alias("v")).distinct().limit(101).collect()]
    try:
        levels = sorted(found, key=float)
    except ValueError:
        levels = sorted(found)
    if not 3 <= len(levels) <= 100:
        raise AnalysisError("an ordinal target takes 3 to 100 levels")
    number = F.create_map(*[F.lit(v) for k, level in enumerate(levels) for v in (level, float(k))])
    rows = hold(complete(df.withColumn("_y", number[F.col(f"`{target}`").cast("string")]), ["_y", *names]))
    counts = {int(r._y): r["count"] for r in rows.groupBy("_y").count().collect()}
    n = sum(counts.values())
    if len(counts) != len(levels) or n < len(names) + len(levels):
        return too_few("ordinal_logit", n, len(names) + len(levels))
    share = np.cumsum([counts[k] for k in range(len(levels) - 1)]) / n
    cuts = np.log(share / (1 - share))
    fit = maximise(rows, "_y", names, ll_ordinal(), np.concatenate([np.zeros(len(names)), cuts[:1], np.log(np.diff(cuts))]), intercept=False)
    k = len(names)
    null = sum(c * math.log(c / n) for c in counts.values())
    cut = (fit["theta"][k] + np.concatenate([[0.0], np.cumsum(np.exp(fit["theta"][k + 1 :]))])).tolist()
    return result("ordinal_logit", n, {"log_likelihood": fit["loglik"], "mcfadden_r2": 1 - fit["loglik"] / null}, {"statistic": 2 * (fit["loglik"] - null), "df": k, "p_value": D.chi2_sf(max(0.0, 2 * (fit["loglik"] - null)), k)}, diagnostics={"converged": fit["converged"]}, tables={"coefficients": table_of(names, fit["theta"][:k], fit["se"][:k], exp="odds_ratio"), "cuts": dict(zip(levels, cut, strict=False))})


@analysis("ridge_regression")
def ridge_regression(df: DataFrame, target: str, alpha: float = 1.0, test_size: float = 0.2, seed: int = 42, **p: Any) -> Result:
    """Closed form on standardised features, the intercept free; test rows by a hash."""
    names = features_of(df, target, p)
    rows = complete(df, [target, *names])
    rows = rows.withColumn("_u", F.pmod(F.xxhash64(*[f"`{c}`" for c in rows.columns], F.lit(seed)), F.lit(1_000_000)) / 1_000_000)
    train, test = rows.where(F.col("_u") >= test_size), rows.where(F.col("_u") < test_size)
    n, mean, s = centred_products(train, [*names, target])
    k = len(names)
    if n < k + 2:
        return too_few("ridge_regression", int(n), k + 2)
    sd = np.sqrt(np.diag(s)[:k] / n)
    sd[sd == 0] = 1
    b = np.linalg.solve(s[:k, :k] / np.outer(sd, sd) + alpha * np.eye(k), s[:k, k] / sd) / sd
    beta = np.concatenate([[mean[k] - b @ mean[:k]], b])
    return result("ridge_regression", int(n), {"alpha": alpha, **errors_of(test, names, beta, target)}, tables={"coefficients": dict(zip(["intercept", *names], beta.tolist(), strict=True))})


def errors_of(test: DataFrame, names: list[str], beta: np.ndarray, target: str) -> dict:
    e, y = F.col("_res"), F.col(f"`{target}`")
    r = fitted(test, names, beta, target).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("v")).first()
    return {"test_rows": r.n, "mse": r.mse, "mae": r.mae, "r_squared": 1 - r.mse / r.v if r.v else None}


def elastic_net(s: np.ndarray, c: np.ndarray, lam: float, ratio: float, start: np.ndarray) -> np.ndarray:
    """Coordinate descent on (1/2) b'Sb - c'b + lam (ratio |b| + (1 - ratio) b^2 / 2), S a correlation matrix."""
    b = start.copy()
    for _ in range(2000):
        last = b.copy()
        for j in range(len(b)):
            r = c[j] - s[j] @ b + s[j, j] * b[j]
            b[j] = math.copysign(max(abs(r) - lam * ratio, 0.0), r) / (s[j, j] + lam * (1 - ratio))
        if np.abs(b - last).max() < 1e-10:
            break
    return b


@analysis("ridge_lasso")
def ridge_lasso(df: DataFrame, target: str, penalty: str = "lasso", l1_ratio: float | None = None, alphas: Any = None, folds: int = 5, seed: int = 42, **p: Any) -> Result:
    """Elastic net, cross-validated from one pass: each fold's cross products give all fits and all errors."""
    ratio = {"ridge": 0.0, "lasso": 1.0}.get(penalty, 0.5) if l1_ratio is None else float(l1_ratio)
    names = features_of(df, target, p)
    rows = complete(df, [target, *names])
    columns = [*names, target]
    k = len(names)
    c = [F.lit(1.0), *[F.col(f"`{n}`") for n in columns]]
    at = [(i, j) for i in range(k + 2) for j in range(i, k + 2)]
    fold = F.pmod(F.xxhash64(*[f"`{x}`" for x in columns], F.lit(seed)), F.lit(folds))
    # products of columns less their means; the intercept takes the means back at the end
    rows, origin = shifted(rows.withColumn("_fold", fold), columns)
    parts = []
    for r in rows.groupBy("_fold").agg(*[F.sum(c[i] * c[j]).alias(f"s{i}_{j}") for i, j in at]).collect():
        m = np.zeros((k + 2, k + 2))
        for i, j in at:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        parts.append(m)
    whole = sum(parts) if parts else np.zeros((k + 2, k + 2))
    n = whole[0, 0]
    if n < 10 or len(parts) < 2:
        return too_few("ridge_lasso", int(n), 10)

    def standard(m: np.ndarray):
        size, mean, s = centred(m)
        sd = np.sqrt(np.diag(s)[:k] / size)
        sd[sd == 0] = 1
        return mean, sd, s[:k, :k] / np.outer(sd, sd) / size, s[:k, k] / sd / size

    def path(m: np.ndarray, grid: list[float]) -> list[np.ndarray]:
        mean, sd, s, cy = standard(m)
        b, out = np.zeros(k), []
        for lam in grid:
            b = elastic_net(s, cy, lam, ratio, b)
            own = b / sd
            out.append(np.concatenate([[mean[k] - own @ mean[:k]], own]))
        return out

    top = np.abs(standard(whole)[3]).max() / max(ratio, 1e-3)
    grid = sorted(map(float, as_list(alphas)), reverse=True) if alphas is not None else np.geomspace(max(top, 1e-8), max(top, 1e-8) * 1e-4, 25).tolist()
    error = np.zeros(len(grid))
    for m in parts:
        for i, b in enumerate(path(whole - m, grid)):
            w = np.append(-b, 1.0)
            error[i] += w @ m @ w
    best = int(error.argmin())
    beta = path(whole, grid)[best]
    beta[0] += origin[k] - beta[1:] @ origin[:k]
    return result("ridge_lasso", int(n), {"alpha": grid[best], "l1_ratio": ratio, "cv_mse": error[best] / n, "kept": int((np.abs(beta[1:]) > 1e-10).sum())}, tables={"coefficients": dict(zip(["intercept", *names], beta.tolist(), strict=True)), "path": [{"alpha": a, "cv_mse": e / n} for a, e in zip(grid, error.tolist(), strict=True)]})


@analysis("quantile_regression")
def quantile_regression(df: DataFrame, target: str, quantiles: Any = None, tau: Any = None, rounds: int = 60, **p: Any) -> Result:
    """Iteratively reweighted least squares on a smoothed pinball loss; all quantiles share each pass."""
    taus = [float(q) for q in as_list(quantiles if quantiles is not None else tau)] if not isinstance(quantiles if quantiles is not None else tau, (int, float)) else [float(quantiles if quantiles is not None else tau)]
    taus = taus or [0.1, 0.25, 0.5, 0.75, 0.9]
    names = features_of(df, target, p)
    rows = hold(complete(df, [target, *names]))
    f = fit_ols(rows, target, names)
    if "beta" not in f:
        return too_few("quantile_regression", f["n"], len(names) + 2)
    k, eps = len(names) + 1, 1e-6 * math.sqrt(f["total"] / f["n"] or 1)
    beta = np.tile(f["beta"], (len(taus), 1))
    distinct = counted(rows, list(dict.fromkeys([target, *names])))
    for _ in range(rounds):
        def run(batches: Iterable[pd.DataFrame], beta=beta) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(taus), k, k + 1))
            for b in batches:
                x, y, times = np.column_stack([np.ones(len(b)), b[names].to_numpy(float)]), b[target].to_numpy(float), b["_times"].to_numpy(float)
                for i, t in enumerate(taus):
                    r = y - x @ beta[i]
                    w = times * np.where(r > 0, t, 1 - t) / np.maximum(np.abs(r), eps)
                    total[i, :, :k] += (x * w[:, None]).T @ x
                    total[i, :, k] += x.T @ (w * y)
            yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

        got = distinct.mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").toPandas()["v"].to_numpy().reshape(len(taus), k, k + 1)
        new = np.array([np.linalg.solve(m[:, :k], m[:, k]) for m in got])
        done, beta = np.abs(new - beta).max() < 1e-6 * (1 + np.abs(beta).max()), new
        if done:
            break
    se, sparse = quantile_errors(rows, target, names, taus, beta, f)
    terms = ["intercept", *names]
    warnings = [f"no rows near the line of quantile {t:g}: no standard errors" for t, s in zip(taus, sparse, strict=True) if s is None]
    if min(taus) >= 0.25 and max(taus) <= 0.75:
        warnings.append("all quantiles lie in the middle; tails such as 0.1 and 0.9 may differ more")
    if f["n"] < 10 * k:
        warnings.append("fewer than ten rows for each parameter: tails are uncertain")
    by_term = [{"quantile": t, **row} for t, b, e in zip(taus, beta, se, strict=True) for row in table_of(terms, b, e)]
    return result("quantile_regression", f["n"], tables={"coefficients": [{"quantile": t, **dict(zip(terms, b.tolist(), strict=True))} for t, b in zip(taus, beta, strict=True)], "by_quantile": by_term}, diagnostics={"density_at_zero": dict(zip(map(str, taus), sparse, strict=True))}, warnings=warnings)


def hall_sheather(tau: float, n: int, alpha: float = 0.05) -> float:
    """The bandwidth for the density at a quantile, as a share, kept inside (0, 1) around ``tau``."""
    z = D.normal_ppf(tau)
    density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    h = n ** (-1 / 3) * D.normal_ppf(1 - alpha / 2) ** (2 / 3) * (1.5 * density**2 / (2 * z * z + 1)) ** (1 / 3)
    return min(h, 0.99 * min(tau, 1 - tau))


def quantile_errors(rows: DataFrame, target: str, names: list[str], taus: list[float], beta: np.ndarray, f: dict) -> tuple[list[np.ndarray], list[float | None]]:
    """Standard errors of each quantile's coefficients, and the density of its residuals at zero.

    The sandwich is tau (1 - tau) D^-1 X'X D^-1 with D = X'KX, K an Epanechnikov kernel around zero.
    Its width comes from the spread of the residuals, the smaller of their standard deviation and their quartiles' distance, which
    are quantiles over ranges; D of all quantiles comes from one pass.
    """
    k, n = len(names) + 1, f["n"]
    line = lambda b: F.lit(float(b[0])) + sum((F.col(f"`{c}`") * float(v) for c, v in zip(names, b[1:], strict=True)), F.lit(0.0))
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.col(f"`{target}`") - line(b)).alias("v")) for i, b in enumerate(beta)])).alias("x")).select("x.*")
    quartiles = {r.i: r.q for r in ranged(long, [0.25, 0.75], ["i"]).collect()}
    spread = {r.i: r.s for r in long.groupBy("i").agg(F.stddev_samp("v").alias("s")).collect()}
    widths = []
    for i, t in enumerate(taus):
        h, iqr = hall_sheather(t, n), quartiles[i][1] - quartiles[i][0]
        widths.append((min(spread[i], iqr / 1.34) if iqr > 0 else spread[i]) * (D.normal_ppf(t + h) - D.normal_ppf(t - h)))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(taus) + 1, k, k))
        for b in batches:
            x, y = np.column_stack([np.ones(len(b)), b[names].to_numpy(float)]), b[target].to_numpy(float)
            total[-1] += x.T @ x
            for i, w in enumerate(widths):
                u = (y - x @ beta[i]) / w if w else np.full(len(y), np.inf)
                weight = np.where(np.abs(u) < 1, 0.75 * (1 - u * u) / (w or 1), 0.0)
                total[i] += (x * weight[:, None]).T @ x
        yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

    got = rows.mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").toPandas()["v"].to_numpy().reshape(-1, k, k)
    errors: list[np.ndarray] = []
    density: list[float | None] = []
    for t, d in zip(taus, got[:-1], strict=True):
        try:
            bread = np.linalg.inv(d)
            errors.append(np.sqrt(np.maximum(np.diag(bread @ got[-1] @ bread) * t * (1 - t), 0)))
            density.append(float(d[0, 0] / n))
        except np.linalg.LinAlgError:
            errors.append(np.full(k, np.nan))
            density.append(None)
    return errors, density
