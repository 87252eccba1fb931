"""Descriptives, ranks, and tests of means and ranks, all from grouped aggregates.

Each statistic has a DataFrame step that Spark aggregates (public, so that it
can be queried) and a last step on the driver that turns a few numbers into p-values.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.numeric import dtype, is_numeric_type, numbers
from ..operators.columns import public, require
from ..operators.ranges import quantiles as ranged
from ..operators.ranges import running_totals
from ..storage import remove, written
from .result import AnalysisError, Result, analysis, result, too_few


#: Groups and cells of a result's tables.
SHOWN = 10_000


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in public(df) if is_numeric_type(dtype(df, c))]


def as_list(x: Any) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def grouped(df: DataFrame, value: str, group: str) -> DataFrame:
    """(g, v) of rows that have both."""
    require(df, [value, group])
    return df.select(F.col(f"`{group}`").cast("string").alias("g"), numbers(df, value)[0].alias("v")).dropna()


def moments(df: DataFrame, columns: list[str], quantiles: bool = True) -> DataFrame:
    """A row for each column: n, mean, sd, min, q1, median, q3, max, sum, skewness, kurtosis; without ``quantiles`` no quartiles.

    One aggregation over all columns, and two passes for their quartiles.  Skewness and kurtosis divide by powers of
    the sample standard deviation.
    """
    parts, quartiles = [], {}
    if quantiles:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(name).alias("c"), c.alias("v")) for name, c in zip(columns, numbers(df, *columns), strict=True)])).alias("x")).select("x.*")
        quartiles = {r.c: r.q for r in ranged(long, [0.25, 0.5, 0.75], ["c"]).collect()}
    for name, c in zip(columns, numbers(df, *columns), strict=True):
        n = F.count(c)
        ratio = F.sqrt((n - 1) / n)
        q = F.array(*[F.lit(x).cast("double") for x in quartiles.get(name, [None] * 3)])
        parts.append(F.struct(F.lit(name).alias("column"), n.alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("min"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), F.max(c).alias("max"), F.sum(c).alias("sum"), (F.skewness(c) * F.pow(ratio, 3)).alias("skewness"), ((F.kurtosis(c) + 3) * F.pow(ratio, 4) - 3).alias("kurtosis")))
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("r")).select("r.*")


def jarque_bera(n: int, skewness: float | None, kurtosis: float | None) -> dict:
    if n < 8 or skewness is None or kurtosis is None:
        return {"statistic": None, "p_value": None, "normal": None}
    jb = n / 6 * (skewness**2 + kurtosis**2 / 4)
    p = D.chi2_sf(jb, 2)
    return {"statistic": jb, "p_value": p, "normal": p > 0.05}


@analysis("descriptive")
def descriptive(df: DataFrame, columns: Any = None, confidence_level: float = 0.95, **_: Any) -> Result:
    names = require(df, as_list(columns)) if columns else numeric_columns(df)
    rows = [r.asDict() for r in moments(df, names).collect()]
    for r in rows:
        n, sd = r["n"], r["sd"]
        modes = df.select(numbers(df, r["column"])[0].alias("v")).dropna().groupBy("v").count().orderBy(F.desc("count"), "v").limit(2).collect()
        r["mode"] = None if not modes or len(modes) > 1 and modes[0]["count"] == modes[1]["count"] else modes[0].v
        if n > 1 and sd is not None:
            half = D.t_ppf(0.5 + confidence_level / 2, n - 1) * sd / math.sqrt(n)
            r |= {"variance": sd * sd, "standard_error": sd / math.sqrt(n), "ci_low": r["mean"] - half, "ci_high": r["mean"] + half}
    return result("descriptive", max((r["n"] for r in rows), default=0), tables={"descriptives": rows})


@analysis("normality_tests")
def normality(df: DataFrame, columns: Any = None, column: Any = None, **_: Any) -> Result:
    names = as_list(columns or column) or numeric_columns(df)
    rows = []
    for r in moments(df, names).collect():
        lo, hi = (r.q1 - 1.5 * (r.q3 - r.q1), r.q3 + 1.5 * (r.q3 - r.q1)) if r.n else (None, None)
        c = numbers(df, r.column)[0]
        outliers = df.where((c < lo) | (c > hi)).count() if r.n else 0
        rows.append({"column": r.column, "n": r.n, "skewness": r.skewness, "kurtosis": r.kurtosis, **jarque_bera(r.n, r.skewness, r.kurtosis), "outlier_percent": 100 * outliers / r.n if r.n else None})
    return result("normality_test", max((r["n"] for r in rows), default=0), tables={"normality": rows})


def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    """(g, n, mean, var) of each group."""
    return grouped(df, value, group).groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))


def welch(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row for the two groups in order of their labels: n, mean and variance of each, t and df."""
    g = group_moments(df, value, group).agg(F.sort_array(F.collect_list(F.struct("g", "n", "mean", "var"))).alias("x")).select(F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
    va, vb = F.col("a.var") / F.col("a.n"), F.col("b.var") / F.col("b.n")
    return g.select("a.g", F.col("a.n").alias("n1"), F.col("a.mean").alias("mean1"), F.col("a.var").alias("var1"), F.col("b.n").alias("n2"), F.col("b.mean").alias("mean2"), F.col("b.var").alias("var2"), F.try_divide(F.col("a.mean") - F.col("b.mean"), F.sqrt(va + vb)).alias("t"), F.try_divide(F.pow(va + vb, 2), F.try_divide(va * va, F.col("a.n") - 1) + F.try_divide(vb * vb, F.col("b.n") - 1)).alias("df"))


def anova_parts(g: DataFrame) -> DataFrame:
    """One row of (n, k, between, within, f) from rows (g, v)."""
    per = g.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s"))
    total = per.agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("raw"), F.sum((F.col("n") - 1) * F.coalesce("s", F.lit(0.0))).alias("within"), F.collect_list(F.struct("n", "m")).alias("x"))
    between = F.aggregate("x", F.lit(0.0), lambda acc, r: acc + r.n * (r.m - F.col("grand")) * (r.m - F.col("grand")))
    out = total.select("n", "k", between.alias("between"), "within")
    return out.withColumn("f", F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))))


def brown_forsythe(g: DataFrame) -> DataFrame:
    """ANOVA of distances to the group's median; there are as many medians as groups."""
    centre = ranged(g, [0.5], ["g"]).select("g", F.col("q")[0].alias("c"))
    return anova_parts(g.join(centre, "g").select("g", F.abs(F.col("v") - F.col("c")).alias("v")))


def _levene(g: DataFrame) -> dict:
    r = brown_forsythe(g).first()
    if r.f is None:
        return {"statistic": None, "p_value": None}
    return {"statistic": r.f, "p_value": D.f_sf(r.f, r.k - 1, r.n - r.k)}


@analysis("welch_t_test")
def welch_t_test(df: DataFrame, value_column: str | None = None, group_column: str | None = None, value: str | None = None, group: str | None = None, alternative: str = "two-sided", confidence_level: float = 0.95, **_: Any) -> Result:
    value, group = value_column or value, group_column or group
    g = grouped(df, value, group)
    labels = [r.g for r in g.groupBy("g").count().orderBy("g").limit(3).collect()]
    if len(labels) != 2:
        raise AnalysisError("Welch's test compares exactly two groups")
    r = welch(df, value, group).first()
    if min(r.n1, r.n2) < 2 or r.t is None:
        return too_few("welch_t_test", r.n1 + r.n2)
    diff, se = r.mean1 - r.mean2, math.sqrt(r.var1 / r.n1 + r.var2 / r.n2)
    half = D.t_ppf(0.5 + confidence_level / 2, r.df) * se
    pooled = math.sqrt(((r.n1 - 1) * r.var1 + (r.n2 - 1) * r.var2) / (r.n1 + r.n2 - 2))
    return result("welch_t_test", r.n1 + r.n2, {"difference": diff, "groups": labels}, {"statistic": r.t, "df": r.df, "p_value": D.tail(r.t, lambda x: D.t_sf(x, r.df), alternative)}, [diff - half, diff + half], {"cohens_d": diff / pooled if pooled else None}, {"levene": _levene(g), "variance_ratio": max(r.var1, r.var2) / min(r.var1, r.var2) if min(r.var1, r.var2) else None}, tables={"groups": [{"group": labels[0], "n": r.n1, "mean": r.mean1, "sd": math.sqrt(r.var1)}, {"group": labels[1], "n": r.n2, "mean": r.mean2, "sd": math.sqrt(r.var2)}]})


@analysis("one_way_anova")
def one_way_anova(df: DataFrame, value_column: str | None = None, group_column: str | None = None, value: str | None = None, group: str | None = None, **_: Any) -> Result:
    g = grouped(df, value_column or value, group_column or group)
    table = [x.asDict() for x in g.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd")).orderBy("g").limit(31).collect()]
    if not 2 <= len(table) <= 30 or min(x["n"] for x in table) < 2:
        raise AnalysisError("ANOVA takes 2 to 30 groups of two values and more")
    r = anova_parts(g).first()
    d1, d2, total = r.k - 1, r.n - r.k, r.between + r.within
    ms = r.within / d2
    return result("one_way_anova", r.n, {"between": r.between, "within": r.within}, {"statistic": r.f, "df1": d1, "df2": d2, "p_value": D.f_sf(r.f, d1, d2) if r.f is not None else None}, effect={"eta_squared": r.between / total if total else None, "omega_squared": (r.between - d1 * ms) / (total + ms) if total + ms else None}, diagnostics={"levene": _levene(g)}, tables={"groups": table})


def average_ranks(values: DataFrame, value: str = "v") -> DataFrame:
    """(v, n, r): each distinct value with its number and average rank."""
    counts = values.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    return running_totals(counts, "v", ["n"]).select("v", "n", (F.col("n_upto") - (F.col("n") - 1) / 2).alias("r"))


def rank_sums(df: DataFrame, value: str, group: str) -> DataFrame:
    """(g, n, ranks): each group's size and sum of average ranks."""
    g = grouped(df, value, group)
    return g.groupBy("g", "v").agg(F.count("*").alias("c")).join(average_ranks(g), "v").groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("r")).alias("ranks"))


def ties(df: DataFrame, value: str, group: str) -> float:
    """Sum of t^3 - t over tied values."""
    n = grouped(df, value, group).groupBy("v").count().select(F.col("count").cast("double").alias("t"))
    return n.agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("x")).first().x or 0.0


@analysis("mann_whitney")
def mann_whitney(df: DataFrame, value_column: str | None = None, group_column: str | None = None, value: str | None = None, group: str | None = None, alternative: str = "two-sided", **_: Any) -> Result:
    value, group = value_column or value, group_column or group
    rows = rank_sums(df, value, group).orderBy("g").limit(3).collect()
    if len(rows) != 2:
        raise AnalysisError("Mann-Whitney compares exactly two groups")
    a, b = rows
    n = a.n + b.n
    u1 = a.ranks - a.n * (a.n + 1) / 2
    var = a.n * b.n / 12 * (n + 1 - ties(df, value, group) / (n * (n - 1))) if n > 1 else 0
    z = (u1 - a.n * b.n / 2) / math.sqrt(var) if var > 0 else 0.0
    return result("mann_whitney", n, {"u": min(u1, a.n * b.n - u1)}, {"statistic": min(u1, a.n * b.n - u1), "z": z, "p_value": D.tail(z, D.normal_sf, alternative)}, effect={"rank_biserial": 2 * u1 / (a.n * b.n) - 1}, tables={"groups": [{"group": r.g, "n": r.n, "mean_rank": r.ranks / r.n} for r in rows]})


@analysis("kruskal_wallis")
def kruskal_wallis(df: DataFrame, value_column: str | None = None, group_column: str | None = None, value: str | None = None, group: str | None = None, **_: Any) -> Result:
    value, group = value_column or value, group_column or group
    sums = written(rank_sums(df, value, group), "rank_sums")
    t = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("k"), F.sum(F.col("ranks") * F.col("ranks") / F.col("n")).alias("s")).first()
    n, k = t.n, t.k
    if k < 2 or n < 3:
        return too_few("kruskal_wallis", n)
    rows = sums.orderBy("g").limit(SHOWN).collect()
    remove(df.sparkSession, sums)
    h = 12 / (n * (n + 1)) * t.s - 3 * (n + 1)
    h /= 1 - ties(df, value, group) / (n**3 - n) or 1
    return result("kruskal_wallis", n, {"h": h}, {"statistic": h, "df": k - 1, "p_value": D.chi2_sf(h, k - 1)}, effect={"epsilon_squared": h / (n - 1)}, warnings=[f"the first {SHOWN} of {k} groups are shown"] if k > SHOWN else [], tables={"groups": [{"group": r.g, "n": r.n, "mean_rank": r.ranks / r.n} for r in rows]})


@analysis("one_sample_t_test")
def one_sample_t(df: DataFrame, value_column: str | None = None, value: str | None = None, column: str | None = None, mu: float = 0.0, test_value: float | None = None, alternative: str = "two-sided", confidence_level: float = 0.95, **_: Any) -> Result:
    mu = float(test_value if test_value is not None else mu)
    r = moments(df, require(df, [value_column or value or column])).first()
    return _mean_test("one_sample_t_test", r.n, r.mean, r.sd, mu, alternative, confidence_level)


def _mean_test(kind: str, n: int, mean: float, sd: float, mu: float, alternative: str, level: float) -> Result:
    if n < 2 or not sd:
        return too_few(kind, n)
    t, half = (mean - mu) / (sd / math.sqrt(n)), D.t_ppf(0.5 + level / 2, n - 1) * sd / math.sqrt(n)
    return result(kind, n, {"mean": mean, "sd": sd}, {"statistic": t, "df": n - 1, "p_value": D.tail(t, lambda x: D.t_sf(x, n - 1), alternative)}, [mean - half, mean + half], {"cohens_d": (mean - mu) / sd})


@analysis("paired_t_test")
def paired_t(df: DataFrame, x: str, y: str, alternative: str = "two-sided", confidence_level: float = 0.95, **_: Any) -> Result:
    a, b = numbers(df, *require(df, [x, y]))
    r = df.select((b - a).alias("d")).agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s")).first()
    return _mean_test("paired_t_test", r.n, r.m, r.s, 0.0, alternative, confidence_level)


@analysis("one_sample_z_test")
def one_sample_z(df: DataFrame, value_column: str | None = None, column: str | None = None, mu: float = 0.0, sigma: float | None = None, confidence_level: float = 0.95, **_: Any) -> Result:
    r = moments(df, require(df, [value_column or column])).first()
    sd = float(sigma or r.sd or 0)
    if r.n < 2 or not sd:
        return too_few("one_sample_z_test", r.n)
    z, half = (r.mean - mu) / (sd / math.sqrt(r.n)), D.normal_ppf(0.5 + confidence_level / 2) * sd / math.sqrt(r.n)
    return result("one_sample_z_test", r.n, {"mean": r.mean}, {"statistic": z, "p_value": D.tail(z, D.normal_sf)}, [r.mean - half, r.mean + half])


@analysis("wilcoxon_signed_rank")
def wilcoxon(df: DataFrame, x: str, y: str, **_: Any) -> Result:
    a, b = numbers(df, *require(df, [x, y]))
    d = df.select((b - a).alias("d")).where("d <> 0").select(F.abs("d").alias("v"), (F.col("d") > 0).cast("int").alias("up"))
    per = d.groupBy("v").agg(F.count("*").alias("c"), F.sum("up").alias("ups"))
    r = per.join(average_ranks(d), "v").agg(F.sum("c").alias("n"), F.sum(F.col("ups") * F.col("r")).alias("plus"), F.sum(F.col("c") * F.col("r")).alias("all"), F.sum(F.pow("c", 3) - F.col("c")).alias("ties")).first()
    n = r.n or 0
    if n < 3:
        return too_few("wilcoxon_signed_rank", n)
    w, mean, sd = min(r.plus, r["all"] - r.plus), n * (n + 1) / 4, math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - r.ties / 48)
    z = (w - mean + 0.5) / sd
    return result("wilcoxon_signed_rank", n, {"w": w}, {"statistic": w, "z": z, "p_value": min(1.0, 2 * D.normal_sf(abs(z)))}, effect={"r": abs(z) / math.sqrt(n)})


@analysis("two_way_anova")
def two_way_anova(df: DataFrame, value_column: str, group_column: str, second_group_column: str, **_: Any) -> Result:
    require(df, [value_column, group_column, second_group_column])
    rows = df.select(F.col(f"`{group_column}`").cast("string").alias("a"), F.col(f"`{second_group_column}`").cast("string").alias("b"), numbers(df, value_column)[0].alias("v")).dropna()
    cells = [r.asDict() for r in rows.groupBy("a", "b").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var")).orderBy("a", "b").limit(SHOWN + 1).collect()]
    if len(cells) > SHOWN:
        raise AnalysisError(f"two-way ANOVA takes at most {SHOWN} cells")
    n = sum(c["n"] for c in cells)
    if not cells or min(c["n"] for c in cells) < 3:
        return result("two_way_anova", n, status="invalid", warnings=["each cell needs three values"])
    grand = sum(c["n"] * c["mean"] for c in cells) / n

    def between(key) -> tuple[float, int]:
        by: dict = {}
        for c in cells:
            k = key(c)
            s, m = by.get(k, (0.0, 0))
            by[k] = (s + c["n"] * c["mean"], m + c["n"])
        return sum(m * (s / m - grand) ** 2 for s, m in by.values()), len(by)

    (sa, ka), (sb, kb), (sc, kc) = between(lambda c: c["a"]), between(lambda c: c["b"]), between(lambda c: (c["a"], c["b"]))
    within, rest = sum((c["n"] - 1) * c["var"] for c in cells), n - kc
    table = []
    for name, ss, d in ((group_column, sa, ka - 1), (second_group_column, sb, kb - 1), ("interaction", max(0.0, sc - sa - sb), (ka - 1) * (kb - 1))):
        f = ss / d / (within / rest) if d and within else None
        table.append({"source": name, "ss": ss, "df": d, "f": f, "p_value": D.f_sf(f, d, rest) if f is not None else None, "eta_squared": ss / (sc + within)})
    return result("two_way_anova", n, tables={"anova": table, "cells": cells}, diagnostics={"within": within, "df": rest})
