"""What a test assumes of its columns: the evidence, gathered in few aggregations, and a verdict on each point."""

from __future__ import annotations

from bisect import bisect_left
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.numeric import numbers
from ..operators.columns import require
from ..operators.ranges import quantiles
from .basic import brown_forsythe, jarque_bera

#: Which analyses a point matters to (fixed values).
NORMALITY = ("pearson", "linear_regression", "welch_t_test", "one_way_anova")
OUTLIERS = ("pearson", "linear_regression")
EQUAL_VARIANCES = ("one_way_anova",)
GROUPED = ("welch_t_test", "mann_whitney", "one_way_anova", "kruskal_wallis")
TABLES = ("chi_square", "fisher_exact")
ALPHA, MOST_MISSING, MOST_OUTLIERS, LEAST_ROWS, STABLE_ROWS, LEAST_GROUP, LEAST_EXPECTED = 0.05, 20, 5, 3, 30, 5, 5
#: Groups that are described one by one.
SHOWN_GROUPS = 50


def roles(analysis_type: str, p: dict[str, Any]) -> tuple[str | None, str | None]:
    """(outcome, predictor) among the parameters of an analysis."""
    first = lambda *names: next((p[n] if isinstance(p[n], str) else p[n][0] for n in names if p.get(n)), None)
    if analysis_type in TABLES:
        return first("row_column", "row", "x"), first("column_column", "column", "y")
    if analysis_type in GROUPED:
        return first("value_column", "value"), first("group_column", "group")
    return first("y", "target"), first("x", "features", "predictors")


def pair_diagnostics(df: DataFrame, outcome: str, predictor: str, kind: str = "numeric") -> dict[str, Any]:
    """Evidence on two columns; ``kind`` of the predictor is numeric, group or table.

    Sizes, missing values and moments of all rows and of each group come from one aggregation over groups; quartiles and
    medians from ranges of values; a table of labels from one count of its cells.
    """
    require(df, [outcome, predictor])
    if kind == "table":
        return _table(df, outcome, predictor)
    label = F.col(f"`{predictor}`").cast("string") if kind == "group" else numbers(df, predictor)[0]
    rows = df.select(numbers(df, outcome)[0].alias("v"), label.alias("g"))
    total = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("v").isNull()).alias("no_v"), F.count_if(F.col("g").isNull()).alias("no_g")).first()
    both = rows.dropna()
    jb = lambda r: {"n": r.n, "statistic": (t := jarque_bera(r.n, r.s, r.k))["statistic"], "p_value": t["p_value"], "normal": t["normal"]}
    moments = (F.count("v").alias("n"), F.skewness("v").alias("s"), F.kurtosis("v").alias("k"))
    whole = both.agg(*moments).first()
    share = lambda k: round(100 * k / total.rows, 2) if total.rows else 0.0
    out: dict[str, Any] = {"rows": total.rows, "sample_size": whole.n, "outcome_missing_percentage": share(total.no_v), "predictor_missing_percentage": share(total.no_g), "normality": jb(whole)}
    q = quantiles(both, [0.25, 0.75]).first()
    if q is not None:
        low, high = q.q[0] - 1.5 * (q.q[1] - q.q[0]), q.q[1] + 1.5 * (q.q[1] - q.q[0])
        count = both.where((F.col("v") < low) | (F.col("v") > high)).count()
        out["outliers"] = {"count": count, "percentage": round(100 * count / whole.n, 2), "low": low, "high": high}
    if kind == "group":
        per = both.groupBy("g").agg(*moments)
        sizes = per.agg(F.count("*").alias("groups"), F.min("n").alias("least"), F.min_by("g", "n").alias("of")).first()
        shown = per.orderBy(F.desc("n"), "g").limit(SHOWN_GROUPS).collect()
        f = brown_forsythe(both).first() if sizes.groups > 1 else None
        p = D.f_sf(f.f, f.k - 1, f.n - f.k) if f is not None and f.f is not None else None
        out |= {"groups": sizes.groups, "least_group": sizes.least, "least_group_label": sizes.of, "group_sizes": {r.g: r.n for r in shown}, "group_normality": {r.g: jb(r) for r in shown}, "levene": {"statistic": f.f if f is not None else None, "p_value": p}}
    return out


def _table(df: DataFrame, row: str, column: str) -> dict[str, Any]:
    """Expected counts of all cells, those that hold no row too, from the margins: cells below a count pair small margins."""
    labels = df.select(*[F.col(f"`{c}`").cast("string").alias(a) for c, a in ((row, "r"), (column, "c"))])
    total = labels.agg(F.count("*").alias("rows"), F.count_if(F.col("r").isNull()).alias("no_r"), F.count_if(F.col("c").isNull()).alias("no_c")).first()
    both = labels.dropna()
    margins = {a: both.groupBy(a).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("labels")) for a in ("r", "c")}
    n = both.count()
    # margins by their size: at most about the root of twice the rows differ, so the pairs are few
    sides = {a: sorted((x.n, x.labels) for x in m.collect()) for a, m in margins.items()}
    cells = below = 0
    least = None
    if n:
        counts, sums = [k for k, _ in sides["c"]], [0]
        for _, m in sides["c"]:
            sums.append(sums[-1] + m)
        for size, many in sides["r"]:
            upto = bisect_left(counts, LEAST_EXPECTED * n / size)
            below += many * sums[upto]
            cells += many * sums[-1]
        least = sides["r"][0][0] * sides["c"][0][0] / n
    share = lambda k: round(100 * k / total.rows, 2) if total.rows else 0.0
    return {"rows": total.rows, "sample_size": n, "outcome_missing_percentage": share(total.no_r), "predictor_missing_percentage": share(total.no_c), "cells": cells, "least_expected": least, "cells_with_expected_below_5": below}


def assumption_checks(analysis_type: str, d: dict[str, Any]) -> list[dict[str, Any]]:
    """PASS, WARN, FAIL or N/A on sample size, missing values, normality, outliers, variances, group sizes and expected counts."""
    out: list[dict[str, Any]] = []

    def add(name: str, status: str, detail: str, evidence: Any = None) -> None:
        out.append({"name": name, "status": status, "detail": detail, **({"evidence": evidence} if evidence is not None else {})})

    n = d["sample_size"]
    add("Sample size", "FAIL" if n < LEAST_ROWS else "WARN" if n < STABLE_ROWS else "PASS", f"{n} complete rows; {LEAST_ROWS} are needed and {STABLE_ROWS} give stable estimates")
    missing = max(d["outcome_missing_percentage"], d["predictor_missing_percentage"])
    add("Missing values", "WARN" if missing > MOST_MISSING else "PASS", f"{missing:g} % are missing in the column that lacks most")
    if analysis_type in NORMALITY:
        groups = d.get("group_normality") or {}
        odd = [g for g, x in groups.items() if x["normal"] is False]
        whole = d.get("normality") or {}
        if odd:
            add("Normality", "WARN", f"{len(odd)} of {len(groups)} groups are not normal; a rank test assumes less", ", ".join(map(str, odd)))
        elif not groups and whole.get("normal") is False:
            add("Normality", "WARN", "the outcome is not normal; a rank test assumes less", whole["p_value"])
        elif whole.get("p_value") is None:
            add("Normality", "N/A", "too few values to tell")
        else:
            add("Normality", "PASS", "nothing speaks against a normal distribution", whole["p_value"])
    else:
        add("Normality", "N/A", "the method does not assume it")
    if analysis_type in OUTLIERS:
        x = d.get("outliers") or {"count": 0, "percentage": 0.0}
        add("Outliers", "WARN" if x["percentage"] > MOST_OUTLIERS else "PASS", f"{x['count']} values ({x['percentage']:g} %) lie more than one and a half quartile distances outside")
    else:
        add("Outliers", "N/A", "the method hardly depends on single values")
    if analysis_type in EQUAL_VARIANCES:
        p = (d.get("levene") or {}).get("p_value")
        add("Equal variance", "PASS" if p is None or p > ALPHA else "WARN", "variances of the groups are alike" if p is None or p > ALPHA else "variances of the groups differ", p)
    else:
        add("Equal variance", "N/A", "the method does not assume it")
    if analysis_type in GROUPED and d.get("groups"):
        add("Group sizes", "FAIL" if d["least_group"] < LEAST_GROUP else "PASS", f"the smallest of {d['groups']} groups has {d['least_group']} rows; {LEAST_GROUP} are needed", d["least_group_label"])
    if analysis_type == "chi_square":
        below = d["cells_with_expected_below_5"]
        add("Expected counts", "WARN" if below else "PASS", f"{below} of {d['cells']} cells are expected below {LEAST_EXPECTED}", d["least_expected"])
    elif analysis_type == "fisher_exact":
        add("Expected counts", "N/A", "an exact test needs none")
    return out


def checks_of(df: DataFrame, analysis_type: str, parameters: dict[str, Any]) -> tuple[dict[str, Any], list[dict[str, Any]]]:
    """Evidence and verdicts on an analysis of two columns; nothing for analyses of other kinds."""
    outcome, predictor = roles(analysis_type, parameters)
    known = {*NORMALITY, *OUTLIERS, *GROUPED, *TABLES, "spearman", "kendall"}
    if analysis_type not in known or not outcome or not predictor:
        return {}, []
    d = pair_diagnostics(df, outcome, predictor, "table" if analysis_type in TABLES else "group" if analysis_type in GROUPED else "numeric")
    return d, assumption_checks(analysis_type, d)
