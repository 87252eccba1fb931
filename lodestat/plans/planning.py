"""Which analyses fit two columns, what they assume, and which one to prefer."""

from __future__ import annotations

import difflib
import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import dtype, is_numeric_type, to_boolean, to_number, to_timestamp
from ..operators.columns import public
from ..stats import run_analysis
from ..stats.association import chi_square_of, contingency
from ..stats.basic import brown_forsythe, grouped, jarque_bera, moments
from ..functions import distributions as D


def semantic_types(df: DataFrame) -> dict[str, str]:
    """numeric, categorical, boolean, datetime or text for each column, from one aggregation."""
    parts = []
    for k, n in enumerate(public(df)):
        c, t = F.col(f"`{n}`"), dtype(df, n)
        text = c.cast("string")
        parts += [F.count(c).alias(f"n{k}"), F.count(to_number(c, t)).alias(f"d{k}"), F.count(to_boolean(text)).alias(f"b{k}"), F.count(F.when(F.length(text) <= 32, to_timestamp(text, T.StringType()))).alias(f"t{k}"), F.approx_count_distinct(c).alias(f"u{k}")]
    r, out = df.agg(*parts).first(), {}
    for k, n in enumerate(public(df)):
        t, have = dtype(df, n), r[f"n{k}"]
        if not have:
            out[n] = "text"
        elif isinstance(t, T.BooleanType):
            out[n] = "boolean"
        elif is_numeric_type(t):
            out[n] = "numeric"
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[n] = "datetime"
        elif r[f"b{k}"] == have:
            out[n] = "boolean"
        elif r[f"d{k}"] == have:
            out[n] = "numeric"
        elif r[f"t{k}"] >= 0.9 * have:
            out[n] = "datetime"
        else:
            out[n] = "categorical" if r[f"u{k}"] <= max(20, 0.05 * have) else "text"
    return out


def normalise(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.lower())


def find_variable(df: DataFrame, wanted: str) -> str | None:
    """Exact, then normalised, then the only one that contains the words, then the closest."""
    names = public(df)
    if wanted in names:
        return wanted
    by = {normalise(n): n for n in names}
    key = normalise(wanted)
    if key in by:
        return by[key]
    inside = [n for k, n in by.items() if key and key in k]
    if len(inside) == 1:
        return inside[0]
    close = difflib.get_close_matches(key, list(by), n=1, cutoff=0.75)
    return by[close[0]] if close else None


def candidates(a: str, b: str, levels_a: int = 0, levels_b: int = 0) -> list[str]:
    """Analyses for two columns of the given kinds; levels are numbers of different labels."""
    kinds = {a, b}
    labels = {"categorical", "boolean"}
    if kinds == {"numeric"}:
        return ["pearson", "spearman", "kendall", "linear_regression", "paired_t_test", "wilcoxon_signed_rank"]
    if "numeric" in kinds and kinds & labels:
        n = levels_b if b in labels else levels_a
        return ["welch_t_test", "mann_whitney", "point_biserial"] if n == 2 else ["one_way_anova", "kruskal_wallis"]
    if kinds <= labels:
        return ["chi_square", "fisher_exact"] if levels_a == levels_b == 2 else ["chi_square"]
    return []


def assumptions(df: DataFrame, analysis_type: str, value: str | None = None, group: str | None = None, x: str | None = None, y: str | None = None, alpha: float = 0.05) -> list[dict[str, Any]]:
    """PASS, WARN or FAIL for what a test assumes of these columns."""
    out = []

    def add(name: str, verdict: str, **more: Any) -> None:
        out.append({"check": name, "verdict": verdict, **more})

    if value and group:
        g = grouped(df, value, group)
        per = g.groupBy("g").agg(F.count("v").alias("n"), F.skewness("v").alias("s"), F.kurtosis("v").alias("k")).orderBy("g").limit(50).collect()
        least = min((r.n for r in per), default=0)
        add("group_size", "FAIL" if least < 3 else "WARN" if least < 5 else "PASS", least=least)
        for r in per:
            jb = jarque_bera(r.n, r.s, r.k)
            add(f"normality: {r.g}", "WARN" if jb["p_value"] is None else "PASS" if jb["p_value"] > alpha or r.n >= 200 and abs(r.s) < 1 else "FAIL", p=jb["p_value"])
        f = brown_forsythe(g).first()
        p = D.f_sf(f.f, f.k - 1, f.n - f.k) if f.f is not None else None
        add("equal_variances", "PASS" if p is None or p > alpha else "WARN", p=p)
    elif x and y and analysis_type in ("chi_square", "fisher_exact"):
        m, _, _ = contingency(df, x, y)
        e = chi_square_of(m)["expected"]
        add("expected_counts", "PASS" if e.min() >= 5 else "FAIL" if e.min() < 1 else "WARN", least=float(e.min()))
    elif x and y:
        for r in moments(df, [x, y]).collect():
            jb = jarque_bera(r.n, r.skewness, r.kurtosis)
            add(f"normality: {r.column}", "WARN" if jb["p_value"] is None else "PASS" if jb["p_value"] > alpha else "FAIL", p=jb["p_value"])
    return out


def recommend(df: DataFrame, a: str, b: str) -> dict[str, Any]:
    """The analysis to prefer: the rank test if normality or group sizes fail, Fisher's for small 2 x 2 tables."""
    kinds = semantic_types(df.select(f"`{a}`", f"`{b}`"))
    levels = {c: df.select(f"`{c}`").dropna().distinct().limit(51).count() for c in (a, b)}
    names = candidates(kinds[a], kinds[b], levels[a], levels[b])
    if not names:
        return {"recommended": None, "candidates": [], "checks": []}
    if names[0] in ("welch_t_test", "one_way_anova"):
        value, group = (a, b) if kinds[a] == "numeric" else (b, a)
        checks = assumptions(df, names[0], value=value, group=group)
        bad = any(c["verdict"] == "FAIL" for c in checks)
        best = names[1] if bad else names[0]
    elif names[0] == "pearson":
        checks = assumptions(df, names[0], x=a, y=b)
        best = "spearman" if any(c["verdict"] == "FAIL" for c in checks) else "pearson"
    else:
        checks = assumptions(df, names[0], x=a, y=b)
        best = "fisher_exact" if "fisher_exact" in names and any(c["verdict"] != "PASS" for c in checks) else names[0]
    return {"recommended": best, "candidates": names, "checks": checks}


#: Steps of each template: an analysis and which roles its parameters take (fixed values of this engine).
TEMPLATES: dict[str, list[tuple[str, dict[str, str]]]] = {
    "group_comparison": [("descriptive", {"columns": "value"}), ("welch_t_test", {"value_column": "value", "group_column": "group"}), ("mann_whitney", {"value_column": "value", "group_column": "group"})],
    "relationship": [("descriptive", {"columns": "y"}), ("pearson", {"x": "x", "y": "y"}), ("linear_regression", {"target": "y", "features": "x"})],
    "association": [("frequency", {"columns": "row"}), ("crosstab", {"row_column": "row", "column_column": "column"}), ("chi_square", {"row_column": "row", "column_column": "column"})],
    "churn": [("frequency", {"columns": "target"}), ("welch_t_test", {"value_column": "value", "group_column": "target"}), ("logistic_regression", {"target": "target", "features": "value"})],
}


def run_template(df: DataFrame, name: str, roles: dict[str, str]) -> list[dict[str, Any]]:
    """Results of a template's steps; roles are resolved to columns by ``find_variable``."""
    found = {r: find_variable(df, c) for r, c in roles.items()}
    if lost := [roles[r] for r, c in found.items() if c is None]:
        raise ValueError(f"no column like {', '.join(lost)}")
    return [run_analysis(df, analysis, **{k: found[r] for k, r in wants.items()}) for analysis, wants in TEMPLATES[name]]


#: Words that name an analysis in a question.
INTENTS = {"pearson": ("correlat", "relationship"), "welch_t_test": ("differ", "compare", "t test", "t-test"), "chi_square": ("associat", "independen", "chi"), "linear_regression": ("predict", "regress"), "descriptive": ("describe", "average", "mean", "summar"), "frequency": ("how many", "count", "frequen")}


def ask(df: DataFrame, question: str) -> dict[str, Any]:
    """An analysis for a question that names its columns; what is not understood is refused, never guessed."""
    text = question.lower()
    names = sorted((n for n in public(df) if re.search(rf"(?<![a-z0-9]){re.escape(n.lower().replace('_', ' '))}(?![a-z0-9])", text.replace("_", " "))), key=lambda n: text.replace("_", " ").index(n.lower().replace("_", " ")))
    kind = next((k for k, words in INTENTS.items() if any(w in text for w in words)), None)
    if kind is None or not names or kind not in ("descriptive", "frequency") and len(names) < 2:
        return {"status": "not_understood", "analysis": kind, "columns": names}
    if kind in ("descriptive", "frequency"):
        parameters: dict[str, Any] = {"columns": names}
    elif kind == "pearson":
        kind, parameters = recommend(df, *names[:2])["recommended"] or kind, {"x": names[0], "y": names[1]}
    elif kind == "welch_t_test":
        kinds = semantic_types(df.select(*[f"`{n}`" for n in names[:2]]))
        value, group = (names[0], names[1]) if kinds[names[0]] == "numeric" else (names[1], names[0])
        kind, parameters = recommend(df, value, group)["recommended"] or kind, {"value_column": value, "group_column": group}
    elif kind == "chi_square":
        parameters = {"row_column": names[0], "column_column": names[1]}
    else:
        parameters = {"target": names[0], "features": names[1:]}
    return {"status": "ok", "analysis": kind, "columns": names, "result": run_analysis(df, kind, **parameters)}
