"""Profiles, validation, remedies, exploration: one wide aggregation each, wherever one will do."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import correlation, dtype, is_numeric_type, numbers, to_number
from ..operators.columns import POS, public, with_position
from ..operators.ordering import top_values
from ..stats.association import pairwise_correlations, spearman_pairs
from ..stats.basic import jarque_bera, moments, numeric_columns

#: Share of missing values from which a column is mostly missing, of numbers from which text is numeric; values looked at for it.
MOSTLY, NUMERIC_TEXT, LOOKED_AT = 0.5, 0.95, 200
SEVERITY = {"error": 0, "warning": 1, "info": 2}


def _present(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return F.when(~F.isnan(c), c) if isinstance(dtype(df, name), (T.DoubleType, T.FloatType)) else c


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if is_numeric_type(t):
        return "numeric"
    return "date" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "text"


def _distinct(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, distinct).  Two hashes of 96 bits stand for a value (two of ten billion values share them once in a billion tables).

    What is pre-aggregated and shuffled are numbers of fixed width, whatever the columns hold.
    """
    values = [_present(df, n) for n in names]
    marks = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), F.xxhash64(v).alias("a"), F.hash(v, F.lit(1)).alias("b"))) for k, v in enumerate(values)]
    long = df.select(F.explode(F.array(*marks)).alias("x")).where("x IS NOT NULL").select("x.k", "x.a", "x.b")
    counts = long.distinct().groupBy("k").agg(F.count("*").alias("distinct"))
    return counts.select(F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).alias("column"), "distinct")


def profile_columns(df: DataFrame) -> DataFrame:
    """column, kind, n, missing, distinct, min, max (as text), mean; two passes, one for distinct values."""
    names = public(df)
    parts = []
    for n in names:
        c, t = _present(df, n), dtype(df, n)
        number = to_number(F.col(f"`{n}`"), t) if is_numeric_type(t) else F.lit(None).cast("double")
        parts.append(F.struct(F.lit(n).alias("column"), F.lit(kind_of(t)).alias("kind"), F.count("*").alias("n"), F.count_if(c.isNull()).alias("missing"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"), F.avg(number).alias("mean")))
    wide = df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("r")).select("r.*")
    return wide.join(_distinct(df, names), "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))


def duplicate_rows(df: DataFrame) -> int:
    names = public(df)
    return df.groupBy(*[f"`{n}`" for n in names]).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]


def validate(df: DataFrame, original_names: list[str] | None = None) -> dict[str, Any]:
    """verdict (blocked, warnings, clean) and findings by severity; ``original_names`` are those before they were made unique."""
    names, found = public(df), []
    given = original_names or names

    def add(code: str, severity: str, column: str | None = None, **more: Any) -> None:
        found.append({"code": code, "severity": severity, "column": column, **more})

    if repeated := sorted({n for n in given if given.count(n) > 1}):
        add("duplicate_column_names", "error", names=repeated)
    if blank := [n for n in given if not n.strip() or n.startswith("Unnamed")]:
        add("blank_column_names", "warning", names=blank)
    if not names:
        add("no_columns", "error")
    rows = {r.column: r for r in profile_columns(df).collect()} if names else {}
    n = next((r.n for r in rows.values()), 0)
    if names and not n:
        add("empty_dataset", "error")
    if n:
        if extra := duplicate_rows(df):
            add("duplicate_rows", "warning", rows=extra)
        texts = [c for c in names if isinstance(dtype(df, c), T.StringType)]
        looks = df.select(*texts, *([POS] if POS in df.columns else [])).where(F.col(POS) < LOOKED_AT) if POS in df.columns else df.select(*texts).limit(LOOKED_AT)
        seen = looks.agg(*[F.struct(F.count(F.col(f"`{c}`")).alias("n"), F.count(to_number(F.col(f"`{c}`"), T.StringType())).alias("d")).alias(c) for c in texts]).first() if texts else None
        lows = df.agg(*[F.min(c).alias(k) for k, c in zip(numeric_columns(df), numbers(df, *numeric_columns(df)), strict=True)]).first() if numeric_columns(df) else None
        for c in names:
            r = rows[c]
            if r.missing == n:
                add("column_all_missing", "error", c)
                continue
            if r.missing >= MOSTLY * n:
                add("column_mostly_missing", "warning", c, share=r.missing / n)
            if r.distinct <= 1:
                add("constant_column", "warning", c)
                if r.kind == "numeric":
                    add("zero_variance", "warning", c)
            if r.kind == "numeric" and lows[c] is not None and lows[c] < 0:
                add("negative_values", "info", c)
            if r.distinct == n and not r.missing and n > 1:
                add("likely_identifier", "info", c)
            if c in texts and seen[c].n and seen[c].d >= NUMERIC_TEXT * seen[c].n:
                add("numeric_stored_as_text", "warning", c)
    found.sort(key=lambda f: SEVERITY[f["severity"]])
    worst = {f["severity"] for f in found}
    return {"verdict": "blocked" if "error" in worst else "warnings" if "warning" in worst else "clean", "rows": n, "findings": found}


#: Remedy of each finding, in the order they are applied; those on by default.
FIXES = {"duplicate_column_names": "rename", "blank_column_names": "rename", "column_all_missing": "drop", "column_mostly_missing": "drop", "constant_column": "drop", "numeric_stored_as_text": "cast", "duplicate_rows": "dedupe"}
DEFAULT = ("duplicate_column_names", "blank_column_names", "column_all_missing", "numeric_stored_as_text", "duplicate_rows")


LABELS = {"rename": "give each column a name of its own", "drop": "drop the column", "cast": "read the text as numbers", "dedupe": "drop repeated rows"}


def remedies(report: dict[str, Any]) -> list[dict[str, Any]]:
    """The findings of a report that have a remedy: code, column, fix, label, and whether it is applied without being asked for."""
    return [{"code": f["code"], "column": f["column"], "fix": FIXES[f["code"]], "label": LABELS[FIXES[f["code"]]], "default": f["code"] in DEFAULT} for f in report["findings"] if f["code"] in FIXES]


def column_warnings(rows: dict[str, dict[str, Any]]) -> list[str]:
    """What stands in the way of an analysis, from the rows of ``profile_columns``."""
    out = [f"{c} has no value in {r['missing'] / r['n']:.0%} of the rows" for c, r in rows.items() if r["n"] and r["missing"] >= MOSTLY * r["n"]]
    if rows and not any(r["kind"] == "numeric" for r in rows.values()):
        out.append("no numeric column: means, correlations and regressions need one")
    if single := [c for c, r in rows.items() if r["n"] and r["distinct"] == 1]:
        out.append(f"only one value: {', '.join(single)}")
    return out


def dataset_profile(df: DataFrame) -> dict[str, Any]:
    """Variables by kind with their shape, and what holds for the whole table: complete and repeated rows, missing cells."""
    rows, numeric = {r.column: r.asDict() for r in profile_columns(df).collect()}, numeric_columns(df)
    n = next((r["n"] for r in rows.values()), 0)
    stats = {r.column: r.asDict() for r in moments(df, numeric).collect()} if numeric and n else {}
    fences = {c: (s["q1"] - 1.5 * (s["q3"] - s["q1"]), s["q3"] + 1.5 * (s["q3"] - s["q1"])) for c, s in stats.items() if s["n"]}
    outside = df.agg(*[F.count_if((v < fences[c][0]) | (v > fences[c][1])).alias(c) for c, v in zip(numeric, numbers(df, *numeric), strict=True) if c in fences]).first() if fences else None
    for c, r in rows.items():
        if c in fences:
            s = stats[c]
            r |= {k: s[k] for k in ("sd", "skewness", "kurtosis", "median")} | {"normality": jarque_bera(s["n"], s["skewness"], s["kurtosis"]), "outliers": outside[c]}
        else:
            top = top_values(df.where(F.col(f"`{c}`").isNotNull()), c, 10).collect()
            r |= {"levels": [t.value for t in top], "top_percentage": 100 * top[0]["count"] / (r["n"] - r["missing"]) if top else None}
        r["binary"] = r["distinct"] == 2
    complete = df.select(*[f"`{c}`" for c in public(df)]).dropna().count() if n else 0
    kinds: dict[str, list[str]] = {}
    for c, r in rows.items():
        kinds.setdefault(r["kind"], []).append(c)
    missing = sum(r["missing"] for r in rows.values())
    warnings = column_warnings(rows) + ([f"only {n} rows"] if n < 30 else [])
    return {"rows": n, "columns": rows, "kinds": kinds, "complete_rows": complete, "duplicate_rows": duplicate_rows(df) if n else 0, "missing_percent": 100 * missing / max(1, n * len(rows)), "warnings": warnings}


def remediate(df: DataFrame, report: dict[str, Any], fixes: list[str] | None = None) -> tuple[DataFrame, list[dict], list[dict]]:
    """(rows, applied, skipped): names are already unique here, so drops, casts and deduplication remain to be composed."""
    from ..operators import cleaning
    from ..operators.columns import cast_types

    wanted, applied, skipped = set(fixes if fixes is not None else DEFAULT), [], []
    order = ["rename", "drop", "cast", "dedupe"]
    for f in sorted(report["findings"], key=lambda f: order.index(FIXES.get(f["code"], "rename"))):
        if f["code"] not in FIXES or f["code"] not in wanted:
            skipped.append({"code": f["code"], "column": f["column"], "reason": "no remedy" if f["code"] not in FIXES else "not asked for"})
            continue
        kind, column = FIXES[f["code"]], f["column"]
        if kind in ("drop", "cast") and column not in df.columns:
            skipped.append({"code": f["code"], "column": column, "reason": "gone already"})
            continue
        if kind == "drop" and len(public(df)) == 1:
            skipped.append({"code": f["code"], "column": column, "reason": "the last column stays"})
            continue
        if kind == "drop":
            df = df.drop(column)
        elif kind == "cast":
            df = cast_types(df, column, "numeric")
        elif kind == "dedupe":
            df = cleaning.drop_duplicates(df if POS in df.columns else with_position(df))
        applied.append({"code": f["code"], "column": column, "fix": kind})
    return df, applied, skipped


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n): equal widths, the last bin closed; empty bins are absent.  Bounds come from one aggregation."""
    c = numbers(df, column)[0]
    lo, hi = df.agg(F.min(c), F.max(c)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin long, low double, high double, n long")
    width = (hi - lo) / bins or 1.0
    b = F.least(F.floor((c - lo) / width), F.lit(bins - 1))
    return df.where(c.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(lo) + F.col("bin") * width).alias("low"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("high"), "n")


def find_correlations(df: DataFrame, columns: list[str] | None = None, least: int = 30, k: int = 12) -> list[dict]:
    """Strongest pairs; where ranks disagree with values by over 0.1 the rank correlation is reported."""
    names, out = columns or numeric_columns(df), []
    for r in pairwise_correlations(df, names).collect() if len(names) > 1 else ():
        if r.n < least or r.r is None:
            continue
        s = spearman_pairs(df, r.x, r.y).agg(correlation(F.col("x"), F.col("y"))).first()[0]
        use = s is not None and abs(s - r.r) > 0.1
        out.append({"x": r.x, "y": r.y, "n": r.n, "method": "spearman" if use else "pearson", "r": s if use else r.r})
    return sorted(out, key=lambda c: -abs(c["r"]))[:k]


def explore(df: DataFrame) -> dict[str, Any]:
    """Statistics, histograms, frequent values, correlations and warnings of every column."""
    rows, numeric = {r.column: r.asDict() for r in profile_columns(df).collect()}, numeric_columns(df)
    stats = {r.column: r.asDict() for r in moments(df, numeric).collect()} if numeric else {}
    for name, r in rows.items():
        if name in stats:
            r |= {"statistics": stats[name], "histogram": [tuple(b) for b in histogram(df, name).orderBy("bin").collect()]}
        r["top"] = [(t.value, t["count"]) for t in top_values(df, name, 8).collect()]
    return {"columns": rows, "correlations": find_correlations(df, numeric), "validation": validate(df), "warnings": column_warnings(rows)}
