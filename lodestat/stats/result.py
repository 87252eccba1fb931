"""The standard result of an analysis, and the registry of analyses."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame

Result = dict[str, Any]
ANALYSES: dict[str, Callable[..., Result]] = {}


class AnalysisError(ValueError):
    """The analysis cannot run on these columns or parameters."""


def analysis(*names: str) -> Callable:
    def add(f: Callable[..., Result]) -> Callable[..., Result]:
        for n in names:
            ANALYSES[n] = f
        return f

    return add


def plain(x: Any) -> Any:
    """Values for JSON: numbers that are not finite become null, floats keep six places, small ones eight digits."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return (round(x, 6) if abs(x) >= 0.01 else float(f"{x:.8g}")) if math.isfinite(x) else None
    return x


def result(kind: str, n: int, estimate: Any = None, test: Any = None, interval: Any = None, effect: Any = None, diagnostics: Any = None, warnings: Sequence[str] = (), tables: Any = None, status: str = "ok", **meta: Any) -> Result:
    if status == "ok" and (diagnostics or {}).get("converged") is False:
        status = "not_converged"
    return plain({"analysis_type": kind, "status": status, "sample_size": int(n or 0), "estimate": estimate, "test": test, "confidence_interval": interval, "effect_size": effect, "diagnostics": diagnostics or {}, "warnings": list(warnings), "tables": tables or {}, "meta": meta})


def too_few(kind: str, n: int, need: int = 3) -> Result:
    return result(kind, n, status="insufficient_data", warnings=[f"needs at least {need} complete rows, has {n}"])


_held: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    """Persist rows that an analysis reads many times; ``run_analysis`` lets go of them however the analysis ends."""
    _held.append(df.persist())
    return df


def run_analysis(df: DataFrame, analysis_type: str, checks: bool = False, **parameters: Any) -> Result:
    """Run a registered analysis; its p-values are collected and, from three on, corrected together.

    With ``checks`` the result tells what the analysis assumes of its columns, with the evidence.
    """
    from . import assumptions, guardrails

    name = {"normality_test": "normality_tests"}.get(analysis_type, analysis_type)
    if name not in ANALYSES:
        raise AnalysisError(f"no analysis is named {analysis_type!r}")
    before = len(_held)
    try:
        r = guardrails.apply(ANALYSES[name](df, **parameters))
        if checks:
            evidence, found = assumptions.checks_of(df, name, parameters)
            r["assumptions"] = plain({"evidence": evidence, "checks": found})
            r["warnings"] += [f"{c['name']}: {c['detail']}" for c in found if c["status"] == "FAIL"]
        return r
    finally:
        while len(_held) > before:
            _held.pop().unpersist()


def as_rows(r: Result) -> list[tuple[str, str, str]]:
    """(section, key, value) of a result, long form; tables by name and row number."""
    out = []

    def walk(section: str, key: str, x: Any) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                walk(section, f"{key}.{k}" if key else str(k), v)
        elif isinstance(x, list):
            for k, v in enumerate(x):
                walk(section, f"{key}[{k}]", v)
        else:
            out.append((section, key, None if x is None else str(x)))

    for section, x in r.items():
        walk(section, "", x)
    return out
