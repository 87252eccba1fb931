"""Multiple comparisons: from three reported p-values on, corrections come along."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def collect_p_values(x: Any, at: str = "") -> list[tuple[str, float]]:
    if isinstance(x, dict):
        return [p for k, v in x.items() for p in ([(f"{at}{k}", float(v))] if k in ("p_value", "p") and isinstance(v, (int, float)) else collect_p_values(v, f"{at}{k}."))]
    if isinstance(x, list):
        return [p for k, v in enumerate(x) for p in collect_p_values(v, f"{at}{k}.")]
    return []


def bonferroni(p: list[float]) -> list[float]:
    return [min(1.0, x * len(p)) for x in p]


def benjamini_hochberg(p: list[float]) -> list[float]:
    m, least, out = len(p), 1.0, [0.0] * len(p)
    for rank, k in reversed(list(enumerate(sorted(range(m), key=p.__getitem__), 1))):
        least = min(least, p[k] * m / rank)
        out[k] = least
    return out


def apply(r: dict, alpha: float = 0.05, least: int = 3) -> dict:
    found = collect_p_values({k: v for k, v in r.items() if k in ("test", "tables", "diagnostics")})
    if len(found) >= least:
        p = [x for _, x in found]
        r["meta"]["multiple_comparisons"] = {"tests": len(p), "family_wise_error": round(1 - (1 - alpha) ** len(p), 6), "bonferroni": dict(zip([k for k, _ in found], [round(x, 6) for x in bonferroni(p)], strict=True)), "benjamini_hochberg": dict(zip([k for k, _ in found], [round(x, 6) for x in benjamini_hochberg(p)], strict=True))}
    return r


def adjust(df: DataFrame, p: str = "p") -> DataFrame:
    """Adds bonferroni and benjamini_hochberg to a small table of p-values."""
    whole = Window.partitionBy(F.lit(0))
    n = F.count(p).over(whole)
    rank = F.row_number().over(whole.orderBy(p))
    ranked = df.withColumn("bonferroni", F.least(F.lit(1.0), F.col(p) * n)).withColumn("_s", F.col(p) * n / rank).withColumn("_r", rank)
    step = F.min("_s").over(whole.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("benjamini_hochberg", F.least(F.lit(1.0), step)).drop("_s", "_r")
