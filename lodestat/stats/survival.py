"""Kaplan-Meier curves and log-rank tests over distinct times."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.numeric import numbers, to_boolean
from ..operators.columns import require
from ..storage import written
from .association import shown
from ..operators.ranges import running_totals
from .result import AnalysisError, Result, analysis, result, too_few


def times_of(df: DataFrame, time: str, event: str, group: str | None = None, event_value: Any = None) -> DataFrame:
    """(g, t, d, n): events and rows that leave at each distinct time of each group."""
    require(df, [time, event, *([group] if group else [])])
    e = F.col(f"`{event}`")
    happened = (e.cast("string") == str(event_value)) if event_value is not None else F.coalesce(numbers(df, event)[0] != 0, to_boolean(e))
    g = F.col(f"`{group}`").cast("string") if group else F.lit("all")
    rows = df.select(g.alias("g"), numbers(df, time)[0].alias("t"), happened.cast("int").alias("d")).dropna().where("t >= 0")
    return rows.groupBy("g", "t").agg(F.sum("d").alias("d"), F.count("*").alias("n"))


def curve(times: DataFrame) -> DataFrame:
    """(g, t, at_risk, d, survival, se): all that are still there at t are at risk, censored ones too; Greenwood's error up to t."""
    risk = running_totals(times, "t", ["n"], group="g", descending=True).withColumnRenamed("n_upto", "at_risk")
    left = F.col("at_risk") - F.col("d")
    logs = risk.select("g", "t", "d", "at_risk", F.when(left > 0, F.log(left / F.col("at_risk"))).otherwise(0.0).alias("_l"), F.when(left > 0, F.col("d") / (F.col("at_risk") * left)).otherwise(0.0).alias("_v"), (left == 0).cast("int").alias("_e"))
    out = running_totals(logs, "t", ["_l", "_v", "_e"], group="g")
    s = F.when(F.col("_e_upto") > 0, 0.0).otherwise(F.exp("_l_upto"))
    return out.where("d > 0").select("g", "t", "at_risk", "d", s.alias("survival"), (s * F.sqrt("_v_upto")).alias("se"))


def log_rank_parts(times: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Groups, observed and expected events, covariance; rows are the distinct event times of all groups together."""
    groups = [r.g for r in times.select("g").distinct().orderBy("g").limit(51).collect()]
    if not 2 <= len(groups) <= 50:
        raise AnalysisError("log-rank compares 2 to 50 groups")
    wide = times.groupBy("t").agg(*[F.sum(F.when(F.col("g") == g, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k, g in enumerate(groups) for c in "dn"])
    risk = running_totals(wide, "t", [f"n{k}" for k in range(len(groups))], descending=True)
    risk = risk.select("t", *[F.col(f"n{k}_upto").alias(f"n{k}") for k in range(len(groups))], *[f"d{k}" for k in range(len(groups))])
    d = sum((F.col(f"d{k}") for k in range(1, len(groups))), F.col("d0"))
    n = sum((F.col(f"n{k}") for k in range(1, len(groups))), F.col("n0"))
    risk = risk.withColumn("d", d).withColumn("n", n).where("d > 0")
    scale = F.when(F.col("n") > 1, F.col("d") * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    share = [F.col(f"n{k}") / F.col("n") for k in range(len(groups))]
    k = len(groups)
    r = risk.agg(*[F.sum(f"d{i}") for i in range(k)], *[F.sum(F.col("d") * share[i]) for i in range(k)], *[F.sum(scale * share[i] * ((1 if i == j else 0) - share[j])) for i in range(k) for j in range(k)]).first()
    x = np.array([v or 0.0 for v in r], float)
    return groups, x[:k], x[k : 2 * k], x[2 * k :].reshape(k, k)


def log_rank_test(times: DataFrame) -> dict:
    groups, o, e, v = log_rank_parts(times)
    z = (o - e)[:-1]
    stat = float(z @ np.linalg.pinv(v[:-1, :-1]) @ z)
    return {"statistic": stat, "df": len(groups) - 1, "p_value": D.chi2_sf(stat, len(groups) - 1), "observed": dict(zip(groups, o.tolist(), strict=True)), "expected": dict(zip(groups, e.tolist(), strict=True))}


@analysis("kaplan_meier")
def kaplan_meier(df: DataFrame, time_column: str | None = None, event_column: str | None = None, group_column: str | None = None, duration: str | None = None, status: str | None = None, event_coding: Any = None, confidence_level: float = 0.95, **_: Any) -> Result:
    times = times_of(df, time_column or duration, event_column or status, group_column, event_coding).persist()
    n, events = times.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("d"), F.lit(0))).first()
    if n < 3 or not events:
        times.unpersist()
        return too_few("kaplan_meier", n)
    z = D.normal_ppf(0.5 + confidence_level / 2)
    drawn = written(curve(times), "curve")
    table, cut = shown(drawn, "g", "t", what="the curve")
    rows = [r.asDict() for r in table]
    for r in rows:
        r |= {"ci_low": max(0.0, r["survival"] - z * r["se"]), "ci_high": min(1.0, r["survival"] + z * r["se"])}
    medians = {r.g: r.t for r in drawn.where("survival <= 0.5").groupBy("g").agg(F.min("t").alias("t")).collect()}
    groups = [r.g for r in times.select("g").distinct().orderBy("g").limit(51).collect()]
    test = log_rank_test(times) if 2 <= len(groups) <= 50 else None
    times.unpersist()
    return result("kaplan_meier", n, {"events": events, "median": {g: medians.get(g) for g in groups}}, test, warnings=cut, tables={"curve": rows})


@analysis("log_rank")
def log_rank(df: DataFrame, time_column: str, event_column: str, group_column: str, event_coding: Any = None, **_: Any) -> Result:
    times = times_of(df, time_column, event_column, group_column, event_coding).persist()
    n = times.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    test = log_rank_test(times)
    times.unpersist()
    return result("log_rank", n, None, test)
