"""Residual diagnostics, robust and quantile errors, curves, merge prediction, stored runs, assumptions."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestat.functions import distributions as D
from lodestat.operators import combine, ranges
from lodestat.operators.columns import POS, OperationError
from lodestat.plans.runs import Runs
from lodestat.plans.versions import Dataset
from lodestat.stats import run_analysis
from lodestat.stats.assumptions import assumption_checks, pair_diagnostics

RNG = np.random.default_rng(3)


def _frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns)).repartition(3)


def test_previous_values_and_moving_averages(spark):
    v = RNG.normal(size=503)
    rows = _frame(spark, _pos=np.arange(503), v=v)
    got = {r._pos: r.v_before for r in ranges.with_previous(rows, "_pos", "v").collect()}
    assert got[0] is None and all(got[k] == v[k - 1] for k in range(1, 503))
    for window, block in ((1, 100), (2, 100), (7, 50), (60, 20), (9999, 100)):
        got = {r._pos: r.v_moving for r in ranges.moving_average(rows, "_pos", "v", window, block).collect()}
        w = max(1, min(window, 503))
        padded = np.pad(v, (w // 2, w - 1 - w // 2), mode="edge")
        want = np.convolve(padded, np.ones(w) / w, mode="valid")
        assert len(got) == 503 and np.allclose([got[k] for k in range(503)], want), window
    holes = rows.withColumn("v", F.when(F.col("_pos") != 5, F.col("v")))
    got = {r._pos: r.v_moving for r in ranges.moving_average(holes, "_pos", "v", 3, 4).collect()}
    assert [k for k, x in got.items() if x is None] and {k for k, x in got.items() if x is None} == {4, 5, 6}
    assert ranges.moving_average(rows.limit(0), "_pos", "v", 3).count() == 0


def test_residuals_tell_bends_widening_and_order(spark):
    n = 4000
    x = RNG.uniform(0, 10, n)
    pattern = {}
    for name, y in (("straight", 2 * x + RNG.normal(0, 1, n)), ("bent", x * x + RNG.normal(0, 1, n)), ("wide", 2 * x + RNG.normal(0, 1, n) * (0.2 + x))):
        r = run_analysis(_frame(spark, x=x, y=y), "linear_regression", target="y", features=["x"])
        pattern[name] = (r["diagnostics"]["residual_pattern"], r["diagnostics"]["breusch_pagan"]["p_value"])
    assert pattern["straight"][0]["status"] == "pass" and pattern["straight"][1] > 0.01
    assert pattern["bent"][0]["bend"] and not pattern["straight"][0]["bend"]
    assert pattern["wide"][0]["widening"] and pattern["wide"][1] < 1e-6
    e = np.zeros(n)
    for k in range(1, n):
        e[k] = 0.7 * e[k - 1] + RNG.normal()
    r = run_analysis(_frame(spark, **{POS: np.arange(n), "x": x, "y": x + e}), "linear_regression", target="y", features=["x"])
    beta = np.polyfit(x, x + e, 1)
    res = x + e - np.polyval(beta, x)
    assert r["diagnostics"]["durbin_watson"] == pytest.approx((np.diff(res) ** 2).sum() / (res**2).sum(), abs=1e-5)
    assert r["diagnostics"]["lag_correlation"] == pytest.approx((res[1:] * res[:-1]).sum() / (res**2).sum(), abs=1e-5)


def test_cluster_and_jackknife_errors_are_those_of_a_plain_version(spark):
    n = 400
    g, x1, x2 = RNG.integers(0, 23, n), RNG.normal(5, 2, n), RNG.normal(0, 1, n)
    y = 1 + x1 - x2 + RNG.normal(0, 1, n) + RNG.normal(0, 1, 23)[g]
    r = run_analysis(_frame(spark, g=[f"c{k}" for k in g], x1=x1, x2=x2, y=y), "linear_regression", target="y", features=["x1", "x2"], cluster_column="g", jackknife=True)
    x = np.column_stack([np.ones(n), x1, x2])
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    e = y - x @ beta
    meat = sum(np.outer(s, s) for s in (x[g == k].T @ e[g == k] for k in np.unique(g)))
    groups = len(np.unique(g))
    cr1 = np.sqrt(np.diag(inverse @ meat @ inverse) * groups / (groups - 1) * (n - 1) / (n - 3))
    assert np.allclose([t["standard_error"] for t in r["tables"]["cluster_robust"]], cr1, rtol=1e-4)
    left = np.array([np.linalg.lstsq(np.delete(x, k, 0), np.delete(y, k), rcond=None)[0] for k in range(n)])
    jack = np.sqrt((n - 1) / n * ((left - left.mean(0)) ** 2).sum(0))
    assert np.allclose([t["standard_error"] for t in r["tables"]["jackknife"]], jack, rtol=1e-4)


def test_quantile_errors_are_those_of_a_plain_version(spark):
    n = 3000
    x = RNG.uniform(0, 4, n)
    y = 1 + 2 * x + RNG.normal(0, 1, n) * (0.5 + 0.3 * x)
    taus = [0.25, 0.5, 0.9]
    r = run_analysis(_frame(spark, x=x, y=y), "quantile_regression", target="y", features=["x"], quantiles=taus)
    rows = r["tables"]["by_quantile"]
    z = np.column_stack([np.ones(n), x])
    for k, t in enumerate(taus):
        beta = np.array([rows[2 * k]["coefficient"], rows[2 * k + 1]["coefficient"]])
        e = y - z @ beta
        q = D.normal_ppf(t)
        f = math.exp(-q * q / 2) / math.sqrt(2 * math.pi)
        h = n ** (-1 / 3) * D.normal_ppf(0.975) ** (2 / 3) * (1.5 * f * f / (2 * q * q + 1)) ** (1 / 3)
        h = min(h, 0.99 * min(t, 1 - t))
        w = min(e.std(ddof=1), np.subtract(*np.quantile(e, [0.75, 0.25])) / 1.34) * (D.normal_ppf(t + h) - D.normal_ppf(t - h))
        u = e / w
        bread = np.linalg.inv((z * np.where(abs(u) < 1, 0.75 * (1 - u * u) / w, 0)[:, None]).T @ z)
        se = np.sqrt(np.diag(bread @ z.T @ z @ bread) * t * (1 - t))
        assert np.allclose([rows[2 * k]["standard_error"], rows[2 * k + 1]["standard_error"]], se, rtol=0.02)
        # the truth lies within four standard errors
        assert abs(beta[1] - (2 + 0.3 * q)) < 4 * se[1]
    # simulated again and again, estimates vary about as much as told
    told = rows[3]["standard_error"]
    slopes = []
    for s in range(6):
        rng = np.random.default_rng(100 + s)
        own = 1 + 2 * x + rng.normal(0, 1, n) * (0.5 + 0.3 * x)
        slopes.append(run_analysis(_frame(spark, x=x, y=own), "quantile_regression", target="y", features=["x"], tau=0.5)["tables"]["by_quantile"][1]["coefficient"])
    assert told / 3 < np.std(slopes, ddof=1) < 3 * told


def test_curve_and_area(spark):
    rng = random.Random(9)
    rows = [(float(rng.randint(0, 60)), float(rng.random() < 0.4)) for _ in range(900)]
    points, area = ranges.roc_points(spark.createDataFrame(rows, "s double, y double").repartition(4), cells=20)
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert area.first().auc == pytest.approx(auc)
    got = points.orderBy("fpr").collect()
    assert 2 <= len(got) <= 21 and got[-1].tpr == got[-1].fpr == 1
    for r in got:
        assert r.true_positives == sum(s >= r.threshold for s in pos) and r.false_positives == sum(s >= r.threshold for s in neg)
    assert ranges.hull([(0.1, 0.5), (0.2, 0.55), (0.3, 0.9), (1.0, 1.0)]) == [True, False, True, True]
    one = ranges.roc_points(spark.createDataFrame([(1.0, 1.0)], "s double, y double"))
    assert one[1].first().auc is None and one[0].count() == 1


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_a_merge_is_foretold(spark, how):
    rng = random.Random(1)
    a = spark.createDataFrame([(rng.choice([None, 1, 2, 3, 4]), rng.choice("xy"), k) for k in range(40)], "k int, s string, v int")
    b = spark.createDataFrame([(rng.choice([None, 3, 4, 5]), rng.choice("xz"), k) for k in range(30)], "k int, s string, w int")
    r = combine.predict_merge(a, b, how, on=["k", "s"]).first()
    assert r.rows == combine.merge(a, b, how, on=["k", "s"]).count() and (r.rows_left, r.rows_right) == (40, 30)
    with pytest.raises(OperationError, match="would give"):
        combine.merge_report(a, b, how, on=["k", "s"], most_rows=r.rows - 1)
    text = b.withColumn("k", F.col("k").cast("string"))
    assert combine.merge_report(a, text, how, on=["k"])["warnings"][0].startswith("types differ")


def test_a_merge_of_two_files_is_guarded(spark, tmp_path):
    data = Dataset(spark, str(tmp_path / "d"))
    data.create(spark.createDataFrame([(k, 10 * k) for k in (1, 2, 3, 4)], "`Holding ID` int, `Maize Harvest (kg)` int"))
    other = spark.createDataFrame([(2, "B"), (3, "C"), (4, "D"), (5, "E")], "`Holding ID` int, Region string")
    v = data.apply("merge", other=other, on=["Holding ID"])
    assert data.read(v).count() == 3 and data.warnings[0].startswith("rows lost")
    assert data.apply("merge", source=1, other=other, on=["Holding ID"], how="outer") == 3 and data.read(3).count() == 5
    many = spark.createDataFrame([(1, "x")] * 50, "`Holding ID` int, Region string")
    with pytest.raises(OperationError, match="would give 50 rows"):
        data.apply("merge", source=1, other=many, on=["Holding ID"], most_rows=20)
    with pytest.raises(OperationError, match="no rows"):
        data.apply("merge", source=1, other=other.where("Region = 'E'"), on=["Holding ID"])
    assert max(r.version for r in data.log().collect()) == 3


def test_runs_are_replayed_modified_and_grow_stale(spark, tmp_path):
    data = Dataset(spark, str(tmp_path / "d"))
    data.create(spark.createDataFrame([(float(k), "ab"[k % 2]) for k in range(40)], "value double, g string"))
    runs = Runs(data)
    first = runs.run(1, "welch_t_test", value_column="value", group_column="g")
    assert runs.stale() == []
    data.apply("filter", conditions=[{"column": "value", "operator": "lt", "value": 20}])
    assert runs.stale() == [first]
    second = runs.replay(first, version=2)
    assert runs.result(second)["sample_size"] == 20 and runs.stale() == []
    third = runs.modify(second, confidence_level=0.9)
    a, b = runs.result(second)["confidence_interval"], runs.result(third)["confidence_interval"]
    assert a[0] < b[0] < b[1] < a[1]
    again = runs.replay(first)
    rows = {r.id: r for r in runs.log().collect()}
    assert rows[again].key == rows[first].key and rows[again].result == rows[first].result and rows[third].key != rows[second].key
    assert runs.graph() == [("v1", "v2", "filter"), ("v1", "r1", "welch_t_test"), ("v2", "r2", "welch_t_test"), ("r1", "r2", "replay"), ("v2", "r3", "welch_t_test"), ("r2", "r3", "modify"), ("v1", "r4", "welch_t_test"), ("r1", "r4", "replay")]
    # content, not place, names an upload: the same rows in another order have the same hash
    twin = Dataset(spark, str(tmp_path / "e"))
    twin.create(spark.createDataFrame([(float(k), "ab"[k % 2]) for k in reversed(range(40))], "value double, g string"))
    assert twin.fingerprint(1) == data.fingerprint(1) != data.fingerprint(2)
    for call in (lambda: runs.replay(99), lambda: runs.run(9, "pearson", x="value", y="value")):
        with pytest.raises(OperationError):
            call()


def test_assumptions_come_with_a_result(spark):
    healthy = _frame(spark, value=RNG.normal(10, 2, 75), group=np.repeat(["a", "b", "c"], 25))
    r = run_analysis(healthy, "one_way_anova", checks=True, value_column="value", group_column="group")
    got = {c["name"]: c["status"] for c in r["assumptions"]["checks"]}
    assert got == {"Sample size": "PASS", "Missing values": "PASS", "Normality": "PASS", "Outliers": "N/A", "Equal variance": "PASS", "Group sizes": "PASS"}
    tiny = _frame(spark, value=np.arange(12.0), group=["a"] * 10 + ["b"] * 2)
    r = run_analysis(tiny, "welch_t_test", checks=True, value_column="value", group_column="group")
    got = {c["name"]: c["status"] for c in r["assumptions"]["checks"]}
    assert got["Group sizes"] == "FAIL" and got["Sample size"] == "WARN" and any(w.startswith("Group sizes") for w in r["warnings"])
    values = [None if k % 3 == 0 else float(k) for k in range(200)]
    gaps = spark.createDataFrame([(v, float(k % 50)) for k, v in enumerate(values)], "left double, right double")
    assert {c["name"]: c["status"] for c in run_analysis(gaps, "pearson", checks=True, x="right", y="left")["assumptions"]["checks"]}["Missing values"] == "WARN"
    skewed = _frame(spark, left=RNG.lognormal(0, 1.5, 400), right=RNG.normal(size=400))
    found = {c["name"]: c["status"] for c in run_analysis(skewed, "pearson", checks=True, x="right", y="left")["assumptions"]["checks"]}
    assert found["Normality"] == "WARN" and found["Outliers"] == "WARN"
    unlike = _frame(spark, v=np.concatenate([RNG.normal(0, 1, 200), RNG.normal(0, 6, 200)]), g=np.repeat(["a", "b"], 200))
    assert {c["name"]: c["status"] for c in assumption_checks("one_way_anova", pair_diagnostics(unlike, "v", "g", "group"))}["Equal variance"] == "WARN"
    cells = spark.createDataFrame([(a, b) for a, b, n in (("r", "x", 20), ("r", "y", 6), ("s", "x", 9), (None, "x", 3)) for _ in range(n)], "row string, col string")
    r = run_analysis(cells, "chi_square", checks=True, row_column="row", column_column="col")["assumptions"]
    assert r["evidence"]["cells_with_expected_below_5"] == 2 and r["evidence"]["least_expected"] == pytest.approx(9 * 6 / 35, abs=1e-6) and r["evidence"]["cells"] == 4
    assert "assumptions" not in run_analysis(cells, "chi_square", row_column="row", column_column="col")


def test_vectors_of_one_large_split_are_dealt_to_several_tasks(spark, monkeypatch):
    from lodestat.stats import learning

    monkeypatch.setattr(learning, "TASK_ROWS", 100)
    one = spark.range(1000).coalesce(1)
    assert learning.spread(one, 1000).rdd.getNumPartitions() == 10
    assert learning.spread(one, 100).rdd.getNumPartitions() == 1
    r = run_analysis(one.select((F.col("id") % 2 * 10.0).alias("a"), (F.col("id") % 3).cast("double").alias("b")), "kmeans", features=["a", "b"], n_clusters=2)
    assert sorted(r["tables"]["sizes"]) == [500, 500]
