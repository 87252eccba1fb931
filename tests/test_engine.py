"""Operators, readers and analyses on small tables, against textbook values and brute force."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.functions import distributions as D
from lodestat.functions.expressions import ExpressionError, compile_expression
from lodestat.operators import cleaning, columns, combine, filters, grouping, ordering
from lodestat.operators.columns import POS, OperationError
from lodestat.plans import charts, planning, profile
from lodestat.plans.registry import ORACLES, QUERIES
from lodestat.plans.versions import Dataset
from lodestat.sources import readers, tables, writers
from lodestat.stats import ANALYSES, run_analysis
from lodestat.stats.guardrails import adjust, benjamini_hochberg


def close(a, b, tol=1e-6):
    return a == pytest.approx(b, abs=tol)


def test_distributions():
    assert close(D.normal_sf(1.959963985), 0.025) and close(D.normal_ppf(0.975), 1.959963985)
    assert close(D.t_sf(2.228139, 10), 0.025) and close(D.t_ppf(0.975, 10), 2.228139)
    assert close(D.chi2_sf(3.841459, 1), 0.05) and close(D.chi2_sf(18.307038, 10), 0.05)
    assert close(D.f_sf(4.964603, 1, 10), 0.05) and D.f_sf(0, 2, 3) == 1
    assert close(D.beta_cdf(0.3, 2, 5), 1 - sum(math.comb(6, k) * 0.3**k * 0.7 ** (6 - k) for k in range(2)))


def test_expressions(spark):
    df = spark.createDataFrame([(7.0, -3.0, "4", None), (2.5, 0.0, "x", 1.0), (-1.0, 2.0, "1d", 2.0)], "a double, b double, s string, n double")

    def values(text):
        return [r[0] for r in df.select(compile_expression(text, df)).collect()]

    assert values("a % b") == [7.0 % -3.0, None, 1.0]
    assert values("a // b") == [-3.0, None, -1.0]
    assert values("a / b")[1] is None and values("s + 0") == [4.0, None, None]
    assert values("round(a)") == [7.0, 2.0, -1.0] and values("sqrt(a)")[2] is None and values("log(a)")[2] is None
    assert values("max(a, n)") == [None, 2.5, 2.0] and values("clip(a, 0, 3)") == [3.0, 2.5, 0.0]
    assert values("where(a > 0 and b < 0, 1, -1)") == [1.0, -1.0, -1.0]
    assert values("0 < a < 5") == [False, True, False] and values("n != 1") == [True, False, True]
    for bad in ("__import__('os')", "a.b", "a[0]", "'x'", "foo(1)", "a if b else n", "missing + 1", "not a", "1 +", "True"):
        with pytest.raises(ExpressionError):
            compile_expression(bad, df)


def test_columns_and_cells(spark):
    df = columns.with_position(spark.createDataFrame([(1, "a", 1.5), (2, "b", None), (3, "yes", 2.5)], "id long, s string, v double").repartition(3))
    assert sorted(r[POS] for r in df.collect()) == [0, 1, 2]
    assert columns.select_columns(df, ["v", "id"]).columns == ["v", "id", POS]
    with pytest.raises(OperationError):
        columns.drop_columns(df, ["id", "s", "v"])
    with pytest.raises(OperationError):
        columns.rename_columns(df, {"id": "s"})
    casts = columns.cast_column(df, "s")
    assert {r[0] for r in df.select(casts["boolean"]).collect()} == {None, True}
    assert sorted(r[0] for r in columns.cast_types(df, "v", "integer").select("v").dropna().collect()) == [2, 2]
    at = {r.id: r[POS] for r in df.collect()}
    out = columns.set_values(df, [{"row": at[1], "column": "v", "value": ""}, {"row": at[2], "column": "v", "value": 9}, {"row": at[3], "column": "s", "value": "new"}])
    assert {(r.id, r.s, r.v) for r in out.collect()} == {(1, "a", None), (2, "b", 9.0), (3, "new", 2.5)}


def test_filters_and_nulls(spark):
    df = spark.createDataFrame([("Dar", 20, 1.0), ("Dodoma", 30, None), (None, 40, float("nan")), ("dar es", 50, 4.0)], "region string, age int, w double")

    def ages(*conditions, logic="and"):
        return sorted(r.age for r in filters.filter_rows(df, [dict(zip(("column", "operator", "value"), c, strict=False)) for c in conditions], logic).collect())

    assert ages(("region", "contains", "DAR")) == [20, 50] and ages(("region", "ne", "Dar")) == [30, 40, 50]
    assert ages(("region", "not_in", ["Dar", "Dodoma"])) == [40, 50] and ages(("w", "is_null")) == [30, 40]
    assert ages(("age", "between", [45, 25])) == [30, 40] and ages(("age", "gt", "35")) == [40, 50]
    assert ages(("region", "eq", "Dar"), ("age", "gt", 45), logic="or") == [20, 50]
    with pytest.raises(OperationError):
        ages(("age", "like", 1))


def test_cleaning_and_grouping(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", 1.0), (2, None, None), (3, None, 3.0), (4, "b", None)], f"{POS} long, k string, v double")
    assert sorted(r[POS] for r in cleaning.drop_duplicates(df, ["k"]).collect()) == [0, 2, 4]
    assert sorted(r[POS] for r in cleaning.drop_duplicates(df, ["k"], "last").collect()) == [1, 3, 4]
    assert cleaning.drop_duplicates(df).count() == 4
    assert cleaning.drop_missing(df, ["v"]).count() == 3 and cleaning.drop_missing(df, threshold=2).count() == 4
    assert sorted(r.v for r in cleaning.fill_missing(df, "median", ["v"]).collect()) == [1.0, 1.0, 1.0, 1.0, 3.0]
    assert {r.k for r in cleaning.fill_missing(df, "zero").collect()} == {"a", "b", ""}
    assert cleaning.fill_missing(df, "mode", ["k"]).where("k = 'a'").count() == 4
    g = grouping.group_by(df, ["k"], {"v": ["sum", "count", "std", "nunique"], "__rows__": "count"}).collect()
    assert [tuple(r) for r in g] == [("a", 2.0, 2, 0.0, 1, 2), ("b", 0.0, 0, None, 0, 1), (None, 3.0, 1, None, 1, 2)]
    summary = cleaning.change_summary(df, cleaning.drop_missing(df)).first()
    assert (summary.rows_before, summary.rows_after, summary.rows_removed, summary.missing_cells_before) == (5, 2, 3, 4)


def test_merge_append_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(2, "p"), (None, "q"), (3, "r")], "k int, v string")
    assert {tuple(r) for r in combine.merge(a, b, "inner", on=["k"]).collect()} == {(2, "y", "p"), (None, "z", "q")}
    assert combine.merge(a, b, "outer", on=["k"]).count() == 4 and combine.merge(a, b, "left", left_on=["k"], right_on=["k"]).columns == ["k", "v_left", "v_right"]
    both = combine.append(a.withColumn(POS, F.lit(0)), b.select(F.col("k").cast("string").alias("k"), F.lit(1).alias("w")).withColumn(POS, F.lit(0)))
    assert both.count() == 6 and both.schema["k"].dataType.simpleString() == "string" and {r[POS] for r in both.collect()} == {0, 1}
    assert [r.k for r in ordering.sort(a, ["k"], False).collect()] == [2, 1, None]
    assert ordering.sample(a, 2).collect() == ordering.sample(a.repartition(3), 2).collect()


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id, name ,name,when,ok,price\n1,x,,2024-01-05,yes,1.5\n2,,b,01/06/2024,no,2\n")
    df = readers.read(spark, f"{tmp_path}/a.csv")
    assert df.columns == ["id", "name", "name_2", "when", "ok", "price"]
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "string", "timestamp", "boolean", "double"]
    (tmp_path / "b.txt").write_text("a;b\n1;2\n3;4\n")
    assert [tuple(r) for r in readers.read(spark, f"{tmp_path}/b.txt").collect()] == [(1, 2), (3, 4)]
    (tmp_path / "c.csv").write_bytes("n\nñandú\n".encode("latin-1"))
    assert readers.read(spark, f"{tmp_path}/c.csv").first().n == "ñandú"
    (tmp_path / "d.json").write_text(json.dumps({"a": [1, 2], "b": ["x", "y"]}))
    assert sorted(tuple(r) for r in readers.read(spark, f"{tmp_path}/d.json").collect()) == [(1, "x"), (2, "y")]
    assert readers.rows_of({"data": [{"a": 1}], "n": [2]}) == [{"a": 1}]
    rest = readers.read_rest(spark, {"url": "x"}, lambda _: b'{"items": [{"a": 1}, {"a": 2, "b": "z"}]}')
    assert sorted((r.a, r.b) for r in rest.collect()) == [(1, None), (2, "z")]
    assert readers.read_rest(spark, {"url": "x"}, lambda _: b"a,b\n1,q\n").first().a == 1
    assert readers.jdbc_options("postgres", {"host": "h", "database": "d", "user": "u", "table": "t"}, "p")["url"] == "jdbc:postgresql://h:5432/d"
    with pytest.raises(OperationError):
        readers.validate_config("mysql", {"host": "h"})
    import pandas as pd

    pd.DataFrame({"g": pd.Categorical(["m", "f"]), "v": [1.0, 2.0]}).to_stata(f"{tmp_path}/e.dta", write_index=False, variable_labels={"v": "amount"})
    stata = readers.read(spark, f"{tmp_path}/e.dta")
    assert stata.count() == 2 and stata.schema["v"].metadata["variable_label"] == "amount"
    for fmt in ("csv", "json", "parquet"):
        writers.write(df, f"{tmp_path}/out_{fmt}.{fmt}", fmt)
        assert readers.read(spark, f"{tmp_path}/out_{fmt}.{fmt}").count() == 2


def test_html_tables(spark):
    html = "<table><tr><th colspan=2>G</th><th></th></tr><tr><th>a</th><th>a</th><th></th></tr><tr><td>1<td>2<td></tr></table><table><tr><td>x</td></tr><tr><td>5</td></tr></table><table></table>"
    assert tables.extract_tables(html) == [(["G / a", "G / a_2"], [["1", "2"]]), (["x"], [["5"]])]
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert sorted((r.page_id, r.table, r.row) for r in tables.page_tables(pages).collect()) == [(1, 0, 0), (1, 1, 0)]


def test_versions(spark, tmp_path):
    data = Dataset(spark, f"{tmp_path}/set")
    assert data.create(spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "k int, v string")) == 1
    data.apply("sort", by=["k"])
    assert [r.k for r in data.preview(2, 2).collect()] == [1, 2]
    data.apply("drop_missing", columns=["v"])
    data.apply("calculate_column", source=1, name="d", expression="k * 2")
    assert data.read(3).count() == 2 and "d" in data.read(4).columns
    assert [s["operation"] for s in data.lineage(3)] == ["upload", "sort", "drop_missing"] and [s["version"] for s in data.lineage(4)] == [1, 4]
    assert [r.k for r in data.page(3, 1, 1).collect()] == [1]
    with pytest.raises(OperationError):
        data.apply("filter", conditions=[{"column": "k", "operator": "gt", "value": 99}])


def test_profile_validate_explore(spark):
    df = spark.createDataFrame([(k, "5" if k % 2 else "6", None, 1.0, -float(k % 7)) for k in range(30)] + [(29, "5", None, 1.0, -1.0)] * 2, "id int, t string, gone string, one double, neg double")
    report = profile.validate(df, ["id", "t", "t", "Unnamed: 3", "neg"])
    assert {(f["code"], f["column"]) for f in report["findings"]} == {("duplicate_column_names", None), ("blank_column_names", None), ("duplicate_rows", None), ("column_all_missing", "gone"), ("constant_column", "one"), ("zero_variance", "one"), ("negative_values", "neg"), ("numeric_stored_as_text", "t")}
    assert report["verdict"] == "blocked" and profile.validate(df.limit(0))["verdict"] == "blocked"
    out, applied, skipped = profile.remediate(df, report)
    assert "gone" not in out.columns and out.schema["t"].dataType.simpleString() == "double" and out.count() == 30 and {s["code"] for s in skipped} >= {"negative_values"}
    explored = profile.explore(df.drop("gone"))
    assert explored["columns"]["neg"]["statistics"]["n"] == 32 and sum(b[3] for b in explored["columns"]["neg"]["histogram"]) == 32
    assert charts.build(df, "bar", x="t", y="neg", facet="one")["1.0"].count() == 2
    with pytest.raises(OperationError):
        charts.build(df, "donut", x="t")


WELCH = [(v, "a" if v <= 5 else "b") for v in range(1, 11)]


def test_means_and_ranks(spark):
    w = spark.createDataFrame(WELCH, "value int, g string")
    r = run_analysis(w, "welch_t_test", value_column="value", group_column="g")
    assert close(r["test"]["statistic"], -5.0) and close(r["test"]["df"], 8.0) and close(r["test"]["p_value"], 0.001053, 1e-5)
    a = spark.createDataFrame([(v, g) for g, vs in (("x", (1, 2, 3)), ("y", (3, 4, 5)), ("z", (5, 6, 7))) for v in vs], "value int, g string")
    r = run_analysis(a, "one_way_anova", value_column="value", group_column="g")
    assert close(r["test"]["statistic"], 12.0) and close(r["test"]["p_value"], 0.008, 1e-4) and close(r["effect_size"]["eta_squared"], 0.8)
    m = spark.createDataFrame([(v, "a" if v < 4 else "b") for v in range(1, 7)], "value int, g string")
    r = run_analysis(m, "mann_whitney", value_column="value", group_column="g")
    assert r["test"]["statistic"] == 0 and close(r["test"]["z"], -1.963961, 1e-5)
    k = spark.createDataFrame([(v, "abc"[(v - 1) // 3]) for v in range(1, 10)], "value int, g string")
    assert close(run_analysis(k, "kruskal_wallis", value_column="value", group_column="g")["test"]["statistic"], 7.2)
    five = spark.createDataFrame([(v, v) for v in range(1, 6)], "v int, u int")
    d = run_analysis(five, "descriptive", columns="v")["tables"]["descriptives"][0]
    assert d["mean"] == 3 and close(d["sd"], 1.581139) and d["mode"] is None and close(d["ci_low"], 3 - 2.776445 * 1.581139 / math.sqrt(5), 1e-5)
    assert close(run_analysis(five, "one_sample_t_test", value_column="v", mu=2)["test"]["statistic"], math.sqrt(2))
    p = spark.createDataFrame([(1, 3), (2, 5), (3, 7), (4, 9), (5, 12)], "x int, y int")
    assert close(run_analysis(p, "paired_t_test", x="x", y="y")["estimate"]["mean"], 4.2)
    assert run_analysis(p, "wilcoxon_signed_rank", x="x", y="y")["estimate"]["w"] == 0
    cells = spark.createDataFrame([(float(i + j + k), f"a{i}", f"b{j}") for i in range(2) for j in range(2) for k in range(3)], "v double, a string, b string")
    t = {r["source"]: r for r in run_analysis(cells, "two_way_anova", value_column="v", group_column="a", second_group_column="b")["tables"]["anova"]}
    assert close(t["a"]["ss"], 3.0) and close(t["interaction"]["ss"], 0.0) and close(t["a"]["f"], 3.0)


def test_association(spark):
    p = spark.createDataFrame([(1, 2), (2, 4), (3, 5), (4, 4), (5, 5)], "x int, y int")
    r = run_analysis(p, "pearson", x="x", y="y")
    assert close(r["estimate"]["r"], 0.774597) and close(r["test"]["p_value"], 0.124027, 1e-5)
    assert close(run_analysis(p, "spearman", x="x", y="y")["estimate"]["r"], 0.737865, 1e-5)
    rng = random.Random(1)
    rows = [(rng.randint(0, 6), rng.randint(0, 5)) for _ in range(80)]
    sign = lambda v: (v > 0) - (v < 0)
    s = sum(sign(a - c) * sign(b - e) for i, (a, b) in enumerate(rows) for c, e in rows[:i])
    tx, ty = (sum(1 for i, r in enumerate(rows) for q in rows[:i] if r[k] == q[k]) for k in (0, 1))
    tau = s / math.sqrt((80 * 79 / 2 - tx) * (80 * 79 / 2 - ty))
    assert close(run_analysis(spark.createDataFrame(rows, "x int, y int"), "kendall", x="x", y="y")["estimate"]["tau"], tau)
    c = spark.createDataFrame([(r, k) for r, k, n in (("a", "x", 10), ("a", "y", 20), ("b", "x", 30), ("b", "y", 40)) for _ in range(n)], "r string, c string")
    r = run_analysis(c, "chi_square", row_column="r", column_column="c")
    assert close(r["test"]["statistic"], 0.793651) and close(r["effect_size"]["cramers_v"], 0.089087)
    tea = spark.createDataFrame([(r, k) for r, k, n in (("m", "m", 3), ("m", "t", 1), ("t", "m", 1), ("t", "t", 3)) for _ in range(n)], "r string, c string")
    assert close(run_analysis(tea, "fisher_exact", row_column="r", column_column="c")["test"]["p_value"], 0.485714)
    mc = spark.createDataFrame([("a", "b")] * 30 + [("a", "a")] * 20 + [("b", "a")] * 10, "before string, after string")
    assert close(run_analysis(mc, "mcnemar", before_column="before", after_column="after")["test"]["statistic"], 19**2 / 40)
    prop = spark.createDataFrame([(int(k < n), g) for g, n in (("a", 10), ("b", 20)) for k in range(100)], "value int, g string")
    assert close(run_analysis(prop, "two_proportion_z_test", value_column="value", group_column="g")["test"]["statistic"], -1.980295, 1e-5)
    assert close(run_analysis(mc, "chi_square_gof", column="after")["test"]["p_value"], 1.0)
    part = np.random.default_rng(3).standard_normal((200, 3))
    part[:, 0] += part[:, 2]
    part[:, 1] += part[:, 2]
    res = [part[:, k] - np.polyval(np.polyfit(part[:, 2], part[:, k], 1), part[:, 2]) for k in (0, 1)]
    got = run_analysis(spark.createDataFrame(part.tolist(), "x double, y double, z double"), "partial_correlation", x="x", y="y", controls=["z"])
    assert close(got["estimate"]["r"], np.corrcoef(*res)[0, 1])
    m = run_analysis(spark.createDataFrame(part.tolist(), "x double, y double, z double"), "correlation_matrix")
    assert len(m["tables"]["pairs"]) == 3 and m["meta"]["multiple_comparisons"]["tests"] == 3


def test_linear_models(spark):
    p = spark.createDataFrame([(0, 1, 3), (1, 2, 5), (2, 3, 7), (3, 4, 9), (4, 5, 12)], f"{POS} long, x int, y int")
    r = run_analysis(p, "linear_regression", target="y", predictors=["x"])
    coef = {c["term"]: c["coefficient"] for c in r["tables"]["coefficients"]}
    assert close(coef["x"], 2.2) and close(coef["intercept"], 0.6) and close(r["estimate"]["r_squared"], 0.991803, 1e-4)
    res = np.array([3, 5, 7, 9, 12]) - (0.6 + 2.2 * np.arange(1, 6))
    assert close(r["diagnostics"]["durbin_watson"], (np.diff(res) ** 2).sum() / (res**2).sum(), 1e-5)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 3))
    y = 1 + x @ [2.0, 0.0, -1.0] + rng.standard_normal(400)
    df = spark.createDataFrame(np.column_stack([y, x]).tolist(), "y double, a double, b double, c double")
    beta = np.linalg.lstsq(np.column_stack([np.ones(400), x]), y, rcond=None)[0]
    got = run_analysis(df, "linear_regression", target="y")
    assert [close(c["coefficient"], b, 1e-5) for c, b in zip(got["tables"]["coefficients"], beta, strict=True)] == [True] * 4
    lasso = run_analysis(df, "ridge_lasso", target="y", penalty="lasso")["tables"]["coefficients"]
    assert abs(lasso["a"] - 2) < 0.2 and abs(lasso["c"] + 1) < 0.2 and abs(lasso["b"]) < 0.15
    assert run_analysis(df, "ridge_regression", target="y")["estimate"]["r_squared"] > 0.7
    q = {c["quantile"]: c for c in run_analysis(df, "quantile_regression", target="y", quantiles=[0.5, 0.9], features=["a", "c"])["tables"]["coefficients"]}
    assert abs(q[0.5]["a"] - 2) < 0.25 and abs(q[0.9]["intercept"] - q[0.5]["intercept"] - 1.28) < 0.35
    v = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert [close(c["variance"], e, 1e-5) for c, e in zip(run_analysis(df, "pca", features=["a", "b", "c"])["tables"]["components"], v, strict=True)] == [True] * 3
    assert run_analysis(df, "kmeans", features=["a", "b"], n_clusters=2)["estimate"]["silhouette"] > 0.3


def test_likelihood_models(spark):
    rng = np.random.default_rng(7)
    n = 1500
    x = rng.standard_normal(n)
    u = rng.uniform(size=n)
    counts = rng.poisson(np.exp(0.3 + 0.5 * x))
    latent = 1 + x + rng.standard_normal(n)
    grade = np.digitize(0.8 * x + rng.logistic(size=n), [-1, 0.5])
    rows = np.column_stack([x, u < 1 / (1 + np.exp(-(0.5 + x))), counts, np.where(rng.uniform(size=n) < 0.3, 0, counts), np.maximum(latent, 0), grade, rng.negative_binomial(2, 2 / (2 + np.exp(0.3 + 0.5 * x)))])
    df = spark.createDataFrame(rows.astype(float).tolist(), "x double, b double, c double, z double, t double, g double, nb double").repartition(4)

    def slope(kind, target, table="coefficients", term="x", **p):
        r = run_analysis(df, kind, target=target, features=["x"], **p)
        return next(c["coefficient"] for c in r["tables"][table] if c["term"] == term), r

    b, r = slope("logistic_regression", "b")
    assert abs(b - 1) < 0.2 and r["diagnostics"]["converged"] and 0.65 < r["estimate"]["auc"] < 0.9
    assert abs(slope("probit", "b")[0] - 0.6) < 0.15
    assert 0.1 < slope("linear_probability_model", "b", "hc1")[0] < 0.3
    assert abs(slope("poisson_regression", "c")[0] - 0.5) < 0.08
    b, r = slope("negative_binomial", "nb")
    assert abs(b - 0.5) < 0.12 and abs(r["estimate"]["alpha"] - 0.5) < 0.2
    assert abs(slope("zero_inflated", "z", "count")[0] - 0.5) < 0.12 and abs(slope("hurdle", "z", "count")[0] - 0.5) < 0.12
    b, r = slope("tobit", "t", threshold=0)
    assert abs(b - 1) < 0.12 and abs(r["estimate"]["sigma"] - 1) < 0.1
    assert abs(slope("ordinal_logit", "g")[0] - 0.8) < 0.2


def test_reliability_and_survival(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal(120)
    items = np.round(base[:, None] + 0.7 * rng.standard_normal((120, 4)), 3)
    df = spark.createDataFrame(items.tolist(), "a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    k, cov = 4, np.cov(items.T)
    assert close(run_analysis(df, "cronbach_alpha", items=names)["estimate"]["alpha"], k / (k - 1) * (1 - np.trace(cov) / cov.sum()), 1e-5)
    assert 0.6 < run_analysis(df, "mcdonalds_omega", items=names)["estimate"]["omega"] < 1
    m = items.mean()
    rows, cols = 4 * ((items.mean(1) - m) ** 2).sum() / 119, 120 * ((items.mean(0) - m) ** 2).sum() / 3
    rest = (((items - items.mean(1)[:, None] - items.mean(0) + m) ** 2).sum()) / (119 * 3)
    assert close(run_analysis(df, "icc", columns=names)["estimate"]["icc_2_1"], (rows - rest) / (rows + 3 * rest + 4 * (cols - rest) / 120), 1e-5)
    kappa = spark.createDataFrame([("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15, "p string, q string")
    assert close(run_analysis(kappa, "cohens_kappa", row_column="p", column_column="q")["estimate"]["kappa"], 0.4)
    votes = [[0, 0, 0, 0, 14], [0, 2, 6, 4, 2], [0, 0, 3, 5, 6], [0, 3, 9, 2, 0], [2, 2, 8, 1, 1], [7, 7, 0, 0, 0], [3, 2, 6, 3, 0], [2, 5, 3, 2, 2], [6, 5, 2, 1, 0], [0, 2, 2, 3, 7]]
    wide = spark.createDataFrame([[str(c) for c, k in enumerate(v) for _ in range(k)] for v in votes], ", ".join(f"r{k} string" for k in range(14)))
    assert close(run_analysis(wide, "fleiss_kappa", columns=wide.columns)["estimate"]["kappa"], 0.20993, 1e-4)
    likert = spark.createDataFrame([(5, 1), (4, 2), (2, 4)], "a int, b int")
    r = {i["item"]: i for i in run_analysis(likert, "likert_analysis", items=["a", "b"], reversed_items=["b"], scale_min=1, scale_max=5)["tables"]["items"]}
    assert close(r["a"]["mean"], r["b"]["mean"])
    # censored rows leave the risk set at their own times
    km = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (5, 1)], "t int, e int")
    curve = run_analysis(km, "kaplan_meier", time_column="t", event_column="e")["tables"]["curve"]
    assert [(c["t"], c["at_risk"]) for c in curve] == [(1, 5), (3, 3), (5, 1)] and close(curve[1]["survival"], 0.8 * 2 / 3) and curve[2]["survival"] == 0
    two = spark.createDataFrame([(t, 1, "a") for t in (1, 2, 3, 4)] + [(t, 1, "b") for t in (5, 6, 7, 8)], "t int, e int, g string")
    r = run_analysis(two, "log_rank", time_column="t", event_column="e", group_column="g")
    risk = [(4 - k, 4) for k in range(4)]
    e = sum(a / (a + b) for a, b in risk)
    v = sum(a * b / (a + b) ** 2 for a, b in risk)
    assert close(r["test"]["statistic"], (4 - e) ** 2 / v, 1e-4)
    assert run_analysis(spark.createDataFrame([(1, 0)] * 4, "t int, e int"), "kaplan_meier", time_column="t", event_column="e")["status"] == "insufficient_data"


def test_planning(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.gauss(5, 1), rng.choice("ab"), rng.random()) for _ in range(100)], "Yield_kg double, plot string, rain double")
    assert planning.semantic_types(df) == {"Yield_kg": "numeric", "plot": "categorical", "rain": "numeric"}
    assert planning.find_variable(df, "yield kg") == "Yield_kg" and planning.find_variable(df, "zzz") is None
    assert planning.recommend(df, "Yield_kg", "plot")["recommended"] == "welch_t_test"
    assert planning.recommend(df, "Yield_kg", "rain")["recommended"] in ("pearson", "spearman")
    assert [r["analysis_type"] for r in planning.run_template(df, "relationship", {"x": "rain", "y": "yield kg"})] == ["descriptive", "pearson", "linear_regression"]
    assert planning.ask(df, "Does Yield kg differ by plot?")["analysis"] == "welch_t_test" and planning.ask(df, "sing a song")["status"] == "not_understood"


def test_guardrails(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    assert [round(x, 4) for x in benjamini_hochberg(p)] == [0.04, 0.0533, 0.0533, 0.5]
    got = {round(r.p, 2): r for r in adjust(spark.createDataFrame([(x,) for x in p], "p double")).collect()}
    assert all(close(got[x].benjamini_hochberg, y) and close(got[x].bonferroni, min(1, 4 * x)) for x, y in zip(p, benjamini_hochberg(p), strict=True))


def test_catalogue():
    from lodestat.plans import analysis_queries, core_queries  # noqa: F401

    assert len(ANALYSES) == 52 and set(ORACLES) <= set(QUERIES)
    assert {f"analysis_{a}" for a in ANALYSES} <= set(QUERIES)


def test_stream_in_batches(spark, tmp_path):
    from lodestat.streaming import run_available

    rows = [(k, f"2024-01-{1 + k // 10:02d} 0{k % 10}:00:00", "ab"[k % 2], float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, ts string, kind string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        run_available(spark, f"{tmp_path}/in", "id long, ts timestamp, kind string, v double", f"{tmp_path}/out", f"{tmp_path}/cp", "ts", "kind", "v")
    got = {(str(r.start)[:10], r.key): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got and all(n == 5 for n in got.values())


@pytest.mark.parametrize("name", ["filter_ne", "merge_outer", "profile_columns", "kaplan_meier", "mann_whitney_ranks"])
def test_queries_match_their_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    from lodestat.plans import analysis_queries, core_queries  # noqa: F401

    rng = random.Random(3)
    spark.createDataFrame([(k, rng.choice(["en", "de"]), f"src{k % 12}", rng.randint(10, 4000)) for k in range(60)], "doc_id long, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(k, k % 7) for k in range(20)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT id AS o_orderkey, id % 25 AS o_custkey, CASE WHEN id % 3 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus, (id * 37 % 11) * 1.5D AS o_totalprice, timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(id % 30) AS o_orderdate FROM range(80)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT id % 80 AS l_orderkey, id % 90 AS l_partkey, id % 9 AS l_suppkey, CAST(1 + id % 7 AS INT) AS l_linenumber, (id % 50) * 1D AS l_quantity, (id * 7919 % 1000) / 7D AS l_extendedprice, (id % 11) / 100D AS l_discount, (id % 9) / 100D AS l_tax, CASE WHEN id % 4 = 0 THEN 'F' ELSE 'O' END AS l_linestatus, substr('ANR', 1 + id % 3, 1) AS l_returnflag, timestamp_ntz'1995-01-20 00:00:00' + make_dt_interval(id % 40) AS l_shipdate FROM range(300)").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for table in ("documents", "labels", "customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(str(tuple(r[c] for c in names)) for r in got.collect()) == sorted(map(str, found.fetchall()))


# Round trips after a shuffle, fits of awkward scale, reports


def test_no_row_is_lost_after_a_shuffle(spark, tmp_path):
    from lodestat.operators.columns import POS, with_position
    from lodestat.plans.versions import Dataset

    n = 200_000
    df = spark.range(n).select(F.hash("id").alias("k"), F.pmod("id", F.lit(1000)).alias("g"), F.repeat(F.md5(F.col("id").cast("string")), 4).alias("w"))
    got = with_position(df.orderBy("k")).agg(F.count("*"), F.countDistinct(POS), F.max(POS)).first()
    assert tuple(got) == (n, n, n - 1)
    data = Dataset(spark, str(tmp_path / "d"))
    data.create(df)
    for operation, config, rows in (("sort", {"by": ["k"]}, n), ("filter", {"conditions": [{"column": "g", "operator": "lt", "value": 500}]}, n // 2), ("drop_duplicates", {"subset": ["g"]}, 500)):
        v = data.apply(operation, **config)
        got = data.read(v).agg(F.count("*"), F.countDistinct(POS), F.max(POS)).first()
        assert tuple(got) == (rows, rows, rows - 1), operation


def test_an_empty_result_leaves_no_version(spark, tmp_path):
    from lodestat.operators.columns import OperationError
    from lodestat.plans.versions import Dataset

    data = Dataset(spark, str(tmp_path / "d"))
    data.create(spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string"))
    for _ in range(2):
        with pytest.raises(OperationError):
            data.apply("filter", conditions=[{"column": "x", "operator": "gt", "value": 9}])
    assert data.apply("filter", conditions=[{"column": "x", "operator": "gt", "value": 1}]) == 2
    right = spark.createDataFrame([(7, "c")], "x int, z string")
    data.apply("merge", other=right, on=["x"], how="left")
    assert data.warnings == []


def test_merge_report(spark):
    from lodestat.operators.combine import merge, merge_report

    a = spark.createDataFrame([(k,) for k in (1, 1, 2, 3)], "k int")
    for keys, word in (((9,), "no rows"), ((2, 5), "rows lost"), ((1, 1, 2), "rows multiplied")):
        b = spark.createDataFrame([(k, "x") for k in keys], "k int, v string")
        report = merge_report(a, b, on=["k"])
        assert report["warnings"] == [w for w in report["warnings"] if w.startswith(word)] and len(report["warnings"]) == 1
    b = spark.createDataFrame([(k, "x") for k in (1, 2, 3)], "k int, v string")
    assert merge_report(a, b, on=["k"])["warnings"] == []


def test_fits_do_not_depend_on_scale(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    z = rng.normal(size=3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-z))).astype(int)
    fits = []
    for scale, shift in ((1.0, 0.0), (20_000.0, 50_000.0), (1e-3, 10.0)):
        df = spark.createDataFrame(pd.DataFrame({"x": z * scale + shift, "y": y, "w": 2 * (z * scale + shift) + rng.normal(size=3000) * scale}))
        r = run_analysis(df, "logistic_regression", target="y", features=["x"])
        assert r["status"] == "ok"
        fits.append((r["tables"]["coefficients"][1]["coefficient"] * scale, r["tables"]["coefficients"][1]["standard_error"] * scale, r["estimate"]["log_likelihood"]))
        slope = run_analysis(df, "linear_regression", target="w", features=["x"])["tables"]["coefficients"][1]
        assert abs(slope["coefficient"] - 2) < 5 * slope["standard_error"] < 0.2
    for f in fits[1:]:
        assert f == pytest.approx(fits[0], rel=1e-3)
    far = spark.createDataFrame(pd.DataFrame({"x": 1.7e9 + z, "y": 2 * (1.7e9 + z) + rng.normal(size=3000)}))
    assert run_analysis(far, "linear_regression", target="y", features=["x"])["tables"]["coefficients"][1]["coefficient"] == pytest.approx(2, abs=0.1)


def test_kendall_of_many_values_is_exact(spark, monkeypatch):
    import numpy as np
    import pandas as pd
    from lodestat.stats import association

    rng = np.random.default_rng(2)
    x = rng.integers(0, 40, 300)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": x + rng.integers(0, 30, 300)}))
    want = association.kendall_counts(df, "x", "y")
    monkeypatch.setattr(association, "MATRIX", 0)
    assert association.kendall_counts(df, "x", "y").tolist() == want.tolist()


def test_running_totals_over_ranges(spark):
    from lodestat.stats.basic import running_totals

    rows = [(g, t, t % 3) for g in "ab" for t in range(200)]
    got = {(r.g, r.t): r.n_upto for r in running_totals(spark.createDataFrame(rows, "g string, t int, n long"), "t", ["n"], group="g", descending=True).collect()}
    assert got == {(g, t): sum(k % 3 for k in range(t, 200)) for g in "ab" for t in range(200)}


def test_remedies_profiles_and_wide_charts(spark):
    from lodestat.plans import charts, profile

    df = spark.createDataFrame([(k, "7", None, float(k % 5)) for k in range(40)], "id int, text string, blank string, v double")
    found = {f["code"] for f in profile.remedies(profile.validate(df))}
    assert {"column_all_missing", "constant_column", "numeric_stored_as_text"} <= found and "likely_identifier" not in found
    p = profile.dataset_profile(df)
    assert p["rows"] == 40 and p["complete_rows"] == 0 and p["columns"]["v"]["outliers"] == 0 and any("blank" in w for w in p["warnings"])
    panel = spark.createDataFrame([("a", "p", 1.0), ("a", "q", 2.0), ("b", "p", 3.0)], "x string, series string, value double")
    assert [tuple(r) for r in charts.wide(panel).collect()] == [("a", 1.0, 2.0), ("b", 3.0, None)]
